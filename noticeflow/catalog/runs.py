"""Queries that run the whole funnel over documents, labels, events, orders and customers."""

from datetime import datetime

from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.catalog import joins, texts
from noticeflow.catalog.base import View, case, norm_sql, padded, query, text
from noticeflow.operators import reports
from noticeflow.plans import funnel
from noticeflow.session import scratch_path
from noticeflow.sources import state
from noticeflow.streaming import intake

RUN = funnel.Run(as_of=datetime(2026, 6, 15, 9, 30))

NOTICES = View("documents", {
    **{k: v for k, v in texts.NOTICES.columns.items() if k != "text"},
    "item_key": "'SC' || " + padded("doc_id", 8) + " || '|' || " + text("doc_id"),
    "enrich_error": case("doc_id % 13", {"5": "'404 Client Error'", "6": "'Read timed out'"}, "''"),
})
ORGANISATIONS = View("documents", {
    "school_code": NOTICES.columns["school_code"],
    "school_name": "'Istituto ' || " + text("doc_id"),
    "region": "lang",
    "cup": NOTICES.columns["cup"],
    "clp": NOTICES.columns["clp"],
    "amount": text("doc_id + 40000") + " || '.00'",
})
TEXTS = View("documents", {
    "item_key": NOTICES.columns["item_key"],
    "text": texts.NOTICES.columns["text"],
    "hydrate_error": case("doc_id % 17", {"3": "'404 Client Error'", "4": "'Read timed out'"}, "''"),
})
VERDICTS = View("labels", {
    "item_key": NOTICES.columns["item_key"],
    "answer": texts.VERDICTS.columns["answer"],
    "error": texts.VERDICTS.columns["error"],
    "same_process": "quality = 1",
    "actionable": "toxic = 0",
})
# Earlier runs: notices of the organisations that had signed up, and the alerts of active buyers.
PROCESSED = View("events", {"item_key": "'SC' || " + padded("user_id", 8) + " || '|' || " + text("user_id")},
                 where="event_type = 'signup'")
ALERTS = View("events", {
    "alert_key": "lower('SC' || " + padded("user_id", 8) + " || '|' || 'H74D' || " + padded("user_id", 11)
                 + " || '|M4C1I2.1-2026-1745-P-' || " + text("user_id") + " || '|https://albo.example.it/src' || "
                 + text("user_id % 20") + " || '/' || " + text("user_id") + ")",
    "status": "CASE WHEN value > 20 THEN 'sent' ELSE 'failed' END",
    "updated_at": "cast(ts as timestamp)",
}, where="event_type = 'purchase'")
THREADS = View("orders", {
    **joins.THREADS.columns,
    "updated_at": "cast(o_orderdate as timestamp) + INTERVAL '28' YEAR",
}, where=joins.THREADS.where)


def _inputs(spark, sf_dir):
    # a customer's alert may have several attempts: the key keeps its best state
    attempts = ALERTS.df(spark, sf_dir)
    alerts = attempts.groupBy("alert_key").agg(F.max("status").alias("status"), F.max("updated_at").alias("updated_at"))
    known = joins._signalled(THREADS, spark, sf_dir)
    return alerts, known


def decided(spark, sf_dir):
    alerts, _ = _inputs(spark, sf_dir)
    rows = funnel.decide(NOTICES.df(spark, sf_dir), ORGANISATIONS.df(spark, sf_dir), TEXTS.df(spark, sf_dir),
                         VERDICTS.df(spark, sf_dir), PROCESSED.df(spark, sf_dir), alerts, RUN)
    return rows.withColumn("seq", F.col("item_id").cast("bigint"))


def planned(spark, sf_dir, rows):
    alerts, known = _inputs(spark, sf_dir)
    return funnel.plan_alerts(rows, known, alerts.withColumn("school_code", F.lit("")).withColumn("url", F.lit("")), RUN)


def decided_once(spark, sf_dir):
    """The decided rows, kept for the several passes that follow."""
    from noticeflow.session import cut_lineage

    return cut_lineage(decided(spark, sf_dir))


# --- the same funnel as one SQL statement -------------------------------------------------------------------------

_CONTEXT = "trim('Categoria: ' || category || ' | Pubblicato: ' || published || ' | Scadenza: ' || expires) || chr(10) || text"
_BASE = f"""(SELECT n.* EXCLUDE (enrich_error), n.enrich_error, t.text AS body, t.hydrate_error FROM {NOTICES.sql} n JOIN {TEXTS.sql} t USING (item_key))"""
_DOCS = f"""(SELECT doc_id, cup, clp, title, url, {_CONTEXT} AS text FROM (SELECT * REPLACE (body AS text) FROM (SELECT *, body AS text FROM {_BASE})))"""
_PREF = texts._PREFILTER_SQL.replace("contains(t,", f"contains(pre,")
_KIND0_DUE = "(CASE WHEN doc_id % 3 = 0 THEN DATE '2026-06-01' ELSE DATE '2026-07-01' END + cast(doc_id % 28 AS INTEGER))"
_SCREEN = f"""(SELECT *, CASE
      WHEN NOT {_PREF} THEN 'prefilter_rejected'
      WHEN enrich_error <> '' THEN 'enrich_error'
      WHEN vendor = 'Search' AND published <> '' THEN 'outside_search_window'
      WHEN expires = '31/05/2026' THEN 'expired'
      WHEN hydrate_error <> '' THEN 'hydrate_error'
      WHEN doc_id % 8 = 0 AND {_KIND0_DUE} < DATE '2026-06-15' THEN 'expired' END AS stage1
    FROM (SELECT *, {norm_sql("title || ' ' || category")} AS pre FROM {_BASE})
    WHERE item_key NOT IN (SELECT item_key FROM {PROCESSED.sql}))"""
_GATED = texts._GATE_SQL.replace(texts.NOTICES.sql, _DOCS)
_SIGNALS = f"""(SELECT d.doc_id, d.cup, {norm_sql("d.title || ' ' || d.text")} AS sig FROM {_DOCS} d)"""
_JUDGED = f"""(SELECT s.*, CASE WHEN s.stage1 IS NOT NULL THEN s.stage1 WHEN g.gate_stage <> 'passed' THEN g.gate_stage
      WHEN lower(s.school_code || '|' || s.cup || '|' || s.clp || '|' || s.url) IN (SELECT alert_key FROM {ALERTS.sql} WHERE status = 'sent')
        THEN 'already_alerted' END AS stage2, s.stage1 IS NULL AND g.gate_stage = 'passed' AS is_confirmed, g.ai_used AS scored, x.sig
    FROM {_SCREEN} s JOIN ({_GATED}) g ON s.doc_id = g.doc_id JOIN {_SIGNALS} x ON x.doc_id = s.doc_id)"""
_ITEMS = f"""(SELECT cast(doc_id AS string) AS item_key, school_code, cup,
      array_to_string({texts.hits_sql('sig', vocab.ROLE_TERMS)}, ',') AS roles,
      nullif(regexp_extract(sig, {texts._re(vocab.PROTOCOL)}, 1) || '|' || regexp_extract(sig, {texts._re(vocab.PROTOCOL)}, 2), '|') AS protocol_ref,
      CASE doc_id % 3 WHEN 0 THEN DATE '2026-05-29' WHEN 1 THEN DATE '2026-05-10' END AS published_date, l.quality = 1 AS same_process,
      CASE WHEN regexp_matches(sig, {texts._re(vocab.APPLY_INSTRUCTION)}) THEN true
           WHEN regexp_matches(sig, {texts._re(vocab.AUTHORISING_ONLY)}) OR NOT regexp_matches(sig, {texts._re(vocab.WEAK_APPLICATION)}) THEN false
           ELSE coalesce(l.toxic = 0, true) END AS actionable
    FROM {_JUDGED} j LEFT JOIN labels l USING (doc_id) WHERE stage2 IS NULL)"""
_OPEN = f"""(SELECT * FROM {THREADS.sql} WHERE status IN ('held', 'sent') AND updated_at >= timestamp '2026-06-15 09:30:00' - INTERVAL 60 DAY)"""
_MATCHED = joins._MATCH.replace(joins.ITEMS.sql, "funnel_items").replace(joins._OPEN, _OPEN)
FINAL_SQL = f"""
    WITH funnel_items AS MATERIALIZED {_ITEMS}, judged AS MATERIALIZED {_JUDGED}
    SELECT j.item_key, coalesce(stage2, CASE WHEN m.thread_status = 'sent' THEN CASE WHEN i.actionable THEN 'alerted' ELSE 'suppressed_duplicate' END
        ELSE CASE WHEN i.actionable THEN 'alerted' ELSE 'held' END END) AS stage,
      CASE WHEN stage2 = 'enrich_error' THEN doc_id % 13 = 5 WHEN stage2 = 'hydrate_error' THEN doc_id % 17 = 3
        ELSE coalesce(stage2, '') <> 'ai_unavailable_deferred_ambiguous' END AS processed, is_confirmed AS confirmed
    FROM judged j LEFT JOIN funnel_items i ON cast(j.doc_id AS string) = i.item_key LEFT JOIN {_MATCHED} m ON m.item_key = i.item_key"""


@query("funnel", FINAL_SQL)
def q_funnel(spark, sf_dir):
    rows = decided_once(spark, sf_dir)
    return funnel.final_decisions(rows, planned(spark, sf_dir, rows)).select("item_key", "stage", "processed", "confirmed")


@query("processed_policy", f"SELECT stage, processed, count(*) AS n FROM ({FINAL_SQL}) GROUP BY stage, processed")
def q_policy(spark, sf_dir):
    rows = decided_once(spark, sf_dir)
    final = funnel.final_decisions(rows, planned(spark, sf_dir, rows))
    return final.groupBy("stage", "processed").agg(F.count(F.lit(1)).alias("n"))


# Reasons of every step; of a deadline found in a text only the sentence's beginning is compared.
_RULED = texts._VERDICT_SQL.replace(texts.NOTICES.sql, _DOCS)
_CAUSE = "CASE WHEN coalesce(v.error, '') <> '' THEN 'disponibile: ' || v.error ELSE 'consultata - mode/budget/key' END"
_LATE = "Document-stated application deadline "


def _quoted(sentence):
    return "'" + sentence.replace("'", "''") + "'"


_REASONS = f"""(SELECT f.*, f.confirmed AND g.unverified AS unverified,
      CASE WHEN v.answer IS NOT NULL AND coalesce(v.error, '') = '' THEN
          CASE WHEN len(string_split(v.answer, '|')) > 4 THEN trim(split_part(v.answer, '|', 5)) ELSE trim(v.answer) END
        WHEN g.unverified THEN 'NON VERIFICATO DA AI - possibile opportunità basata solo sulle regole (AI non ' || {_CAUSE} || '). ' || r.reason ELSE r.reason END AS told,
      CASE f.stage WHEN 'prefilter_rejected' THEN {_quoted(funnel.PREFILTER_REASON)} WHEN 'enrich_error' THEN left(n.enrich_error, {vocab.ERROR_CHARS})
        WHEN 'hydrate_error' THEN left(t.hydrate_error, {vocab.ERROR_CHARS})
        WHEN 'outside_search_window' THEN 'Published ' || n.published || ', older than the rolling {vocab.SEARCH_WINDOW_DAYS}-day search window as of today.'
        WHEN 'expired' THEN CASE WHEN n.expires = '31/05/2026' THEN 'Platform-reported archive/expiry date ' || n.expires || ' has passed.' ELSE '{_LATE}' END
        WHEN 'rule_rejected' THEN left(r.reason, {vocab.REASON_CHARS}) WHEN 'ai_rejected' THEN left('AI rejected candidate: ' || trim(v.answer), {vocab.REASON_CHARS})
        WHEN 'already_alerted' THEN {_quoted(funnel.ALREADY_REASON)} WHEN 'held' THEN {_quoted(funnel.HELD_REASON)}
        WHEN 'suppressed_duplicate' THEN 'No new information beyond what was already sent (' || m.why || ').' END AS why
    FROM ({FINAL_SQL}) f JOIN {NOTICES.sql} n USING (item_key) JOIN {TEXTS.sql} t USING (item_key) JOIN ({_GATED}) g USING (doc_id) JOIN {_RULED} r USING (doc_id)
    LEFT JOIN {VERDICTS.sql} v USING (item_key)
    LEFT JOIN (WITH funnel_items AS MATERIALIZED {_ITEMS} SELECT item_key AS id, {joins._WHY} AS why FROM {_MATCHED}) m ON m.id = cast(n.doc_id AS string))"""


@query("decision_log", f"""
    WITH told AS MATERIALIZED (SELECT * FROM {_REASONS})
    SELECT item_key, stage, 3 AS step, CASE WHEN stage = 'alerted' THEN told WHEN stage LIKE 'ai_unavailable%' THEN 'deferred' ELSE why END AS reason FROM told
    UNION ALL SELECT item_key, 'confirmed', 2, told FROM told WHERE stage IN ('alerted', 'held', 'suppressed_duplicate')
    UNION ALL SELECT item_key, 'confirmed_unverified', 1, left(told, {vocab.REASON_CHARS}) FROM told WHERE unverified""")
def q_log(spark, sf_dir):
    rows = decided_once(spark, sf_dir)
    log = funnel.decision_log(rows, planned(spark, sf_dir, rows))
    reason = F.when(F.col("stage").startswith("ai_unavailable"), "deferred").when(
        F.startswith("reason", F.lit(_LATE)), F.lit(_LATE)).otherwise(F.col("reason"))
    return log.select("item_key", "stage", "step", reason.alias("reason"))


_MATCHED_RULE = "g.gate_stage <> 'rule_rejected' AND stage NOT IN ('prefilter_rejected', 'enrich_error', 'outside_search_window', 'expired', 'hydrate_error')"


@query("run_stats", f"""
    SELECT (SELECT count(*) FROM {ORGANISATIONS.sql} WHERE region <> 'de') AS schools, (SELECT count(*) FROM {ORGANISATIONS.sql} WHERE region = 'de') AS unsupported,
      count(*) AS new_items, count(*) FILTER (WHERE stage <> 'prefilter_rejected' AND stage <> 'superseded') AS prefiltered,
      count(*) FILTER (WHERE f.confirmed) AS confirmed, count(*) FILTER (WHERE stage = 'alerted') AS alerts,
      count(*) FILTER (WHERE {_MATCHED_RULE} AND coalesce(v.error, '') <> '') AS ai_failures,
      count(*) FILTER (WHERE {_MATCHED_RULE} AND g.ai_used) AS ai_verified, count(*) FILTER (WHERE {_MATCHED_RULE} AND NOT g.ai_used) AS rule_only
    FROM ({FINAL_SQL}) f JOIN {NOTICES.sql} n USING (item_key) JOIN ({_GATED}) g USING (doc_id) LEFT JOIN {VERDICTS.sql} v USING (item_key)""")
def q_stats(spark, sf_dir):
    rows = decided_once(spark, sf_dir)
    final = funnel.final_decisions(rows, planned(spark, sf_dir, rows))
    polled = ORGANISATIONS.df(spark, sf_dir).select((F.col("region") != "de").alias("supported"))
    return reports.run_stats(final, polled)


@query("alert_digest", f"""SELECT item_key, 1 AS n FROM ({FINAL_SQL}) WHERE stage = 'alerted'""")
def q_alert_digest(spark, sf_dir):
    rows = decided_once(spark, sf_dir)
    plan = planned(spark, sf_dir, rows)
    _, known = _inputs(spark, sf_dir)
    sent = plan.filter(F.col("stage") == "alerted").select("item_key", "group_key")
    messages = funnel.alert_digest(plan, known).filter(F.length("subject") > 5)
    return sent.join(messages, "group_key").groupBy("item_key").agg(F.count(F.lit(1)).alias("n"))


@query("stream_runs", f"SELECT item_key, stage, processed FROM ({FINAL_SQL})")
def q_stream_runs(spark, sf_dir):
    """The same run over a stream of notices, from stored state to stored decisions."""
    alerts, known = _inputs(spark, sf_dir)
    root, none = scratch_path(spark, "runs"), F.lit(None).cast("string")
    blank = {c: none for c in ("school_code", "url", "message_id", "subject", "title", "published")}
    state.write_state(alerts.withColumns(blank | {"created_at": F.col("updated_at")}), root, "alerts")
    seen = PROCESSED.df(spark, sf_dir).distinct().withColumns(blank | {"first_seen": F.lit(RUN.utc)})
    state.write_state(seen, root, "processed_items")
    state.write_state(known.withColumn("created_at", F.col("updated_at")), root, "call_threads")
    tables = {"registry": ORGANISATIONS.df(spark, sf_dir), "texts": TEXTS.df(spark, sf_dir), "verdicts": VERDICTS.df(spark, sf_dir)}
    intake.stream_funnel(NOTICES.stream(spark, sf_dir), lambda: tables, RUN, root, scratch_path(spark, "offsets"))
    done = state.read_state(spark, root, "processed_items").select("item_key", F.lit(True).alias("processed"))
    return state.read_state(spark, root, "decisions").select("item_key", "stage").join(done, "item_key", "left").withColumn(
        "processed", F.coalesce("processed", F.lit(False)))
