"""Queries over history joins, threads, groups and ordered picks."""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.catalog.base import FEED, ORDER_NOTICES, PROJECTS, View, case, italian_date, padded, query, table, text
from noticeflow.functions.text import first_non_empty
from noticeflow.operators import lookups, ranking, reports, threads
from noticeflow.operators.clusters import cluster_new

# What earlier runs had processed: everything published in the first half of the month.
PROCESSED = View("events", FEED.columns, where="ts < timestamp '2024-01-16 00:00:00'")


@query("new_notices", f"""SELECT f.item_key, f.title, f.published FROM {FEED.sql} f
    WHERE NOT EXISTS (SELECT 1 FROM {PROCESSED.sql} p WHERE p.item_key = f.item_key)""")
def q_new(spark, sf_dir):
    fresh = lookups.new_notices(FEED.df(spark, sf_dir), PROCESSED.df(spark, sf_dir))
    return fresh.select("item_key", "title", "published")


@query("key_difference", f"""SELECT DISTINCT school_code FROM {ORDER_NOTICES.sql} WHERE school_code NOT IN (SELECT school_code FROM {FEED.sql})""")
def q_difference(spark, sf_dir):
    return lookups.key_difference(ORDER_NOTICES.df(spark, sf_dir), FEED.df(spark, sf_dir), "school_code")


@query("superseded", f"""
    SELECT n.item_id, (n.status = 'O' AND EXISTS (
        SELECT 1 FROM {ORDER_NOTICES.sql} r WHERE r.school_code = n.school_code AND r.status = 'F'
        AND (n.published = '' OR r.published = '' OR r.day >= n.day))) AS superseded FROM {ORDER_NOTICES.sql} n""")
def q_superseded(spark, sf_dir):
    return lookups.with_superseded(ORDER_NOTICES.df(spark, sf_dir)).select("item_id", "superseded")


@query("superseded_over_time", f"""
    SELECT n.item_id, (n.status = 'O' AND EXISTS (
        SELECT 1 FROM {ORDER_NOTICES.sql} r WHERE r.school_code = n.school_code AND r.status = 'F' AND r.seq % 3 <= n.seq % 3
        AND (n.published = '' OR r.published = '' OR r.day >= n.day))) AS superseded FROM {ORDER_NOTICES.sql} n""")
def q_superseded_over_time(spark, sf_dir):
    """Three polls: result acts of earlier ones close later notices, those of later ones come too late."""
    notices, earlier, polls = ORDER_NOTICES.df(spark, sf_dir), None, []
    for poll in range(3):
        now = notices.filter(F.col("seq") % 3 == poll)
        polls.append(lookups.with_superseded(now, earlier=earlier).select("item_id", "superseded"))
        acts = lookups.result_acts(now)
        earlier = acts if earlier is None else lookups.merge_result_acts(earlier, acts)
    return reduce(DataFrame.unionByName, polls)


@query("project_lookup", f"""SELECT n.item_id, n.school_code, p.school_name, p.region, p.amount
    FROM {ORDER_NOTICES.sql} n LEFT JOIN {PROJECTS.sql} p ON n.school_code = p.school_code""")
def q_project(spark, sf_dir):
    found = lookups.project_lookup(ORDER_NOTICES.df(spark, sf_dir).select("item_id", "school_code"),
                                   PROJECTS.df(spark, sf_dir), ["school_name", "region", "amount"])
    return found


# Detail records: one per order that has lines; the archive date is the last shipping day.
_DETAIL_SQL = f"""(SELECT l_orderkey, max(l_shipdate) AS shipped, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey)"""


def _details(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("shipped"), F.min("l_returnflag").alias("flag"))
    effective = f"CASE WHEN flag = 'A' THEN {italian_date('shipped')} ELSE '' END"
    return lines.selectExpr(
        "cast(l_orderkey as string) AS detail_ref", f"{effective} AS detail_expires",
        f"CASE WHEN flag = 'R' THEN {italian_date('shipped')} END AS detail_original",
        "CASE WHEN flag = 'N' THEN '' ELSE 'Tipo ' || flag END AS detail_category")


@query("detail_join", f"""SELECT n.item_id, CASE WHEN flag = 'A' THEN {italian_date('shipped')} WHEN d.l_orderkey IS NOT NULL THEN '' END AS detail_expires
    FROM {ORDER_NOTICES.sql} n LEFT JOIN {_DETAIL_SQL} d ON n.seq = d.l_orderkey""")
def q_detail(spark, sf_dir):
    listing = ORDER_NOTICES.df(spark, sf_dir).select("item_id", F.col("item_id").alias("detail_ref"))
    return lookups.detail_join(listing, _details(spark, sf_dir)).select("item_id", "detail_expires")


@query("enrich_notice", f"""SELECT n.item_id,
      CASE WHEN flag IN ('A', 'R') THEN {italian_date('shipped')} ELSE n.expires END AS expires,
      CASE WHEN flag IN ('A', 'R') THEN 'Tipo ' || flag ELSE n.category END AS category
    FROM {ORDER_NOTICES.sql} n LEFT JOIN {_DETAIL_SQL} d ON n.seq = d.l_orderkey""")
def q_enrich(spark, sf_dir):
    listing = ORDER_NOTICES.df(spark, sf_dir).select("item_id", F.col("item_id").alias("detail_ref"), "expires", "category")
    return lookups.enrich_notice(lookups.detail_join(listing, _details(spark, sf_dir))).select("item_id", "expires", "category")


@query("first_non_empty", f"""SELECT item_id, coalesce(nullif(expires, ''), nullif(published, ''), 'n.d.') AS shown FROM {ORDER_NOTICES.sql}""")
def q_first_non_empty(spark, sf_dir):
    return ORDER_NOTICES.df(spark, sf_dir).select(
        "item_id", first_non_empty(F.col("expires"), F.col("published"), F.lit("n.d.")).alias("shown"))


# --- threads: orders that are not open calls are earlier documents of the same customer's project ---------

AS_OF = datetime(1998, 6, 1, 12, 0)
_AS_OF_SQL = "timestamp '1998-06-01 12:00:00'"
_CUP = "'H74D' || " + padded("o_custkey", 11)
_ROLES = case("o_orderkey % 4", {"0": "'esperto'", "1": "'tutor'", "2": "'esperto,tutor'"}, "''")
_PROTOCOL = "CASE WHEN o_orderkey % 3 = 0 THEN " + text("o_custkey") + " || '|' || " + text("o_orderkey % 2") + " END"
THREADS = View("orders", {
    "thread_id": "'T' || " + text("o_orderkey"),
    "school_code": "'SC' || " + padded("o_custkey", 8),
    "cup": _CUP,
    "clp": "'M4C1I2.1-2026-1745-P-' || " + text("o_custkey"),
    "roles": _ROLES,
    "protocol_ref": _PROTOCOL,
    "status": "CASE WHEN o_orderstatus = 'F' THEN 'sent' WHEN o_orderpriority = '5-LOW' THEN 'closed' ELSE 'held' END",
    "subject": "'Oggetto ' || " + text("o_orderkey"),
    "message_id": "'<' || " + text("o_orderkey") + " || '@x.it>'",
    "last_item_key": text("o_orderkey"),
    "last_title": "o_orderpriority",
    "updated_at": "cast(o_orderdate as timestamp)",
}, where="o_orderstatus <> 'O'")
ITEMS = View("orders", {
    "item_key": text("o_orderkey"),
    "seq": "o_orderkey",
    "school_code": "'SC' || " + padded("o_custkey", 8),
    "cup": "CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 5 = 0 THEN '' ELSE " + _CUP + " END",
    "roles": _ROLES,
    "protocol_ref": _PROTOCOL,
    "published_date": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(o_orderdate as date) END",
    "same_process": "o_totalprice > 250000",
    "actionable": "o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "title": "'Avviso ' || " + text("o_orderkey"),
}, where="o_orderstatus = 'O'")


def _signalled(view, spark, sf_dir):
    df = view.df(spark, sf_dir)
    roles = F.filter(F.split("roles", ","), lambda r: r != "")
    return df.withColumn("role_signature", roles).drop("roles")


_OPEN = f"""(SELECT * FROM {THREADS.sql} WHERE status IN ('held', 'sent') AND updated_at >= {_AS_OF_SQL} - INTERVAL 60 DAY)"""


@query("open_threads", f"SELECT thread_id, school_code, status FROM {_OPEN}")
def q_open(spark, sf_dir):
    return threads.open_threads(_signalled(THREADS, spark, sf_dir), AS_OF).select("thread_id", "school_code", "status")


@query("thread_ttl", f"SELECT status, count(*) AS n, count(*) FILTER (WHERE thread_id IN (SELECT thread_id FROM {_OPEN})) AS n_open FROM {THREADS.sql} GROUP BY status")
def q_ttl(spark, sf_dir):
    known = _signalled(THREADS, spark, sf_dir)
    alive = threads.open_threads(known, AS_OF).select("thread_id", F.lit(1).alias("alive"))
    return known.join(alive, "thread_id", "left").groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count("alive").alias("n_open"))


_MATCH = f"""(
    WITH pairs AS (
      SELECT i.item_key, i.same_process, t.thread_id, t.status, t.updated_at,
             coalesce(abs(i.published_date - cast(t.updated_at AS date)), 31) AS dist,
             i.protocol_ref = t.protocol_ref AS same_ref,
             list_has_any(list_filter(string_split(i.roles, ','), lambda x: x <> ''), string_split(t.roles, ',')) AS same_role
      FROM {ITEMS.sql} i JOIN {_OPEN} t ON i.school_code = t.school_code AND i.cup = t.cup),
    ranked AS (
      SELECT *, CASE WHEN same_ref THEN 1 WHEN same_role AND dist <= 5 THEN 2 WHEN same_process AND dist <= 30 THEN 3 END AS way
      FROM pairs)
    SELECT i.item_key, r.thread_id, r.status AS thread_status, r.way, a.item_key IS NOT NULL AS any_open
    FROM {ITEMS.sql} i
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY way, CASE WHEN way = 3 THEN dist ELSE 0 END,
                 updated_at DESC, thread_id) AS rn FROM ranked WHERE way IS NOT NULL) r ON i.item_key = r.item_key AND r.rn = 1
    LEFT JOIN (SELECT DISTINCT item_key FROM pairs) a ON i.item_key = a.item_key)"""
_WHY = """CASE way WHEN 1 THEN 'matching protocol reference' WHEN 2 THEN 'overlapping role + close publish date'
    WHEN 3 THEN 'AI judged same process' ELSE CASE WHEN any_open THEN 'no matching thread' ELSE 'no open threads for this CUP' END END"""


@query("match_thread", f"SELECT item_key, thread_id, thread_status, {_WHY} AS match_why FROM {_MATCH}")
def q_match(spark, sf_dir):
    matched = threads.match_thread(_signalled(ITEMS, spark, sf_dir), _signalled(THREADS, spark, sf_dir), AS_OF)
    return matched.select("item_key", "thread_id", "thread_status", "match_why")


@query("resolve_thread", f"""
    SELECT m.item_key, m.thread_id,
      CASE WHEN m.thread_status = 'sent' THEN CASE WHEN actionable THEN 'send_reply' ELSE 'suppress' END
           ELSE CASE WHEN actionable THEN 'send_new' ELSE 'hold' END END AS action,
      CASE WHEN i.cup = '' THEN 'No CUP to link against.'
           WHEN m.thread_id IS NULL AND any_open THEN 'New process for this CUP (' || {_WHY} || ').'
           WHEN m.thread_id IS NULL THEN 'First document seen for this CUP.'
           WHEN m.thread_status = 'held' AND actionable THEN 'Held thread now has actionable content (' || {_WHY} || ').'
           WHEN m.thread_status = 'held' THEN 'Still no actionable content (' || {_WHY} || ').'
           WHEN actionable THEN 'Companion document for an already-sent process (' || {_WHY} || ').'
           ELSE 'No new information beyond what was already sent (' || {_WHY} || ').' END AS action_reason
    FROM {_MATCH} m JOIN {ITEMS.sql} i ON m.item_key = i.item_key""")
def q_resolve(spark, sf_dir):
    matched = threads.match_thread(_signalled(ITEMS, spark, sf_dir), _signalled(THREADS, spark, sf_dir), AS_OF)
    return threads.resolve_thread(matched).select("item_key", "thread_id", "action", "action_reason")


@query("nearest_thread", f"""
    SELECT item_key, thread_id, dist AS days FROM (
      SELECT i.item_key, t.thread_id, abs(i.published_date - cast(t.updated_at AS date)) AS dist,
             row_number() OVER (PARTITION BY i.item_key ORDER BY abs(i.published_date - cast(t.updated_at AS date)), t.updated_at DESC, t.thread_id) AS rn
      FROM {ITEMS.sql} i JOIN {_OPEN} t ON i.school_code = t.school_code AND i.cup = t.cup
      WHERE abs(i.published_date - cast(t.updated_at AS date)) <= 30) WHERE rn = 1""")
def q_nearest(spark, sf_dir):
    return threads.nearest_thread(_signalled(ITEMS, spark, sf_dir), _signalled(THREADS, spark, sf_dir), AS_OF)


@query("thread_root", f"""SELECT m.item_key, m.thread_id, t.message_id AS root_message_id, t.subject AS root_subject
    FROM {_MATCH} m LEFT JOIN {THREADS.sql} t ON m.thread_id = t.thread_id""")
def q_root(spark, sf_dir):
    known = _signalled(THREADS, spark, sf_dir)
    matched = threads.match_thread(_signalled(ITEMS, spark, sf_dir), known, AS_OF).select("item_key", "thread_id")
    return lookups.thread_root(matched, known).select("item_key", "thread_id", "root_message_id", "root_subject")


# --- groups: order lines are alerts, an order is one selection process -------------------------------------

_SEQ = "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint)"
ENTRIES = View("lineitem", {
    "seq": _SEQ,
    "group_key": "'G' || " + text("l_orderkey"),
    "item_key": text(_SEQ),
    "title": "'Avviso ' || " + text("l_partkey"),
    "url": "'https://albo.example.it/' || " + text("l_partkey"),
    "roles": case("l_linenumber", {"1": "'esperto'", "2": "'tutor'", "3": "'esperto,tutor'", "4": "'rup'", "5": "'docente,rup'"}, "''"),
    "protocol_ref": "CASE WHEN l_suppkey % 4 = 0 THEN " + text("l_suppkey") + " || '|' || " + text("l_linenumber % 3") + " END",
    "published_date": "CASE WHEN l_discount > 0.05 THEN cast(l_shipdate as date) END",
    "action": "CASE WHEN l_returnflag = 'A' THEN 'suppress' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'hold' "
              "WHEN l_returnflag = 'N' THEN 'suppress' WHEN l_linestatus = 'O' THEN 'send_new' ELSE 'send_reply' END",
    "school_name": "'Istituto ' || " + text("l_suppkey"),
    "school_code": "'SC' || " + padded("l_suppkey", 8),
    "region": "'LAZIO'",
    "cup": "'H74D' || " + padded("l_suppkey", 11),
    "clp": "'M4C1I2.1-2026-1745-P-' || " + text("l_suppkey"),
    "amount": text("l_suppkey + 40000") + " || '.00'",
    "opportunity_type": "'esperti'",
    "deadline": "CASE WHEN l_returnflag = 'A' THEN 'non specificata' ELSE '15/07/2026' END",
    "confidence": "CASE WHEN l_linestatus = 'O' THEN 'high' ELSE 'medium' END",
    "ai_used": "l_linestatus = 'O'",
    "reason": "'motivo ' || " + text("l_linenumber"),
    "reply_subject": "CASE WHEN l_orderkey % 10 = 0 THEN 'Oggetto ' || " + text("l_orderkey") + " END",
})


@query("group_alerts", f"""SELECT coalesce(m.thread_id, i.school_code || '|' || coalesce(nullif(i.cup, ''), i.school_code)) AS group_key, count(*) AS n
    FROM {_MATCH} m JOIN {ITEMS.sql} i ON m.item_key = i.item_key GROUP BY 1""")
def q_groups(spark, sf_dir):
    matched = threads.match_thread(_signalled(ITEMS, spark, sf_dir), _signalled(THREADS, spark, sf_dir), AS_OF)
    key = threads.group_key(F.col("thread_id"), F.col("school_code"), F.col("cup"))
    return matched.groupBy(key.alias("group_key")).agg(F.count(F.lit(1)).alias("n"))


_ROLE_LIST = "list_filter(string_split(roles, ','), lambda x: x <> '')"


@query("cluster_new", f"""
    WITH RECURSIVE e AS (SELECT group_key, seq, {_ROLE_LIST} AS rs, protocol_ref AS p,
        row_number() OVER (PARTITION BY group_key ORDER BY seq) AS rn FROM {ENTRIES.sql}),
    walk AS (
      SELECT group_key, rn, seq, seq AS cluster_id, [{{'f': seq, 'r': rs, 'p': p}}] AS cs FROM e WHERE rn = 1
      UNION ALL
      SELECT group_key, rn, seq, CASE WHEN k > 0 THEN cs[k].f ELSE seq END,
        CASE WHEN k > 0 THEN list_transform(cs, lambda c, i: CASE WHEN i = k
               THEN {{'f': c.f, 'r': list_distinct(list_concat(c.r, rs)), 'p': coalesce(c.p, p)}} ELSE c END)
             ELSE list_append(cs, {{'f': seq, 'r': rs, 'p': p}}) END
      FROM (SELECT e.*, w.cs, coalesce(list_position(list_transform(w.cs, lambda c: coalesce(c.p = e.p, false) OR list_has_any(c.r, e.rs)), true), 0) AS k
            FROM walk w JOIN e ON e.group_key = w.group_key AND e.rn = w.rn + 1))
    SELECT group_key, seq, cluster_id FROM walk""")
def q_cluster(spark, sf_dir):
    entries = _signalled(ENTRIES, spark, sf_dir).select("group_key", "seq", "role_signature", "protocol_ref")
    return cluster_new(entries, "group_key", "seq").select("group_key", "seq", "cluster_id")


@query("merge_signals", f"""
    SELECT g.group_key, array_to_string(list_sort(list_distinct(g.all_roles)), ',') AS roles, p.protocol_ref, d.published_date
    FROM (SELECT group_key, list_filter(flatten(list(string_split(roles, ','))), lambda x: x <> '') AS all_roles FROM {ENTRIES.sql} GROUP BY group_key) g
    LEFT JOIN (SELECT group_key, arg_min(protocol_ref, seq) AS protocol_ref FROM {ENTRIES.sql} WHERE protocol_ref IS NOT NULL GROUP BY group_key) p USING (group_key)
    LEFT JOIN (SELECT group_key, cast(arg_min(published_date, seq) AS string) AS published_date FROM {ENTRIES.sql} WHERE published_date IS NOT NULL GROUP BY group_key) d USING (group_key)""")
def q_merge(spark, sf_dir):
    merged = threads.merge_signals(_signalled(ENTRIES, spark, sf_dir), "group_key", "seq")
    return merged.select("group_key", F.array_join("role_signature", ",").alias("roles"), "protocol_ref",
                         F.col("published_date").cast("string").alias("published_date"))


@query("set_overlap", f"""SELECT a.group_key, a.seq, list_has_any(list_filter(string_split(a.roles, ','), lambda x: x <> ''), string_split(f.roles, ',')) AS overlaps
    FROM {ENTRIES.sql} a JOIN (SELECT group_key, arg_min(roles, seq) AS roles FROM {ENTRIES.sql} GROUP BY group_key) f USING (group_key)""")
def q_overlap(spark, sf_dir):
    entries = _signalled(ENTRIES, spark, sf_dir).select("group_key", "seq", "role_signature")
    first = entries.groupBy("group_key").agg(F.min_by("role_signature", "seq").alias("first_roles"))
    return entries.join(first, "group_key").select(
        "group_key", "seq", F.arrays_overlap("role_signature", "first_roles").alias("overlaps"))


@query("set_union", f"""SELECT a.group_key, a.seq, array_to_string(list_sort(list_distinct(list_filter(list_concat(string_split(a.roles, ','), string_split(f.roles, ',')), lambda x: x <> ''))), ',') AS roles
    FROM {ENTRIES.sql} a JOIN (SELECT group_key, arg_min(roles, seq) AS roles FROM {ENTRIES.sql} GROUP BY group_key) f USING (group_key)""")
def q_union(spark, sf_dir):
    entries = _signalled(ENTRIES, spark, sf_dir).select("group_key", "seq", "role_signature")
    first = entries.groupBy("group_key").agg(F.min_by("role_signature", "seq").alias("first_roles"))
    return entries.join(first, "group_key").select(
        "group_key", "seq", F.array_join(F.array_sort(F.array_union("role_signature", "first_roles")), ",").alias("roles"))


@query("group_action", f"""SELECT group_key, CASE WHEN bool_or(action = 'send_reply') THEN 'send_reply' WHEN bool_or(action = 'send_new') THEN 'send_new'
    WHEN bool_or(action = 'hold') THEN 'hold' ELSE 'suppress' END AS group_action, count(*) AS n_items FROM {ENTRIES.sql} GROUP BY group_key""")
def q_group_action(spark, sf_dir):
    return threads.group_action(ENTRIES.df(spark, sf_dir), "group_key")


@query("thread_last_item", f"""SELECT group_key, arg_max(item_key, seq) AS last_item_key, arg_max(title, seq) AS last_title FROM {ENTRIES.sql} GROUP BY group_key""")
def q_last_item(spark, sf_dir):
    return threads.thread_last_item(ENTRIES.df(spark, sf_dir), "group_key", "seq")


_BLOCK = """chr(10) || rn || '. ' || title || chr(10) || '   Link: ' || url || chr(10) || '   Tipo: ' || opportunity_type
    || ' | Scadenza: ' || deadline || ' | Affidabilità: ' || CASE confidence WHEN 'high' THEN 'alta' ELSE 'media' END
    || ' | Verifica IA: ' || CASE WHEN ai_used THEN 'sì' ELSE 'no' END || chr(10) || '   Perché: ' || reason || chr(10)"""


_SUBJECT = """CASE WHEN reply IS NOT NULL THEN 'Re: ' || reply
           WHEN n > 1 THEN 'Opportunità formatore IA PNRR: ' || name || ' — ' || n || ' avvisi'
           WHEN due <> 'non specificata' THEN 'Opportunità formatore IA PNRR: ' || name || ' (scade ' || due || ')'
           ELSE 'Opportunità formatore IA PNRR: ' || name END"""
_HEADER = """'Nuova opportunità di formazione PNRR sull''intelligenza artificiale confermata.' || chr(10) || chr(10)
      || 'Scuola: ' || name || chr(10) || 'Codice meccanografico: ' || code || chr(10) || 'Regione: ' || reg || chr(10)
      || 'CUP: ' || the_cup || chr(10) || 'CLP: ' || the_clp || chr(10) || 'Importo: ' || amt || chr(10) || chr(10)
      || 'Avvisi trovati (' || n || '):' || chr(10)"""
_HEADS = f"""(SELECT group_key, count(*) AS n, arg_min(school_name, seq) AS name, arg_min(school_code, seq) AS code, arg_min(region, seq) AS reg,
                 arg_min(cup, seq) AS the_cup, arg_min(clp, seq) AS the_clp, arg_min(amount, seq) AS amt, arg_min(deadline, seq) AS due,
                 min(reply_subject) AS reply, string_agg({_BLOCK}, '' ORDER BY seq) AS blocks
          FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY seq) AS rn FROM {ENTRIES.sql}) GROUP BY group_key)"""


@query("digest", f"SELECT group_key, {_SUBJECT} AS subject, {_HEADER} || blocks AS body FROM {_HEADS}")
def q_digest(spark, sf_dir):
    return reports.digest(ENTRIES.df(spark, sf_dir), ["seq"])


@query("digest_parts", f"""
    SELECT group_key, 0 AS block_no, {_SUBJECT} AS subject, {_HEADER} AS text FROM {_HEADS}
    UNION ALL SELECT group_key, rn, NULL, {_BLOCK} FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY seq) AS rn FROM {ENTRIES.sql})""")
def q_digest_parts(spark, sf_dir):
    """Headers and numbered blocks as rows: what a sender of messages of any size streams."""
    headers, blocks = reports.digest_parts(ENTRIES.df(spark, sf_dir), ["seq"])
    top = headers.select("group_key", F.lit(0).cast("long").alias("block_no"), "subject", F.col("header").alias("text"))
    return top.unionByName(blocks.select("group_key", F.col("block_no").cast("long").alias("block_no"), F.lit(None).cast("string").alias("subject"), "text"))


# --- ordered picks --------------------------------------------------------------------------------------------

@query("keep_first_per_key", f"SELECT school_code, category, min(seq) AS seq, arg_min(title, seq) AS title FROM {FEED.sql} GROUP BY 1, 2")
def q_keep_first(spark, sf_dir):
    rows = FEED.df(spark, sf_dir).select("school_code", "category", "seq", "title")
    return ranking.keep_first(rows, ["school_code", "category"], "seq")


@query("keep_last_per_key", f"SELECT school_code, max(seq) AS seq, arg_max(stage, seq) AS stage FROM {FEED.sql} GROUP BY 1")
def q_keep_last(spark, sf_dir):
    return ranking.keep_last(FEED.df(spark, sf_dir).select("school_code", "seq", "stage"), ["school_code"], "seq")


@query("budget_cap", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 500 AS granted FROM documents")
def q_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ranking.budget_cap(docs, "doc_id", 500, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "granted")


@query("rotate_order", f"""SELECT school_code, (rn - 1 - (37 % n) + n) % n AS run_order FROM (
    SELECT school_code, row_number() OVER (ORDER BY school_code) AS rn, count(*) OVER () AS n FROM {PROJECTS.sql})""")
def q_rotate(spark, sf_dir):
    from noticeflow.plans.mapping import run_order

    placed = ranking.ordinal(PROJECTS.df(spark, sf_dir).select("school_code"), [], ["school_code"])
    return run_order(placed, "ordinal", 37).select("school_code", "run_order")


@query("limit_projects", f"SELECT school_code FROM {PROJECTS.sql} ORDER BY school_code LIMIT 25")
def q_limit(spark, sf_dir):
    return ranking.limit_ordered(PROJECTS.df(spark, sf_dir).select("school_code"), 25, "school_code")


@query("top_k_per_group", f"""SELECT school_code, item_id, rank FROM (
    SELECT school_code, item_id, row_number() OVER (PARTITION BY school_code ORDER BY seq) AS rank FROM {FEED.sql}) WHERE rank <= 3""")
def q_top_k(spark, sf_dir):
    rows = FEED.df(spark, sf_dir).select("school_code", "item_id", "seq")
    return ranking.top_k(rows, ["school_code"], 3, "seq").select("school_code", "item_id", "rank")


@query("order_newest", f"SELECT item_key, stage, row_number() OVER (ORDER BY ts DESC, seq) AS position FROM {FEED.sql}")
def q_newest(spark, sf_dir):
    age = FEED.df(spark, sf_dir).withColumn("age", -F.unix_micros(F.col("ts").cast("timestamp")))
    placed = ranking.ordinal(age.select("item_key", "stage", "age", "seq", F.col("ts").alias("updated_at")), [], ["age", "seq"], "position")
    return reports.decision_trail(placed).select("item_key", "stage", "position")


@query("order_progressive", "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS position FROM customer")
def q_progressive(spark, sf_dir):
    from noticeflow.sources.registry import order_progressive

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("progressive"))
    placed = ranking.ordinal(rows.withColumn("n", F.expr("try_cast(progressive AS int)")), [], ["n"], "position")
    return order_progressive(placed).select("c_custkey", "position")


# --- counts ------------------------------------------------------------------------------------------------------

@query("mapping_counts", f"SELECT CASE vendor WHEN 'Other' THEN 'UNRESOLVED' ELSE vendor END AS vendor, count(*) AS n FROM {FEED.sql} GROUP BY 1")
def q_mapping_counts(spark, sf_dir):
    vendor = F.when(F.col("vendor") == "Other", " ").otherwise(F.col("vendor"))
    return reports.mapping_counts(FEED.df(spark, sf_dir).withColumn("vendor", vendor))


@query("ai_cooldown_counts", """SELECT count(*) FILTER (WHERE event_type = 'view') AS n_skipped,
    arg_max('429 at ' || event_id, ts) FILTER (WHERE event_type = 'error') AS last_error FROM events""")
def q_cooldown(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select(
        "ts", (F.col("event_type") == "view").alias("skipped"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("429 at "), F.col("event_id").cast("string"))).alias("error"))
    return reports.ai_cooldown_counts(attempts)


@query("reconcile_counts", f"""SELECT 'processed_items' AS table_name, 'source' AS side, count(*) AS n FROM {FEED.sql}
    UNION ALL SELECT 'processed_items', 'target', count(*) FROM {PROCESSED.sql}
    UNION ALL SELECT 'call_threads', 'source', count(*) FROM {THREADS.sql}
    UNION ALL SELECT 'call_threads', 'target', count(*) FROM {_OPEN}""")
def q_reconcile(spark, sf_dir):
    known = _signalled(THREADS, spark, sf_dir)
    return reports.reconcile_counts({
        "processed_items": (FEED.df(spark, sf_dir), PROCESSED.df(spark, sf_dir)),
        "call_threads": (known, threads.open_threads(known, AS_OF)),
    })


@query("copy_missing_rows", f"""SELECT item_key, title FROM {FEED.sql} WHERE item_key NOT IN (SELECT item_key FROM {PROCESSED.sql})""")
def q_copy(spark, sf_dir):
    source = FEED.df(spark, sf_dir).select("item_key", "title")
    return reports.copy_missing_rows(source, PROCESSED.df(spark, sf_dir), "item_key")


@query("decision_trail", f"""SELECT item_key, stage, row_number() OVER (PARTITION BY school_code ORDER BY ts DESC) AS position FROM {FEED.sql}""")
def q_trail(spark, sf_dir):
    rows = FEED.df(spark, sf_dir).withColumn("updated_at", F.col("ts"))
    age = rows.withColumn("age", -F.unix_micros(F.col("ts").cast("timestamp")))
    placed = ranking.ordinal(age.select("school_code", "item_key", "stage", "updated_at", "age"), ["school_code"], ["age"], "position")
    return reports.decision_trail(placed).select("item_key", "stage", "position")
