"""Queries over document texts and sentences derived from the tables."""

from datetime import date, datetime

from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.catalog.base import (
    ORDER_NOTICES, View, case, hits_sql, iso_date, italian_date, norm_sql, padded, query, table, text,
)
from noticeflow.functions import dates, keys
from noticeflow.functions.text import (
    collapse_ws, confidence_word, normalize_term, normalize_text, replacement_ratio,
    split_addresses, term_hits, truncate_text, yes_no,
)
from noticeflow.operators import lookups, rules

AS_OF = datetime(2026, 6, 1, 9, 30)
TODAY = date(2026, 6, 1)

_CUP = "'H74D' || " + padded("doc_id", 11)
_TITLES = {
    "0": "'Avviso pubblico per la selezione di esperti formatori'",
    "1": "'Graduatoria definitiva tutor d’aula'",
    "2": "'Dichiarazione assenza di conflitto di interesse RUP'",
    "3": "'Avviso di selezione docenti – personale interno'",
    "4": "'Richiesta autorizzazione incarico aggiuntivo del DS'",
    "5": "'Manifestazione di interesse operatori economici'",
    "6": "'Comunicazione alle famiglie'",
}
_BODIES = {
    "0": f"'Procedura di selezione CUP ' || {_CUP} || ' per esperti esterni. Presentare domanda entro le ore 12:00 del '"
         " || " + text("doc_id % 28 + 1") + " || CASE WHEN doc_id % 3 = 0 THEN ' giugno' ELSE ' luglio' END || ' 2026. Prot. n. ' || " + text("doc_id + 100") + " || ' del 08/05/2026'",
    "1": "'Si pubblica la graduatoria. Decreto di assegnazione al dirigente scolastico dell’incarico'",
    "2": "'Il sottoscritto RUP dichiara. Avviso pubblico CUP ' || " + _CUP,
    "3": f"'Avviso interno CUP ' || {_CUP} || ' riservato a personale interno; procedura di selezione. "
         "In caso contrario indire nuovo avviso oppure ricercare all’esterno. Il dirigente dichiara che è "
         "dipendente di altra P.A., ovvero se è esperto esterno'",
    "4": "'Si chiede autorizzazione. Contratto e determina allegati'",
    "5": f"'Indagine di mercato D.M. 219/2025 snodi formativi intelligenza artificiale M4C1I2.1, CUP ' || {_CUP} || "
         "'. Personale interno e operatori economici: per esterni: partita IVA. Si autorizza l’avvio. Inviare istanza "
         "entro le ore 30/06/2026, tramite PEC'",
    "6": "'Reclutamento tutor ed esperti, educare all’IA; iscrizione al corso di formazione'",
}
# One notice per document: a title, and the whole document text behind a sentence of its kind.
NOTICES = View("documents", {
    "doc_id": "doc_id",
    "school_code": "'SC' || " + padded("doc_id", 8),
    "item_id": text("doc_id"),
    "vendor": case("doc_id % 4", {"0": "'Argo'", "1": "'Spaggiari'", "2": "'Search'"}, "'Generic'"),
    "title": case("doc_id % 8", _TITLES, "'Avviso selezione tutor intelligenza artificiale'"),
    "url": "'https://albo.example.it/' || source || '/' || " + text("doc_id"),
    "category": "source",
    "cup": _CUP,
    "clp": "'M4C1I2.1-2026-1745-P-' || " + text("doc_id"),
    "published": case("doc_id % 3", {"0": "'29/05/2026'", "1": "'2026-05-10'"}, "''"),
    "expires": case("doc_id % 7", {"0": "'31/05/2026'", "1": "''"}, "'30/09/2026'"),
    "text": case("doc_id % 8", _BODIES, "'Avviso di selezione: figure professionali, tutor'") + " || '\n' || text",
    "n_chars": "n_chars",
})


def notices(spark, sf_dir, *columns):
    return NOTICES.df(spark, sf_dir).select(*columns) if columns else NOTICES.df(spark, sf_dir)


@query("normalize_text", f"SELECT doc_id, md5({norm_sql('text')}) AS digest FROM documents")
def q_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalize_text(F.col("text"))).alias("digest"))


@query("collapse_ws", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]+', ' ', 'g'))) AS digest FROM documents")
def q_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(collapse_ws(F.col("text"))).alias("digest"))


_CALLS = [normalize_term(t) for t in vocab.CALL_TERMS]


@query("term_hits", f"""
    SELECT doc_id, array_to_string({hits_sql('t', _CALLS)}, ',') AS hits
    FROM (SELECT doc_id, {norm_sql('text')} AS t FROM {NOTICES.sql})""")
def q_term_hits(spark, sf_dir):
    norm = notices(spark, sf_dir, "doc_id", normalize_text(F.col("text")).alias("t"))
    return norm.select("doc_id", F.array_join(term_hits(F.col("t"), vocab.CALL_TERMS), ",").alias("hits"))


def _any_sql(e, terms):
    unique = list(dict.fromkeys(normalize_term(t) for t in terms))
    return f"(len({hits_sql(e, unique)}) > 0)"


_PREFILTER_SQL = (
    f"({_any_sql('t', vocab.STRONG_PREFILTER_TERMS)} OR ({_any_sql('t', vocab.PROJECT_CONTEXT_TERMS)} AND "
    f"{_any_sql('t', vocab.WEAK_PREFILTER_TERMS + vocab.CALL_TERMS)}))")


@query("prefilter", f"""
    SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE {_PREFILTER_SQL}) AS n_relevant
    FROM (SELECT source, {norm_sql("text || ' ' || source")} AS t FROM documents) GROUP BY source""")
def q_prefilter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "source", rules.prefilter(F.col("text"), F.col("source")).alias("relevant"))
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if("relevant").alias("n_relevant"))


@query("exact_code_hits", f"""
    SELECT doc_id, array_to_string(list_filter([{norm_sql('cup')}, {norm_sql('clp')}], lambda c: contains(t, c)), ', ') AS hits
    FROM (SELECT doc_id, cup, clp, {norm_sql("title || ' ' || url || ' ' || text")} AS t FROM {NOTICES.sql})""")
def q_codes(spark, sf_dir):
    full = notices(spark, sf_dir, "doc_id", "cup", "clp",
                   normalize_text(F.concat_ws(" ", "title", "url", "text")).alias("t"))
    return full.select("doc_id", F.array_join(rules.code_hits(F.col("t"), F.col("cup"), F.col("clp")), ", ").alias("hits"))


_KIND_SQL = norm_sql(f"title || ' ' || url || ' ' || substring(text, 1, {vocab.KIND_WINDOW_CHARS})")


@query("kind_window", f"SELECT doc_id, md5({_KIND_SQL}) AS digest FROM {NOTICES.sql}")
def q_kind(spark, sf_dir):
    return notices(spark, sf_dir, "doc_id", F.md5(
        rules.kind_window(F.col("title"), F.col("url"), F.col("text"))).alias("digest"))


def _norm_list(terms):
    return [normalize_term(t) for t in terms]


def _re(pattern):
    return "'" + pattern.replace("(?U)", "").replace("'", "''") + "'"


def _quoted(s):
    return "'" + s.replace("'", "''") + "'"


_STRONG_SQL = f"""list_concat({hits_sql('kind', _norm_list(vocab.STRONG_NEGATIVE_TERMS))},
    CASE WHEN regexp_matches(kind, {_re(vocab.ROLE_ASSIGNMENT)}) THEN [{_quoted(vocab.HIT_ROLE_ASSIGNMENT)}] ELSE [] END,
    CASE WHEN regexp_matches(title_n, {_re(vocab.STANDALONE_DECLARATION)}) THEN [{_quoted(vocab.HIT_STANDALONE_DECLARATION)}] ELSE [] END,
    CASE WHEN regexp_matches(title_n, {_re(vocab.AUTHORISATION_REQUEST)}) THEN [{_quoted(vocab.HIT_AUTHORISATION_REQUEST)}] ELSE [] END)"""
_STAGED_SQL = f"""(SELECT doc_id, cup, clp, {norm_sql('title')} AS title_n, {_KIND_SQL} AS kind,
    {norm_sql("title || ' ' || url || ' ' || text")} AS t FROM {NOTICES.sql})"""


@query("strong_negative", f"SELECT doc_id, array_to_string({_STRONG_SQL}, ', ') AS hits FROM {_STAGED_SQL}")
def q_strong(spark, sf_dir):
    staged = notices(spark, sf_dir, "doc_id", normalize_text(F.col("title")).alias("t"),
                     rules.kind_window(F.col("title"), F.col("url"), F.col("text")).alias("k"))
    return staged.select("doc_id", F.array_join(rules.strong_negative(F.col("k"), F.col("t")), ", ").alias("hits"))


_INTERNAL_SQL = hits_sql("t", _norm_list(vocab.INTERNAL_TERMS))
_EXTERNAL_SQL = hits_sql(f"regexp_replace(t, {_re(vocab.APPLICANT_CHECKBOX)}, ' ', 'g')", _norm_list(vocab.EXTERNAL_TERMS))
_RESERVED_SQL = f"""(len(internal) > 0 AND (len(external) = 0 OR
    (regexp_matches(t, {_re(vocab.EXTERNAL_FALLBACK_ONLY)}) AND NOT regexp_matches(t, {_re(vocab.EXTERNAL_ELIGIBILITY)}))))"""


@query("internal_only", f"""SELECT doc_id, len(internal) AS n_internal, len(external) AS n_external, {_RESERVED_SQL} AS reserved
    FROM (SELECT *, {_INTERNAL_SQL} AS internal, {_EXTERNAL_SQL} AS external FROM {_STAGED_SQL})""")
def q_internal(spark, sf_dir):
    full = notices(spark, sf_dir, "doc_id", normalize_text(F.concat_ws(" ", "title", "url", "text")).alias("t"))
    hits = full.select("doc_id", "t", term_hits(F.col("t"), vocab.INTERNAL_TERMS).alias("i"),
                       rules.external_hits(F.col("t")).alias("e"))
    return hits.select("doc_id", F.size("i").alias("n_internal"), F.size("e").alias("n_external"),
                       rules.internal_only(F.col("t"), F.col("i"), F.col("e")).alias("reserved"))


def _top(h):
    return f"array_to_string({h}[1:3], ', ')"


_HITS_SQL = f"""(SELECT *, {_STRONG_SQL} AS strong, {_INTERNAL_SQL} AS internal, {_EXTERNAL_SQL} AS external,
    {hits_sql('kind', _norm_list(vocab.NEGATIVE_TERMS))} AS negative,
    {hits_sql('t', _norm_list(vocab.CALL_CORE_TERMS))} AS core,
    {hits_sql('t', _norm_list(vocab.PROJECT_CONTEXT_TERMS))} AS context,
    list_filter([{norm_sql('cup')}, {norm_sql('clp')}], lambda c: contains(t, c)) AS exact FROM {_STAGED_SQL})"""
_VERDICT_SQL = f"""(SELECT doc_id, (NOT closed AND len(core) > 0 AND (len(exact) > 0 OR len(context) >= 3)) AS is_match,
    CASE WHEN closed OR len(core) = 0 THEN 'low'
         WHEN len(exact) > 0 THEN CASE WHEN len(internal) > 0 AND len(external) > 0 THEN 'medium' ELSE 'high' END
         WHEN len(context) >= 3 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN NOT closed AND len(core) > 0 AND (len(exact) > 0 OR len(context) >= 3) THEN core[1]
         ELSE 'sconosciuto' END AS opportunity_type,
    (NOT closed AND len(core) > 0 AND len(exact) > 0 AND len(internal) > 0 AND len(external) > 0) AS ambiguous,
    CASE WHEN len(strong) > 0 AND len(core) = 0
           THEN 'Closed/already-decided, contract-stage, or admin act (' || {_top('strong')} || ').'
         WHEN len(strong) > 0
           THEN 'Mixed with closed/admin terms (' || {_top('strong')} || '); requires a cleaner open-call document.'
         WHEN reserved THEN 'Selection appears reserved to internal staff (' || {_top('internal')} || ').'
         WHEN len(negative) > 0 AND len(core) = 0 THEN 'Looks like non-opportunity document: ' || {_top('negative')} || '.'
         WHEN len(core) = 0 THEN 'No clear open-call/procurement language found.'
         WHEN len(exact) > 0 THEN 'Identificativo di progetto esatto trovato (' || array_to_string(exact, ', ')
           || ') insieme a termini di bando (' || {_top('core')} || ').'
         WHEN len(context) >= 3 THEN 'Forte contesto D.M. 219 sull''IA (' || {_top('context')}
           || ') con termini di bando (' || {_top('core')} || ').'
         ELSE 'Linguaggio di bando presente (' || {_top('core')} || ') ma collegamento al progetto insufficiente ('
           || len(context) || ' riferimento/i) - probabilmente un altro programma.' END AS reason
    FROM (SELECT *, (len(strong) > 0 OR reserved) AS closed
          FROM (SELECT *, {_RESERVED_SQL} AS reserved FROM {_HITS_SQL})))"""


@query("rule_verdict", f"SELECT * FROM {_VERDICT_SQL}")
def q_verdict(spark, sf_dir):
    ruled = rules.with_rule_verdict(notices(spark, sf_dir))
    return ruled.select("doc_id", *[F.col(f"rule.{c}").alias(c) for c in (
        "is_match", "confidence", "opportunity_type", "ambiguous", "reason")])


# External answers by label: quality and toxicity pick the answer's shape.
VERDICTS = View("labels", {
    "doc_id": "doc_id",
    "answer": "CASE WHEN toxic = 1 THEN 'IGNORE | non pertinente' WHEN quality = 1 THEN "
              "'MATCH | High | esperto esterno | 15/07/2026 | motivo ' || " + text("doc_id") +
              " ELSE 'match | certa | tutor' END",
    "error": "CASE WHEN quality = 0 AND toxic = 0 AND doc_id % 2 = 0 THEN 'TimeoutError: slow' ELSE '' END",
})


@query("parse_verdict_line", f"""
    SELECT doc_id, m AS is_match,
      CASE WHEN NOT m THEN 'low' WHEN lower(trim(split_part(a, '|', 2))) IN ('high','medium','low')
           THEN lower(trim(split_part(a, '|', 2))) ELSE 'medium' END AS confidence,
      CASE WHEN NOT m THEN 'AI rejected candidate: ' || trim(a) WHEN n > 4 THEN trim(split_part(a, '|', 5)) ELSE trim(a) END AS reason,
      CASE WHEN NOT m THEN 'sconosciuto' WHEN n > 2 THEN trim(split_part(a, '|', 3)) ELSE 'esperti' END AS opportunity_type,
      CASE WHEN m AND n > 3 THEN trim(split_part(a, '|', 4)) ELSE 'non specificata' END AS deadline
    FROM (SELECT doc_id, answer AS a, starts_with(upper(trim(answer)), 'MATCH') AS m,
                 len(string_split(answer, '|')) AS n FROM {VERDICTS.sql})""")
def q_verdict_line(spark, sf_dir):
    parsed = VERDICTS.df(spark, sf_dir).select("doc_id", keys.parse_verdict_line(F.col("answer"), F.lit("esperti")).alias("v"))
    return parsed.select("doc_id", "v.*")


_GATE_SQL = f"""
    SELECT r.doc_id,
      CASE WHEN NOT r.is_match THEN 'rule_rejected'
           WHEN NOT used AND r.confidence <> 'high' AND r.ambiguous THEN 'ai_unavailable_deferred_ambiguous'
           WHEN used AND NOT starts_with(upper(trim(answer)), 'MATCH') THEN 'ai_rejected' ELSE 'passed' END AS gate_stage,
      (r.is_match AND NOT used AND r.confidence <> 'high' AND NOT r.ambiguous) AS unverified,
      (r.is_match AND used) AS ai_used
    FROM {_VERDICT_SQL} r LEFT JOIN {VERDICTS.sql} v ON r.doc_id = v.doc_id,
    LATERAL (SELECT v.answer IS NOT NULL AND coalesce(v.error, '') = '' AS used)"""


@query("verification_gate", _GATE_SQL)
def q_gate(spark, sf_dir):
    ruled = rules.with_rule_verdict(notices(spark, sf_dir)).select("doc_id", "rule")
    scored = ruled.join(VERDICTS.df(spark, sf_dir), "doc_id", "left")
    return rules.with_gate(scored).select(
        "doc_id", F.coalesce("gate_stage", F.lit("passed")).alias("gate_stage"), "unverified",
        F.coalesce("final.ai_used", F.lit(False)).alias("ai_used"))


@query("verdict_join", f"""
    SELECT r.doc_id, r.confidence, coalesce(v.answer, '') AS answer, (v.doc_id IS NULL) AS not_consulted
    FROM {_VERDICT_SQL} r LEFT JOIN {VERDICTS.sql} v ON r.doc_id = v.doc_id WHERE r.is_match""")
def q_verdict_join(spark, sf_dir):
    ruled = rules.with_rule_verdict(notices(spark, sf_dir)).filter("rule.is_match").select(
        F.col("doc_id").alias("item_key"), "rule.confidence")
    told = VERDICTS.df(spark, sf_dir).withColumnRenamed("doc_id", "item_key")
    return lookups.verdict_join(ruled, told).select(
        F.col("item_key").alias("doc_id"), "confidence", F.coalesce("answer", F.lit("")).alias("answer"),
        F.col("answer").isNull().alias("not_consulted"))


@query("scoring_requests", f"""
    SELECT n.doc_id, md5(substring(n.text, 1, {vocab.SCORING_TEXT_CHARS})) AS digest
    FROM {NOTICES.sql} n JOIN {_VERDICT_SQL} r ON n.doc_id = r.doc_id WHERE r.is_match
    ORDER BY n.n_chars DESC, n.doc_id LIMIT 50""")
def q_scoring(spark, sf_dir):
    ruled = rules.with_rule_verdict(notices(spark, sf_dir))
    chosen = rules.scoring_requests(ruled, "capped", 50, [F.desc("n_chars"), F.col("doc_id")])
    return chosen.select("doc_id", F.md5("request_text").alias("digest"))


@query("candidate_context", f"""SELECT doc_id, md5('Categoria: ' || category || ' | Pubblicato: ' || published || ' | Scadenza: '
    || CASE WHEN expires = '' THEN '30/09/2026' ELSE expires END || chr(10) || text) AS digest FROM {NOTICES.sql}""")
def q_context(spark, sf_dir):
    expires = F.when(F.col("expires") == "", F.lit("30/09/2026")).otherwise(F.col("expires"))
    return notices(spark, sf_dir, "doc_id", F.md5(rules.candidate_context(
        F.col("category"), F.col("published"), expires, F.col("text"))).alias("digest"))


@query("replacement_ratio", "SELECT doc_id, cast(round(1000000 * (length(text) - length(replace(text, 'e', ''))) / length(text)) AS bigint) AS ppm FROM documents")
def q_ratio(spark, sf_dir):
    broken = F.replace(F.col("text"), F.lit("e"), F.lit("�"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.round(replacement_ratio(broken) * 1000000).cast("bigint").alias("ppm"))


@query("truncate_text", "SELECT doc_id, md5(substring(text, 1, 4000)) AS head, length(substring(text, 1, 20000)) AS n FROM documents")
def q_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(truncate_text(F.col("text"), vocab.PAGE_TEXT_CHARS)).alias("head"),
        F.length(truncate_text(F.col("text"), vocab.SCORING_TEXT_CHARS)).alias("n"))


# --- dates: sentences built from order keys and dates ------------------------------------------------

_D, _M, _Y = "day(o_orderdate)", "month(o_orderdate)", "(year(o_orderdate) + 28)"
_MONTH_NAME = "CASE month(o_orderdate) " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(vocab.MONTHS_IT, 1)) + " END"
_H, _MIN = "o_orderkey % 26", "o_custkey % 60"
_NUM = f"{text(_D)} || '/' || {text(_M)} || '/' || {text(_Y)}"
_WORD = f"{text(_D)} || ' ' || {_MONTH_NAME} || ' ' || {text(_Y)}"
_CLOCK = f"{text(_H)} || ':' || {padded(_MIN, 2)}"
SENTENCES = View("orders", {
    "o_orderkey": "o_orderkey",
    "day": iso_date("o_orderdate", 28),
    "hour": _H,
    "minute": _MIN,
    "shape": "o_orderkey % 9",
    "expires": f"CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE {italian_date('o_orderdate', 28)} END",
    "sentence": case("o_orderkey % 9", {
        "0": f"'Le domande entro le ore ' || {_CLOCK} || ' del ' || {_NUM} || '.'",
        "1": f"'Istanze ENTRO E NON OLTRE LE ORE ' || {_CLOCK} || ' di venerdì ' || {_WORD}",
        "2": f"'entroenonoltreleore ' || {_CLOCK} || 'delgiorno' || {_WORD}",
        "3": f"'entro le ore ' || {_NUM} || ' ore ' || {_CLOCK}",
        "4": f"'entro le ore ' || {_WORD} || ' ore ' || {_CLOCK}",
        "5": f"'entro le ore ' || {_NUM} || ', tramite PEC'",
        "6": f"'entro le ore ' || {_WORD} || ' tramite PEC'",
        "7": f"'Pubblicato il ' || {_NUM} || ' sul sito'",
    }, f"'Prot. n. ' || {text('o_orderkey')} || ' dell’' || {_WORD}"),
})
_S = SENTENCES.sql
_TIMED = "(shape < 5 AND hour < 24)"
_HHMM = "lpad(cast(hour AS string), 2, '0') || ':' || lpad(cast(minute AS string), 2, '0')"
_DL_DAY = "CASE WHEN shape < 7 THEN day END"
_DL_TIME = f"CASE WHEN {_TIMED} THEN {_HHMM} END"


def deadlines(spark, sf_dir):
    return SENTENCES.df(spark, sf_dir).withColumn("norm", normalize_text(F.col("sentence"))).withColumn(
        "deadline", dates.application_deadline(F.col("norm")))


@query("application_deadline", f"SELECT o_orderkey, {_DL_DAY} AS due, {_DL_TIME} AS due_time FROM {_S}")
def q_deadline(spark, sf_dir):
    return deadlines(spark, sf_dir).select(
        "o_orderkey", F.col("deadline.date").cast("string").alias("due"), F.col("deadline.time").alias("due_time"))


_PASSED = (f"coalesce(shape < 7 AND (day < '{TODAY}' OR (day = '{TODAY}' AND {_TIMED} AND {_HHMM} || ':00' < '11:30:00')), false)")


@query("deadline_passed", f"SELECT o_orderkey, {_PASSED} AS passed FROM {_S}")
def q_passed(spark, sf_dir):
    return deadlines(spark, sf_dir).select("o_orderkey", dates.deadline_passed(F.col("deadline"), AS_OF).alias("passed"))


@query("expired_by_document", f"SELECT shape, count(*) AS n, count(*) FILTER (WHERE {_PASSED}) AS n_expired FROM {_S} GROUP BY shape")
def q_expired_doc(spark, sf_dir):
    return deadlines(spark, sf_dir).groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(dates.deadline_passed(F.col("deadline"), AS_OF)).alias("n_expired"))


@query("published_date", f"SELECT o_orderkey, CASE WHEN shape >= 7 THEN day END AS published FROM {_S}")
def q_published(spark, sf_dir):
    return SENTENCES.df(spark, sf_dir).withColumn("norm", normalize_text(F.col("sentence"))).select(
        "o_orderkey", dates.published_date(F.col("norm")).cast("string").alias("published"))


_IT_DAY = "strftime(cast(day AS date), '%d/%m/%Y')"


@query("enrich_published_from_text", f"SELECT o_orderkey, CASE WHEN shape >= 7 THEN {_IT_DAY} ELSE 'n.d.' END AS published FROM {_S}")
def q_enrich_published(spark, sf_dir):
    return SENTENCES.df(spark, sf_dir).withColumn("norm", normalize_text(F.col("sentence"))).select(
        "o_orderkey", dates.enrich_published(F.lit("n.d."), F.col("norm")).alias("published"))


_SHOWN = (f"CASE WHEN shape < 7 THEN {_IT_DAY} || CASE WHEN {_TIMED} THEN ' ' || {_HHMM} ELSE '' END "
          f"WHEN expires <> '' THEN expires ELSE 'non specificata' END")


@query("deadline_display", f"SELECT o_orderkey, {_SHOWN} AS shown FROM {_S}")
def q_display(spark, sf_dir):
    return deadlines(spark, sf_dir).select("o_orderkey", dates.deadline_display(
        F.col("deadline"), F.col("expires"), F.lit(vocab.DEFAULT_DEADLINE)).alias("shown"))


_STATUS = (f"CASE WHEN shape >= 7 AND expires = '' THEN 'scadenza sconosciuta' "
           f"WHEN day < '{TODAY}' THEN 'scaduta' ELSE 'aperta' END")


@query("open_status", f"SELECT o_orderkey, {_STATUS} AS status FROM {_S}")
def q_status(spark, sf_dir):
    shown = deadlines(spark, sf_dir).withColumn("shown", dates.deadline_display(
        F.col("deadline"), F.col("expires"), F.lit(vocab.DEFAULT_DEADLINE)))
    return shown.select("o_orderkey", dates.open_status(F.col("shown"), TODAY).alias("status"))


@query("has_deadline", f"SELECT o_orderkey, NOT (shape >= 7 AND expires = '') AS has_deadline FROM {_S}")
def q_has_deadline(spark, sf_dir):
    shown = deadlines(spark, sf_dir).withColumn("shown", dates.deadline_display(
        F.col("deadline"), F.col("expires"), F.lit(" Non specificata ")))
    return shown.select("o_orderkey", dates.has_deadline(F.col("shown")).alias("has_deadline"))


_MAIL_MONTH = "CASE month(o_orderdate) " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(
        ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"), 1)) + " END"
PLATFORM_DATES = View("orders", {
    "o_orderkey": "o_orderkey",
    "day": iso_date("o_orderdate", 28),
    "shape": "o_orderkey % 8",
    "value": case("o_orderkey % 8", {
        "0": italian_date("o_orderdate", 28),
        "1": f"{iso_date('o_orderdate', 28)} || 'T10:00:00'",
        "2": f"replace({italian_date('o_orderdate', 28)}, '/', '-')",
        "3": f"replace({italian_date('o_orderdate', 28)}, '/', '.') || ' ore 9'",
        "4": f"'Mon, ' || {padded(_D, 2)} || ' ' || {_MAIL_MONTH} || ' ' || {text(_Y)} || ' 23:30:00 +0200'",
        "5": f"{text(_D)} || ' ' || {_MAIL_MONTH} || ' ' || {text(_Y)} || ' 08:15 GMT'",
        "6": "''"}, "'31/02/2026 n.d.'"),
})


@query("parse_notice_date", f"SELECT o_orderkey, CASE WHEN shape < 6 THEN day END AS parsed FROM {PLATFORM_DATES.sql}")
def q_notice_date(spark, sf_dir):
    return PLATFORM_DATES.df(spark, sf_dir).select(
        "o_orderkey", dates.parse_notice_date(F.col("value")).cast("string").alias("parsed"))


@query("expired_by_metadata", f"SELECT o_orderkey, (shape < 6 AND day <= '{TODAY}') AS expired FROM {PLATFORM_DATES.sql}")
def q_expired_meta(spark, sf_dir):
    return PLATFORM_DATES.df(spark, sf_dir).select(
        "o_orderkey", dates.expired_by_metadata(F.col("value"), TODAY).alias("expired"))


@query("outside_window", f"""SELECT item_id, (vendor = 'Search' AND published <> '' AND cast(day AS date) < DATE '{TODAY}' - 7) AS outside
    FROM {ORDER_NOTICES.sql}""")
def q_outside(spark, sf_dir):
    return ORDER_NOTICES.df(spark, sf_dir).select(
        "item_id", dates.outside_window(F.col("vendor"), F.col("published"), TODAY).alias("outside"))


@query("late_notice_filter", f"""SELECT vendor, count(*) AS n FROM {ORDER_NOTICES.sql}
    WHERE NOT (vendor = 'Search' AND published <> '' AND cast(day AS date) < DATE '{TODAY}' - 7) GROUP BY vendor""")
def q_late(spark, sf_dir):
    from noticeflow.streaming.intake import late_notice_filter

    return late_notice_filter(ORDER_NOTICES.df(spark, sf_dir), TODAY).groupBy("vendor").agg(F.count(F.lit(1)).alias("n"))


@query("days_apart", f"""SELECT item_id, CASE WHEN published = '' THEN 31 ELSE abs(cast(day AS date) - DATE '{TODAY}') END AS days
    FROM {ORDER_NOTICES.sql}""")
def q_days(spark, sf_dir):
    return ORDER_NOTICES.df(spark, sf_dir).select(
        "item_id", dates.days_apart(dates.parse_notice_date(F.col("published")), F.lit(TODAY)).alias("days"))


@query("to_iso_date", f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE {iso_date('o_orderdate')} END AS iso FROM orders")
def q_iso(spark, sf_dir):
    raw = f"CASE WHEN o_orderkey % 3 = 0 THEN {italian_date('o_orderdate')} ELSE replace({italian_date('o_orderdate')}, '/', '-') || ' 10:00:00' END"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{raw} AS raw").select(
        "o_orderkey", dates.to_iso_date(F.col("raw")).alias("iso"))


_CENTS = "cast(round(o_totalprice * 100) as bigint)"


@query("normalize_amount", f"""SELECT o_orderkey, cast({_CENTS} // 100 AS string) || '.' || lpad(cast({_CENTS} % 100 AS string), 2, '0') AS amount
    FROM orders""")
def q_amount(spark, sf_dir):
    grouped = F.format_number(F.floor(F.col("cents") / 100), 0)
    italian = F.concat(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_CENTS} AS cents").select(
        "o_orderkey", keys.normalize_amount(italian).alias("amount"))


# --- signals ---------------------------------------------------------------------------------------------

@query("protocol_ref", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE cast(o_custkey AS string) || '|' || {italian_date('o_orderdate')} END AS ref
    FROM orders""")
def q_protocol(spark, sf_dir):
    cited = (f"CASE WHEN o_orderkey % 3 = 0 THEN 'Nessun protocollo' WHEN o_orderkey % 3 = 1 THEN 'Atto PROT. N. ' || {text('o_custkey')} "
             f"|| ' del ' || {italian_date('o_orderdate')} ELSE 'protocollo n.' || {text('o_custkey')} || ' del' || {italian_date('o_orderdate')} || ' bis' END")
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{cited} AS cited").select(
        "o_orderkey", keys.protocol_ref(normalize_text(F.col("cited"))).alias("ref"))


@query("role_signature", f"""SELECT doc_id, array_to_string(list_sort({hits_sql('t', vocab.ROLE_TERMS)}), ',') AS roles
    FROM (SELECT doc_id, {norm_sql("title || ' ' || text")} AS t FROM {NOTICES.sql})""")
def q_roles(spark, sf_dir):
    norm = notices(spark, sf_dir, "doc_id", normalize_text(F.concat_ws(" ", "title", "text")).alias("t"))
    return norm.select("doc_id", F.array_join(keys.role_signature(F.col("t")), ",").alias("roles"))


@query("is_actionable", f"""SELECT t.doc_id,
      CASE WHEN regexp_matches(t, {_re(vocab.APPLY_INSTRUCTION)}) THEN true
           WHEN regexp_matches(t, {_re(vocab.AUTHORISING_ONLY)}) OR NOT regexp_matches(t, {_re(vocab.WEAK_APPLICATION)}) THEN false
           ELSE coalesce(quality = 1, true) END AS actionable
    FROM (SELECT doc_id, {norm_sql("title || ' ' || text")} AS t FROM {NOTICES.sql}) t LEFT JOIN labels l ON t.doc_id = l.doc_id""")
def q_actionable(spark, sf_dir):
    norm = notices(spark, sf_dir, "doc_id", normalize_text(F.concat_ws(" ", "title", "text")).alias("t"))
    told = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("told"))
    return norm.join(told, "doc_id", "left").select(
        "doc_id", keys.is_actionable(F.col("t"), F.col("told")).alias("actionable"))


ANSWERS = View("labels", {
    "doc_id": "doc_id",
    "same_answer": "CASE WHEN quality = 1 THEN ' stesso processo' WHEN toxic = 1 THEN NULL ELSE 'DIVERSO' END",
    "action_answer": "CASE WHEN toxic = 1 THEN 'SOLO_AUTORIZZAZIONE' WHEN quality = 1 THEN 'Azionabile.' END",
})


@query("same_process_flag", "SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN NULL ELSE false END AS same FROM labels")
def q_same(spark, sf_dir):
    return ANSWERS.df(spark, sf_dir).select("doc_id", keys.same_process_flag(F.col("same_answer")).alias("same"))


@query("actionable_flag", "SELECT doc_id, CASE WHEN toxic = 1 THEN false WHEN quality = 1 THEN true END AS actionable FROM labels")
def q_action_flag(spark, sf_dir):
    return ANSWERS.df(spark, sf_dir).select("doc_id", keys.actionable_flag(F.col("action_answer")).alias("actionable"))


# --- small scalars -----------------------------------------------------------------------------------------

@query("split_addresses", """SELECT c_custkey, array_to_string(list_filter(list_transform(
      string_split(replace(raw, ';', ','), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS addresses
    FROM (SELECT c_custkey, lower(c_mktsegment) || '@x.it; ' || c_name || '@y.it ,;, z@z.it' AS raw FROM customer)""")
def q_addresses(spark, sf_dir):
    raw = F.expr("lower(c_mktsegment) || '@x.it; ' || c_name || '@y.it ,;, z@z.it'")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.array_join(split_addresses(raw), "|").alias("addresses"))


@query("reply_subject", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 're: ' || c_name ELSE 'Re: ' || c_name END AS subject FROM customer""")
def q_reply(spark, sf_dir):
    subject = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("re: "), F.col("c_name"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", keys.reply_subject(subject).alias("subject"))


@query("display_map", """SELECT doc_id, CASE quality WHEN 1 THEN 'alta' ELSE CASE toxic WHEN 1 THEN 'bassa' ELSE 'media' END END AS word,
    CASE WHEN toxic = 1 THEN 'sì' ELSE 'no' END AS flag FROM labels""")
def q_words(spark, sf_dir):
    level = F.when(F.col("quality") == 1, "high").when(F.col("toxic") == 1, "low").otherwise("medium")
    return table(spark, sf_dir, "labels").select(
        "doc_id", confidence_word(level).alias("word"), yes_no(F.col("toxic") == 1).alias("flag"))


@query("keys", f"""SELECT item_id, school_code || '|' || item_id AS item_key, lower(school_code || '|' || cup || '|' || clp || '|' || url) AS alert_key,
    lower(school_code || '|' || url) AS opp_key FROM {ORDER_NOTICES.sql}""")
def q_keys(spark, sf_dir):
    c = F.col
    return ORDER_NOTICES.df(spark, sf_dir).select(
        "item_id", keys.item_key(c("school_code"), c("item_id")).alias("item_key"),
        keys.alert_key(c("school_code"), c("cup"), c("clp"), c("url")).alias("alert_key"),
        keys.opportunity_key(c("school_code"), c("url")).alias("opp_key"))


@query("http_outcome_policy", """SELECT event_id, event_type = 'error' AS final FROM events""")
def q_http(spark, sf_dir):
    error = F.when(F.col("event_type") == "error", F.lit("404 Client Error: Not Found")).when(
        F.col("event_type") == "view", F.lit("503 Server Error")).otherwise(F.lit("Read timed out"))
    return table(spark, sf_dir, "events").select("event_id", keys.http_outcome(error).alias("final"))
