"""Queries over files Spark writes from the tables: feeds, documents, detail records, own sites, the CSV export."""

from datetime import datetime

from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.catalog import payloads, state
from noticeflow.catalog.base import PROJECTS, View, case, italian_date, query, table, text
from noticeflow.operators import lookups, reports
from noticeflow.session import scratch_path
from noticeflow.sources import documents, feeds

_SCHOOL = "'SC' || " + text("user_id")


@query("stored_feeds", f"""
    SELECT {_SCHOOL} AS school_code, CASE event_type WHEN 'click' THEN {text('event_id')} WHEN 'error' THEN {text('event_id + 5')}
        WHEN 'view' THEN 'guid-' || event_id ELSE 'https://albo.example.it/n/' || event_id END AS item_id,
      'Avviso & n. ' || event_id AS title, {italian_date('ts')} AS published
    FROM events WHERE event_type <> 'purchase' AND user_id % 7 <> 0
    UNION ALL SELECT DISTINCT {_SCHOOL}, 'outer', 'Raccolta', '' FROM events WHERE user_id % 3 = 2 AND user_id % 7 <> 0""")
def q_stored_feeds(spark, sf_dir):
    """One feed file per organisation, with items in a channel, deeper, or inside another item; some are malformed."""
    body = payloads._grouped(spark, sf_dir, payloads._RSS_ITEM).groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "body"))), lambda p: p["body"]), "").alias("body"))
    kind = F.col("user_id") % 3
    end = F.when(F.col("user_id") % 7 == 0, "").otherwise("</rss>")
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss>'),
        F.when(kind == 0, F.concat(F.lit("<channel>"), "body", F.lit("</channel>"))).when(
            kind == 1, F.concat(F.lit("<feed><entry>"), "body", F.lit("</entry></feed>"))).otherwise(
            F.concat(F.lit("<item><title>Raccolta</title><guid>outer</guid><list>"), "body", F.lit("</list></item>"))), end)
    folder = scratch_path(spark, "feeds")
    body.select(F.expr(_SCHOOL).alias("school_code"), xml.alias("value")).repartition("school_code").write.partitionBy("school_code").text(folder)
    files = documents.stored_files(spark, folder, "part-*")
    school = F.regexp_extract("path", r"school_code=([^/]+)/", 1)
    stored = files.select(school.alias("school_code"), documents.decoded(F.col("content")).alias("xml"))
    return feeds.parse_rss_feed(stored).select("school_code", "item_id", "title", "published")


_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
_FILES = f"(SELECT {_HOST} AS host, string_agg(html, chr(10) ORDER BY page_id) AS html FROM pages GROUP BY 1)"


@query("stored_documents", f"SELECT host, 'html' AS kind, md5({payloads._TEXT_SQL}) AS digest FROM {_FILES}")
def q_stored_documents(spark, sf_dir):
    """One file per host with all its pages, found below the folder and read by kind."""
    folder = scratch_path(spark, "documents")
    rows = table(spark, sf_dir, "pages").select(F.expr(_HOST).alias("host"), "page_id", F.col("html").alias("value"))
    rows.repartition("host").sortWithinPartitions("host", "page_id").select("host", "value").write.partitionBy("host").text(folder)
    read = documents.read_documents(documents.stored_files(spark, folder, "part-*"))
    host = F.url_decode(F.regexp_extract("path", r"host=([^/]+)/", 1))
    return read.select(host.alias("host"), "kind", F.md5("text").alias("digest"))


# Detail records whose fields come and go and change their types.
_JSON = ("'{' || " + case("event_type", {
    "'click'": "'\"dataArchiviazioneEffettiva\": \"' || " + italian_date("ts") + " || '\", '",
    "'error'": "'\"dataArchiviazioneEffettiva\": \"\", \"dataArchiviazioneOriginale\": \"' || " + italian_date("ts") + " || '\", '",
    "'view'": "'\"dataArchiviazioneOriginale\": ' || " + text("event_id") + " || ', '"}, "''")
    + " || " + case("event_id % 3", {"0": "'\"tipologiaAttoDenominazione\": \"Tipo ' || event_type || '\", '", "1": "'\"tipologiaAttoDenominazione\": null, '"}, "''")
    + " || '\"descrizione\": \"Selezione ' || " + text("event_id") + " || '\", \"allegati\": ' || "
    + case("event_id % 4", {"0": "'[{\"nome\": \"a' || " + text("event_id") + " || '.pdf\"}, {\"nome\": null}, {\"nome\": \"b.docx\"}]'", "1": "'[]'", "2": "'null'"},
           "'[{\"nome\": \"c.pdf\", \"peso\": 1}, \"guasto\"]'") + " || '}'")
DETAILS = View("events", {
    "detail_ref": text("event_id"),
    "expires": "CASE WHEN event_id % 2 = 0 THEN '31/12/2026' ELSE '' END",
    "category": "'Albo'",
    "json": f"CASE WHEN event_id % 10 = 9 THEN 'errore 500' ELSE {_JSON} END",
})


@query("parse_details", f"""
    SELECT {text('event_id')} AS detail_ref,
      CASE WHEN event_id % 10 <> 9 AND event_type IN ('click', 'error') THEN {italian_date('ts')} WHEN event_id % 10 <> 9 AND event_type = 'view' THEN {text('event_id')}
        WHEN event_id % 2 = 0 THEN '31/12/2026' ELSE '' END AS expires,
      CASE WHEN event_id % 10 <> 9 AND event_id % 3 = 0 THEN 'Tipo ' || event_type ELSE 'Albo' END AS category
    FROM events""")
def q_parse_details(spark, sf_dir):
    notices = DETAILS.df(spark, sf_dir)
    parsed = documents.parse_details(notices.select("detail_ref", "json"))
    return lookups.enrich_notice(lookups.detail_join(notices.drop("json"), parsed)).select("detail_ref", "expires", "category")


_PART_ROWS = f"""(SELECT {text('event_id')} AS detail_ref, 0 AS rank, 0 AS pos, 'Selezione ' || event_id AS text FROM events WHERE event_id % 10 <> 9
    UNION ALL SELECT {text('event_id')}, 0, 1, 'Tipo ' || event_type FROM events WHERE event_id % 10 <> 9 AND event_id % 3 = 0
    UNION ALL SELECT {text('event_id')}, 1, 0, CASE event_id % 4 WHEN 0 THEN 'a' || event_id || '.pdf' ELSE 'c.pdf' END FROM events WHERE event_id % 10 <> 9 AND event_id % 4 IN (0, 3)
    UNION ALL SELECT {text('event_id')}, 1, 2, 'b.docx' FROM events WHERE event_id % 10 <> 9 AND event_id % 4 = 0
    UNION ALL SELECT {text('event_id')}, 2, cast(turn AS INTEGER), text FROM events JOIN conversations ON conv_id = event_id
      WHERE event_id % 10 <> 9 AND event_id % 4 IN (0, 3) AND text <> '')"""


@query("detail_parts", f"SELECT detail_ref, md5(string_agg(text, chr(10) ORDER BY rank, pos, text)) AS digest, count(*) AS n FROM {_PART_ROWS} GROUP BY detail_ref")
def q_detail_parts(spark, sf_dir):
    parsed = documents.parse_details(DETAILS.df(spark, sf_dir).select("detail_ref", "json"))
    bodies = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("detail_ref"), F.col("turn").alias("pos"), "text")
    parts = documents.detail_parts(parsed, bodies, "detail_ref")
    counts = parts.groupBy("detail_ref").agg(F.count(F.lit(1)).alias("n"))
    return documents.assemble_text(parts, "detail_ref").join(counts, "detail_ref").select("detail_ref", F.md5("text").alias("digest"), "n")


@query("site_parts", f"""
    SELECT page_id, md5(string_agg(text, chr(10) ORDER BY rank, pos, text)) AS digest FROM (
      SELECT page_id, 1 AS rank, 0 AS pos, left(html, {vocab.PAGE_TEXT_CHARS}) AS text FROM pages
      UNION ALL SELECT page_id, 0, turn, text FROM pages JOIN conversations ON conv_id = page_id WHERE turn < {vocab.MAX_ATTACHMENTS}) WHERE text <> '' GROUP BY page_id""")
def q_site_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    found = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("pos"), "text")
    own = found.join(pages.select("page_id"), "page_id", "left_semi")
    return documents.assemble_text(documents.site_parts(pages, own, "page_id"), "page_id").select("page_id", F.md5("text").alias("digest"))


@query("write_export", f"""
    SELECT p.school_code, p.school_name, o.title, o.opp_key AS url, o.deadline,
      CASE WHEN strptime(o.deadline, '%d/%m/%Y') < timestamp '2024-01-20 00:00:00' THEN 'scaduta' ELSE 'aperta' END AS status, o.first_seen
    FROM {state.OPP_ALL.sql} o JOIN {PROJECTS.sql} p ON o.school_code = p.school_code""")
def q_write_export(spark, sf_dir):
    rows = state.OPP_ALL.df(spark, sf_dir).join(PROJECTS.df(spark, sf_dir), "school_code")
    at = scratch_path(spark, "export")
    reports.write_export(rows.withColumn("url", F.col("opp_key")).withColumn("published", F.lit("")), at, datetime(2024, 1, 20).date())
    return reports.read_export(spark, at).select("school_code", "school_name", "title", "url", "deadline", "status", "first_seen")
