"""Queries over what a run settles: ordered reservations, deliveries, thread changes."""

from datetime import datetime

from pyspark.sql import functions as F

from noticeflow.catalog import joins
from noticeflow.catalog.base import View, case, padded, query, table, text
from noticeflow.operators import settlement, state_ops

RUN = datetime(2026, 6, 15, 9, 30)
_RUN_SQL = "timestamp '2026-06-15 09:30:00'"

# Order lines are documents: a supplier is an organisation, some 64 orders one process, a part one alert.
ASKED = {
    "seq": joins._SEQ,
    "school_code": "'SC' || " + padded("l_suppkey", 8),
    "cup": "CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'H74D' || " + padded("l_suppkey", 11) + " END",
    "clp": "'M4C1I2.1-' || " + text("l_suppkey"),
    "item_key": text(joins._SEQ),
    "title": "'Avviso ' || " + text("l_partkey"),
    "url": "'https://albo.example.it/' || " + text("l_partkey"),
    "alert_key": "'A' || " + text("l_suppkey") + " || '|' || " + text("l_partkey"),
    "bucket": "l_orderkey div 64",
    "reason": "'motivo ' || " + text("l_linenumber"),
    "action": case("l_linenumber % 4", {"0": "'send_reply'", "1": "'hold'", "2": "'send_new'"}, "'suppress'"),
    "roles": case("l_linenumber", {"1": "'esperto'", "2": "'tutor'", "3": "'esperto,tutor'", "4": "'rup'", "5": "'docente,rup'"}, "''"),
    "protocol_ref": "CASE WHEN l_suppkey % 4 = 0 THEN " + text("l_suppkey") + " || '|' || " + text("l_linenumber % 3") + " END",
}
_ROWS = View("lineitem", ASKED)
_ROWS_SQL = _ROWS.sql.replace("l_orderkey div 64", "l_orderkey // 64")
# (bucket, supplier) is a group; even buckets answer to a known thread
_ASK = f"""(SELECT *, school_code || '#' || cast(bucket AS string) AS group_key,
    CASE WHEN bucket % 2 = 0 THEN 'T' || school_code || '#' || cast(bucket AS string) END AS thread_id FROM {_ROWS_SQL})"""
_ALERT_ROWS = """(SELECT DISTINCT 'A' || cast(l_suppkey AS string) || '|' || cast(l_partkey AS string) AS alert_key,
    CASE l_partkey % 5 WHEN 0 THEN 'sent' WHEN 1 THEN 'sending' WHEN 2 THEN 'sending' ELSE 'failed' END AS status,
    CASE l_partkey % 5 WHEN 1 THEN timestamp '2026-06-15 09:00:00' ELSE timestamp '2026-06-15 06:00:00' END AS updated_at
    FROM lineitem WHERE l_partkey % 3 = 0)"""
_LIVE = f"(SELECT alert_key FROM {_ALERT_ROWS} WHERE status = 'sent' OR (status = 'sending' AND updated_at >= {_RUN_SQL} - INTERVAL 120 MINUTE))"


def asked(spark, sf_dir):
    rows = _ROWS.df(spark, sf_dir)
    key = F.concat_ws("#", "school_code", F.col("bucket").cast("string"))
    roles = F.filter(F.split("roles", ","), lambda r: r != "")
    return rows.withColumn("group_key", key).withColumn(
        "thread_id", F.when(F.col("bucket") % 2 == 0, F.concat(F.lit("T"), key))).withColumn("role_signature", roles).drop("roles", "bucket")


def alerts(spark, sf_dir):
    part = F.col("l_partkey") % 5
    rows = table(spark, sf_dir, "lineitem").filter("l_partkey % 3 = 0").select("l_suppkey", "l_partkey").distinct()
    none = F.lit(None).cast("string")
    at = F.when(part == 1, F.lit("2026-06-15 09:00:00")).otherwise("2026-06-15 06:00:00").cast("timestamp")
    return rows.select(
        F.concat(F.lit("A"), F.col("l_suppkey").cast("string"), F.lit("|"), F.col("l_partkey").cast("string")).alias("alert_key"),
        F.lit("").alias("school_code"), F.lit("").alias("url"),
        F.when(part == 0, "sent").when(part.isin(1, 2), "sending").otherwise("failed").alias("status"),
        none.alias("message_id"), none.alias("subject"), at.alias("created_at"), at.alias("updated_at"))


_WALK = f"""asks AS MATERIALIZED (SELECT a.*, b.alert_key IS NOT NULL AS blocked FROM {_ASK} a LEFT JOIN {_LIVE} b USING (alert_key)),
    groups AS MATERIALIZED (SELECT school_code, group_key, list(alert_key) AS ks, count(*) > count(DISTINCT alert_key) OR bool_or(blocked) AS hopeless,
        row_number() OVER (PARTITION BY school_code ORDER BY min(thread_id) IS NULL, min(seq)) AS rn FROM asks GROUP BY school_code, group_key),
    walk AS (
      SELECT school_code, group_key, rn, NOT hopeless AS won, CASE WHEN hopeless THEN [] ELSE ks END AS held FROM groups WHERE rn = 1
      UNION ALL
      SELECT school_code, group_key, rn, won, CASE WHEN won THEN list_concat(held, ks) ELSE held END
      FROM (SELECT g.*, w.held, NOT hopeless AND NOT list_has_any(w.held, g.ks) AS won FROM walk w JOIN groups g ON g.school_code = w.school_code AND g.rn = w.rn + 1)),
    won AS MATERIALIZED (SELECT group_key, rn, won FROM walk)"""
_RESERVED = f"""
    WITH RECURSIVE {_WALK},
    holders AS (SELECT a.alert_key, min(w.rn) AS rn FROM asks a JOIN won w USING (group_key) WHERE w.won GROUP BY a.alert_key),
    told AS (SELECT a.group_key, a.seq, a.alert_key, w.won, a.blocked OR coalesce(h.rn < w.rn, false)
        OR a.seq > min(a.seq) OVER (PARTITION BY a.group_key, a.alert_key) AS refused
      FROM asks a JOIN won w USING (group_key) LEFT JOIN holders h USING (alert_key))
    SELECT item_key, group_key, group_granted, new_status FROM (
      SELECT cast(seq AS string) AS item_key, group_key, won AS group_granted, CASE WHEN won THEN 'sending'
        WHEN seq < min(seq) FILTER (WHERE refused) OVER (PARTITION BY group_key) THEN 'failed' END AS new_status FROM told)"""


def reserved(spark, sf_dir):
    return settlement.settle_in_turn(
        asked(spark, sf_dir), alerts(spark, sf_dir), RUN, "group_key", "seq", F.col("thread_id").isNotNull(), F.col("school_code"))


@query("settle_groups", _RESERVED)
def q_settle_groups(spark, sf_dir):
    return reserved(spark, sf_dir).select("item_key", "group_key", "group_granted", "new_status")


# --- deliveries: two of three groups go out, some are never heard of --------------------------------------------

_PLANNED = f"""(SELECT *, CASE WHEN g.sends THEN CASE WHEN a.bucket % 3 = 0 THEN 'already_alerted' ELSE 'alerted' END
      WHEN g.holds THEN 'held' ELSE 'suppressed_duplicate' END AS stage
    FROM {_ASK} a JOIN (SELECT group_key, bool_or(action LIKE 'send%') AS sends, bool_or(action = 'hold') AS holds FROM {_ASK} GROUP BY 1) g USING (group_key))"""
_OUTCOMES = View("lineitem", {"group_key": "'SC' || " + padded("l_suppkey", 8) + " || '#' || " + text("l_orderkey div 64"), "bucket": "l_orderkey div 64"})
_SETTLED = f"""(SELECT *, CASE WHEN stage = 'alerted' THEN CASE WHEN bucket % 5 < 3 THEN 'sent' WHEN bucket % 5 = 3 THEN 'failed' ELSE 'unknown' END END AS delivery
    FROM {_PLANNED})"""


def planned(spark, sf_dir):
    rows = asked(spark, sf_dir)
    acts = rows.groupBy("group_key").agg(F.bool_or(F.col("action").startswith("send")).alias("sends"), F.bool_or(F.col("action") == "hold").alias("holds"))
    bucket = F.split_part("group_key", F.lit("#"), F.lit(2)).cast("bigint")
    return rows.join(acts, "group_key").withColumn("stage", F.when(
        F.col("sends"), F.when(bucket % 3 == 0, "already_alerted").otherwise("alerted")).when(F.col("holds"), "held").otherwise("suppressed_duplicate"))


def settled(spark, sf_dir):
    tried = _OUTCOMES.df(spark, sf_dir).distinct().filter("bucket % 5 <> 4").select(
        "group_key", (F.col("bucket") % 5 < 3).alias("delivered"), F.concat(F.lit("<"), "group_key", F.lit("@x.it>")).alias("message_id"),
        F.concat(F.lit("Oggetto "), "group_key").alias("subject"))
    return settlement.settle_delivery(planned(spark, sf_dir), tried)


@query("settle_delivery", f"""
    SELECT item_key, delivery, CASE WHEN stage = 'alerted' AND delivery <> 'sent' THEN 'send_failed' ELSE stage END AS stage,
      CASE WHEN stage = 'alerted' AND delivery <> 'sent' THEN 'Confirmed and grouped, but AlertService.send() did not succeed.' ELSE reason END AS reason
    FROM {_SETTLED}""")
def q_settle_delivery(spark, sf_dir):
    return settled(spark, sf_dir).select("item_key", "delivery", "stage", "reason")


@query("settle_alerts", f"""
    SELECT alert_key, CASE WHEN s.alert_key IS NOT NULL THEN 'sent' WHEN a.status = 'sending' AND f.alert_key IS NOT NULL AND a.updated_at = timestamp '2026-06-15 09:00:00'
        THEN 'failed' ELSE a.status END AS status
    FROM {_ALERT_ROWS} a FULL JOIN (SELECT DISTINCT alert_key FROM {_SETTLED} WHERE delivery = 'sent') s USING (alert_key)
    LEFT JOIN (SELECT DISTINCT alert_key FROM {_SETTLED} WHERE delivery = 'failed') f USING (alert_key)""")
def q_settle_alerts(spark, sf_dir):
    after = settlement.settle_alerts(alerts(spark, sf_dir), settled(spark, sf_dir), datetime(2026, 6, 15, 9, 0), RUN)
    return after.select("alert_key", "status")


_CHANGES = f"""(SELECT group_key, coalesce(min(thread_id), md5(min(school_code) || '|' || coalesce(nullif(min(cup), ''), min(school_code)) || '|' || arg_min(item_key, seq))) AS thread_id,
      CASE WHEN min(thread_id) IS NULL THEN 'created' WHEN min(stage) = 'held' THEN 'held' WHEN bool_or(action = 'send_reply') THEN 'replied' ELSE 'upgraded' END AS transition,
      CASE WHEN min(stage) = 'alerted' THEN 'sent' ELSE 'held' END AS status, arg_max(item_key, seq) AS last_item_key, arg_max(title, seq) AS last_title,
      arg_min(protocol_ref, seq) FILTER (WHERE protocol_ref IS NOT NULL) AS protocol_ref,
      array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split(roles, ','))), lambda x: x <> ''))), ',') AS roles,
      CASE WHEN min(stage) = 'alerted' THEN 'Oggetto ' || group_key END AS subject
    FROM {_SETTLED} WHERE delivery = 'sent' OR stage = 'held' GROUP BY group_key)"""


@query("thread_changes", f"SELECT thread_id, transition, status, last_item_key, last_title, protocol_ref, roles, subject FROM {_CHANGES}")
def q_thread_changes(spark, sf_dir):
    changes = settlement.thread_changes(settled(spark, sf_dir), "group_key", "seq")
    return changes.select("thread_id", "transition", "status", "last_item_key", "last_title", "protocol_ref",
                          F.array_join("role_signature", ",").alias("roles"), "subject")


@query("thread_table_after_run", f"""
    SELECT thread_id, CASE WHEN k.thread_id IS NULL OR c.transition = 'upgraded' THEN c.status ELSE 'held' END AS status,
      CASE WHEN k.thread_id IS NULL OR c.transition = 'held' THEN c.roles ELSE 'old' END AS roles,
      coalesce(c.last_item_key, 'old') AS last_item_key, CASE WHEN c.transition IN ('created', 'upgraded') THEN c.subject END AS subject
    FROM (SELECT DISTINCT thread_id FROM {_ASK} WHERE thread_id IS NOT NULL) k FULL JOIN {_CHANGES} c USING (thread_id)""")
def q_thread_table(spark, sf_dir):
    none, at = F.lit(None).cast("string"), F.lit("2026-06-01 00:00:00").cast("timestamp")
    known = asked(spark, sf_dir).filter("thread_id is not null").select("thread_id").distinct().select(
        "thread_id", none.alias("school_code"), none.alias("cup"), none.alias("clp"), F.array(F.lit("old")).alias("role_signature"), none.alias("protocol_ref"),
        F.lit("held").alias("status"), none.alias("subject"), none.alias("message_id"), F.lit("old").alias("last_item_key"),
        F.lit("old").alias("last_title"), at.alias("created_at"), at.alias("updated_at"))
    changes = settlement.thread_changes(settled(spark, sf_dir), "group_key", "seq")
    after = state_ops.apply_thread_updates(known, changes, RUN)
    return after.select("thread_id", "status", F.array_join("role_signature", ",").alias("roles"), "last_item_key", "subject")
