"""Queries over keyed state: upserts, leases, thread updates, checkpoints, streamed intake."""

from datetime import datetime

from pyspark.sql import functions as F

from noticeflow.catalog.base import FEED, PROJECTS, View, italian_date, padded, query, table, text
from noticeflow.catalog.joins import ITEMS, PROCESSED, THREADS, _signalled
from noticeflow.operators import lookups, reports, state_ops
from noticeflow.sources import state as store
from noticeflow.session import scratch_path
from noticeflow.streaming import intake

AS_OF = datetime(1998, 6, 1, 1, 0)
_AS_OF_SQL = "timestamp '1998-06-01 01:00:00'"
_LIVE_SQL = f"(status = 'sent' OR (status = 'sending' AND updated_at >= {_AS_OF_SQL} - INTERVAL 120 MINUTE))"


# Alert leases of earlier runs: one per order up to the day of the run.
ALERTS = View("orders", {
    "alert_key": "'a' || " + text("o_orderkey"),
    "school_code": "'SC' || " + padded("o_custkey", 8),
    "url": "'https://albo.example.it/' || " + text("o_orderkey"),
    "status": "CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'sending' ELSE 'failed' END",
    "message_id": "'<' || " + text("o_orderkey") + " || '>'",
    "subject": "o_orderpriority",
    "created_at": "cast(o_orderdate as timestamp)",
    "updated_at": "cast(o_orderdate as timestamp)",
}, where="o_orderdate < timestamp '1998-06-02 00:00:00'")
# Send requests of this run: every order line asks for its order's alert; copies ask again.
_SEQ = "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint)"
REQUESTS = View("lineitem", {
    "alert_key": "'a' || " + text("l_orderkey"),
    "seq": _SEQ,
    "group_key": "'G' || " + text("l_suppkey") + " || '/' || " + text("l_partkey % 50"),
    "school_code": "'SC' || " + padded("l_suppkey", 8),
    "url": "'https://albo.example.it/' || " + text("l_orderkey"),
})


@query("already_alerted", f"SELECT seq FROM {REQUESTS.sql} WHERE alert_key IN (SELECT alert_key FROM {ALERTS.sql} WHERE {_LIVE_SQL})")
def q_alerted(spark, sf_dir):
    return lookups.already_alerted(REQUESTS.df(spark, sf_dir), ALERTS.df(spark, sf_dir), AS_OF).select("seq")


@query("lease_ttl", f"SELECT status, count(*) AS n, count(*) FILTER (WHERE {_LIVE_SQL}) AS n_live FROM {ALERTS.sql} GROUP BY status")
def q_lease(spark, sf_dir):
    alerts = ALERTS.df(spark, sf_dir)
    live = lookups.live_alerts(alerts, AS_OF).withColumn("live", F.lit(1))
    return alerts.join(live, "alert_key", "left").groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.count("live").alias("n_live"))


_RESERVED_SQL = f"""(SELECT r.*, (row_number() OVER (PARTITION BY r.alert_key ORDER BY r.seq) = 1 AND l.alert_key IS NULL) AS granted
    FROM {REQUESTS.sql} r LEFT JOIN (SELECT alert_key FROM {ALERTS.sql} WHERE {_LIVE_SQL}) l ON r.alert_key = l.alert_key)"""


@query("reserve_alert", f"SELECT seq, granted FROM {_RESERVED_SQL}")
def q_reserve(spark, sf_dir):
    return state_ops.reserve_alerts(REQUESTS.df(spark, sf_dir), ALERTS.df(spark, sf_dir), AS_OF).select("seq", "granted")


_GROUPED_SQL = f"""(SELECT *, CASE WHEN whole THEN 'sending' WHEN granted THEN 'failed' END AS new_status
    FROM (SELECT *, bool_and(granted) OVER (PARTITION BY group_key) AS whole FROM {_RESERVED_SQL}))"""


@query("reserve_group", f"SELECT seq, whole AS group_granted, new_status FROM {_GROUPED_SQL}")
def q_reserve_group(spark, sf_dir):
    reserved = state_ops.reserve_alerts(REQUESTS.df(spark, sf_dir), ALERTS.df(spark, sf_dir), AS_OF)
    return state_ops.reserve_groups(reserved, "group_key").select("seq", "group_granted", "new_status")


@query("lease_alerts", f"""
    SELECT alert_key, coalesce(c.school_code, a.school_code) AS school_code, coalesce(c.new_status, a.status) AS status,
      CASE WHEN c.alert_key IS NULL THEN cast(a.updated_at AS string) ELSE '1998-06-01 01:00:00' END AS updated
    FROM {ALERTS.sql} a FULL JOIN (SELECT alert_key, school_code, new_status FROM {_GROUPED_SQL} WHERE new_status IS NOT NULL) c USING (alert_key)""")
def q_lease_alerts(spark, sf_dir):
    alerts = ALERTS.df(spark, sf_dir)
    reserved = state_ops.reserve_groups(state_ops.reserve_alerts(REQUESTS.df(spark, sf_dir), alerts, AS_OF), "group_key")
    return state_ops.lease_alerts(alerts, reserved, AS_OF).select(
        "alert_key", "school_code", "status", F.col("updated_at").cast("string").alias("updated"))


# Alerts delivered in this run: one per supplier's first line of an order.
SENT = View("orders", {
    "alert_key": "'a' || " + text("o_orderkey"),
    "school_code": "'SC' || " + padded("o_custkey", 8),
    "url": "'https://albo.example.it/' || " + text("o_orderkey"),
    "message_id": "'<new' || " + text("o_orderkey") + " || '>'",
    "subject": "'Opportunità ' || " + text("o_orderkey"),
}, where="o_orderpriority = '1-URGENT'")


@query("mark_alerted", f"""SELECT alert_key, CASE WHEN s.alert_key IS NULL THEN a.status ELSE 'sent' END AS status,
    coalesce(s.message_id, a.message_id) AS message_id, coalesce(s.subject, a.subject) AS subject
    FROM {ALERTS.sql} a FULL JOIN {SENT.sql} s USING (alert_key)""")
def q_mark_alerted(spark, sf_dir):
    return state_ops.mark_alerted(ALERTS.df(spark, sf_dir), SENT.df(spark, sf_dir), AS_OF).select(
        "alert_key", "status", "message_id", "subject")


@query("mark_failed", f"""SELECT alert_key, CASE WHEN status = 'sending' AND alert_key IN (SELECT alert_key FROM {SENT.sql}) THEN 'failed' ELSE status END AS status
    FROM {ALERTS.sql}""")
def q_mark_failed(spark, sf_dir):
    return state_ops.mark_failed(ALERTS.df(spark, sf_dir), SENT.df(spark, sf_dir), AS_OF).select("alert_key", "status")


@query("insert_if_absent", f"""SELECT item_key, title, published FROM {FEED.sql} WHERE item_key NOT IN (SELECT item_key FROM {PROCESSED.sql})""")
def q_insert(spark, sf_dir):
    feed = FEED.df(spark, sf_dir).select("item_key", "title", "published", "seq")
    twice = feed.unionByName(feed.withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("title", F.lit("copia")))
    known = PROCESSED.df(spark, sf_dir).select("item_key", "title", "published")
    return state_ops.insert_if_absent(known, twice, "item_key", "seq")


# Archive before the run: first-half notices, one row per organisation and kind; the run brings the whole month.
_OPP = {
    "opp_key": "lower('SC' || " + padded("user_id", 8) + " || '|' || event_type)",
    "school_code": "'SC' || " + padded("user_id", 8),
    "title": "'Avviso ' || " + text("event_id"),
    "deadline": italian_date("ts"),
    "opportunity_type": "event_type",
    "confidence": "CASE WHEN value > 20 THEN 'high' ELSE 'medium' END",
    "first_seen": text("event_id"),
    "last_seen": text("event_id"),
    "seq": "event_id",
}
OPP_BATCH = View("events", _OPP, where="ts >= timestamp '2024-01-10 00:00:00'")
OPP_HISTORY = View("events", _OPP, where="ts < timestamp '2024-01-10 00:00:00'")
OPP_ALL = View("events", _OPP)
_OPP_STATE_SQL = f"""(SELECT opp_key, arg_min(title, seq) AS title, arg_max(deadline, seq) AS deadline, arg_min(first_seen, seq) AS first_seen,
    arg_max(last_seen, seq) AS last_seen, arg_max(confidence, seq) AS confidence FROM {OPP_HISTORY.sql} GROUP BY opp_key)"""


@query("upsert_opportunity", f"""
    SELECT opp_key, coalesce(o.title, n.title) AS title, coalesce(n.deadline, o.deadline) AS deadline, coalesce(n.confidence, o.confidence) AS confidence,
      coalesce(o.first_seen, n.first_seen) AS first_seen, coalesce(n.last_seen, o.last_seen) AS last_seen
    FROM {_OPP_STATE_SQL} o FULL JOIN (
      SELECT opp_key, arg_min(title, seq) AS title, arg_max(deadline, seq) AS deadline, arg_min(first_seen, seq) AS first_seen,
        arg_max(last_seen, seq) AS last_seen, arg_max(confidence, seq) AS confidence FROM {OPP_BATCH.sql} GROUP BY opp_key) n USING (opp_key)""")
def q_upsert_opportunity(spark, sf_dir):
    columns = ["opp_key", "school_code", "title", "deadline", "opportunity_type", "confidence", "first_seen", "last_seen"]
    empty = OPP_HISTORY.df(spark, sf_dir).select(*columns).limit(0)
    before = state_ops.upsert_opportunity(empty, OPP_HISTORY.df(spark, sf_dir))
    after = state_ops.upsert_opportunity(before, OPP_BATCH.df(spark, sf_dir))
    return after.select("opp_key", "title", "deadline", "confidence", "first_seen", "last_seen")


_DEC = {
    "item_key": "'SC' || " + padded("user_id", 8),
    "school_code": "'first ' || " + text("event_id"),
    "title": "'Avviso ' || " + text("event_id"),
    "url": "'https://albo.example.it/' || " + text("event_id"),
    "stage": "event_type",
    "reason": "'k' || props",
    "updated_at": "ts",
    "seq": "event_id",
}
DEC_BATCH = View("events", _DEC, where="ts >= timestamp '2024-01-16 00:00:00'")
DEC_HISTORY = View("events", _DEC, where="ts < timestamp '2024-01-16 00:00:00'")


@query("upsert_decision", f"""
    SELECT item_key, coalesce(o.school_code, n.school_code) AS school_code, coalesce(n.stage, o.stage) AS stage, coalesce(n.reason, o.reason) AS reason
    FROM (SELECT item_key, arg_min(school_code, seq) AS school_code, arg_max(stage, seq) AS stage, arg_max(reason, seq) AS reason FROM {DEC_HISTORY.sql} GROUP BY 1) o
    FULL JOIN (SELECT item_key, arg_min(school_code, seq) AS school_code, arg_max(stage, seq) AS stage, arg_max(reason, seq) AS reason FROM {DEC_BATCH.sql} GROUP BY 1) n USING (item_key)""")
def q_upsert_decision(spark, sf_dir):
    columns = ["item_key", "school_code", "title", "url", "stage", "reason", "updated_at"]
    empty = DEC_HISTORY.df(spark, sf_dir).select(*columns).limit(0)
    before = state_ops.upsert_decision(empty, DEC_HISTORY.df(spark, sf_dir))
    return state_ops.upsert_decision(before, DEC_BATCH.df(spark, sf_dir)).select("item_key", "school_code", "stage", "reason")


# Thread changes of a run: urgent and high threads are touched, every open call starts a thread.
_TRANSITION = "CASE WHEN o_orderstatus = 'O' THEN 'created' WHEN o_orderpriority = '1-URGENT' THEN 'upgraded' WHEN o_orderpriority = '2-HIGH' THEN 'replied' ELSE 'held' END"
CHANGES = View("orders", {
    "thread_id": "'T' || " + text("o_orderkey"),
    "transition": _TRANSITION,
    "school_code": "'SC' || " + padded("o_custkey", 8),
    "cup": "'new'", "clp": "'new'",
    "roles": "'rup'",
    "protocol_ref": "'new'",
    "status": "'sent'",
    "subject": "'Nuovo'",
    "message_id": "'<n>'",
    "last_item_key": "'i' || " + text("o_orderkey"),
    "last_title": "'Ultimo ' || " + text("o_orderkey"),
}, where="o_orderpriority <> '5-LOW'")


@query("apply_thread_updates", f"""
    SELECT thread_id, coalesce(t.school_code, c.school_code) AS school_code,
      CASE WHEN c.transition IN ('created', 'held') THEN c.roles ELSE t.roles END AS roles,
      CASE WHEN c.transition IN ('created', 'held') THEN c.protocol_ref ELSE t.protocol_ref END AS protocol_ref,
      CASE WHEN c.transition IN ('created', 'upgraded') THEN c.status ELSE t.status END AS status,
      CASE WHEN c.transition IN ('created', 'upgraded') THEN c.message_id ELSE t.message_id END AS message_id,
      CASE WHEN c.transition IS NULL THEN t.last_title ELSE c.last_title END AS last_title,
      c.transition IS NOT NULL AS touched
    FROM {THREADS.sql} t FULL JOIN {CHANGES.sql} c USING (thread_id)""")
def q_thread_updates(spark, sf_dir):
    now = datetime(2030, 1, 1)
    known = _signalled(THREADS, spark, sf_dir).withColumn("created_at", F.col("updated_at"))
    updated = state_ops.apply_thread_updates(known, _signalled(CHANGES, spark, sf_dir), now)
    return updated.select("thread_id", "school_code", F.array_join("role_signature", ",").alias("roles"), "protocol_ref", "status",
                          "message_id", "last_title", (F.col("updated_at") == F.lit(now)).alias("touched"))


@query("checkpoint_advance", "SELECT 1 AS id, (17 + (SELECT count(*) FROM orders)) % (SELECT count(*) FROM customer) AS next_index")
def q_checkpoint(spark, sf_dir):
    polled = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("polled"), F.lit(1).alias("id"))
    total = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("id"))
    before = total.join(polled, "id").withColumn("next_index", F.lit(17))
    return state_ops.checkpoint_advance(before, F.col("polled"), F.col("total")).select("id", "next_index")


@query("export_opportunities", f"""
    SELECT p.school_code, p.school_name, p.region, p.cup, p.clp, o.title, o.opp_key AS url, o.deadline,
      CASE WHEN strptime(o.deadline, '%d/%m/%Y') < timestamp '2024-01-20 00:00:00' THEN 'scaduta' ELSE 'aperta' END AS status,
      o.opportunity_type, o.confidence, '' AS published, o.first_seen, o.last_seen
    FROM {OPP_ALL.sql} o JOIN {PROJECTS.sql} p ON o.school_code = p.school_code""")
def q_export(spark, sf_dir):
    rows = OPP_ALL.df(spark, sf_dir).join(PROJECTS.df(spark, sf_dir), "school_code")
    archive = rows.withColumn("url", F.col("opp_key")).withColumn("published", F.lit(""))
    return reports.export_opportunities(archive, datetime(2024, 1, 20).date())


# --- snapshots and streams -------------------------------------------------------------------------------------

_PROCESSED_COLUMNS = ("item_key", "school_code", "title", "published")


@query("read_state", f"SELECT item_key, school_code, title, published FROM {FEED.sql}")
def q_read_state(spark, sf_dir):
    root = scratch_path(spark, "state")
    feed = FEED.df(spark, sf_dir).withColumn("first_seen", F.col("ts").cast("timestamp"))
    store.write_state(feed.filter("ts < timestamp '2024-01-16 00:00:00'"), root, "processed_items")
    known = store.read_state(spark, root, "processed_items")
    store.write_state(known.unionByName(state_ops.insert_if_absent(known, feed, "item_key", "seq")), root, "processed_items")
    return store.read_state(spark, root, "processed_items").select(*_PROCESSED_COLUMNS)


@query("write_state", f"SELECT thread_id, school_code, roles, status FROM {THREADS.sql}")
def q_write_state(spark, sf_dir):
    root = scratch_path(spark, "state")
    known = _signalled(THREADS, spark, sf_dir).withColumn("created_at", F.col("updated_at"))
    written = store.write_state(known, root, "call_threads")
    return written.select("thread_id", "school_code", F.array_join("role_signature", ",").alias("roles"), "status")


@query("stream_new_notices", f"SELECT item_key, title, published FROM {FEED.sql}")
def q_stream(spark, sf_dir):
    doubled = FEED.stream(spark, sf_dir).unionByName(FEED.stream(spark, sf_dir))
    path = scratch_path(spark, "intake")
    intake.stream_new_notices(doubled, path, scratch_path(spark, "offsets"), order="seq")
    return spark.read.parquet(path).select("item_key", "title", "published")


@query("stream_threads", f"SELECT item_key, thread_id, action FROM ({{resolve}})")
def q_stream_threads(spark, sf_dir):
    from noticeflow.catalog.joins import AS_OF as RUN

    signalled = ITEMS.stream(spark, sf_dir).withColumn("role_signature", F.filter(F.split("roles", ","), lambda r: r != "")).drop("roles")
    path = scratch_path(spark, "threads")
    intake.stream_threads(signalled, _signalled(THREADS, spark, sf_dir), RUN, path, scratch_path(spark, "offsets"))
    return spark.read.parquet(path).select("item_key", "thread_id", "action")


def _share_oracle() -> None:
    """The streamed thread decisions must equal the batch ones."""
    from noticeflow.catalog.base import ORACLES

    ORACLES["stream_threads"] = ORACLES["stream_threads"].format(resolve=ORACLES["resolve_thread"])


_share_oracle()
