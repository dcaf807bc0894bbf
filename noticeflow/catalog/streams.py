"""Queries over streams that keep state."""

from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.catalog.base import View, case, padded, query, text
from noticeflow.session import scratch_path
from noticeflow.streaming.thread_state import RESULT, stream_thread_state

# A user's events are documents of one project; time is stretched, so that threads expire.
_AT = "cast(ts as timestamp) + (cast(ts as timestamp) - timestamp '2024-01-01 00:00:00') * 5"
DOCUMENTS = View("events", {
    "item_key": text("event_id"),
    "seq": "event_id",
    "school_code": "'SC' || " + padded("user_id", 8),
    "cup": "CASE WHEN event_id % 19 = 0 THEN '' ELSE 'H74D' || " + padded("user_id", 11) + " END",
    "title": "'Avviso ' || " + text("event_id"),
    "roles": case("event_id % 7", {"0": "'esperto'", "1": "'tutor'", "2": "'esperto,tutor'", "3": "'rup'"}, "''"),
    "protocol_ref": "CASE WHEN event_id % 5 = 0 THEN " + text("user_id") + " || '|' || " + text("event_id % 3") + " END",
    "published_date": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN cast(" + _AT + " - INTERVAL '4' DAY as date) "
                      "WHEN 2 THEN cast(" + _AT + " - INTERVAL '33' DAY as date) ELSE cast(" + _AT + " as date) END",
    "same_process": "value > 30",
    "actionable": "event_type IN ('click', 'purchase')",
    "seen_at": _AT,
    "arrival": "CASE WHEN ts < timestamp '2024-01-11 00:00:00' THEN 0 WHEN ts < timestamp '2024-01-21 00:00:00' THEN 1 ELSE 2 END",
})
_LIVE = f"list_filter(w.open, lambda t: t.touched >= e.seen_at - INTERVAL {vocab.THREAD_TTL_DAYS} DAY)"
_FOLD = f"""
    WITH RECURSIVE docs AS MATERIALIZED (SELECT *, list_filter(string_split(roles, ','), lambda x: x <> '') AS rs FROM {DOCUMENTS.sql}),
    e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY school_code, cup ORDER BY seen_at, seq) AS rn FROM docs WHERE cup <> ''),
    walk AS (
      SELECT school_code, cup, 0::BIGINT AS rn, ''::VARCHAR AS item_key, ''::VARCHAR AS thread_id, ''::VARCHAR AS action, ''::VARCHAR AS match_why,
        []::STRUCT(id VARCHAR, status VARCHAR, r VARCHAR[], p VARCHAR, touched TIMESTAMP)[] AS open FROM (SELECT DISTINCT school_code, cup FROM e)
      UNION ALL
      SELECT school_code, cup, rn, item_key, hit.id, act, why,
        CASE WHEN act = 'suppress' THEN live ELSE list_prepend(
          {{'id': hit.id, 'status': CASE WHEN act = 'hold' THEN 'held' ELSE 'sent' END, 'r': CASE WHEN k = 0 OR act = 'hold' THEN rs ELSE hit.r END,
            'p': CASE WHEN k = 0 OR act = 'hold' THEN protocol_ref ELSE hit.p END, 'touched': seen_at}}, list_filter(live, lambda t: t.id <> hit.id)) END
      FROM (SELECT *, CASE WHEN k = 0 OR hit.status = 'held' THEN CASE WHEN actionable THEN 'send_new' ELSE 'hold' END
              WHEN actionable THEN 'send_reply' ELSE 'suppress' END AS act,
            CASE WHEN len(live) = 0 THEN 'no open threads for this CUP' WHEN k1 > 0 THEN 'matching protocol reference'
              WHEN k2 > 0 THEN 'overlapping role + close publish date' WHEN k3 > 0 THEN 'AI judged same process' ELSE 'no matching thread' END AS why
        FROM (SELECT *, CASE WHEN k1 > 0 THEN k1 WHEN k2 > 0 THEN k2 ELSE k3 END AS k,
              CASE WHEN k > 0 THEN live[k] ELSE {{'id': md5(school_code || '|' || cup || '|' || item_key), 'status': '', 'r': rs, 'p': protocol_ref, 'touched': seen_at}} END AS hit
          FROM (SELECT *, coalesce(list_position(list_transform(live, lambda t: coalesce(t.p = protocol_ref, false)), true), 0) AS k1,
                coalesce(list_position(list_transform(live, lambda t: list_has_any(t.r, rs) AND coalesce(abs(published_date - cast(t.touched AS date)) <= {vocab.ROLE_MATCH_DAYS}, false)), true), 0) AS k2,
                CASE WHEN same_process AND list_min(apart) <= {vocab.NEAREST_THREAD_DAYS} THEN list_position(apart, list_min(apart)) ELSE 0 END AS k3
            FROM (SELECT e.*, {_LIVE} AS live, list_transform({_LIVE}, lambda t: abs(e.published_date - cast(t.touched AS date))) AS apart
              FROM walk w JOIN e ON e.school_code = w.school_code AND e.cup = w.cup AND e.rn = w.rn + 1)))))
    SELECT item_key, school_code, cup, thread_id, action, match_why FROM walk WHERE rn > 0
    UNION ALL SELECT item_key, school_code, cup, NULL, CASE WHEN actionable THEN 'send_new' ELSE 'hold' END, 'no CUP' FROM docs WHERE cup = ''"""


@query("stream_thread_state", _FOLD)
def q_stream_thread_state(spark, sf_dir):
    """The table arrives in three parts; after each one the stream stops and is restarted from its checkpoint."""
    folder, out, offsets = (scratch_path(spark, n) for n in ("arrivals", "threads", "offsets"))
    docs = DOCUMENTS.df(spark, sf_dir).withColumn("role_signature", F.filter(F.split("roles", ","), lambda r: r != "")).drop("roles")
    for arrival in range(3):
        docs.filter(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(folder)
        stream_thread_state(spark.readStream.schema(docs.drop("arrival").schema).parquet(folder), out, offsets)
    return spark.read.schema(RESULT).parquet(out)
