"""Polls as micro-batches: exactly-once intake, thread decisions, durable state snapshots.

Each micro-batch is one run against the state before it, with a single writer.  State lives in
snapshot tables (not in operator state), so keys have no expiry and a hot key is an ordinary join key.
"""

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from noticeflow.functions.keys import item_key
from noticeflow.operators import state_ops, threads
from noticeflow.schemas import STATE_KEYS


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has arrived, batch by batch, then stop."""
    finish(stream.writeStream.foreachBatch(handle), checkpoint)


def finish(writer: DataStreamWriter, checkpoint: str) -> None:
    """Run until everything that has arrived is processed."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_new_notices(notices: DataFrame, processed_path: str, checkpoint: str, order: str) -> None:
    """Append notices never seen before to the processed table, one row per key: the first by ``order``.

    ``order`` is an arrival sequence; a publication date as text would not sort by time.

    Partial replays are safe: the batch writes its own folder, so a re-run replaces it.
    """
    spark = notices.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("item_key", item_key(F.col("school_code"), F.col("item_id")))
        seen = _earlier(spark, processed_path, batch_id, keyed.schema)
        fresh = state_ops.insert_if_absent(seen, keyed, "item_key", order)
        fresh.write.mode("overwrite").parquet(f"{processed_path}/batch={batch_id}")

    run_available(notices, handle, checkpoint)


def _earlier(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """Rows written by earlier batches."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    stored = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    return spark.read.schema(stored).parquet(path).filter(F.col("batch") < batch_id).drop("batch")


def late_notice_filter(notices: DataFrame, today) -> DataFrame:
    """Rolling lower bound for dated search results; a filter, not a watermark - undated rows must pass."""
    from noticeflow.functions.dates import outside_window

    return notices.filter(~F.coalesce(outside_window(F.col("vendor"), F.col("published"), today), F.lit(False)))


def stream_threads(items: DataFrame, known_threads: DataFrame, as_of, out_path: str, checkpoint: str) -> None:
    """Thread decision per arriving item against the thread table, written per batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        resolved = threads.resolve_thread(threads.match_thread(batch, known_threads, as_of))
        resolved.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    run_available(items, handle, checkpoint)


def deliver_all(planned: DataFrame) -> DataFrame:
    """A sender that never fails: one outcome per granted group, its message named by the group's first row."""
    sent = planned.filter(F.col("stage") == "alerted").groupBy("group_key").agg(F.min_by("item_key", "seq").alias("_first"))
    return sent.select("group_key", F.lit(True).alias("delivered"), F.concat(F.lit("<"), F.md5("_first"), F.lit(">")).alias("message_id"),
                       F.col("group_key").alias("subject"))


def stream_funnel(notices: DataFrame, tables: Callable[[], dict[str, DataFrame]], run, root: str, checkpoint: str,
                  deliver: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Full run per micro-batch: notices are decided and sent, and all tables change at once.

    ``tables`` returns the current registry, texts and verdicts; ``run`` is a ``funnel.Run`` or gives one
    for a batch number.  ``deliver`` maps planned rows to outcomes (group_key, delivered, message_id,
    subject) and is asked once per batch, as its answer is stored before anything else; without it alerts
    stay leased for a sender outside.

    Each table gets the rows of touched keys only.  A batch becomes visible by its marker, written last; if
    it is interrupted before, the next start repeats it from the state before it and keeps the tables it
    had finished.  A batch that has its marker is skipped.
    """
    from noticeflow.operators import lookups
    from noticeflow.operators.ranking import ordinal
    from noticeflow.plans import funnel
    from noticeflow.session import cut_lineage
    from noticeflow.sources import state

    spark = notices.sparkSession

    def touched(table: str, changes: DataFrame) -> DataFrame:
        """The rows of a table that a run may change."""
        key = STATE_KEYS[table]
        return state.read_state(spark, root, table).join(changes.select(key).distinct(), key, "left_semi")

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch_id in state.committed(spark, root):
            return
        t, now = tables(), run(batch_id) if callable(run) else run
        before = {name: state.read_state(spark, root, name) for name in ("processed_items", "alerts", "call_threads", "result_acts")}
        decided = funnel.decide(batch, t["registry"], t["texts"], t["verdicts"], before["processed_items"], before["alerts"], now, before["result_acts"])
        decided = cut_lineage(ordinal(decided, [], ["item_key", "url", "title"], "seq"))
        planned = funnel.plan_alerts(decided, before["call_threads"], before["alerts"], now)
        outcomes = None
        if deliver is not None:
            if not state.written(spark, root, "outcomes", batch_id):
                state.write_changes(deliver(planned), root, "outcomes", batch_id)
            outcomes = state.own_changes(spark, root, "outcomes", batch_id)
        settled = funnel.settle(planned, outcomes, touched("alerts", planned), before["call_threads"], now)
        final = funnel.final_decisions(decided, settled.planned).withColumn("updated_at", F.lit(now.utc)).withColumn(
            "first_seen", F.lit(now.utc))
        archive = decided.filter("confirmed").withColumn(
            "opp_key", F.lower(F.concat_ws("|", "school_code", "url"))).withColumn(
            "first_seen", F.lit(now.utc)).withColumn("last_seen", F.lit(now.utc))
        acts = lookups.result_acts(funnel.with_project(batch, t["registry"]))
        changes = {
            "alerts": settled.alerts,
            "call_threads": state_ops.apply_thread_updates(touched("call_threads", settled.changes), settled.changes, now.utc),
            "decisions": state_ops.upsert_decision(touched("decisions", final), final),
            "opportunities": state_ops.upsert_opportunity(touched("opportunities", archive), archive),
            "result_acts": lookups.merge_result_acts(touched("result_acts", acts), acts),
            "processed_items": state_ops.insert_if_absent(before["processed_items"], final.filter("processed"), "item_key", "seq"),
        }
        for table, rows in changes.items():
            state.write_changes(rows, root, table, batch_id)
        state.commit(spark, root, batch_id)

    run_available(notices, handle, checkpoint)
