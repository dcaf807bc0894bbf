"""Keyed state: insert-if-absent, partial upserts, alert leases, thread updates.

Each function maps (state, batch) to the new state; the update policy of every table is data.
Batches are reduced to one row per key first.  One writer per micro-batch, see ``streaming``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.operators.lookups import live_alerts
from noticeflow.operators.ranking import keep_first

# Columns an update may change, per table; everything else keeps its first value.
UPDATE_POLICY = {
    "opportunities": ("deadline", "opportunity_type", "confidence", "last_seen"),
    "decisions": ("title", "url", "stage", "reason", "updated_at"),
}
THREAD_COLUMNS = (
    "role_signature", "protocol_ref", "status", "subject", "message_id", "last_item_key", "last_title",
)


def insert_if_absent(state: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append: first batch row per key, only for keys the state does not hold."""
    fresh = batch.join(state.select(key), key, "left_anti")
    return keep_first(fresh, [key], order).select(*state.columns)


def upsert(state: DataFrame, batch: DataFrame, key: str, updatable: tuple[str, ...], order: str) -> DataFrame:
    """Insert new keys; for known keys change only the updatable columns."""
    changing = [c for c in state.columns if c in updatable]
    frozen = [c for c in state.columns if c != key and c not in updatable]
    # a new key keeps the frozen columns of its first batch row; the others come from its last one
    latest = batch.groupBy(key).agg(
        F.min_by(F.struct(*frozen), order).alias("_first"), F.max_by(F.struct(*changing), order).alias("_last")
    ).select(key, "_first.*", "_last.*")
    old, new = state.alias("o"), latest.alias("n")
    known, touched = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"o.{c}", f"n.{c}")
        take_new = touched if c in updatable else touched & ~known
        return F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(
        *[value(c).alias(c) for c in state.columns])


def upsert_opportunity(state: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    return upsert(state, batch, "opp_key", UPDATE_POLICY["opportunities"], order)


def upsert_decision(state: DataFrame, batch: DataFrame, order: str = "seq") -> DataFrame:
    return upsert(state, batch, "item_key", UPDATE_POLICY["decisions"], order)


def reserve_alerts(requests: DataFrame, alerts: DataFrame, as_of, order: str = "seq") -> DataFrame:
    """Add ``granted``: nobody sent this alert, nobody holds a live lease, and the row is the first to ask."""
    first = requests.groupBy("alert_key").agg(F.min(order).alias("_first"))
    blocked = live_alerts(alerts, as_of).withColumn("_blocked", F.lit(True))
    ask = first.join(blocked, "alert_key", "left")
    return requests.join(ask, "alert_key", "left").withColumn(
        "granted", F.col("_blocked").isNull() & (F.col(order) == F.col("_first"))).drop("_blocked", "_first")


def reserve_groups(reserved: DataFrame, group: str) -> DataFrame:
    """All or nothing per group: one refusal releases the granted ones (``group_granted``, ``new_status``)."""
    whole = reserved.groupBy(group).agg(F.bool_and("granted").alias("group_granted"))
    return reserved.join(whole, group, "left").withColumn(
        "new_status", F.when(F.col("group_granted"), F.lit("sending")).when(F.col("granted"), F.lit("failed")))


def lease_alerts(alerts: DataFrame, reserved: DataFrame, as_of) -> DataFrame:
    """New alerts table after a reservation pass (rows with a ``new_status``)."""
    changed = reserved.filter(F.col("new_status").isNotNull()).select(
        "alert_key", "school_code", "url", F.col("new_status").alias("status"))
    return _apply_alerts(alerts, changed, as_of, ("school_code", "url", "status"))


def mark_alerted(alerts: DataFrame, sent: DataFrame, as_of) -> DataFrame:
    """Unconditional move to sent, with message id and subject."""
    changed = sent.select("alert_key", "school_code", "url", F.lit("sent").alias("status"), "message_id", "subject")
    return _apply_alerts(alerts, changed, as_of, ("school_code", "url", "status", "message_id", "subject"))


def _apply_alerts(alerts: DataFrame, changed: DataFrame, as_of, columns: tuple[str, ...]) -> DataFrame:
    one = changed.groupBy("alert_key").agg(
        F.max(F.struct(*columns)).alias("_new"))
    joined = alerts.join(one, "alert_key", "full")
    now, touched = F.lit(as_of).cast("timestamp"), F.col("_new").isNotNull()
    fresh = F.col("updated_at").isNull()

    def value(c: str) -> Column:
        if c == "updated_at":
            return F.when(touched, now).otherwise(F.col(c))
        if c == "created_at":
            return F.when(touched & fresh, now).otherwise(F.col(c))
        return F.when(touched, F.col(f"_new.{c}")).otherwise(F.col(c)) if c in columns else F.col(c)

    return joined.select(*[value(c).alias(c) for c in alerts.columns])


def mark_failed(alerts: DataFrame, failed: DataFrame, as_of) -> DataFrame:
    """Move sending -> failed; other states stay."""
    hit = failed.select("alert_key").distinct().withColumn("_failed", F.lit(True))
    release = F.coalesce(F.col("_failed"), F.lit(False)) & (F.col("status") == "sending")
    return alerts.join(hit, "alert_key", "left").withColumn(
        "updated_at", F.when(release, F.lit(as_of).cast("timestamp")).otherwise(F.col("updated_at"))
    ).withColumn("status", F.when(release, F.lit("failed")).otherwise(F.col("status"))).select(*alerts.columns)


def apply_thread_updates(threads: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Thread table after one run.  ``changes``: one row per thread_id with ``transition`` and new values.

    created - a new held or sent thread; upgraded - held thread that was sent (roles stay);
    replied - only the last item moves; held - roles, protocol and last item are refreshed.
    """
    touches = {
        "upgraded": {"status", "subject", "message_id", "last_item_key", "last_title"},
        "replied": {"last_item_key", "last_title"},
        "held": {"role_signature", "protocol_ref", "last_item_key", "last_title"},
    }
    now = F.lit(as_of).cast("timestamp")
    old, new = threads.alias("o"), changes.alias("n")
    transition = F.col("n.transition")

    def value(c: str) -> Column:
        if c == "thread_id":
            return F.coalesce("o.thread_id", "n.thread_id")
        if c == "updated_at":
            return F.when(transition.isNotNull(), now).otherwise(F.col("o.updated_at"))
        if c == "created_at":
            return F.coalesce(F.col("o.created_at"), now)
        allowed = ["created"] + [t for t, cols in touches.items() if c in cols and c in THREAD_COLUMNS]
        return F.when(transition.isin(*allowed), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return old.join(new, F.col("o.thread_id") == F.col("n.thread_id"), "full").select(
        *[value(c).alias(c) for c in threads.columns])


def checkpoint_advance(checkpoint: DataFrame, count: Column | int, total: Column | int) -> DataFrame:
    """One-row table: next start position, wrapping; unchanged when there is nothing to poll."""
    count = F.lit(count) if isinstance(count, int) else count
    total = F.lit(total) if isinstance(total, int) else total
    moved = F.pmod(F.col("next_index") + count, total)
    return checkpoint.withColumn("next_index", F.when(total > 0, moved).otherwise(F.col("next_index")))
