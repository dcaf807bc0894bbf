"""What a run settles: which groups may send, what was delivered, how threads change.

Groups ask for their alerts in order, all or nothing: a refused group gives back what it had reserved,
so a later group may have it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.operators.lookups import live_alerts
from noticeflow.operators.state_ops import mark_alerted, mark_failed
from noticeflow.session import cut_lineage, small


def _ranks(rows: DataFrame, group: str, order: str, threaded: Column, project: Column, wanted: DataFrame | None = None) -> DataFrame:
    """``_rank`` of every group, or of the ``wanted`` ones only."""
    late = ~F.coalesce(threaded, F.lit(False))
    marked = rows.select(group, order, late.alias("_late"), F.when(late, F.coalesce(project, F.col(group))).alias("_project"))
    own = marked.groupBy(group).agg(F.min("_late").alias("_late"), F.min("_project").alias("_project"), F.min(order).alias("_own"))
    own = own if wanted is None else cut_lineage(own.join(wanted, group, "left_semi"))
    first = marked.filter("_late").groupBy("_project").agg(F.min(order).alias("_first"))
    # a thread stands for itself
    known = own.filter(~F.col("_late")).withColumn("_first", F.col("_own"))
    placed = known.unionByName(own.filter("_late").join(first, "_project"))
    return placed.select(group, F.struct(F.col("_late").cast("int").alias("_late"), "_first", "_own").alias("_rank"))


def group_rank(rows: DataFrame, group: str, order: str, threaded: Column, project: Column) -> DataFrame:
    """Add ``_rank``: groups of known threads by their first row, then new groups by project and first row."""
    return rows.join(_ranks(rows, group, order, threaded, project), group)


def settle_groups(requests: DataFrame, alerts: DataFrame, as_of, group: str, order: str, rank: str = "_rank") -> DataFrame:
    """Add ``group_granted`` and ``new_status`` (sending, failed or null) to rows that ask for an ``alert_key``.

    A group is refused if one of its alerts was sent or is leased, if it asks twice for one, or if a group
    before it (by ``rank``) was granted one.  What a refused group reserved before its first refusal
    becomes failed, unless another group is granted it.
    """
    return _settle(requests, alerts, as_of, group, order, lambda wanted: requests.select(group, F.col(rank).alias("_rank")).join(
        wanted, group, "left_semi").groupBy(group).agg(F.min("_rank").alias("_rank")))


def settle_in_turn(rows: DataFrame, alerts: DataFrame, as_of, group: str, order: str, threaded: Column, project: Column) -> DataFrame:
    """``settle_groups`` in the order of ``group_rank``, which is asked of groups only that share an alert."""
    return _settle(rows, alerts, as_of, group, order, lambda wanted: _ranks(rows, group, order, threaded, project, wanted))


def _settle(requests: DataFrame, alerts: DataFrame, as_of, group: str, order: str, ranks: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``settle_groups``; ``ranks`` gives ``_rank`` of the groups it is handed.

    All rows move to their alert once, where those that alone ask for a free one are done with, and at last
    to what their group is told: the refused ones are told, all others are granted.  Ranks are asked of groups
    only that share an alert.

    Of groups that share an alert, in every round those are granted that come first for all their alerts,
    and those are refused that share one with them.  So rounds grow with the longest chain of groups that
    wait for each other, and each round moves undecided groups only.
    """
    asking = requests.filter(F.col(group).isNotNull())
    live = live_alerts(alerts, as_of).filter("alert_key IS NOT NULL").withColumn("_live", F.lit(True))
    meeting = asking.select("alert_key", F.col(group).alias("_who"), F.col(order).alias("_at"), F.lit(False).alias("_live")).unionByName(
        live, allowMissingColumns=True)
    # requests for no alert at all meet those of their own group only
    meeting = meeting.withColumn("_none", F.when(F.col("alert_key").isNull(), F.col("_who")))
    one = Window.partitionBy("alert_key", "_none")
    met = meeting.withColumn("_blocked", F.max("_live").over(one)).withColumn("_n", F.count("_who").over(one))
    # of what a group asks for one alert, the first two places tell all
    place = F.dense_rank().over(Window.partitionBy("alert_key", "_none", "_who").orderBy("_at"))
    firsts = met.filter(~F.col("_live") & (F.col("_blocked") | (F.col("_n") > 1))).withColumn("_place", place).filter("_place <= 2")
    # the group's name comes from an aggregate: what Catalyst infers of a grouping column that is null on one side of a union fails later
    per_key = firsts.groupBy("alert_key", "_none", "_who").agg(
        F.min("_who").alias(group), F.max("_blocked").alias("_blocked"), F.count(F.lit(1)).alias("_asks"),
        F.min("_at").alias("_first_ask"), F.max("_at").alias("_next_ask"))
    again = F.when(F.col("_next_ask") > F.col("_first_ask"), F.col("_next_ask"))
    end = F.when(F.col("alert_key").isNotNull(), F.when(F.col("_blocked"), F.col("_first_ask")).otherwise(again))
    asked = cut_lineage(per_key.withColumn("_shared", F.count(F.lit(1)).over(one) > 1).select(
        group, F.when(F.col("_shared"), F.col("alert_key")).alias("alert_key"), "_shared", (F.col("_blocked") | (F.col("_asks") > 1)).alias("_out"),
        F.when(F.col("_shared"), F.col("_first_ask")).alias("_first_ask"), end.alias("_end")))

    out = asked.filter("_out").select(group).distinct().withColumn("_hopeless", F.lit(True))
    rivals = asked.filter("_shared").select(group, "alert_key", "_first_ask", "_end")
    rivals = cut_lineage(rivals.join(ranks(rivals.select(group).distinct()), group).join(out, group, "left"))
    undecided = rivals.filter("_hopeless IS NULL").select(group, "alert_key", "_rank")
    granted = undecided.select(group).limit(0)
    at = Window.partitionBy("alert_key")
    while not undecided.isEmpty():
        led = undecided.withColumn("_first", F.min(F.struct("_rank", group)).over(at)).select(
            group, (F.col("_rank") == F.col("_first._rank")).alias("_leads"), F.col("_first").getField(group).alias("_lead"))
        won = led.groupBy(group).agg(F.bool_and("_leads").alias("_won"))
        winners = won.filter("_won").select(F.col(group).alias("_lead"))
        losers = led.filter(~F.col("_leads")).join(winners, "_lead", "left_semi").select(group).distinct().withColumn("_lost", F.lit(True))
        decided = cut_lineage(won.join(losers, group, "left"))
        granted = granted.unionByName(decided.filter("_won").select(group))
        waiting = small(decided.filter(~F.col("_won") & F.col("_lost").isNull()).select(group))
        undecided = cut_lineage(undecided.join(waiting, group, "left_semi"))

    held = rivals.join(granted.withColumn("_won", F.lit(True)), group, "left").withColumn(
        "_holder", F.min(F.when(F.col("_won"), F.col("_rank"))).over(at))
    lost = held.filter("_won IS NULL").select(
        group, F.when(F.col("_holder") < F.col("_rank"), F.col("_first_ask")).otherwise(F.col("_end")).alias("_end"))
    # an alert that one group asks for is here because that group cannot have it
    told = asked.filter(~F.col("_shared")).select(group, "_end").unionByName(lost).groupBy(group).agg(F.min("_end").alias("_end"))
    return asking.join(told.withColumn("_refused", F.lit(True)), group, "left").withColumn(
        "group_granted", F.col("_refused").isNull()).withColumn(
        "new_status", F.when(F.col("group_granted"), "sending").when(F.col(order) < F.col("_end"), "failed")
    ).select(*requests.columns, "group_granted", "new_status")


def settle_delivery(planned: DataFrame, outcomes: DataFrame, group: str = "group_key") -> DataFrame:
    """Granted rows with what became of their message: stage, reason, message_id, subject.

    ``outcomes`` has one row per group that was tried: delivered, message_id, subject.  A group without one
    counts as not delivered; its lease stays until it expires, as nobody knows whether it went out.
    """
    told = outcomes.select(group, F.col("delivered").alias("_delivered"), "message_id", "subject")
    rows = planned.drop("message_id", "subject").join(told, group, "left")
    sent = F.col("stage") == "alerted"
    lost = sent & ~F.coalesce("_delivered", F.lit(False))
    return rows.withColumn("delivery", F.when(~sent, F.lit(None)).when(F.col("_delivered"), "sent").when(
        ~F.col("_delivered"), "failed").otherwise("unknown")).withColumn(
        "reason", F.when(lost, F.lit(vocab.SEND_FAILED_REASON)).otherwise(F.col("reason"))).withColumn(
        "stage", F.when(lost, "send_failed").otherwise(F.col("stage"))).drop("_delivered")


def settle_alerts(alerts: DataFrame, settled: DataFrame, leased_at, as_of) -> DataFrame:
    """Alerts after delivery: delivered ones are sent, failed ones are free again.

    Only a lease taken at ``leased_at`` is given back, so a run that comes late cannot free the lease of
    another one.
    """
    done = mark_alerted(alerts, settled.filter("delivery = 'sent'"), as_of)
    own = alerts.filter((F.col("status") == "sending") & (F.col("updated_at") == F.lit(leased_at).cast("timestamp")))
    return mark_failed(done, settled.filter("delivery = 'failed'").join(own.select("alert_key"), "alert_key", "left_semi"), as_of)


def thread_changes(settled: DataFrame, group: str, order: str) -> DataFrame:
    """One row per thread that a run creates or touches, as ``apply_thread_updates`` takes them.

    A delivered group replies to its thread (``replied``), turns a held one into a sent one (``upgraded``)
    or starts a thread; a held group refreshes its thread (``held``) or starts a held one.  Groups that were
    refused, not delivered or suppressed change nothing.  Roles are united, the first protocol in order and
    the last item stand for the group; a new thread is named by its project and first item, so a run that
    is repeated names it the same.
    """
    rank = F.col(order)
    cup = F.coalesce(F.nullif("cup", F.lit("")), F.col("school_code"))
    # rows are exploded by role, so what a task holds of a group is bounded by the vocabulary
    groups = settled.filter(F.col("stage").isin("alerted", "held")).withColumn("_role", F.explode_outer("role_signature")).groupBy(group).agg(
        F.array_sort(F.collect_set("_role")).alias("role_signature"),
        F.min_by("protocol_ref", F.when(F.col("protocol_ref").isNotNull(), rank)).alias("protocol_ref"),
        F.max_by(F.struct("item_key", "title"), rank).alias("_last"),
        F.min_by(F.struct("item_key", "school_code", cup.alias("cup"), "clp"), rank).alias("_first"),
        F.bool_or(F.col("action") == "send_reply").alias("_reply"), F.bool_or(F.col("stage") == "alerted").alias("_sent"),
        F.min("thread_id").alias("thread_id"), F.min("message_id").alias("message_id"), F.min("subject").alias("subject"))
    known = F.col("thread_id").isNotNull()
    own = F.md5(F.concat_ws("|", "_first.school_code", "_first.cup", "_first.item_key"))
    return groups.select(
        F.coalesce("thread_id", own).alias("thread_id"),
        F.when(~known, "created").when(F.col("_sent") & F.col("_reply"), "replied").when(F.col("_sent"), "upgraded").otherwise("held").alias("transition"),
        "_first.school_code", "_first.cup", "_first.clp", "role_signature", "protocol_ref",
        F.when(F.col("_sent"), "sent").otherwise("held").alias("status"),
        F.when(F.col("_sent"), F.col("subject")).alias("subject"), F.when(F.col("_sent"), F.col("message_id")).alias("message_id"),
        F.col("_last.item_key").alias("last_item_key"), F.col("_last.title").alias("last_title"))
