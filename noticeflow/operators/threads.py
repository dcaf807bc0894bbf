"""Linking documents of one selection process, and the decision that follows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions import keys
from noticeflow.functions.dates import days_apart, parse_notice_date


def open_threads(threads: DataFrame, as_of) -> DataFrame:
    """Held or sent threads touched within the look-back."""
    cutoff = F.lit(as_of) - F.expr(f"INTERVAL {vocab.THREAD_TTL_DAYS} DAYS")
    return threads.filter(F.col("status").isin("held", "sent") & (F.col("updated_at") >= cutoff))


def with_signals(df: DataFrame, normalized: str) -> DataFrame:
    """Add protocol_ref, role_signature and published_date from normalised title + text."""
    text = F.col(normalized)
    return (
        df.withColumn("protocol_ref", keys.protocol_ref(text))
        .withColumn("role_signature", keys.role_signature(text))
        .withColumn("published_date", parse_notice_date(F.col("published")))
    )


def _newest(threads: DataFrame, by: list[str]) -> DataFrame:
    """Most recently touched thread per key, as one struct; ties go to the smaller id."""
    body = F.struct("thread_id", "status", "updated_at")
    rank = F.struct(-F.unix_micros("updated_at"), F.col("thread_id"))
    return threads.groupBy(*by).agg(F.min_by(body, rank).alias("_thread"))


def match_thread(items: DataFrame, threads: DataFrame, as_of, key: str = "item_key") -> DataFrame:
    """Pick at most one open thread per item: thread_id, thread_status, match_why, any_open.

    Items carry school_code, cup, protocol_ref, role_signature, published_date and
    same_process (external verdict about the nearest thread); ``key`` is unique.
    Two look-ups instead of a pairwise join: threads shrink to the newest one per protocol, per
    (role, day) and per day, and an item asks only for the days it may match (11 per role, 61 for the
    nearest).  Work is linear in items however many threads share one project.
    """
    project = ["school_code", "cup"]
    live = open_threads(threads, as_of).filter(F.coalesce("cup", F.lit("")) != "").withColumn(
        "_day", F.to_date("updated_at"))
    by_protocol = _newest(live.filter(F.coalesce(F.col("protocol_ref"), F.lit("")) != ""),
                          [*project, "protocol_ref"])
    cited = items.join(by_protocol.withColumnRenamed("_thread", "_by_protocol"), [*project, "protocol_ref"], "left")

    way = F.lit("role"), F.lit("day")
    by_role = live.withColumn("_way", way[0]).withColumn("_role", F.explode("role_signature"))
    by_day = live.withColumn("_way", way[1]).withColumn("_role", F.lit(""))
    spots = _newest(by_role.unionByName(by_day), [*project, "_way", "_role", "_day"])

    def ask(kind: Column, role: Column, distance: int) -> Column:
        return F.transform(_days_around("published_date", distance), lambda d: F.struct(
            kind.alias("_way"), role.alias("_role"), d.alias("_day")))

    of_roles = F.flatten(F.transform("role_signature", lambda r: ask(way[0], r, vocab.ROLE_MATCH_DAYS)))
    of_days = F.when(F.col("same_process"), ask(way[1], F.lit(""), vocab.NEAREST_THREAD_DAYS))
    asked = cited.filter(F.col("_by_protocol").isNull()).select(
        key, *project, "published_date",
        F.explode(F.concat(of_roles, F.coalesce(of_days, F.slice(of_roles, 1, 0)))).alias("_ask")
    ).select(key, *project, "published_date", "_ask.*")
    distance = F.when(F.col("_way") == "day", days_apart(F.col("published_date"), F.col("_day"))).otherwise(0)
    rank = F.struct(F.col("_way") == "day", distance, -F.unix_micros("_thread.updated_at"), F.col("_thread.thread_id"))
    hits = asked.join(spots, [*project, "_way", "_role", "_day"]).groupBy(key).agg(
        F.min_by(F.struct("_thread", "_way"), rank).alias("_hit"))

    known = live.select(*project).distinct().withColumn("any_open", F.lit(True))
    found = cited.join(hits, key, "left").join(known, project, "left").withColumn(
        "any_open", F.coalesce("any_open", F.lit(False)))
    chosen = F.coalesce("_by_protocol", "_hit._thread")
    return found.select(
        *items.columns, chosen["thread_id"].alias("thread_id"), chosen["status"].alias("thread_status"), "any_open",
        F.when(F.col("_by_protocol").isNotNull(), "matching protocol reference")
        .when(F.col("_hit._way") == "role", "overlapping role + close publish date")
        .when(F.col("_hit._way") == "day", "AI judged same process")
        .when(F.col("any_open"), "no matching thread")
        .otherwise("no open threads for this CUP").alias("match_why"))


def _days_around(column: str, distance: int) -> Column:
    return F.sequence(F.date_sub(column, distance), F.date_add(column, distance))


def nearest_thread(items: DataFrame, threads: DataFrame, as_of, key: str = "item_key") -> DataFrame:
    """Nearest open thread of the same project within the look-around, whatever its signals."""
    project = ["school_code", "cup"]
    live = open_threads(threads, as_of).withColumn("_day", F.to_date("updated_at"))
    by_day = _newest(live, [*project, "_day"])
    asked = items.select(key, *project, "published_date").withColumn(
        "_day", F.explode(_days_around("published_date", vocab.NEAREST_THREAD_DAYS)))
    return asked.join(by_day, [*project, "_day"]).groupBy(key).agg(
        F.min_by(
            F.struct(F.col("_thread.thread_id").alias("thread_id"),
                     days_apart(F.col("published_date"), F.col("_day")).alias("days")),
            F.struct(days_apart(F.col("published_date"), F.col("_day")),
                     -F.unix_micros("_thread.updated_at"), F.col("_thread.thread_id"))).alias("_t")
    ).select(key, "_t.*")


def resolve_thread(matched: DataFrame) -> DataFrame:
    """Add action and action_reason from cup, actionable and the matched thread."""
    cup = F.coalesce(F.col("cup"), F.lit("")) != ""
    found, go = F.col("thread_id").isNotNull(), F.col("actionable")
    held = F.col("thread_status") == "held"
    why = F.concat(F.lit("("), F.col("match_why"), F.lit(")."))

    def told(text: str) -> Column:
        return F.concat(F.lit(text), why)

    action = (
        F.when(~found, F.when(go, "send_new").otherwise("hold"))
        .when(held, F.when(go, "send_new").otherwise("hold"))
        .otherwise(F.when(go, "send_reply").otherwise("suppress"))
    )
    reason = (
        F.when(~cup, F.lit("No CUP to link against."))
        .when(~found & F.col("any_open"), told("New process for this CUP "))
        .when(~found, F.lit("First document seen for this CUP."))
        .when(held & go, told("Held thread now has actionable content "))
        .when(held, told("Still no actionable content "))
        .when(go, told("Companion document for an already-sent process "))
        .otherwise(told("No new information beyond what was already sent "))
    )
    return matched.withColumn("action", action).withColumn("action_reason", reason)


def group_key(thread_id: Column, school_code: Column, cup: Column, cluster: Column | None = None) -> Column:
    """Alerts of one existing thread form a group; new ones group by project (and cluster)."""
    project = F.concat_ws("|", school_code, F.coalesce(F.nullif(cup, F.lit("")), school_code))
    if cluster is not None:
        project = F.concat_ws("#", project, cluster.cast("string"))
    return F.coalesce(thread_id, project)


def merge_signals(entries: DataFrame, group: str, order: str) -> DataFrame:
    """Per group: union of roles, first protocol and first date in order.

    Roles are exploded and collected as a set, so what a task holds is bounded by the vocabulary.
    """
    rank = F.struct(order)
    return entries.withColumn("_role", F.explode_outer("role_signature")).groupBy(group).agg(
        F.array_sort(F.collect_set("_role")).alias("role_signature"),
        F.min_by("protocol_ref", F.when(F.col("protocol_ref").isNotNull(), rank)).alias("protocol_ref"),
        F.min_by("published_date", F.when(F.col("published_date").isNotNull(), rank)).alias("published_date"))


def group_action(entries: DataFrame, group: str) -> DataFrame:
    """One action per group: any send wins (reply if any reply), then hold, else suppress."""
    sends = F.col("action").isin("send_new", "send_reply")
    return entries.groupBy(group).agg(
        F.when(F.bool_or(F.col("action") == "send_reply"), "send_reply")
        .when(F.bool_or(sends), "send_new")
        .when(F.bool_or(F.col("action") == "hold"), "hold")
        .otherwise("suppress").alias("group_action"),
        F.count(F.lit(1)).alias("n_items"))


def thread_last_item(entries: DataFrame, group: str, order: str) -> DataFrame:
    return entries.groupBy(group).agg(F.max_by(F.struct("item_key", "title"), order).alias("_last")).select(
        group, F.col("_last.item_key").alias("last_item_key"), F.col("_last.title").alias("last_title"))
