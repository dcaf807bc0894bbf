"""Joins of notices with registry, history, details, verdicts and threads.

Right sides hold one row per key (by contract, or reduced here first), so no join multiplies rows and
adaptive execution may split a hot key on the left freely.  Broadcasts are left to Catalyst's size check.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions.dates import parse_notice_date
from noticeflow.functions.text import first_non_empty, has_any


def new_notices(notices: DataFrame, processed: DataFrame) -> DataFrame:
    """Notices whose key was never processed; copies inside one fetch survive."""
    return notices.join(processed.select("item_key"), "item_key", "left_anti")


def key_difference(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct wanted keys that are not known."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def project_lookup(notices: DataFrame, registry: DataFrame, columns: list[str]) -> DataFrame:
    return notices.join(registry.select("school_code", *columns), "school_code", "left")


def _marked_results(notices: DataFrame, terms) -> DataFrame:
    """Add whether a title names its project (``_coded``) and is a result act of it (``_result``), and its ``_day``."""
    title = F.lower(F.col("title"))

    def names(code: str) -> Column:
        c = F.lower(F.coalesce(F.col(code), F.lit("")))
        return (c != "") & F.contains(title, c)

    return notices.withColumn("_coded", names("cup") | names("clp")).withColumn(
        "_result", F.col("_coded") & has_any(title, terms.RESULT_MARKERS, normalized=False)
    ).withColumn("_day", parse_notice_date(F.col("published")))


def result_acts(notices: DataFrame, terms=vocab) -> DataFrame:
    """Per organisation: the day of its latest result act, and whether it has an undated one."""
    return _marked_results(notices, terms).filter("_result").groupBy("school_code").agg(
        F.max("_day").alias("last_result"), F.bool_or(F.col("_day").isNull()).alias("undated_result"))


def merge_result_acts(*summaries: DataFrame) -> DataFrame:
    """One summary of several: acts of earlier polls stay known however often they are merged."""
    return reduce(DataFrame.unionByName, summaries).groupBy("school_code").agg(
        F.max("last_result").alias("last_result"), F.bool_or("undated_result").alias("undated_result"))


def with_superseded(notices: DataFrame, terms=vocab, earlier: DataFrame | None = None) -> DataFrame:
    """Add ``superseded``: a result act of the same project is as recent as the notice, or undated.

    Needs title, published, school_code, cup and clp.  Result acts shrink to one row per project
    (latest date, any undated) before the join, so the theta join becomes an equi-join; ``earlier`` are
    those of earlier polls (see ``result_acts``).
    """
    results = result_acts(notices, terms)
    results = merge_result_acts(results, earlier) if earlier is not None else results
    closed = F.col("_day").isNull() | F.col("undated_result") | (F.col("last_result") >= F.col("_day"))
    return _marked_results(notices, terms).join(results, "school_code", "left").withColumn(
        "superseded", F.coalesce(F.col("_coded") & ~F.col("_result") & closed, F.lit(False))
    ).drop("_coded", "_result", "_day", "last_result", "undated_result")


def live_alerts(alerts: DataFrame, as_of) -> DataFrame:
    """Keys that block another send: sent, or being sent within the lease."""
    fresh = F.col("updated_at") >= F.lit(as_of) - F.expr(f"INTERVAL {vocab.ALERT_LEASE_MINUTES} MINUTES")
    return alerts.filter((F.col("status") == "sent") | ((F.col("status") == "sending") & fresh)).select("alert_key")


def already_alerted(candidates: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    return candidates.join(live_alerts(alerts, as_of), "alert_key", "left_semi")


def detail_join(notices: DataFrame, details: DataFrame, key: str = "detail_ref") -> DataFrame:
    """Listing rows with their detail record, one record per id."""
    one = details.groupBy(key).agg(F.min_by(F.struct(*[c for c in details.columns if c != key]),
                                            F.struct(*[c for c in details.columns if c != key])).alias("_d"))
    return notices.join(one.select(key, "_d.*"), key, "left")


def enrich_notice(joined: DataFrame) -> DataFrame:
    """Fill expiry and category from detail columns detail_expires, detail_original, detail_category."""
    return joined.withColumn(
        "expires", first_non_empty(F.col("detail_expires"), F.col("detail_original"), F.col("expires"))
    ).withColumn("category", first_non_empty(F.col("detail_category"), F.col("category"))).drop(
        "detail_expires", "detail_original", "detail_category")


def verdict_join(matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rule matches with their external answer or error; null when not consulted."""
    return matches.join(verdicts.select("item_key", "answer", "error"), "item_key", "left")


def thread_root(groups: DataFrame, threads: DataFrame) -> DataFrame:
    """Message id and subject of the matched thread, for replies."""
    roots = threads.select("thread_id", F.col("message_id").alias("root_message_id"),
                           F.col("subject").alias("root_subject"))
    return groups.join(roots, "thread_id", "left")
