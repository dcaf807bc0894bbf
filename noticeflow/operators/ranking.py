"""Ordered picks that stay exact when one key holds a large share of the rows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.session import cut_lineage


def keep_first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """First row per key.  An aggregate, not a window: each task pre-reduces its own rows."""
    return _pick(df, keys, F.min_by, order)


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last row per key (last write wins)."""
    return _pick(df, keys, F.max_by, order)


def _pick(df: DataFrame, keys: list[str], pick, order) -> DataFrame:
    rank = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(pick(F.struct(*df.columns), rank).alias("_row"))
    return picked.select("_row.*")


def top_k(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """First k rows per key; Spark limits every partition before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal",
            partitions: int | None = None) -> DataFrame:
    """1-based position within each key over the whole table, without one task per key.

    Rows are range-partitioned by (key, order) and pinned by a reliable checkpoint; positions are
    counted inside each (key, partition) and shifted by that key's earlier partitions.  A key with
    a third of the rows is spread over a third of the partitions.  ``order`` must be total.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id())
    pinned = cut_lineage(spread)
    sizes = pinned.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = sizes.select(
        *keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    # the shift of a key's slice comes as a row before the slice's own, so rows move once for both
    marked = pinned.withColumn("_shift", F.lit(None).cast("long")).unionByName(shift, allowMissingColumns=True)
    local = Window.partitionBy(*keys, "_slice").orderBy(F.col("_shift").isNull(), *order)
    placed = marked.withColumn("_local", F.row_number().over(local) - 1).withColumn("_before", F.first("_shift").over(local))
    return placed.filter("_shift IS NULL").withColumn(name, F.col("_local") + F.col("_before")).select(*df.columns, name)


def budget_cap(df: DataFrame, key: str, budget: int, *order, spent: str = "granted") -> DataFrame:
    """Mark the first ``budget`` rows in order; the rest are deferred.  ``key`` is unique.

    The winners are a distributed top-k of at most ``budget`` keys, so the marking join is small.
    """
    winners = df.orderBy(*order).limit(budget).select(F.col(key), F.lit(True).alias(spent))
    return df.join(winners, key, "left").withColumn(spent, F.coalesce(F.col(spent), F.lit(False)))


def rotate(df: DataFrame, ordinal_col: str, start: Column | int, total: Column | int) -> DataFrame:
    """Rotated position: the run starts at ``start`` and wraps around."""
    start = F.lit(start) if isinstance(start, int) else start
    total = F.lit(total) if isinstance(total, int) else total
    return df.withColumn("run_order", F.pmod(F.col(ordinal_col) - 1 - F.pmod(start, total), total))


def limit_ordered(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)
