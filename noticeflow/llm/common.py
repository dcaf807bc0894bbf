"""Small helpers the operators share: typed inputs, distributed prefix sums, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeflow.session import cut_lineage, scratch_path

WHITE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]


def text_of(name: str = "text") -> Column:
    """The text of a row as a string; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without_white(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; plain byte searches, no pattern."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows written to a compressed table in the shared folder (there in ``folder``), and read again."""
    spark = df.sparkSession
    at = f"{folder}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder of one's own; nothing that still has to be computed may read from it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def prefix_sums(rows: DataFrame, order: list[str], value: str, unique: bool = False) -> DataFrame:
    """Add ``start`` (sum of ``value`` before the row), ``position`` (rows before it), ``total`` and ``rows``.

    Rows are range-partitioned by ``order`` and a row number that makes it total, so repeated keys may
    span partitions.  Each partition is summed by itself; one row per partition carries the running
    total to the next.  The placed rows are checkpointed: the sampled boundaries hold for all later reads.
    ``unique`` says that ``order`` is total by itself.
    """
    keys = [F.col(c).asc_nulls_first() for c in order] + ([] if unique else [F.col("_row")])
    numbered = rows if unique else cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    placed = cut_lineage(numbered.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_count"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    parts = parts.select(
        "_part",
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_count_before"),
        F.sum("_sum").over(everything).alias("total"),
        F.sum("_count").over(everything).alias("rows"),
    )
    within = Window.partitionBy("_part").orderBy(*keys)
    local = placed.withColumns({
        "_sum_here": F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value),
        "_count_here": F.row_number().over(within) - 1,
    })
    return local.join(parts, "_part").withColumns({
        "start": F.col("_sum_before") + F.col("_sum_here"),
        "position": F.col("_count_before") + F.col("_count_here"),
    }).drop("_part", "_row", "_sum_before", "_sum_here", "_count_before", "_count_here")


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of ``links`` (a, b long): one row (node, component), the smallest node reachable.

    Large-star and small-star rounds over the links, each checkpointed, until no link changes.  A node's
    neighbours only meet in a minimum (partial sums before the shuffle), so hubs do not gather in a task;
    rounds grow with the logarithm of the longest chain.  Isolated nodes have no row.
    """
    links = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    for _ in range(rounds):
        # large star: every larger neighbour of a node joins the smallest node it sees
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of a node, and itself, join its smallest neighbour
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        pairs = star.join(low, "a")
        star = pairs.select(F.col("b").alias("x"), F.col("m").alias("y")).union(
            pairs.select(F.col("a").alias("x"), F.col("m").alias("y"))
        ).filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        links = cut_lineage(star)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = links.groupBy("a").agg(F.min("b").alias("b"))
    return nodes.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        nodes.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) that ``links`` (a, b) make of those ``found`` before.

    Only links between different components go through rounds; a component's name stays its smallest node.
    """
    first = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    second = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    lifted = cut_lineage(links.join(first, "a", "left").join(second, "b", "left").select(
        "a", F.coalesce("ca", "a").alias("ca"), "b", F.coalesce("cb", "b").alias("cb")))
    over = components(lifted.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    known = found.select("node", "component").union(lifted.select("a", "ca")).union(lifted.select("b", "cb")).distinct()
    return known.join(over.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(
        "node", F.coalesce("top", "component").alias("component"))
