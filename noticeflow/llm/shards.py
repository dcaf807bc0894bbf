"""Sharding: contiguous shards of near equal bytes, cut on a global prefix sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import prefix_sums, text_of


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: documents in the order of doc_id (null first, then checksum and size) are cut where
    the byte-size prefix sum passes equal targets, so shards are contiguous and differ by at most one
    document's size.  A document goes to the shard that holds its middle byte.  ``size`` is the UTF-8
    length plus 1 (null text: 1, checksum 0); ``slot`` counts a shard's documents from 0 without gaps;
    ``grown_shard`` is null under this law.  Repeated rows are placed one after the other.
    """
    text = text_of()
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = prefix_sums(sized, ["doc_id", "text_crc32", "size"], "size").withColumn(
        "shard",
        # the middle byte times the shard count over the total, in whole numbers
        F.least(F.expr(f"cast((cast(2 * start + size as decimal(38, 0)) * {shards}) div (2 * total) as int)"),
                F.lit(shards - 1)),
    )
    first = placed.groupBy("shard").agg(F.min("position").alias("_first"))  # a row per shard
    return placed.join(first, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
