"""Exact dedup: a tree merge of digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import text_of, without_white
from noticeflow.session import cut_lineage

_KEY = ("text_sha256", "_bytes", "_check")


def exact_dedup(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; of equal texts the one with the most code
    points stays, then the smallest doc_id (null after all others), then the first row.  A null text is
    empty; repeated rows are rows of their own, so just one is kept; other columns are ignored.

    Each input partition is a run with one entry per digest.  A round hands runs ``i`` to run
    ``i / fan_in`` and merges them, keeping count and best identifier of every digest, until one run is
    left.  An entry is merged only if its byte length and a second hash of the text agree as well.  A
    digest held by a third of the rows is one entry per run, so no round meets it more than ``fan_in``
    times at one place.
    """
    text = text_of()
    bare = without_white(text)
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("_chars"),
        F.sha2(bare.cast("binary"), 256).alias("text_sha256"), F.octet_length(bare).alias("_bytes"),
        F.xxhash64(bare).alias("_check"), F.spark_partition_id().alias("_run"),
        F.monotonically_increasing_id().alias("_row"),
    ))
    best = F.struct(-F.col("_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    runs = rows.groupBy("_run", *_KEY).agg(F.count(F.lit(1)).alias("group_size"), F.min(best).alias("_best"))
    last = rows.agg(F.max("_run")).first()[0] or 0
    while last > 0:
        runs = runs.withColumn("_run", F.expr(f"_run div {fan_in}").cast("int")).groupBy("_run", *_KEY).agg(
            F.sum("group_size").alias("group_size"), F.min("_best").alias("_best"))
        last //= fan_in
    groups = runs.select(*_KEY, "group_size", F.col("_best.doc_id").alias("keep_id"), F.col("_best._row").alias("_keep"))
    return rows.join(groups, list(_KEY)).select(
        "doc_id", "keep_id", "group_size", (F.col("_row") == F.col("_keep")).alias("kept"), "text_sha256")


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY c DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY s ORDER BY c DESC, doc_id) AS kept, s AS text_sha256
FROM d"""
