"""Greedy, order-dependent clustering of new alerts inside one project.

An entry joins the first cluster (in creation order) that shares its protocol or one of its roles;
the cluster's roles grow, its first protocol sticks, clusters never merge.  A cluster is named by
the position of its founder, so the result does not depend on the path that computed it.
"""

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.session import cut_lineage

HOT_ROWS = 100_000


def role_mask(roles: Column, terms=vocab.ROLE_TERMS) -> Column:
    """Roles as a bit set (at most 63 terms)."""
    known = F.array(*map(F.lit, terms))
    return F.aggregate(
        F.coalesce(roles, F.array().cast("array<string>")), F.lit(0).cast("bigint"),
        lambda acc, r: acc.bitwiseOR(F.when(F.array_contains(known, r), F.call_function(
            "shiftleft", F.lit(1).cast("bigint"), (F.array_position(known, r) - 1).cast("int"))).otherwise(
            F.lit(0).cast("bigint"))))


def cluster_new(entries: DataFrame, group: str, order: str, hot_rows: int = HOT_ROWS,
                terms=vocab.ROLE_TERMS) -> DataFrame:
    """Add ``cluster_id``.  ``order`` is a bigint; needs role_signature and protocol_ref.

    Entries with equal ``order`` follow each other by their roles, then protocol (none first); those that agree in
    all of these share a cluster, so they are walked once.

    Entries that cannot interact are clustered by plain aggregation.  The rest is folded in order,
    many groups per task; a group beyond ``hot_rows`` is first peeled cluster by cluster with distributed
    aggregations, so no task ever walks more than ``hot_rows`` of its entries.
    """
    mask, protocol = role_mask(F.col("role_signature"), terms), F.coalesce("protocol_ref", F.lit(""))
    ties = F.posexplode(F.array_sort(F.collect_set(F.struct(mask.alias("m"), protocol.alias("p")))))
    slim = cut_lineage(entries.groupBy(F.col(group).alias("g"), F.col(order).cast("bigint").alias("o")).agg(ties.alias("t", "e")).select(
        "g", "o", "t", F.col("e.m").alias("m"), F.nullif("e.p", F.lit("")).alias("p")))
    cited = slim.filter((F.col("m") > 0) & F.col("p").isNotNull()).select("g", "p").distinct()
    lone = slim.filter((F.col("m") == 0) & F.col("p").isNull()).select("g", "o", "m", "p", F.col("o").alias("c"))
    bare = slim.filter((F.col("m") == 0) & F.col("p").isNotNull())
    plain = bare.join(cited, ["g", "p"], "left_anti")
    founders = plain.groupBy("g", "p").agg(F.min("o").alias("c"))
    by_protocol = plain.join(founders, ["g", "p"]).select("g", "o", "m", "p", "c")
    mixed = slim.filter(F.col("m") > 0).unionByName(bare.join(cited, ["g", "p"], "left_semi").select("g", "o", "t", "m", "p"))

    hot_groups = mixed.groupBy("g").count().filter(F.col("count") > hot_rows).select("g")
    parts = [lone, by_protocol]
    if hot_groups.isEmpty():
        parts.append(_fold(mixed))
    else:
        parts.append(_fold(mixed.join(hot_groups, "g", "left_anti")))
        parts.extend(_peel(mixed.join(hot_groups, "g", "left_semi").select("g", "o", "t", "m", "p"), hot_rows))
    assigned = reduce(DataFrame.unionByName, parts)
    named = assigned.select(F.col("g").alias(group), F.col("o").alias("_o"), F.col("m").alias("_m"),
                            F.coalesce("p", F.lit("")).alias("_p"), F.col("c").alias("cluster_id"))
    return entries.withColumns({"_o": F.col(order).cast("bigint"), "_m": mask, "_p": protocol}).join(named, [group, "_o", "_m", "_p"], "left").select(
        *entries.columns, "cluster_id")


def _fold(mixed: DataFrame) -> DataFrame:
    """Sorted walk over partitions of whole groups.

    State of the current group: first cluster owning each role, first cluster citing each protocol.
    """
    import pandas as pd

    def walk(batches: Iterator["pd.DataFrame"]) -> Iterator["pd.DataFrame"]:
        clusters, owner, cited = [], {}, {}
        for batch in batches:
            names = []
            for n, o, m, p in zip(batch["n"], batch["o"], batch["m"], batch["p"]):
                if n == 1:
                    clusters, owner, cited = [], {}, {}
                bits = [b for b in range(m.bit_length()) if m >> b & 1]
                homes = [owner[b] for b in bits if b in owner] + ([cited[p]] if p in cited else [])
                home = min(homes, default=len(clusters))
                if home == len(clusters):
                    clusters.append([o, None])
                owner.update(dict.fromkeys(bits, home))
                if p and clusters[home][1] is None:
                    clusters[home][1] = p
                    cited[p] = min(home, cited.get(p, home))
                names.append(clusters[home][0])
            yield pd.DataFrame({"g": batch["g"], "o": batch["o"], "m": batch["m"], "p": batch["p"], "c": names})

    kind = mixed.schema["g"].dataType.simpleString()
    # A window, not repartition + sort: it makes whole, ordered groups a requirement that adaptive
    # re-planning must keep, whereas a repartition over an equal partitioning is dropped.
    in_order = Window.partitionBy("g").orderBy("o", "t")
    placed = mixed.withColumn("p", F.coalesce("p", F.lit(""))).withColumn("n", F.row_number().over(in_order))
    return placed.mapInPandas(walk, f"g {kind}, o bigint, m bigint, p string, c bigint")


def _peel(hot: DataFrame, hot_rows: int) -> list[DataFrame]:
    """Clusters of large groups, the first of every group at a time, until the rest is small enough to fold.

    A cluster only changes when a member brings a new role or its first protocol - a handful of
    times - so its history is found by a few "next change" aggregations over all rows.
    """
    spark, left, found = hot.sparkSession, cut_lineage(hot), []
    kind = hot.schema["g"].dataType.simpleString()
    layout = f"g {kind}, c bigint, since struct<o:bigint,t:int>, until struct<o:bigint,t:int>, cm bigint, cp string"
    at = F.struct("o", "t")
    head = F.min_by(F.struct("o", "t", "m", "p"), at).alias("e")
    while True:
        heads = left.groupBy("g").agg(head, F.count(F.lit(1)).alias("n")).collect()
        small = [(r.g,) for r in heads if r.n <= hot_rows]
        if small:
            done = spark.createDataFrame(small, f"g {kind}")
            found.append(_fold(left.join(done, "g", "left_semi").select("g", "o", "t", "m", "p")))
            left = left.join(done, "g", "left_anti")
        state = {r.g: [r.e.o, (r.e.o, r.e.t), r.e.m, r.e.p] for r in heads if r.n > hot_rows}
        if not state:
            return found
        history, active = [], dict(state)
        while active:
            now = spark.createDataFrame([(g, c, t, None, m, p) for g, (c, t, m, p) in active.items()], layout)
            later = left.join(now, "g").filter(at > F.col("since"))
            changes = later.filter(_matches() & (
                (F.col("m").bitwiseAND(F.bitwise_not("cm")) != 0) | (F.col("cp").isNull() & F.col("p").isNotNull())))
            steps = {r.g: r.e for r in changes.groupBy("g").agg(head).collect()}
            for g, (c, t, m, p) in list(active.items()):
                step = steps.get(g)
                history.append((g, c, t, (step.o, step.t) if step else None, m, p))
                if step:
                    active[g] = [c, (step.o, step.t), m | step.m, p or step.p]
                else:
                    del active[g]
        spans = spark.createDataFrame(history, layout)
        inside = (at > F.col("since")) & (F.col("until").isNull() | (at <= F.col("until")))
        members = left.join(spans, "g").filter(inside & _matches()).select("g", "o", "t", "m", "p", "c").unionByName(
            spark.createDataFrame([(g, *s[1], *s[2:], s[0]) for g, s in state.items()], f"g {kind}, o bigint, t int, m bigint, p string, c bigint"))
        members = cut_lineage(members)
        found.append(members.drop("t"))
        left = cut_lineage(left.join(members.select("g", "o", "t"), ["g", "o", "t"], "left_anti").select("g", "o", "t", "m", "p"))
        if len(found) % 32 == 0:
            found = [cut_lineage(reduce(DataFrame.unionByName, found))]


def _matches() -> Column:
    shared = F.col("m").bitwiseAND(F.col("cm")) != 0
    return shared | F.coalesce(F.col("p") == F.col("cp"), F.lit(False))
