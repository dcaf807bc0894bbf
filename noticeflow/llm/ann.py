"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.session import cut_lineage

TABLES = 6
WIDTH = 1.0            # width of a hash interval, in largest norms
BUCKET = 500           # vectors that a bucket is meant to hold
RECALL = 0.98          # neighbours that the visited buckets should hold, by the hash functions' own estimate
SAMPLE, SAMPLE_QUERIES = 4096, 128     # vectors that the neighbour distance is fitted on
INDEX_BLOCK, QUERY_BLOCK = 1 << 22, 1 << 21   # numbers in a task's pair of blocks, at most
PARTS, PART = 24, 1 << 19     # an index of that many blocks of PART numbers or less is not cut further
PRODUCTS = 1 << 21     # inner products that a task holds at once
SPARE = 8              # candidates kept beyond k until the exact scores are known


@dataclass
class Hashing:
    """``functions`` random projections per table; the inner product as a distance.

    A vector is extended by sqrt(M^2 - |x|^2), M the largest norm, and a query by 0 after scaling it to
    norm M: the largest inner product is then the smallest distance.  Normal projections are 2-stable, so
    the projections of two points differ by a normal variate times their distance; that gives the
    chance that a neighbour at the fitted distance lies in any interval.
    """

    dim: int
    functions: int
    norm: float
    radius: float
    n: int

    def __post_init__(self):
        rng = np.random.default_rng(7 + self.dim)
        self.axes = rng.normal(size=(TABLES, self.dim + 1, self.functions))
        self.shift = rng.uniform(0, 1, size=(TABLES, 1, self.functions))

    def _project(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        full = np.column_stack([x, last]) / self.norm
        return np.einsum("nd,tdf->tnf", full, self.axes) / WIDTH + self.shift

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The interval numbers of every vector: table x vector x function."""
        left = np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(axis=1)))
        return np.floor(self._project(x, left)).astype(np.int64)

    def chances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per table, query and function: the lowest interval in reach, and the chance that a neighbour lies in each from there."""
        scaled = q * (self.norm / np.sqrt((q * q).sum(axis=1)))[:, None]
        at = self._project(scaled, np.zeros(len(q)))
        spread = self.radius / self.norm / WIDTH
        reach = max(1, math.ceil(3 * spread))
        low = np.floor(at).astype(np.int64) - reach
        ends = low[..., None] + np.arange(2 * reach + 2)
        return low, np.diff(np.interp((ends - at[..., None]) / spread, _GRID, _NORMAL), axis=-1)

    def least(self, q: np.ndarray) -> np.ndarray:
        """Per query and table the least chance of a bucket that is visited: the tables together should hold RECALL of the neighbours."""
        enough = 1 - (1 - RECALL) ** (1 / TABLES)
        chances = -np.sort(-self.chances(q)[1], axis=-1)
        return np.array([[_least(chances[t, i].tolist(), enough) for t in range(TABLES)] for i in range(len(q))]).reshape(len(q), TABLES)

    def visited(self, low: np.ndarray, chances: np.ndarray, least: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """query x vector: whether the vector is in a bucket that the query visits in any table."""
        out = np.zeros((low.shape[1], buckets.shape[1]), bool)
        for t in range(TABLES):
            different, own = np.unique(buckets[t], axis=0, return_inverse=True)
            chance = np.ones((len(out), len(different)))
            for f in range(self.functions):
                step = different[:, f] - low[t, :, f, None]
                inside = (step >= 0) & (step < chances.shape[-1])
                chance *= np.where(inside, np.take_along_axis(chances[t, :, f], np.where(inside, step, 0), axis=1), 0)
            out |= ((chance > 0) & (chance >= least[:, t, None] * (1 - 1e-9)))[:, own.ravel()]
        return out


_GRID = np.linspace(-9, 9, 1 << 14)
_NORMAL = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _GRID])


def _least(choices: list[list[float]], enough: float) -> float:
    """Products of one choice per function (each list descending) are taken in descending order, until ``enough`` is seen: the last one."""
    start = (0,) * len(choices)
    heap, seen, total, last = [(-math.prod(c[0] for c in choices), start)], {start}, 0.0, 0.0
    while heap and total < enough:
        chance, pick = heapq.heappop(heap)
        if chance == 0:
            return last
        total, last = total - chance, -chance
        for f in range(len(pick)):
            if pick[f] + 1 < len(choices[f]):
                after = pick[:f] + (pick[f] + 1,) + pick[f + 1:]
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (-math.prod(c[p] for c, p in zip(choices, after, strict=True)), after))
    return last


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part: no null, zero or non-finite ones."""
    v = F.col("embedding").cast("array<double>")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null AND v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite).filter(F.exists("v", lambda x: x != 0))


def _distinct(rows: DataFrame, keep: int, kind: str) -> DataFrame:
    """(gid, v, ids): every different vector once, with its ``keep`` smallest ids, of which gid is the first.

    Among equal vectors only the smallest ids can be among the nearest.  A partition hands on ``keep`` of
    them, so a vector held by many rows is short after the first step.
    """
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list[int]] = {}
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held.setdefault(tuple(x + 0.0 for x in v), []).append(i)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(held), pa.list_(pa.float32() if kind == "float" else pa.float64())),
                pa.array([sorted(set(ids))[:keep] for ids in held.values()], pa.list_(pa.int64()))], ["v", "ids"])

    lists = rows.mapInArrow(few, f"v array<{kind}>, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep)
    return cut_lineage(lists.groupBy("v").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("gid"), "v", "ids"))


def fit(groups: DataFrame, k: int) -> dict[int, Hashing]:
    """Hash functions per dimension; their number follows the count of vectors, their reach a fitted distance."""
    stats = groups.groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).alias("norm")).collect()
    out = {}
    for row in stats:  # one per dimension
        sample = groups.filter(F.size("v") == row.dim).orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).select("v").collect()
        x = np.array([r.v for r in sample])
        q = x[:SAMPLE_QUERIES]
        score = (q * (row.norm / np.linalg.norm(q, axis=1))[:, None]) @ x.T
        np.fill_diagonal(score, -np.inf)
        rank = min(max(1, round(k * len(x) / row.n)), max(1, len(x) - 1))
        best = -np.sort(-score, axis=1)[:, rank - 1] if len(x) > 1 else np.zeros(1)
        distance = np.sqrt(np.maximum(0, 2 * row.norm**2 - 2 * np.where(np.isfinite(best), best, 0)))
        radius = max(float(np.median(distance)), 1e-3 * row.norm)
        out[row.dim] = Hashing(row.dim, max(1, round(math.log(max(1.0, row.n / BUCKET), 5))), row.norm, radius, row.n)
    return out


def _vectors(column) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _asking(groups: DataFrame, hashing: dict[int, Hashing], kind: str) -> DataFrame:
    """(dim, gid, v, least): the queries, with the least chance of a bucket that each visits per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                dims = batch.column("dim").to_numpy(zero_copy_only=False)
                for dim in np.unique(dims).tolist():
                    part = batch.filter(pa.array(dims == dim))
                    least = hashing[dim].least(_vectors(pa.chunked_array([part.column("v")])))
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c) for c in ("dim", "gid", "v")], pa.array(least.tolist(), pa.list_(pa.float64()))], ["dim", "gid", "v", "least"])

    return groups.select(F.size("v").alias("dim"), "gid", "v").mapInArrow(run, f"dim int, gid long, v array<{kind}>, least array<double>")


_FOUND = pa.schema([("query", pa.int64()), ("gids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _best(left: pa.Table, right: pa.Table, keep: int, hashing: Hashing) -> pa.Table:
    """A row for each query of a query block: the ``keep`` nearest of those of an index block in its buckets, by exact inner products."""
    if not left.num_rows or not right.num_rows:
        return _FOUND.empty_table()
    every, gid, all_gids = _vectors(left.column("v")), left.column("gid").to_numpy(), right.column("gid").to_numpy()
    buckets = hashing.buckets(every)
    all_q, all_least = _vectors(right.column("v")), _vectors(right.column("least"))
    sizes, gids, scores = [], [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, PRODUCTS // len(every))
    for a in range(0, len(all_q), step):
        q = all_q[a:a + step]
        visited = hashing.visited(*hashing.chances(q), all_least[a:a + step], buckets)
        some = np.flatnonzero(visited.any(axis=0))
        x, own = every[some], gid[some]
        products = np.where(visited[:, some], q @ x.T, -np.inf)
        take = min(keep, len(x))
        least = -np.partition(-products, take - 1, axis=1)[:, take - 1] if take else np.zeros(len(q))
        # products differ in their last places by the order they are summed in
        margin = 1e-12 * hashing.norm * np.sqrt((q * q).sum(axis=1))
        for i in range(len(q)):
            near = np.flatnonzero((products[i] >= least[i] - margin[i]) & (products[i] > -np.inf))
            # the reported product is summed in one order wherever the pair meets, so equal pairs have equal scores
            score = (x[near] * q[i]).sum(axis=1)
            first = np.lexsort((own[near], -score))[:take]
            sizes.append(len(first))
            gids.append(own[near[first]])
            scores.append(score[first])
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
    return pa.Table.from_arrays([
        pa.array(all_gids), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(gids))),
        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(scores)))], schema=_FOUND)


def _merged(keep: int):
    """Rows sorted by query: the ``keep`` best entries of each query's lists, each entry once."""
    def top(query: np.ndarray, gid: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gid, -score, query))
        query, gid, score = query[order], gid[order], score[order]
        # an entry met in several tables has the same score, so its repeats follow each other
        new = np.concatenate(([True], (query[1:] != query[:-1]) | (gid[1:] != gid[:-1]))) if len(query) else np.zeros(0, bool)
        query, gid, score = query[new], gid[new], score[new]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        few = rank < keep
        return pa.RecordBatch.from_arrays([pa.array(query[few]), pa.array(gid[few]), pa.array(score[few])], ["query", "gid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            lists = batch.column("gids")
            size = np.diff(np.asarray(lists.offsets))
            held = [np.concatenate(x) for x in zip(held, (
                np.repeat(batch.column("query").to_numpy(zero_copy_only=False), size), lists.flatten().to_numpy(zero_copy_only=False),
                batch.column("scores").flatten().to_numpy(zero_copy_only=False)), strict=True)]
            # the last query may go on in the next batch
            done = held[0] != held[0][-1] if len(held[0]) else np.zeros(0, bool)
            if done.any():
                yield top(*[x[done] for x in held])
            rest = top(*[x[~done] for x in held])
            held = [rest.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        yield top(*held)
    return run


def nearest(rows: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """For each query its ``k`` nearest: query_id, rank (from 1), vec_id, score (inner product).

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows with another
    vec_id and as many components.  Vectors that are null, zero or hold null or non-finite components,
    and rows without vec_id, take no part; a repeated row counts once; equal scores rank by vec_id.

    Equal vectors are one entry of the index.  Index and queries are cut into blocks, and each pair of blocks meets
    once, whatever the number of buckets: a task hashes its vectors and takes a query's candidates from the buckets
    the query visits in any table.  So no bucket is copied for the queries that visit it.
    """
    array = rows.schema["embedding"].dataType
    kind = "float" if isinstance(array, T.ArrayType) and isinstance(array.elementType, T.FloatType) else "double"
    valid = usable(rows)
    groups = _distinct(valid, k + 1, kind)
    asked = valid.filter(F.col("vec_id") % every == 0).select("vec_id", F.col("v").cast(f"array<{kind}>").alias("v")).distinct()
    asked = cut_lineage(asked.join(groups.select("v", "gid"), "v").select(F.col("vec_id").alias("query_id"), "gid"))
    hashing = fit(groups, k)
    queries = cut_lineage(_asking(groups.join(asked.select("gid").distinct(), "gid", "left_semi"), hashing, kind))
    counts = {r.dim: r["count"] for r in queries.groupBy("dim").count().collect()}  # one per dimension
    size = [(d, max(-(-h.n * d // INDEX_BLOCK), min(PARTS, -(-h.n * d // PART))), max(1, -(-counts.get(d, 0) * d // QUERY_BLOCK)))
            for d, h in hashing.items()]
    size = F.broadcast(rows.sparkSession.createDataFrame(size, "dim int, n int, m int"))
    own = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = groups.select(F.size("v").alias("dim"), "gid", "v").join(size, "dim").select("dim", own("n").alias("a"), other("m").alias("b"), "gid", "v")
    right = queries.join(size, "dim").select("dim", other("n").alias("a"), own("m").alias("b"), "gid", "v", "least")
    keep = k + 1 + SPARE

    def pair(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _best(left, right, keep, hashing[key[0].as_py()])

    block = ["dim", "a", "b"]
    lists = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(pair, "query long, gids array<long>, scores array<double>")
    found = lists.repartition("query").sortWithinPartitions("query").mapInArrow(_merged(keep), "query long, gid long, score double")
    # every id of the best entries, then every query with its own row taken out
    ids = found.join(groups.select("gid", "ids"), "gid").select("query", "score", F.explode("ids").alias("vec_id"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("r") <= k + 1)
    result = asked.join(ids.select(F.col("query").alias("gid"), "vec_id", "score"), "gid").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "gid").orderBy(F.col("score").desc(), "vec_id"))
    return result.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
