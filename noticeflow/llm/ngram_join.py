"""N-gram Jaccard join: a grouped prefix join of word-shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import components, extended, text_of
from noticeflow.llm.shingles import by_bytes, mix64, shingle_sets
from noticeflow.llm.tables import bit_tables, counted_levels, level_of, ranges_of
from noticeflow.session import cut_lineage, small

ZONE = 2                          # prefixes are counted this many times their length
FREQUENT = (8, 64, 512, 4096)     # documents from which a shingle is of the next level
MAP_WORDS = 16                    # of 64 bits, in a set's bit map
NEAR = 3                          # a hub's nodes differ from it in at most a third of both sizes
_SALT = np.uint64(0x5851F42D4C957F2D)


def _digest(values: np.ndarray) -> bytes:
    """A 128-bit name of a set."""
    size = np.uint64(len(values))
    return np.array([mix64(values).sum(dtype=np.uint64) + size, mix64(values ^ _SALT).sum(dtype=np.uint64)], np.uint64).tobytes()


def _bit_map(values: np.ndarray) -> np.ndarray:
    """MAP_WORDS words with a bit for every element of a set."""
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[(values >> np.uint64(32)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits).view(np.int64)


def _prefix(n: int, percent: int) -> int:
    """Any set that is similar enough shares one of this many first shingles."""
    return n - -(-percent * n // 100) + 1


def _per_document(docs: DataFrame, words: int, rows, schema: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``rows(batch, sets)`` (an Arrow batch or None) to documents in parts, with their shingle sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "_text"):
                out = rows(batch, shingle_sets(batch.column("_text"), words))
                if out is not None:
                    yield out

    return docs.select(*columns, text_of().alias("_text")).mapInArrow(run, schema)


def _frequent(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    """Levels of the shingles that are among the first of many documents, counted over all documents.

    Every document counts the smallest hashes of its set, a zone of ZONE prefixes.  Sorted runs of hashes
    travel packed; a task holds one of the hash ranges.
    """
    ranges = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def zones(batch, sets):
        return ranges_of(np.concatenate([s[:ZONE * _prefix(len(s), percent)] for s in sets]), ranges)

    return counted_levels(_per_document(docs, words, zones, "range int, keys binary"), ranges, FREQUENT)


def _packed(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "prefix"):
                out = ranges_of(np.frombuffer(b"".join(batch.column("prefix").to_pylist()), np.uint64), ranges)
                if out is not None:
                    yield out
    return run


def _sets_of(docs: DataFrame, words: int, nodes: DataFrame) -> DataFrame:
    """(node, n, values) of the wanted sets, once each; a bit table keeps most others from being sent."""
    spark = docs.sparkSession
    key = F.conv(F.hex(F.substring("node", 1, 7)), 16, 10).cast("long")
    wanted = spark.sparkContext.broadcast(bit_tables(nodes.select(key.alias("key"), F.lit(1).alias("level")), 1))

    def rows(batch, sets):
        names = [_digest(s) for s in sets]
        key = np.array([int.from_bytes(d[:7], "big") for d in names], np.uint64)
        pick = np.flatnonzero(level_of(wanted.value, key) & np.array([len(s) > 0 for s in sets]))
        if not len(pick):
            return None
        return pa.RecordBatch.from_arrays([
            pa.array([names[i] for i in pick], pa.binary()), pa.array([sets[i].tobytes() for i in pick], pa.binary())], ["node", "values"])

    # copies of a set are equal, so any of them will do; each task sends a set once
    found = _per_document(docs, words, rows, "node binary, values binary")
    return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("values").alias("values"))


def _compared(pairs: DataFrame, docs: DataFrame, words: int, percent: int, levels) -> DataFrame:
    """(a, b, n, ok, size, adds, delta) of every pair: by their exact intersection, whether the sets are similar.

    ``delta`` holds what set b has and a lacks, the rarest first, then (salted) what a has and b lacks;
    ``size`` counts both, ``adds`` the first.  It is left out for pairs that have little in common.
    """
    nodes = cut_lineage(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    sets = cut_lineage(_sets_of(docs, words, nodes))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                held = np.isin(y, x, assume_unique=True)
                same = int(held.sum())
                size = len(x) + len(y) - 2 * same
                delta = None
                if levels is not None and NEAR * size <= len(x) + len(y):
                    more, less = y[~held], x[~np.isin(x, y, assume_unique=True)]
                    more = more[np.argsort(level_of(levels.value, more), kind="stable")]
                    delta = np.concatenate((more, less ^ _SALT)).tobytes()
                rows.append((len(y), 100 * same >= percent * (len(x) + len(y) - same), size, len(y) - same, delta))
            n, ok, size, adds, delta = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("a"), batch.column("b"), pa.array(n, pa.int64()), pa.array(ok, pa.bool_()), pa.array(size, pa.int64()),
                pa.array(adds, pa.int64()), pa.array(delta, pa.binary())], ["a", "b", "n", "ok", "size", "adds", "delta"])

    # of the first sides, often a few hubs, only their own sets move
    firsts = small(cut_lineage(pairs.select(F.col("a").alias("node")).distinct()))
    hubs = sets.join(firsts, "node", "left_semi").select(F.col("node").alias("a"), F.col("values").alias("x"))
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("values").alias("y")), "b").join(hubs, "a")
    return cut_lineage(both.select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary, n long, ok boolean, size long, adds long, delta binary"))


def _centred(near: DataFrame, percent: int) -> DataFrame:
    """The nodes of each hub that not all nodes are similar to, seen from what most of them have in common.

    ``near`` has hub, node, n, ok, size, adds and delta.  An element in most deltas of a hub moves to the
    hub's side, which gives the deltas from a common core that need not be a document.  The node nearest to
    the core, ``m``, is compared with the others by their deltas: ``joined`` tells that they are similar.
    A core moves elements that most deltas hold, so it has at most twice as many as an average delta.
    """
    open_ = near.join(near.filter("NOT ok").select("hub").distinct(), "hub", "left_semi")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for batch in by_bytes(part, "delta"):
                tokens = [np.frombuffer(d, np.int64) for d in batch.column("delta").to_pylist()]
                size = np.array([len(d) for d in tokens])
                of = np.repeat(np.arange(len(tokens)), size)
                at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                added = at < batch.column("adds").to_numpy(zero_copy_only=False)[of]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(added), batch.column("hub").take(pa.array(of))],
                                                 ["token", "added", "hub"])

    held = open_.select("hub", "adds", "delta").mapInArrow(unpack, "token long, added boolean, hub binary").groupBy("hub", "token", "added").agg(
        F.count(F.lit(1)).alias("k"))
    most = held.join(open_.groupBy("hub").agg(F.count(F.lit(1)).alias("nodes")), "hub").filter("nodes > 2 AND 2 * k > nodes")
    core = most.groupBy("hub").agg(F.collect_list(F.when(F.col("added"), F.col("token"))).alias("more"),
                                   F.collect_list(F.when(~F.col("added"), F.col("token"))).alias("less"))

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, adds, deltas = [], [], []
            for d, a, more, less in zip(*[batch.column(c).to_pylist() for c in ("delta", "adds", "more", "less")], strict=True):
                d = np.frombuffer(d, np.uint64)
                own, lacks = d[:a], d[a:]
                more, less = (np.array(t or [], np.int64).view(np.uint64) for t in (more, less))
                plus = np.concatenate((own[~np.isin(own, more)], less[~np.isin(less, lacks)] ^ _SALT))
                minus = np.concatenate((lacks[~np.isin(lacks, less)], more[~np.isin(more, own)] ^ _SALT))
                sizes.append(len(plus) + len(minus))
                adds.append(len(plus))
                deltas.append(np.concatenate((plus, minus)).tobytes())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("hub", "node", "n")], pa.array(sizes, pa.int64()), pa.array(adds, pa.int64()),
                pa.array(deltas, pa.binary())], ["hub", "node", "n", "size", "adds", "delta"])

    moved = cut_lineage(open_.select("hub", "node", "n", "adds", "delta").join(core, "hub", "left").select(
        "hub", "node", "n", "adds", "delta", "more", "less").mapInArrow(centre, "hub binary, node binary, n long, size long, adds long, delta binary"))
    lead = f"{100 + percent} * size - {100 - percent} * n"
    middle = moved.groupBy("hub").agg(F.min_by(F.struct("node", "n", "size", "delta"), F.struct(F.expr(lead), "node")).alias("m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = []
            for x, y, n, m in zip(*[batch.column(c).to_pylist() for c in ("delta", "delta_m", "n", "n_m")], strict=True):
                differ = len(np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                joined.append((100 + percent) * differ <= (100 - percent) * (n + m))
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in ("hub", "node", "n", "size", "adds", "delta", "m", "n_m", "size_m")], pa.array(joined, pa.bool_())],
                ["hub", "node", "n", "size", "adds", "delta", "m", "n_m", "size_m", "joined"])

    return cut_lineage(moved.join(middle, "hub").select(
        "hub", "node", "n", "size", "adds", "delta", F.col("m.delta").alias("delta_m"), F.col("m.n").alias("n_m"), F.col("m.size").alias("size_m"),
        F.col("m.node").alias("m")).mapInArrow(
        compare, "hub binary, node binary, n long, size long, adds long, delta binary, m binary, n_m long, size_m long, joined boolean"))


def _around_hubs(near: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of two nodes of one hub that may be similar though they are not both joined to its middle m.

    ``near`` has the columns of :func:`_centred` and component c.  Two sets differ in the elements that are in
    just one of their deltas.  With c = (100 - percent) / (100 + percent), similar sets differ in at most
    c times both sizes; y, not joined to m, has size + size_m > c (n + n_m), so x shares more than half of
    (size - c n) - (size_m - c n_m) with y's delta, a number that is never negative as m has the least.
    One of x's first elements, the rarest, is thus in y's delta: nodes are not paired through the core.

    Elements of the core that both lack are shared by many.  Two sets that share nothing the core lacks
    differ in adds + adds + |lacks - lacks| elements at least, so such an element opens a pair only if
    that is few enough; all other pairs share a rare element.
    """
    def unpack(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                for batch in by_bytes(part, "delta"):
                    tokens = [np.frombuffer(d, np.int64) for d in batch.column("delta").to_pylist()]
                    if not whole:
                        n, size, n_m, size_m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "size", "n_m", "size_m"))
                        least = ((100 + percent) * (size - size_m) - (100 - percent) * (n - n_m)) // (2 * (100 + percent)) + 1
                        tokens = [d[:max(0, len(d) - k + 1)] for d, k in zip(tokens, np.maximum(1, least).tolist(), strict=True)]
                    size = np.array([len(d) for d in tokens])
                    of = np.repeat(np.arange(len(tokens)), size)
                    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                    added = at < batch.column("adds").to_numpy(zero_copy_only=False)[of]
                    of = pa.array(of)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.concatenate(tokens)), pa.array(added), *[batch.column(c).take(of) for c in ("hub", "node", "n", "size", "adds", "c")]],
                        ["token", "added", "hub", "node", "n", "size", "adds", "c"])
        return run

    rows = "token long, added boolean, hub binary, node binary, n long, size long, adds long, c binary"
    pick = ("hub", "node", "n", "size", "adds", "c", "delta", "n_m", "size_m")
    x = near.filter("size > 0").select(*pick).mapInArrow(unpack(False), rows)
    y = near.filter("NOT joined").select(*pick).mapInArrow(unpack(True), rows)
    close = (f"x.hub = y.hub AND x.token = y.token AND x.c <> y.c AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND "
             f"{100 + percent} * abs(x.size - y.size) <= {100 - percent} * (x.n + y.n) AND (x.added OR {100 + percent} * "
             f"(x.adds + y.adds + abs(x.size - x.adds - y.size + y.adds)) <= {100 - percent} * (x.n + y.n))")
    return x.alias("x").join(y.alias("y"), F.expr(close)).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _close(percent: int) -> str:
    """SQL: rows x and y of one bucket may be similar by their sizes and the bucket's places in their orders."""
    least = f"ceil({percent} * (x.n + y.n) / {100 + percent}.0D)"
    return (f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND "
            f"least(x.n - x.at, y.n - y.at) >= {least}")


def _maps_close(percent: int) -> str:
    """SQL: rows x and y may be similar by their bit maps.  A bit that is in one of them stands for an element that is in one set only."""
    apart = "aggregate(zip_with(x.bits, y.bits, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return f"{100 + percent} * {apart} <= {100 - percent} * (x.n + y.n)"


def similar_classes(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (see ``_classes``)."""
    named, found = _classes(docs, words, percent)
    return _labelled(named, found).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _named(docs: DataFrame, words: int) -> DataFrame:
    """Every document's set: doc_id, _hash (of its text), node (the set's digest, null for an empty set), n."""
    def rows(batch, sets):
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("_hash"), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
            pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "_hash", "node", "n"])

    own = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("_hash")
    return cut_lineage(_per_document(docs, words, rows, "doc_id long, _hash long, node binary, n long", own))


def _labelled(named: DataFrame, found: DataFrame) -> DataFrame:
    """``named`` with the smallest doc_id of each component; an empty set is its own document's."""
    rooted = named.filter("node is not null").join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(lowest, "root").select("doc_id", "_hash", "n", "component_id").union(
        named.filter("node is null").select("doc_id", "_hash", "n", F.col("doc_id").alias("component_id")))


def _classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The documents' sets, and the components of sets that are similar to at least ``percent``.

    A text's set holds its distinct ``words``-word shingles (A-Z lower-cased, as 64-bit hashes); shorter
    texts are one shingle, empty and null ones link with nothing.  Repeated rows have equal sets.

    1. Equal sets are one node.  A node's prefix is its first shingles in an order that puts frequent ones last.
    2. Nodes with one prefix and size form a group; only groups' prefixes are spread into buckets.
    3. In every bucket groups are compared with its hub, the one with the fewest rare shingles, in every group
       members with one of them.  This joins the great groups of copies without pairing their members.
    4. Nodes of one hub that are of different components are paired by what they differ in from their common core.
    5. Buckets that still hold several components of different hubs are expanded to members; pairs that
       sizes, places and bit maps allow are verified.  Pairs within a component would change nothing.
    """
    spark = docs.sparkSession
    named = _named(docs, words)
    levels = spark.sparkContext.broadcast(_frequent(docs, words, percent))  # a table of fixed size

    def prefixes(batch, sets):
        out = []
        for values in sets:
            if len(values):
                level, first = level_of(levels.value, values), _prefix(len(values), percent)
                order = np.argsort(level, kind="stable")[:first]
                rare = int(1000 * (level[:ZONE * first] == 0).mean())
                out.append((_digest(values), len(values), values[order].tobytes(), rare, _bit_map(values)))
        if not out:
            return None
        node, n, first, rare, bits = zip(*out, strict=True)
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * MAP_WORDS), pa.array(np.concatenate(bits)))
        return pa.RecordBatch.from_arrays([
            pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.binary()), pa.array(rare, pa.int32()), bits],
            ["node", "n", "prefix", "rare", "bits"])

    nodes = _per_document(docs, words, prefixes, "node binary, n long, prefix binary, rare int, bits array<long>").groupBy("node").agg(
        F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("rare").alias("rare"), F.first("bits").alias("bits"))
    nodes = cut_lineage(nodes.withColumn("prefix_name", F.md5(F.concat(F.col("prefix"), F.col("n").cast("string").cast("binary")))))
    groups = cut_lineage(nodes.groupBy("prefix_name").agg(
        F.min(F.struct("rare", "node")).alias("centre"), F.count(F.lit(1)).alias("members"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix")).select("prefix_name", "members", "n", "prefix", F.col("centre.rare").alias("rare"), F.col("centre.node").alias("g")))
    # shingles that are in one prefix only open no bucket
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    again = spark.sparkContext.broadcast(counted_levels(groups.select("prefix").mapInArrow(_packed(ranges), "range int, keys binary"), ranges, (2,)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "prefix"):
                firsts = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
                size = np.array([len(f) for f in firsts])
                of = np.repeat(np.arange(len(size)), size)
                at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                tokens = np.concatenate(firsts)
                some = np.flatnonzero(level_of(again.value, tokens))
                of = pa.array(of[some])
                yield pa.RecordBatch.from_arrays([
                    pa.array(tokens[some].view(np.int64)), *[batch.column(c).take(of) for c in ("g", "n", "rare")],
                    pa.array(at[some].astype(np.int32))], ["bucket", "g", "n", "rare", "at"])

    rows = cut_lineage(groups.select("g", "n", "rare", "prefix").mapInArrow(spread, "bucket long, g binary, n long, rare int, at int"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("rare", "g", "n", "at")).alias("hub")).filter("k > 1")
    shared = cut_lineage(rows.join(shared, "bucket").select("bucket", "g", "n", "at", "hub"))
    stars = shared.select("g", "n", "at", "hub").filter("g <> hub.g").filter(_close(percent).replace("x.", "").replace("y.", "hub."))
    stars = stars.select(F.col("hub.g").alias("a"), F.col("g").alias("b"), F.col("hub.rare").alias("rare"))
    members = cut_lineage(nodes.join(groups.filter("members > 1").select("prefix_name", "g", F.col("rare").alias("centre")), "prefix_name").select(
        "node", "g", "n", "centre"))
    tried = cut_lineage(stars.union(members.filter("node <> g").select(F.col("g").alias("a"), F.col("node").alias("b"), "centre")).distinct())
    compared = _compared(tried, docs, words, percent, levels)
    # every node belongs to the most central hub that it has much in common with
    near = compared.filter("delta IS NOT NULL").join(tried, ["a", "b"])
    near = cut_lineage(near.groupBy(F.col("b").alias("node")).agg(
        F.min(F.struct("rare", F.col("a").alias("hub"), "n", "ok", "size", "adds", "delta")).alias("m")).select("node", "m.*").drop("rare"))
    centred = _centred(near, percent)
    links = compared.filter("ok").select("a", "b").union(centred.filter("joined AND m <> node").select("m", "node"))
    found = cut_lineage(components(links))
    around = _around_hubs(centred.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), percent)

    # buckets and groups whose members are of several components
    alone = groups.filter("members = 1").select(F.col("g").alias("node"), "g")
    placed = members.select("node", "g").union(alone).join(found, "node", "left").select(
        "node", "g", F.coalesce("component", "node").alias("c"))
    placed = placed.join(near.select("node", "hub"), "node", "left").withColumn("h", F.coalesce("hub", "node")).drop("hub")
    placed = cut_lineage(placed.join(shared.select("g").union(members.select("g")).distinct(), "g", "left_semi"))
    spans = placed.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    open_ = shared.join(spans, "g").groupBy("bucket").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low < high").select("bucket")
    rest = shared.join(open_, "bucket", "left_semi").join(placed, "g").select("bucket", "node", "n", "at", "c", "h")
    split = members.join(spans.filter("low < high").select("g"), "g", "left_semi").join(placed.select("node", "c", "h"), "node").select(
        F.xxhash64("g").alias("bucket"), "node", "n", F.lit(0).alias("at"), "c", "h")
    rest = cut_lineage(rest.union(split).join(nodes.select("node", "bits"), "node"))
    more = rest.alias("x").join(rest.alias("y"), F.expr(f"x.bucket = y.bucket AND x.c < y.c AND x.h <> y.h AND {_close(percent)} AND {_maps_close(percent)}")).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(around).distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = cut_lineage(more.join(done, ["a", "b"], "left_anti"))
    return named, extended(found, _compared(more, docs, words, percent, None).filter("ok").select("a", "b"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay when each class of similar ones keeps one: the smallest doc_id, empty sets all.

    Rows that share the smallest doc_id stay together (repeated rows are for exact dedup), rows without
    doc_id lose to any, and a class without any doc_id stays whole.  Rows are told by id and text, so another
    text with the id of one that goes stays.
    """
    named, found = _classes(docs, words, percent)
    gone = _labelled(named, found).filter("not (doc_id <=> component_id)").select(
        F.col("doc_id").alias("_drop"), F.col("_hash").alias("_dropped")).distinct()
    wrapped = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_own"), F.xxhash64(text_of()).alias("_text"))
    return wrapped.join(gone, F.col("_own").eqNullSafe(F.col("_drop")) & (F.col("_text") == F.col("_dropped")), "left_anti").select("doc.*")
