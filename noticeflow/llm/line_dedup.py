"""Fuzzy line dedup: MinHash bands, exact Jaccard verification, and one line kept per component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import components, discard, extended, stored, text_of
from noticeflow.llm.shingles import _LOWER, _WHITE, by_bytes, mix64, range_hashes, raw_bytes
from noticeflow.llm.tables import bit_tables, counted_levels, level_of, ranges_of
from noticeflow.session import cut_lineage, scratch_path

CHARS = 8             # characters of a shingle
PERCENT = 80          # Jaccard similarity from which lines are linked
BANDS, BAND = 12, 4   # a pair at 0.8 shares a band with probability 0.998
LEAST_CHARS = 1       # shorter lines, blank ones, always stay
BAND_CHARS = 10       # shorter lines are compared exactly only, without bands
_NEWLINE = 10
_MARK = 20            # bits of a band key that tell the line, when lines with the key are counted
_BINS = BANDS * BAND
_WORDS = 32           # of 64 bits, in the bit map of a line's shingles


class Lines:
    """The lines of some texts, normalised: A-Z lower-cased, white space runs one space, ends trimmed.

    ``text`` and ``number`` tell each line's text and its place there (from 0); a text has one line more
    than it has line feeds.
    """

    def __init__(self, texts: pa.Array):
        data, bounds = raw_bytes(texts)
        feeds = np.flatnonzero(data == _NEWLINE)
        starts = np.sort(np.concatenate((bounds[:-1], feeds + 1)), kind="stable")
        count = np.diff(np.searchsorted(feeds, bounds)) + 1
        self.text = np.repeat(np.arange(len(texts)), count)
        self.number = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
        white = _WHITE[data]
        first = np.zeros(len(data) + 1, bool)
        first[starts] = True
        # a white byte stays, as a space, if it follows a word of its line; a line's last one goes at the end
        ends = np.append(starts[1:], len(data))
        keep = ~white
        keep[1:] |= ~white[:-1] & ~first[1:-1]
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        self.data = np.where(white, np.uint8(32), _LOWER[data])[keep]
        self.starts, self.ends = place[starts], place[ends]
        trailing = (self.ends > self.starts) & (np.append(self.data, 0)[self.ends - 1] == 32)
        self.ends = self.ends - trailing
        lead = (self.data & 0xC0) != 0x80
        self.chars = np.flatnonzero(lead)
        self.first = np.searchsorted(self.chars, self.starts)
        self.last = np.searchsorted(self.chars, self.ends)

    def names(self) -> np.ndarray:
        """Two independent 64-bit hashes of every line."""
        return np.column_stack([range_hashes(self.data, self.starts, self.ends, other) for other in (False, True)])

    def long_enough(self) -> np.ndarray:
        return self.last - self.first >= LEAST_CHARS

    def banded(self) -> np.ndarray:
        return self.last - self.first >= BAND_CHARS

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def shingles(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the character shingles of the lines ``of``, and the line of each."""
        count = np.maximum(1, self.last[of] - self.first[of] - CHARS + 1)
        owner = np.repeat(np.arange(len(of)), count)
        at = np.repeat(self.first[of] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        bounds = np.append(self.chars, len(self.data))
        start = bounds[np.minimum(at, len(bounds) - 1)]
        end = bounds[np.minimum(at + CHARS, self.last[of][owner])]
        return range_hashes(self.data, start, np.maximum(start, end)), owner

    def bands(self, of: np.ndarray) -> np.ndarray:
        """A key per band of the MinHash signature, by one permutation: the smallest hash of every bin."""
        hashes, owner = self.shingles(of)
        # the lower half of a hash picks the bin, the whole is the value
        bin_ = (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(_BINS) >> np.uint64(32)
        least = np.full(len(of) * _BINS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, owner * _BINS + bin_.view(np.int64), hashes)
        least = least.reshape(len(of), _BINS)
        empty = np.iinfo(np.uint64).max
        # an empty bin takes the next one's value, marked with the distance
        for _ in range(_BINS):
            hole = least == empty
            if not hole.any():
                break
            taken = np.roll(least, -1, axis=1)
            least = np.where(hole & (taken != empty), mix64(taken + np.uint64(1)), least)
        key = np.zeros((len(of), BANDS), np.uint64)
        rows = least.reshape(len(of), BANDS, BAND)
        for i in range(BAND):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
        return mix64(key + np.arange(BANDS, dtype=np.uint64))


def _each(docs: DataFrame, rows, schema: str, columns: tuple[Column, ...] = ()) -> DataFrame:
    """Apply ``rows(batch, lines)`` (an Arrow batch or None) to documents in parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "_text"):
                out = rows(batch, Lines(batch.column("_text")))
                if out is not None and out.num_rows:
                    yield out

    return docs.select(*columns, text_of().alias("_text")).mapInArrow(run, schema)


def _node(names: np.ndarray) -> pa.Array:
    return pa.array([n.tobytes() for n in names], pa.binary())


def _halves(nodes: pa.Array) -> np.ndarray:
    """The first of the two hashes that name each line."""
    return np.frombuffer(b"".join(nodes.to_pylist()), np.uint64).reshape(-1, 2)[:, 0]


def _signed(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, times, keys) of the lines of each part of the documents: how often it occurs, and its band keys (short lines: none)."""
    def rows(batch, lines):
        of = np.flatnonzero(lines.long_enough())
        names = lines.names()
        _, at, times = np.unique(names[of, 0], return_index=True, return_counts=True)
        of = of[at]
        keys, banded = np.full(len(of), b"", object), lines.banded()[of]
        keys[banded] = [k.tobytes() for k in lines.bands(of[banded])]
        return pa.RecordBatch.from_arrays([_node(names[of]), pa.array(times.astype(np.int32)), pa.array(keys, pa.binary())],
                                          ["node", "times", "keys"])

    return stored(_each(docs, rows, "node binary, times int, keys binary"), "signatures", folder)


def _counted(signed: DataFrame, rows, marked: int = 0) -> np.ndarray:
    """A bit table of the keys that ``rows(batch)`` gives twice or more."""
    ranges = max(1, int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ranges_of(rows(batch), ranges)
            if out is not None:
                yield out

    return counted_levels(signed.mapInArrow(run, "range int, keys binary"), ranges, (2,), marked)


def _with_bands(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.filter(pc.greater(pc.binary_length(batch.column("keys")), 0))


def _bands_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("keys").to_pylist()), np.uint64).reshape(-1, BANDS)


def _with_line(batch: pa.RecordBatch) -> np.ndarray:
    """Band keys, their lowest bits replaced by a line's own."""
    low = np.uint64((1 << _MARK) - 1)
    batch = _with_bands(batch)
    return ((_bands_of(batch) & ~low) | (_halves(batch.column("node")) & low)[:, None]).ravel()


def _twice(batch: pa.RecordBatch) -> np.ndarray:
    return np.repeat(_halves(batch.column("node")), np.minimum(2, batch.column("times").to_numpy(zero_copy_only=False)))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those (a, b) whose lines' shingle sets have a Jaccard similarity of PERCENT or more."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "x"):
                sets = []
                for side in ("x", "y"):
                    lines = Lines(batch.column(side).cast(pa.large_binary()).cast(pa.large_string()))
                    hashes, owner = lines.shingles(np.arange(batch.num_rows))
                    cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                    sets.append([np.unique(hashes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
                keep = []
                for x, y in zip(*sets, strict=True):
                    same = int(np.isin(x, y, assume_unique=True).sum())
                    keep.append(100 * same >= PERCENT * (len(x) + len(y) - same))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a binary, b binary")


def _key(node: str) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 7)), 16, 10).cast("long").alias("key")


def _occurrences(docs: DataFrame, repeated: np.ndarray, shared: DataFrame) -> DataFrame:
    """(_id, _hash, number, node, line): where repeated lines and those of a shared band occur.

    ``line`` is the normalised text of the latter, once in each part of the documents.
    """
    candidates = bit_tables(shared.select(_key("node"), F.lit(1).alias("level")), 1)
    both = docs.sparkSession.sparkContext.broadcast((repeated, candidates))  # tables of fixed size

    def rows(batch, lines):
        again, banded = both.value
        of, names = np.flatnonzero(lines.long_enough()), lines.names()
        head = names[of, 0]
        known = level_of(banded, head.byteswap() >> np.uint64(8)) > 0
        pick = known | (level_of(again, head) > 0)
        of, head, known = of[pick], head[pick], known[pick]
        _, first = np.unique(head, return_index=True)
        with_text = np.zeros(len(of), bool)
        with_text[first] = True
        with_text &= known
        text = pa.array(lines.text[of])
        return pa.RecordBatch.from_arrays([
            batch.column("_id").take(text), batch.column("_hash").take(text), pa.array(lines.number[of].astype(np.int32)), _node(names[of]),
            pa.array([lines.raw(i) if t else None for i, t in zip(of.tolist(), with_text.tolist(), strict=True)], pa.binary())],
            ["_id", "_hash", "number", "node", "line"])

    return stored(_each(docs, rows, "_id long, _hash long, number int, node binary, line binary", _document()), "line-occurrences")


def _shingled(rest: DataFrame, rows, schema: str) -> DataFrame:
    """Apply ``rows(batch, sets)`` (an Arrow batch or None) to lines (node, line) in parts, with their shingle sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "line"):
                lines = Lines(batch.column("line").cast(pa.large_binary()).cast(pa.large_string()))
                hashes, owner = lines.shingles(np.arange(batch.num_rows))
                cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
                out = rows(batch, [np.unique(hashes[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
                if out is not None:
                    yield out

    return rest.mapInArrow(run, schema)


def _outlines(rest: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, n, u, bits): the size of each line's shingle set, how many of it another line may have, and a bit map of these."""
    spark = rest.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = _shingled(rest, lambda batch, sets: ranges_of(np.concatenate(sets), ranges), "range int, keys binary")
    again = spark.sparkContext.broadcast(counted_levels(counts, ranges, (2,)))  # a table of fixed size

    def rows(batch, sets):
        known = [x[level_of(again.value, x) > 0] for x in sets]
        words = np.zeros((len(sets), _WORDS), np.uint64)
        for row, x in zip(words, known, strict=True):
            at = x >> np.uint64(32)  # the lower half has picked the bit of the table
            np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64) % _WORDS, np.uint64(1) << (at & np.uint64(63)))
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * _WORDS), pa.array(words.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([
            batch.column("node"), pa.array([len(x) for x in sets], pa.int32()), pa.array([len(x) for x in known], pa.int32()), bits],
            ["node", "n", "u", "bits"])

    return stored(_shingled(rest, rows, "node binary, n int, u int, bits array<long>"), "line-outlines", folder)


def _close() -> str:
    """SQL: lines x and y may be similar by their outlines.

    What is in x's bit map and not in y's is in one of the sets only, so both have at most u less that many in common.
    """
    apart = "aggregate(zip_with({0}.bits, {1}.bits, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v)"
    need = f"{PERCENT} * (x.n + y.n)"
    return (f"x.c <> y.c AND {100 + PERCENT} * least(x.u, y.u) >= {need} AND {100 + PERCENT} * (x.u - {apart.format('x', 'y')}) >= {need} "
            f"AND {100 + PERCENT} * (y.u - {apart.format('y', 'x')}) >= {need}")


def _line_components(shared: DataFrame, seen: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, component) of the lines that are similar to another one.

    Lines that share a band are verified against the most frequent of the band.  Bands that then still hold several
    components, as those of lines that only have a passage in common, are joined to the line with the least
    shingles no other has, then paired across components; pairs whose outlines show that they have too little in
    common are not made.  So a great group of near copies is joined by one comparison a line, and no pair of a band
    that could join two components is left out.
    """
    texts = stored(seen.filter("line IS NOT NULL").groupBy("node").agg(F.first("line").alias("line")), "line-texts", folder)
    tried = stored(shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "line-pairs", folder)
    found = cut_lineage(components(stored(_verified(tried, texts), "line-links", folder)))

    def across(rows: DataFrame, found: DataFrame) -> DataFrame:
        """The rows of bands whose lines are of several components c."""
        placed = rows.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        mixed = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("bucket")
        return placed.join(mixed, "bucket", "left_semi")

    rest = stored(across(shared.select("bucket", "node"), found), "line-rest", folder)
    outlines = _outlines(texts.join(rest.select("node").distinct(), "node", "left_semi"), folder)
    rest = stored(rest.join(outlines, "node"), "line-rows", folder)
    middle = rest.groupBy("bucket").agg(F.min(F.struct((F.col("n") - F.col("u")).alias("own"), "node", "n", "u", "bits", "c")).alias("y"))
    pair = F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    stars = rest.alias("x").join(middle, "bucket").filter(_close()).select(*pair).distinct()
    found = cut_lineage(extended(found, stored(_verified(stars, texts), "line-links", folder)))
    left = stored(across(rest.drop("c"), found), "line-across", folder)
    more = left.alias("x").join(left.alias("y"), F.expr(f"x.bucket = y.bucket AND x.node < y.node AND {_close()}")).select(*pair).distinct()
    return cut_lineage(extended(found, stored(_verified(more, texts), "line-links", folder)))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(_id, _hash, drop): for each document that loses lines, their numbers; documents are told by id and text."""
    spark = docs.sparkSession
    # tables of the steps before the result are deleted as soon as nothing is read from them any more
    own, work = scratch_path(spark, "line-signatures"), scratch_path(spark, "line-dedup")
    signed = _signed(docs, own)
    table = spark.sparkContext.broadcast(_counted(signed, _with_line, _MARK))

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_with_bands, batches):
            keys = _bands_of(batch)
            line, band = np.nonzero(level_of(table.value, keys.ravel() >> np.uint64(_MARK)).reshape(keys.shape))
            of = pa.array(line)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[line, band].view(np.int64)), batch.column("node").take(of), batch.column("times").take(of)], ["bucket", "node", "times"])

    rows = signed.mapInArrow(banded, "bucket long, node binary, times int").groupBy("bucket", "node").agg(F.sum("times").alias("times"))
    rows = stored(rows, "bands", work)
    # the line of a band that occurs most often is the one most likely to be the others' origin
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("times", "node")).alias("most"), F.min("node").alias("low"), F.max("node").alias("high")).filter(
        "low < high").select("bucket", F.col("most.node").alias("hub"))
    rows = rows.drop("times")
    shared = stored(rows.join(hubs, "bucket"), "shared-bands", work)
    repeated = _counted(signed, _twice)
    discard(spark, own)
    seen = _occurrences(docs, repeated, shared)
    found = _line_components(shared, seen, work)
    discard(spark, work)
    rooted = seen.drop("line").distinct().join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_hash", "number"))
    keepers = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("k"), first.alias("keep")).filter("k > 1").drop("k")
    lost = rooted.join(keepers, "root").filter(
        ~(F.col("_id").eqNullSafe(F.col("keep._id")) & (F.col("_hash") == F.col("keep._hash")) & (F.col("number") == F.col("keep.number"))))
    # the numbers of one document's lines
    return lost.groupBy("_id", "_hash").agg(F.collect_list("number").alias("drop"))


def _document() -> tuple[Column, Column]:
    return F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text_of()).alias("_hash")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Each document as the struct ``doc`` with its remaining text, n_lines and n_dropped.

    Two lines are similar when the sets of their CHARS-character shingles have a Jaccard similarity of
    PERCENT or more; those with under BAND_CHARS characters only when they are equal.  Of every component of
    similar lines the first stays: smallest doc_id (null last), then text hash, then line number.  Blank lines
    always stay.  A null text stays
    null, an empty one has one empty line; repeated rows (same id and text) share their fate.
    """
    lost = dropped_lines(docs)
    keyed = docs.select(F.struct("*").alias("doc"), *[c.alias(f"_own{n}") for c, n in zip(_document(), ("_id", "_hash"), strict=True)])
    joined = keyed.join(lost, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), "left")
    lines = F.split(text_of("doc.text"), "\n", -1)  # the text moves once, in doc
    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda s: ~F.array_contains(F.col("drop"), s["i"])), lambda s: s["x"]), "\n")
    return joined.select(
        "doc", F.when(F.col("drop").isNull(), F.col("doc.text")).otherwise(kept).alias("text"), F.size(lines).alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("n_dropped"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their remaining text and its length; those left without any text by it go."""
    left = dedup_lines(docs).filter(r"n_dropped = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    own = {"text": F.col("text"), "n_chars": F.length(F.coalesce("text", F.lit(""))).cast("long")}
    return left.select(*[own.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def deduped_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the remaining text of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", "text")
