"""Language-model scores: a probabilistic suffix tree over words, counted and looked up by shuffles.

A state of the tree is a context of zero, one or two words.  Contexts are the ones that hold a share
``SHARE`` of all training tokens, so there are at most ``1 / SHARE`` of each length (and twice that many
candidates), however large the corpus is; those tables are broadcast.  What grows without a bound, how
often every word follows every context, is never gathered: words travel in packed, sorted runs to the task
that counts and scores them.  A word, or a word after a context, that has a share of ``SHARE`` by itself
is in a broadcast table too and need not travel, so no task receives more than that share for one key.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import text_of
from noticeflow.llm.shingles import by_bytes, mix64, word_hashes
from noticeflow.session import cut_lineage

SHARE = 2.0 ** -15
STRENGTHS = (16.0, 128.0, 1024.0)   # of a parent's distribution, in occurrences; each state takes its best
PARENT = 1                          # the strength that stands for a parent in the test of its children
DIVERGENCE = 0.02                   # nats an occurrence that a state has to tell more than its parent
ALPHA = 0.1                         # added to every word's count, and to one unknown word
BLOCK = 1 << 21                     # tokens that a task sorts at once
RANGE = 3 << 20                     # tokens that a task counts at once
PIECE = 1 << 23                     # longer texts are read in pieces of so many bytes

START, NONE, END = (np.uint64(x) for x in (0x51A7_0000_0000_0001, 0x51A7_0000_0000_0002, 0x51A7_0000_0000_0003))
_MULTIPLE = np.uint64(0x9E3779B97F4A7C15)
_WHITES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")

_RUN = "range int, block long, kind int, data binary"
_ROWS, _SUMS = 0, 1                 # kinds of runs: documents of a block, sums or events of its documents
_EVENTS = ("<u8", "<u4", "<u4", "<u4")
_PARTS = ("<u4", "<f8", "<u4", "<f8")
_DOCS = ("<i8", "<i8", "u1", "u1", "<i8", "<i8", "<f8", "<f8")
_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length as one value; bytes of equal weight lie together, so that they compress."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return zstd.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = np.frombuffer(zstd.ZstdDecompressor().decompress(data), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at:at + n * s].reshape(s, n).T).view(k).ravel())
        at += n * s
    return out


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in a sorted table, -1 if it does not."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def sums(order: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values[order]`` over the groups that begin at ``first``."""
    return np.add.reduceat(values[order], first) if len(first) else np.zeros(0, values.dtype)


@dataclass
class Tree:
    """Tables of bounded size: frequent words, contexts, and frequent words after contexts."""

    tokens: int = 0                 # N and V of the training texts
    words: int = 0
    ranges: int = 1
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))    # words, sorted
    heavy_n: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    one: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))      # contexts of one word, sorted
    two: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))      # of two: codes of ids, sorted
    count: list = field(default_factory=lambda: [np.zeros(1), np.zeros(1)])      # by length and id (from 1)
    strength: list = field(default_factory=lambda: [np.zeros(1), np.zeros(1)])
    kept: list = field(default_factory=lambda: [np.zeros(1, bool), np.zeros(1, bool)])
    after: list = field(default_factory=lambda: [np.zeros(0, np.uint64), np.zeros(0, np.uint64)])   # codes of (heavy word, context id)
    after_n: list = field(default_factory=lambda: [np.zeros(0, np.int64), np.zeros(0, np.int64)])

    def contexts(self, before: np.ndarray, before_that: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (0: none) of the contexts of one and two words."""
        a, b = find(self.one, before) + 1, find(self.one, before_that) + 1
        pair = find(self.two, code(b, a)) + 1
        return a.astype(np.uint32), np.where((a > 0) & (b > 0), pair, 0).astype(np.uint32)

    def root(self, count: np.ndarray) -> np.ndarray:
        return (count + ALPHA) / (self.tokens + ALPHA * (self.words + 1))

    def step(self, length: int, parent: np.ndarray, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """A state's probability from its parent's; without a state (id 0) it stays."""
        mu, n = self.strength[length - 1][ids], self.count[length - 1][ids]
        return np.where(ids > 0, (count + mu * parent) / np.maximum(n + mu, 1), parent)


def code(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, bool, bool]]:
    """Rows with their texts, whether the first continues a text, and whether the last goes on."""
    for part in by_bytes(batch, "text"):
        texts = part.column("text")
        if part.num_rows > 1 or texts.nbytes <= PIECE:
            yield part, texts, False, False
            continue
        raw, at = texts[0].as_py().encode(), 0
        while True:
            end = at + PIECE
            if end < len(raw):   # cut at white space
                last = max(raw.rfind(w, at, end) for w in _WHITES)
                end = last if last > at else min((x for w in _WHITES if (x := raw.find(w, end)) >= 0), default=len(raw))
            yield part, pa.array([raw[at:end].decode()]), at > 0, end < len(raw)
            if end >= len(raw):
                break
            at = end


@dataclass
class Block:
    """Tokens of some documents in a row, with the two before each; a document ends in END."""

    number: int
    docs: pa.Table
    token: np.ndarray
    before: np.ndarray
    before_that: np.ndarray
    doc: np.ndarray     # row of ``docs``
    train: np.ndarray   # of every token


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """A task's documents (doc_id, held_out, text) in blocks of about BLOCK tokens; a longer text is split."""
    first_number = TaskContext.get().partitionId() << 32
    number, rows, parts, size, carry, goes_on = 0, [], [], 0, (NONE, NONE), False

    def made() -> Block:
        docs = pa.Table.from_batches(rows).select(["row", "doc_id", "held_out"])
        token, before, before_that, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        held = docs.column("held_out").to_numpy()
        return Block(first_number + number, docs, token, before, before_that, doc, ~held[doc])

    n_docs = 0
    for batch in batches:
        for part, texts, continued, open_end in pieces(batch):
            word, first = word_hashes(texts)
            if not continued:
                rows.append(part)
                n_docs += part.num_rows
            count = np.diff(first)
            ends = np.ones(len(texts), np.int64)
            ends[-1] -= open_end
            begin = np.cumsum(count + ends) - (count + ends)
            token = np.full(int((count + ends).sum()), END, np.uint64)
            token[np.arange(len(word)) + np.repeat(np.cumsum(ends) - ends, count)] = word
            before, before_that = np.empty_like(token), np.empty_like(token)
            before[1:], before_that[2:] = token[:-1], token[:-2]
            before[:1], before_that[:1], before_that[1:2] = carry[0], carry[1], carry[0]
            fresh = begin[int(continued):]
            fresh = fresh[fresh < len(token)]
            before[fresh], before_that[fresh] = START, NONE
            second = fresh + 1
            second = second[second < len(token)]
            second = second[before[second] != START]
            before_that[second] = START
            carry = (token[-1], before[-1]) if len(token) else carry if continued else (START, NONE)
            parts.append((token, before, before_that, (n_docs - len(texts) + np.repeat(np.arange(len(texts)), count + ends)).astype(np.uint32)))
            size += len(token)
            goes_on = open_end
            if size >= BLOCK:
                yield made()
                last = part.slice(part.num_rows - 1)
                number, rows, parts, size, n_docs = number + 1, [last] if goes_on else [], [], 0, int(goes_on)
    if rows:
        yield made()


def sent(number: int, ranges: int, route: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Events in order of their routing key, one packed row for each range of keys."""
    order = np.argsort(route, kind="stable")
    route, columns = route[order], [c[order] for c in columns]
    low = (np.arange(ranges, dtype=np.float64) * (2.0**64 / ranges)).astype(np.uint64)
    cuts = np.append(np.searchsorted(route, low), len(route))
    some = np.flatnonzero(np.diff(cuts))
    data = [pack(*(c[cuts[r]:cuts[r + 1]] for c in columns)) for r in some]
    return run_batch(some, number, _SUMS, data)


def run_batch(ranges, number: int, kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ranges, pa.int32()), pa.array([number] * len(data), pa.int64()), pa.array([kind] * len(data), pa.int32()),
         pa.array(data, pa.binary())], ["range", "block", "kind", "data"])


def gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of every key of a partition, in an order that does not depend on their arrival."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("range", "block", "kind", "data")), strict=True):
            held.setdefault(row[0 if key == "range" else 1], []).append(row)
    while held:
        at, rows = held.popitem()
        yield at, sorted(rows, key=lambda r: (r[2], r[0], r[1]))


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by the keys (first is major), where groups of equal keys begin in it, and the group of every row."""
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    group = np.empty(n, np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group


def routed(tree: Tree, token: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Where a word is counted: by itself, a frequent one with its context."""
    return np.where(find(tree.heavy, token) < 0, mix64(token), mix64(token ^ (one.astype(np.uint64) + np.uint64(1)) * _MULTIPLE))


class Model:
    """Fits the tree in three passes over the texts and scores them in a fourth."""

    def __init__(self, docs: DataFrame, modulus: int = 10, share: float = SHARE):
        self.share = share
        held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0
        self.docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_of().alias("text"))
        self.spark = docs.sparkSession
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tree = Tree(ranges=self.partitions)
        self._words()
        self._candidates()
        self._contexts()

    def _map(self, each: Callable[[Tree, Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        tree = self.spark.sparkContext.broadcast(self.tree)   # of bounded size, see the module's text

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                yield from each(tree.value, block)

        return self.docs.mapInArrow(run, schema)

    def _reduce(self, runs: DataFrame, each: Callable[[Tree, int, list[tuple]], Iterator[pa.RecordBatch]], schema: str, key: str = "range") -> DataFrame:
        tree = self.spark.sparkContext.broadcast(self.tree)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, rows in gathered(batches, key):
                yield from each(tree.value, at, rows)

        moved = runs.repartitionById(self.tree.ranges, "range") if key == "range" else runs.repartition(key)
        return moved.mapInArrow(run, schema)

    def _words(self) -> None:
        """Count every word of the training texts: N, V and the words with a share."""
        share = self.share

        def each(tree: Tree, block: Block) -> Iterator[pa.RecordBatch]:
            token, n = np.unique(block.token[block.train], return_counts=True)
            yield sent(block.number, tree.ranges, mix64(token), [token, n.astype(np.uint32)])
            starts = int((block.before[block.train] == START).sum())
            yield run_batch([block.number % tree.ranges], block.number, _ROWS, [pack(np.array([starts]), np.array([len(block.token)]))])

        def count(tree: Tree, at: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            numbers = [unpack(r[3], ("<i8", "<i8")) for r in rows if r[2] == _ROWS]
            starts, size = (int(sum(x[i][0] for x in numbers)) for i in (0, 1))
            counted = [unpack(r[3], ("<u8", "<u4")) for r in rows if r[2] == _SUMS]
            token, n = (np.concatenate(x) for x in zip(*counted, strict=True)) if counted else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order, first, _ = groups(token)
            n, token = sums(order, first, n.astype(np.int64)), token[order][first]
            often = n >= share * n.sum()   # at least those with a share of all tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(token[often].view(np.int64), 0)), pa.array(np.append(n[often], n.sum())),
                 pa.array([None] * int(often.sum()) + [len(n)], pa.int64()), pa.array([0] * int(often.sum()) + [starts], pa.int64()),
                 pa.array([0] * int(often.sum()) + [size], pa.int64())], ["token", "n", "words", "starts", "size"])

        found = cut_lineage(self._reduce(self._map(each, _RUN), count, "token long, n long, words long, starts long, size long"))
        total = found.filter("words is not null").agg(F.sum("n"), F.sum("words"), F.sum("starts"), F.sum("size")).first()
        tokens, words, starts, size = (x or 0 for x in total)
        heavy = found.filter(F.col("words").isNull() & (F.col("n") >= share * tokens)).orderBy("token").toPandas()   # 1 / share rows at most
        hashes, n = heavy["token"].to_numpy(np.int64).view(np.uint64), heavy["n"].to_numpy(np.int64)
        order = np.argsort(hashes)
        hashes, n = hashes[order], n[order]
        inner = hashes != END
        one = np.append(hashes[inner], START) if starts >= max(1, share * tokens) else hashes[inner]
        self.tree = Tree(tokens=tokens, words=words, ranges=max(self.partitions, math.ceil(size / RANGE)), heavy=hashes, heavy_n=n, one=np.sort(one))

    def _candidates(self) -> None:
        """Contexts of two words that may have a share: merged summaries of each block's frequent pairs.

        A block lowers its counts by the count of its ``2 / share + 1``-th pair, so it hands on so many at
        most; a pair's lowered counts fall short by the sum of these at most, which is half a share.
        """
        most, share = int(2 / self.share), self.share

        def each(tree: Tree, block: Block) -> Iterator[pa.RecordBatch]:
            a, b = (find(tree.one, x[block.train]) + 1 for x in (block.before, block.before_that))
            pair, n = np.unique(code(b, a)[(a > 0) & (b > 0)], return_counts=True)
            less = int(np.partition(n, -most - 1)[-most - 1]) if len(n) > most else 0
            pair, n = pair[n > less], n[n > less] - less
            yield pa.RecordBatch.from_arrays([pa.array(np.append(pair.view(np.int64), -1)), pa.array(np.append(n, less))], ["pair", "n"])

        merged = cut_lineage(self._map(each, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
        short = merged.filter("pair = -1").first()
        floor = max(1, share * self.tree.tokens - (short.n if short else 0))
        pairs = merged.filter((F.col("pair") >= 0) & (F.col("n") >= floor)).select("pair").toPandas()   # 2 / share rows at most
        self.tree.two = np.sort(pairs["pair"].to_numpy(np.int64).view(np.uint64))

    def _contexts(self) -> None:
        """Keep the contexts whose next words diverge from their parent's.

        Every occurrence is predicted from the others (leave one out) and from the parent; a state is kept
        if it gains DIVERGENCE or more nats an occurrence, and with it its suffix.
        """
        share = self.share
        gains = [f"g{i}" for i in range(len(STRENGTHS))]
        schema = "length int, id long, token long, n long, " + ", ".join(f"{g} double" for g in gains)

        def each(tree: Tree, block: Block) -> Iterator[pa.RecordBatch]:
            one, two = tree.contexts(block.before[block.train], block.before_that[block.train])
            token = block.token[block.train]
            use = (one > 0) | (find(tree.heavy, token) < 0)
            token, one, two = token[use], one[use], two[use]
            order, first, _ = groups(token, code(one, two))
            n = np.diff(np.append(first, len(order))).astype(np.uint32)
            token, one, two = (x[order][first] for x in (token, one, two))
            yield sent(block.number, tree.ranges, routed(tree, token, one), [token, one, two, n])

        def count(tree: Tree, at: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            token, one, two, n = (np.concatenate(x) for x in zip(*(unpack(r[3], _EVENTS) for r in rows), strict=True))
            n = n.astype(np.int64)
            order, first, group = groups(token)
            heavy = find(tree.heavy, token)
            total = np.where(heavy >= 0, tree.heavy_n[heavy] if len(tree.heavy) else 0, sums(order, first, n)[group])
            parent = total / tree.tokens
            for length, ids in ((1, one), (2, two)):
                order, first, group = groups(token, ids)
                c = sums(order, first, n)
                who, where, above, word = ids[order][first], order[first], parent[order][first], token[order][first]
                some = who > 0
                c, who, above, word = c[some], who[some], above[some], word[some]
                gain = [np.bincount(who, c * np.log((c - 1 + mu * above) / above), minlength=1) for mu in STRENGTHS]
                ids_here = np.flatnonzero(np.bincount(who, minlength=1))
                n_here = np.bincount(who, c, minlength=1)[ids_here].astype(np.int64)
                often = c >= share * tree.tokens
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids_here) + often.sum(), length, np.int32)), pa.array(np.concatenate((ids_here, who[often])).astype(np.int64)),
                    pa.array([None] * len(ids_here) + word[often].view(np.int64).tolist(), pa.int64()), pa.array(np.concatenate((n_here, c[often]))),
                    *(pa.array(np.concatenate((g[ids_here], np.zeros(often.sum())))) for g in gain)], ["length", "id", "token", "n", *gains])
                parent = tree.step(1, parent, sums(order, first, n)[group], ids) if length == 1 else parent

        tree = self.tree
        at = find(tree.heavy, tree.one)
        tree.count[0] = np.concatenate(([0.0], np.where(at >= 0, tree.heavy_n[at] if len(tree.heavy) else 0, 0).astype(float)))
        begins = find(tree.heavy, np.array([END]))[0]   # a document starts as often as one ends
        tree.count[0][1:][tree.one == START] = tree.heavy_n[begins] if begins >= 0 else 0
        tree.strength[0] = np.full(len(tree.one) + 1, STRENGTHS[PARENT])
        found = cut_lineage(self._reduce(self._map(each, _RUN), count, schema))
        for length, known in ((1, tree.one), (2, tree.two)):
            own = found.filter(F.col("length") == length)
            state = own.filter("token is null").groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(g).alias(g) for g in gains)).toPandas()
            count_by, gain = np.zeros(len(known) + 1), np.full((len(known) + 1, len(STRENGTHS)), -np.inf)
            ids, n = state["id"].to_numpy(np.int64), state["n"].to_numpy(float)
            count_by[ids] = n
            for i, (g, mu) in enumerate(zip(gains, STRENGTHS, strict=True)):
                gain[ids, i] = state[g].to_numpy(float) - n * np.log(n - 1 + mu)
            tree.count[length - 1] = count_by
            tree.strength[length - 1] = np.array(STRENGTHS)[gain.argmax(axis=1)]
            tree.kept[length - 1] = (count_by >= max(1, self.share * tree.tokens)) & (gain.max(axis=1) >= DIVERGENCE * count_by)
            pairs = own.filter("token is not null").select("token", "id", "n").toPandas()   # 1 / share rows at most
            key = code(find(tree.heavy, pairs["token"].to_numpy(np.int64).view(np.uint64)), pairs["id"].to_numpy(np.int64))
            order = np.argsort(key)
            tree.after[length - 1], tree.after_n[length - 1] = key[order], pairs["n"].to_numpy(np.int64)[order]
        suffix = (tree.two[tree.kept[1][1:]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        tree.kept[0][suffix] = True

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, base_score, score of every text."""
        def each(tree: Tree, block: Block) -> Iterator[pa.RecordBatch]:
            one, two = tree.contexts(block.before, block.before_that)
            one, two = np.where(tree.kept[0][one], one, 0).astype(np.uint32), np.where(tree.kept[1][two], two, 0).astype(np.uint32)
            word = find(tree.heavy, block.token)
            heavy = word >= 0
            pair = np.where(heavy & (one > 0), find(tree.after[0], code(word, one)), -1)
            triple = np.where(heavy & (two > 0), find(tree.after[1], code(word, two)), -1)
            here = heavy & ((one == 0) | (pair >= 0) & ((two == 0) | (triple >= 0)))
            n_docs = block.docs.num_rows
            p = tree.root(tree.heavy_n[word[heavy]])
            base = np.bincount(block.doc[heavy], np.log10(p), minlength=n_docs)
            for length, ids, after in ((1, one, pair), (2, two, triple)):
                n = tree.after_n[length - 1]
                p = tree.step(length, p, np.where(after[heavy] >= 0, n[after[heavy]] if len(n) else 0, 0), ids[heavy])
            score = np.bincount(block.doc[heavy], np.where(here[heavy], np.log10(p), 0), minlength=n_docs)
            known = np.bincount(block.doc[heavy], minlength=n_docs)
            size = np.bincount(block.doc, minlength=n_docs)
            ids = block.docs.column("doc_id").combine_chunks()
            yield run_batch([block.number % tree.ranges], block.number, _ROWS, [pack(
                block.docs.column("row").to_numpy(), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).view(np.uint8),
                block.docs.column("held_out").to_numpy().view(np.uint8), size, known, base, score)])
            go = ~here
            route = np.where(pair >= 0, mix64(block.token ^ (two.astype(np.uint64) + np.uint64(1 << 40)) * _MULTIPLE), routed(tree, block.token, one))[go]
            yield sent(block.number, tree.ranges, route, [
                block.token[go], one[go], two[go], (block.doc[go] << np.uint32(1)) | block.train[go].astype(np.uint32)])

        def score(tree: Tree, at: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for r in rows:
                if r[2] == _ROWS:
                    yield run_batch([at], r[1], _ROWS, [r[3]])
            events = [r for r in rows if r[2] == _SUMS]
            if not events:
                return
            unpacked = [unpack(r[3], _EVENTS) for r in events]
            which = np.repeat(np.arange(len(events)), [len(u[0]) for u in unpacked])
            token, one, two, doc = (np.concatenate(x) for x in zip(*unpacked, strict=True))
            train, doc = (doc & np.uint32(1)).astype(np.int64), doc >> np.uint32(1)
            word = find(tree.heavy, token)
            order, first, group = groups(token)
            light = word < 0
            n = np.where(light, sums(order, first, train)[group], tree.heavy_n[word] if len(tree.heavy) else 0)
            p = base = tree.root(n)
            for length, ids in ((1, one), (2, two)):
                order, first, group = groups(token, ids)
                own = sums(order, first, train)[group]
                known = np.where(light | (ids == 0), -1, find(tree.after[length - 1], code(word, ids)))
                counts = tree.after_n[length - 1]
                p = tree.step(length, p, np.where(known >= 0, counts[known] if len(counts) else 0, own), ids)
            where = code(which, doc)
            order, first, _ = groups(where)
            at_block, at_doc = which[order][first], doc[order][first]
            parts = (at_doc.astype(np.uint32), sums(order, first, np.where(light, np.log10(base), 0)),
                     sums(order, first, (light & (n > 0)).astype(np.int64)).astype(np.uint32), sums(order, first, np.log10(p)))
            cuts = np.searchsorted(at_block, np.arange(len(events) + 1))
            for i, r in enumerate(events):
                yield run_batch([at], r[1], _SUMS, [pack(*(x[cuts[i]:cuts[i + 1]] for x in parts))])

        def finish(tree: Tree, at: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            row, doc_id, null, held, size, known, base, total = (unpack(rows[0][3], _DOCS))
            known, base, total = known.copy(), base.copy(), total.copy()
            for r in rows[1:]:
                doc, b, k, s = unpack(r[3], _PARTS)
                base[doc] += b
                known[doc] += k
                total[doc] += s
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(doc_id, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(size), pa.array(known), pa.array(base), pa.array(total)],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        parts = self._reduce(self._reduce(self._map(each, _RUN), score, _RUN), finish, _SCORED, key="block")
        # a text that runs over several blocks has a row in each
        return parts.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"),
            *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end per text; a null or empty text
    is its end.  Learnt from are the rows whose crc32 of the id as text (null: empty) is no multiple of 10.
    Repeated rows count and are scored each; other columns are ignored; an empty table gives no rows, and
    one without training rows gives every word the same probability.  A text of more than BLOCK tokens is
    read in pieces and has one row.  Words are told apart by 64-bit hashes.
    """
    model = Model(docs)
    rows = model.scores().withColumn("train_tokens", F.lit(model.tree.tokens).cast("long"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
