"""Packing: deficit round-robin over source queues into fixed windows of tokens."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from noticeflow.llm.common import text_of
from noticeflow.session import cut_lineage, scratch_path

WINDOW = 2048
SLICE = 256
END_ID = 1
CACHE_WORDS = 600_000
BATCH_BYTES = 8 << 20
BROADCAST_ROWS = 200_000

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
_TOKENS = "doc_id long, source string, part int, local long, n long, ids binary"

# Words the fast path may split itself: lower-casing and composition are one to one here.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_WORD_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def _byte_letters() -> dict[int, str]:
    """Byte to letter as byte-level vocabularies write it: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of white-space separated words by a word-end BPE file; words are looked up once per worker.

    No token of such a vocabulary spans white space, so a text's ids are its words' ids.  Words of plain
    Latin letters go straight to the merges; any other word, and any that may hold a special token, takes
    the whole pipeline of the tokenizer file.
    """

    _loaded: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _part(self, part: str) -> bytes:
        found = self.cache.get(part)
        if found is None:
            letters = part.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[part] = found
        return found

    def word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self._part(p) for p in _WORD_PARTS.findall(word.lower())])
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by END_ID, and the texts' bounds in them."""
        words = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(words.offsets, np.int64)
        coded = words.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        values = [self.word(w) for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(v) // 4 for v in values] + [1], np.int64)
        flat = np.frombuffer(b"".join(values) + np.array([END_ID], "<u4").tobytes(), "<u4")
        starts = np.cumsum(sizes) - sizes
        # after its words, every text gets the closing entry
        index = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds[1:], len(values))
        length = sizes[index]
        ends = np.cumsum(length)
        where = np.repeat(starts[index] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        closes = bounds[1:] + np.arange(1, len(bounds))
        return flat[where], np.concatenate(([0], ends[closes - 1])) if len(closes) else np.zeros(1, np.int64)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BATCH_BYTES of text each."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + BATCH_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """A row per document with its ids and its place in its source's queue of this partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokenizer, queued = TaskContext.get().partitionId(), WordTokenizer.load(path), {}
        for whole in batches:
            for batch in _slices(whole, "text"):
                ids, bounds = tokenizer.texts(batch.column("text"))
                n = np.diff(bounds)
                sources, local = batch.column("source").to_pylist(), []
                for source, size in zip(sources, n.tolist(), strict=True):
                    local.append(queued.get(source, 0))
                    queued[source] = local[-1] + size
                small = ids.astype("<u2") if ids.max(initial=0) < 1 << 16 else None
                width = 2 if small is not None else 4
                raw = (small if small is not None else ids).tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("source"), pa.array([part] * len(n), pa.int32()),
                    pa.array(local, pa.int64()), pa.array(n, pa.int64()),
                    pa.array([raw[a * width:b * width] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                ], ["doc_id", "source", "part", "local", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    return rows.mapInArrow(run, _TOKENS)


@dataclass
class Schedule:
    """Deficit round-robin in closed form.

    A queue is served in slices of SLICE tokens.  Every window adds a queue's quantum (its share of the
    window) to its deficit counter; it is served while the counter holds a slice, the rest is carried to
    the next window.  When a queue drains, its deficit ends and the others share its quantum: a new phase.
    Slices served up to window k of a phase are thus floor(credit + (k - first + 1) * rate), so any task
    can place any slice without asking the others.
    """

    totals: np.ndarray          # tokens per queue
    first: np.ndarray           # first window of each phase
    credit: np.ndarray          # phase x queue: slices owed at its beginning
    rate: np.ndarray            # phase x queue: slices owed per window

    @classmethod
    def plan(cls, totals: list[int], shares: list[float], window: int = WINDOW, piece: int = SLICE) -> Schedule:
        total = np.array(totals, np.int64)
        slices = -(-total // piece).astype(np.int64)
        share = np.array(shares, float)
        credit, at = np.zeros(len(total)), 0
        first, credits, rates = [], [], []
        while True:
            open_ = credit < slices
            weight = np.where(open_, np.maximum(share, 0), 0.0)
            if open_.any() and not weight.any():
                weight = open_.astype(float)  # only queues without a share are left: they share alike
            rate = weight / weight.sum() * (window / piece) if weight.any() else weight
            first.append(at)
            credits.append(credit.copy())
            rates.append(rate)
            if not rate.any():
                break
            live = rate > 0
            steps = max(1, int(np.ceil((slices[live] - credit[live]) / rate[live]).min()))
            credit = np.where(live, credit + steps * rate, credit)
            done = credit >= slices - 1e-6
            credit = np.where(done, slices, credit)
            at += steps
        return cls(total, np.array(first, np.int64), np.array(credits), np.array(rates))

    def slices_by(self, window: np.ndarray, queue: np.ndarray | None = None, piece: int = SLICE) -> np.ndarray:
        """Slices served up to the end of ``window`` (-1: none), of one queue each or of all queues."""
        phase = np.clip(np.searchsorted(self.first, window, "right") - 1, 0, None)
        steps = window - self.first[phase] + 1
        most = -(-self.totals // piece)
        if queue is None:
            got = np.floor(self.credit[phase] + steps[:, None] * self.rate[phase] + 1e-9)
            return np.where(window[:, None] < 0, 0, np.minimum(got, most)).astype(np.int64)
        got = np.floor(self.credit[phase, queue] + steps * self.rate[phase, queue] + 1e-9)
        return np.where(window < 0, 0, np.minimum(got, most[queue])).astype(np.int64)

    def window_of(self, queue: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The window that serves slice ``number`` of its queue: the first with number + 1 slices served."""
        low = np.full(len(number), -1, np.int64)
        high = np.full(len(number), self.first[-1], np.int64)
        while (gap := high - low > 1).any():
            mid = (low + high) // 2
            enough = self.slices_by(mid, queue) > number
            high, low = np.where(gap & enough, mid, high), np.where(gap & ~enough, mid, low)
        return high

    def positions(self, queue: np.ndarray, number: np.ndarray, piece: int = SLICE) -> np.ndarray:
        """Tokens before each slice in the packed stream: windows in order, queues in turn within a window."""
        out = np.empty(len(number), np.int64)
        step = max(1, 2_000_000 // max(1, len(self.totals)))
        window = self.window_of(queue, number)
        for a in range(0, len(number), step):
            w, q, j = window[a:a + step], queue[a:a + step], number[a:a + step]
            seen, back = np.unique(w, return_inverse=True)
            before = np.minimum(self.totals, piece * self.slices_by(seen - 1))
            after = np.minimum(self.totals, piece * self.slices_by(seen))
            turn = np.cumsum(after - before, axis=1) - (after - before)
            base = before.sum(axis=1)
            out[a:a + step] = base[back] + turn[back, q] + piece * j - before[back, q]
        return out


def _cut(schedule: Schedule, queue: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, position) of documents lying at ``begin`` of their queues."""
    first, last = begin // SLICE, (begin + n - 1) // SLICE
    count = last - first + 1
    doc = np.repeat(np.arange(len(n)), count)
    number = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    a = np.maximum(number * SLICE, begin[doc])
    b = np.minimum((number + 1) * SLICE, (begin + n)[doc])
    position = schedule.positions(queue[doc], number) + a - number * SLICE
    start, length = a - begin[doc], b - a
    # cut where a piece runs over the end of a sequence
    room = WINDOW - position % WINDOW
    over = length > room
    doc, start, length, position = (
        np.concatenate(x) for x in (
            (doc, doc[over]), (start, start[over] + room[over]),
            (np.minimum(length, room), length[over] - room[over]), (position, position[over] + room[over])))
    order = np.lexsort((start, doc))
    doc, start, length, position = doc[order], start[order], length[order], position[order]
    # pieces that follow each other in the document and in one sequence are one
    joined = (doc[1:] == doc[:-1]) & (position[1:] == position[:-1] + length[:-1]) & (
        position[1:] // WINDOW == position[:-1] // WINDOW)
    head = np.flatnonzero(np.concatenate(([True], ~joined))) if len(doc) else np.zeros(0, np.int64)
    return doc[head], start[head], np.add.reduceat(length, head) if len(head) else length, position[head]


def pack(docs: DataFrame, tokenizer_path: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Pack all documents into sequences of WINDOW tokens; one row per piece (see PIECES).

    ``shares`` are the sources' target token proportions; a source it does not name follows when the named
    ones are drained.  By default each source has its share of all tokens, so all queues drain together.
    Only the last sequence may be shorter than WINDOW.  A null text is empty (one closing token), a null
    source is a queue of its own, repeated rows are packed once each, an empty table gives no pieces.

    Documents are tokenised once into a table in the shared folder.  Per-partition totals of each source,
    summed up over the partitions, place each partition in its queues; from there every document finds its
    windows by the schedule alone.  One number per source is all that is brought together.
    """
    spark = docs.sparkSession
    at = scratch_path(spark, "packing")
    tokenised(docs, tokenizer_path).write.option("compression", "zstd").parquet(at)
    tokens = spark.read.schema(_TOKENS).parquet(at)
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = sorted((r.source, r.n) for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect())
    names = [s for s, _ in totals]
    schedule = Schedule.plan([n for _, n in totals], [float((shares or dict(totals)).get(s, 0.0)) for s in names])
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut_lineage(parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    # ids stay where they are while the bases, a row per partition and source, are few; else both are shuffled
    bases = F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases
    number = {s: i for i, s in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, "ids"):
                n = batch.column("n").to_numpy(zero_copy_only=False)
                begin = batch.column("local").to_numpy(zero_copy_only=False) + batch.column("base").to_numpy(zero_copy_only=False)
                queue = np.array([number[s] for s in batch.column("source").to_pylist()], np.int64)
                doc, start, length, position = _cut(schedule, queue, begin, n)
                values = batch.column("ids").to_pylist()
                ids = [np.frombuffer(v, f"<u{len(v) // k}").astype("<u4") for v, k in zip(values, n.tolist(), strict=True)]
                crc = [zlib.crc32(ids[d][a:a + k]) for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(n[doc]), pa.array(position // WINDOW), pa.array(position % WINDOW),
                ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.join(bases, ["source", "part"]).select(
        "doc_id", "source", "local", "base", "n", "ids").mapInArrow(run, PIECES)
