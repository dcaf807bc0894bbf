"""Toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import text_of

SAMPLE_TOXIC, SAMPLE_ORDINARY = 1200, 3600     # labelled rows at most that a model is fitted on
SAMPLE_BYTES = 16_000                          # longer labelled texts are not sampled for fitting
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 16 << 10   # dictionary sizes
WINDOW, STRIDE, LEVEL = 96, 48, 9
GRAMS, BEFORE = range(5, 11), 6                # sizes of n-grams, bytes before one that tell copies of it
LEAST_ROWS, LEAST_RATIO = 4, 30.0
RIDGE = 0.05

_SCORED = "doc_id long, held_out boolean, score double"
_BLANK = re.compile(r"[\x00-\x20]+")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text (null: empty) is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def plain(text: str) -> bytes:
    """White space runs one space; words get a capital letter and small ones, so that a match tells a word's beginning."""
    return _BLANK.sub(" ", text.title()).strip().encode()


def _grams(text: bytes, size: int) -> np.ndarray:
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(0, len(data) - size + 1)
    code = np.full(n, size, np.uint64)
    for i in range(size):
        code = code * np.uint64(0x9E3779B97F4A7C15) + data[i:i + n]
        code ^= code >> np.uint64(29)
    return code


def _rows_apart(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts and in how many rows each follows other bytes; so copies of a passage count once."""
    grams, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for text in texts:
        found, at = np.unique(_grams(text, size), return_index=True)
        before = _grams(b" " * BEFORE + text, BEFORE)[at]
        grams.append(found)
        places.append(found * np.uint64(0x9E3779B97F4A7C15) ^ before)
    _, at = np.unique(np.concatenate(places), return_index=True)
    return np.unique(np.concatenate(grams)[at], return_counts=True)


def _rows_with(grams: np.ndarray, texts: list[bytes], size: int) -> np.ndarray:
    """In how many of the texts each of the sorted ``grams`` occurs."""
    rows = np.zeros(len(grams), np.int64)
    for text in texts:
        rows += np.isin(grams, _grams(text, size))
    return rows


def _telling_spans(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Spans of the toxic texts whose byte n-grams of some size occur in far more toxic than ordinary rows."""
    toxic, ordinary = [[b" " + t for t in texts] for texts in (toxic, ordinary)]
    inside = [np.zeros(len(t), bool) for t in toxic]
    for size in GRAMS:
        grams, rows = _rows_apart(toxic, size)
        # what would tell if no ordinary row held it
        rate = rows / max(1, len(toxic))
        likely = (rows >= LEAST_ROWS) & (rate >= LEAST_RATIO * 0.5 / max(1, len(ordinary)))
        grams, rate = grams[likely], rate[likely]
        telling = grams[rate >= LEAST_RATIO * (_rows_with(grams, ordinary, size) + 0.5) / max(1, len(ordinary))]
        for text, marks in zip(toxic, inside, strict=True):
            for at in np.flatnonzero(np.isin(_grams(text, size), telling)):
                marks[at:at + size] = True
    spans = []
    for text, marks in zip(toxic, inside, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
        spans += [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    return spans


def _frequent(samples: list[bytes], size: int) -> bytes:
    """The different samples, most frequent last."""
    return b" ".join(s for s, _ in reversed(Counter(samples).most_common()))[-size:]


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary; samples too few to train on are taken as they are, most frequent last."""
    try:
        return zstd.train_dictionary(size, [s.ljust(8) for s in samples], k=k, d=d).as_bytes()
    except zstd.ZstdError:
        return _frequent(samples, size)


@dataclass
class Model:
    """Two dictionaries and the calibration of a text's window distances.

    The toxic compressor knows the ordinary dictionary too, placed nearest, so its windows are shorter
    only where toxic passages match; a window's distance is the bytes this saves.
    """

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def compressors(self):
        def make(content: bytes):
            known = zstd.ZstdCompressionDict(content or b" " * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False,
                                       write_dict_id=False).compress
        return make(self.ordinary), make(self.toxic + self.ordinary)

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(features)), (features - self.centre) / self.scale])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def distances(text: bytes, ordinary, toxic) -> np.ndarray:
    """Bytes saved by the toxic dictionary in every window of the whole text."""
    starts = range(0, max(1, len(text) - STRIDE), STRIDE)
    windows = [text[a:a + WINDOW] for a in starts]
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows])


def features(texts: list[bytes], compressors) -> np.ndarray:
    out = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        top = np.maximum(0, np.sort(distances(text, *compressors))[::-1])
        out[i] = np.log1p(top[0]), np.log1p(top[:3].sum()), np.log1p(top.sum()), np.log(len(top))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [RIDGE] * (x.shape[1] - 1)) * len(x) / 100
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_model(toxic: list[str], ordinary: list[str], toxic_share: float) -> Model:
    """Train both dictionaries on two thirds of the texts, calibrate on the third left over.

    ``toxic_share`` is the share of toxic rows among all labelled ones; the calibration weighs rows so
    that a score of 0.5 is the point where both labels are as likely at that share.
    """
    both = [[plain(t) for t in texts] for texts in (toxic, ordinary)]
    train = [[t for i, t in enumerate(texts) if i % 3] for texts in both]
    test = [texts[::3] for texts in both]
    pieces = [t[a:a + 256] for t in train[1] for a in range(0, len(t), 256)]
    step = max(1, len(pieces) // 20_000)
    model = Model(_dictionary(pieces[::step], ORDINARY_BYTES, 64, 8),
                  _frequent(_telling_spans(*train), TOXIC_BYTES), np.zeros(5), np.zeros(4), np.ones(4))
    if not test[0] or not test[1]:  # one label only: nothing to tell apart
        share = min(max(toxic_share, 1e-6), 1 - 1e-6)
        model.weights[0] = np.log(share / (1 - share))
        return model
    x = features(test[0] + test[1], model.compressors())
    y = np.array([1.0] * len(test[0]) + [0.0] * len(test[1]))
    model.centre, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weight = np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean()))
    model.weights = _logistic((x - model.centre) / model.scale, y, weight)
    return model


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fifth, drawn by a hash of the id."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.md5(F.col("doc_id").cast("string"))
    picked = None
    for label, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        part = marked.filter(F.col("toxic") == label).withColumn("_draw", draw).orderBy("_draw", "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    # at most SAMPLE_TOXIC + SAMPLE_ORDINARY ids; of rows with one id, the text with the smallest hash is learnt from
    mine = texts.join(F.broadcast(picked), "doc_id").groupBy("_draw", "doc_id", "toxic").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = mine.orderBy("_draw", "doc_id").select("toxic", "text").collect()
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_model([r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0], share)




def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every whole text.

    Only the text is looked at.  A null text counts as empty; empty texts, very long ones and repeated
    rows are scored like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        compressors = model.compressors()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = features([plain(t) for t in part.column("text").to_pylist()], compressors)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(model.score(found))],
                    ["doc_id", "held_out", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       text_of().alias("text")).mapInArrow(run, _SCORED).withColumn(
        "predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below 0.5, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts):
        model = shared.value
        return _series(model.score(features([plain(t) for t in texts], model.compressors())))

    return docs.filter(scores(text_of()) < 0.5)


def _series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values)
