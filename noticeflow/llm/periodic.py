"""Periodic runs of words: a suffix automaton whose link tree is accessed by link-cut paths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import text_of
from noticeflow.llm.shingles import by_bytes

TIMES, LEAST_WORDS = 4, 6   # a run is this many periods long, and this many words

_RUN = "struct<start:bigint,length:bigint,period:bigint>"
_OUT = f"doc_id long, runs array<{_RUN}>, strongest {_RUN}, collapsed string"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_ARROW_RUN)), ("strongest", _ARROW_RUN), ("collapsed", pa.string())])


def stretches(ids: np.ndarray, offset: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of the words that may hold runs, with their places.

    In a run of four periods and six words, every three words in a row occur three times.  So the text is
    cut where three words in a row do not, and its parts again by what occurs in them, until no part is
    cut any more.  No run is touched by a cut.
    """
    todo = [(offset, ids)]
    while todo:
        at, part = todo.pop()
        n = len(part)
        if n < LEAST_WORDS:
            continue
        _, pair = np.unique(part[:-1] * (int(part.max()) + 1) + part[1:], return_inverse=True)
        _, triple, count = np.unique(pair[:-1] * (int(part.max()) + 1) + part[2:], return_inverse=True, return_counts=True)
        often = count[triple] >= 3
        if often.all():
            yield at, part
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            _, own = np.unique(part[a:b + 2], return_inverse=True)
            todo.append((at + a, own))


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton of a sequence: suffix links, lengths, and the state of every prefix."""
    link, length, step, prefix = [-1], [0], [{}], []
    last = 0
    for c in word:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        prefix.append(new)
        last = new
    return link, length, prefix


class LinkCut:
    """The link tree in paths of one colour, each a splay tree ordered by depth.

    A colour is the place where the strings of a path's states last ended.  It is kept at the root of the
    splay tree; -1 stands for strings that have not occurred.
    """

    def __init__(self, link: list[int]):
        self.up = list(link)   # parent in the splay tree, or for its root the path above
        self.left = [-1] * len(link)
        self.right = [-1] * len(link)
        self.colour = [-1] * len(link)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right

        def rotate(x: int, p: int) -> None:
            g = up[p]
            if left[p] == x:
                inner = left[p] = right[x]
                right[x] = p
            else:
                inner = right[p] = left[x]
                left[x] = p
            if inner >= 0:
                up[inner] = p
            up[p], up[x] = x, g
            if g >= 0:
                if left[g] == p:
                    left[g] = x
                elif right[g] == p:
                    right[g] = x

        p = up[x]
        while p >= 0 and (left[p] == x or right[p] == x):
            g = up[p]
            if g >= 0 and (left[g] == p or right[g] == p):
                self.colour[x] = self.colour[g]   # the last one taken is the old root's
                rotate(p, g) if (left[g] == p) == (left[p] == x) else rotate(x, p)
            else:
                self.colour[x] = self.colour[p]
            rotate(x, up[x])
            p = up[x]

    def access(self, state: int, colour: int) -> Iterator[tuple[int, int]]:
        """Give the path from ``state`` to the root one colour; yields its segments so far: deepest state, colour."""
        below, x = -1, state
        while x >= 0:
            self._splay(x)
            yield x, self.colour[x]
            cut = self.right[x]
            if cut >= 0:
                self.colour[cut] = self.colour[x]
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = colour


def runs_in(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, in no order.

    When a word is appended, the path of the new prefix's state falls into segments: strings that last
    ended at the same place.  The longest string of a segment, of ``l`` words, ended ``d`` words before, so
    ``l + d`` words have the period ``d``, and no smaller one, else they had ended later.  If ``d`` is at
    most ``l`` they hold a square; it reaches as far back as it can, since ``l`` is the longest, and is a
    run's once the next word does not extend it.
    """
    link, length, prefix = automaton(word)
    tree, out, n = LinkCut(link), [], len(word)
    for i, state in enumerate(prefix):
        for x, last in tree.access(state, i):
            if last >= 0:
                d, l = i - last, length[x]
                if l >= (TIMES - 1) * d and l + d >= LEAST_WORDS and (i + 1 == n or word[i + 1] != word[i + 1 - d]):
                    out.append((i + 1 - l - d, l + d, d))
    return out


def text_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start and period."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return sorted((at + s, l, p) for at, part in stretches(ids) for s, l, p in runs_in(part.tolist()))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run repeats, joined by one space."""
    drop = np.zeros(len(words) + 1, np.int64)
    for s, l, p in runs:
        drop[s + p] += 1
        drop[s + l] -= 1
    drop = np.cumsum(drop)
    return b" ".join(w for w, d in zip(words, drop.tolist(), strict=False) if not d) if runs else b" ".join(words)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period; ties go to the smaller start, then period."""
    best = None
    for run in runs:   # by start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the ids (by checksum; null: no digits) get a text whose end repeats a part of it."""
    h, n = zlib.crc32(b"%d" % doc_id if doc_id is not None else b""), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def find_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """doc_id, runs (start, length, period by start and period), strongest, collapsed: one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null text has none.  A run is a stretch of words
    with smallest period ``q``, at least ``4 * q`` and six words long, that no neighbour extends.  The
    collapsed text leaves out what a run holds after its first ``q`` words.  ``strongest`` is null without
    runs.  Repeated rows and null ids are rows of their own; other columns are ignored.  A text is one
    value of one row, so its automaton is built in one task, over stretches that may hold runs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named(r: tuple[int, int, int]) -> dict:
            return {"start": r[0], "length": r[1], "period": r[2]}

        for batch in batches:
            for part in by_bytes(batch, "text", 1 << 22):
                ids = part.column("doc_id").to_pylist()
                all_runs, texts = [], []
                for doc_id, text in zip(ids, part.column("text"), strict=True):
                    words = text.as_py().encode().split()   # splits at the six white characters only
                    words = planted(doc_id, words) if plant else words
                    runs = text_runs(words)
                    all_runs.append(runs)
                    texts.append(collapsed(words, runs).decode())
                best = [strongest(runs) for runs in all_runs]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array([[named(r) for r in runs] for runs in all_runs], _ARROW.field("runs").type),
                    pa.array([b and named(b) for b in best], _ARROW_RUN), pa.array(texts, pa.string())], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _OUT)


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest one, and digests of all runs and of the collapsed text."""
    line = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    best = F.col("strongest")
    return find_runs(docs, plant=True).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
        best.period.alias("period"), F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(line, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
