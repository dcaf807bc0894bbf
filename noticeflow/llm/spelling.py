"""Spelling variants: the vocabulary acceptor composed with a one-edit transducer and itself."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import stored, text_of
from noticeflow.session import cut_lineage

LEAST_CHARS, LEAST_COUNT = 5, 3   # code points and occurrences of a word
TYPO = 97                         # runs whose checksum is a multiple lose a code point
HELD = 1 << 18                    # different words a task counts before it hands them on
GROUP = 2048                      # words of an initial state beyond which it is split

_RUN = re.compile("[a-zÀ-ÿ]+")
_WORD, _PAIR = "word string, n long", "word string, near string, near_n long"


def runs_of(doc_id: int | None, text: str) -> Counter:
    """The counted runs of a text, A-Z lower-cased, with the planted slips of its id (null: no digits)."""
    counted = Counter(_RUN.findall(text.encode().lower().decode()))
    head = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    out = Counter()
    for run, n in counted.items():
        h = zlib.crc32(run.encode(), head)
        if h % TYPO == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_CHARS:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: every different run of ``LEAST_CHARS`` code points or more that occurs ``LEAST_COUNT`` times or more."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for run, n in runs_of(doc_id, text.as_py()).items():
                    held[run] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(count, _WORD).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """The minimal acyclic automaton of some different words, given in order.

    State numbers grow from the ends of words to their beginnings, so an edge leads to a smaller number.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        open_edges: list[dict[str, int]] = [{}]   # states of the last word, not yet known to be minimal
        open_final = [False]

        def close(depth: int, last: str) -> None:
            while len(open_edges) > depth + 1:
                edges, final = open_edges.pop(), open_final.pop()
                key = (final, *edges.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.edges)
                    self.edges.append(edges)
                    self.final.append(final)
                open_edges[-1][last[len(open_edges) - 1]] = state

        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            close(same, last)
            for _ in word[same:]:
                open_edges.append({})
                open_final.append(False)
            open_final[-1] = True
            last = word
        close(0, last)
        self.edges.append(open_edges[0])
        self.final.append(open_final[0])
        self.start = len(self.edges) - 1


def _text(cell: tuple | None) -> str:
    out = []
    while cell:
        out.append(cell[0])
        cell = cell[1]
    return "".join(out)


def one_edit_pairs(words: list[str], depth: int) -> Iterator[tuple[str, str]]:
    """Pairs of different words (in order, given sorted) one replaced or inserted code point apart.

    They are the paths of the composition acceptor - one-edit transducer - acceptor.  Before the edit both
    acceptors are in one state; the edit is taken where the words first differ, so each pair has one path,
    and only before ``depth`` code points.  After the edit both read the same: what two states both accept
    is found once per pair of states.  Of an inserted code point, the word without it comes first.
    """
    machine = Acceptor(words)
    edges, final = machine.edges, machine.final
    shared: dict[tuple[int, int], list] = {}

    def both(p: int, q: int) -> list:
        """What both states accept, as linked code points."""
        first = (p, q) if p <= q else (q, p)
        todo = [first]
        while todo:
            pair = todo[-1]
            if pair in shared:
                todo.pop()
                continue
            a, b = edges[pair[0]], edges[pair[1]]
            steps = [(c, (a[c], b[c]) if a[c] <= b[c] else (b[c], a[c])) for c in (a if len(a) <= len(b) else b) if c in a and c in b]
            missing = [s for _, s in steps if s not in shared]
            if missing:
                todo += missing
                continue
            found: list = [None] if final[pair[0]] and final[pair[1]] else []
            for c, s in steps:
                found += [(c, rest) for rest in shared[s]]
            shared[pair] = found
            todo.pop()
        return shared[first]

    edits: dict[int, list] = {}

    def edits_at(p: int) -> list:
        """(rest of the one word, rest of the other) for an edit of the first code point read from ``p``."""
        if p not in edits:
            out, here = [], list(edges[p].items())
            for i, (c, to) in enumerate(here):
                for d, other in here[i + 1:]:
                    out += [((c, rest), (d, rest)) for rest in both(to, other)]
                out += [(rest, (c, rest)) for rest in both(p, to) if rest is None or rest[0] != c]
            edits[p] = out
        return edits[p]

    todo: list[tuple[int, tuple | None, int]] = [(machine.start, None, 0)]
    while todo:
        p, back, n = todo.pop()
        found = edits_at(p)
        if found:
            head = _text(back)[::-1]
            for a, b in found:
                yield head + _text(a), head + _text(b)
        if n + 1 < depth:
            todo += [(to, (c, back), n + 1) for c, to in edges[p].items()]


def _windows(rows: DataFrame, windows) -> DataFrame:
    """Each word once per initial state: the code points before ``lo`` and the last ``m - hi`` ones are what it has read."""
    one = rows.withColumn("_w", F.explode(windows)).select("word", "n", "chars", "_w.*")
    tail = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return one.withColumn("key", F.xxhash64(
        "m", "lo", "hi", F.expr("substring(word, 1, lo)"), F.when(tail > 0, F.right("word", tail)).otherwise("")))


def _halves(m, lo, hi) -> list:
    mid = F.floor((lo + hi) / 2).cast("int")
    return [F.struct(m.alias("m"), lo.alias("lo"), mid.alias("hi")), F.struct(m.alias("m"), mid.alias("lo"), hi.alias("hi"))]


def initial_states(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, n, chars, m, lo, hi, key: the words by what the two acceptors have read around the edit.

    Two words one edit apart, the shorter of ``m`` code points, first differ at one of the places 0 to
    ``m``.  If that place lies from ``lo`` to before ``hi``, they share the code points before ``lo`` and
    the last ``m - hi`` ones.  Each word goes to the lower and upper half of the places, as a word of
    ``m`` code points and as the longer one of ``m + 1``.  States that hold more than ``group`` words are
    halved again until the place is known: then there are no more words than pairs of letters.
    """
    m = F.col("m_")
    rows = words.withColumn("chars", F.length("word")).withColumn("m_", F.explode(F.array("chars", F.col("chars") - 1))).filter(m >= LEAST_CHARS)
    rows = _windows(rows, F.array(*_halves(m, F.lit(0), m + 1)))
    while True:
        hot = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_rows"), F.first(F.col("hi") - F.col("lo")).alias("_wide"))
                          .filter((F.col("_rows") > group) & (F.col("_wide") > 1)).select("key", F.lit(True).alias("_hot")))
        if hot.isEmpty():
            return rows
        here = F.struct("m", "lo", "hi")
        rows = cut_lineage(_windows(
            rows.join(hot, "key", "left").drop("key"),
            F.when(F.col("_hot"), F.array(*_halves(F.col("m"), F.col("lo"), F.col("hi")))).otherwise(F.array(here))))


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, near, near_n: every pair of words one edit apart, in both directions, from word and n (different words)."""
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(rows: pa.Table) -> list[tuple[str, str, int]]:
            m, lo, hi = (rows.column(c)[0].as_py() for c in ("m", "lo", "hi"))
            tail = max(m - hi, 0)
            counts = dict(zip(rows.column("word").to_pylist(), rows.column("n").to_pylist(), strict=True))
            some = next(iter(counts))
            before, after = some[:lo], some[len(some) - tail:] if tail else ""
            out = []
            for a, b in one_edit_pairs(sorted(w[lo:len(w) - tail] for w in counts), hi - lo):
                a, b = before + a + after, before + b + after
                if len(a) == m:   # two longer words belong to another state
                    out += [(a, b, counts[b]), (b, a, counts[a])]
            return out

        def run(rows: pa.Table, last: bool) -> tuple[pa.Table, list]:
            """The pairs of all states but an unfinished one at the end, which is left over."""
            key = rows.column("key").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            ends = len(cuts) - 1 if last else len(cuts) - 2
            out = []
            for i in np.flatnonzero(np.diff(cuts[:ends + 1]) > 1).tolist():
                out += pairs_of(rows.slice(cuts[i], cuts[i + 1] - cuts[i]))
            return rows.slice(cuts[ends]), out

        def made(found: list) -> pa.RecordBatch:
            word, near, n = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(near), pa.array(n, pa.int64())], ["word", "near", "near_n"])

        rest, out = None, []
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rest, found = run(pa.concat_tables([rest, rows]) if rest is not None else rows, False)
                out += found
            if len(out) > 20_000:
                yield made(out)
                out = []
        if rest is not None:
            out += run(rest, True)[1]
        if out:
            yield made(out)

    states = initial_states(words, group).select("key", "m", "lo", "hi", "word", "n")
    return states.repartition("key").sortWithinPartitions("key").mapInArrow(compose, _PAIR)


def variants(words: DataFrame, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of different words with their counts.

    A form is the near word of largest count (ties: first in code-point order) that occurs twice as often
    or more.  Counts double on the way to a root, so doubling the steps reaches it in the logarithm of the
    logarithm of the largest count.
    """
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    enough = -F.col("_best.less") >= 2 * F.col("n")
    rows = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("_best.near")).alias("form"), F.when(enough, -F.col("_best.less")).alias("form_n")), "spelling-forms")
    most = rows.agg(F.max("n")).first()[0] or 1
    steps = rows.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    reach = 1
    while reach < most.bit_length():
        then = steps.select(F.col("word").alias("root"), F.col("root").alias("_then"))
        steps = cut_lineage(steps.join(then, "root", "left").select("word", F.coalesce("_then", "root").alias("root")))
        reach *= 2
    return rows.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of all words of whole texts.

    A null text has no words; a null id counts as no digits in the checksum.  Repeated rows count each.
    Very long runs are words like any other.  An empty table, or one without frequent words, gives no
    rows.  Other columns are ignored.
    """
    return variants(stored(vocabulary(docs), "spelling-words"))


# DuckDB has no CRC-32; its table is made by the rule of its polynomial.
SPELLING_SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
       lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tbl),
r AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents) GROUP BY ALL),
h AS MATERIALIZED (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(strlen(x)), lambda k: ('0x' || substr(hex(x), CAST(2 * k + 1 AS BIGINT), 2))::BIGINT)),
       lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT *, d || ':' || run AS x FROM r), t),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN w ON c.v = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN w ON c.v = w.word),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': encode(near)}) AS b, arg_min(near, {'less': -near_n, 'near': encode(near)}) AS near FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * w.n THEN near END AS form, CASE WHEN -b.less >= 2 * w.n THEN -b.less END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON f.word = k.next)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k USING (word) WHERE k.next IS NULL"""
