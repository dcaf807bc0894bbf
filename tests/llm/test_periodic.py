"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import data
import pytest

from noticeflow.llm import periodic

REST = ("en", "a", 1, *["c"] * 11)


def brute_runs(words):
    """All maximal repetitions by comparing words q apart, smallest period first."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e - s + q >= max(6, 4 * q) and e > s:
                out.setdefault((s, e + q - s), q)   # a multiple of a period gives the same stretch
            s = max(e, s) + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def repetitive(rng, n):
    out = []
    while len(out) < n:
        part = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        out += part * rng.choice((1, 1, 2, 4, 5, 9)) + part[:rng.randint(0, len(part))]
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    words = repetitive(rng, rng.randint(0, 150)) if seed % 2 else [rng.choice("ab") for _ in range(rng.randint(0, 200))]
    want = brute_runs(words)
    assert sorted(periodic.runs_in([ord(w) for w in words])) == want
    assert periodic.text_runs([w.encode() for w in words]) == want


def test_nested_runs_and_runs_of_runs():
    inner = ["x"] * 7 + ["y"]
    words = ["p"] + inner * 5 + ["q"] + ["a", "b"] * 4
    runs = periodic.text_runs([w.encode() for w in words])
    assert (1, 40, 8) in runs and (42, 8, 2) in runs and sum(r[2] == 1 for r in runs) == 5 and runs == brute_runs(words)
    assert periodic.strongest(runs) == (1, 7, 1)


def test_digests_of_documents_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(repetitive(rng, rng.randint(1, 120))) for _ in range(120)]
    texts += ["\n".join(["one", "two\xa0three"] * 6), "a a a a a", "a a a a a a", "日 本 " * 9, " \t ", ""]
    rows = [(i, t, *REST) for i, t in enumerate(texts)] + [r for r in data.documents() if len(r[1] or "") < 5000]
    got = periodic.run_digests(data.frame(spark, rows, data.DOCUMENTS))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute(r[0], r[1]) for r in rows), key=str)


def test_long_text(spark):
    rng = random.Random(2)
    part = [rng.choice("abcdefgh") for _ in range(5000)]
    words = ["z"] + part * 5 + ["y"] + [rng.choice("abcd") for _ in range(20_000)]
    runs = periodic.text_runs([w.encode() for w in words])
    assert (1, 25_000, 5000) in runs and [r for r in runs if r[2] <= 40] == [r for r in brute_runs_to(words, 40)]


def brute_runs_to(words, most):
    """Runs of small periods only: the whole brute force is quadratic."""
    out, n = {}, len(words)
    for q in range(1, most + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > s and e - s + q >= max(6, 4 * q):
                out.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def test_nothing_to_read(spark):
    assert periodic.run_digests(spark.createDataFrame([], data.DOCUMENTS)).count() == 0
    (row,) = periodic.find_runs(data.frame(spark, [(None, None, *REST)], data.DOCUMENTS)).collect()
    assert tuple(row) == (None, [], None, "")
