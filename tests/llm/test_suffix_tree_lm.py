"""Language-model scores against a brute-force suffix tree."""

import collections
import math
import random
import re
import zlib

import data
import pytest

from noticeflow.llm import suffix_tree_lm as lm

REST = ("en", "a", 1, *["c"] * 11)


def tokens_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["<end>"]


class Brute:
    """The same tree with dictionaries: all counts, contexts by share, leave-one-out gains."""

    def __init__(self, rows, share):
        train = [tokens_of(t) for i, t, *_ in rows if zlib.crc32(str("" if i is None else i).encode()) % 10]
        self.c = collections.Counter(x for t in train for x in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.after = {1: collections.defaultdict(collections.Counter), 2: collections.defaultdict(collections.Counter)}
        for t in train:
            seen = ["<start>", *t]
            for i, x in enumerate(t):
                self.after[1][seen[i]][x] += 1
                if i:
                    self.after[2][seen[i - 1], seen[i]][x] += 1
        least = max(1, share * self.n)
        self.states = {}
        for length in (1, 2):
            for s, nexts in self.after[length].items():
                n = sum(nexts.values())
                if n < least or length == 2 and any(sum(self.after[1][w].values()) < least for w in s):
                    continue
                gains = []
                for mu in lm.STRENGTHS:
                    gain = -n * math.log(n - 1 + mu)
                    for x, c in nexts.items():
                        above = self.c[x] / self.n
                        if length == 2:
                            m = self.after[1][s[1]]
                            above = (m[x] + lm.STRENGTHS[lm.PARENT] * above) / (sum(m.values()) + lm.STRENGTHS[lm.PARENT])
                        gain += c * math.log((c - 1 + mu * above) / above)
                    gains.append(gain)
                best = max(range(3), key=lambda i: gains[i])
                self.states[s] = (n, lm.STRENGTHS[best], gains[best] >= lm.DIVERGENCE * n)
        for s in [s for s in self.states if isinstance(s, tuple) and self.states[s][2]]:
            self.states[s[1]] = (*self.states[s[1]][:2], True)

    def root(self, x):
        return (self.c[x] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, x, one, two):
        p = self.root(x)
        for length, s in ((1, one), (2, two)):
            n, mu, kept = self.states.get(s, (0, 0, False))
            if kept:
                p = (self.after[length][s][x] + mu * p) / (n + mu)
        return p

    def row(self, doc_id, text):
        t = tokens_of(text)
        seen = ["<start>", *t]
        held = zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10 == 0
        return (doc_id, held, len(t), sum(self.c[x] > 0 for x in t), self.n, sum(math.log10(self.root(x)) for x in t),
                sum(math.log10(self.p(x, seen[i], (seen[i - 1], seen[i]) if i else None)) for i, x in enumerate(t)))


def chain(rng, n):
    """Words that depend on the two before, so that contexts tell something."""
    out = ["w0", "w1"]
    while len(out) < n:
        k = (int(out[-1][1:]) * 3 + int(out[-2][1:])) % 11 if rng.random() < 0.8 else rng.randrange(40)
        out.append(f"w{k}")
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    made = [(i, chain(rng, rng.randint(1, 90)).upper() if i % 7 == 0 else chain(rng, rng.randint(1, 90)), *REST) for i in range(200)]
    return made + [r for r in data.documents() if len(r[1] or "") < 5000]


def same(got, want):
    def key(r):
        return str(r[:5]), r[5]
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(("share", "block"), [(0.002, None), (0.0005, 700), (0.05, 5000)])
def test_scores_equal_brute_force(spark, rows, monkeypatch, share, block):
    frame = data.frame(spark, rows, data.DOCUMENTS)
    if block:
        monkeypatch.setattr(lm, "RANGE", 3000)
    model = lm.Model(frame, share=share)
    brute = Brute(rows, share)
    assert sum(int(k.sum()) for k in model.tree.kept) == sum(kept for *_, kept in brute.states.values())
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, model.tree.tokens, r.base_score, r.score) for r in model.scores().collect()]
    same(got, [brute.row(r[0], r[1]) for r in rows])


def test_states_tell_more_than_words_and_sum_to_one(rows):
    brute = Brute(rows, 0.002)
    held = [brute.row(r[0], r[1]) for r in rows]
    held = [r for r in held if r[1]]
    assert sum(r[6] for r in held) > 0.9 * sum(r[5] for r in held)
    for one, two in (("w3", ("w1", "w3")), ("<start>", None), ("never", None)):
        assert sum(brute.p(x, one, two) for x in brute.c) + brute.p("not seen", one, two) == pytest.approx(1)


def test_long_text_in_pieces(monkeypatch):
    """Blocks and pieces of a text give the tokens of the whole text, each with the two before it."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(lm, "PIECE", 50)
    monkeypatch.setattr(lm, "BLOCK", 40)
    monkeypatch.setattr(lm, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    monkeypatch.setattr(lm, "by_bytes", lambda batch, column: (batch.slice(i, 1) for i in range(batch.num_rows)))
    rng = random.Random(1)
    texts = [data.words(rng, n) for n in (3, 400, 1, 60)] + ["", " " * 200 + "after white", "x" * 130 + " y", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array([False] * len(texts)), pa.array(texts)], ["row", "doc_id", "held_out", "text"])
    seen = {i: [] for i in range(len(texts))}
    for block in lm.blocks(iter([batch])):
        row = block.docs.column("row").to_numpy()
        for d, *x in zip(block.doc.tolist(), block.token, block.before, block.before_that, strict=True):
            seen[int(row[d])].append(tuple(map(int, x)))
    for i, t in enumerate(texts):
        word = lm.word_hashes(pa.array([t]))[0] if t else np.zeros(0, np.uint64)
        token = [int(w) for w in word] + [int(lm.END)]
        before = [int(lm.START), *token[:-1]]
        assert seen[i] == list(zip(token, before, [int(lm.NONE), *before[:-1]], strict=True))


def test_nothing_to_learn_from(spark):
    assert lm.scored(spark.createDataFrame([], data.DOCUMENTS)).count() == 0
    (row,) = lm.scored(data.frame(spark, [(None, None, *REST)], data.DOCUMENTS)).collect()
    assert tuple(row) == (None, True, 1, 0, 0, 0.0, 0.0)
    assert row.__fields__ == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
