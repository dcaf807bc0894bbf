"""Lines that only share a passage are not compared pair by pair."""

import random

import data
from noticeflow.llm import line_dedup


def test_lines_with_a_common_passage(spark, monkeypatch):
    rng = random.Random(3)
    passage = data.words(rng, 80)
    lines = [data.words(rng, rng.randint(14, 20)) + " " + passage for _ in range(80)]
    lines += [lines[5] + " und", lines[9][3:]]  # copies of two of them
    compared = []
    verified = line_dedup._verified

    def counting(pairs, texts):
        compared.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(line_dedup, "_verified", counting)
    rows = [(i, t, "en", "a", len(t), *["c"] * 11) for i, t in enumerate(lines)]
    found = {r.doc_id: r.n_dropped for r in line_dedup.deduped_documents(data.frame(spark, rows, data.DOCUMENTS)).collect()}
    assert {i for i, n in found.items() if n} == {80, 81}
    assert sum(compared) < 4 * len(lines)
