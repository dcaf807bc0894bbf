"""What the pair operators leave on disk, and how many pairs they look at."""

import glob
import os
import random

import numpy as np
from pyspark.sql import functions as F

from noticeflow.llm import common, line_dedup, ngram_join
from noticeflow.session import shared_dir


def _kept(spark) -> set[str]:
    return {os.path.basename(p) for p in glob.glob(shared_dir(spark).removeprefix("file:") + "/*-*")}


def test_line_dedup_deletes_its_tables(spark):
    rows = [(i, f"Una riga comune a tutti i testi numero {i % 3}\nriga propria {i} con altre parole {i * i}") for i in range(40)]
    before = _kept(spark)
    left = line_dedup.deduped_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(left) == 40 and sum(r.n_dropped for r in left) >= 37
    new = _kept(spark) - before
    assert not [n for n in new if n.startswith(("line-", "bands-", "shared-bands-", "signatures-")) and not n.startswith("line-occurrences-")], new


def test_extended_equals_components_of_all_links(spark):
    rng = random.Random(5)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    first, second = (spark.createDataFrame(part, "a long, b long") for part in (links[:60], links[60:]))
    found = common.extended(common.components(first), second)
    whole = common.components(first.union(second))
    assert {tuple(r) for r in found.collect() if r.node != r.component} == {tuple(r) for r in whole.collect() if r.node != r.component}


def test_bit_maps_refuse_near_misses_and_nothing_similar(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 150).astype(np.uint64)
    sets = []
    for _ in range(60):
        own = base.copy()
        own[rng.choice(150, rng.integers(0, 40), replace=False)] = rng.integers(0, 2**63, 1, np.int64).astype(np.uint64) + np.uint64(1)
        sets.append(np.unique(own))
    rows = [(i, len(s), ngram_join._bit_map(s).tolist()) for i, s in enumerate(sets)]
    table = spark.createDataFrame(rows, "i int, n long, bits array<long>")
    kept = {(r.a, r.b) for r in table.alias("x").join(table.alias("y"), F.expr(f"x.i < y.i AND {ngram_join._maps_close(90)}")).select(
        F.col("x.i").alias("a"), F.col("y.i").alias("b")).collect()}
    held = [set(s.tolist()) for s in sets]
    share = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a in range(60) for b in range(a + 1, 60)}
    assert {p for p, j in share.items() if j >= 0.9} <= kept
    assert sum(j < 0.8 for j in share.values()) > 500 and not {p for p, j in share.items() if j < 0.8} & kept
