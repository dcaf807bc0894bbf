"""Archives, HTML extraction, nearest neighbours, and the pipeline."""

import base64
import collections
import hashlib
import os
import random

import data
import numpy as np
import pytest

import corpus_pipeline
from noticeflow.llm import ann, html_text, warc

SMALL = "/root/testdata/sf0.001"


def page(i, article, host="site.example", extra=""):
    return (f"http://{host}/p/{i}", f"""<!DOCTYPE html><html><head><title>T {i}</title><script>var a = "<p>no</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/x{i}">Menu {i}</a></ul></nav><header id="top">Site head {i}</header>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy {i}</div><main><article>{article}<div class="share">Share {i}</div>{extra}</article></main>
<aside>Side {i}</aside><div id="comments"><p>Reader says {i}</p></div><form><input name=q>Search</form><footer>&copy; {i}</footer></body></html>""")


def pages():
    rows, want = [], []
    for i in range(14):
        url, html = page(i, f"<h1>Head &amp; {i}</h1><p>First <b>bold</b>\n text{i}<p>Second {i} &lt;&#8364;&gt;<br>line {i}", extra="<p>Same words on every page</p>")
        rows.append((i, url, html))
        want.append(f"Head & {i} First bold text{i} Second {i} <€> line {i}")
    rows += [(20, "http://one.example/a", "<div id=nav>Menu</div><p>Alone &amp fine</p><div class='post-body'>Body<span> in</span>side</div>"),
             (21, None, None), (22, None, ""), (23, "no url", "plain text only"), (24, "http://b.example", "<p>open <b>tags <i>never <div class=comment>hid</div> end" + "<b " * 2000),
             (25, "http://c.example", "<!-- never closed <p>text</p>"), (26, "http://d.example", "<p>" + "long words " * 50_000)]
    return [(*r, *["x"] * 5) for r in rows], want


@pytest.fixture(scope="module")
def table(spark):
    return data.frame(spark, pages()[0], data.PAGES).cache()


def test_templates_leave_the_main_text(table, spark):
    want = pages()[1]
    got = {r.page_id: r for r in html_text.extract(table).collect()}
    assert [got[i].text for i in range(14)] == want
    assert got[20].text == "Alone & fine Body inside"
    assert got[21].text == got[22].text == "" and got[23].text == "plain text only"
    assert got[24].text.startswith("open tags never end") and "hid" not in got[24].text
    assert got[25].text == "" and got[26].text == ("long words " * 50_000).strip()
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(spark.createDataFrame([], data.PAGES)).count() == 0


def test_archives_come_back_whole(spark, table, tmp_path):
    rows = [(i, f"http://x/{i}\r\n", random.Random(i % 7).randbytes(300).hex() * (1 + i % 7), *["c"] * 5) for i in range(60)]
    rows += [(100, None, None, *["c"] * 5), (101, "u", "", *["c"] * 5), (None, "n", "solo", *["c"] * 5), (None, "n", "", *["c"] * 5),
             (102, "ü", "größe", *["c"] * 5), (102, "ü", "größe", *["c"] * 5)]
    names = []
    for parts in (1, 6):
        folder = str(tmp_path / f"w{parts}")
        warc.write_archives(data.frame(spark, rows, data.PAGES, parts), folder, shard_bytes=40_000, roll_bytes=2_000)
        files = sorted(f for f in os.listdir(folder) if f.endswith(".gz"))
        names.append([(f, hashlib.sha1(open(f"{folder}/{f}", "rb").read()).hexdigest()) for f in files])
    assert names[0] == names[1] and len(names[0]) > 3
    assert not [f for f in os.listdir(folder) if f.endswith(".tmp")]
    open(f"{folder}/part-999999-0000.warc.gz", "wb").write(b"left over")
    got = warc.read_archives(spark, folder).collect()
    by_payload = collections.defaultdict(list)
    for r in rows:
        by_payload[(r[2] or "").encode()].append(r[0])
    want = []
    for payload, ids in by_payload.items():
        keep = max((i for i in ids if i is not None), default=None)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = True
        for i in ids:
            response = i == keep and first
            first = first and not response
            want.append((i, len(payload), digest, "response" if response else "revisit", None if response else keep, payload if response else None))
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in got))) == sorted(map(repr, want))
    os.remove(f"{folder}/{names[1][0][0]}")
    with pytest.raises(ValueError, match="not there"):
        warc.read_archives(spark, folder)
    assert warc.archived(spark.createDataFrame([], data.PAGES)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype("f4")
    x[100:700] = x[100]  # one vector held by many rows
    rows = [(i, v.tolist(), 0, "c", "c") for i, v in enumerate(x)]
    rows += [(9000, None, 0, "c", "c"), (9020, [0.0] * 24, 0, "c", "c"), (9040, [float("nan")] * 24, 0, "c", "c"), (9060, [1.0, None], 0, "c", "c"),
             (None, x[0].tolist(), 0, "c", "c"), (40, x[40].tolist(), 0, "c", "c"), (9080, [1.0, 2.0], 0, "c", "c"), (9081, [3.0, 2.0], 0, "c", "c")]
    schema = "vec_id long, embedding array<float>, label int, gid string, v string"
    got = collections.defaultdict(list)
    for r in ann.nearest(data.frame(spark, rows, schema)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype("f8")
    found = []
    for q in range(0, 3000, 20):
        score = y @ y[q]
        score[q] = -np.inf
        want = set(np.lexsort((np.arange(3000), -score.round(9)))[:20].tolist())
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert mine == [(i + 1, *m[1:]) for i, m in enumerate(sorted(mine, key=lambda m: (-m[2], m[1])))]
        assert all(abs(score[m[1]] - m[2]) < 1e-9 for m in mine)
        found.append(len(want & {m[1] for m in mine}) / 20)
    assert np.mean(found) >= 0.95
    assert sorted(m[1] for m in got[120]) == [100, *range(101, 120)]
    assert got[9080] == [(1, 9081, 7.0)] and not {9000, 9020, 9040, 9060} & set(got)
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]


def test_only_pages_that_may_occur_again_move(spark):
    rows = [(f"http://h{i % 2}.example/{i}", f"<p>page {i}</p>") for i in range(40)] + [(f"http://h0.example/c{i}", "<p>copy</p>") for i in range(9)]
    rows += [("http://h1.example/c", "<p>copy</p>"), (None, ""), (None, "")]
    once, first = html_text._different(spark.createDataFrame(rows, "url string, html string"))
    assert sorted(r.html for r in once.collect()) == sorted([f"<p>page {i}</p>" for i in range(40)] + ["<p>copy</p>"])
    assert sorted(r.html for r in first.collect()) == ["", "<p>copy</p>"]
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()


def test_a_vector_is_sent_once_per_pair_of_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16))
    hashing = ann.Hashing(16, 2, float(np.linalg.norm(x, axis=1).max()), 4.0, len(x))
    q, least = x[:30], hashing.least(x[:30])
    seen = hashing.visited(*hashing.chances(q), least, hashing.buckets(x))
    assert 0.3 < seen.mean() < 1
    # what is not in a bucket that a query visits is not found, however near
    import pyarrow as pa
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    index = pa.table({"gid": pa.array(np.arange(4000)), "v": lists(x)})
    asked = pa.table({"gid": pa.array(np.arange(30)), "v": lists(q), "least": lists(least)})
    found = ann._best(index, asked, 25, hashing).to_pylist()
    score = x @ x[:30].T
    for i, row in enumerate(found):
        want = sorted(np.flatnonzero(seen[i]).tolist(), key=lambda j: (-score[j, i], j))[:25]
        assert row["query"] == i and row["gids"] == want
    moved = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plan = ann.nearest(moved)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" not in plan
