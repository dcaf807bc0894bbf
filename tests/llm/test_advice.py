"""Cases that an operator once did less than its whole job on."""

import random

import data
import numpy as np

from noticeflow.llm import ann, html_text, line_dedup, toxicity


def test_toxic_words_of_a_small_language_are_found():
    rng = random.Random(11)

    def text(toxic, small):
        out = data.words(rng, rng.randint(30, 90)).split(" ")
        for _ in range(4):
            # the small language's toxic words only share their beginning, which ordinary words have inside
            tail = data.words(rng, 1)
            bad = "zorqe" + tail if small else rng.choice(("scoundrel", "blockhead"))
            fine = tail[:2] + "zorqe" + tail if small else "fair" + tail
            out.insert(rng.randrange(len(out)), bad if toxic else fine)
        return " ".join(out)
    model = toxicity.fit_model([text(True, i % 5 == 0) for i in range(300)], [text(False, i % 5 == 0) for i in range(900)], 0.25)
    held = [(toxic, text(toxic, True)) for toxic in (True, False) for _ in range(60)]
    found = model.score(toxicity.features([toxicity.plain(t) for _, t in held], model.compressors())) >= 0.5
    assert np.mean(found[:60]) >= 0.7 and np.mean(found[60:]) <= 0.1


def test_short_lines_are_deduplicated_exactly(spark):
    rng = random.Random(2)
    body = data.words(rng, 40)
    texts = [f"{body}\nHaanth.\n今日は晴れです", f"Haanth.\n{body}\n今日は晴れです", "HAANTH.\nHaanthe.\n\n", " Haanth. "]
    docs = data.frame(spark, [(i, t, "en", "a", 0, *["c"] * 11) for i, t in enumerate(texts)], data.DOCUMENTS)
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.deduped_documents(docs).collect()}
    assert got == {0: (0, texts[0]), 1: (3, ""), 2: (1, "Haanthe.\n\n"), 3: (1, "")}
    assert sorted(r.doc_id for r in line_dedup.without_repeats(docs).collect()) == [0, 2]


def test_a_host_of_copies_keeps_its_article(spark):
    def page(i, article):
        return (i, f"http://mirror.example/{i}", f"<html><body><nav>Menu</nav><article>{article}</article></body></html>", *["x"] * 5)
    rows = [page(i, "<h1>Head</h1><p>One article.</p>") for i in range(11)]
    rows += [page(i, f"<h1>Other {i}</h1><p>Text {i}</p>") for i in (11, 12)]
    # not the same html, but the same article
    rows += [(i, f"http://crawl.example/{i}", f"<body><article><h1>Head</h1><p>Again.</p></article><footer>{i}</footer>", *["x"] * 5) for i in range(20, 32)]
    got = {r.page_id: r.text for r in html_text.extract(data.frame(spark, rows, data.PAGES)).collect()}
    assert got == {**dict.fromkeys(range(11), "Head One article."), 11: "Other 11 Text 11", 12: "Other 12 Text 12", **dict.fromkeys(range(20, 32), "Head Again.")}


def test_an_article_is_found_through_wrappers():
    story = "<h1>Title</h1><p>The story goes on and on.</p><aside>Links</aside><div class='comments'><article>Reader says</article></div>"
    for page in (f'<div class="content header-layout sidebar"><article>{story}</article></div>', f'<form id="aspnetForm"><main>{story}</main></form>',
                 f'<form><div class="widget page"><nav>Menu</nav><div role="main">{story}</div></div></form><footer>Imprint</footer>'):
        assert html_text.main_text(page, {}) == "Title The story goes on and on.", page
    inside = f'<div class="page widget"><nav><article>Menu of very many things to click on</article></nav><article>{story}</article></div>'
    assert html_text.main_text(inside, {}) == "Title The story goes on and on."
    # what an article does not stand in by name alone stays out
    for page in ("<aside><article>Teaser</article></aside><p>Text</p>", '<div class="comments"><article>Reader says this and that</article></div><p>Text</p>',
                 '<div class="sidebar"><article>Short</article></div><p>A longer text</p>', '<nav><form><main>Menu of many things</main></form></nav><p>Text</p>'):
        assert html_text.main_text(page, {}) in ("Text", "A longer text"), page


def test_neighbours_of_equal_score_come_in_order_of_their_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, (400, 16)).astype("f4")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    full = x.astype(float) @ x.astype(float).T
    used = x.any(axis=1)
    for q in range(0, 400, 20):
        if used[q]:
            want = sorted((i for i in range(400) if i != q and used[i]), key=lambda i: (-full[q, i], i))[:20]
            assert got[q] == want, q
