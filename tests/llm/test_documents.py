"""Operators on documents against brute force."""

import collections
import hashlib
import random
import re
import zlib

import data
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noticeflow.llm import dedup, line_dedup, mixing, ngram_join, packing, shards, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return data.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return data.frame(spark, rows, data.DOCUMENTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], data.DOCUMENTS)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    return find


def linked(sets, percent):
    """All pairs of equal keys' sets with a Jaccard similarity of ``percent`` or more."""
    holders, pairs = collections.defaultdict(list), []
    for k, s in sets.items():
        shared = collections.Counter(j for x in s for j in holders[x])
        pairs += [(k, j) for j, n in shared.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
        for x in s:
            holders[x].append(k)
    return pairs


def classes(rows, words, percent):
    sets = {}
    for i, row in enumerate(rows):
        w = WORDS.findall(lowered(row[1] or ""))
        sets[i] = set(zip(*[w[k:] for k in range(words)], strict=False)) if len(w) >= words else ({tuple(w)} if w else set())
    find = union_find(linked(sets, percent), sets)
    lowest = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            lowest[find(i)] = min(lowest.get(find(i), row[0]), row[0])
    return sorted(((row[0], len(sets[i]), lowest.get(find(i))) for i, row in enumerate(rows)), key=repr)


def test_mixing_meets_its_marginals(spark, rows, docs):
    got = mixing.mixed_rows(docs).collect()
    assert len(got) == len(rows)
    topics = [re.compile(p) for _, p in mixing.TOPICS]
    cells, doc = collections.Counter(), []
    for r in rows:
        text = r[1] or ""
        topic = next((n for (n, _), p in zip(mixing.TOPICS, topics, strict=True) if p.search(text)), "prose")
        doc.append((r[0], r[3] or "", r[2] or "", topic, max(1, len(WORDS.findall(text)))))
        cells[doc[-1][1:4]] += doc[-1][4]
    total, w = sum(cells.values()), {c: float(n) for c, n in cells.items()}
    for _ in range(400):
        for axis, margin in enumerate(mixing.MARGINS):
            tokens = collections.Counter()
            for c, n in cells.items():
                tokens[c[axis]] += n
            goal = {v: n ** mixing.TEMPERATURE[margin] for v, n in tokens.items()}
            mass = collections.Counter()
            for c, x in w.items():
                mass[c[axis]] += x
            w = {c: x * goal[c[axis]] / sum(goal.values()) / mass[c[axis]] for c, x in w.items()}
    ratio = {c: w[c] / (cells[c] / total) for c in cells}
    top = max(ratio.values())
    want = []
    for i, s, lang, topic, n in doc:
        p = ratio[s, lang, topic] / top
        drawn = int(hashlib.md5(f"17:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        want.append((i, s, lang, topic, n, drawn < p))
    assert sorted(map(repr, ((r.doc_id, r.source, r.lang, r.topic, r.tokens, r.kept) for r in got))) == sorted(map(repr, want))
    assert all(abs(r.probability - ratio[r.source, r.lang, r.topic] / top) < 1e-5 for r in got)


def test_mixing_takes_given_shares_and_keeps_columns(docs, empty):
    rated = mixing.mix(docs, {"lang": {"en": 1.0, "nowhere": 3.0}})
    assert {r[0] for r in rated.filter("weight > 0").select("_lang").distinct().collect()} == {"en"}
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    assert kept.count() == mixing.mixed_rows(docs).filter("kept").count()
    assert mixing.sampled(empty).count() == mixing.mixed_rows(empty).count() == 0


def test_shards_are_contiguous_and_equal(rows, docs, empty):
    got = shards.shard_by_bytes(docs).collect()
    want = sorted(((-1 if r[0] is None else r[0]), zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [((-1 if r.doc_id is None else r.doc_id), r.text_crc32, r.size) for r in order] == want
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    total, biggest = sum(r.size for r in got), max(r.size for r in got)
    for shard in range(8):
        assert abs(sum(r.size for r in got if r.shard == shard) - total / 8) <= biggest
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    assert shards.shard_by_bytes(empty).count() == 0


def test_exact_dedup(rows, docs, empty):
    got = dedup.exact_dedup(docs, fan_in=2).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    want = []
    for text, members in groups.items():
        members.sort()
        sha = hashlib.sha256(text.encode()).hexdigest()
        want += [(m[3], members[0][3], len(members), n == 0, sha) for n, m in enumerate(members)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert dedup.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_similar_classes(rows, docs, words, percent):
    got = sorted(data.by_python(ngram_join.similar_classes(docs, words, percent)), key=repr)
    assert got == classes(rows, words, percent)


def test_a_great_group_of_near_copies_is_linked_without_its_pairs(spark):
    rng = random.Random(3)
    base = data.words(rng, 150)
    texts = [base] + [data.edited(rng, base, rng.choice((0, 1, 2, 3, 4, 5, 8))) for _ in range(250)]
    rows = [(i, t, "en", "a", 0, *["c"] * 11) for i, t in enumerate(texts)]
    got = sorted(data.by_python(ngram_join.similar_classes(data.frame(spark, rows, data.DOCUMENTS))), key=repr)
    assert got == classes(rows, 3, 90)


def test_one_of_each_class_stays(rows, docs, empty):
    want = collections.Counter(r[0] for r in rows)
    for doc_id, _, component in classes(rows, 5, 80):
        if doc_id is not None and doc_id != component:
            want.pop(doc_id, None)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == want


def test_rows_that_go_are_told_by_id_and_text(spark):
    rng = random.Random(3)
    base, other = data.words(rng, 200), data.words(rng, 200)
    near = data.edited(rng, base, 2)
    rest = ("en", "a", 1, *["c"] * 11)
    table = data.frame(spark, [(1, base, *rest), (7, near, *rest), (7, other, *rest), (None, near, *rest), (None, data.words(rng, 50), *rest)], data.DOCUMENTS)
    kept = collections.Counter((r.doc_id, r.text == other) for r in ngram_join.one_of_each(table).collect())
    assert kept == {(1, False): 1, (7, True): 1, (None, False): 1}


def test_nothing_to_join(empty):
    assert ngram_join.one_of_each(empty).count() == ngram_join.similar_classes(empty).count() == 0


def test_line_dedup(rows, docs, empty):
    norm = lambda l: lowered(re.sub(r"[\x20\x09-\x0D]+", " ", l).strip(" "))
    seen, lines = collections.defaultdict(set), {}
    for i, r in enumerate(rows):
        for k, line in enumerate((r[1] or "").split("\n")):
            n = norm(line)
            if len(n) >= line_dedup.LEAST_CHARS:
                seen[n].add((r[0] is None, r[0] or 0, k))
                lines[n] = {n[j:j + line_dedup.CHARS] for j in range(max(1, len(n) - line_dedup.CHARS + 1))}
    find = union_find(linked(lines, line_dedup.PERCENT), lines)
    groups = collections.defaultdict(set)
    for n, at in seen.items():
        groups[find(n)] |= at
    lost = {at for g in groups.values() for at in sorted(g)[1:]}
    want = []
    for r in rows:
        own = (r[1] or "").split("\n")
        gone = [k for k in range(len(own)) if (r[0] is None, r[0] or 0, k) in lost]
        text = r[1] if not gone else "\n".join(x for k, x in enumerate(own) if k not in gone)
        want.append((r[0], len(own), len(gone), text))
    assert sorted(map(repr, data.by_python(line_dedup.deduped_documents(docs)))) == sorted(map(repr, want))
    stay = line_dedup.without_repeats(docs)
    assert stay.columns == docs.columns
    assert stay.count() == sum(1 for _, _, gone, text in want if not gone or WORDS.search(text))
    assert line_dedup.without_repeats(empty).count() == 0


def test_packing_covers_every_token_once(rows, docs, empty):
    got = packing.pack(docs, TOKENIZER).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    wanted = collections.defaultdict(list)
    for r in rows:
        wanted[r[0]].append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])
    assert set(pieces) == set(wanted)
    for doc_id, texts in wanted.items():
        whole = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces[doc_id])
        if len(texts) > 1:
            assert sum(p[1] for p in whole) == sum(map(len, texts))
            continue
        at = 0
        for start, length, crc, size in whole:
            assert (start, size) == (at, len(texts[0]))
            assert crc == zlib.crc32(np.array(texts[0][start:start + length], "<u4").tobytes())
            at += length
        assert at == len(texts[0])
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for number, parts in sequences.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == packing.WINDOW or number == len(sequences) - 1
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_schedule_keeps_target_shares_and_carries_deficits():
    totals, shares = [200_000, 50_000, 30_000, 700], [0.5, 0.3, 0.2, 0.0]
    plan = packing.Schedule.plan(totals, shares)
    queue = np.concatenate([np.full(-(-t // packing.SLICE), i) for i, t in enumerate(totals)])
    number = np.concatenate([np.arange(-(-t // packing.SLICE)) for t in totals])
    size = np.minimum(packing.SLICE, np.array(totals)[queue] - number * packing.SLICE)
    position = plan.positions(queue, number)
    order = np.argsort(position)
    assert (position[order] == np.cumsum(size[order]) - size[order]).all()
    drained = position[queue == 2].max()  # until the first queue is empty every prefix is within a few slices of the targets
    for end in range(packing.WINDOW, int(drained), packing.WINDOW):
        for i, share in enumerate(shares):
            held = size[(queue == i) & (position < end)].sum()
            assert abs(held - share * end) <= 4 * packing.SLICE


def test_words_are_tokenised_like_whole_texts():
    import pyarrow as pa

    texts = ["", "  ", " it's I'M <|endoftext|>x  café ΣΑΣ naïve 12,3!!'ll \x0b\x1f\x85 a b İx 5×7 _a_ '", "日本語 text", "'t"]
    ids, bounds = packing.WordTokenizer.load(TOKENIZER).texts(pa.array(texts))
    whole = Tokenizer.from_file(TOKENIZER)
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids + [1]


def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(9)
    bad = ["scoundrel", "nitwit", "blockhead", "wretch"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = data.words(rng, rng.randint(20, 150)).split(" ")
        for _ in range(rng.randint(3, 8) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text), "en", "a", 0, *["c"] * 11))
        labels.append((i, 1, int(toxic)))
    rows += [(None, None, None, None, None, *[None] * 11), (5000, "", "en", "a", 0, *["c"] * 11), (5001, "scoundrel nitwit " * 20_000, "en", "a", 0, *["c"] * 11)]
    docs = data.frame(spark, rows, data.DOCUMENTS)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i in range(900) if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) >= 0.97
    assert got[5001].predicted == 1 and got[5000].predicted == 0
    stay = toxicity.without_toxic(docs, model)
    assert stay.columns == docs.columns and stay.count() == sum(r.predicted == 0 for r in got.values())
    nothing = toxicity.train(empty, marks.limit(0))
    assert toxicity.score(empty, nothing).count() == 0
    assert toxicity.score(docs.limit(3), nothing).filter("predicted = 1").count() == 0
