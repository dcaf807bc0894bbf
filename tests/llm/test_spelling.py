"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import data

from noticeflow.llm import spelling

ALPHABET = "abcé"
REST = ("en", "a", 1, *["c"] * 11)
NONE = (None,) * 14


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    counts = collections.Counter()
    for row in rows:
        doc_id, text = row[0], row[1] or ""
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def slipped(rng, word):
    at = rng.randrange(len(word))
    return rng.choice((word[:at] + word[at + 1:], word[:at] + rng.choice(ALPHABET) + word[at:], word[:at] + rng.choice(ALPHABET) + word[at + 1:]))


def vocabulary(rng, n):
    words = {"".join(rng.choice(ALPHABET) for _ in range(rng.randint(5, 9))) for _ in range(n)}
    words |= {"common" * 3 + "".join(rng.choice(ALPHABET) for _ in range(4)) for _ in range(n)}   # one long beginning
    words |= {"".join(rng.choice(ALPHABET) for _ in range(4)) + "ending" * 3 for _ in range(n)}
    words |= {slipped(rng, w) for w in list(words)[:n]}
    words |= {"a" * k for k in range(5, 12)} | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    return sorted(w for w in words if len(w) >= 5)


def test_pairs_of_the_composition_equal_brute_force(spark):
    rng = random.Random(3)
    words = vocabulary(rng, 150)
    counts = {w: rng.choice((3, 4, 7, 9, 20, 100)) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    for group in (2048, 8):   # without and with states split again
        got = sorted(tuple(r) for r in spelling.near_pairs(table, group).collect())
        assert got == sorted((a, b, counts[b]) for a in words for b in words if one_edit(a, b))
        assert sorted(map(tuple, spelling.variants(table, group).collect()), key=lambda r: r[0]) == brute(counts)


def test_states_hold_few_words_however_common_a_beginning_is(spark):
    rng = random.Random(4)
    words = sorted({"shared" * 4 + "".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)})
    states = spelling.initial_states(spark.createDataFrame([(w, 3) for w in words], "word string, n long"), 100)
    assert states.groupBy("key").count().agg({"count": "max"}).first()[0] <= 100


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("ab", "cd", "e") for b in ("", "x", "xyz"))
    machine = spelling.Acceptor(words)
    shapes = {(f, tuple(sorted(e.items()))) for f, e in zip(machine.final, machine.edges, strict=True)}
    assert len(shapes) == len(machine.edges) and all(to < s for s, e in enumerate(machine.edges) for to in e.values())
    read, todo = [], [(machine.start, "")]
    while todo:
        s, head = todo.pop()
        read += [head] if machine.final[s] else []
        todo += [(to, head + c) for c, to in machine.edges[s].items()]
    assert sorted(read) == words


def test_variants_of_documents_equal_brute_force(spark):
    rng = random.Random(6)
    words = [w for w in vocabulary(rng, 60) if len(w) < 100]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.4 else slipped(rng, rng.choice(words[:9])) for _ in range(60)) for _ in range(80)]
    texts += ["MIXED Case×÷ Straße STRASSE Étééé éTééé naïve-words_under 12wordsſ" for _ in range(4)]
    rows = [(i, t, *REST) for i, t in enumerate(texts)] + [r for r in data.documents() if len(r[1] or "") < 50_000]
    rows += [(None, texts[0], *NONE)]
    got = spelling.spelling_variants(data.frame(spark, rows, data.DOCUMENTS))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == brute(brute_words(rows))


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], data.DOCUMENTS)).count() == 0
    few = data.frame(spark, [(1, "once only", *REST), (None, None, *NONE)], data.DOCUMENTS)
    assert spelling.spelling_variants(few).count() == 0


def test_sql_equals_the_operator(spark):
    import duckdb

    from noticeflow.llm import queries

    folder = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = connection.execute(f"select word, form, root, n, n_near, form_n from ({spelling.SPELLING_SQL})").fetchall()
    got = queries.op11_spelling(spark, folder).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(want) > 1000 and sorted(map(tuple, got)) == sorted(want)
