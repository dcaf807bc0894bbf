"""Small messy tables: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names the operators use themselves
    *[T.StructField(n, T.StringType()) for n in ("_text", "node", "shard", "start", "kept", "drop", "_id", "_own", "part", "weight", "doc")],
])
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in ("_id", "_sha1", "host", "tokens", "text")],
])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, edits):
    out = text.split(" ")
    for _ in range(edits):
        out[rng.randrange(len(out))] = words(rng, 1)
    return " ".join(out)


def documents(n=60, seed=5):
    rng = random.Random(seed)
    base = words(rng, 220)
    line = words(rng, 9)
    texts = [words(rng, rng.randint(1, 120)) + "\n" + words(rng, 12) for _ in range(n)]
    texts += [base] + [edited(rng, base, rng.choice((1, 2, 3, 4, 6))) for _ in range(25)]
    texts += [line + "\n" + words(rng, 8) for _ in range(6)] + [edited(rng, line + " " + words(rng, 20), 1) for _ in range(3)]
    texts += ["", " \t\n", None, "One", "two Words", "ONE", base, base.upper(), base + " \r\n", "a\x00b \x0b ß Ω 日本語", "x\n\ny\n"]
    texts += [words(rng, 30_000)]
    rows = [(i, t, rng.choice(("en", "de", None)), "hot" if i % 3 else rng.choice(("a", "b", None)), len(t or ""), *["c"] * 11) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", "en", "a", 3, *[None] * 11), (None, None, None, None, None, *[None] * 11), rows[3], rows[3]]
    return rows


def frame(spark, rows, schema, parts=5):
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), schema)


def by_python(df):
    return [tuple(r) for r in df.collect()]
