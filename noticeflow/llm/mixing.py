"""Mixing sources to target weights: raking of token weights and calibrated sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import text_of
from noticeflow.session import cut_lineage

MARGINS = ("source", "lang", "topic")
TEMPERATURE = {"source": 0.85, "lang": 0.9, "topic": 0.95}
SWEEPS_A_ROUND = 4
CELLS_A_PARTITION = 100_000
HASH_RANGE = 2**52

# Topic rules, tried in order; the rest is prose.
TOPICS = (
    ("legal", r"(?i)licen[cs]e|copyright|all rights reserved"),
    ("contact", r"[\w.+-]+@[\w-]+\.\w"),
    ("numeric", r"\d.{0,40}\d.{0,40}\d"),
)
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    rule = F.lit(None).cast("string")
    for name, pattern in reversed(TOPICS):
        rule = F.when(text.rlike(pattern), name).otherwise(rule)
    return F.coalesce(rule, F.lit("prose"))


def draw(seed: int) -> Column:
    """A number in [0, 1) that depends on the document's id and the seed alone, so re-runs draw alike."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(HASH_RANGE))


def with_cells(docs: DataFrame) -> DataFrame:
    """Each document as the struct ``doc`` with doc_id, _source, _lang, _topic (null: empty name) and _tokens.

    Tokens are words; an empty text counts one.
    """
    text = text_of()
    return docs.select(
        F.struct("*").alias("doc"), F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_lang"), topic_of(text).alias("_topic"),
        F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1)).cast("long").alias("_tokens"))


def targets(cells: DataFrame, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """A row (margin, value, share) per marginal value; shares of a margin add up to 1.

    ``shares`` gives weights per margin; its values without rows are left out, values it does not name
    get none, the rest is scaled.  A margin without weights is tempered: token share to the power of TEMPERATURE.
    """
    rows = None
    for margin in MARGINS:
        own = cells.groupBy(F.col(f"_{margin}").alias("value")).agg(F.sum("tokens").alias("tokens"))
        given = (shares or {}).get(margin)
        if given is None:
            weight = F.pow(F.col("tokens").cast("double"), F.lit(TEMPERATURE[margin]))
        else:
            weight = F.lit(0.0)
            for value, share in given.items():
                weight = F.when(F.col("value") == value, float(share)).otherwise(weight)
        own = own.select(F.lit(margin).alias("margin"), "value", weight.alias("weight"))
        own = own.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("margin")))
        rows = own if rows is None else rows.union(own)
    return rows.drop("weight")


def rake(cells: DataFrame, shares: dict[str, dict[str, float]] | None = None, tolerance: float = 1e-9,
         rounds: int = 50) -> DataFrame:
    """Iterative proportional fitting of the cells' token weights to the three marginals.

    A sweep scales all cells of a source, then of a language, then of a topic to its target; sweeps end
    when no marginal is off by more than ``tolerance`` of the whole.  Cells, not documents, are raked: one
    row per (source, language, topic), spread over partitions by their count.  Marginals that no weights
    can meet at once end after ``rounds`` at the last sweep's fit.
    """
    count = cells.count()
    state = cells.withColumn("w", F.col("tokens") / F.sum("tokens").over(Window.partitionBy()))
    goal = targets(cells, shares)
    for margin in MARGINS:
        state = state.join(goal.filter(F.col("margin") == margin).select(
            F.col("value").alias(f"_{margin}"), F.col("share").alias(f"_goal_{margin}")), f"_{margin}")
    # one partition for cells that fit one satisfies every window below without a shuffle
    state = cut_lineage(state.coalesce(max(1, -(-count // CELLS_A_PARTITION))))
    for _ in range(rounds):
        for _ in range(SWEEPS_A_ROUND):
            for margin in MARGINS:
                mass = F.sum("w").over(Window.partitionBy(f"_{margin}"))
                state = state.withColumn("w", F.when(mass > 0, F.col("w") * F.col(f"_goal_{margin}") / mass).otherwise(F.lit(0.0)))
        state = cut_lineage(state)
        off = F.greatest(*[F.abs(F.sum("w").over(Window.partitionBy(f"_{m}")) - F.col(f"_goal_{m}")) for m in MARGINS])
        worst = state.select(off.alias("off")).agg(F.max("off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.drop(*[f"_goal_{m}" for m in MARGINS])


def rates(cells: DataFrame, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells with ``weight`` (raked share) and ``probability``: weight over token share, scaled so that the largest is 1."""
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())
    rated = rake(cells, shares).withColumn("_ratio", F.col("w") / share)
    return cut_lineage(rated.select(
        "_source", "_lang", "_topic", F.col("w").alias("weight"),
        (F.col("_ratio") / F.max("_ratio").over(Window.partitionBy())).alias("probability")))


def mix(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None, seed: int = 17) -> DataFrame:
    """Every document as ``doc`` with its _source, _lang, _topic, _tokens, weight, probability and kept.

    A document is kept when its drawn number is below its cell's probability.  As every probability is in
    proportion to raked weight over tokens at hand, the kept tokens meet all three marginals in
    expectation, without repeating a document.  Null source or language is a value of its own, a null text
    counts as empty, rows with equal ids share their fate, and an empty table stays empty.
    """
    celled = with_cells(docs)
    cells = cut_lineage(celled.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")))
    return celled.join(rates(cells, shares), ["_source", "_lang", "_topic"], "left").withColumn(
        "kept", draw(seed) < F.coalesce(F.col("probability"), F.lit(0.0)))


def sampled(docs: DataFrame, shares: dict[str, dict[str, float]] | None = None, seed: int = 17) -> DataFrame:
    """The documents that the mixture keeps, with their own columns only."""
    return mix(docs, shares, seed).filter("kept").select("doc.*")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The decision on every document: doc_id, source, lang, topic, tokens, weight, probability, kept."""
    narrow = cut_lineage(with_cells(docs).select("doc_id", "_source", "_lang", "_topic", "_tokens"))
    cells = cut_lineage(narrow.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens")))
    return narrow.join(rates(cells), ["_source", "_lang", "_topic"]).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"), F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), (draw(17) < F.col("probability")).alias("kept"))


def _topic_sql() -> str:
    arms = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS)
    return f"CASE {arms} ELSE 'prose' END"


def mix_sql(sweeps: int = 60, seed: int = 17) -> str:
    """The same by unrolled sweeps; one row of factors per cell and step."""
    steps, last = [], "s0"
    for i in range(sweeps * 3):
        m = MARGINS[i % 3]
        steps.append(
            f"s{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, w * g.share / sum(w) OVER (PARTITION BY {m}) AS w "
            f"FROM {last} JOIN goal_{m} g ON g.value = {m})")
        last = f"s{i + 1}"
    goals = ",\n".join(
        f"goal_{m} AS MATERIALIZED (SELECT value, w / sum(w) OVER () AS share FROM "
        f"(SELECT {m} AS value, pow(sum(tokens)::DOUBLE, {TEMPERATURE[m]}) AS w FROM cells GROUP BY 1))" for m in MARGINS)
    return rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {_topic_sql()} AS topic,
         greatest(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')), 1)::BIGINT AS tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{goals},
s0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS w FROM cells),
{", ".join(steps)},
r AS (SELECT source, lang, topic, w, w / (tokens / sum(tokens) OVER ()) AS ratio FROM {last}),
p AS MATERIALIZED (SELECT source, lang, topic, w, ratio / max(ratio) OVER () AS p FROM r)
SELECT doc_id, d.source, d.lang, d.topic, tokens, round(w, 6) AS weight, round(p, 6) AS probability,
       ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(HASH_RANGE)} < p AS kept
FROM d JOIN p USING (source, lang, topic)"""
