"""Run statistics, digests, exports and reconciliation."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.functions.dates import has_deadline, open_status
from noticeflow.functions.keys import reply_subject
from noticeflow.functions.text import confidence_word, yes_no
from noticeflow.operators.ranking import ordinal
from noticeflow.schemas import EXPORT_COLUMNS, text_schema


def run_stats(funnel: DataFrame, schools: DataFrame) -> DataFrame:
    """One-row run summary from the funnel table and the polled schools (column ``supported``)."""
    counted = funnel.agg(
        F.count(F.lit(1)).alias("new_items"),
        F.count_if(~F.col("stage").isin("superseded", "prefilter_rejected")).alias("prefiltered"),
        F.count_if("confirmed").alias("confirmed"),
        F.count_if(F.col("ai_error") != "").alias("ai_failures"),
        F.count_if("ai_used").alias("ai_verified"),
        F.count_if(F.col("ai_used") == F.lit(False)).alias("rule_only"),
    )
    groups = funnel.filter(F.col("stage") == "alerted").select("group_key").distinct().agg(
        F.count(F.lit(1)).alias("alerts"))
    polled = schools.agg(
        F.count_if("supported").alias("schools"), F.count_if(~F.col("supported")).alias("unsupported"))
    one = [d.withColumn("_k", F.lit(1)) for d in (polled, counted, groups)]
    return reduce(lambda a, b: a.join(b, "_k"), one).drop("_k")


def mapping_counts(registry: DataFrame) -> DataFrame:
    """Rows per platform, blank as UNRESOLVED."""
    vendor = F.coalesce(F.nullif(F.trim("vendor"), F.lit("")), F.lit("UNRESOLVED"))
    return registry.groupBy(vendor.alias("vendor")).agg(F.count(F.lit(1)).alias("n"))


def ai_cooldown_counts(attempts: DataFrame) -> DataFrame:
    """Skipped requests and the last rate-limit error of a run (columns skipped, error, ts)."""
    return attempts.agg(
        F.count_if("skipped").alias("n_skipped"),
        F.max_by("error", F.when(F.coalesce("error", F.lit("")) != "", F.col("ts"))).alias("last_error"))


def message_subject(school_name: Column, n: Column, deadline: Column, reply_to: Column) -> Column:
    """Subject of one message: reply, several notices, or one notice with its deadline."""
    base = F.concat(F.lit("Opportunità formatore IA PNRR: "), school_name)
    return (
        F.when(reply_to.isNotNull(), reply_subject(reply_to))
        .when(n > 1, F.concat(base, F.lit(" — "), n.cast("string"), F.lit(" avvisi")))
        .when(has_deadline(deadline), F.concat(base, F.lit(" (scade "), deadline, F.lit(")")))
        .otherwise(base)
    )


_DIGEST_COLUMNS = (
    "school_name", "school_code", "region", "cup", "clp", "amount", "title", "url", "opportunity_type",
    "deadline", "confidence", "ai_used", "reason", "reply_subject",
)


_BLOCK_COLUMNS = ("title", "url", "opportunity_type", "deadline", "confidence", "ai_used", "reason")


def digest_parts(entries: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Messages in two tables of the same shape at any size.

    Headers: one row per group (group_key, n, subject, header).  Blocks: one per entry (group_key,
    block_no, text), numbered in ``order``.  Positions come from the skew-safe ranking, so no task gathers
    a group.  Entries: group_key, school_name, school_code, region, cup, clp, amount, title, url,
    opportunity_type, deadline, confidence, ai_used, reason, reply_subject.
    """
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    needed = [c for c in entries.columns if c in ("group_key", *order, *_DIGEST_COLUMNS)]
    # entries of one order key stand in one order for headers and blocks
    rows = entries.select(*needed).withColumn("_tie", F.xxhash64(*needed))
    own = [c for c in needed if c in ("group_key", *order, *_BLOCK_COLUMNS)]
    numbered = ordinal(rows.select(*own, "_tie"), ["group_key"], [*order, "_tie"], "block_no")
    block = F.concat(
        F.lit("\n"), F.col("block_no").cast("string"), F.lit(". "), text("title"),
        F.lit("\n   Link: "), text("url"),
        F.lit("\n   Tipo: "), text("opportunity_type"), F.lit(" | Scadenza: "), text("deadline"),
        F.lit(" | Affidabilità: "), confidence_word(F.col("confidence")),
        F.lit(" | Verifica IA: "), yes_no(F.col("ai_used")),
        F.lit("\n   Perché: "), text("reason"), F.lit("\n"))
    # a header needs the first entry only, which an aggregate finds without moving the others
    head = F.struct("school_name", "school_code", "region", "cup", "clp", "amount", "deadline", "reply_subject")
    heads = rows.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min_by(head, F.struct(*order, "_tie")).alias("_h"))
    h, n = F.col("_h"), F.col("n")

    def line(label: str, c: str) -> Column:
        return F.concat(F.lit(label), F.coalesce(h[c], F.lit("")), F.lit("\n"))

    header = F.concat(
        F.lit("Nuova opportunità di formazione PNRR sull'intelligenza artificiale confermata.\n\n"),
        line("Scuola: ", "school_name"), line("Codice meccanografico: ", "school_code"),
        line("Regione: ", "region"), line("CUP: ", "cup"), line("CLP: ", "clp"), line("Importo: ", "amount"),
        F.lit("\nAvvisi trovati ("), n.cast("string"), F.lit("):\n"))
    headers = heads.select(
        "group_key", "n", message_subject(h["school_name"], n, h["deadline"], h["reply_subject"]).alias("subject"), header.alias("header"))
    return headers, numbered.select("group_key", "block_no", block.alias("text"))


def digest(entries: DataFrame, order: list[str]) -> DataFrame:
    """One message per group: group_key, subject, body.

    The last step of a digest: a message is one value, so its blocks have to meet.  A sender of
    messages that do not fit a value takes :func:`digest_parts` and streams the blocks.
    """
    headers, blocks = digest_parts(entries, order)
    bodies = blocks.groupBy("group_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: b["text"]), "").alias("_blocks"))
    return headers.join(bodies, "group_key").select("group_key", "subject", F.concat("header", "_blocks").alias("body"))


def export_opportunities(opportunities: DataFrame, today, strict: bool = False) -> DataFrame:
    """Archive rows with open/expired/unknown status, newest first."""
    return opportunities.withColumn("status", open_status(F.col("deadline"), today, strict)).select(
        *EXPORT_COLUMNS).orderBy(F.desc("first_seen"))


def write_export(opportunities: DataFrame, path: str, today, strict: bool = False) -> None:
    """The export as CSV: a header, columns in fixed order, newest first, quotes doubled, nulls empty.

    Rows are range-partitioned by their order, so the parts read by name are the sorted file and no task
    holds all of it.
    """
    rows = export_opportunities(opportunities, today, strict).orderBy(F.desc("first_seen"), "school_code", "url")
    rows.write.mode("overwrite").csv(path, header=True, escape='"', nullValue="", emptyValue="")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The exported rows; empty values are empty texts."""
    return spark.read.schema(text_schema(*EXPORT_COLUMNS)).csv(path, header=True, escape='"', multiLine=True).na.fill("")


def decision_trail(decisions: DataFrame, school_code: str | None = None) -> DataFrame:
    rows = decisions if school_code is None else decisions.filter(F.col("school_code") == school_code)
    return rows.orderBy(F.desc("updated_at"))


def copy_missing_rows(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows to append to the target: source rows whose key it lacks."""
    return source.join(target.select(key), key, "left_anti").select(*source.columns)


def reconcile_counts(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Source and target row counts per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), F.lit(side).alias("side"), "n")
        for name, (source, target) in tables.items() for side, df in (("source", source), ("target", target))
    ]
    return reduce(DataFrame.unionByName, counts)
