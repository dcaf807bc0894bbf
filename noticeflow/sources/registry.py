"""Organisation registry: CSV in and out, rows cut from funded-list page texts."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions.dates import to_iso_date
from noticeflow.functions.keys import normalize_amount
from noticeflow.functions.text import collapse_ws
from noticeflow.schemas import REGISTRY_COLUMNS

MAPPING_COLUMNS = ("website", "vendor", "albo_id", "albo_url")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry CSV with a header: every field trimmed, URLs without trailing slash, coded rows only."""
    raw = spark.read.csv(path, header=True, escape='"', multiLine=True)
    raw = raw.toDF(*[n.lstrip("\ufeff").strip() for n in raw.columns])
    return clean_registry(raw)


def clean_registry(raw: DataFrame) -> DataFrame:
    def field(name: str) -> Column:
        value = F.trim(F.coalesce(F.col(name), F.lit(""))) if name in raw.columns else F.lit("")
        return F.rtrim(value, F.lit("/")) if name in ("website", "albo_url") else value

    return raw.select(*[field(n).alias(n) for n in REGISTRY_COLUMNS]).filter(F.col("school_code") != "")


def write_registry(registry: DataFrame, path: str) -> None:
    """Fixed column order, a folder of CSV parts that ``read_registry`` takes back."""
    registry.select(*REGISTRY_COLUMNS).write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")



def _row_pattern() -> str:
    fields = r"\s+".join(f"({pattern})" for _, pattern in vocab.FUNDED_ROW_FIELDS)
    return fields + vocab.FUNDED_ROW_END


def extract_funded_rows(pages: DataFrame) -> DataFrame:
    """Registry rows from page texts (page, text); the last match per organisation wins.

    The page is scanned once for whole rows; fields are read from each short row.
    """
    pattern = _row_pattern()
    found = pages.select("page", F.posexplode(
        F.regexp_extract_all(collapse_ws(F.col("text")), F.lit(pattern), F.lit(0))).alias("pos", "row"))
    names = [name for name, _ in vocab.FUNDED_ROW_FIELDS]
    raw = found.select("page", "pos", *[
        F.regexp_extract("row", pattern, i + 1).alias(n) for i, n in enumerate(names)])
    columns = {
        "area": collapse_ws(F.col("area")), "school_name": collapse_ws(F.col("school_name")),
        "amount": normalize_amount(F.col("amount")), "funded_date": to_iso_date(F.col("date")),
    }
    parsed = raw.select("page", "pos", *[
        columns.get(n, F.col(n) if n in names else F.lit("")).alias(n) for n in REGISTRY_COLUMNS])
    last = parsed.groupBy("school_code").agg(
        F.max_by(F.struct(*REGISTRY_COLUMNS), F.struct("page", "pos")).alias("_row"))
    return last.select("_row.*")


def preserve_mapping(fresh: DataFrame, earlier: DataFrame) -> DataFrame:
    """Re-extracted rows keep website and platform of an earlier file."""
    old = earlier.select("school_code", *[F.col(c).alias(f"_old_{c}") for c in MAPPING_COLUMNS])
    return fresh.join(old, "school_code", "left").select(*[
        F.coalesce(f"_old_{c}", F.lit("")).alias(c) if c in MAPPING_COLUMNS else F.col(c) for c in fresh.columns])


def malformed(registry: DataFrame) -> DataFrame:
    """Rows whose name swallowed a code or a currency sign."""
    return registry.filter(
        F.contains("school_name", F.lit("M4C1I2")) | F.contains("school_name", F.lit("€")))


def assert_wellformed(registry: DataFrame) -> DataFrame:
    """Fail with up to five examples when names are malformed, else return the rows."""
    bad = malformed(registry).select("school_code", F.left("school_name", F.lit(80)).alias("n")).limit(5).collect()
    if bad:
        raise ValueError("Malformed parsed rows: " + "; ".join(f"{r.school_code}: {r.n}" for r in bad))
    return registry


def order_progressive(registry: DataFrame) -> DataFrame:
    return registry.orderBy(F.expr("try_cast(progressive AS int)"))
