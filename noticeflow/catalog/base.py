"""Registered queries: each reads the given tables, or data Spark derives from them, whole.

A derived view is written once as SQL expressions both engines understand; Spark evaluates them
with ``selectExpr`` and the check inlines them as a subquery.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the check for DuckDB, left out where SQL cannot express it."""
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream; a glob, because the source may be one file or a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@dataclass(frozen=True)
class View:
    """Rows of one table reshaped by expressions."""

    source: str
    columns: dict[str, str]
    where: str = ""

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.of(table(spark, sf_dir, self.source))

    def stream(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.of(stream(spark, sf_dir, self.source))

    def of(self, rows: DataFrame) -> DataFrame:
        if self.where:
            rows = rows.filter(self.where)
        return rows.selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        columns = ", ".join(f"{e} AS {n}" for n, e in self.columns.items())
        return f"(SELECT {columns} FROM {self.source}" + (f" WHERE {self.where})" if self.where else ")")


def text(e: str) -> str:
    return f"cast({e} as string)"


def padded(e: str, n: int) -> str:
    return f"lpad({text(e)}, {n}, '0')"


def italian_date(ts: str, add_years: int = 0) -> str:
    year = f"year({ts}) + {add_years}"
    return f"({padded(f'day({ts})', 2)} || '/' || {padded(f'month({ts})', 2)} || '/' || {text(year)})"


def iso_date(ts: str, add_years: int = 0) -> str:
    year = f"year({ts}) + {add_years}"
    return f"({text(year)} || '-' || {padded(f'month({ts})', 2)} || '-' || {padded(f'day({ts})', 2)})"


def case(subject: str, options: dict[str, str], other: str) -> str:
    arms = " ".join(f"WHEN {k} THEN {v}" for k, v in options.items())
    return f"CASE {subject} {arms} ELSE {other} END"


def sql_list(terms) -> str:
    """Vocabulary as a DuckDB list literal of normalised terms."""
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


# DuckDB twin of the text normalisation; equal on these tables (see the tests for other text).
def norm_sql(e: str) -> str:
    return (
        f"trim(regexp_replace(lower(regexp_replace(strip_accents({e}), '[’‘´`''�_-]', ' ', 'g')), "
        f"'[\\s\\x1c-\\x1f]+', ' ', 'g'))"
    )


def hits_sql(e: str, terms) -> str:
    return f"list_filter({sql_list(terms)}, lambda term_: contains({e}, term_))"


PROJECT = {
    "school_code": "'SC' || " + padded("c_custkey", 8),
    "school_name": "c_name",
    "region": "c_mktsegment",
    "cup": "'H74D' || " + padded("c_custkey", 11),
    "clp": "'M4C1I2.1-2026-1745-P-' || " + text("c_custkey"),
    "amount": text("c_custkey + 40000") + " || '.00'",
}
PROJECTS = View("customer", PROJECT)

_CUP = "'H74D' || " + padded("o_custkey", 11)
ORDER_CLASS = "o_orderkey % 5"
ORDER_NOTICES = View("orders", {
    "school_code": "'SC' || " + padded("o_custkey", 8),
    "item_id": text("o_orderkey"),
    "seq": "o_orderkey",
    "vendor": case("o_orderpriority", {
        "'1-URGENT'": "'Argo'", "'2-HIGH'": "'Spaggiari'", "'3-MEDIUM'": "'Nuvola'",
        "'4-NOT SPECIFIED'": "'Generic'"}, "'Search'"),
    "title": case("o_orderstatus", {
        "'F'": f"'Graduatoria finale esperti CUP ' || {_CUP}",
        "'O'": f"'Avviso di selezione esperti esterni DM 219 CUP ' || {_CUP}"},
        "'Circolare n. ' || " + text("o_orderkey")),
    "url": "'https://albo.example.it/atti/' || " + text("o_orderkey"),
    "cup": _CUP,
    "clp": "'M4C1I2.1-2026-1745-P-' || " + text("o_custkey"),
    "published": f"CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN '' "
                 f"WHEN o_orderpriority = '1-URGENT' THEN {iso_date('o_orderdate', 28)} "
                 f"ELSE {italian_date('o_orderdate', 28)} END",
    "expires": f"CASE WHEN o_orderpriority = '2-HIGH' THEN '' ELSE {italian_date('o_orderdate', 28)} END",
    "category": "o_orderpriority",
    "status": "o_orderstatus",
    "day": iso_date("o_orderdate", 28),
})

FEED_TITLES = {
    "'click'": "'Avviso di selezione esperti e tutor DM 219/2025 n. '",
    "'error'": "'Graduatoria definitiva esperti n. '",
    "'purchase'": "'Determina acquisto materiale igienico n. '",
    "'signup'": "'Avviso interno per docenti tutor n. '",
}
FEED = View("events", {
    "school_code": "'SC' || " + padded("user_id", 8),
    "item_id": text("event_id"),
    "item_key": "'SC' || " + padded("user_id", 8) + " || '|' || " + text("event_id"),
    "seq": "event_id",
    "vendor": case("event_type", {
        "'click'": "'Argo'", "'error'": "'Spaggiari'", "'purchase'": "'Nuvola'", "'signup'": "'Generic'"}, "'Other'"),
    "title": case("event_type", FEED_TITLES, "'Circolare n. '") + " || " + text("event_id"),
    "url": "'https://albo.example.it/' || event_type || '/' || " + text("event_id"),
    "published": italian_date("ts"),
    "category": "event_type",
    "stage": "event_type",
    "ts": "ts",
})
