"""Vendor payloads -> notices: feeds, embedded page JSON, search results, category pages."""

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions.text import collapse_ws, first_non_empty, html_unescape, let
from noticeflow.functions.web import anchors, is_pdf_url, url_join
from noticeflow.operators.ranking import keep_first
from noticeflow.schemas import NOTICE_COLUMNS
from noticeflow.session import cut_lineage, evaluate_once, small
from noticeflow.sources.documents import well_formed_xml

_ITEM = "title string, link string, guid string, pubDate string"
_ID = r"[?&]id=(\d+)"

_DATA_PAGE = r'data-page="([^"]+)"'
_DOCUMENTS = (
    "props struct<documenti: struct<data: array<struct<"
    "id: string, data_pubblicazione: string, data_scadenza: string, "
    "documento: struct<id: string, url: string, url_download: string, nome_file_origine: string>, "
    "categoria: struct<descrizione_class: string>>>>>"
)


def as_notices(df: DataFrame, vendor: str) -> DataFrame:
    """Complete a partial selection to the notice columns, blanks as ''."""
    have = set(df.columns)
    columns = [
        F.lit(vendor).alias(c) if c == "vendor"
        else F.coalesce(F.col(c), F.lit("")).alias(c) if c in have else F.lit("").alias(c)
        for c in NOTICE_COLUMNS
    ]
    return df.select(*columns)


def without_cdata(xml: Column) -> Column:
    """Comments left out and CDATA sections as escaped text, so that tags can be looked for by pattern."""
    parts = F.split(F.regexp_replace(xml, r"(?s)<!--.*?-->", ""), r"<!\[CDATA\[")

    def escaped(part: Column) -> Column:
        end = F.instr(part, F.lit("]]>"))
        inside = F.replace(F.replace(F.substring(part, F.lit(1), end - 1), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
        return F.concat(inside, F.substring(part, end + 3, F.length(part)))

    return let(parts, lambda p: F.concat(
        F.element_at(p, 1), F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), escaped), "")))


def elements(xml: Column, name: str) -> Column:
    """All elements of a name at any depth, each without those inside it; ``xml`` is without CDATA.

    Innermost elements are taken out first, then the ones around them, as often as the document nests them.
    """
    opening = rf"<{name}(?:\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)?(?<!/)>"
    innermost = rf"(?s){opening}(?:(?!<{name}[\s>]).)*?</{name}\s*>"
    marks = F.regexp_extract_all(xml, F.lit(rf"(?s)({opening}|</{name}\s*>)"), F.lit(1))
    depth = F.aggregate(
        marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, m: let(acc["now"] + F.when(F.startswith(m, F.lit("</")), -1).otherwise(1), lambda now: F.struct(
            now.alias("now"), F.greatest(acc["most"], now).alias("most"))),
        lambda acc: acc["most"])
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        rounds, F.struct(xml.alias("rest"), F.array().cast("array<string>").alias("found")),
        lambda acc, _: F.struct(
            F.regexp_replace(acc["rest"], innermost, "").alias("rest"),
            F.concat(acc["found"], F.regexp_extract_all(acc["rest"], F.lit(rf"(?s)({innermost[4:]})"), F.lit(1))).alias("found")),
        lambda acc: acc["found"])


def parse_rss_feed(feeds: DataFrame) -> DataFrame:
    """Feeds (school_code, xml) -> notices, from ``item`` elements at any depth; malformed XML gives no rows.

    Names are taken as they are written: items with a prefix, or of a feed whose first element has a default
    namespace, are other elements.
    """
    plain = ~F.col("xml").rlike(r"(?s)\A\s*(?:<\?.*?\?>|<!--.*?-->|<![^>]*>|\s)*+<[^>]*\sxmlns\s*=\s*[\"'][^\"']")
    sound = evaluate_once(feeds.filter(well_formed_xml(F.col("xml")) & plain).select(
        "school_code", without_cdata(F.col("xml")).alias("_xml")))
    items = sound.select("school_code", F.explode(elements(F.col("_xml"), "item")).alias("_item")).select(
        "school_code", F.from_xml("_item", _ITEM).alias("i"))
    blank = F.lit("")
    link, guid = F.trim(F.coalesce("i.link", blank)), F.trim(F.coalesce("i.guid", blank))
    item_id = first_non_empty(F.regexp_extract(guid, _ID, 1), F.regexp_extract(link, _ID, 1), guid, link)
    rows = items.select(
        "school_code", item_id.alias("item_id"), collapse_ws(F.coalesce("i.title", blank)).alias("title"),
        first_non_empty(link, guid).alias("url"), F.trim(F.coalesce("i.pubDate", blank)).alias("published"),
        item_id.alias("detail_ref"))
    return as_notices(rows.filter(F.col("item_id") != ""), "Argo")


def parse_embedded_json(pages: DataFrame) -> DataFrame:
    """Pages (school_code, albo_id, html) with an escaped JSON attribute -> notices; bad JSON gives no rows."""
    payload = html_unescape(F.regexp_extract("html", _DATA_PAGE, 1))
    records = pages.filter(F.trim("albo_id") != "").select(
        "school_code", "albo_id",
        F.explode(F.from_json(payload, _DOCUMENTS)["props"]["documenti"]["data"]).alias("r"))
    doc = F.col("r.documento")
    item_id = F.coalesce(F.nullif(F.col("r.id"), F.lit("")), doc["id"])
    rows = records.select(
        "school_code", item_id.alias("item_id"),
        first_non_empty(doc["nome_file_origine"], F.concat(F.lit("Atto "), item_id)).alias("title"),
        first_non_empty(doc["url"], F.concat(F.lit(vocab.SPAGGIARI_BASE + "/"), F.trim("albo_id"))).alias("url"),
        F.col("r.data_pubblicazione").alias("published"), F.col("r.data_scadenza").alias("expires"),
        F.col("r.categoria.descrizione_class").alias("category"),
        first_non_empty(doc["url_download"], doc["url"]).alias("pdf_url"))
    return as_notices(rows.filter(F.col("item_id").isNotNull()), "Spaggiari")


def parse_search_results(pages: DataFrame, limit: int = vocab.MAX_SEARCH_RESULTS) -> DataFrame:
    """Result pages (query_id, html) -> first ``limit`` distinct web results per page, in order."""
    pattern = r'(?s)class="result__a"[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    found = pages.select("query_id", F.posexplode(
        F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("pos", "a"))
    href = F.regexp_extract("a", pattern, 1)
    target = F.regexp_extract(href, "uddg=([^&]+)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)
    results = found.select(
        "query_id", "pos", F.when(target != "", decoded).otherwise(href).alias("url"),
        collapse_ws(F.regexp_replace(F.regexp_extract("a", pattern, 2), "<[^>]+>", "")).alias("title"))
    web = results.filter(
        F.startswith("url", F.lit("http")) & ~F.contains("url", F.lit(vocab.SEARCH_ENGINE_HOST)))
    first = keep_first(web, ["query_id", "url"], "pos")
    order = Window.partitionBy("query_id").orderBy("pos")
    return first.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit).drop("pos")


def search_requests(registry: DataFrame) -> DataFrame:
    """One query text per organisation with a name."""
    return registry.filter(F.coalesce("school_name", F.lit("")) != "").select(
        "school_code",
        F.concat(F.lit('"'), F.col("school_name"), F.lit(f'" {vocab.SEARCH_QUERY_TERMS}')).alias("query"))


def search_notices(results: DataFrame) -> DataFrame:
    """Search results (school_code, school_name, url, title, published) -> notices; named organisations only."""
    named = results.filter(F.coalesce("school_name", F.lit("")) != "")
    rows = named.select(
        "school_code", F.col("url").alias("item_id"), first_non_empty(F.col("title"), F.col("url")).alias("title"),
        "url", "published", F.when(is_pdf_url(F.col("url")), F.col("url")).otherwise(F.lit("")).alias("pdf_url"))
    return as_notices(rows, "Search")


def list_category_documents(registry: DataFrame, pages: DataFrame,
                            target: str = vocab.TARGET_CATEGORY,
                            labels: tuple[str, ...] = vocab.NAVIGATION_LABELS,
                            board: str = vocab.NUVOLA_BOARD) -> DataFrame:
    """Board page -> its category page -> document links, navigation labels left out.

    Pages: url, html.  The first anchor with the category's label is followed; each document counts once.
    """
    code = first_non_empty(F.trim("albo_id"), F.trim("school_code"))
    head, tail = board.split("{code}")
    boards = registry.withColumn("_code", code).filter(F.col("_code") != "").select(
        "school_code", F.concat(F.lit(head), F.col("_code"), F.lit(tail)).alias("url"))
    # only pages that lead to the category take part in the first join, as a short reference
    leads = pages.join(small(boards.select("url")), "url", "left_semi").select("url", F.get(
        F.filter(anchors(F.col("html")), lambda a: a["label"] == target), F.lit(0))["href"].alias("href"))
    category = cut_lineage(boards.join(evaluate_once(leads).filter(F.col("href").isNotNull()), "url").select(
        "school_code", url_join(F.col("url"), F.col("href")).alias("url")))
    # page bodies stay where they are while the category pages are few
    listed = pages.join(small(category), "url").select(
        "school_code", "url", F.posexplode(anchors(F.col("html"))).alias("pos", "a")
    ).filter((F.col("a.label") != "") & ~F.col("a.label").isin(*labels))
    rows = listed.select("school_code", "pos", F.col("a.label").alias("title"),
                         url_join(F.col("url"), F.col("a.href")).alias("url"))
    first = keep_first(rows, ["school_code", "url"], "pos")
    return as_notices(first.withColumn("item_id", F.col("url")), "Nuvola")


class Readers:
    """Vendor name -> reader function (DataFrame of that vendor's payloads -> notices)."""

    def __init__(self) -> None:
        self._readers: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register_reader(self, vendor: str, reader: Callable[[DataFrame], DataFrame]) -> "Readers":
        if not vendor.strip():
            raise ValueError("a reader needs a vendor name")
        self._readers[vendor.strip().lower()] = reader
        return self

    def dispatch(self, sources: DataFrame) -> DataFrame:
        """Route rows by vendor, case-insensitively; unknown vendors give no notices."""
        vendor = F.lower(F.trim("vendor"))
        return union_sources(*[
            reader(sources.filter(vendor == name)) for name, reader in sorted(self._readers.items())])

    def unsupported(self, sources: DataFrame) -> DataFrame:
        return sources.filter(~F.lower(F.trim(F.coalesce("vendor", F.lit("")))).isin(*self._readers))


def union_sources(*notices: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), notices)
