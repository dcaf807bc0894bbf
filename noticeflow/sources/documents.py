"""Stored document contents: what kind they are, which extraction to trust, one text per notice."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions.text import replacement_ratio
from noticeflow.functions.web import html_to_text, xml_to_text
from noticeflow.session import evaluate_once


def sniff_content(content: Column, url: Column, content_type: Column) -> Column:
    """Route stored bytes by their first characters, then by name and header: pdf, xml, docx, doc, html."""
    head = F.lower(F.regexp_extract(F.decode(content, "ISO-8859-1"), r"(?s)\A[\t-\r ]*+(.{0,10})", 1))
    name, kind = F.lower(url), F.lower(content_type)
    xml = F.lit(False)
    for mark in ("<?xml", "<rss", "<feed", "<urlset"):
        xml = xml | F.startswith(head, F.lit(mark))
    said_pdf = F.endswith(name, F.lit(".pdf")) | F.contains(kind, F.lit("pdf"))
    return (
        F.when(said_pdf & F.startswith(head, F.lit("%pdf-")), "pdf").when(xml, "xml")
        .when(F.endswith(name, F.lit(".docx")) | F.contains(kind, F.lit("wordprocessingml")), "docx")
        .when(F.endswith(name, F.lit(".doc")), "doc").otherwise("html")
    )


def well_formed_xml(xml: Column) -> Column:
    """Does the XML parser accept the document?"""
    options = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    return F.from_xml(xml, "_corrupt string", options)["_corrupt"].isNull()


def markup_to_text(content: Column, kind: Column) -> Column:
    """Text of XML or HTML content; malformed XML is read as HTML, legacy Word files give ''."""
    return (
        F.when((kind == "xml") & well_formed_xml(content), xml_to_text(content))
        .when(kind == "doc", F.lit("")).otherwise(html_to_text(content))
    )


def usable(text: Column) -> Column:
    return (F.length(text) >= vocab.MIN_USABLE_CHARS) & (replacement_ratio(text) <= vocab.MAX_REPLACEMENT_RATIO)


def choose_extraction(primary: Column, secondary: Column, fallback: Column) -> Column:
    """First usable extraction, else the fallback."""
    return F.coalesce(F.when(usable(primary), primary), F.when(usable(secondary), secondary), fallback)


def assemble_text(parts: DataFrame, key: str = "item_key") -> DataFrame:
    """One text per notice from its parts (rank, pos, text), newline-joined in (rank, pos) order.

    Blank parts are dropped before the shuffle.  The group is one document, which has to fit a
    value anyway.
    """
    filled = parts.filter(F.coalesce("text", F.lit("")) != "")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "pos", "text")))
    return filled.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("text"))


def decoded(content: Column) -> Column:
    """Stored markup as text: UTF-16 by its mark, else UTF-8 where the bytes are that, else Latin-1."""
    text = content.cast("string")
    return (
        F.when(F.substring(content, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff")), F.decode(content, "UTF-16"))
        .when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", "")).otherwise(F.decode(content, "ISO-8859-1"))
    )


def stored_files(spark: SparkSession, folder: str, pattern: str | None = None, max_bytes: int | None = None,
                 streaming: bool = False) -> DataFrame:
    """Files below a folder as path, length and content, read as a batch or a stream.

    Names and sizes are pruned before any content is read; folders ``key=value`` stay part of the path.
    Empty files have no row.
    """
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    files = reader.load(folder)
    return files.filter(F.col("length") <= max_bytes) if max_bytes is not None else files


def read_documents(files: DataFrame) -> DataFrame:
    """Stored files -> path, length, kind, text.

    Markup is read here; text is null for PDF and Word files, which other programs extract (see
    ``choose_extraction``), and empty for legacy Word files.
    """
    kinds = evaluate_once(files.withColumn("kind", sniff_content(F.col("content"), F.col("path"), F.lit(""))))
    text = F.when(F.col("kind").isin("xml", "html"), markup_to_text(decoded(F.col("content")), F.col("kind"))).when(F.col("kind") == "doc", "")
    return kinds.select("path", "length", "kind", text.alias("text"))


def parse_details(details: DataFrame, key: str = "detail_ref") -> DataFrame:
    """Detail records (key, json) -> detail_expires, detail_original, detail_category, description, attachments.

    Vendors change types between records, so fields are taken from a VARIANT one by one: what has another
    type is read as text, what is missing is null, and a record that is no JSON object has nulls only.
    """
    parsed = evaluate_once(details.select(key, F.try_parse_json("json").alias("_v")))

    def field(name: str) -> Column:
        return F.nullif(F.try_variant_get("_v", f"$.{name}", "string"), F.lit(""))

    names = F.transform(F.try_variant_get("_v", "$.allegati", "array<variant>"),
                        lambda a: F.coalesce(F.try_variant_get(a, "$.nome", "string"), F.lit("")))
    return parsed.select(
        key, field("dataArchiviazioneEffettiva").alias("detail_expires"), field("dataArchiviazioneOriginale").alias("detail_original"),
        field("tipologiaAttoDenominazione").alias("detail_category"), field("descrizione").alias("description"),
        F.coalesce(names, F.array().cast("array<string>")).alias("attachments"))


def detail_parts(parsed: DataFrame, bodies: DataFrame, key: str = "item_key") -> DataFrame:
    """Parts (key, rank, pos, text) of notices with a detail record: description and type, attachment names, bodies.

    ``bodies`` (key, pos, text) are what was read of the attachments.
    """
    facts = F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).alias("pos"), F.col("description").alias("text")),
                    F.struct(F.lit(0).alias("rank"), F.lit(1).alias("pos"), F.col("detail_category").alias("text")))
    names = F.transform("attachments", lambda name, i: F.struct(F.lit(1).alias("rank"), i.alias("pos"), name.alias("text")))
    own = parsed.select(key, F.explode(F.concat(facts, names)).alias("_p")).select(key, "_p.*")
    read = bodies.join(parsed.filter(F.size("attachments") > 0).select(key).distinct(), key, "left_semi")
    return own.unionByName(read.select(key, F.lit(2).alias("rank"), F.col("pos").cast("int").alias("pos"), "text")).filter(
        F.coalesce("text", F.lit("")) != "")


def site_parts(pages: DataFrame, attachments: DataFrame, key: str = "item_key") -> DataFrame:
    """Parts of notices of an own site: the first attachments (key, pos, text), then a slice of the page text (key, text)."""
    first = attachments.filter(F.col("pos") < vocab.MAX_ATTACHMENTS).select(key, F.lit(0).alias("rank"), F.col("pos").cast("int").alias("pos"), "text")
    page = pages.select(key, F.lit(1).alias("rank"), F.lit(0).alias("pos"), F.substring("text", 1, vocab.PAGE_TEXT_CHARS).alias("text"))
    return first.unionByName(page).filter(F.coalesce("text", F.lit("")) != "")
