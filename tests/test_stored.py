"""Stored feeds, documents, detail records and the CSV export."""

import csv
import glob
import json
import os
import re
import xml.etree.ElementTree as ET
from datetime import date

from pyspark.sql import functions as F

from noticeflow.operators import lookups, reports
from noticeflow.schemas import EXPORT_COLUMNS
from noticeflow.sources import documents, feeds

ITEM = "<item><title>{0} &amp; altri</title><link>https://x.it/a?id={0}</link><guid>g{0}</guid><pubDate> 01/06/2026 </pubDate></item>"
FEEDS = {
    "channel": "<rss><channel>" + ITEM.format(1) + ITEM.format(2) + "</channel></rss>",
    "root": "<feed>" + ITEM.format(3) + "<entry><deep>" + ITEM.format(4) + "</deep></entry></feed>",
    "nested": "<rss><item><title>outer</title><guid>o</guid><box>" + ITEM.format(5) + "</box><item><guid>i</guid></item></item></rss>",
    "one": "<item><guid>only</guid></item>",
    "prefixed": '<rss xmlns:x="urn:x"><x:item><guid>no</guid></x:item>' + ITEM.format(6) + "</rss>",
    "space": '<rdf xmlns="urn:rss"><item><guid>no</guid></item></rdf>',
    "cdata": "<rss><item><title><![CDATA[ <item> & <b>x</b> ]]></title><guid><![CDATA[c]]></guid></item><!-- <item><guid>no</guid></item> --></rss>",
    "attributes": "<rss><item a='b > c' d=\"/\"><guid>q</guid></item><item/><items><guid>no</guid></items></rss>",
    "malformed": "<rss>" + ITEM.format(7) + "</channel></rss>",
    "cut": "<rss>" + ITEM.format(8),
    "text": "no markup",
    "empty": "",
    "blank": "<rss><item><title>nothing to tell it by</title></item></rss>",
}


def brute_feed(xml):
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return []
    out = []
    for node in root.iter("item"):
        link, guid = ((node.findtext(t) or "").strip() for t in ("link", "guid"))
        found = re.search(r"[?&]id=(\d+)", guid) or re.search(r"[?&]id=(\d+)", link)
        key = found[1] if found else guid or link
        if key:
            out.append((key, " ".join((node.findtext("title") or "").split()), link or guid, (node.findtext("pubDate") or "").strip()))
    return out


def test_items_at_any_depth(spark):
    table = spark.createDataFrame(list(FEEDS.items()), "school_code string, xml string")
    got = sorted((r.school_code, r.item_id, r.title, r.url, r.published) for r in feeds.parse_rss_feed(table).collect())
    assert got == sorted((name, *row) for name, xml in FEEDS.items() for row in brute_feed(xml))
    assert {g[1] for g in got if g[0] == "nested"} == {"o", "5", "i"}


def test_feeds_from_files(spark, scratch):
    for name, xml in FEEDS.items():
        with open(f"{scratch}/{name}.xml", "w", encoding="utf-16" if name == "root" else "utf-8") as f:
            f.write(xml)
    name = F.regexp_extract("path", r"/([^/]+)\.xml$", 1)
    want = sorted((n, row[0]) for n, xml in FEEDS.items() for row in brute_feed(xml))

    def notices(files):
        return feeds.parse_rss_feed(files.select(name.alias("school_code"), documents.decoded(F.col("content")).alias("xml")))
    assert sorted((r.school_code, r.item_id) for r in notices(documents.stored_files(spark, scratch, "*.xml")).collect()) == want
    out = f"{scratch}/out"
    stream = notices(documents.stored_files(spark, scratch, "*.xml", streaming=True))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{scratch}/offsets").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.school_code, r.item_id) for r in spark.read.parquet(out).collect()) == want


def test_stored_documents(spark, scratch):
    os.makedirs(f"{scratch}/in/deep")
    content = {
        "a.html": "<html><title>x</title><p>perché no</p><script>no()</script></html>".encode(), "b.html": "<p>perché no</p>".encode("latin-1"),
        "deep/c.pdf": b"  %PDF-1.7 ...", "deep/d.pdf": b"<html>an error page</html>", "e.xml": b"<?xml version='1.0'?><a>uno <b>due</b> tre</a>",
        "f.xml": b"<?xml version='1.0'?><a>uno <b>due</a>", "g.doc": b"\xd0\xcf\x11\xe0", "h.docx": b"PK\x03\x04", "i.html": b"", "j.html": b"<p>" + b"x" * 5000,
        "k.html": "<p>marca</p>".encode("utf-16"), "l.txt": b"not asked for",
    }
    for name, data in content.items():
        with open(f"{scratch}/in/{name}", "wb") as f:
            f.write(data)
    files = documents.stored_files(spark, f"{scratch}/in", "*.{html,pdf,xml,doc,docx}", max_bytes=4000)
    got = {r.path.split("/in/")[1]: (r.kind, r.text) for r in documents.read_documents(files).collect()}
    assert got == {
        "a.html": ("html", "x perché no"), "b.html": ("html", "perché no"), "deep/c.pdf": ("pdf", None), "deep/d.pdf": ("html", "an error page"),
        "e.xml": ("xml", "uno due"), "f.xml": ("xml", "uno due"), "g.doc": ("doc", ""), "h.docx": ("docx", None), "k.html": ("html", "marca")}


def test_detail_records_of_any_shape(spark):
    full = {"dataArchiviazioneEffettiva": "30/06/2026", "dataArchiviazioneOriginale": "01/06/2026", "tipologiaAttoDenominazione": "Avvisi",
            "descrizione": "Selezione", "allegati": [{"nome": "a.pdf"}, {"nome": None}, {"altro": 1}, "odd", {"nome": 7}]}
    records = {
        "full": json.dumps(full), "late": json.dumps({"dataArchiviazioneEffettiva": "", "dataArchiviazioneOriginale": 20260601, "allegati": {"nome": "x"}}),
        "list": "[1, 2]", "broken": "{", "none": None, "null": "null", "bare": json.dumps({"allegati": [], "descrizione": {"testo": "x"}})}
    parsed = documents.parse_details(spark.createDataFrame(list(records.items()), "detail_ref string, json string"))
    got = {r[0]: tuple(r)[1:] for r in parsed.collect()}
    nothing = (None, None, None, None, [])
    assert got == {"full": ("30/06/2026", "01/06/2026", "Avvisi", "Selezione", ["a.pdf", "", "", "", "7"]), "late": (None, "20260601", None, None, []),
                   "list": nothing, "broken": nothing, "none": nothing, "null": nothing, "bare": (None, None, None, '{"testo":"x"}', [])}
    notices = spark.createDataFrame([("full", "", "Cat"), ("late", "x", ""), ("gone", "y", "z")], "detail_ref string, expires string, category string")
    rich = lookups.enrich_notice(lookups.detail_join(notices, parsed)).collect()
    assert {r.detail_ref: (r.expires, r.category) for r in rich} == {"full": ("30/06/2026", "Avvisi"), "late": ("20260601", ""), "gone": ("y", "z")}
    bodies = spark.createDataFrame([("full", 1, "second"), ("full", 0, "first"), ("full", 2, ""), ("late", 0, "no attachment listed")], "detail_ref string, pos int, text string")
    texts = documents.assemble_text(documents.detail_parts(parsed, bodies, "detail_ref"), "detail_ref")
    assert {r.detail_ref: r.text for r in texts.collect()} == {"full": "Selezione\nAvvisi\na.pdf\n7\nfirst\nsecond", "bare": '{"testo":"x"}'}


def test_parts_of_own_sites(spark):
    pages = spark.createDataFrame([("a", "p" * 5000), ("b", "")], "item_key string, text string")
    found = spark.createDataFrame([("a", i, f"doc{i}" if i != 1 else "") for i in (4, 3, 2, 1, 0)], "item_key string, pos int, text string")
    texts = {r.item_key: r.text for r in documents.assemble_text(documents.site_parts(pages, found)).collect()}
    assert texts == {"a": "doc0\ndoc2\n" + "p" * 4000}


def test_csv_export(spark, scratch):
    rows = [(f"S{i % 3}", 'Istituto "A", sede', None, "C", "", "riga\nnuova, con virgola" if i == 5 else f"t{i}", f"u{i}", "30/06/2026" if i % 2 else "", "esperti",
             "high", "", f"2026-06-{1 + i % 9:02d}", "2026-06-10") for i in range(40)]
    columns = [c for c in EXPORT_COLUMNS if c != "status"]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).repartition(5)
    reports.write_export(table, f"{scratch}/csv", date(2026, 6, 15))
    lines, headers = [], 0
    for part in sorted(glob.glob(f"{scratch}/csv/part-*.csv")):
        with open(part, newline="", encoding="utf-8") as f:
            found = list(csv.reader(f))
        headers += found[:1] == [list(EXPORT_COLUMNS)]
        lines += found[1:]
    assert headers >= 1 and len(lines) == 40
    assert [x[12] for x in lines] == sorted((r[11] for r in rows), reverse=True)
    assert {tuple(x) for x in lines} == {(*(v or "" for v in r[:8]), "aperta" if r[7] else "scadenza sconosciuta", *r[8:]) for r in rows}
    assert {tuple(r) for r in reports.read_export(spark, f"{scratch}/csv").collect()} == {tuple(x) for x in lines}
