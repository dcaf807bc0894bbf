import html
import random
from datetime import date, datetime, timezone
from email.utils import parsedate_to_datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions import dates, keys, text, web


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalisation_equals_unicode_folding(spark):
    samples = ["È l’accordo_di-concessione… ﬁne ½ º Ⅷ ＡＢ １２", "plain ascii-text_x 'q'", "dell�incarico perché 𝐀𝐛 ´x",
               "  a\x1cb c\xa0d\x85e  f", "", "İstanbul ǅ ß Σας ﷺ ㎏ ⑴", "çá ‘x’ `y` z_z"]
    assert column(spark, samples, text.normalize_text) == [text.normalize_term(s) for s in samples]


def test_exact_fold_also_covers_hangul(spark):
    samples = ["한글 Àé", "l’a"]
    assert column(spark, samples, text.exact_fold()) == [text.normalize_term(s) for s in samples]


def test_golden_spellings_meet(spark):
    pairs = ["dell�incarico", "dell'incarico", "pubblicità", "pubblicita", "decreto-nomina_rup", "decreto nomina rup"]
    out = column(spark, pairs, text.normalize_text)
    assert out[0] == out[1] and out[2] == out[3] and out[4] == out[5]


def test_duplicate_terms_count_twice(spark):
    hits = column(spark, ["richiesta disponibilità"], lambda c: text.term_hits(
        text.normalize_text(c), ("richiesta disponibilita", "richiesta disponibilità")))
    assert hits == [["richiesta disponibilita"] * 2]


def test_html_unescape_equals_stdlib(spark):
    samples = ["a &amp;lt; b &lt; &#38;amp; &notit; &notin; &euro; &#8364; &#x1F600; &#128; &#0; x&y &copy &copyx; &quot;",
               "no", "&&amp;&#xD800; &lt&lt; &zz; &AMP &#38", "&#1114112; &#13; &#127;", ""]
    assert column(spark, samples, text.html_unescape) == [html.unescape(s) for s in samples]


def test_url_join_equals_stdlib(spark):
    bases = ["http://h.it/a/b?x=1#z", "http://h.it", "http://h.it/a/", "https://h.it/a/b/c", "http://h.it/a//b/c"]
    refs = ["", "x", "/y", "//k.it/z", "?q=1", "#f", "../u", "./v/", "../../../w", "http://z/q", "mailto:a@b", "a//b", "d/../e", "..", "x y.pdf"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in rows.select("b", "r", web.url_join(F.col("b"), F.col("r")).alias("j")).collect():
        assert row.j == urljoin(row.b, row.r), (row.b, row.r)


@pytest.mark.parametrize("sentence, due, clock", [
    ("entroenonoltreleore 12.00 del 29giugno 2026", date(2026, 6, 29), "12:00"),
    ("entro le ore 06.07.2026 ore 8.00", date(2026, 7, 6), "08:00"),
    ("entro le ore 30/06/2026, tramite PEC", date(2026, 6, 30), None),
    ("entro e non oltre le ore 12:00 del giorno venerdì 04/07//2026", date(2026, 7, 4), "12:00"),
    ("entro le ore 13 del giorno sabato 4 luglio 2026", date(2026, 7, 4), "13:00"),
    ("entro le ore 24:00 di venerdì 19/6/26", date(2026, 6, 19), None),
    ("entro le ore 10:75 del 19/6/2026", date(2026, 6, 19), None),
    ("entro le ore 31/02/2026 ore 10", None, None),
    ("entro le ore 9 del 5 maggio 1999", None, None),
    ("entro il settimo giorno dalla data di pubblicazione", None, None),
])
def test_deadline(spark, sentence, due, clock):
    found = column(spark, [sentence], lambda c: dates.application_deadline(text.normalize_text(c)))[0]
    assert (found and found["date"], found and found["time"]) == (due, clock)


def test_published_date(spark):
    samples = ["Prot. 4625 dell'8 maggio 2026", "pubblicato in data 3/4/2026 prot. n. 5 del 1/1/2025", "pubblicata il 9 marzo 2026", "nulla"]
    out = column(spark, samples, lambda c: dates.published_date(text.normalize_text(c)))
    assert out == [date(2026, 5, 8), date(2026, 4, 3), date(2026, 3, 9), None]


def test_platform_dates(spark):
    samples = ["29/06/2026", "2026-06-29T10:00", "29-6-2026", "29.06.2026 ore", "Mon, 29 Jun 2026 23:30:00 +0200", "29 Jun 26 10:00",
               "garbage", "", "5/7/2026", "31/02/2026", "Mon, 29 Jun 2026 25:30:00 +0200", "29 Jun 2026"]
    day = date(2026, 6, 29)
    assert column(spark, samples, dates.parse_notice_date) == [day, day, day, day, day, day, None, None, date(2026, 7, 5), None, None, None]
    assert parsedate_to_datetime(samples[4]).date() == day


def test_deadline_clock_is_rome(spark):
    def passed(sentence, as_of):
        return column(spark, [sentence], lambda c: dates.deadline_passed(dates.application_deadline(text.normalize_text(c)), as_of))[0]

    timed, dated = "entro le ore 12:00 del 15/06/2026", "entro le ore 15/06/2026"
    assert not passed(timed, datetime(2026, 6, 15, 10, 0, 0))
    assert passed(timed, datetime(2026, 6, 15, 10, 0, 1))
    assert passed(timed, datetime(2026, 6, 15, 10, 0, 1, tzinfo=timezone.utc))
    assert not passed(dated, datetime(2026, 6, 15, 21, 59))
    assert passed(dated, datetime(2026, 6, 15, 22, 1))


def test_open_status_default_and_strict(spark):
    samples = ["15/07/2026 12:00", "15/07/2026", "2020-01-01", "presto", None]
    today = date(2026, 7, 1)
    assert column(spark, samples, lambda c: dates.open_status(c, today)) == [
        "aperta", "aperta", "scaduta", "scadenza sconosciuta", "scadenza sconosciuta"]
    assert column(spark, samples, lambda c: dates.open_status(c, today, strict=True))[0] == "scadenza sconosciuta"


def test_three_expiry_boundaries(spark):
    today = date(2026, 6, 15)
    assert column(spark, ["15/06/2026", "16/06/2026", "", "n.d."], lambda c: dates.expired_by_metadata(c, today)) == [True, False, False, False]
    assert column(spark, ["15/06/2026"], lambda c: dates.open_status(c, today)) == ["aperta"]


def test_search_window(spark):
    today = date(2026, 6, 15)
    out = column(spark, ["08/06/2026", "07/06/2026", "", "boh"], lambda c: dates.outside_window(F.lit("Search"), c, today))
    assert out == [False, True, False, False]
    assert column(spark, ["01/01/2020"], lambda c: dates.outside_window(F.lit("Argo"), c, today)) == [False]


def test_verdict_lines(spark):
    lines = ["MATCH | high | tipo | 15/07/2026 | motivo", "match | certa", "IGNORE | no", "", None]
    out = column(spark, lines, lambda c: keys.parse_verdict_line(c, F.lit("esperti")))
    assert tuple(out[0]) == (True, "high", "motivo", "tipo", "15/07/2026")
    assert tuple(out[1]) == (True, "medium", "match | certa", "esperti", "non specificata")
    assert tuple(out[2])[:3] == (False, "low", "AI rejected candidate: IGNORE | no")
    assert out[3][0] is False and out[4] is None


def test_actionable(spark):
    samples = ["presentare la propria candidatura", "si autorizza l avvio della procedura di candidatura", "visto decreta", "domanda"]
    assert column(spark, samples, lambda c: keys.is_actionable(c, F.lit(None).cast("boolean"))) == [True, False, False, True]
    assert column(spark, ["domanda"], lambda c: keys.is_actionable(c, F.lit(False))) == [False]


def test_protocol_and_amount(spark):
    assert column(spark, ["prot. n. 12 del 8/5/2026", "protocollo 7 del 1.2.26", "niente"], keys.protocol_ref) == ["12|8/5/2026", "7|1.2.26", None]
    assert column(spark, ["49.168,00", "1 049.168,50"], keys.normalize_amount) == ["49168.00", "1049168.50"]


def test_platform_fingerprints(spark):
    pages = ["<a href='https://web.spaggiari.eu/sdg2/Trasparenza/NOIT1'>", "{&quot;custcode&quot; : &quot;AB1&quot;}", "x CUSTOMERCODE=sg9&z",
             "<script src=MADISOFT>", "nothing", "albo_pretorio.php?sede_codice=Q1 customerCode=Z"]
    out = column(spark, pages, lambda c: web.detect_platform(c, F.lit("SC1")))
    assert [tuple(r) for r in out] == [("Spaggiari", "NOIT1"), ("Spaggiari", "AB1"), ("Argo", "sg9"), ("Nuvola", "SC1"), ("", ""), ("Spaggiari", "Q1")]


def test_markup_of_any_length(spark):
    long = "x" * 1_000_000
    assert column(spark, [f"<a>{long}</a>"], web.xml_to_text) == [long]
    assert column(spark, [f"<p>a</p><b {long}", f"<b title='{long}'>in</b>"], web.html_to_text) == [f"a <b {long}", "in"]
    found = column(spark, [f"<a {long} href='/x'>go</a><a {long}"], web.anchors)
    assert [(a.href, a.label) for a in found[0]] == [("/x", "go")]


def test_numeric_entities_of_any_length(spark):
    samples = ["&#00000000000065;B", "&#x000000000000041;", "&#99999999999999;", "&#xFFFFFFFFFFFF;", "&#000;", "&#65 &#x41"]
    assert column(spark, samples, text.html_unescape) == [html.unescape(s) for s in samples]


def test_content_is_sniffed_behind_any_blanks(spark):
    from noticeflow.sources.documents import sniff_content

    blank = b" \n" * 5000
    rows = spark.createDataFrame([(0, blank + b"%PDF-1.7"), (1, blank + b"<?xml version='1.0'?>"), (2, blank)], "i int, c binary")
    kinds = rows.select("i", sniff_content(F.col("c"), F.lit("a.pdf"), F.lit("")).alias("k")).orderBy("i").collect()
    assert [r.k for r in kinds] == ["pdf", "xml", "html"]


def test_long_lists_are_found_in_one_pass(spark):
    """Overlapping, nested and repeated terms, and characters that patterns give a meaning."""
    rng = random.Random(1)
    for size in (3, text.ONE_PASS_TERMS + 5):
        terms = tuple("".join(rng.choice("ab.-+ ^]\\$(") for _ in range(rng.randint(1, 5))) for _ in range(size))
        rows = [("".join(rng.choice("ab.-+ ^]\\$(") for _ in range(rng.randint(0, 30))),) for _ in range(300)]
        df = spark.createDataFrame(rows + [(None,), ("",)], "x string")
        for r in df.select("x", text.term_hits(F.col("x"), terms, False).alias("hits"), text.has_any(F.col("x"), terms, False).alias("some")).collect():
            assert r.hits == [t for t in terms if t in (r.x or "")]
            assert r.some is None if r.x is None else r.some == any(t in r.x for t in terms)


def test_terms_are_looked_for_by_their_stems(spark):
    lists = [vocab.CALL_CORE_TERMS, vocab.STRONG_NEGATIVE_TERMS + vocab.NEGATIVE_TERMS, ("mepa", "selezione", "selezione esperti", "selezione", "a")]
    for terms in lists:
        listed = tuple(text.normalize_term(t) for t in terms)
        found, of = text.stems(listed)
        assert len(found) < len(listed) and all(found[i] in t for t, i in zip(listed, of, strict=True))
        texts = [None, "", *listed, " x ".join(listed), " ".join(t[1:] for t in listed), *(s for s in found)]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = {r.i: r.h for r in df.select("i", text.term_hits(F.col("t"), terms).alias("h")).collect()}
        assert [got[i] for i in range(len(texts))] == [[t for t in listed if t in (x or "")] if x is not None else [] for x in texts]


def test_separators_and_white_space_collapse_together(spark):
    raw = ["A - B__c\t'd`\r\n e", "-_'`", "È l’ora – di_-_\x1cfine", "a\x0b-\x0cb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", text.normalize_text(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(raw))] == [text.normalize_term(t) for t in raw]
