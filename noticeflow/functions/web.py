"""URL, HTML and XML functions over stored pages, as built-in expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions.text import collapse_ws, html_unescape, let

_INVISIBLE = (
    r"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?[^>]*>"
    r"|<(script|style|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)"
)
# possessive runs: no step back and no nesting per character, however long a tag or text is
_TAG = r"""<(?:/?[a-zA-Z])(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
_ANCHOR = r"""(?is)<a\s((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>(.*?)(?:</a\s*>|(?=<a\s)|\z)"""
_HREF = r"""(?is)(?:^|\s)href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def visible_html(html: Column) -> Column:
    """HTML without comments, declarations, scripts and styles."""
    return F.regexp_replace(html, _INVISIBLE, " ")


def tag_text(fragment: Column) -> Column:
    """Text of a fragment: tags become spaces, entities are decoded, white space collapses."""
    return collapse_ws(html_unescape(F.regexp_replace(fragment, _TAG, " ")))


def html_to_text(html: Column) -> Column:
    return tag_text(visible_html(html))


def html_title(html: Column) -> Column:
    """<title>, else the first h1/h2, else a fixed label."""
    return let(visible_html(html), _title)


def _title(page: Column) -> Column:
    title = collapse_ws(html_unescape(F.regexp_extract(page, r"(?is)<title\b[^>]*>([^<]*)</title", 1)))
    heading = F.regexp_extract(page, r"(?is)<(h1|h2)\b[^>]*>(.*?)</\1\s*>", 2)
    return F.coalesce(
        F.nullif(title, F.lit("")),
        F.when(page.rlike(r"(?is)<h[12]\b"), tag_text(heading)),
        F.lit("Untitled page"),
    )


def xml_to_text(xml: Column) -> Column:
    """Texts that directly follow an opening tag, in document order; tails are left out.

    Callers choose :func:`html_to_text` for malformed input, see ``sources.documents``.
    """
    clean = F.regexp_replace(xml, r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    cdata = r"(?s)<!\[CDATA\[(.*?)\]\]>"
    texts = F.regexp_extract_all(
        clean, F.lit(r"(?s)<[A-Za-z_:][^<>]*(?<!/)>((?:[^<]++|<!\[CDATA\[.*?\]\]>)++)"), F.lit(1))
    decoded = F.transform(texts, lambda t: collapse_ws(
        F.when(F.contains(t, F.lit("<![CDATA[")), F.regexp_replace(t, cdata, "$1")).otherwise(html_unescape(t))))
    return F.array_join(F.filter(decoded, lambda t: t != ""), " ")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def url_host(url: Column) -> Column:
    """Network location, lower-cased, '' for relative references."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _resolve_dots(path: Column) -> Column:
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    plain = ~path.rlike(r"(^|/)\.\.?(/|$)")
    return F.when(plain, path).otherwise(F.array_join(closed, "/"))


def url_join(base: Column, ref: Column) -> Column:
    """Resolve a reference against its page, as browsers do (RFC 3986)."""
    return let(F.struct(base.alias("base"), ref.alias("ref")), lambda x: _join(x["base"], x["ref"]))


def _join(base: Column, ref: Column) -> Column:
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    suffix = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    beside = F.concat(F.regexp_extract(base_path, r"^(.*)/", 1), F.lit("/"), ref_path)
    rooted = F.when(F.left(ref_path, F.lit(1)) == "/", ref_path).otherwise(
        F.regexp_replace(beside, "/{2,}", "/"))
    path = F.regexp_replace(let(rooted, _resolve_dots), "^(?!/)", "/")
    return (
        F.when(ref == "", base)
        .when(url_scheme(ref) != "", ref)
        .when(F.left(ref, F.lit(2)) == "//", F.concat(url_scheme(base), F.lit(":"), ref))
        .when(F.left(ref, F.lit(1)) == "?", F.concat(origin, base_path, ref))
        .when(F.left(ref, F.lit(1)) == "#", F.concat(origin, base_path, base_query, ref))
        .otherwise(F.concat(origin, path, suffix))
    )


def url_clean(url: Column) -> Column:
    """Web URL without its fragment; null for mail, phone, script and other schemes."""
    return F.when(url_scheme(url).isin("http", "https"), F.regexp_extract(url, "(?s)^([^#]*)", 1))


def anchors(html: Column) -> Column:
    """array<struct<href, label>> of all anchors that carry an href, in page order."""
    found = F.regexp_extract_all(visible_html(html), F.lit(_ANCHOR), F.lit(0))
    parsed = F.transform(found, lambda a: F.struct(
        _attribute(F.regexp_extract(a, _ANCHOR, 1)).alias("href"),
        tag_text(F.regexp_extract(a, _ANCHOR, 2)).alias("label")))
    return F.filter(parsed, lambda x: x["href"].isNotNull() & (x["href"] != ""))


def _attribute(attributes: Column) -> Column:
    values = [F.nullif(F.regexp_extract(attributes, _HREF, i), F.lit("")) for i in (1, 2, 3)]
    return html_unescape(F.coalesce(*values))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def is_pdf_url(url: Column) -> Column:
    return F.endswith(F.lower(url), F.lit(".pdf"))


def looks_like_document(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.endswith(low, F.lit(".pdf")) | F.contains(low, F.lit("download"))
        | F.contains(low, F.lit("allegat")) | F.contains(low, F.lit("/documenti/"))
    )


def detect_platform(html: Column, school_code: Column) -> Column:
    """struct<vendor, albo_id> from the fingerprints in a page, by fixed priority; '' when none."""
    return let(html_unescape(html), lambda page: _fingerprint(page, school_code))


def _fingerprint(page: Column, school_code: Column) -> Column:
    first_id = F.coalesce(*[
        F.nullif(F.regexp_extract(page, vocab.SPAGGIARI_ID, i), F.lit("")) for i in (1, 2, 3)])
    second_id = F.coalesce(*[
        F.nullif(F.regexp_extract(page, vocab.ARGO_ID, i), F.lit("")) for i in (1, 2)])

    def pick(vendor: str, albo_id: Column) -> Column:
        return F.struct(F.lit(vendor).alias("vendor"), albo_id.alias("albo_id"))

    return (
        F.when(first_id.isNotNull(), pick("Spaggiari", first_id))
        .when(second_id.isNotNull(), pick("Argo", second_id))
        .when(F.contains(F.lower(page), F.lit(vocab.NUVOLA_MARK)), pick("Nuvola", school_code))
        .otherwise(pick("", F.lit("")))
    )
