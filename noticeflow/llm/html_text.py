"""HTML extraction: templates deduced from equivalence classes of tokens over the pages of a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import text_of
from noticeflow.llm.tables import bit_tables, level_of
from noticeflow.session import cut_lineage

LEAST_PAGES = 3        # a host with fewer pages takes the template of all hosts
LEAST_SHARE = 0.5      # share of a host's pages that a class occurs on
TEXT_SHARE = 0.8       # and a text run, which also needs TEXT_PAGES
TEXT_PAGES = 10
LEAST_CLASS = 2        # tokens of a class
BROADCAST_TOKENS = 200_000

EVERYWHERE = "*"

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math select button canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
OWN_KIND = frozenset("li dt dd tr td th option".split())
MAIN = frozenset(("article", "main"))
BESIDE = frozenset("nav header footer aside form menu dialog head".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
BESIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|"
    r"footer|sidebar|side|aside|widget|cookie|cookies|consent|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|"
    r"related|recommended|comment|comments|commentlist|disqus|reply|replies|form|search|pagination|pager|skip)(?:$|[\s_-])", re.IGNORECASE)

# names of wrappers do not speak of what they hold, but for these
HELD_NAMES = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|reply|replies|related|recommended)(?:$|[\s_-])", re.IGNORECASE)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'">]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    path: int
    beside: bool
    main: bool
    wrapped: bool = False   # beside by nothing but the names of wrappers, or a form around the page


def _name(*parts) -> int:
    """A 64-bit name of a token; the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


_paths: dict[tuple, tuple[int, bool, bool, bool]] = {}


def _enter(parent: Node | None, tag: str, attributes: str, through: bool = False) -> Node:
    """The element's place: its path of tags, classes and ids, and whether it stands beside the main text.

    With ``through`` an article or main element does not share the fate of wrappers around it.
    """
    key = (parent.path if parent else 0, tag, attributes if "=" in attributes else "")
    known = _paths.get(key)
    if known is None:
        found = {n.lower(): " ".join((a or b or c).lower().split()) for n, a, b, c in _ATTRIBUTE.findall(attributes)}
        label = f"{found.get('class', '')} {found.get('id', '')}"
        strictly = tag in BESIDE or found.get("role", "") in BESIDE_ROLES
        beside = strictly or (tag not in ("body", "html") and tag not in MAIN and bool(BESIDE_NAMES.search(label)))
        wrapper = beside and (not strictly or tag == "form") and not HELD_NAMES.search(label)
        stable = re.sub(r"\d+", "0", label)
        known = (_name(key[0], tag, stable), beside, tag in MAIN or found.get("role") == "main", wrapper)
        if len(_paths) > 100_000:
            _paths.clear()
        _paths[key] = known
    path, own, main, wrapper = known
    if parent is None:
        return Node(tag, path, own, main, wrapper)
    if through and main and not own and parent.beside and parent.wrapped:
        return Node(tag, path, False, True)
    # a page's own header inside its article belongs to the text
    beside = parent.beside or (own and not (tag == "header" and parent.main))
    wrapped = beside and (wrapper or not own) and (parent.wrapped or not parent.beside)
    return Node(tag, path, beside, main or parent.main, wrapped)


def events(page: str, through: bool = False) -> Iterator[tuple[str, Node | None, str]]:
    """The page as (kind, element, text): ``open`` and ``close`` of elements, ``break`` and ``text``; raw elements are left out."""
    stack: list[Node] = []
    at, end = 0, len(page)

    def leave(count: int):
        while len(stack) > count:
            yield "close", stack.pop(), ""

    for match in iter(lambda: _TAG.search(page, at), None):
        if match.start() > at:
            yield "text", stack[-1] if stack else None, page[at:match.start()]
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    yield from leave(i)
                    break
            else:
                if tag not in INLINE:
                    yield "break", None, ""
            continue
        attributes = match[3] or match[6] or ""
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(f"</{re.escape(tag)}[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
            continue
        if tag in VOID:
            if tag not in INLINE:
                yield "break", None, ""
            continue
        if tag in CLOSES_P or tag in OWN_KIND:
            same = "p" if tag in CLOSES_P else tag
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == same:
                    yield from leave(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        stack.append(_enter(stack[-1] if stack else None, tag, attributes, through))
        yield "open", stack[-1], ""
        if attributes.endswith("/") and tag not in INLINE:
            yield from leave(len(stack) - 1)
    if at < end:
        yield "text", stack[-1] if stack else None, page[at:]
    yield from leave(0)


def host_of(url: str | None) -> str:
    match = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return match[1].lower() if match else ""


@dataclass
class Block:
    """Text between two block boundaries; ``slot`` counts the template tokens before it."""

    path: int
    main: bool
    slot: int
    text: str


def blocks(page: str, template: frozenset[int] = frozenset(), through: bool = False) -> Iterator[Block]:
    """The blocks of a page that do not stand beside the main text, character references decoded."""
    parts: list[str] = []
    first, slot = None, 0

    def block() -> Iterator[Block]:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            yield Block(first.path if first else 0, bool(first and first.main), slot, text)
        parts.clear()

    place: list[Node] = []
    for kind, node, text in events(page, through):
        if kind == "text":
            if not (node and node.beside):
                if not parts:
                    first = place[-1] if place else None
                parts.append(text)
        elif kind == "break" or node.tag not in INLINE:
            yield from block()
            if kind == "open":
                place.append(node)
            elif kind == "close" and place:
                place.pop()
            if kind != "break" and node.path in template:
                slot += 1
    yield from block()


def page_tokens(page: str) -> tuple[dict[int, int], dict[int, int]]:
    """Occurrences of the element tokens, and of the text tokens (whole blocks), on a page."""
    tags: dict[int, int] = {}
    texts: dict[int, int] = {}
    for kind, node, _ in events(page):
        if kind == "open":
            tags[node.path] = tags.get(node.path, 0) + 1
    for block in blocks(page):
        name = _name(block.path, block.text)
        texts[name] = texts.get(name, 0) + 1
    return tags, texts


_COUNTS = "host string, token long, is_text boolean, pages long, vector long"
_MASK = (1 << 64) - 1


def _token_counts(pages: DataFrame) -> DataFrame:
    """Per part of the pages: on how many each token occurs, and a fingerprint of its occurrence vector.

    The fingerprint adds up a hash of (page, occurrences), so it does not matter where a page is read
    and tokens with equal vectors have equal sums.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int, bool], list[int]] = {}
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host, me = host_of(url), _name(url, page)
                tags, texts = page_tokens(page)
                for tokens, is_text in ((tags, False), (texts, True)):
                    for token, times in tokens.items():
                        mark = _name(me, times)
                        for place in ((host,) if is_text else (host, EVERYWHERE)):
                            held = found.setdefault((place, token, is_text), [0, 0])
                            held[0] += 1
                            held[1] += mark
                for place in (host, EVERYWHERE):
                    held = found.setdefault((place, 0, False), [0, 0])
                    held[0] += 1
                    held[1] += _name(me, 1)
            keys, sums = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
                pa.array([k[2] for k in keys], pa.bool_()), pa.array([s[0] for s in sums], pa.int64()),
                pa.array([((s[1] + (1 << 63)) & _MASK) - (1 << 63) for s in sums], pa.int64()),
            ], ["host", "token", "is_text", "pages", "vector"])

    return pages.mapInArrow(run, _COUNTS)


def _different(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages (url, html) in two parts: those whose host and html occur once, where they lie, and one of each of the rest.

    A table of fixed size tells which may occur again, so only these move; what it lets pass by mistake is moved for nothing.
    """
    keyed = pages.select("url", "html", _host().alias("_host"), F.xxhash64("html").alias("_hash")).withColumn("_key", F.xxhash64("_host", "_hash"))
    again = keyed.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    table = pages.sparkSession.sparkContext.broadcast(bit_tables(again.select("key", F.lit(1).alias("level")), 1))

    def part(more: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = level_of(table.value, batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64)) > 0
                yield batch.filter(pa.array(known == more))
        return keyed.mapInArrow(run, keyed.schema)

    return part(False).select("url", "html"), part(True).dropDuplicates(["_host", "_hash"]).select("url", "html")


def _host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame) -> DataFrame:
    """One row per host (and one for all): the tokens of its template, and the class of each.

    Pages of a host with the same html count once.
    Tokens with the same occurrence vector over the host's pages are a class.  Classes of LEAST_CLASS
    tokens or more that occur on LEAST_SHARE of the pages make up the template; text runs have to be on
    TEXT_SHARE of at least TEXT_PAGES pages.  As each of its tokens is on half of the pages, a template has
    at most twice as many as an average page.
    """
    # wrapping sums: fingerprints are numbers mod 2**64
    half = F.lit(1 << 32)
    once, first = _different(pages)
    counts = _token_counts(once).union(_token_counts(first)).groupBy("host", "token", "is_text").agg(
        F.sum("pages").alias("pages"),
        F.sum(F.pmod("vector", half)).alias("low"), F.sum(F.shiftright("vector", 32)).alias("high"),
    ).withColumn("vector", F.concat_ws(":", F.pmod("low", half), F.pmod(F.col("high") + F.shiftright("low", 32), half)))
    counts = cut_lineage(counts.select("host", "token", "is_text", "pages", "vector"))
    hosts = counts.filter("token = 0 AND NOT is_text").select("host", F.col("pages").alias("all_pages"))
    often = counts.filter("token <> 0").join(hosts, "host").filter(
        f"all_pages >= {LEAST_PAGES} AND pages >= {LEAST_SHARE} * all_pages AND "
        f"(NOT is_text OR (all_pages >= {TEXT_PAGES} AND pages >= {TEXT_SHARE} * all_pages))")
    classes = often.groupBy("host", "pages", "vector").agg(F.collect_set("token").alias("tokens")).filter(F.size("tokens") >= LEAST_CLASS)
    return cut_lineage(classes.select("host", F.explode("tokens").alias("token"), F.xxhash64("pages", "vector").alias("class")).groupBy("host").agg(
        F.collect_list("token").alias("tokens"), F.collect_list("class").alias("classes")))


def _crossed(marks: list[tuple[int, int]]) -> set[int]:
    """Classes that are not valid on a page: element spans of their tokens cross those of another class.

    ``marks`` are (class, +1 or -1) at every opening and closing of a template element, in page order.
    """
    open_: list[int] = []
    crossed: set[int] = set()
    for name, step in marks:
        if step > 0:
            open_.append(name)
        elif open_ and open_[-1] == name:
            open_.pop()
        elif name in open_:
            crossed.add(name)
            open_.remove(name)
    return crossed


def main_text(page: str, template: dict[int, int]) -> str:
    """The text in the template's slots that hold the main text.

    The page is read along the template: valid classes nest, what lies between two of their tokens is a
    slot.  Slots inside the page's article or main element hold the text (without one, all slots do),
    unless they or an element in them stand beside it: menus, headers, footers, side bars, notices,
    adverts, forms, readers' comments.  A block of text that is itself a template token fills no
    slot, unless all of the article's blocks are.
    """
    marks = [(template[n.path], 1 if kind == "open" else -1) for kind, n, _ in events(page) if kind in ("open", "close") and n.path in template]
    crossed = _crossed(marks)
    tokens = frozenset(t for t, c in template.items() if c not in crossed)
    slots: dict[int, list[Block]] = {}
    found = list(blocks(page, tokens))
    if not any(b.main for b in found):
        # the article may stand in a wrapper whose name only says how the page is laid out, or in a form around it all
        inside = [b for b in blocks(page, tokens, through=True) if b.main]
        if sum(len(b.text) for b in inside) > sum(len(b.text) for b in found):
            found = inside
    new = [b for b in found if _name(b.path, b.text) not in tokens]
    # where a template holds all of the article, its blocks are the text
    if any(b.main for b in found) and not any(b.main for b in new):
        new = [b for b in found if b.main]
    for block in new or found:
        slots.setdefault(block.slot, []).append(block)
    filled = [b for slot in slots.values() for b in slot]
    main = [b for b in filled if b.main]
    return " ".join(b.text for b in main or filled)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html counts as empty and gives an empty text, a null url is a host of its own, repeated rows are
    extracted each, broken markup is read as browsers do in the common cases.  Pages of hosts with fewer
    than LEAST_PAGES pages are read along the template of all pages.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    found = templates(rows.select("url", "html"))
    everywhere = found.filter(F.col("host") == EVERYWHERE).select(F.col("tokens").alias("tokens_all"), F.col("classes").alias("classes_all"))
    common = everywhere.first()  # the template of all pages: at most twice an average page's tokens
    common = dict(zip(common.tokens_all, common.classes_all, strict=True)) if common else {}
    # the templates are sent to all tasks while they are small, else pages meet them by host
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    joined = rows.withColumn("host", _host()).join(F.broadcast(found) if size <= BROADCAST_TOKENS else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, int]] = {}
        for batch in batches:
            texts = []
            for host, tokens, classes, page in zip(*[batch.column(c).to_pylist() for c in ("host", "tokens", "classes", "html")], strict=True):
                if host not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[host] = dict(zip(tokens, classes, strict=True)) if tokens else common
                texts.append(main_text(page, known[host]))
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "host", "tokens", "classes", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
