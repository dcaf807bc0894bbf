"""Text functions: accent folding, whitespace, vocabulary hits, HTML entities."""

import re
import sys
import unicodedata
from functools import lru_cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow import vocab

_SEPARATORS = "’‘´`'�_-"
_ASCII_SEPARATORS = "`'_-"
_ASCII_WS = r"[\t-\r\x1c-\x20]+"
_ANY_WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def normalize_term(term: str) -> str:
    """Driver-side twin of :func:`normalize_text`, for the (small) vocabularies."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", term) if not unicodedata.combining(c))
    spaced = bare.translate(str.maketrans(dict.fromkeys(_SEPARATORS, " ")))
    return " ".join(spaced.lower().split())


def _char_class(points: list[int]) -> str:
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str, str]:
    """Compatibility folding derived from the Unicode database.

    Returns (source characters, replacement characters, class of characters that expand,
    expansions as a str_to_map literal).  Hangul syllables stay composed: they cannot touch a
    Latin vocabulary; :func:`exact_fold` covers them.
    """
    source, target, removed, expanding, expansions = [], [], [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= point <= 0xDFFF or 0xAC00 <= point <= 0xD7A3:
            continue
        char = chr(point)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if char in _SEPARATORS or (point >= 0x80 and char.isspace()):
            folded = " "
        if folded == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif folded:
            expanding.append(point)
            expansions.append(f"{char}\x02{folded}")
        else:
            removed.append(char)
    return "".join(source + removed), "".join(target), _char_class(expanding), "\x01".join(expansions)


def fold_marks(c: Column) -> Column:
    """NFKD without combining marks, separators as spaces; pure-ASCII values take a short path."""
    return let(c, _fold)


def _fold(c: Column) -> Column:
    """ASCII values need four replacements; others one more per distinct character that folds."""
    return reduce(lambda acc, s: F.replace(acc, F.lit(s), F.lit(" ")), _ASCII_SEPARATORS, _unmarked(c))


def _unmarked(c: Column) -> Column:
    """Without combining marks, separators beyond ASCII as spaces."""
    source, target, expanding, expansions = _fold_tables()
    table = F.str_to_map(F.lit(expansions), F.lit("\x01"), F.lit("\x02"))

    def folded(char: Column) -> Column:
        return F.when(char.rlike(expanding), F.element_at(table, char)).otherwise(
            F.translate(char, source, target))

    characters = F.array_distinct(F.split(F.regexp_replace(c, r"[\x00-\x7f]+", ""), ""))
    pairs = F.transform(characters, lambda ch: F.struct(ch.alias("char"), folded(ch).alias("to")))
    changed = F.filter(pairs, lambda p: p["char"] != p["to"])
    beyond = F.aggregate(changed, c, lambda acc, p: F.replace(acc, p["char"], p["to"]))
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, c).otherwise(beyond)


def normalize_text(c: Column) -> Column:
    """Fold accents, turn apostrophes, dashes and underscores into spaces, lower, collapse."""
    # separators become spaces and runs of these one space: both in one pass
    return F.trim(F.regexp_replace(F.lower(let(c, _unmarked)), f"[{re.escape(_ASCII_SEPARATORS)}{_ASCII_WS[1:]}", " "))


def exact_fold():
    """Opt-in Arrow UDF with the interpreter's own NFKD (adds Hangul to :func:`normalize_text`)."""
    import pandas as pd

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(normalize_term, na_action="ignore")

    return fold


def let(value: Column, body) -> Column:
    """Bind an expression once and use it in ``body``; keeps large expressions from being repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse_ws(c: Column) -> Column:
    """Every run of Unicode white space becomes one space, ends trimmed."""
    return let(c, _collapse)


def _collapse(c: Column) -> Column:
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.trim(F.when(ascii_only, F.regexp_replace(c, _ASCII_WS, " ")).otherwise(
        F.regexp_replace(c, _ANY_WS, " ")))


def joined(*parts: Column) -> Column:
    """Space-join of already normalised parts, empty ones left out."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def term_array(terms, normalized: bool = True) -> Column:
    """A vocabulary as one constant array; duplicates are kept because hit counts depend on them."""
    if not terms:
        return F.array().cast("array<string>")
    values = [normalize_term(t) for t in terms] if normalized else list(terms)
    return F.split(F.lit("\n".join(values)), "\n")


ONE_PASS_TERMS = 40   # from so many terms on, one factored pattern reads a text faster than a look for each term


@lru_cache(maxsize=64)
def factored(terms: tuple[str, ...]) -> str:
    """One pattern for all terms, factored by common beginnings; it finds the longest term at a place."""
    tree: dict = {}
    for term in terms:
        node = tree
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        tails: dict[str, list[str]] = {}
        for c, below in node.items():
            if c:
                tails.setdefault(pattern(below), []).append(re.escape(c))
        parts = [(cs[0] if len(cs) == 1 else "[" + "".join(cs) + "]") + tail for tail, cs in tails.items()]
        if not parts:
            return ""
        body = "|".join(parts)
        return f"(?:{body})?+" if "" in node else body if len(parts) == 1 else f"(?:{body})"

    first = "".join(re.escape(c) for c in tree if c)
    return f"(?=[{first}])" + pattern(tree) if first else "(?!)"


def _listed(terms, normalized: bool) -> tuple[str, ...]:
    return tuple(filter(None, dict.fromkeys(map(normalize_term, terms) if normalized else terms)))


STEM_CHARS = 5   # a text without the stem of some terms, a part of so many characters they share, is not searched for them


@lru_cache(maxsize=64)
def stems(terms: tuple[str, ...]) -> tuple[tuple[str, ...], tuple[int, ...]]:
    """Few texts of which every term contains one, and which one it is for each term."""
    parts = [{t[a:b] for a in range(len(t)) for b in range(a + STEM_CHARS, len(t) + 1)} or {t} for t in terms]
    found: list[str] = []
    of: dict[int, int] = {}
    while len(of) < len(terms):
        shared: dict[str, int] = {}
        for i, own in enumerate(parts):
            for part in own if i not in of else ():
                shared[part] = shared.get(part, 0) + 1
        best = max(shared, key=lambda part: (shared[part], len(part), part))
        of |= {i: len(found) for i, own in enumerate(parts) if i not in of and best in own}
        found.append(best)
    return tuple(found), tuple(of[i] for i in range(len(terms)))


def term_hits(text: Column, terms, normalized: bool = True) -> Column:
    """Vocabulary terms contained in the text, in vocabulary order; terms are looked for where their stem was found."""
    listed = term_array(terms, normalized)
    if not terms:
        return listed
    parts, of = stems(tuple(map(normalize_term, terms)) if normalized else tuple(terms))
    which = F.array(*map(F.lit, of))
    return let(text, lambda x: let(
        F.transform(term_array(parts, False), lambda part: F.contains(x, part)),
        lambda there: F.filter(listed, lambda t, i: F.get(there, F.get(which, i)) & F.contains(x, t))))


def among(hits: Column, terms) -> Column:
    """Terms of a vocabulary that are in an array of hits, in vocabulary order."""
    return let(hits, lambda found: F.filter(term_array(terms), lambda t: F.array_contains(found, t)))


def has_any(text: Column, terms, normalized: bool = True) -> Column:
    if len(terms) >= ONE_PASS_TERMS:
        return text.rlike(factored(_listed(terms, normalized)))
    return let(text, lambda x: F.exists(term_array(terms, normalized), lambda t: F.contains(x, t)))


def first_non_empty(*cols: Column) -> Column:
    """First column that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))



def truncate_text(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit)


def replacement_ratio(c: Column) -> Column:
    """Share of U+FFFD among the characters; 0 for empty text."""
    bad = F.length(c) - F.length(F.replace(c, F.lit("�"), F.lit("")))
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(bad / F.length(c))


def split_addresses(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


@lru_cache(maxsize=1)
def _entity_tables() -> tuple[str, str]:
    table = "\x01".join(f"&{name}\x02{value}" for name, value in html5.items())
    open_names = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return table, "^(&(?:" + "|".join(map(re.escape, open_names)) + "))(.*)$"


def _code_point(token: Column) -> Column:
    """Character for ``&#n;`` / ``&#xh;``: Windows-1252 for 128-159, U+FFFD out of range."""
    is_hex = F.lower(F.substring(token, 3, 1)) == "x"
    # leading zeros do not count; what is left of more than eight digits is out of range
    digits = F.regexp_replace(token, "^&#[xX]?0*+|;$", "")
    digits = F.when(F.length(digits) > 8, F.lit("99999999")).when(digits == "", F.lit("0")).otherwise(digits)
    number = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
    windows = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))
    as_utf32 = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("�"))
        .when(number.between(0x80, 0x9F), F.substring(F.lit(windows), (number - 0x7F).cast("int"), F.lit(1)))
        .when((number < 0x20) & ~number.isin(9, 10, 12, 13) | (number == 0x7F), F.lit(""))
        .otherwise(as_utf32)
    )


def html_unescape(c: Column) -> Column:
    """Decode HTML entities once: every distinct entity in the value is replaced as a whole.

    Longer entities go first and a produced ``&`` is parked as U+FFFF, so nothing is decoded twice.
    """
    return let(c, _unescape)


def _unescape(c: Column) -> Column:
    table, open_prefix = _entity_tables()
    names = F.str_to_map(F.lit(table), F.lit("\x01"), F.lit("\x02"))

    def value(token: Column) -> Column:
        prefix = F.regexp_extract(token, open_prefix, 1)
        named = F.coalesce(
            names[token],
            F.when(prefix != "", F.concat(names[prefix], F.regexp_extract(token, open_prefix, 2))),
            token,
        )
        return F.when(F.substring(token, 2, 1) == "#", _code_point(token)).otherwise(named)

    tokens = F.array_distinct(F.regexp_extract_all(
        c, F.lit("&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"), F.lit(0)))
    longest_first = F.array_sort(tokens, lambda a, b: F.length(b) - F.length(a))
    decoded = F.aggregate(
        longest_first, c,
        lambda acc, t: F.replace(acc, t, F.replace(value(t), F.lit("&"), F.lit("￿"))),
    )
    return F.when(F.contains(c, F.lit("&")), F.replace(decoded, F.lit("￿"), F.lit("&"))).otherwise(c)


def confidence_word(c: Column) -> Column:
    pairs = [F.lit(x) for pair in vocab.CONFIDENCE_IT.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[c], c)


def yes_no(c: Column) -> Column:
    return F.when(c, F.lit("sì")).otherwise(F.lit("no"))
