"""Dates: platform dates, deadlines and publication dates written inside Italian documents.

Every "today" or "now" is a parameter, so runs can be replayed.
"""

from datetime import datetime, timezone
from functools import partial
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions.text import collapse_ws, let

ROME = ZoneInfo("Europe/Rome")

# --- fixed values: date and deadline patterns over normalised text ---------------------------
_TIME = r"(\d{1,2})\s*(?:[:.,]\s*(\d{2}))?"
_NUM_DATE = r"(\d{1,2})\s*[/.]\s*/?\s*(\d{1,2})\s*[/.]\s*/?\s*(\d{2,4})"
_WORD_DATE = r"(\d{1,2})\s*(" + "|".join(vocab.MONTHS_IT) + r")\s*(\d{4})"
_CONNECTOR = r"(?:del|di)\s*(?:giorno\s*)?(?:(?:" + "|".join(vocab.WEEKDAYS_IT) + r")\S*\s*)?"
_TIMED = r"entro\s*(?:e\s*non\s*oltre\s*)?le\s*ore\s*" + _TIME + r"\s*" + _CONNECTOR + r"\s*"
_HOUR_SLOT = r"entro\s*le\s*ore\s*"
_PUBLISHED = r"pubblicat[oa]\s*(?:il|in\s*data)?\s*"
_PROTOCOL = r"prot(?:ocollo)?\.?\s*n?\.?\s*\d+\s*de(?:l|ll)\s*"

# (pattern, index of the first date group, index of the first time group or 0)
DEADLINE_PATTERNS = (
    (_TIMED + _NUM_DATE, 3, 1),
    (_TIMED + _WORD_DATE, 3, 1),
    (_HOUR_SLOT + _NUM_DATE + r"\s*ore\s*" + _TIME, 1, 4),
    (_HOUR_SLOT + _WORD_DATE + r"\s*ore\s*" + _TIME, 1, 4),
    (_HOUR_SLOT + _NUM_DATE + r"(?!\s*ore)", 1, 0),
    (_HOUR_SLOT + _WORD_DATE + r"(?!\s*ore)", 1, 0),
)
PUBLISHED_PATTERNS = (
    (_PUBLISHED + _NUM_DATE, 1, 0),
    (_PUBLISHED + _WORD_DATE, 1, 0),
    (_PROTOCOL + _NUM_DATE, 1, 0),
    (_PROTOCOL + _WORD_DATE, 1, 0),
)
# --- fixed values: platform date shapes ---------------------------------------------------------
_PLATFORM_SHAPES = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1)),
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", (3, 2, 1)),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", (3, 2, 1)),
)
_MAIL_DATE = (
    r"(?i)^(?:[a-z]{3,9}\s*,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?(\d{1,2})[ -]"
    r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ -](\d{4}|\d{2})\s+"
    r"(?:[01]?\d|2[0-3])[:.][0-5]?\d(?:[:.][0-5]?\d)?(?:\s|$)"
)
_MAIL_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _iso(year: Column, month: Column, day: Column) -> Column:
    """Calendar date from digit strings, null when it does not exist."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def _shaped_date(value: Column, pattern: str, order: tuple[int, int, int]) -> Column:
    year, month, day = (F.regexp_extract(value, pattern, i) for i in order)
    return F.when(value.rlike(pattern), _iso(year, month, day))


def parse_notice_date(c: Column) -> Column:
    """Platform date: four numeric shapes in the first ten characters, else a mail date.

    A mail date keeps its own calendar day; it is not moved to UTC.
    """
    return let(collapse_ws(c), _platform_date)


def _platform_date(value: Column) -> Column:
    head = F.left(value, F.lit(10))
    short_year = F.regexp_extract(value, _MAIL_DATE, 3)
    year = F.when(F.length(short_year) == 4, short_year).otherwise(
        F.concat(F.when(short_year < "69", F.lit("20")).otherwise(F.lit("19")), short_year))
    month = F.array_position(
        F.array(*map(F.lit, _MAIL_MONTHS)), F.lower(F.regexp_extract(value, _MAIL_DATE, 2))).cast("string")
    mail = F.when(value.rlike(_MAIL_DATE), _iso(year, month, F.regexp_extract(value, _MAIL_DATE, 1)))
    return F.coalesce(*[_shaped_date(head, p, o) for p, o in _PLATFORM_SHAPES], mail)


def to_iso_date(c: Column) -> Column:
    """Leading dd-MM-yyyy rewritten as yyyy-MM-dd text, '' when absent."""
    shape = r"^(\d{2})-(\d{2})-(\d{4})"
    parts = [F.regexp_extract(c, shape, i) for i in (3, 2, 1)]
    return F.when(c.rlike(shape), F.concat_ws("-", *parts)).otherwise(F.lit(""))


def _month_number(c: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, vocab.MONTHS_IT)), c)
    return F.when(named > 0, named.cast("string")).otherwise(c)


def _first_found(text: Column, patterns) -> Column:
    """First pattern whose date is real and plausible, as struct<date, time, raw>.

    Each pattern scans the text once; its groups are then read from the short matched piece.
    """
    return F.coalesce(*[
        let(F.regexp_extract(text, pattern, 0), partial(_parse_piece, pattern, date_at, time_at))
        for pattern, date_at, time_at in patterns])


def _parse_piece(pattern: str, date_at: int, time_at: int, raw: Column) -> Column:
    low, high = vocab.PLAUSIBLE_YEARS
    digits = F.regexp_extract(raw, pattern, date_at + 2)
    year = F.when(F.length(digits) == 2, F.concat(F.lit("20"), digits)).otherwise(digits)
    day = _iso(year, _month_number(F.regexp_extract(raw, pattern, date_at + 1)),
               F.regexp_extract(raw, pattern, date_at))
    clock = F.lit(None).cast("string")
    if time_at:
        hour = F.lpad(F.regexp_extract(raw, pattern, time_at), 2, "0")
        minute = F.coalesce(F.nullif(F.regexp_extract(raw, pattern, time_at + 1), F.lit("")), F.lit("00"))
        clock = F.when((hour < "24") & (minute < "60"), F.concat_ws(":", hour, minute))
    return F.when(raw != "", let(day, lambda d: F.when(
        F.year(d).between(low, high), F.struct(d.alias("date"), clock.alias("time"), raw.alias("raw")))))


def application_deadline(normalized: Column) -> Column:
    """Deadline stated in normalised text: struct<date, time 'HH:mm' or null, raw>, null if none."""
    return let(normalized, lambda t: F.when(
        F.contains(t, F.lit("entro")), _first_found(t, DEADLINE_PATTERNS)))


def published_date(normalized: Column) -> Column:
    """Publication date stated in normalised text, else the date of a protocol citation."""
    return let(normalized, lambda t: F.when(
        F.contains(t, F.lit("pubblicat")) | F.contains(t, F.lit("prot")), _first_found(t, PUBLISHED_PATTERNS)))["date"]


def rome_clock(as_of: datetime) -> datetime:
    """Wall clock in Rome; a naive value is taken as UTC."""
    return (as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)).astimezone(ROME)


def deadline_passed(deadline: Column, as_of: datetime) -> Column:
    """Timed deadlines pass after their minute in Rome; date-only ones stay open all day."""
    return let(deadline, lambda d: _passed(d, rome_clock(as_of)))


def _passed(deadline: Column, now: datetime) -> Column:
    today, clock = F.lit(now.date()), F.lit(now.strftime("%H:%M:%S.%f"))
    day, time = deadline["date"], F.concat(deadline["time"], F.lit(":00.000000"))
    late_today = F.coalesce((day == today) & (time < clock), F.lit(False))
    return F.coalesce((day < today) | late_today, F.lit(False))


def format_deadline(deadline: Column) -> Column:
    return F.concat_ws(" ", F.date_format(deadline["date"], "dd/MM/yyyy"), deadline["time"])


def deadline_display(deadline: Column, expires: Column, own: Column) -> Column:
    """Document deadline, else platform expiry, else the verdict's own wording."""
    return F.coalesce(
        let(deadline, lambda d: F.when(d.isNotNull(), format_deadline(d))),
        F.date_format(parse_notice_date(expires), "dd/MM/yyyy"),
        own,
    )


def has_deadline(c: Column) -> Column:
    return ~F.lower(F.trim(c)).isin(*vocab.UNKNOWN_DEADLINES)


def open_status(c: Column, today, strict: bool = False) -> Column:
    """Open / expired / unknown.  ``strict`` refuses a trailing time, as the archive export once did."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    if not strict:
        raw = F.regexp_replace(raw, r" \d{2}:\d{2}$", "")
    return let(let(raw, lambda r: F.coalesce(*[_shaped_date(r, p, o) for p, o in _PLATFORM_SHAPES[:3]])),
               lambda due: _status(due, today))


def _status(due: Column, today) -> Column:
    return (
        F.when(due < F.lit(today), vocab.STATUS_EXPIRED)
        .when(due.isNotNull(), vocab.STATUS_OPEN)
        .otherwise(vocab.STATUS_UNKNOWN)
    )


def days_apart(a: Column, b: Column) -> Column:
    """Absolute distance in days; an unknown date counts as just too far."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(vocab.NEAREST_THREAD_DAYS + 1))


def expired_by_metadata(expires: Column, today) -> Column:
    return F.coalesce(parse_notice_date(expires) <= F.lit(today), F.lit(False))


def outside_window(vendor: Column, published: Column, today) -> Column:
    """Dated search results older than the rolling window; undated ones pass."""
    old = parse_notice_date(published) < F.date_sub(F.lit(today), vocab.SEARCH_WINDOW_DAYS)
    return (F.lower(vendor) == "search") & F.coalesce(old, F.lit(False))


def enrich_published(published: Column, normalized: Column) -> Column:
    return F.coalesce(F.date_format(published_date(normalized), "dd/MM/yyyy"), published)
