"""Keys, verdict lines and small display rules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions.text import let, term_hits


def item_key(school_code: Column, item_id: Column) -> Column:
    return F.concat_ws("|", F.coalesce(school_code, F.lit("")), F.coalesce(item_id, F.lit("")))


def alert_key(school_code: Column, cup: Column, clp: Column, url: Column) -> Column:
    return F.lower(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (school_code, cup, clp, url)]))


def opportunity_key(school_code: Column, url: Column) -> Column:
    return F.lower(F.concat_ws("|", F.coalesce(school_code, F.lit("")), F.coalesce(url, F.lit(""))))


def normalize_amount(c: Column) -> Column:
    """"49.168,00" -> "49168.00"."""
    return F.translate(c, ", .", ".")


def protocol_ref(normalized: Column) -> Column:
    """"number|date" of the first protocol citation, null when there is none."""
    return let(F.regexp_extract(normalized, vocab.PROTOCOL, 0), lambda cited: F.when(
        cited != "", F.concat_ws("|", *[F.regexp_extract(cited, vocab.PROTOCOL, i) for i in (1, 2)])))


def role_signature(normalized: Column, roles=vocab.ROLE_TERMS) -> Column:
    return F.array_sort(term_hits(normalized, roles, normalized=False))


def is_actionable(normalized: Column, external: Column) -> Column:
    """Does the text tell a candidate how to apply?  ``external`` settles the unclear middle."""
    told = let(normalized, lambda t: (
        F.when(t.rlike(vocab.APPLY_INSTRUCTION), F.lit(True))
        .when(t.rlike(vocab.AUTHORISING_ONLY) | ~t.rlike(vocab.WEAK_APPLICATION), F.lit(False))))
    return F.coalesce(told, external, F.lit(True))


def answer_starts_with(answer: Column, word: str) -> Column:
    return F.startswith(F.upper(F.trim(answer)), F.lit(word))


def same_process_flag(answer: Column) -> Column:
    return answer_starts_with(answer, "STESSO")


def actionable_flag(answer: Column) -> Column:
    return answer_starts_with(answer, "AZIONABILE")


def parse_verdict_line(answer: Column, rule_type: Column) -> Column:
    """External answer -> struct<is_match, confidence, reason, opportunity_type, deadline>."""
    line = F.trim(answer)
    parts = F.transform(F.split(line, r"\|"), lambda p: F.trim(p))
    level = F.lower(F.get(parts, F.lit(1)))
    accepted = F.struct(
        F.lit(True).alias("is_match"),
        F.when(level.isin("high", "medium", "low"), level).otherwise(F.lit("medium")).alias("confidence"),
        F.coalesce(F.get(parts, F.lit(4)), line).alias("reason"),
        F.coalesce(F.get(parts, F.lit(2)), rule_type).alias("opportunity_type"),
        F.coalesce(F.get(parts, F.lit(3)), F.lit(vocab.DEFAULT_DEADLINE)).alias("deadline"),
    )
    refused = F.struct(
        F.lit(False).alias("is_match"), F.lit("low").alias("confidence"),
        F.concat(F.lit("AI rejected candidate: "), line).alias("reason"),
        F.lit(vocab.DEFAULT_TYPE).alias("opportunity_type"),
        F.lit(vocab.DEFAULT_DEADLINE).alias("deadline"),
    )
    return F.when(answer.isNull(), F.lit(None)).when(
        F.startswith(F.upper(line), F.lit("MATCH")), accepted).otherwise(refused)


def reply_subject(subject: Column) -> Column:
    return F.when(F.startswith(F.lower(subject), F.lit("re:")), subject).otherwise(
        F.concat(F.lit("Re: "), subject))


def http_outcome(error: Column) -> Column:
    """A failed fetch is final only when the document is gone (404); all others are retried."""
    return F.contains(error, F.lit("404"))
