"""Relevance rules: title prefilter, ordered rule verdict, external-score gate."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions import keys
from noticeflow.functions.text import among, has_any, joined, let, normalize_term, normalize_text, term_hits
from noticeflow.session import evaluate_once


def prefilter(title: Column, category: Column, strong=vocab.STRONG_PREFILTER_TERMS,
              project=vocab.PROJECT_CONTEXT_TERMS,
              weak=vocab.WEAK_PREFILTER_TERMS + vocab.CALL_TERMS) -> Column:
    """Cheap gate: a strong term, or a programme term together with a weak one."""
    return let(normalize_text(F.concat_ws(" ", title, category)), lambda t: (
        has_any(t, strong) | (has_any(t, project) & has_any(t, weak))))


def code_hits(text: Column, *codes: Column) -> Column:
    """Normalised, non-empty identifiers contained in the text."""
    wanted = F.array(*[normalize_text(F.coalesce(c, F.lit(""))) for c in codes])
    return let(text, lambda t: F.filter(wanted, lambda c: (c != "") & F.contains(t, c)))


def kind_window(title: Column, url: Column, text: Column, chars: int = vocab.KIND_WINDOW_CHARS) -> Column:
    """Early part of a document that tells what kind of act it is."""
    return normalize_text(F.concat_ws(" ", title, url, F.substring(text, 1, chars)))


def strong_negative(kind: Column, title: Column, hits: Column | None = None, terms=vocab) -> Column:
    """Closing or administrative signals in the kind window and in the normalised title.

    ``hits`` holds the window's terms when they were looked up before; ``terms`` are the caller's lists.
    """
    listed = term_hits(kind, terms.STRONG_NEGATIVE_TERMS) if hits is None else among(hits, terms.STRONG_NEGATIVE_TERMS)
    extra = F.array_compact(F.array(
        F.when(kind.rlike(terms.ROLE_ASSIGNMENT), F.lit(vocab.HIT_ROLE_ASSIGNMENT)),
        F.when(title.rlike(terms.STANDALONE_DECLARATION), F.lit(vocab.HIT_STANDALONE_DECLARATION)),
        F.when(title.rlike(terms.AUTHORISATION_REQUEST), F.lit(vocab.HIT_AUTHORISATION_REQUEST)),
    ))
    return F.concat(listed, extra)


def external_hits(text: Column, terms=vocab) -> Column:
    """External-candidate terms, the generic applicant checkbox left out."""
    return term_hits(F.regexp_replace(text, terms.APPLICANT_CHECKBOX, " "), terms.EXTERNAL_TERMS)


def internal_only(text: Column, internal: Column, external: Column, terms=vocab) -> Column:
    """Reserved to internal staff: no external term, or only as a fallback clause."""
    fallback = text.rlike(terms.EXTERNAL_FALLBACK_ONLY) & ~text.rlike(terms.EXTERNAL_ELIGIBILITY)
    return (F.size(internal) > 0) & ((F.size(external) == 0) | fallback)


def _top(hits: Column) -> Column:
    return F.array_join(F.slice(hits, 1, 3), ", ")


def with_rule_verdict(df: DataFrame, title: str = "title", url: str = "url", text: str = "text",
                      normalized: str | None = None, cup: str = "cup", clp: str = "clp", terms=vocab) -> DataFrame:
    """Add ``rule``: struct<is_match, confidence, reason, opportunity_type, deadline, ambiguous>.

    ``normalized`` names a column holding the normalised text when the caller has one already;
    ``terms`` are the lists to decide by, see :func:`noticeflow.vocab.own`.
    Each vocabulary scans a document at most once: the two rejecting lists share one look-up, and
    lists that an earlier rule makes irrelevant are not looked up at all.
    """
    body = F.col(normalized) if normalized else normalize_text(F.col(text))
    title_n, url_n = normalize_text(F.col(title)), normalize_text(F.col(url))
    staged = df.withColumn("_title", title_n).withColumn("_full", joined(F.col("_title"), url_n, body))
    staged = evaluate_once(staged.withColumn("_kind", kind_window(F.col(title), F.col(url), F.col(text))))
    full, kind, none = F.col("_full"), F.col("_kind"), F.array().cast("array<string>")
    rejecting = list(dict.fromkeys(map(normalize_term, terms.STRONG_NEGATIVE_TERMS + terms.NEGATIVE_TERMS)))
    staged = evaluate_once(staged.withColumn("_rejecting", term_hits(kind, rejecting)))
    staged = evaluate_once(staged.withColumn(
        "_strong", strong_negative(kind, F.col("_title"), F.col("_rejecting"), terms)
    ).withColumn("_core", term_hits(full, terms.CALL_CORE_TERMS)))
    clean = F.size("_strong") == 0
    staged = evaluate_once(staged.withColumn(
        "_internal", F.when(clean, term_hits(full, terms.INTERNAL_TERMS)).otherwise(none)
    ).withColumn("_exact", F.when(clean, code_hits(full, F.col(cup), F.col(clp))).otherwise(none)))
    undecided = clean & (F.size("_core") > 0) & (F.size("_exact") == 0)
    staged = evaluate_once(staged.withColumn("_hits", F.struct(
        F.col("_strong").alias("strong"), F.col("_core").alias("core"), F.col("_exact").alias("exact"),
        F.col("_internal").alias("internal"), among(F.col("_rejecting"), terms.NEGATIVE_TERMS).alias("negative"),
        F.when(undecided, term_hits(full, terms.PROJECT_CONTEXT_TERMS)).otherwise(none).alias("context"),
        F.when(F.size("_internal") > 0, external_hits(full, terms)).otherwise(none).alias("external"))))
    reserved = internal_only(full, F.col("_hits.internal"), F.col("_hits.external"), terms)
    ruled = staged.withColumn("_reserved", reserved).withColumn(
        "rule", rule_verdict(F.col("_hits"), F.col("_reserved")))
    return evaluate_once(ruled.drop(
        "_title", "_full", "_kind", "_rejecting", "_strong", "_core", "_internal", "_exact", "_hits", "_reserved"))


def rule_verdict(hits: Column, reserved: Column) -> Column:
    """Ordered decision list over the hit lists; the first rule that applies decides."""
    strong, core, negative = hits["strong"], hits["core"], hits["negative"]
    exact, context = hits["exact"], hits["context"]
    mixed = (F.size(hits["internal"]) > 0) & (F.size(hits["external"]) > 0)
    no_core = F.size(core) == 0

    def verdict(match: bool, confidence: Column, reason: Column, kind: Column, ambiguous: Column) -> Column:
        return F.struct(
            F.lit(match).alias("is_match"), confidence.alias("confidence"), reason.alias("reason"),
            kind.alias("opportunity_type"), F.lit(vocab.DEFAULT_DEADLINE).alias("deadline"),
            ambiguous.alias("ambiguous"))

    def reject(*reason) -> Column:
        parts = [F.lit(r) if isinstance(r, str) else r for r in reason]
        return verdict(False, F.lit("low"), F.concat(*parts), F.lit(vocab.DEFAULT_TYPE), F.lit(False))

    return (
        F.when((F.size(strong) > 0) & no_core, reject(
            "Closed/already-decided, contract-stage, or admin act (", _top(strong), ")."))
        .when(F.size(strong) > 0, reject(
            "Mixed with closed/admin terms (", _top(strong), "); requires a cleaner open-call document."))
        .when(reserved, reject(
            "Selection appears reserved to internal staff (", _top(hits["internal"]), ")."))
        .when((F.size(negative) > 0) & no_core, reject(
            "Looks like non-opportunity document: ", _top(negative), "."))
        .when(no_core, reject("No clear open-call/procurement language found."))
        .when(F.size(exact) > 0, verdict(
            True, F.when(mixed, F.lit("medium")).otherwise(F.lit("high")),
            F.concat(F.lit("Identificativo di progetto esatto trovato ("), F.array_join(exact, ", "),
                     F.lit(") insieme a termini di bando ("), _top(core), F.lit(").")),
            F.get(core, F.lit(0)), mixed))
        .when(F.size(context) >= 3, verdict(
            True, F.lit("medium"),
            F.concat(F.lit("Forte contesto D.M. 219 sull'IA ("), _top(context),
                     F.lit(") con termini di bando ("), _top(core), F.lit(").")),
            F.get(core, F.lit(0)), F.lit(False)))
        .otherwise(reject(
            "Linguaggio di bando presente (", _top(core), ") ma collegamento al progetto insufficiente (",
            F.size(context).cast("string"), " riferimento/i) - probabilmente un altro programma."))
    )


def with_gate(df: DataFrame, verification_required: bool = True, answer: str = "answer",
              error: str = "error") -> DataFrame:
    """Combine ``rule`` with an external answer or failure into ``final``, ``gate_stage``, ``gate_reason``.

    ``gate_stage`` is null for a confirmed match; ``unverified`` tells that the match goes out on rules alone.
    """
    rule = F.col("rule")
    failed = F.coalesce(F.col(error), F.lit("")) != ""
    consulted = F.col(answer).isNotNull() & ~failed
    scored = keys.parse_verdict_line(F.when(consulted, F.col(answer)), rule["opportunity_type"])
    weak = rule["is_match"] & ~consulted & (rule["confidence"] != "high") & F.lit(verification_required)
    held = weak & rule["ambiguous"]
    sent = weak & ~rule["ambiguous"]
    prefix = F.lit("NON VERIFICATO DA AI - possibile opportunità basata solo sulle regole (AI non ")
    cause = F.when(failed, F.concat(F.lit("disponibile: "), F.col(error))).otherwise(
        F.lit("consultata - mode/budget/key"))
    reason = F.when(sent, F.concat(prefix, cause, F.lit("). "), rule["reason"])).otherwise(rule["reason"])

    def field(name: str, fallback: Column) -> Column:
        return F.when(consulted, scored[name]).otherwise(fallback).alias(name)

    final = F.struct(
        field("is_match", rule["is_match"]), field("confidence", rule["confidence"]),
        field("reason", reason), field("opportunity_type", rule["opportunity_type"]),
        field("deadline", rule["deadline"]), consulted.alias("ai_used"),
        F.when(failed, F.col(error)).otherwise(F.lit("")).alias("ai_error"))
    level = rule["confidence"]
    held_reason = F.when(failed, F.concat(
        F.lit("AI call failed ("), F.col(error),
        F.lit(") on a mixed internal/external signal; holding back rather than sending unconfirmed "
              "(this specific case has a confirmed high wrong-send rate without AI)."),
    )).otherwise(F.concat(
        F.lit("Rule confidence '"), level,
        F.lit("' on a mixed internal/external signal without an AI confirmation (AI not consulted — "
              "mode/budget/key); holding back rather than sending unconfirmed.")))
    out = evaluate_once(df.withColumn("final", F.when(rule["is_match"], final)))
    return out.withColumn("unverified", F.coalesce(sent, F.lit(False))).withColumn(
        "gate_stage",
        F.when(~rule["is_match"], F.lit("rule_rejected"))
        .when(held, F.lit("ai_unavailable_deferred_ambiguous"))
        .when(~F.col("final.is_match"), F.lit("ai_rejected")),
    ).withColumn(
        "gate_reason",
        F.left(F.when(~rule["is_match"], rule["reason"]).when(held, held_reason)
               .otherwise(F.col("final.reason")), F.lit(vocab.REASON_CHARS)))


def scoring_requests(df: DataFrame, mode: str, budget: int, order: list[str]) -> DataFrame:
    """Rule matches sent to the external scorer, with whole-text cut at the scorer's input limit.

    ``capped`` keeps the first ``budget`` in the given order, as a distributed top-k.
    """
    wanted = df.filter(F.col("rule.is_match"))
    if mode == "off":
        wanted = wanted.filter(F.lit(False))
    if mode == "capped":
        wanted = wanted.orderBy(*order).limit(budget)
    return wanted.withColumn("request_text", F.substring("text", 1, vocab.SCORING_TEXT_CHARS))


def candidate_context(category: Column, published: Column, expires: Column, text: Column) -> Column:
    """Platform facts put in front of the document text."""
    blank = F.lit("")
    head = F.concat(
        F.lit("Categoria: "), F.coalesce(category, blank), F.lit(" | Pubblicato: "),
        F.coalesce(published, blank), F.lit(" | Scadenza: "), F.coalesce(expires, blank))
    return F.concat(F.trim(head), F.lit("\n"), F.coalesce(text, blank))
