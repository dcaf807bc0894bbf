"""The monitoring run: notices in, one decision per notice out, then grouped alerts and new state."""

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow import vocab
from noticeflow.functions import keys
from noticeflow.functions.dates import (
    application_deadline, deadline_display, deadline_passed, enrich_published, expired_by_metadata,
    format_deadline, outside_window, rome_clock,
)
from noticeflow.functions.text import joined, normalize_text
from noticeflow.operators import lookups, rules, settlement, state_ops, threads
from noticeflow.operators.clusters import cluster_new
from noticeflow.operators.reports import digest
from noticeflow.session import cut_lineage, evaluate_once

# Stages that leave a notice open for the next run; every other stage finalises it.
RETRIED_STAGES = ("ai_unavailable_deferred_ambiguous", "send_failed")
FETCH_ERROR_STAGES = ("enrich_error", "hydrate_error")

SUPERSEDED_REASON = (
    "A later result act (graduatoria/decreto di affidamento/aggiudicazione) "
    "sharing this project's CUP/CLP was found."
)
PREFILTER_REASON = "Title/category matched no known call-language or D.M. 219 signal."
ALREADY_REASON = "Confirmed again, but this exact alert was already sent previously."
HELD_REASON = (
    "Confirmed opportunity, but no actionable application details yet; "
    "waiting for a companion document (e.g. the Avviso) before emailing."
)
RESERVED_REASON = "Alert was already sent or is currently being sent."


@dataclass(frozen=True)
class Run:
    """One run's clock and policy."""

    as_of: datetime
    verification_required: bool = True

    @property
    def today(self):
        return rome_clock(self.as_of).date()

    @property
    def utc(self) -> datetime:
        """Clock for state timestamps, as a naive UTC value."""
        return self.as_of.astimezone(timezone.utc).replace(tzinfo=None) if self.as_of.tzinfo else self.as_of


def processed_policy(stage: Column, fetch_final: Column) -> Column:
    """Does this outcome finalise the notice?  Fetch errors only when the document is gone, by the whole error."""
    return F.when(stage.isin(*FETCH_ERROR_STAGES), F.coalesce(fetch_final, F.lit(False))).otherwise(
        ~stage.isin(*RETRIED_STAGES))


def _first_stage(df: DataFrame, *steps: tuple[str, Column, Column]) -> DataFrame:
    """Leave the funnel at the first step that applies; earlier exits stay."""
    stage, reason = F.when(F.col("stage").isNotNull(), F.col("stage")), F.when(F.col("stage").isNotNull(), F.col("reason"))
    for name, applies, why in steps:
        stage, reason = stage.when(applies, F.lit(name)), reason.when(applies, why)
    return df.withColumn("_stage", stage).withColumn("reason", reason).withColumn("stage", F.col("_stage")).drop("_stage")


PROJECT = ["school_name", "region", "cup", "clp", "amount"]


def with_project(notices: DataFrame, registry: DataFrame) -> DataFrame:
    return lookups.project_lookup(notices.drop(*PROJECT), registry, PROJECT)


def screen(notices: DataFrame, registry: DataFrame, processed: DataFrame, texts: DataFrame, run: Run,
           earlier_results: DataFrame | None = None) -> DataFrame:
    """Everything before the document rules; ``stage`` is set for notices that leave here.

    Notices: notice columns plus optional enrich_error.  Texts: item_key, text, hydrate_error.
    Cheap title checks come first; a notice that has left gets a text key that matches nothing, so no
    body is attached to it or scanned for it.  Store texts bucketed by item_key to spare their shuffle.
    """
    base = notices.withColumn("item_key", keys.item_key(F.col("school_code"), F.col("item_id")))
    if "enrich_error" not in base.columns:
        base = base.withColumn("enrich_error", F.lit(None).cast("string"))
    history = lookups.with_superseded(with_project(base, registry), earlier=earlier_results)
    fresh = lookups.new_notices(history, processed)
    none = F.lit(None).cast("string")
    cheap = evaluate_once(_first_stage(
        fresh.withColumn("stage", none).withColumn("reason", none),
        ("superseded", F.col("superseded"), F.lit(SUPERSEDED_REASON)),
        ("prefilter_rejected", ~rules.prefilter(F.col("title"), F.col("category")), F.lit(PREFILTER_REASON)),
        ("enrich_error", F.coalesce("enrich_error", F.lit("")) != "", F.left("enrich_error", F.lit(vocab.ERROR_CHARS))),
        # search notices get their real date from the text first, so only other vendors leave here
        ("expired", (F.lower("vendor") != "search") & expired_by_metadata(F.col("expires"), run.today),
         F.concat(F.lit("Platform-reported archive/expiry date "), F.col("expires"), F.lit(" has passed."))),
    ))
    text_key = F.when(F.col("stage").isNull(), F.col("item_key")).otherwise(F.concat(F.lit("left:"), F.col("item_key")))
    bodies = texts.select(F.col("item_key").alias("_text_key"), "text", "hydrate_error")
    read = cheap.withColumn("_text_key", text_key).join(bodies, "_text_key", "left").drop("_text_key")
    read = evaluate_once(read.withColumn("_body", normalize_text(F.coalesce("text", F.lit("")))))
    search = (F.lower("vendor") == "search") & F.col("stage").isNull()
    dated = read.withColumn("published", F.when(
        search, enrich_published(F.col("published"), F.col("_body"))).otherwise(F.col("published")))
    open_rows = evaluate_once(dated.withColumn(
        "_deadline", F.when(F.col("stage").isNull(), application_deadline(F.col("_body")))))
    late = F.concat(
        F.lit("Document-stated application deadline "), format_deadline(F.col("_deadline")),
        F.lit(" has passed (platform-reported expiry was "),
        F.coalesce(F.nullif("expires", F.lit("")), F.lit("unspecified")), F.lit(")."))
    errors = F.when(F.col("stage") == "enrich_error", F.col("enrich_error")).otherwise(F.coalesce("hydrate_error", F.lit("")))
    return evaluate_once(_first_stage(
        open_rows.withColumn("fetch_final", keys.http_outcome(errors)),
        ("outside_search_window", outside_window(F.col("vendor"), F.col("published"), run.today),
         F.concat(F.lit("Published "), F.col("published"), F.lit(
             f", older than the rolling {vocab.SEARCH_WINDOW_DAYS}-day search window as of today."))),
        ("expired", expired_by_metadata(F.col("expires"), run.today),
         F.concat(F.lit("Platform-reported archive/expiry date "), F.col("expires"), F.lit(" has passed."))),
        ("hydrate_error", F.coalesce("hydrate_error", F.lit("")) != "", F.left("hydrate_error", F.lit(vocab.ERROR_CHARS))),
        ("expired", deadline_passed(F.col("_deadline"), run.as_of), late),
    ))


def judge(screened: DataFrame, verdicts: DataFrame, alerts: DataFrame, run: Run) -> DataFrame:
    """Rules, external answers and the alert history for every notice that is still open.

    Verdicts: item_key, answer, error, same_process, actionable (the last two may be null).
    """
    open_text = F.when(F.col("stage").isNull(), rules.candidate_context(
        F.col("category"), F.col("published"), F.col("expires"), F.col("text")))
    context = normalize_text(rules.candidate_context(F.col("category"), F.col("published"), F.col("expires"), F.lit("")))
    staged = screened.withColumn("_doc", open_text).withColumn(
        "_norm", F.when(F.col("stage").isNull(), joined(context, F.col("_body"))))
    ruled = rules.with_rule_verdict(staged, text="_doc", normalized="_norm")
    ruled = ruled.withColumn("rule", F.when(F.col("stage").isNull(), F.col("rule")))
    scored = ruled.join(verdicts.select(
        "item_key", "answer", "error", "same_process", F.col("actionable").alias("_told_actionable")), "item_key", "left")
    gated = rules.with_gate(scored, run.verification_required)
    passed = F.col("stage").isNull() & F.col("gate_stage").isNull()
    shown = deadline_display(application_deadline(F.col("_norm")), F.col("expires"), F.col("final.deadline"))
    confirmed = gated.withColumn("confirmed", F.coalesce(passed, F.lit(False))).withColumn(
        "deadline", F.when(passed, shown)).withColumn(
        "alert_key", keys.alert_key(F.col("school_code"), F.col("cup"), F.col("clp"), F.col("url")))
    known = lookups.live_alerts(alerts, run.utc).withColumn("_known", F.lit(True))
    checked = confirmed.join(known, "alert_key", "left")
    staged = _first_stage(
        checked,
        ("left", F.col("gate_stage").isNotNull(), F.col("gate_reason")),
        ("already_alerted", F.coalesce("_known", F.lit(False)), F.lit(ALREADY_REASON)),
    )
    stage = F.when(F.col("stage") == "left", F.col("gate_stage")).otherwise(F.col("stage"))
    signal_text = F.when(stage.isNull(), joined(normalize_text(F.col("title")), F.col("_norm")))
    signalled = threads.with_signals(
        staged.withColumn("stage", stage).withColumn("_signal", signal_text), "_signal")
    return signalled.withColumn("actionable", F.when(
        F.col("stage").isNull(), keys.is_actionable(F.col("_signal"), F.col("_told_actionable"))))


RESULT_COLUMNS = (
    "item_key", "school_code", "vendor", "item_id", "title", "url", "published", "school_name", "region", "cup", "clp",
    "amount", "stage", "reason", "confirmed", "confidence", "opportunity_type", "deadline", "ai_used", "ai_error",
    "alert_key", "protocol_ref", "role_signature", "published_date", "same_process", "actionable",
    "fetch_final", "unverified", "unverified_reason",
)


def decide(notices: DataFrame, registry: DataFrame, texts: DataFrame, verdicts: DataFrame,
           processed: DataFrame, alerts: DataFrame, run: Run, earlier_results: DataFrame | None = None) -> DataFrame:
    """One row per new notice: where it left the funnel and why; ``stage`` is null for a pending alert.

    ``earlier_results`` are the result acts of earlier runs (``lookups.result_acts``).
    """
    judged = judge(screen(notices, registry, processed, texts, run, earlier_results), verdicts, alerts, run)
    flat = judged.withColumn("confidence", F.col("final.confidence")).withColumn(
        "opportunity_type", F.col("final.opportunity_type")).withColumn(
        "ai_used", F.col("final.ai_used")).withColumn("ai_error", F.col("final.ai_error")).withColumn(
        "reason", F.coalesce("reason", "final.reason")).withColumn(
        "unverified", F.col("confirmed") & F.col("unverified")).withColumn(
        "unverified_reason", F.when(F.col("unverified"), F.left("final.reason", F.lit(vocab.REASON_CHARS))))
    return evaluate_once(flat.select(*RESULT_COLUMNS))


def plan_alerts(decided: DataFrame, open_calls: DataFrame, alerts: DataFrame, run: Run, order: str = "seq") -> DataFrame:
    """Pending alerts with thread decision, group and reservation: the rows a sender works through.

    ``order`` is a unique bigint position (arrival order).  Threads are resolved against the state
    before the run, so one look-up serves all notices.
    """
    pending = decided.filter(F.col("stage").isNull())
    # pending alerts are few, and several passes follow: each pass starts from a reliable checkpoint
    resolved = cut_lineage(threads.resolve_thread(threads.match_thread(pending, open_calls, run.utc)))
    project = F.concat_ws("|", "school_code", F.coalesce(F.nullif("cup", F.lit("")), F.col("school_code")))
    fresh = cluster_new(resolved.filter(F.col("thread_id").isNull()).withColumn("_project", project), "_project", order)
    fresh = fresh.withColumn("group_key", F.concat_ws("#", "_project", "cluster_id")).drop("_project", "cluster_id")
    grouped = cut_lineage(fresh.unionByName(
        resolved.filter(F.col("thread_id").isNotNull()).withColumn("group_key", F.col("thread_id"))))
    acted = grouped.join(threads.group_action(grouped, "group_key"), "group_key", "left")
    asking = acted.filter(F.col("group_action").isin("send_new", "send_reply"))
    reserved = settlement.settle_in_turn(asking, alerts, run.utc, "group_key", order, F.col("thread_id").isNotNull(), project)
    quiet = acted.filter(~F.col("group_action").isin("send_new", "send_reply"))
    rows = reserved.unionByName(quiet, allowMissingColumns=True)
    stage = (
        F.when(F.col("group_action") == "hold", "held").when(F.col("group_action") == "suppress", "suppressed_duplicate")
        .when(F.col("group_granted"), "alerted").otherwise("already_alerted"))
    why = (
        F.when(F.col("group_action") == "hold", F.lit(HELD_REASON))
        .when(F.col("group_action") == "suppress", F.col("action_reason"))
        .when(F.col("group_granted"), F.col("reason")).otherwise(F.lit(RESERVED_REASON)))
    return cut_lineage(rows.withColumn("reason", why).withColumn("stage", stage))


@dataclass(frozen=True)
class Settled:
    """What a run leaves behind once its messages were tried."""

    planned: DataFrame
    alerts: DataFrame
    changes: DataFrame
    threads: DataFrame


def settle(planned: DataFrame, outcomes: DataFrame | None, alerts: DataFrame, known_threads: DataFrame, run: Run,
           order: str = "seq") -> Settled:
    """Leases, deliveries and thread changes of planned rows.

    ``alerts`` and ``known_threads`` are the tables before the run, or their rows that it may touch;
    ``outcomes`` tells per group whether its message was delivered.  Rows of groups that were not are
    ``send_failed`` and stay open for the next run.  Without outcomes the messages are left to a sender
    outside: alerts stay leased, and of the threads only held ones change.
    """
    leased = state_ops.lease_alerts(alerts, planned, run.utc)
    if outcomes is None:
        none = F.lit(None).cast("string")
        rows = planned.withColumns({"delivery": none, "message_id": none, "subject": none})
        after, threaded = leased, rows.filter(F.col("stage") == "held")
    else:
        rows = threaded = cut_lineage(settlement.settle_delivery(planned, outcomes))
        after = settlement.settle_alerts(leased, rows, run.utc, run.utc)
    changes = cut_lineage(settlement.thread_changes(threaded, "group_key", order))
    return Settled(rows, after, changes, state_ops.apply_thread_updates(known_threads, changes, run.utc))


def final_decisions(decided: DataFrame, planned: DataFrame) -> DataFrame:
    """Current decision per notice after alerts were planned: stage, reason and whether it is finalised."""
    shape = ["item_key", "school_code", "title", "url", "published", "stage", "reason", "confirmed", "ai_used",
             "ai_error", "group_key", "fetch_final"] + (["seq"] if "seq" in decided.columns else [])
    left = decided.filter(F.col("stage").isNotNull()).withColumn("group_key", F.lit(None).cast("string"))
    rows = left.select(*shape).unionByName(planned.select(*shape))
    return rows.withColumn("processed", processed_policy(F.col("stage"), F.col("fetch_final"))).drop("fetch_final")


def decision_log(decided: DataFrame, planned: DataFrame) -> DataFrame:
    """Every (stage, reason) row of the run in order: first exits, unverified matches, confirmations, outcomes."""
    base = ["item_key", "school_code", "title", "url"]
    first = decided.filter(F.col("stage").isNotNull()).select(*base, "stage", "reason", F.lit(3).alias("step"))
    # a match by rules alone is logged before the alert history is looked at
    unverified = decided.filter("unverified").select(
        *base, F.lit("confirmed_unverified").alias("stage"), F.col("unverified_reason").alias("reason"), F.lit(1).alias("step"))
    confirmed = decided.filter(F.col("stage").isNull()).select(
        *base, F.lit("confirmed").alias("stage"), "reason", F.lit(2).alias("step"))
    outcome = planned.select(*base, "stage", "reason", F.lit(3).alias("step"))
    return first.unionByName(unverified).unionByName(confirmed).unionByName(outcome)


def alert_digest(planned: DataFrame, open_calls: DataFrame, order: str = "seq") -> DataFrame:
    """Messages of the groups that were granted a send."""
    sent = planned.filter(F.col("stage") == "alerted")
    rooted = lookups.thread_root(sent, open_calls).withColumn(
        "reply_subject", F.when(F.col("group_action") == "send_reply", F.col("root_subject")))
    return digest(rooted, [order])
