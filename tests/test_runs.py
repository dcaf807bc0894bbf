"""The whole funnel on hand-made notices, and the same notices as a stream."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import state_ops
from noticeflow.plans import funnel
from noticeflow.schemas import state_schema
from noticeflow.sources import state as store
from noticeflow.streaming import intake

RUN = funnel.Run(as_of=datetime(2026, 6, 15, 9, 30))
CUP = "H74D25002610006"
APPLY = "procedura di selezione, domanda di partecipazione"

# id, vendor, title, published, expires, category, text, stage
CASES = [
    ("new", "Argo", "Avviso di selezione esperti", "10/06/2026", "", "", f"{APPLY} tutor CUP {CUP} entro le ore 12:00 del 30/06/2026", "alerted"),
    ("same", "Argo", "Avviso di selezione tutor bis", "11/06/2026", "", "", f"{APPLY} tutor CUP {CUP}", "alerted"),
    ("other", "Argo", "Avviso di selezione rup", "11/06/2026", "", "", f"{APPLY} rup CUP {CUP}", "alerted"),
    ("hold", "Argo", "Avviso di selezione referente", "11/06/2026", "", "", f"procedura di selezione referente CUP {CUP}", "held"),
    ("menu", "Argo", "Menu della mensa", "10/06/2026", "", "", "x", "prefilter_rejected"),
    ("old", "Search", "Procedura di selezione", "01/06/2026", "", "", APPLY, "outside_search_window"),
    ("dated", "Search", "Procedura di selezione", "", "", "", "pubblicato il 1 giugno 2026 " + APPLY, "outside_search_window"),
    ("undated", "Search", "Procedura di selezione", "", "", "", "procedura", "rule_rejected"),
    ("expired", "Argo", "Procedura di selezione", "01/06/2026", "15/06/2026", "", APPLY, "expired"),
    ("late", "Argo", "Procedura di selezione", "01/06/2026", "30/06/2026", "", "entro le ore 10 del 15/06/2026 " + APPLY, "expired"),
    ("closed", "Argo", f"Procedura di selezione {CUP}", "01/06/2026", "", "", APPLY, "superseded"),
    ("result", "Argo", f"Graduatoria procedura di selezione {CUP}", "02/06/2026", "", "", "graduatoria", "rule_rejected"),
    ("mixed", "Argo", "Procedura di selezione", "01/06/2026", "", "", f"{APPLY} CUP {CUP} personale interno, esperti esterni", "ai_unavailable_deferred_ambiguous"),
    ("no", "Argo", "Procedura di selezione", "01/06/2026", "", "", f"{APPLY} CUP {CUP}", "ai_rejected"),
    ("known", "Argo", "Procedura di selezione docenti", "01/06/2026", "", "", f"{APPLY} CUP {CUP}", "already_alerted"),
    ("gone", "Argo", "Procedura di selezione", "01/06/2026", "", "", "404", "hydrate_error"),
    ("slow", "Argo", "Procedura di selezione", "01/06/2026", "", "", "timeout", "hydrate_error"),
    ("done", "Argo", "Procedura di selezione", "01/06/2026", "", "", APPLY, None),
]


@pytest.fixture(scope="module")
def tables(spark):
    notices = spark.createDataFrame(
        [("S1", v, i, t, f"http://x.it/{i}", p, e, c) for i, v, t, p, e, c, _, _ in CASES],
        "school_code string, vendor string, item_id string, title string, url string, published string, expires string, category string")
    texts = spark.createDataFrame(
        [(f"S1|{c[0]}", c[6], {"gone": "404 Not Found", "slow": "timeout"}.get(c[0])) for c in CASES], "item_key string, text string, hydrate_error string")
    registry = spark.createDataFrame([("S1", "Istituto", "LAZIO", CUP, "", "1.00")], "school_code string, school_name string, region string, cup string, clp string, amount string")
    verdicts = spark.createDataFrame([("S1|no", "IGNORE | chiuso", None, None, None)], "item_key string, answer string, error string, same_process boolean, actionable boolean")
    alerts = spark.createDataFrame([(f"s1|{CUP.lower()}||http://x.it/known", "S1", "u", "sent", None, None, RUN.utc, RUN.utc)], state_schema("alerts"))
    processed = spark.createDataFrame([("S1|done",)], "item_key string")
    return dict(notices=notices, texts=texts, registry=registry, verdicts=verdicts, alerts=alerts, processed=processed,
                threads=spark.createDataFrame([], state_schema("call_threads")))


@pytest.fixture(scope="module")
def outcome(tables):
    t = tables
    decided = funnel.decide(t["notices"], t["registry"], t["texts"], t["verdicts"], t["processed"], t["alerts"], RUN)
    order = F.create_map(*[F.lit(x) for i, c in enumerate(CASES) for x in (c[0], i)])
    decided = decided.withColumn("seq", order[F.col("item_id")].cast("bigint"))
    planned = funnel.plan_alerts(decided, t["threads"], t["alerts"], RUN)
    return decided, planned


def test_every_notice_leaves_at_its_stage(outcome):
    final = {r.item_key.split("|")[1]: r for r in funnel.final_decisions(*outcome).collect()}
    assert {i: r.stage for i, r in final.items()} == {c[0]: c[-1] for c in CASES if c[-1]}
    assert not final["slow"].processed and not final["mixed"].processed
    assert all(final[i].processed for i in ("gone", "new", "hold", "menu", "no", "known"))


def test_roles_make_separate_groups(outcome):
    rows = {r.item_key.split("|")[1]: r for r in outcome[1].collect()}
    assert rows["new"].group_key == rows["same"].group_key != rows["other"].group_key
    assert rows["hold"].group_key not in (rows["new"].group_key, rows["other"].group_key)
    assert rows["new"].deadline == "30/06/2026 12:00"


def test_messages(outcome, tables):
    messages = funnel.alert_digest(outcome[1], tables["threads"]).collect()
    subjects = sorted(m.subject for m in messages)
    assert subjects == ["Opportunità formatore IA PNRR: Istituto", "Opportunità formatore IA PNRR: Istituto — 2 avvisi"]


def test_log_has_every_step(outcome):
    log = {(r.item_key.split("|")[1], r.stage) for r in funnel.decision_log(*outcome).collect()}
    assert {("new", "confirmed"), ("new", "alerted"), ("hold", "confirmed"), ("hold", "held"), ("menu", "prefilter_rejected")} <= log


def test_stream_equals_batch_and_replays_nothing(spark, outcome, tables, scratch):
    source, root = f"{scratch}/in", f"{scratch}/state"
    tables["notices"].coalesce(1).write.parquet(source)
    store.write_state(tables["alerts"], root, "alerts")
    done = spark.createDataFrame([("S1|done", "S1", "", "", RUN.utc)], state_schema("processed_items"))
    store.write_state(done, root, "processed_items")
    stream = spark.readStream.schema(tables["notices"].schema).parquet(source)
    for _ in range(2):
        intake.stream_funnel(stream, lambda: tables, RUN, root, f"{scratch}/offsets")
    final = {r.item_key: (r.stage, r.processed) for r in funnel.final_decisions(*outcome).collect()}
    decisions = {r.item_key: r.stage for r in store.read_state(spark, root, "decisions").collect()}
    assert decisions == {k: v[0] for k, v in final.items()}
    kept = {r.item_key for r in store.read_state(spark, root, "processed_items").collect()}
    assert kept == {k for k, v in final.items() if v[1]} | {"S1|done"}
    status = {r.alert_key.rsplit("/", 1)[1]: r.status for r in store.read_state(spark, root, "alerts").collect()}
    assert status == {"known": "sent", "new": "sending", "same": "sending", "other": "sending"}
    archive = {r.opp_key for r in store.read_state(spark, root, "opportunities").collect()}
    assert archive == {f"s1|http://x.it/{i}" for i in ("new", "same", "other", "hold", "known")}


def deliver_but(failing):
    def deliver(planned):
        return intake.deliver_all(planned).withColumn("delivered", ~F.col("group_key").contains(failing))
    return deliver


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def everything(spark, root):
    names = ("alerts", "call_threads", "decisions", "opportunities", "result_acts", "processed_items", "outcomes")
    return {n: sorted(map(str, store.read_state(spark, root, n).collect())) for n in names}


def test_a_run_that_fails_after_any_write_ends_like_one_that_does_not(spark, tables, scratch, monkeypatch, few_partitions):
    source = f"{scratch}/in"
    tables["notices"].coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(tables["notices"].schema).parquet(source)
    asked = []

    def deliver(planned):
        asked.append(1)
        return intake.deliver_all(planned)

    def start(root):
        intake.stream_funnel(stream, lambda: tables, RUN, root, f"{root}/offsets", deliver)

    start(f"{scratch}/whole")
    wanted = everything(spark, f"{scratch}/whole")
    assert len(wanted["decisions"]) == len(CASES) and len(wanted["call_threads"]) == len(wanted["outcomes"]) + 1
    asked.clear()
    root, write, commit = f"{scratch}/broken", store.write_changes, store.commit
    for point in (0, 2, 4, 6):
        count = iter(range(99))

        def failing(df, root, table, batch):
            write(df, root, table, batch)
            if next(count) == point:
                raise RuntimeError(f"lost after {table}")
        monkeypatch.setattr(store, "write_changes", failing)
        monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost before the marker")))
        with pytest.raises(Exception, match="lost"):
            start(root)
        assert everything(spark, root) == {n: [] for n in wanted}   # nothing is visible yet
    monkeypatch.setattr(store, "write_changes", write)
    monkeypatch.setattr(store, "commit", commit)
    start(root)
    assert everything(spark, root) == wanted and len(asked) == 1
    start(root)
    for table in wanted:
        store.compact(spark, root, table)
    assert everything(spark, root) == wanted


def test_runs_build_on_each_other(spark, tables, scratch, few_partitions):
    """A held process is sent, a failed message is tried again, and a result act of an earlier run closes a later notice."""
    source, root = f"{scratch}/in", f"{scratch}/state"
    shape = tables["notices"].schema
    texts = {}

    def arrive(day, rows, deliver):
        for i, title, published, text in rows:
            texts[f"S1|{i}"] = text
        spark.createDataFrame([("S1", "Argo", i, t, f"http://x.it/{i}", p, "", "") for i, t, p, _ in rows], shape).coalesce(1).write.mode("append").parquet(source)
        now = dict(tables, texts=spark.createDataFrame([(k, t, "") for k, t in texts.items()], "item_key string, text string, hydrate_error string"),
                   verdicts=spark.createDataFrame([], tables["verdicts"].schema))
        stream = spark.readStream.schema(shape).parquet(source)
        intake.stream_funnel(stream, lambda: now, funnel.Run(as_of=datetime(2026, 6, day, 9)), root, f"{scratch}/offsets", deliver)
        return {r.item_key.split("|")[1]: r.stage for r in store.read_state(spark, root, "decisions").collect()}

    held = f"procedura di selezione referente CUP {CUP} prot. n. 77 del 08/06/2026"
    got = arrive(10, [("a", "Avviso di selezione referente", "08/06/2026", held), ("r", f"Graduatoria procedura di selezione {CUP}", "12/06/2026", "graduatoria")], intake.deliver_all)
    assert got == {"a": "held", "r": "rule_rejected"}
    go = f"{APPLY} referente CUP {CUP} prot. n. 77 del 08/06/2026"
    got = arrive(11, [("b", "Avviso di selezione referente", "09/06/2026", go), ("c", f"Procedura di selezione {CUP}", "09/06/2026", APPLY)], deliver_but(""))
    assert got["b"] == "send_failed" and got["c"] == "superseded"
    (thread,) = store.read_state(spark, root, "call_threads").collect()
    assert thread.status == "held" and "S1|b" not in {r.item_key for r in store.read_state(spark, root, "processed_items").collect()}
    got = arrive(12, [("b", "Avviso di selezione referente", "09/06/2026", go), ("d", f"Procedura di selezione referente {CUP}", "13/06/2026", go)], intake.deliver_all)
    assert got["b"] == "alerted" and got["d"] == "alerted" and got["a"] == "held"
    (thread,) = store.read_state(spark, root, "call_threads").collect()
    assert thread.status == "sent" and thread.message_id and thread.last_item_key in ("S1|b", "S1|d") and thread.created_at.day == 10


def test_intake_keeps_each_key_once(spark, tables, scratch):
    source = f"{scratch}/in"
    for n in range(3):
        tables["notices"].coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(tables["notices"].schema).parquet(source)
        intake.stream_new_notices(stream, f"{scratch}/seen", f"{scratch}/offsets", order="title")
        assert spark.read.parquet(f"{scratch}/seen").count() == len(CASES)


def test_thread_updates_follow_the_whitelist(spark):
    now = datetime(2026, 6, 15)
    columns = state_schema("call_threads")
    base = ("S", "C", "L", ["tutor"], None, "held", None, None, "i0", "t0", datetime(2026, 6, 1), datetime(2026, 6, 1))
    threads = spark.createDataFrame([(k, *base) for k in ("up", "re", "ho", "un")], columns)
    new = ("X", "X", "X", ["rup"], "9|1", "sent", "Sub", "<m>", "i1", "t1")
    changes = spark.createDataFrame(
        [(k, t, *new) for k, t in (("up", "upgraded"), ("re", "replied"), ("ho", "held"), ("cr", "created"))],
        "thread_id string, transition string, school_code string, cup string, clp string, role_signature array<string>, protocol_ref string, "
        "status string, subject string, message_id string, last_item_key string, last_title string")
    got = {r.thread_id: (r.school_code, r.role_signature, r.protocol_ref, r.status, r.subject, r.last_title, r.updated_at == now)
           for r in state_ops.apply_thread_updates(threads, changes, now).collect()}
    assert got == {
        "up": ("S", ["tutor"], None, "sent", "Sub", "t1", True), "re": ("S", ["tutor"], None, "held", None, "t1", True),
        "ho": ("S", ["rup"], "9|1", "held", None, "t1", True), "un": ("S", ["tutor"], None, "held", None, "t0", False),
        "cr": ("X", ["rup"], "9|1", "sent", "Sub", "t1", True)}


def test_a_late_404_in_a_long_error_is_final(spark, tables):
    errors = {"gone": "x" * 400 + " 404 Client Error", "slow": "x" * 400 + " timed out"}
    texts = tables["texts"].withColumn("hydrate_error", F.lit(""))
    notices = tables["notices"].filter(F.col("item_id") == "new").drop("item_id").crossJoin(
        spark.createDataFrame(list(errors.items()), "item_id string, enrich_error string"))
    decided = funnel.decide(notices, tables["registry"], texts, tables["verdicts"], tables["processed"], tables["alerts"], RUN)
    got = {r.item_key.split("|")[1]: funnel_row for r in decided.collect() for funnel_row in [(r.stage, r.fetch_final)]}
    assert got == {"gone": ("enrich_error", True), "slow": ("enrich_error", False)}


def test_unverified_matches_are_logged_with_their_reason(outcome):
    decided, planned = outcome
    want = {(r.item_key, r.unverified_reason) for r in decided.filter("unverified").collect()}
    log = funnel.decision_log(decided, planned).filter("stage = 'confirmed_unverified'").collect()
    assert {(r.item_key, r.reason) for r in log} == want
    assert all(r.reason.startswith("NON VERIFICATO DA AI") for r in log)
