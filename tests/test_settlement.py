"""Ordered reservations, deliveries and thread changes against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import settlement, state_ops
from noticeflow.plans import funnel
from noticeflow.schemas import state_schema

RUN = datetime(2026, 6, 15, 9, 30)
ALERTS = state_schema("alerts")
ASK = "seq bigint, group_key string, thread_id string, project string, alert_key string"


def brute(rows, alerts):
    """The reference order: threads as they appear, then projects, then their groups; each asks key by key."""
    state = {k: (s, at) for k, s, at in alerts}
    threaded = list(dict.fromkeys(g for _, g, t, _, _ in rows if t))
    projects = list(dict.fromkeys(p for _, _, t, p, _ in rows if not t))
    order = threaded + [g for p in projects for g in dict.fromkeys(g for _, g, t, q, _ in rows if not t and q == p)]
    granted = {}
    for group in order:
        mine = [r for r in rows if r[1] == group]
        taken = []
        for *_, key in mine:
            s, at = state.get(key, (None, None))
            if s == "sent" or s == "sending" and at >= RUN - timedelta(minutes=120):
                for k in taken:
                    state[k] = ("failed", RUN)
                break
            state[key] = ("sending", RUN)
            taken.append(key)
        granted[group] = len(taken) == len(mine)
    return granted, {k: s for k, (s, _) in state.items()}


@pytest.mark.parametrize("seed", range(4))
def test_groups_reserve_in_order(spark, seed):
    rnd = random.Random(seed)
    keys = [f"k{i}" for i in range((30, 60, 400, 12)[seed])]
    rows = []
    for i in range(300):
        thread = f"T{rnd.randrange(30)}" if rnd.random() < 0.4 else None
        project = f"p{rnd.randrange(9)}"
        rows.append((i, thread or f"{project}#{rnd.randrange(12)}", thread, project, rnd.choice(keys)))
    alerts = [(k, rnd.choice(("sent", "sending", "failed")), RUN - timedelta(minutes=rnd.choice((5, 500)))) for k in keys if rnd.random() < 0.2]
    table = spark.createDataFrame([(k, "", "", s, None, None, at, at) for k, s, at in alerts], ALERTS)
    asked = settlement.group_rank(spark.createDataFrame(rows, ASK), "group_key", "seq", F.col("thread_id").isNotNull(), F.col("project"))
    got = settlement.settle_groups(asked, table, RUN, "group_key", "seq").collect()
    granted, state = brute(rows, alerts)
    assert len(got) == len(rows) and {r.group_key: r.group_granted for r in got} == granted
    after = {k: s for k, s, _ in alerts}
    for r in sorted(got, key=lambda r: r.new_status or ""):   # failed before sending
        if r.new_status:
            after[r.alert_key] = r.new_status
    assert after == state


def test_a_released_alert_is_offered_to_the_next_group(spark):
    rows = [(1, "A", None, "p", "x"), (2, "A", None, "p", "y"), (3, "B", None, "p", "y"), (4, "C", None, "p", "y")]
    table = spark.createDataFrame([("x", "", "", "sent", None, None, RUN, RUN)], ALERTS)
    asked = settlement.group_rank(spark.createDataFrame(rows, ASK), "group_key", "seq", F.col("thread_id").isNotNull(), F.col("project"))
    got = {r.seq: (r.group_granted, r.new_status) for r in settlement.settle_groups(asked, table, RUN, "group_key", "seq").collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, "sending"), 4: (False, None)}


def test_nobody_asks(spark):
    asked = settlement.group_rank(spark.createDataFrame([], ASK), "group_key", "seq", F.col("thread_id").isNotNull(), F.col("project"))
    assert settlement.settle_groups(asked, spark.createDataFrame([], ALERTS), RUN, "group_key", "seq").count() == 0


PLANNED = ("seq bigint, item_key string, title string, school_code string, cup string, clp string, url string, alert_key string, role_signature array<string>, "
           "protocol_ref string, action string, thread_id string, group_key string, stage string, reason string, new_status string")


def row(i, group, action, stage, roles=(), protocol=None, thread=None, cup="C1"):
    return (i, f"i{i}", f"title {i}", "S1", cup, "L1", f"u{i}", f"a{i}", list(roles), protocol, action, thread, group, stage, "why",
            "sending" if stage == "alerted" else None)


def test_hold_then_send_then_reply(spark):
    """Three runs over one process, each from the thread table the last one left; a repeated run changes nothing."""
    alerts, known = spark.createDataFrame([], ALERTS), spark.createDataFrame([], state_schema("call_threads"))

    def run(day, rows, outcomes):
        nonlocal alerts, known
        at = funnel.Run(as_of=datetime(2026, 6, day, 9, 0))
        planned = spark.createDataFrame(rows, PLANNED)
        told = spark.createDataFrame(outcomes, "group_key string, delivered boolean, message_id string, subject string")
        done = funnel.settle(planned, told, alerts, known, at)
        again = state_ops.apply_thread_updates(done.threads, done.changes, at.utc)
        assert sorted(map(str, again.collect())) == sorted(map(str, done.threads.collect()))
        alerts, known = (spark.createDataFrame(x.collect(), x.schema) for x in (done.alerts, done.threads))
        return {r.item_key: r.stage for r in done.planned.collect()}

    assert run(1, [row(1, "p#1", "hold", "held", ["tutor"]), row(2, "p#1", "hold", "held", ["esperto"], "7|2026")], []) == {"i1": "held", "i2": "held"}
    (thread,) = known.collect()
    assert (thread.status, thread.role_signature, thread.protocol_ref, thread.last_item_key, thread.subject) == ("held", ["esperto", "tutor"], "7|2026", "i2", None)
    name = thread.thread_id

    # not delivered: the thread stays as it was, the alert is free again, the notice is retried
    assert run(2, [row(3, name, "send_new", "alerted", ["rup"], thread=name)], [(name, False, None, None)]) == {"i3": "send_failed"}
    assert known.first().status == "held" and known.first().last_item_key == "i2" and alerts.first().status == "failed"

    assert run(3, [row(3, name, "send_new", "alerted", ["rup"], thread=name)], [(name, True, "<m1>", "Oggetto")]) == {"i3": "alerted"}
    (thread,) = known.collect()
    assert (thread.status, thread.message_id, thread.last_item_key, thread.role_signature) == ("sent", "<m1>", "i3", ["esperto", "tutor"])
    assert (alerts.first().status, alerts.first().subject) == ("sent", "Oggetto")

    assert run(4, [row(4, name, "suppress", "alerted", thread=name), row(5, name, "send_reply", "alerted", ["ata"], thread=name)], [(name, True, "<m2>", "Re")]) == {"i4": "alerted", "i5": "alerted"}
    (thread,) = known.collect()
    assert (thread.message_id, thread.subject, thread.last_item_key, thread.created_at.day, thread.updated_at.day) == ("<m1>", "Oggetto", "i5", 1, 4)


def test_unknown_outcomes_keep_their_lease(spark):
    planned = spark.createDataFrame([row(1, "g", "send_new", "alerted"), row(2, "h", "suppress", "suppressed_duplicate")], PLANNED)
    none = spark.createDataFrame([], "group_key string, delivered boolean, message_id string, subject string")
    done = funnel.settle(planned, none, spark.createDataFrame([], ALERTS), spark.createDataFrame([], state_schema("call_threads")), funnel.Run(as_of=RUN))
    assert {r.item_key: (r.stage, r.delivery) for r in done.planned.collect()} == {"i1": ("send_failed", "unknown"), "i2": ("suppressed_duplicate", None)}
    assert done.alerts.first().status == "sending" and done.threads.count() == 0


def test_only_the_own_lease_is_given_back(spark):
    early = RUN - timedelta(minutes=30)
    table = spark.createDataFrame([("a1", "", "", "sending", None, None, early, RUN), ("a2", "", "", "sending", None, None, early, early)], ALERTS)
    settled = spark.createDataFrame([("a1", "failed"), ("a2", "failed")], "alert_key string, delivery string").selectExpr(
        "*", "'' school_code", "'' url", "cast(null as string) message_id", "cast(null as string) subject")
    after = settlement.settle_alerts(table, settled, early, RUN)
    assert {r.alert_key: r.status for r in after.collect()} == {"a1": "sending", "a2": "failed"}


def test_requests_are_read_once_more_after_the_walk(spark, scratch):
    rows = [("g1", "a", 1, 1), ("g1", "b", 2, 1), ("g1", "b", 4, 1), ("g1", "c", 5, 1), ("g2", "a", 3, 2), ("g2", "a", 3, 2), ("g3", "d", 6, 3), ("g4", "d", 7, 4),
            ("g4", "e", 8, 4), ("g5", "e", 9, 5), ("g5", None, 10, 5), ("g5", "f", 11, 5)]
    spark.createDataFrame(rows, "g string, alert_key string, seq long, _rank long").write.parquet(f"{scratch}/asks")
    alerts = spark.createDataFrame([("f", "sent", datetime(2026, 6, 15, 9, 0))], "alert_key string, status string, updated_at timestamp")
    out = settlement.settle_groups(spark.read.parquet(f"{scratch}/asks"), alerts, datetime(2026, 6, 15, 9, 30), "g", "seq")
    got = {(r.g, r.alert_key, r.seq): (r.group_granted, r.new_status) for r in out.collect()}
    assert out.count() == len(rows)
    assert got == {
        ("g1", "a", 1): (False, "failed"), ("g1", "b", 2): (False, "failed"), ("g1", "b", 4): (False, None), ("g1", "c", 5): (False, None),
        ("g2", "a", 3): (False, None), ("g3", "d", 6): (True, "sending"), ("g4", "d", 7): (False, None), ("g4", "e", 8): (False, None),
        ("g5", "e", 9): (False, "failed"), ("g5", None, 10): (False, "failed"), ("g5", "f", 11): (False, None)}
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 2


def shuffled_rows(spark, since=-1):
    """Rows written to shuffles by stages after ``since``, and the last stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    seen = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteRecords()) for i in range(stages.size())]
    return sum(n for stage, n in seen if stage > since), max((stage for stage, _ in seen), default=-1)


def test_requests_move_to_their_alert_their_group_and_their_rank_only(spark):
    n, wide = 20_000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # every hundredth group asks for the alert of the one before it, every tenth for one that was sent
    asks = spark.range(n).selectExpr("id seq", "concat('g', id) g", "concat('a', if(id % 100 = 7, id - 1, id)) alert_key", "id _rank")
    table = spark.range(0, n, 10).selectExpr("concat('a', id) alert_key", "'sent' status").withColumn("updated_at", F.lit(RUN))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)[1]
        got = settlement.settle_groups(asks, table, RUN, "g", "seq").groupBy("group_granted", "new_status").agg(F.count("*"), F.sum("seq")).collect()
        moved = shuffled_rows(spark, before)[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", wide)
    refused = [i for i in range(n) if i % 10 == 0 or i % 100 == 7]
    assert {tuple(r) for r in got} == {
        (True, "sending", n - len(refused), n * (n - 1) // 2 - sum(refused)), (False, None, len(refused), sum(refused))}
    assert moved < 4 * n


def test_ranks_looked_up_late_are_those_of_group_rank(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        thread = f"T{rnd.randrange(40)}" if rnd.random() < 0.5 else None
        project = f"p{rnd.randrange(6)}"
        rows.append((i, thread or f"{project}#{rnd.randrange(9)}", thread, project, rnd.choice((None, *(f"k{n}" for n in range(150))))))
    table = spark.createDataFrame([("k3", "", "", "sent", None, None, RUN, RUN), (None, "", "", "sent", None, None, RUN, RUN)], ALERTS)
    asks = spark.createDataFrame(rows, ASK)
    how = F.col("thread_id").isNotNull(), F.col("project")
    early = settlement.settle_groups(settlement.group_rank(asks, "group_key", "seq", *how), table, RUN, "group_key", "seq").drop("_rank")
    late = settlement.settle_in_turn(asks, table, RUN, "group_key", "seq", *how)
    assert late.columns == [*asks.columns, "group_granted", "new_status"]
    assert sorted(map(str, late.collect())) == sorted(map(str, early.select(late.columns).collect()))
