"""Threads, clusters, ranking and state against brute force, with one dominant key."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from noticeflow.operators import clusters, lookups, ranking, reports, state_ops, threads
from noticeflow.sources import state as store

AS_OF = datetime(2026, 6, 15, 12, 0)


def brute_clusters(rows):
    known, out = {}, {}
    for g, o, roles, p in sorted(rows, key=lambda r: r[1]):
        mine = known.setdefault(g, [])
        home = next((c for c in mine if (p and c[2] == p) or (set(roles) & c[1])), None)
        if home is None:
            home = [o, set(), None]
            mine.append(home)
        home[1] |= set(roles)
        home[2] = home[2] or p
        out[(g, o)] = home[0]
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 150])
def test_clusters_with_a_dominant_project(spark, hot_rows):
    rnd = random.Random(11)
    rows = []
    for i in range(900):
        roles = [r for r in ("tutor", "esperto", "rup", "ata") if rnd.random() < 0.1]
        rows.append((rnd.choice(["hot", "hot", "b", "c"]), i, roles, rnd.choice([None, None, f"P{rnd.randrange(25)}"])))
    df = spark.createDataFrame(rows, "grp string, o bigint, role_signature array<string>, protocol_ref string")
    found = {(r.grp, r.o): r.cluster_id for r in clusters.cluster_new(df, "grp", "o", hot_rows=hot_rows).collect()}
    assert found == brute_clusters(rows)


def test_clusters_do_not_merge(spark):
    rows = [("g", 1, ["tutor"], None), ("g", 2, ["esperto"], None), ("g", 3, ["tutor", "esperto"], None), ("g", 4, ["esperto"], None)]
    df = spark.createDataFrame(rows, "grp string, o bigint, role_signature array<string>, protocol_ref string")
    assert {r.o: r.cluster_id for r in clusters.cluster_new(df, "grp", "o").collect()} == {1: 1, 2: 2, 3: 1, 4: 1}


def brute_match(item, known):
    key, cup, ref, roles, published, same = item
    live = sorted((t for t in known if t[1] == cup and t[4] in ("held", "sent") and t[5] >= AS_OF - timedelta(days=60)),
                  key=lambda t: (-t[5].timestamp(), t[0]))
    if not cup or not live:
        return None

    def apart(t):
        return abs((published - t[5].date()).days) if published else 31

    for t in live:
        if ref and t[2] == ref:
            return t[0]
    for t in live:
        if set(roles) & set(t[3]) and apart(t) <= 5:
            return t[0]
    nearest = min(live, key=apart)
    return nearest[0] if apart(nearest) <= 30 and same else None


def test_match_thread_with_a_dominant_project(spark):
    rnd = random.Random(5)
    cups = ["hot"] * 6 + ["a", "b", ""]
    known = [(f"T{i}", rnd.choice(cups[:8]), rnd.choice([None, f"R{i % 40}"]), rnd.sample(["tutor", "esperto", "rup"], rnd.randrange(3)),
              rnd.choice(["held", "sent", "closed"]), AS_OF - timedelta(days=rnd.randrange(90), minutes=rnd.randrange(1000))) for i in range(400)]
    items = [(f"I{i}", rnd.choice(cups), rnd.choice([None, None, f"R{rnd.randrange(60)}"]), rnd.sample(["tutor", "esperto", "rup"], rnd.randrange(3)),
              rnd.choice([None, date(2026, 6, 15) - timedelta(days=rnd.randrange(120))]), rnd.choice([True, False, None])) for i in range(500)]
    t = spark.createDataFrame(known, "thread_id string, cup string, protocol_ref string, role_signature array<string>, status string, updated_at timestamp")
    i = spark.createDataFrame(items, "item_key string, cup string, protocol_ref string, role_signature array<string>, published_date date, same_process boolean")
    t, i = t.withColumn("school_code", F.lit("S")), i.withColumn("school_code", F.lit("S"))
    found = {r.item_key: r.thread_id for r in threads.match_thread(i, t, AS_OF).collect()}
    assert found == {x[0]: brute_match(x, known) for x in items}
    wide = {r.item_key: r.thread_id for r in threads.match_thread(i.repartition(7), t.repartition(3), AS_OF).collect()}
    assert wide == found


def test_superseded_needs_the_code_and_the_date(spark):
    rows = [("1", "Avviso CUP X1", "10/06/2026"), ("2", "Graduatoria CUP X1", "12/06/2026"), ("3", "Avviso CUP X1", "20/06/2026"),
            ("4", "Avviso senza codice", "01/01/2026"), ("5", "Avviso CUP X1", "boh"), ("6", "Aggiudicazione cup x1", "01/06/2026")]
    df = spark.createDataFrame(rows, "item_id string, title string, published string").withColumn("school_code", F.lit("S")).withColumn(
        "cup", F.lit("X1")).withColumn("clp", F.lit(""))
    out = {r.item_id: r.superseded for r in lookups.with_superseded(df).collect()}
    assert out == {"1": True, "2": False, "3": False, "4": False, "5": True, "6": False}


@pytest.mark.parametrize("keys", [["k"], []])
def test_ordinal_is_exact_with_a_dominant_key(spark, keys):
    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice("abc"), i) for i in rnd.sample(range(10**6), 5000)]
    df = spark.createDataFrame(rows, "k string, o bigint").repartition(6)
    got = {(r.k, r.o): r.ordinal for r in ranking.ordinal(df, keys, ["o"]).collect()}
    seen, want = {}, {}
    for k, o in sorted(rows, key=lambda r: r[1]):
        slot = k if keys else ""
        seen[slot] = seen.get(slot, 0) + 1
        want[(k, o)] = seen[slot]
    assert got == want


def test_digest_has_one_shape_at_any_size(spark):
    names = ("school_name", "school_code", "region", "cup", "clp", "amount", "url", "opportunity_type", "deadline", "reason")
    df = spark.range(1100).select(F.when(F.col("id") < 11, "g").otherwise("big").alias("group_key"), F.col("id").alias("seq"),
                                  F.concat(F.lit("T"), F.col("id")).alias("title"), *[F.lit(n).alias(n) for n in names],
                                  F.lit("high").alias("confidence"), F.lit(True).alias("ai_used"), F.lit(None).cast("string").alias("reply_subject"))
    headers, blocks = reports.digest_parts(df, ["seq"])
    assert {r.group_key: r.n for r in headers.collect()} == {"g": 11, "big": 1089}
    assert sorted(r.block_no for r in blocks.filter("group_key = 'big'").collect()) == list(range(1, 1090))
    messages = {r.group_key: r for r in reports.digest(df, ["seq"]).collect()}
    body = messages["g"].body
    assert body.count("   Link: url") == 11 and body.index("\n1. T0") < body.index("\n11. T10")
    assert body.startswith("Nuova opportunità") and "Avvisi trovati (11)" in body
    assert messages["g"].subject == "Opportunità formatore IA PNRR: school_name — 11 avvisi"
    assert messages["big"].body.count("   Link: url") == 1089


ALERTS = "alert_key string, school_code string, url string, status string, message_id string, subject string, created_at timestamp, updated_at timestamp"


def test_lease_life_cycle(spark):
    old, fresh = AS_OF - timedelta(minutes=121), AS_OF - timedelta(minutes=120)
    rows = [(k, "S", "u", s, None, None, t, t) for k, s, t in (
        ("sent", "sent", old), ("live", "sending", fresh), ("stale", "sending", old), ("failed", "failed", fresh))]
    alerts = spark.createDataFrame(rows, ALERTS)
    asked = spark.createDataFrame([(k, i, "g" + k) for i, k in enumerate(["sent", "live", "stale", "failed", "new", "new"])], "alert_key string, seq bigint, group_key string")
    reserved = state_ops.reserve_alerts(asked, alerts, AS_OF)
    assert [r.granted for r in reserved.orderBy("seq").collect()] == [False, False, True, True, True, False]
    whole = state_ops.reserve_groups(reserved.withColumn("school_code", F.lit("S")).withColumn("url", F.lit("u")), "group_key")
    after = {r.alert_key: r.status for r in state_ops.lease_alerts(alerts, whole, AS_OF).collect()}
    assert after == {"sent": "sent", "live": "sending", "stale": "sending", "failed": "sending", "new": "failed"}
    failed = {r.alert_key: r.status for r in state_ops.mark_failed(alerts, alerts.select("alert_key"), AS_OF).collect()}
    assert failed == {"sent": "sent", "live": "failed", "stale": "failed", "failed": "failed"}


def test_upserts_are_idempotent_and_keep_frozen_columns(spark):
    columns = "item_key string, school_code string, title string, url string, stage string, reason string, updated_at timestamp"
    state = spark.createDataFrame([("k", "S0", "t0", "u", "prefilter_rejected", "", AS_OF)], columns)
    batch = spark.createDataFrame([("k", "S1", "t1", "u", "confirmed", "a", AS_OF, 1), ("k", "S2", "t2", "u", "alerted", "b", AS_OF, 2),
                                   ("n", "S3", "t3", "u", "expired", "c", AS_OF, 3)], columns + ", seq bigint")
    once = state_ops.upsert_decision(state, batch)
    twice = state_ops.upsert_decision(once, batch)
    rows = {r.item_key: (r.school_code, r.title, r.stage) for r in once.collect()}
    assert rows == {"k": ("S0", "t2", "alerted"), "n": ("S3", "t3", "expired")}
    assert sorted(once.collect()) == sorted(twice.collect())


def test_state_snapshots(spark, scratch):
    assert store.read_state(spark, scratch, "decisions").count() == 0
    row = spark.createDataFrame([("k", "S", "t", "p", AS_OF)], "item_key string, school_code string, title string, published string, first_seen timestamp")
    store.write_state(row, scratch, "processed_items")
    store.write_state(store.read_state(spark, scratch, "processed_items").unionByName(row.withColumn("item_key", F.lit("k2"))), scratch, "processed_items")
    assert store.read_state(spark, scratch, "processed_items").count() == 2


@pytest.mark.parametrize("hot_rows", [100_000, 1])
def test_entries_with_equal_order_keep_a_row_each(spark, hot_rows):
    rows = [("G", 1, ["tutor"], None), ("G", 1, ["rup"], "a"), ("G", 1, ["rup"], "a"), ("G", 2, [], None), ("G", 2, [], None),
            ("G", 3, ["rup"], None), ("G", 4, [], "a"), ("G", 5, ["esperto"], None), ("G", 5, ["esperto", "tutor"], "b")]
    df = spark.createDataFrame(rows, "grp string, o bigint, role_signature array<string>, protocol_ref string")
    found = sorted((r.o, r.role_signature, r.cluster_id) for r in clusters.cluster_new(df, "grp", "o", hot_rows=hot_rows).collect())
    assert found == [(1, ["rup"], 1), (1, ["rup"], 1), (1, ["tutor"], 1), (2, [], 2), (2, [], 2), (3, ["rup"], 1), (4, [], 1),
                     (5, ["esperto"], 5), (5, ["esperto", "tutor"], 1)]


def test_digest_rows_move_once_for_their_numbers(spark):
    columns = "group_key school_name school_code region cup clp amount title url opportunity_type deadline confidence ai_used reason reply_subject".split()
    rows = [(f"g{i % 3}" if i % 7 else None, f"s{i}", *["c"] * 5, f"t{i}", *["c"] * 3, "high", True, "r", None, i // 4) for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'boolean' if c == 'ai_used' else 'string'}" for c in columns) + ", seq long").repartition(5)
    headers, blocks = reports.digest_parts(df, ["seq"])
    # a group's header is of the entry that stands first, also where order keys are equal
    first = {r.group_key: r.text for r in blocks.filter("block_no = 1").collect()}
    for r in headers.filter("group_key IS NOT NULL").collect():
        name = r.header.split("Scuola: ")[1].split("\n")[0]
        assert f"1. t{name[1:]}\n" in first[r.group_key]
    assert "Join" not in blocks._jdf.queryExecution().executedPlan().toString()
    numbers = {}
    for r in blocks.collect():
        numbers.setdefault(r.group_key, []).append(r.block_no)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())
    assert sum(map(len, numbers.values())) == 60 and None in numbers
