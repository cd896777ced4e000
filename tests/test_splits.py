import hashlib

import pytest
from pyspark.sql import functions as F

from strideframe.config import StudyGrid, calibration_fractions
from strideframe.functions.digests import content_digest, set_digest
from strideframe.operators import splits as sp, weights as wt
from tests.helpers import nodes, plain_plans, values

L = {"bus": 0, "car": 1, "train": 2}


def windows(spark, groups, rows=2):
    """(label, group count) pairs -> window rows, one participant and session per group."""
    out = [(f"g{label}-{g}", label, f"p{g}", f"s{label}-{g}", i * 1000) for label, n in groups.items() for g in range(n) for i in range(rows)]
    return spark.createDataFrame(out, "group_id string, label int, participant_id string, session_id string, window_start_ms bigint")


def roles(frame, label):
    return sorted(r.role for r in frame.where(F.col("label") == label).collect())


def test_shares_per_class(spark):
    df = windows(spark, {0: 5, 1: 5, 2: 5})
    found = sp.group_holdout_split(df, L, {"bus": 0.8, "car": 0.4, "train": 0.4}, 3)
    assert [roles(found, i).count("calibration") for i in range(3)] == [4, 2, 2]
    again = sp.group_holdout_split(df.orderBy(F.desc("group_id")), L, {"bus": 0.8, "car": 0.4, "train": 0.4}, 3)
    assert values(found) == values(again)


def test_counts_are_clamped_and_one_group_raises(spark):
    assert roles(sp.group_holdout_split(windows(spark, {0: 2, 1: 2, 2: 2}), L, 0.9, 1), 0) == ["calibration", "holdout"]
    with pytest.raises(Exception, match="fewer than two groups"):
        sp.group_holdout_split(windows(spark, {0: 2, 1: 1, 2: 2}), L, 0.5, 1).collect()
    with pytest.raises(ValueError):
        calibration_fractions({"bus": 0.5}, L)


def test_mixed_group_raises(spark):
    df = windows(spark, {0: 3}).withColumn("label", F.pmod(F.col("window_start_ms") / 1000, F.lit(2)).cast("int"))
    with pytest.raises(Exception, match="exactly one configured label"):
        sp.group_labels(df, L).collect()


def test_folds_hold_whole_groups(spark):
    df = windows(spark, {0: 2, 1: 8, 2: 4})
    folds = sp.group_kfold(df, "group_id", 1)
    assert folds.count() == 14 and {r.fold for r in folds.collect()} == set(range(5))
    dealt = sp.stratified_group_kfold(df, "group_id", 1, 2)
    per = dealt.groupBy("label", "fold").count().collect()
    assert all(r["count"] == {0: 1, 1: 4, 2: 2}[r.label] for r in per)


def sessions(spark):
    out = [(f"p{p}", f"p{p}-{m}-{s}", m, i, 0, 60_000) for p in range(7) for i, m in enumerate(L) for s in range(4)]
    return spark.createDataFrame(out, "participant_id string, session_id string, vehicle_type string, label int, window_start_ms bigint, window_end_ms bigint")


def test_one_participant_per_fold(spark):
    folds = sp.lopo_folds(sp.session_rollup(sessions(spark))).collect()
    assert [(r.test_sessions, r.pool_sessions) for r in folds] == [(12, 72)] * 7
    assert len({r.pool_digest for r in folds}) == 7


def test_calibration_subsets_are_nested_and_shared(spark):
    rollup = sp.session_rollup(sessions(spark))
    chosen = sp.nested_calibration(rollup, (0.1, 0.5, 1.0), (42, 43))
    assert sp.not_nested(chosen).count() == 0
    counts = {(r.fraction, r["count"]) for r in chosen.groupBy("held_out_participant_id", "seed", "fraction", "vehicle_type").count().collect()}
    assert counts == {(0.1, 2), (0.5, 12), (1.0, 24)}
    assert chosen.where("participant_id = held_out_participant_id").count() == 0
    swapped = chosen.withColumn("fraction", F.when(F.col("fraction") == 0.1, 0.5).when(F.col("fraction") == 0.5, 0.1).otherwise(1.0))
    assert sp.not_nested(swapped).count() > 0


def test_grid_counts(spark):
    seeds = spark.createDataFrame([(42,), (43,), (44,)], "seed int")
    grid = sp.study_grid(seeds, StudyGrid())
    assert grid.count() == 33 and grid.where("run_name = 'pooled-local-0p25-seed-43'").count() == 1
    runs = grid.withColumn("evaluation_digest", F.lit("d"))
    assert sp.grid_completeness(grid, runs).first()["valid"]
    short = sp.grid_completeness(grid, runs.where("seed < 44 OR fraction < 1").unionByName(runs.limit(1))).first()
    assert (short.missing_runs, short.duplicate_runs, short.valid) == (2, 1, False)


def test_hierarchical_masses(spark):
    rows = [("source", 0, "p1", "a"), ("source", 0, "p1", "b"), ("source", 0, "p2", "c"), ("collector", 0, "p3", "d"),
            ("collector", 0, "p3", "d"), ("collector", 1, "p3", "e"), ("source", 1, "p1", "f"), ("collector", 1, "p4", "g")]
    df = spark.createDataFrame(rows, "domain string, label int, participant_id string, session_id string")
    found = wt.hierarchical_weights(df, local_weight=2.0)
    assert found.agg(F.sum("weight")).first()[0] == pytest.approx(8)
    mass = {(r.domain, r.label): r.w for r in found.groupBy("domain", "label").agg(F.sum("weight").alias("w")).collect()}
    assert mass[("collector", 0)] == pytest.approx(mass[("collector", 1)]) == pytest.approx(2 * mass[("source", 0)])
    person = {r.participant_id: r.w for r in found.where("domain = 'source' AND label = 0").groupBy("participant_id").agg(F.sum("weight").alias("w")).collect()}
    assert person["p1"] == pytest.approx(person["p2"])


def balanced(rows, target):
    """The queue: participants take turns until the class has reached the target."""
    queues, kept, total = {}, [], 0.0
    for person, session, seconds in rows:
        queues.setdefault(person, []).append((session, seconds))
    while total < target and any(queues.values()):
        for person in sorted(queues):
            if queues[person] and total < target:
                session, seconds = queues[person].pop(0)
                kept.append(session)
                total += seconds
    return kept


def test_duration_balance_equals_the_queue(spark):
    import hashlib
    import random
    rng = random.Random(4)
    rows = [(f"s{i}", rng.choice((0, 1, 1, 1)), f"p{rng.choice((0, 0, 0, 1, 2))}", float(rng.randint(10, 500))) for i in range(300)]
    found = wt.duration_balance(spark.createDataFrame(rows, "session_id string, label bigint, participant_id string, duration_seconds double"), 7)
    got = {r.session_id for r in found.collect()}
    target = min(sum(r[3] for r in rows if r[1] == label) for label in (0, 1))
    expected = set()
    for label in (0, 1):
        mine = sorted((r for r in rows if r[1] == label), key=lambda r: hashlib.md5(f"7|{label}|{r[2]}|{r[0]}".encode()).hexdigest())
        expected |= set(balanced([(r[2], r[0], r[3]) for r in mine], target))
    assert got == expected


def test_balancing_keeps_source_rows_and_whole_sessions(spark):
    rows = [("collector", f"b{i}", 0, "p0", w * 50_000, (w + 1) * 50_000) for i in range(2) for w in range(2)]
    rows += [("collector", f"c{i}", 1, f"p{i % 2}", w * 50_000, (w + 1) * 50_000) for i in range(4) for w in range(2)]
    rows += [("source", f"x{i}", 1, "q", 0, 1000) for i in range(2)]
    df = spark.createDataFrame(rows, "domain string, session_id string, label bigint, participant_id string, window_start_ms bigint, window_end_ms bigint")
    kept = wt.balanced_rows(df, 1)
    assert kept.where("domain = 'source'").count() == 2
    cars = kept.where("domain = 'collector' AND label = 1")
    assert cars.select("session_id").distinct().count() == 2 and cars.count() == 4
    assert cars.select("participant_id").distinct().count() == 2


def test_content_digest_ignores_order_only(spark):
    df = windows(spark, {0: 3, 1: 2})
    columns = df.columns
    digest = lambda d: content_digest(d, columns).first()["digest"]
    assert digest(df) == digest(df.orderBy(F.desc("session_id")).repartition(3))
    assert digest(df) != digest(df.withColumn("label", F.col("label") + 1))
    assert digest(df) != digest(df.withColumn("label", F.col("label").cast("bigint")))
    assert digest(df) != digest(df.unionByName(df.limit(1)))


def test_weights_keep_rows_without_participant(spark):
    from strideframe.operators.weights import hierarchical_weights
    rows = spark.createDataFrame([("d", 0, None, "s1"), ("d", 0, "p", "s2"), ("d", 1, "p", None)], "domain string, label int, participant_id string, session_id string")
    found = [r.weight for r in hierarchical_weights(rows).collect()]
    assert len(found) == 3 and abs(sum(found) - 3) < 1e-9


def test_ranks_keep_null_keys(spark):
    from strideframe.operators.ordered import ranked
    rows = spark.createDataFrame([(None, 0, 5), (None, 1, 7), ("a", 0, 1)], "k string, b int, v int")
    assert sorted((r.k or "", r.v, r["rank"]) for r in ranked(rows, ["k"], "b", ["v"]).collect()) == [("", 5, 1), ("", 7, 2), ("a", 1, 1)]


def test_leakage_is_found_row_by_row_and_session_by_session(spark):
    from strideframe.operators.splits import leakage_check
    made = lambda rows: spark.createDataFrame(rows, "k long, session_id string, participant_id string, held_out_participant_id string")
    evaluation = made([(k, f"s{k // 3}", "p", "p") for k in range(9)])
    assert leakage_check(made([(1, "x", "q", "p")]), evaluation, evaluation, ["k"]).count() == 0
    bad = made([(0, "s0", "p", "p"), (0, "s0", "p", "p"), (1, "s0", "p", "p"), (3, "s1", "p", "p"), (4, "s1", "p", "p"), (5, "s1", "p", "p"), (99, "new", "p", "p")])
    found = sorted(tuple(r) for r in leakage_check(made([(7, "y", "p", "p"), (8, "y", "p", "p")]), bad, evaluation, ["k"]).collect())
    assert found == [("held-out participant in training", "p|y"), ("row not predicted", "2"), *[("row not predicted", str(k)) for k in (6, 7, 8)],
                     ("row predicted more than once", "0"), ("session not predicted", "s2"), ("unexpected session", "new")]


def test_selections_move_no_session_by_mode_and_hash_each_once(spark):
    """The cut-off keys go to every task, and digests from the numbers that sessions hold are those of the ids."""
    rows = [(f"s{i}", f"p{i % 4}", "bus" if i % 3 else "car", i, 1000 * i, 1000 * i + 500) for i in range(40)]
    sessions = spark.createDataFrame(rows, "session_id string, participant_id string, vehicle_type string, window_rows bigint, window_start_ms bigint, window_end_ms bigint")
    numbered = sp.numbered_sessions(sessions)
    with plain_plans(spark):
        chosen = sp.nested_calibration(numbered, (0.5, 1.0), (1,))
        assert next(n.nodeName() for n in nodes(chosen) if n.nodeName().endswith("Join")) == "BroadcastHashJoin"
    found = sp.effective_fractions(numbered, chosen)
    assert found.count() == 8
    assert values(found) == values(sp.effective_fractions(sessions, sp.nested_calibration(sessions, (0.5, 1.0), (1,))))


def test_set_digest_adds_md5_numbers(spark):
    ids = ["a", "b", "b", None, "é"]
    number = lambda x, at: int(hashlib.md5(x.encode()).hexdigest()[at : at + 15], 16)
    (found,) = spark.createDataFrame([(x,) for x in ids], "id string").agg(set_digest(F.col("id")).alias("d")).select("d.*").collect()
    assert (found.n, int(found.a), int(found.b)) == (5, *(sum(number(x, at) for x in ids if x is not None) for at in (0, 16)))
    (none,) = spark.createDataFrame([(None,)], "id string").agg(set_digest(F.col("id")).alias("d")).select("d.*").collect()
    assert (none.n, none.a, none.b) == (1, None, None)
