"""Splits, weights, study grid and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.digests import content_digest as table_digest, membership_digest as ids_digest
from strideframe.operators import splits as sp, weights as wt
from strideframe.operators.windows import covered_duration as covered
from workload import views as v
from workload.metric_queries import rounded
from workload.registry import query, with_views

L = v.LABELS


@query("label_consistency", with_views("""
SELECT participant_id || '#' || phone_position AS group_id, min(label) AS lowest_label, max(label) AS highest_label,
  'mixed labels' AS problem FROM predictions GROUP BY 1 HAVING min(label) <> max(label)""", v.PREDICTIONS))
def label_consistency(spark, sf):
    """Groups by participant and phone position mix labels and must be reported."""
    mixed = v.predictions(spark, sf).withColumn("group_id", F.concat_ws("#", "participant_id", "phone_position"))
    return sp.label_consistency(mixed, L)


@query("sparse_modes", with_views("""
SELECT m AS transport_mode, count(DISTINCT participant_id) AS units, count(DISTINCT participant_id) < 30 AS sparse
FROM (SELECT unnest(['bus', 'car', 'train', 'tram']) AS m) LEFT JOIN predictions ON vehicle_type = m GROUP BY m""", v.PREDICTIONS))
def sparse_modes(spark, sf):
    return sp.sparse_modes(v.predictions(spark, sf), {**L, "tram": 3}, minimum=30)


@query("group_holdout_split", with_views("""
SELECT group_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('7|' || label || '|' || group_id))
  <= greatest(1, least(n - 1, CAST(floor(n * CASE label WHEN 0 THEN 0.8 ELSE 0.4 END) AS BIGINT))) THEN 'calibration' ELSE 'holdout' END AS role
FROM (SELECT group_id, min(label) AS label, count(*) OVER (PARTITION BY min(label)) AS n FROM predictions GROUP BY group_id)""", v.PREDICTIONS))
def group_holdout_split(spark, sf):
    return sp.group_holdout_split(v.predictions(spark, sf), L, {"bus": 0.8, "car": 0.4, "train": 0.4}, 7)


@query("group_kfold", with_views("""
SELECT group_id, (row_number() OVER (ORDER BY md5('7|' || group_id)) - 1) % 5 AS fold
FROM (SELECT DISTINCT group_id FROM predictions)""", v.PREDICTIONS))
def group_kfold(spark, sf):
    return sp.group_kfold(v.predictions(spark, sf), "group_id", 7)


@query("stratified_group_kfold", with_views("""
SELECT participant, label, rows, CASE WHEN (i // 4) % 2 = 0 THEN i % 4 ELSE 3 - i % 4 END AS fold FROM (
SELECT *, row_number() OVER (ORDER BY label, rows DESC, md5('7|' || participant)) - 1 AS i FROM (
SELECT participant, CAST(sum(n) AS BIGINT) AS rows, arg_max(label, (n, -label)) AS label FROM (
  SELECT participant_id || '-' || phone_position AS participant, label, count(*) AS n FROM predictions GROUP BY ALL) GROUP BY participant))""", v.PREDICTIONS))
def stratified_group_kfold(spark, sf):
    rows = v.predictions(spark, sf).withColumn("participant", F.concat_ws("-", "participant_id", "phone_position"))
    return sp.stratified_group_kfold(rows, "participant", 7, 4)


ROLLUP = ("rollup", """SELECT session_id, min(participant_id) AS participant_id, min(vehicle_type) AS vehicle_type, count(*) AS window_rows,
  min(window_start_ms) AS window_start_ms, max(window_end_ms) AS window_end_ms FROM predictions GROUP BY session_id""")


@query("session_rollup", with_views("SELECT * FROM rollup", v.PREDICTIONS, ROLLUP))
def session_rollup(spark, sf):
    return sp.session_rollup(v.predictions(spark, sf))


HASHED = ("hashed", """SELECT participant_id, ('0x' || substr(md5(session_id), 1, 15))::HUGEINT AS a,
  ('0x' || substr(md5(session_id), 17, 15))::HUGEINT AS b FROM rollup""")


@query("lopo_folds", with_views("""
SELECT participant_id AS held_out_participant_id, n AS test_sessions, CAST(sum(n) OVER () AS BIGINT) - n AS pool_sessions,
  sha256(n || '|' || a || '|' || b) AS test_digest,
  sha256((CAST(sum(n) OVER () AS BIGINT) - n) || '|' || (sum(a) OVER () - a) || '|' || (sum(b) OVER () - b)) AS pool_digest
FROM (SELECT participant_id, count(*) AS n, sum(a) AS a, sum(b) AS b FROM hashed GROUP BY participant_id)""", v.PREDICTIONS, ROLLUP, HASHED))
def lopo_folds(spark, sf):
    return sp.lopo_folds(sp.session_rollup(v.predictions(spark, sf)))


SELECTION = (v.PREDICTIONS, ROLLUP, ("pools", """
SELECT r.*, f.participant_id AS held_out_participant_id, s.seed FROM rollup r JOIN (SELECT DISTINCT participant_id FROM rollup) f
  ON f.participant_id <> r.participant_id CROSS JOIN (SELECT unnest([42, 43]) AS seed) s"""), ("selection", """
SELECT * EXCLUDE (k, n) FROM (SELECT *, row_number() OVER (PARTITION BY held_out_participant_id, seed, vehicle_type
    ORDER BY md5(seed || '|' || vehicle_type || '|' || session_id)) AS k,
  count(*) OVER (PARTITION BY held_out_participant_id, seed, vehicle_type) AS n FROM pools),
  (SELECT unnest([0.1, 0.5, 1.0]::DOUBLE[]) AS fraction)
WHERE k <= CASE WHEN fraction = 1 THEN n ELSE greatest(1, CAST(floor(n * fraction) AS BIGINT)) END"""))


def selection(spark, sf):
    sessions = sp.numbered_sessions(sp.session_rollup(v.predictions(spark, sf)))
    return sessions, sp.nested_calibration(sessions, (0.1, 0.5, 1.0), (42, 43))


@query("nested_calibration", with_views("""
SELECT held_out_participant_id, seed, fraction, vehicle_type, count(*) AS sessions, min(session_id) AS first_session,
  max(session_id) AS last_session, CAST(sum(window_rows) AS BIGINT) AS window_rows FROM selection GROUP BY ALL""", *SELECTION))
def nested_calibration(spark, sf):
    return selection(spark, sf)[1].groupBy("held_out_participant_id", "seed", "fraction", "vehicle_type").agg(
        F.count("*").alias("sessions"), F.min("session_id").alias("first_session"),
        F.max("session_id").alias("last_session"), F.sum("window_rows").alias("window_rows"))


@query("effective_fractions", with_views("""
SELECT x.held_out_participant_id, seed, fraction, sessions, windows, round(d, 6) AS duration_seconds, round(sessions / ps, 6) AS session_fraction,
  round(windows / pw, 6) AS window_fraction, round(d / pd, 6) AS duration_fraction, sha256(sessions || '|' || a || '|' || b) AS session_digest
FROM (SELECT held_out_participant_id, seed, fraction, count(*) AS sessions, CAST(sum(window_rows) AS BIGINT) AS windows,
    sum(window_end_ms - window_start_ms) / 1000.0 AS d, sum(('0x' || substr(md5(session_id), 1, 15))::HUGEINT) AS a,
    sum(('0x' || substr(md5(session_id), 17, 15))::HUGEINT) AS b FROM selection GROUP BY ALL) x
JOIN (SELECT held_out_participant_id, count(*) AS ps, sum(window_rows) AS pw, sum(window_end_ms - window_start_ms) / 1000.0 AS pd
  FROM pools WHERE seed = 42 GROUP BY ALL) p ON p.held_out_participant_id = x.held_out_participant_id""", *SELECTION))
def effective_fractions(spark, sf):
    found = sp.effective_fractions(*selection(spark, sf))
    return rounded(found, "duration_seconds", "session_fraction", "window_fraction", "duration_fraction")


CELLS = "(VALUES ('source_only', CAST(0 AS DOUBLE)), " + ", ".join(
    f"('{c}', CAST({f} AS DOUBLE))" for f in (0.1, 0.25, 0.5, 0.75, 1.0) for c in ("local_only", "pooled")) + ") AS c(condition, fraction)"
GRID_SQL = ("study_grid", f"""SELECT seed, condition, fraction,
  condition || '-local-' || replace(printf('%.2f', fraction), '.', 'p') || '-seed-' || seed AS run_name
FROM (SELECT DISTINCT seed FROM predictions), {CELLS}""")


@query("study_grid", with_views("SELECT * FROM study_grid", v.PREDICTIONS, GRID_SQL))
def study_grid(spark, sf):
    """The grid over the seeds that occur in the predictions."""
    from strideframe.config import StudyGrid
    return sp.study_grid(v.predictions(spark, sf).select("seed"), StudyGrid())


@query("limited_grid", with_views("""
SELECT condition, fraction, seed FROM study_grid ORDER BY seed, condition <> 'source_only', condition, fraction LIMIT 7""", v.PREDICTIONS, GRID_SQL))
def limited_grid(spark, sf):
    """The first seven runs of the ordered grid over the seeds that occur in the predictions."""
    from strideframe.config import StudyGrid
    from strideframe.plans.study import grid_runs
    seeds = tuple(sorted(r[0] for r in v.predictions(spark, sf).select("seed").distinct().collect()))
    return spark.createDataFrame(grid_runs(StudyGrid(seeds=seeds), 7), "condition string, fraction double, seed int")


@query("grid_completeness", with_views("""
SELECT CAST(33 AS BIGINT) AS expected_runs, (SELECT count(*) FROM study_runs) AS observed_runs,
  (SELECT count(*) FROM study_grid WHERE run_name NOT IN (SELECT run_name FROM study_runs)) AS missing_runs,
  (SELECT count(*) FROM (SELECT run_name FROM study_runs GROUP BY 1 HAVING count(*) > 1)) AS duplicate_runs,
  (SELECT count(DISTINCT run_name) FROM study_runs WHERE run_name NOT IN (SELECT run_name FROM study_grid)) AS unexpected_runs,
  (SELECT count(DISTINCT evaluation_digest) FROM study_runs) AS evaluation_digests, false AS valid""",
    v.PREDICTIONS, v.STUDY, GRID_SQL, ("study_runs", """SELECT condition || '-local-' || replace(printf('%.2f', fraction), '.', 'p') || '-seed-' || seed AS run_name,
  count(*) AS evaluation_digest FROM study_predictions GROUP BY condition, fraction, seed""")))
def grid_completeness(spark, sf):
    """The predicted runs cover only two of five fractions, so the grid is incomplete."""
    from strideframe.config import StudyGrid
    study = v.study_predictions(spark, sf)
    runs = study.groupBy("condition", "fraction", "seed").agg(F.count("*").alias("evaluation_digest")).withColumn(
        "run_name", sp.run_key(F.col("condition"), F.col("fraction"), F.col("seed")))
    return sp.grid_completeness(sp.study_grid(study.select("seed"), StudyGrid()), runs)


@query("leakage_check", with_views("""
SELECT 'held-out participant in training' AS violation, participant_id || '|' || session_id AS subject FROM predictions
  WHERE row_key % 500 = 3 GROUP BY ALL
UNION ALL SELECT 'session not predicted', session_id FROM predictions GROUP BY session_id HAVING count(*) FILTER (WHERE row_key % 7 <> 0) = 0
UNION ALL SELECT 'row predicted more than once', CAST(row_key AS VARCHAR) FROM predictions WHERE row_key % 700 = 1
UNION ALL SELECT 'row not predicted', CAST(row_key AS VARCHAR) FROM predictions WHERE row_key % 7 = 0""", v.PREDICTIONS))
def leakage_check(spark, sf):
    """A flawed evaluation: some training rows of the held-out person, some rows repeated, some lost."""
    p = v.predictions(spark, sf)
    k = F.col("row_key")
    training = p.withColumn("held_out_participant_id", F.when(k % 500 == 3, F.col("participant_id")).otherwise("none"))
    predicted = p.where(k % 7 != 0)
    predicted = predicted.unionByName(predicted.where(k % 700 == 1))
    return sp.leakage_check(training, predicted, p, ["row_key"])


@query("condition_training_frame", with_views("""
SELECT c AS condition, domain, label, count(*) AS rows FROM
 (SELECT unnest(['source_only', 'local_only', 'pooled']) AS c), sensor_events
WHERE (c <> 'local_only' AND domain = 'source') OR (c <> 'source_only' AND domain = 'collector' AND participant_id <> 'p3') GROUP BY ALL""", v.SENSOR_EVENTS))
def condition_training_frame(spark, sf):
    e = v.sensor_events(spark, sf)
    source, local = e.where("domain = 'source'"), e.where("domain = 'collector'")
    selected = local.where("participant_id <> 'p3'").select("session_id")
    frames = [sp.condition_training_frame(c, source, local, selected).withColumn("condition", F.lit(c))
              for c in ("source_only", "local_only", "pooled")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).groupBy("condition", "domain", "label").agg(
        F.count("*").alias("rows"))


@query("class_weights", with_views("""
SELECT session_id, window_start_ms, window_end_ms, domain, label,
  round(count(*) OVER () / (3.0 * count(*) OVER (PARTITION BY label)) * CASE WHEN domain = 'collector' THEN 2 ELSE 1 END, 6) AS weight FROM intervals""", v.INTERVALS))
def class_weights(spark, sf):
    found = wt.class_weights(v.intervals(spark, sf), local_weight=2.0)
    return rounded(found.select("session_id", "window_start_ms", "window_end_ms", "domain", "label", "weight"), "weight")


@query("hierarchical_weights", with_views("""
SELECT session_id, window_start_ms, window_end_ms, round(m / people / sessions / rows * total / (SELECT sum(DISTINCT_MASS) FROM
    (SELECT DISTINCT domain, label, CASE WHEN domain = 'collector' THEN 2.0 ELSE 1.0 END AS DISTINCT_MASS FROM intervals)), 6) AS weight
FROM (SELECT i.*, CASE WHEN domain = 'collector' THEN 2.0::DOUBLE ELSE 1.0 END AS m, count(*) OVER () AS total,
    count(*) OVER (PARTITION BY domain, label, participant_id, session_id) AS rows,
    count(DISTINCT session_id) OVER (PARTITION BY domain, label, participant_id) AS sessions,
    count(DISTINCT participant_id) OVER (PARTITION BY domain, label) AS people FROM intervals i)""", v.INTERVALS))
def hierarchical_weights(spark, sf):
    found = wt.hierarchical_weights(v.intervals(spark, sf), local_weight=2.0)
    return rounded(found.select("session_id", "window_start_ms", "window_end_ms", "weight"), "weight")


COVERED = (v.INTERVALS, ("islands", """
SELECT session_id, min(label) AS label, min(participant_id) AS participant_id, sum(e - s) / 1000.0 AS duration_seconds FROM (
SELECT session_id, island, min(label) AS label, min(participant_id) AS participant_id, min(window_start_ms) AS s, max(window_end_ms) AS e FROM (
SELECT *, sum(CASE WHEN reach IS NULL OR window_start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY window_start_ms, window_end_ms ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, max(window_end_ms) OVER (PARTITION BY session_id ORDER BY window_start_ms, window_end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals))
GROUP BY session_id, island) GROUP BY session_id"""))


@query("covered_duration", with_views("SELECT session_id, round(CAST(duration_seconds AS DOUBLE), 3) AS duration_seconds FROM islands", *COVERED))
def covered_duration(spark, sf):
    found = covered(v.intervals(spark, sf), ["session_id"], bucket_ms=30 * v.DAY)
    return found.select("session_id", F.round("duration_seconds", 3).alias("duration_seconds"))


@query("session_table", with_views("SELECT session_id, label, participant_id, round(CAST(duration_seconds AS DOUBLE), 3) AS duration_seconds FROM islands", *COVERED))
def session_table(spark, sf):
    found = wt.session_table(v.intervals(spark, sf), bucket_ms=30 * v.DAY)
    return found.withColumn("duration_seconds", F.round("duration_seconds", 3))


@query("duration_balance", with_views("""
SELECT session_id, label, participant_id, round(CAST(duration_seconds AS DOUBLE), 3) AS duration_seconds, round, round(CAST(before AS DOUBLE), 3) AS seconds_before, round(CAST(target AS DOUBLE), 3) AS target_seconds
FROM (SELECT *, coalesce(sum(duration_seconds) OVER (PARTITION BY label ORDER BY round, participant_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT *, row_number() OVER (PARTITION BY label, participant_id ORDER BY md5('7|' || label || '|' || participant_id || '|' || session_id)) AS round FROM islands)),
 (SELECT min(d) AS target FROM (SELECT sum(duration_seconds) AS d FROM islands GROUP BY label)) WHERE before < target""", *COVERED))
def duration_balance(spark, sf):
    sessions = wt.session_table(v.intervals(spark, sf), bucket_ms=30 * v.DAY)
    found = wt.duration_balance(sessions, 7)
    names = ["duration_seconds", "seconds_before", "target_seconds"]
    return found.select(*[F.round(c, 3).alias(c) if c in names else F.col(c) for c in found.columns])


@query("membership_digest", """
SELECT l_orderkey AS manifest, count(DISTINCT l_linenumber || '-' || l_partkey) AS members,
  sha256('["' || string_agg(DISTINCT l_linenumber || '-' || l_partkey, '","' ORDER BY l_linenumber || '-' || l_partkey) || '"]') AS digest
FROM lineitem GROUP BY l_orderkey""")
def membership_digest(spark, sf):
    """One small manifest per order; its members are the order's lines."""
    ids = F.concat_ws("-", "l_linenumber", "l_partkey")
    return v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("manifest")).agg(
        F.count_distinct(ids).alias("members"), ids_digest(ids).alias("digest"))


DIGEST_COLUMNS = ["session_id", "label", "participant_id", "window_start_ms", "window_end_ms"]


@query("content_digest", with_views("""
SELECT count(*) AS n_rows, sha256('session_id:string;label:bigint;participant_id:string;window_start_ms:bigint;window_end_ms:bigint|' || count(*) || '|'
  || sum(('0x' || substr(h, 1, 15))::HUGEINT) || '|' || sum(('0x' || substr(h, 17, 15))::HUGEINT)) AS digest
FROM (SELECT md5(concat_ws(',', %s)) AS h FROM intervals)""" % ", ".join(
    f"length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in DIGEST_COLUMNS), v.INTERVALS))
def content_digest(spark, sf):
    return table_digest(v.intervals(spark, sf), DIGEST_COLUMNS)
