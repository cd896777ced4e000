"""Set joins, snapshot summaries, leaderboards and run-store work."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.operators import normalize as nz, reports as rp
from strideframe.sources import records
from workload import views as v
from workload.metric_queries import rounded
from workload.registry import query, with_views
from workload.source_queries import DURATION, TRIAL_VIEWS, metric_documents


@query("semi_sessions", with_views("""
SELECT session_id, count(*) AS rows FROM predictions WHERE session_id IN (SELECT session_id FROM predictions WHERE prediction <> label) GROUP BY ALL""", v.PREDICTIONS))
def semi_sessions(spark, sf):
    p = v.predictions(spark, sf)
    ids = p.where("prediction <> label").select("session_id").distinct()
    return rp.semi_sessions(p, ids).groupBy("session_id").agg(F.count("*").alias("rows"))


@query("anti_pending", with_views("""
SELECT session_id, count(*) AS rows FROM predictions WHERE session_id NOT IN (SELECT session_id FROM predictions WHERE prediction <> label) GROUP BY ALL""", v.PREDICTIONS))
def anti_pending(spark, sf):
    p = v.predictions(spark, sf)
    return rp.anti_pending(p, p.where("prediction <> label")).groupBy("session_id").agg(F.count("*").alias("rows"))


FACTS = ("facts", f"""SELECT lower(coalesce(nullif(vehicle_type, ''), 'unknown')) AS mode, participant_id AS participant,
  CAST({DURATION} AS DOUBLE) AS d, TRY_CAST(sample_count AS BIGINT) AS c FROM sidecars""")
CLOCK = "printf('%02d:%02d:%02d', CAST(round_even(s, 0) AS BIGINT) // 3600, CAST(round_even(s, 0) AS BIGINT) % 3600 // 60, CAST(round_even(s, 0) AS BIGINT) % 60)"


@query("mode_summary", with_views(f"""
SELECT mode, sessions, participants, round(s, 3) AS duration_seconds, {CLOCK} AS duration, samples FROM (
SELECT CASE WHEN grouping(mode) = 1 THEN 'Total' ELSE mode END AS mode, count(*) AS sessions, count(DISTINCT participant) AS participants,
  sum(coalesce(d, 0)) AS s, CAST(sum(coalesce(c, 0)) AS BIGINT) AS samples FROM facts GROUP BY ROLLUP (mode))""", v.SIDECARS, FACTS))
def mode_summary(spark, sf):
    found = rp.mode_summary(nz.snapshot_facts(v.sidecars(spark, sf)))
    return found.withColumn("duration_seconds", F.round("duration_seconds", 3))


MODES = ("bus", "car", "train", "unknown")


@query("participant_mode_crosstab", with_views("""
SELECT CASE WHEN grouping(participant) = 1 THEN 'Total' ELSE participant END AS participant, %s, round(sum(coalesce(d, 0)), 3) AS total
FROM facts GROUP BY ROLLUP (participant)""" % ", ".join(
    f"round(coalesce(sum(coalesce(d, 0)) FILTER (WHERE mode = '{m}'), 0), 3) AS {m}" for m in MODES), v.SIDECARS, FACTS))
def participant_mode_crosstab(spark, sf):
    found = rp.participant_mode_crosstab(nz.snapshot_facts(v.sidecars(spark, sf)), MODES)
    return found.select("participant", *[F.round(c, 3).alias(c) for c in (*MODES, "total")])


def classes(spark, sf):
    return records.metric_classes(metric_documents(spark, sf)).withColumn("path", F.col("run_id"))


@query("rank_by_class_recall", with_views("""
SELECT run_id, trial_name, round(recall, 6) AS recall FROM trials WHERE transport_mode = 'car' ORDER BY trials.recall DESC, trial_name, trial_hash LIMIT 10""", *TRIAL_VIEWS))
def rank_by_class_recall(spark, sf):
    return rp.rank_by_class_recall(classes(spark, sf), "car", 10).select("run_id", "trial_name", F.round("recall", 6).alias("recall"))


RUN_SCORES = ("run_scores", """SELECT run_id || '/' || trial AS run_id, trial_name, trial_hash, sum(right_rows) / sum(support) AS accuracy,
  sum(recall) / 3 AS balanced_accuracy, min(recall) AS minimum_class_recall FROM trials GROUP BY ALL""")
SCORES = ["accuracy", "balanced_accuracy", "minimum_class_recall"]


def scored(spark, sf):
    d = metric_documents(spark, sf)
    return d.select("trial_name", "trial_hash", "trial_index", F.col("trial_hash").alias("run_id"), F.col("run_id").alias("path"), *SCORES)


@query("dedupe_conflicts", with_views("""
SELECT trial_hash AS run_id, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy, round(minimum_class_recall, 6) AS minimum_class_recall,
  'copy 1' AS path FROM run_scores""", *TRIAL_VIEWS, RUN_SCORES))
def dedupe_conflicts(spark, sf):
    """Every run is found twice with equal values; the copy with the lower path stays."""
    s = scored(spark, sf)
    both = s.withColumn("path", F.lit("copy 2")).unionByName(s.withColumn("path", F.lit("copy 1")))
    return rounded(rp.dedupe_conflicts(both, "run_id", SCORES, "path"), *SCORES)


@query("top_runs_by_metric", with_views(" UNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS metric, trial_hash AS run_id, round({m}, 6) AS value FROM run_scores ORDER BY run_scores.{m} DESC, trial_hash LIMIT 5)" for m in SCORES),
    *TRIAL_VIEWS, RUN_SCORES))
def top_runs_by_metric(spark, sf):
    runs = rp.dedupe_conflicts(scored(spark, sf), "run_id", SCORES, "path")
    return rounded(rp.top_runs_by_metric(runs, SCORES, 5), "value")


@query("best_trial", with_views("""
SELECT trial_name, trial_hash, round(minimum_class_recall, 6) AS minimum_class_recall FROM run_scores ORDER BY run_scores.minimum_class_recall DESC, trial_name, trial_hash LIMIT 1""", *TRIAL_VIEWS, RUN_SCORES))
def best_trial(spark, sf):
    return rounded(rp.best_trial(scored(spark, sf), "minimum_class_recall").select("trial_name", "trial_hash", "minimum_class_recall"), "minimum_class_recall")


@query("trial_recall_table", with_views("""
SELECT trial_index, trial_name, trial_hash, %s FROM trials GROUP BY trial_index, trial_name, trial_hash""" % ", ".join(
    f"round(max(recall) FILTER (WHERE transport_mode = '{m}'), 6) AS {m}" for m in v.LABELS), *TRIAL_VIEWS))
def trial_recall_table(spark, sf):
    return rounded(rp.trial_recall_table(classes(spark, sf), list(v.LABELS)).drop("path"), *v.LABELS)


@query("even_sample", with_views("""
SELECT label, i AS sample_index, position, session_id, row_key FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY session_id, window_start_ms, window_end_ms, row_key) AS position, count(*) OVER (PARTITION BY label) AS n FROM predictions)
JOIN (SELECT CAST(unnest(range(20)) AS INT) AS i) ON position = i * (n - 1) // 19 + 1""", v.PREDICTIONS))
def even_sample(spark, sf):
    order = ["session_id", "window_start_ms", "window_end_ms", "row_key"]
    rows = v.predictions(spark, sf).select("label", *order)
    return rp.even_sample(rows, 20, order).select("label", "sample_index", "position", "session_id", "row_key")


def run_store(spark, sf):
    """Runs from orders, experiments from nations, parameters and metrics from line items."""
    o, n, l = [v.table(spark, sf, t) for t in ("orders", "nation", "lineitem")]
    experiments = n.select(F.col("n_nationkey").cast("bigint").alias("experiment_id"), F.concat(F.lit("study "), F.col("n_regionkey")).alias("name"),
                           F.when(F.col("n_nationkey") % 7 == 3, "deleted").otherwise("active").alias("lifecycle_stage"))
    runs = o.select(F.concat(F.lit("run"), F.col("o_orderkey")).alias("run_uuid"), (F.col("o_orderkey") % 25).alias("experiment_id"),
                    F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("active").alias("lifecycle_stage"))
    run = F.concat(F.lit("run"), F.col("l_orderkey"))
    params = l.where("l_linenumber = 1").select(
        run.alias("run_uuid"), F.lit("window_seconds").alias("key"), (F.col("l_quantity").cast("bigint") % 6 * 10 + 10).cast("string").alias("value"))
    metrics = l.where("l_linenumber <= 2").select(
        run.alias("run_uuid"), F.when(F.col("l_linenumber") == 1, "macro_f1").otherwise("loss").alias("key"), (F.col("l_discount") * 10).alias("value"),
        F.when(F.col("l_suppkey") % 9 == 0, 1).otherwise(0).alias("is_nan"))
    return experiments, runs, params, metrics


@query("window_f1_average", """
SELECT CAST(CAST(p.l_quantity AS BIGINT) % 6 * 10 + 10 AS DOUBLE) AS window_seconds, round(avg(m.l_discount * 10), 6) AS average_f1, count(*) AS run_count
FROM nation e JOIN orders r ON r.o_orderkey % 25 = e.n_nationkey JOIN lineitem p ON p.l_orderkey = r.o_orderkey AND p.l_linenumber = 1
JOIN lineitem m ON m.l_orderkey = r.o_orderkey AND m.l_linenumber = 1
WHERE e.n_regionkey = 2 AND e.n_nationkey % 7 <> 3 AND r.o_orderstatus <> 'P' AND m.l_suppkey % 9 <> 0 GROUP BY 1""")
def window_f1_average(spark, sf):
    found = rp.window_f1_average(*run_store(spark, sf), "study 2", "window_seconds", "macro_f1")
    return rounded(found, "average_f1")


@query("prefix_join", """
SELECT run_id, min(condition) AS condition FROM (SELECT DISTINCT md5(CAST(c_custkey AS VARCHAR)) AS run_id, c_custkey FROM customer) r
LEFT JOIN (SELECT substr(md5(CAST(c_custkey AS VARCHAR)), 1, 12) AS recorded, c_mktsegment AS condition FROM customer WHERE c_nationkey < 20) m
  ON starts_with(run_id, recorded) OR starts_with(recorded, run_id) GROUP BY run_id""")
def prefix_join(spark, sf):
    """Runs against 12-character ids recorded for customers of most nations."""
    c = v.table(spark, sf, "customer")
    key = F.md5(F.col("c_custkey").cast("string"))
    recorded = c.where("c_nationkey < 20").select(F.substring(key, 1, 12).alias("recorded_id"), F.col("c_mktsegment").alias("condition"))
    return rp.prefix_join(c.select(key.alias("run_id")), recorded)


@query("change_detection", with_views("""
SELECT session_id, participant_id, s3_key, status, CASE WHEN row_key % 9 = 2 THEN 'moved' ELSE phone_position END AS phone_position,
  CASE WHEN row_key % 50 = 4 THEN NULL ELSE sample_count END AS sample_count FROM sidecars
WHERE status = 'received' AND ((row_key % 9 = 2 AND phone_position IS DISTINCT FROM 'moved') OR (row_key % 50 = 4 AND sample_count IS NOT NULL))""", v.SIDECARS))
def change_detection(spark, sf):
    local = v.sidecars(spark, sf).where("status = 'received'")
    k = F.col("row_key")
    columns = ["session_id", "participant_id", "s3_key", "status", "phone_position", "sample_count"]
    remote = local.withColumn("phone_position", F.when(k % 9 == 2, "moved").otherwise(F.col("phone_position"))).withColumn(
        "sample_count", F.when(k % 50 != 4, F.col("sample_count")))
    return rp.change_detection(local.select(*columns), remote.select(*columns), "session_id", ["participant_id", "s3_key"])


@query("run_merge", """
SELECT 'r' || o_orderkey AS source_run_id, 'sweep' AS source_sweep, sha256('sweep|r' || o_orderkey) AS run_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN sha256('sweep|r' || (o_orderkey // 10 * 10)) END AS parent_run_id, o_orderstatus AS status
FROM orders WHERE o_orderstatus <> 'F'""")
def run_merge(spark, sf):
    """Runs in families of ten; those of finished orders were merged before and are skipped."""
    k = F.col("o_orderkey")
    source = v.table(spark, sf, "orders").select(
        F.concat(F.lit("r"), k).alias("run_id"), F.when(k % 10 != 0, F.concat(F.lit("r"), k - k % 10)).alias("parent_run_id"),
        F.col("o_orderstatus").alias("status"))
    empty = source.where("false").select("run_id", F.col("run_id").alias("source_run_id"), F.lit("sweep").alias("source_sweep"))
    merged = rp.run_merge(source, empty, "sweep").where("status = 'F'")
    return rp.run_merge(source, merged, "sweep")
