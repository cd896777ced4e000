"""Snapshot summaries, leaderboards and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strideframe.functions.scalars import clock_text
from strideframe.operators.ordered import range_blocks, ranked


def semi_sessions(rows: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of the listed sessions; adaptive execution broadcasts a small list and splits hot keys."""
    return rows.join(ids.select(key), key, "left_semi")


def anti_pending(rows: DataFrame, done: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows of sessions not recorded yet."""
    return rows.join(done.select(key), key, "left_anti")


def mode_summary(sessions: DataFrame) -> DataFrame:
    """Sessions, distinct participants, duration and samples per mode, plus a total row.

    The snapshot is first reduced to (mode, participant), where every measure but the participant
    count is additive.
    """
    cells = sessions.groupBy("mode", "participant").agg(
        F.count(F.lit(1)).alias("_s"), F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("_d"),
        F.sum(F.coalesce("sample_count", F.lit(0).cast("bigint"))).alias("_c"))
    table = cells.rollup("mode").agg(
        F.grouping("mode").alias("_total"), F.sum("_s").alias("sessions"), F.count_distinct("participant").alias("participants"),
        F.sum("_d").alias("duration_seconds"), F.sum("_c").alias("samples"))
    return table.select(
        F.when(F.col("_total") == 1, "Total").otherwise(F.col("mode")).alias("mode"), "sessions", "participants",
        "duration_seconds", clock_text(F.col("duration_seconds")).alias("duration"), "samples")


def participant_mode_crosstab(sessions: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Duration per participant (rows) and mode (columns) with totals both ways."""
    seconds = F.coalesce("duration_seconds", F.lit(0.0))
    cells = sessions.groupBy("participant", "mode").agg(F.sum(seconds).alias("_d"))
    sums = [F.coalesce(F.sum(F.when(F.col("mode") == m, F.col("_d"))), F.lit(0.0)).alias(m) for m in modes]
    table = cells.rollup("participant").agg(F.grouping("participant").alias("_total"), *sums, F.sum("_d").alias("total"))
    return table.select(F.when(F.col("_total") == 1, "Total").otherwise(F.col("participant")).alias("participant"),
                        *[F.col(m) for m in modes], "total")


def dedupe_conflicts(runs: DataFrame, key: str, values: Sequence[str], path: str) -> DataFrame:
    """One row per run (lowest path); copies with other values raise.

    Equality is min = max over the row struct, which combines map-side.
    """
    row = F.struct(*values)
    kept = runs.groupBy(key).agg(F.min(row).alias("_lo"), F.max(row).alias("_hi"), F.min(path).alias(path))
    same = F.when(F.col("_lo") == F.col("_hi"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("conflicting values for run "), F.col(key).cast("string"))))
    return kept.select(same.alias(key), *[F.col(f"_lo.{v}").alias(v) for v in values], path)


def rank_by_class_recall(classes: DataFrame, mode: str, limit: int) -> DataFrame:
    """Best trials for one class: recall falling, then name, hash and path."""
    return classes.where(F.col("transport_mode") == mode).orderBy(
        F.desc("recall"), "trial_name", "trial_hash", "path").limit(limit)


def top_runs_by_metric(runs: DataFrame, metrics: Sequence[str], limit: int) -> DataFrame:
    """Top runs for each metric; one bounded heap per metric instead of a ranking of all runs."""
    tables = [runs.orderBy(F.desc(m), "run_id").limit(limit).select(F.lit(m).alias("metric"), "run_id", F.col(m).alias("value"))
              for m in metrics]
    result = tables[0]
    for t in tables[1:]:
        result = result.unionByName(t)
    return result


def best_trial(trials: DataFrame, value: str) -> DataFrame:
    """The single winner: highest value, ties by name, hash and path."""
    order = F.struct((-F.col(value)).alias("v"), "trial_name", "trial_hash", "path")
    return trials.agg(F.min_by(F.struct(*trials.columns), order).alias("_t")).select("_t.*")


def trial_recall_table(classes: DataFrame, modes: Sequence[str]) -> DataFrame:
    """One row per trial with a recall column per class; trials without an index come last."""
    keys = ["trial_index", "trial_name", "trial_hash", "path"]
    wide = classes.groupBy(*keys).agg(*[F.max(F.when(F.col("transport_mode") == m, F.col("recall"))).alias(m) for m in modes])
    return wide.orderBy(F.asc_nulls_last("trial_index"), *keys[1:])


def even_sample(rows: DataFrame, per_class: int, order: Sequence[str]) -> DataFrame:
    """Rows at evenly spaced positions of each class, first and last included.

    Positions are ranks over range partitions, so a class of any size is never sorted in one task.
    """
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    enough = F.when(F.col("_n") >= per_class, F.col("_n")).otherwise(
        F.raise_error(F.concat(F.lit("too few rows for label "), F.col("label").cast("string"))))
    steps = sizes.select("label", enough.alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))).alias("sample_index"))
    wanted = steps.select("label", "sample_index", (F.expr(
        f"sample_index * (_n - 1) div {max(per_class - 1, 1)}") + 1).alias("position"))
    blocks = range_blocks(rows, ["label"], list(order))
    placed = ranked(blocks, ["label"], "_block", list(order), "position").drop("_block")
    return placed.join(wanted, ["label", "position"])


def window_f1_average(experiments: DataFrame, runs: DataFrame, params: DataFrame, metrics: DataFrame, experiment: str,
                      parameter: str, metric: str) -> DataFrame:
    """Average metric per numeric parameter value over the active runs of an experiment."""
    live = runs.where("lifecycle_stage = 'active'").join(
        experiments.where((F.col("name") == experiment) & (F.col("lifecycle_stage") == "active")), "experiment_id", "left_semi")
    p = params.where(F.col("key") == parameter).select("run_uuid", F.col("value").alias("_p"))
    m = metrics.where((F.col("key") == metric) & (F.col("is_nan") == 0)).select("run_uuid", F.col("value").alias("_m"))
    size = F.col("_p").try_cast("double")
    sound = (size > 0) & (size < float("inf")) & F.col("_m").between(0, 1)
    checked = F.when(sound, size).otherwise(F.raise_error(F.concat(F.lit("bad parameter or metric in run "), "run_uuid")))
    return (live.select("run_uuid").join(p, "run_uuid").join(m, "run_uuid").withColumn("window_seconds", checked)
            .groupBy("window_seconds").agg(F.avg("_m").alias("average_f1"), F.count(F.lit(1)).alias("run_count")))


def prefix_join(runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Condition of each run whose id starts with a recorded id, or is a prefix of one.

    Ids are cut to the lengths that occur on the other side, which turns the prefix test into two
    equality joins: of ids that all have one length, a row moves once, and no short prefix gathers the
    ids of half the table. A recorded id is one row, with its lowest and highest condition. More than
    one matching condition raises.
    """
    ids = runs.select("run_id").distinct()
    recorded = conditions.groupBy("recorded_id").agg(F.min("condition").alias("_lo"), F.max("condition").alias("_hi"))
    lengths = lambda df, c: df.agg(F.collect_set(F.length(c))).scalar()
    cut = lambda df, c, sizes: df.withColumn("_n", F.explode(sizes)).withColumn("_prefix", F.substring(F.col(c), F.lit(1), F.col("_n")))
    inside = lambda c: (F.col("_n") > 0) & (F.col("_n") < F.length(c))
    shorter = cut(ids, "run_id", lengths(conditions, "recorded_id")).where(inside("run_id") | (F.col("_n") == F.length("run_id"))).join(
        recorded.withColumnRenamed("recorded_id", "_prefix"), "_prefix").select("run_id", "_lo", "_hi")
    longer = cut(recorded, "recorded_id", lengths(runs, "run_id")).where(inside("recorded_id")).join(
        ids.withColumnRenamed("run_id", "_prefix"), "_prefix").select(F.col("_prefix").alias("run_id"), "_lo", "_hi")
    found = shorter.unionByName(longer).groupBy("run_id").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    one = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.raise_error(F.concat(F.lit("more than one condition for run "), "run_id")))
    return runs.join(found.select("run_id", one.alias("condition")), "run_id", "left")


def change_detection(local: DataFrame, remote: DataFrame, key: str, fixed: Sequence[str], status: str = "received") -> DataFrame:
    """Records whose remote copy differs; lost records or changed fixed columns raise.

    Remote records nobody holds locally are ignored.
    """
    columns = local.columns
    pairs = local.select(F.col(key), F.struct(*columns).alias("_old")).join(
        remote.select(F.col(key), F.struct(*columns).alias("_new")), key, "left")
    broken = F.col("_new").isNull() | (F.col("_new.status") != status)
    for c in fixed:
        broken = broken | ~F.col(f"_new.{c}").eqNullSafe(F.col(f"_old.{c}"))
    checked = F.when(F.coalesce(broken, F.lit(True)), F.raise_error(F.concat(
        F.lit("remote record lost or altered: "), F.col(key)))).otherwise(F.col(key))
    return pairs.where(broken | F.col("_new").isNull() | ~F.col("_old").eqNullSafe(F.col("_new"))).select(
        checked.alias(key), *[F.col(f"_new.{c}").alias(c) for c in columns if c != key])


def run_merge(source: DataFrame, merged: DataFrame, sweep: str) -> DataFrame:
    """New run rows to append to `merged`: unseen runs under ids derived from (sweep, source run).

    Ids are functions of the source id, so parents need no earlier pass and a second merge adds
    nothing. A parent absent from the sweep raises.
    """
    new_id = lambda c: F.when(c.isNotNull(), F.sha2(F.concat_ws("|", F.lit(sweep), c), 256))
    seen = merged.where(F.col("source_sweep") == sweep).select(F.col("source_run_id").alias("run_id"))
    fresh = source.join(seen, "run_id", "left_anti")
    known = source.select(F.col("run_id").alias("parent_run_id"), F.lit(True).alias("_known")).distinct()
    joined = fresh.join(known, "parent_run_id", "left")
    parent = F.when(F.col("parent_run_id").isNotNull() & F.col("_known").isNull(), F.raise_error(F.concat(
        F.lit("parent run is not in the sweep: "), "parent_run_id"))).otherwise(new_id(F.col("parent_run_id")))
    rest = [c for c in source.columns if c not in ("run_id", "parent_run_id")]
    return joined.select(new_id(F.col("run_id")).alias("run_id"), parent.alias("parent_run_id"),
                         F.col("run_id").alias("source_run_id"), F.lit(sweep).alias("source_sweep"), *rest)


def merge_history(points: DataFrame, merged_runs: DataFrame, sweep: str) -> DataFrame:
    """Metric, parameter or tag rows of newly merged runs, under their new ids."""
    ids = merged_runs.where(F.col("source_sweep") == sweep).select(
        F.col("source_run_id").alias("_source"), F.col("run_id").alias("_new"))
    return points.join(ids, F.col("run_id") == F.col("_source")).withColumn("run_id", F.col("_new")).drop("_new", "_source")
