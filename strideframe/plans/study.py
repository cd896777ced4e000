"""The controlled study: every run of the grid over every leave-one-participant-out fold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from strideframe.config import StudyGrid
from strideframe.operators.metrics import confusion_sums, overall_metrics, per_class_metrics
from strideframe.operators.models import IDENTITY_COLUMNS, Classifier, fit_classifier, predict_frame
from strideframe.operators.splits import (
    MOST_FOLDS, condition_training_frame, leakage_check, nested_calibration, session_rollup)
from strideframe.operators.weights import class_weights
from strideframe.plans.jobs import side_by_side
from strideframe.plans.search import _union
from strideframe.session import cut_lineage
from strideframe.sinks import atomic_write, is_complete

RUN = ("condition", "fraction", "seed")


def run_name(condition: str, fraction: float, seed: int) -> str:
    return f"{condition}-local-{fraction:.2f}".replace(".", "p") + f"-seed-{seed}"


def grid_runs(grid: StudyGrid, limit: int | None = None) -> list[tuple[str, float, int]]:
    """Runs in study order: per seed the baseline, then each fraction of each condition."""
    runs = [r for s in grid.seeds for r in (
        [(grid.baseline, 0.0, s)] + [(c, float(f), s) for c in grid.conditions for f in grid.fractions])]
    return runs if limit is None else runs[:limit]


def run_study(source: DataFrame, local: DataFrame, eligible: DataFrame | None, columns: Sequence[str],
              labels: Mapping[str, int], grid: StudyGrid, params: Mapping[str, object], target: str,
              limit: int | None = None, workers: int = 4) -> DataFrame:
    """Train and predict every run; returns the stored predictions of the wanted runs.

    Each run is one all-or-nothing dataset below `target`, so a study that was stopped goes on with the
    runs it lacks. The baseline model is fitted once per seed and predicts all folds.
    """
    spark = local.sparkSession
    if eligible is not None:
        local = local.join(eligible.select("session_id").distinct(), "session_id", "left_semi")
    runs = grid_runs(grid, limit)
    missing = [r for r in runs if not is_complete(spark, f"{target}/run_name={run_name(*r)}")]
    if missing:
        _run_missing(source, local, columns, labels, grid, params, target, missing, workers)
    return read_runs(spark, target).where(F.col("run_name").isin(*[run_name(*r) for r in runs]))


def read_runs(spark: SparkSession, target: str) -> DataFrame:
    """Stored predictions with their run name and fold; filters on either skip folders."""
    found = spark.read.option("basePath", target).parquet(f"{target}/run_name=*")
    # ids that look like numbers must stay text, whatever the session infers from folder names
    folders = ("run_name", "held_out_participant_id")
    schema = StructType([StructField(f.name, StringType()) if f.name in folders else f for f in found.schema.fields])
    return spark.read.schema(schema).option("basePath", target).parquet(f"{target}/run_name=*")


def _run_missing(source: DataFrame, local: DataFrame, columns: Sequence[str], labels: Mapping[str, int], grid: StudyGrid,
                 params: Mapping[str, object], target: str, runs: Sequence[tuple[str, float, int]], workers: int) -> None:
    values = list(labels.values())
    wanted = list(dict.fromkeys(["domain", *IDENTITY_COLUMNS, *columns]))
    slim = lambda df: df.select(*[f"`{c}`" for c in wanted])
    source, local = cut_lineage(slim(source)), cut_lineage(slim(local), ["participant_id"])
    calibrated = any(f > 0 for _, f, _ in runs)
    selection = cut_lineage(nested_calibration(session_rollup(local), grid.fractions, grid.seeds),
                            ["seed", "fraction"]) if calibrated else None
    people = sorted(r[0] for r in local.select("participant_id").distinct().limit(MOST_FOLDS + 1).collect())
    if len(people) > MOST_FOLDS:
        raise ValueError(f"leave-one-out over more than {MOST_FOLDS} participants")

    def fit(train: DataFrame, seed: int) -> Classifier:
        return fit_classifier(train, columns, values, params, seed, class_weights, all_classes=True)

    def fold_predictions(condition: str, fraction: float, seed: int, person: str) -> DataFrame:
        chosen = selection.where((F.col("seed") == seed) & (F.col("fraction") == fraction)
                                 & (F.col("held_out_participant_id") == person))
        train = condition_training_frame(condition, source, local, chosen, grid)
        model = fit(train, seed)
        test = predict_frame(model, local.where(F.col("participant_id") == person))
        return test.withColumn("held_out_participant_id", F.lit(person))

    def do_run(run: tuple[str, float, int]) -> None:
        condition, fraction, seed = run
        if condition == grid.baseline:
            model = fit(source, seed)
            pooled = predict_frame(model, local).withColumn("held_out_participant_id", F.col("participant_id"))
        else:
            pooled = _union([fold_predictions(condition, fraction, seed, p) for p in people])
        stamped = pooled.withColumns({"condition": F.lit(condition), "fraction": F.lit(float(fraction)), "seed": F.lit(seed)})
        atomic_write(stamped, f"{target}/run_name={run_name(*run)}", ["held_out_participant_id"])

    side_by_side(do_run, runs, workers)


def check_study(predictions: DataFrame, local: DataFrame) -> DataFrame:
    """Violations per run: lost, repeated or foreign rows (empty when every row is predicted once)."""
    keys = ["participant_id", "session_id", "window_start_ms", "window_end_ms"]
    # A run whose rows have the count and the sum of hashes of the wanted ones holds just these; only other runs are looked into.
    facts = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys).cast("decimal(20,0)")).alias("digest")]
    wanted = local.agg(*facts).first()
    differs = (F.col("n") != wanted["n"]) | ~F.col("digest").eqNullSafe(F.lit(wanted["digest"]))
    names = [r["run_name"] for r in predictions.groupBy("run_name").agg(*facts).where(differs).select("run_name").collect()]
    per_run = local.withColumn("run_name", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")))
    tagged = lambda df: df.withColumn("session_id", F.concat_ws("|", "run_name", "session_id"))
    none = predictions.select("participant_id", "session_id", "held_out_participant_id").where("false")
    return leakage_check(none, tagged(predictions.where(F.col("run_name").isin(names))), tagged(per_run), keys)


def study_metrics(predictions: DataFrame, labels: Mapping[str, int]) -> DataFrame:
    """Headline metrics of every run and, with the fold named, of every fold."""
    runs = overall_metrics(confusion_sums(predictions, labels, RUN), labels, RUN).withColumn("held_out_participant_id", F.lit(""))
    by = [*RUN, "held_out_participant_id"]
    return runs.unionByName(overall_metrics(confusion_sums(predictions, labels, by), labels, by))


def study_class_metrics(predictions: DataFrame, labels: Mapping[str, int]) -> DataFrame:
    return per_class_metrics(confusion_sums(predictions, labels, RUN), labels, RUN)
