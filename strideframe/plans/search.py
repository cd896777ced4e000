"""Parameter search on pooled out-of-fold predictions, and nested participant evaluation."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from strideframe.operators.metrics import Sums, confusion_sums
from strideframe.operators import boosting
from strideframe.operators.models import Classifier, boosted_settings, fit_classifier, predict_frame
from strideframe.operators.splits import stratified_group_kfold
from strideframe.operators.weights import balanced_rows, training_weights
from strideframe.plans.jobs import side_by_side
from strideframe.session import cut_lineage

# Search ranges per model family, of settings that the learners have. (whole, low, high, step), (real, low, high),
# (log, low, high) or (choice, options).
RANGES: dict[str, dict[str, tuple]] = {
    "random_forest": {
        "n_estimators": ("whole", 200, 800, 100),
        "max_depth": ("choice", (None, 8, 12, 16, 24)),
        "min_samples_leaf": ("choice", (1, 2, 4, 8)),
        "max_features": ("choice", ("sqrt", "log2", 0.5, 0.8)),
    },
    "boosted_trees": {
        "n_estimators": ("whole", 200, 1200, 100),
        "learning_rate": ("log", 0.02, 0.2),
        "max_depth": ("whole", 3, 8, 1),
        "min_child_weight": ("real", 1, 10),
        "subsample": ("real", 0.6, 1.0),
        "colsample": ("real", 0.5, 1.0),
        "gamma": ("real", 0, 5),
        "reg_alpha": ("real", 0, 2),
        "reg_lambda": ("real", 0.5, 10),
    },
    "mlp": {
        "hidden_layers": ("choice", ((64,), (128,), (64, 32), (128, 64))),
        "max_iter": ("whole", 100, 300, 50),
        "tol": ("log", 1e-4, 1e-3),
    },
}


def _share(*parts: object) -> float:
    text = "|".join(map(str, parts)).encode()
    return int(hashlib.md5(text).hexdigest()[:15], 16) / 16**15


def _draw(rule: tuple, share: float) -> object:
    kind, *limits = rule
    if kind == "choice":
        return limits[0][int(share * len(limits[0]))]
    low, high = limits[0], limits[1]
    if kind == "whole":
        return low + limits[2] * int(share * ((high - low) // limits[2] + 1))
    if kind == "log":
        return math.exp(math.log(low) + share * (math.log(high) - math.log(low)))
    return low + share * (high - low)


def candidates(families: Sequence[str], trials: int, seed: int,
               ranges: Mapping[str, Mapping[str, tuple]] = RANGES) -> list[dict]:
    """Repeatable parameter settings: a family each, then a value from every range of that family."""
    unknown = sorted(set(families) - set(ranges))
    if unknown:
        raise ValueError(f"unknown model families: {', '.join(unknown)}")
    drawn = []
    for n in range(trials):
        family = families[int(_share(seed, n, "family") * len(families))]
        drawn.append({"family": family, **{
            name: _draw(rule, _share(seed, n, family, name)) for name, rule in ranges[family].items()}})
    return drawn


@dataclass(frozen=True)
class TrainingRules:
    """How training rows are balanced and weighted, and what a search maximizes."""

    columns: tuple[str, ...]
    labels: Mapping[str, int]
    seed: int = 42
    weighting: str = "class_balanced"
    local_domain: str = "collector"
    local_weight: float = 1.0
    balancing: str = "none"
    metric: str = "macro_f1"
    workers: int = 4


def fit_rows(train: DataFrame, params: Mapping[str, object], rules: TrainingRules, fold: int = 0) -> Classifier:
    """Balance, weight and fit."""
    chosen = balanced_rows(train, rules.seed + fold, rules.local_domain, rules.balancing)
    weigh = lambda df: training_weights(df, rules.weighting, rules.local_domain, rules.local_weight)
    return fit_classifier(chosen, rules.columns, list(rules.labels.values()), params, rules.seed, weigh)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for f in frames[1:]:
        result = result.unionByName(f)
    return result


def pooled_score(predictions: DataFrame, rules: TrainingRules) -> float:
    """The selection metric over all predictions together, not a mean over folds."""
    sums = confusion_sums(predictions, rules.labels)
    return float(sums.select(Sums(rules.labels).metric(rules.metric)).first()[0])


def with_folds(rows: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """Rows with the fold of their group, written by fold so that each fit reads only its folders."""
    return cut_lineage(rows.join(folds.select(group, F.col("fold").cast("int").alias("fold")), group), ["fold"])


def grouped_search(rows: DataFrame, settings: Sequence[Mapping[str, object]], rules: TrainingRules,
                   always: DataFrame | None = None) -> DataFrame:
    """Score of each setting: fit on all folds but one (plus `always`), predict the one, pool, measure.

    `rows` carries `fold`. Boosted trees of all settings and folds, with classes weighed evenly, grow together in one
    pass (`boosted_search`). Other fits share a bounded pool of jobs; per setting one aggregate over its pooled
    predictions reaches the driver.
    """
    if {s["family"] for s in settings} == {"boosted_trees"} and (rules.weighting, rules.balancing) == ("class_balanced", "none"):
        return boosted_search(rows, settings, rules, always)
    numbers = sorted(r[0] for r in rows.select("fold").distinct().limit(1001).collect())
    if not 2 <= len(numbers) <= 1000:
        raise ValueError("a grouped search needs between two and a thousand folds")
    plain = rows.drop("fold")

    def out_of_fold(job: tuple[int, int]) -> DataFrame:
        trial, fold = job
        train = rows.where(F.col("fold") != fold).select(plain.columns)
        if always is not None:
            train = always.unionByName(train)
        model = fit_rows(train, settings[trial], rules, fold)
        return predict_frame(model, rows.where(F.col("fold") == fold), ["label"])

    jobs = [(t, f) for t in range(len(settings)) for f in numbers]
    predicted = side_by_side(out_of_fold, jobs, rules.workers)
    per_trial = [_union([p for (t, _), p in zip(jobs, predicted) if t == n]) for n in range(len(settings))]
    scores = side_by_side(lambda p: pooled_score(p, rules), per_trial, rules.workers)
    table = [(n, str(s["family"]), json.dumps(dict(s), sort_keys=True), score)
             for n, (s, score) in enumerate(zip(settings, scores))]
    return rows.sparkSession.createDataFrame(table, "trial int, family string, params string, score double")


def boosted_search(rows: DataFrame, settings: Sequence[Mapping[str, object]], rules: TrainingRules,
                   always: DataFrame | None = None) -> DataFrame:
    """The same for boosted trees: every (setting, fold) is a model of one pass, so jobs follow from rounds and depth alone.

    Missing values need no imputation: they go to the right of a split. Classes are weighed evenly by the counts of each
    model's own training rows, which reach the driver (folds x classes).
    """
    values = list(rules.labels.values())
    names = [f"_x{i}" for i in range(len(rules.columns))]
    place = F.array_position(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("label").cast("bigint")) - 1
    pick = lambda df, fold: df.select(place.cast("double").alias("_index"), F.lit(1.0).alias("_weight"), fold.cast("int").alias("_fold"),
                                      *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(rules.columns, names)])
    table = pick(rows, F.col("fold"))
    if always is not None:
        table = table.unionByName(pick(always, F.lit(None)))
    table = cut_lineage(table)
    counts = {(r["_fold"], int(r["_index"])): r["n"] for r in table.groupBy("_fold", "_index").agg(F.count("*").alias("n")).collect()}
    folds = sorted({f for f, _ in counts if f is not None})
    if len(folds) < 2:
        raise ValueError("a grouped search needs two folds or more")

    def factors(fold: int) -> tuple[float, ...]:
        own = [sum(n for (f, k), n in counts.items() if f != fold and k == c) for c in range(len(values))]
        return tuple(sum(own) / (sum(n > 0 for n in own) * n) if n else 0.0 for n in own)

    jobs = [(t, f) for t in range(len(settings)) for f in folds]
    models = [boosting.Model(boosted_settings(settings[t]), rules.seed, f, factors(f)) for t, f in jobs]
    cuts = boosting.fit_many(table, names, len(values), models)
    found = boosting.out_of_fold(table, names, len(values), models, cuts)
    value = F.array(*[F.lit(v).cast("bigint") for v in values])
    pooled = found.select(F.floor(F.col("model") / len(folds)).cast("int").alias("trial"), F.get(value, F.col("place")).alias("label"),
                          F.get(value, F.col("predicted")).alias("prediction"), "n")
    sums = pooled.groupBy("trial").agg(*Sums(rules.labels).aggregates(F.col("n")))
    facts = rows.sparkSession.createDataFrame([(n, str(s["family"]), json.dumps(dict(s), sort_keys=True)) for n, s in enumerate(settings)],
                                              "trial int, family string, params string")
    return facts.join(sums.select("trial", Sums(rules.labels).metric(rules.metric).alias("score")), "trial")


def best_setting(scored: DataFrame) -> tuple[dict, float]:
    """Highest score, the earliest trial on ties."""
    row = scored.agg(F.min_by(F.struct("params", "score"), F.struct((-F.col("score")).alias("s"), "trial")).alias("b")).first()["b"]
    return json.loads(row["params"]), float(row["score"])


@dataclass
class NestedResult:
    """Out-of-fold predictions of all local rows, the outer folds, the chosen setting and the final model."""

    predictions: DataFrame
    outer: DataFrame
    search: DataFrame
    params: dict
    model: Classifier


def nested_evaluation(source: DataFrame, local: DataFrame, settings: Sequence[Mapping[str, object]], rules: TrainingRules,
                      inner_folds: int, most_participants: int = 1000, keep: Sequence[str] | None = None) -> NestedResult:
    """Hold each participant out, search on the others, refit, predict; then search and fit on everyone.

    Source rows train every model. Tables are written once and read by folder.
    """
    source = cut_lineage(source)
    local = cut_lineage(local, ["participant_id"])
    people = sorted(r[0] for r in local.select("participant_id").distinct().limit(most_participants + 1).collect())
    if not 2 <= len(people) <= most_participants:
        raise ValueError(f"nested evaluation needs between two and {most_participants} participants")
    identity = list(keep or ("participant_id", "session_id", "vehicle_type", "label", "window_start_ms", "window_end_ms"))

    def searched(rows: DataFrame) -> tuple[DataFrame, dict, float]:
        folds = stratified_group_kfold(rows, "participant_id", rules.seed, inner_folds)
        scored = grouped_search(with_folds(rows, folds, "participant_id"), settings, rules, always=source)
        return (scored, *best_setting(scored))

    def held_out(job: tuple[int, str]) -> tuple[DataFrame, tuple]:
        number, person = job
        others = local.where(F.col("participant_id") != person)
        _, params, score = searched(others)
        model = fit_rows(source.unionByName(others), params, rules, number)
        predicted = predict_frame(model, local.where(F.col("participant_id") == person), identity)
        return predicted, (person, number, json.dumps(params, sort_keys=True), score)

    done = side_by_side(held_out, list(enumerate(people)), rules.workers)
    scored, params, _ = searched(local)
    final = fit_rows(source.unionByName(local), params, rules)
    table = local.sparkSession.createDataFrame(
        [o for _, o in done], "held_out_participant_id string, fold int, params string, inner_score double")
    return NestedResult(_union([p for p, _ in done]), table, scored, params, final)
