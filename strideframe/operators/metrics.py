"""Classification metrics as expressions over additive confusion sums.

Predictions are aggregated once, map-side, into one row of sums per group. Every metric is then a
row expression, so metrics by group, by bootstrap iteration or overall cost the same single shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions.scalars import lookup
from strideframe.functions.stats import safe_ratio

OVERALL = ("accuracy", "balanced_accuracy", "macro_f1", "minimum_class_recall")
STUDY_METRICS = ("macro_f1", "balanced_accuracy")


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


class Sums:
    """Names and metric expressions of the confusion sums of one set of labels.

    `labels` keeps its order: it is the row and column order of every matrix.
    """

    def __init__(self, labels: Mapping[str, int], prefix: str = ""):
        self.labels, self.prefix = dict(labels), prefix
        self.values = list(self.labels.values())

    def name(self, kind: str, *parts: int) -> str:
        return self.prefix + "_".join([kind, *map(str, parts)])

    def names(self) -> list[str]:
        v = self.values
        return ([self.name("n", i, j) for i in v for j in v] + [self.name("support", i) for i in v]
                + [self.name("predicted", i) for i in v] + [self.name("rows"), self.name("right")])

    def aggregates(self, weight: Column | None = None) -> list[Column]:
        """Sums over prediction rows; a `weight` column makes them sums over pre-counted cells."""
        label, prediction = F.col("label"), F.col("prediction")
        one = F.lit(1).cast("bigint") if weight is None else weight

        def count(condition: Column, name: str) -> Column:
            return F.coalesce(F.sum(F.when(condition, one)), F.lit(0).cast("bigint")).alias(name)

        v = self.values
        return ([count((label == i) & (prediction == j), self.name("n", i, j)) for i in v for j in v]
                + [count(label == i, self.name("support", i)) for i in v]
                + [count(prediction == i, self.name("predicted", i)) for i in v]
                + [count(F.lit(True), self.name("rows")), count(label == prediction, self.name("right"))])

    def cell(self, i: int, j: int) -> Column:
        return F.col(self.name("n", i, j))

    def support(self, i: int) -> Column:
        return F.col(self.name("support", i))

    def predicted(self, i: int) -> Column:
        return F.col(self.name("predicted", i))

    def precision(self, i: int) -> Column:
        return safe_ratio(self.cell(i, i), self.predicted(i))

    def recall(self, i: int) -> Column:
        return safe_ratio(self.cell(i, i), self.support(i))

    def f1(self, i: int) -> Column:
        return safe_ratio(2 * self.cell(i, i), self.support(i) + self.predicted(i))

    def one_vs_rest_accuracy(self, i: int) -> Column:
        """(TP + TN) / N; NULL without rows."""
        n = total([self.cell(a, b) for a in self.values for b in self.values])
        wrong = (total([self.cell(i, b) for b in self.values if b != i])
                 + total([self.cell(a, i) for a in self.values if a != i]))
        return F.try_divide((n - wrong).cast("double"), n.cast("double"))

    def metric(self, name: str) -> Column:
        k, v = len(self.values), self.values
        if name == "accuracy":
            return safe_ratio(F.col(self.name("right")), F.col(self.name("rows")))
        if name == "balanced_accuracy":
            return total([self.recall(i) for i in v]) / F.lit(float(k))
        if name == "macro_f1":
            return total([self.f1(i) for i in v]) / F.lit(float(k))
        if name == "minimum_class_recall":
            return F.least(*[self.recall(i) for i in v])
        raise ValueError(f"unknown metric {name!r}")

    def complete(self) -> Column:
        """Every configured class occurs among the true labels."""
        return reduce(lambda a, b: a & b, [self.support(i) > 0 for i in self.values])


def confusion_sums(predictions: DataFrame, labels: Mapping[str, int], by: Sequence[str] = (),
                   prefix: str = "") -> DataFrame:
    return predictions.groupBy(*by).agg(*Sums(labels, prefix).aggregates())


def rollup_sums(cells: DataFrame, labels: Mapping[str, int], by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Confusion sums of coarser groups from those of finer ones."""
    return cells.groupBy(*by).agg(*[
        F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in Sums(labels, prefix).names()])


def _per_class(sums: DataFrame, labels: Mapping[str, int], by: Sequence[str], build) -> DataFrame:
    return sums.select(*by, F.inline(F.array(*[build(name, value) for name, value in labels.items()])))


def confusion_matrix(sums: DataFrame, labels: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """Dense long matrix with empty cells, plus the share within each true class (0 for empty rows)."""
    s = Sums(labels)
    cells = [F.struct(F.lit(i).cast("bigint").alias("label"), F.lit(j).cast("bigint").alias("prediction"),
                      s.cell(i, j).alias("n"),
                      safe_ratio(s.cell(i, j), total([s.cell(i, b) for b in s.values])).alias("share"))
             for i in s.values for j in s.values]
    return sums.select(*by, F.inline(F.array(*cells)))


def per_class_metrics(sums: DataFrame, labels: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    s = Sums(labels)
    return _per_class(sums, labels, by, lambda name, i: F.struct(
        F.lit(name).alias("transport_mode"), s.support(i).alias("support"), s.precision(i).alias("precision"),
        s.recall(i).alias("recall"), s.f1(i).alias("f1"), s.one_vs_rest_accuracy(i).alias("accuracy")))


def overall_metrics(sums: DataFrame, labels: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    s = Sums(labels)
    return sums.select(*by, F.col("rows"), *[s.metric(m).alias(m) for m in OVERALL])


def population(predictions: DataFrame, by: Sequence[str] = (), groups: bool = False) -> DataFrame:
    """Distinct sessions and participants; duplicates collapse map-side first."""
    ids = ["session_id", "participant_id"] + (["group_id"] if groups else [])
    cells = predictions.select(*by, *ids).distinct()
    return cells.groupBy(*by).agg(*[F.count_distinct(c).alias(c.replace("_id", "s")) for c in ids])


def classification_report(sums: DataFrame, labels: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """Class rows plus macro and weighted averages."""
    s, k = Sums(labels), float(len(labels))
    support = total([s.support(i) for i in s.values])

    def row(name: str, p: Column, r: Column, f: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("entry"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        n.alias("support"))

    kinds = (s.precision, s.recall, s.f1)
    rows = [row(name, *[kind(i) for kind in kinds], s.support(i)) for name, i in labels.items()]
    rows.append(row("macro avg", *[total([kind(i) for i in s.values]) / F.lit(k) for kind in kinds], support))
    rows.append(row("weighted avg", *[
        safe_ratio(total([kind(i) * s.support(i) for i in s.values]), support) for kind in kinds], support))
    return sums.select(*by, F.inline(F.array(*rows)))


def metrics_by_group(predictions: DataFrame, labels: Mapping[str, int], columns: Sequence[str]) -> DataFrame:
    """Metrics overall and by each column alone, from one pre-aggregation and grouping sets."""
    cells = predictions.groupBy(*columns, "label", "prediction").agg(F.count(F.lit(1)).alias("_n"))
    sets = [[], *[[F.col(c)] for c in columns]]
    flags = [F.grouping(c).alias(f"_{c}") for c in columns]
    sums = cells.groupingSets(sets, *[F.col(c) for c in columns]).agg(
        *Sums(labels).aggregates(F.col("_n")), *flags)
    kind, value = F.lit("all"), F.lit("")
    for c in columns:
        kind = F.when(F.col(f"_{c}") == 0, c).otherwise(kind)
        value = F.when(F.col(f"_{c}") == 0, F.col(c)).otherwise(value)
    named = sums.withColumn("group_kind", kind).withColumn("group_value", value)
    return overall_metrics(named, labels, ["group_kind", "group_value"])


def session_vote(predictions: DataFrame, labels: Sequence[int], metadata: Sequence[str] = ()) -> DataFrame:
    """Mean probability per session; the most likely class wins, the lowest index on ties.

    A session must carry exactly one true label.
    """
    probabilities = [f"probability_{i}" for i in range(len(labels))]
    votes = predictions.groupBy("session_id").agg(
        F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("windows"),
        *[F.avg(p).alias(p) for p in probabilities], *[F.min(m).alias(m) for m in metadata])
    ordered = F.array(*[F.col(p) for p in probabilities])
    place = F.array_position(ordered, F.array_max(ordered)).cast("int")
    one_label = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(
        F.raise_error(F.concat(F.lit("more than one true label in session "), "session_id")))
    return votes.select("session_id", *metadata, one_label.cast("bigint").alias("label"), "windows", *probabilities,
                        F.element_at(F.array(*[F.lit(v).cast("bigint") for v in labels]), place).alias("prediction"))


def mode_metric_table(predictions: DataFrame, labels: Mapping[str, int], identity: Sequence[str],
                      fold: str | None = None) -> DataFrame:
    """Per-class rows for every run, or for every run and fold; report order is (run, fold, `mode_position`)."""
    by = [*identity, *([fold] if fold else [])]
    return mode_rows(confusion_sums(predictions, labels, by), labels, by)


def mode_rows(sums: DataFrame, labels: Mapping[str, int], by: Sequence[str]) -> DataFrame:
    table = per_class_metrics(sums, labels, by)
    position = lookup(F.col("transport_mode"), {name: i for i, name in enumerate(labels)})
    return table.withColumn("mode_position", position)


def run_metrics(predictions: DataFrame, labels: Mapping[str, int], identity: Sequence[str]) -> DataFrame:
    return overall_metrics(confusion_sums(predictions, labels, identity), labels, identity)


def long_metrics(runs: DataFrame, identity: Sequence[str], metrics: Sequence[str] = OVERALL) -> DataFrame:
    return runs.select(*identity, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))


def transfer_curve(runs: DataFrame, metrics: Sequence[str] = STUDY_METRICS) -> DataFrame:
    """Mean of the per-seed metrics for each condition and calibration fraction."""
    return (long_metrics(runs, ["condition", "fraction"], metrics)
            .groupBy("condition", "fraction", "metric")
            .agg(F.avg("value").alias("estimate"), F.count(F.lit(1)).alias("seeds")))


def class_curve(predictions: DataFrame, labels: Mapping[str, int]) -> DataFrame:
    """Mean F1 per class over the seeds of a condition and fraction."""
    return class_means(confusion_sums(predictions, labels, ["condition", "fraction", "seed"]), labels)


def class_means(run_sums: DataFrame, labels: Mapping[str, int]) -> DataFrame:
    table = per_class_metrics(run_sums, labels, ["condition", "fraction", "seed"])
    return (table.where("fraction > 0").groupBy("condition", "fraction", "transport_mode")
            .agg(F.avg("f1").alias("mean_f1"), F.count(F.lit(1)).alias("seeds")))


def controlled_comparison(curve: DataFrame, baseline: str, conditions: Sequence[str]) -> DataFrame:
    """Baseline at fraction 0 beside the other conditions at full calibration."""
    fraction = F.when(F.col("condition") == baseline, F.lit(0.0)).otherwise(F.lit(1.0))
    picked = curve.where((F.col("fraction") == fraction) & F.col("condition").isin(baseline, *conditions))
    return picked.groupBy("condition").pivot("metric", ["macro_f1", "balanced_accuracy"]).agg(F.first("estimate"))


def paired_deltas(runs: DataFrame, treatment: str, baseline: str, reference: str,
                  metrics: Sequence[str] = STUDY_METRICS) -> DataFrame:
    """Mean metric differences over common seeds: treatment against the baseline (any fraction)
    and against the reference condition at the same fraction."""
    rows = long_metrics(runs, ["condition", "fraction", "seed"], metrics)
    treated = rows.where(F.col("condition") == treatment).select(
        "fraction", "seed", "metric", F.col("value").alias("treated"))
    base = rows.where(F.col("condition") == baseline).select("seed", "metric", F.col("value").alias("other"))
    same = rows.where(F.col("condition") == reference).select(
        "fraction", "seed", "metric", F.col("value").alias("other"))
    pairs = (treated.join(base, ["seed", "metric"]).withColumn("comparison", F.lit(f"{treatment}_minus_{baseline}"))
             .unionByName(treated.join(same, ["fraction", "seed", "metric"])
                          .withColumn("comparison", F.lit(f"{treatment}_minus_{reference}"))))
    return pairs.groupBy("fraction", "comparison", "metric").agg(
        F.avg(F.col("treated") - F.col("other")).alias("estimate"), F.count(F.lit(1)).alias("seeds"))


def paired_alignment(left: DataFrame, right: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identity rows whose multiplicity differs between the two sides.

    One signed map-side count instead of a join: copies of a row stay one key.
    """
    signed = left.select(*identity, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*identity, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = signed.groupBy(*identity).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))
    return counts.where("left_rows <> right_rows")


def prediction_parity(left: DataFrame, right: DataFrame, identity: Sequence[str], classes: int,
                      tolerance: float) -> DataFrame:
    """Agreement of two scored sets: labels must match and probabilities stay within tolerance."""
    names = ["prediction", *[f"probability_{i}" for i in range(classes)]]
    a = left.select(*identity, *[F.col(n).alias(f"l_{n}") for n in names])
    b = right.select(*identity, *[F.col(n).alias(f"r_{n}") for n in names])
    joined = a.join(b, list(identity), "full_outer")
    gap = F.greatest(*[F.abs(F.col(f"l_probability_{i}") - F.col(f"r_probability_{i}")) for i in range(classes)])
    missing = F.col("l_prediction").isNull() | F.col("r_prediction").isNull()
    stats = joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(missing).alias("unmatched_rows"),
        F.count_if(F.col("l_prediction") != F.col("r_prediction")).alias("label_mismatches"),
        F.max(gap).alias("max_probability_gap"))
    good = ((F.col("unmatched_rows") == 0) & (F.col("label_mismatches") == 0)
            & (F.coalesce(F.col("max_probability_gap"), F.lit(0.0)) <= tolerance))
    return stats.withColumn("parity", good)


def stored_matrix_differences(predictions: DataFrame, stored: DataFrame, labels: Mapping[str, int]) -> DataFrame:
    """Cells (label, prediction, n) of a stored matrix that the predictions do not reproduce."""
    actual = confusion_matrix(confusion_sums(predictions, labels), labels).select("label", "prediction", "n")
    keys = ["label", "prediction", "n"]
    return (actual.join(stored, keys, "left_anti").withColumn("side", F.lit("computed"))
            .unionByName(stored.select(*keys).join(actual, keys, "left_anti").withColumn("side", F.lit("stored"))))
