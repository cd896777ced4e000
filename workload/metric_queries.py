"""Metrics, study tables and bootstrap intervals over the prediction views."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.functions.draws import FIRST, SECOND, STEP, stream
from strideframe.operators import bootstrap as boot, metrics as met
from workload import views as v
from workload.registry import query, with_views

L = v.LABELS
V = range(3)


def rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def sums_sql(source: str, by: str = "", prefix: str = "") -> str:
    cells = ", ".join(f"count(*) FILTER (WHERE label = {i} AND prediction = {j}) AS {prefix}n_{i}_{j}" for i in V for j in V)
    return f"SELECT {by + ', ' if by else ''}{cells} FROM {source}" + (f" GROUP BY {by}" if by else "")


def sup(i, x=""):
    return "(" + " + ".join(f"{x}n_{i}_{j}" for j in V) + ")"


def prd(j, x=""):
    return "(" + " + ".join(f"{x}n_{i}_{j}" for i in V) + ")"


def ratio(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


def recall(i, x=""):
    return ratio(f"{x}n_{i}_{i}", sup(i, x))


def precision(i, x=""):
    return ratio(f"{x}n_{i}_{i}", prd(i, x))


def f1(i, x=""):
    return ratio(f"2 * {x}n_{i}_{i}", f"({sup(i, x)} + {prd(i, x)})")


def all_rows(x=""):
    return "(" + " + ".join(sup(i, x) for i in V) + ")"


def metric_sql(name, x=""):
    if name == "accuracy":
        return ratio(" + ".join(f"{x}n_{i}_{i}" for i in V), all_rows(x)).replace("CAST(", "CAST((").replace(" AS DOUBLE", ") AS DOUBLE")
    if name == "balanced_accuracy":
        return "(" + " + ".join(recall(i, x) for i in V) + ") / 3.0"
    if name == "macro_f1":
        return "(" + " + ".join(f1(i, x) for i in V) + ") / 3.0"
    return f"least({', '.join(recall(i, x) for i in V)})"


OVERALL_SQL = ", ".join(f"round({metric_sql(m)}, 6) AS {m}" for m in met.OVERALL)
SUMS = ("sums", sums_sql("predictions"))
MODES = list(L.items())


def per_class_sql(source: str, by: str = "") -> str:
    lead = by + ", " if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{name}' AS transport_mode, {sup(i)} AS support, round({precision(i)}, 6) AS precision, "
        f"round({recall(i)}, 6) AS recall, round({f1(i)}, 6) AS f1, "
        f"round(({all_rows()} - ({sup(i)} + {prd(i)} - 2 * n_{i}_{i})) / CAST(nullif({all_rows()}, 0) AS DOUBLE), 6) AS accuracy "
        f"FROM {source}" for name, i in MODES)


@query("confusion_matrix", with_views(" UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS label, CAST({j} AS BIGINT) AS prediction, n_{i}_{j} AS n FROM sums" for i in V for j in V),
    v.PREDICTIONS, SUMS))
def confusion_matrix(spark, sf):
    return met.confusion_matrix(met.confusion_sums(v.predictions(spark, sf), L), L).drop("share")


@query("confusion_normalized", with_views("""
SELECT participant_id, label, prediction, count(*) FILTER (WHERE row_key IS NOT NULL) AS n,
  round(coalesce(count(row_key) / nullif(sum(count(row_key)) OVER (PARTITION BY participant_id, label), 0), 0), 6) AS share
FROM (SELECT DISTINCT participant_id FROM predictions) u
CROSS JOIN (SELECT CAST(range AS BIGINT) AS label FROM range(3)) a CROSS JOIN (SELECT CAST(range AS BIGINT) AS prediction FROM range(3)) b
LEFT JOIN predictions USING (participant_id, label, prediction) GROUP BY participant_id, label, prediction""", v.PREDICTIONS))
def confusion_normalized(spark, sf):
    sums = met.confusion_sums(v.predictions(spark, sf), L, ["participant_id"])
    return rounded(met.confusion_matrix(sums, L, ["participant_id"]), "share")


@query("per_class_metrics", with_views(f"SELECT * EXCLUDE (accuracy) FROM ({per_class_sql('sums')})", v.PREDICTIONS, SUMS))
def per_class_metrics(spark, sf):
    table = met.per_class_metrics(met.confusion_sums(v.predictions(spark, sf), L), L).drop("accuracy")
    return rounded(table, "precision", "recall", "f1")


@query("one_vs_rest_accuracy", with_views(f"SELECT participant_id, transport_mode, support, accuracy FROM ({per_class_sql('by_person', 'participant_id')})",
    v.PREDICTIONS, ("by_person", sums_sql("predictions", "participant_id"))))
def one_vs_rest_accuracy(spark, sf):
    sums = met.confusion_sums(v.predictions(spark, sf), L, ["participant_id"])
    table = met.per_class_metrics(sums, L, ["participant_id"])
    return rounded(table.select("participant_id", "transport_mode", "support", "accuracy"), "accuracy")


@query("overall_metrics", with_views(f"""
SELECT {all_rows()} AS rows, {OVERALL_SQL}, sessions, participants, groups FROM sums,
  (SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT participant_id) AS participants, count(DISTINCT group_id) AS groups
   FROM predictions)""", v.PREDICTIONS, SUMS))
def overall_metrics(spark, sf):
    p = v.predictions(spark, sf)
    found = rounded(met.overall_metrics(met.confusion_sums(p, L), L), *met.OVERALL)
    people = met.population(p, groups=True)
    return found.withColumn("_p", people.select(F.struct(*people.columns)).scalar()).select("*", "_p.*").drop("_p")


@query("classification_report", with_views("".join((
    " UNION ALL ".join(f"SELECT '{name}' AS entry, round({precision(i)}, 6) AS precision, round({recall(i)}, 6) AS recall, "
                       f"round({f1(i)}, 6) AS f1, {sup(i)} AS support FROM sums" for name, i in MODES),
    " UNION ALL SELECT 'macro avg', ", ", ".join(f"round(({' + '.join(kind(i) for i in V)}) / 3.0, 6)" for kind in (precision, recall, f1)),
    f", {all_rows()} FROM sums UNION ALL SELECT 'weighted avg', ",
    ", ".join(f"round(({' + '.join(kind(i) + ' * ' + sup(i) for i in V)}) / {all_rows()}, 6)" for kind in (precision, recall, f1)),
    f", {all_rows()} FROM sums")), v.PREDICTIONS, SUMS))
def classification_report(spark, sf):
    return rounded(met.classification_report(met.confusion_sums(v.predictions(spark, sf), L), L), "precision", "recall", "f1")


@query("metrics_by_group", with_views(" UNION ALL ".join(
    f"SELECT '{kind}' AS group_kind, {value} AS group_value, {all_rows()} AS rows, {OVERALL_SQL} FROM ({sums_sql('predictions', by)})"
    for kind, value, by in (("all", "''", ""), ("phone_position", "phone_position", "phone_position"),
                            ("participant_id", "participant_id", "participant_id"))), v.PREDICTIONS))
def metrics_by_group(spark, sf):
    return rounded(met.metrics_by_group(v.predictions(spark, sf), L, ["phone_position", "participant_id"]), *met.OVERALL)


@query("session_vote", with_views("""
SELECT session_id, participant_id, label, windows, round(p0, 8) AS probability_0, round(p1, 8) AS probability_1, round(p2, 8) AS probability_2,
  CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS BIGINT) AS prediction
FROM (SELECT session_id, min(participant_id) AS participant_id, min(label) AS label, count(*) AS windows, avg(probability_0) AS p0,
  avg(probability_1) AS p1, avg(probability_2) AS p2 FROM predictions GROUP BY session_id)""", v.PREDICTIONS))
def session_vote(spark, sf):
    found = met.session_vote(v.predictions(spark, sf), [0, 1, 2], ["participant_id"])
    names = [f"probability_{i}" for i in V]
    return found.select(*[F.round(c, 8).alias(c) if c in names else F.col(c) for c in found.columns])


RUN = ["condition", "fraction", "seed"]


@query("mode_metric_table", with_views(
    f"SELECT condition, fraction, seed, participant_id, transport_mode, support, precision, recall, f1, accuracy, "
    f"CASE transport_mode WHEN 'bus' THEN 0 WHEN 'car' THEN 1 ELSE 2 END AS mode_position FROM ("
    f"{per_class_sql('fold_sums', 'condition, fraction, seed, participant_id')} UNION ALL "
    f"SELECT condition, fraction, seed, '' AS participant_id, * EXCLUDE (condition, fraction, seed) FROM ({per_class_sql('run_sums', 'condition, fraction, seed')}))",
    v.PREDICTIONS, v.STUDY, ("fold_sums", sums_sql("study_predictions", "condition, fraction, seed, participant_id")),
    ("run_sums", sums_sql("study_predictions", "condition, fraction, seed"))))
def mode_metric_table(spark, sf):
    p = v.study_predictions(spark, sf)
    folds = met.mode_metric_table(p, L, RUN, "participant_id")
    runs = met.mode_metric_table(p, L, RUN).withColumn("participant_id", F.lit(""))
    return rounded(folds.unionByName(runs), "precision", "recall", "f1", "accuracy")


RUNS_SQL = ("runs", "SELECT condition, fraction, seed, " + ", ".join(f"{metric_sql(m)} AS {m}" for m in met.STUDY_METRICS)
            + f" FROM ({sums_sql('study_predictions', 'condition, fraction, seed')})")
LONG_SQL = ("long_runs", " UNION ALL ".join(f"SELECT condition, fraction, seed, '{m}' AS metric, {m} AS value FROM runs" for m in met.STUDY_METRICS))
CURVE_SQL = ("curve", "SELECT condition, fraction, metric, avg(value) AS estimate, count(*) AS seeds FROM long_runs GROUP BY ALL")
STUDY_VIEWS = (v.PREDICTIONS, v.STUDY, RUNS_SQL, LONG_SQL, CURVE_SQL)


def runs(spark, sf):
    return met.run_metrics(v.study_predictions(spark, sf), L, RUN)


@query("transfer_curve", with_views("SELECT condition, fraction, metric, round(estimate, 6) AS estimate, seeds FROM curve", *STUDY_VIEWS))
def transfer_curve(spark, sf):
    return rounded(met.transfer_curve(runs(spark, sf)), "estimate")


@query("controlled_comparison", with_views("""
SELECT condition, round(max(estimate) FILTER (WHERE metric = 'macro_f1'), 6) AS macro_f1,
  round(max(estimate) FILTER (WHERE metric = 'balanced_accuracy'), 6) AS balanced_accuracy
FROM curve WHERE fraction = CASE WHEN condition = 'source_only' THEN 0 ELSE 1 END GROUP BY condition""", *STUDY_VIEWS))
def controlled_comparison(spark, sf):
    table = met.controlled_comparison(met.transfer_curve(runs(spark, sf)), v.GRID.baseline, v.GRID.conditions)
    return rounded(table, "macro_f1", "balanced_accuracy")


@query("class_curve", with_views(
    f"SELECT condition, fraction, transport_mode, round(avg(f1), 6) AS mean_f1, count(*) AS seeds FROM ("
    + " UNION ALL ".join(f"SELECT condition, fraction, '{n}' AS transport_mode, {f1(i)} AS f1 FROM run_sums" for n, i in MODES)
    + ") WHERE fraction > 0 GROUP BY ALL", v.PREDICTIONS, v.STUDY, ("run_sums", sums_sql("study_predictions", "condition, fraction, seed"))))
def class_curve(spark, sf):
    return rounded(met.class_curve(v.study_predictions(spark, sf), L), "mean_f1")


@query("paired_deltas", with_views("""
SELECT t.fraction, 'pooled_minus_' || o.condition AS comparison, t.metric, round(avg(t.value - o.value), 6) AS estimate, count(*) AS seeds
FROM long_runs t JOIN long_runs o ON o.seed = t.seed AND o.metric = t.metric
  AND (o.condition = 'source_only' OR (o.condition = 'local_only' AND o.fraction = t.fraction))
WHERE t.condition = 'pooled' GROUP BY ALL""", *STUDY_VIEWS))
def paired_deltas(spark, sf):
    return rounded(met.paired_deltas(runs(spark, sf), "pooled", "source_only", "local_only"), "estimate")


@query("paired_alignment", with_views("""
SELECT coalesce(l.participant_id, r.participant_id) AS participant_id, coalesce(l.session_id, r.session_id) AS session_id,
  coalesce(l.window_start_ms, r.window_start_ms) AS window_start_ms, coalesce(l.window_end_ms, r.window_end_ms) AS window_end_ms,
  coalesce(l.label, r.label) AS label, coalesce(l.n, 0) AS left_rows, coalesce(r.n, 0) AS right_rows
FROM (SELECT participant_id, session_id, window_start_ms, window_end_ms, label, count(*) AS n FROM predictions GROUP BY ALL) l
FULL JOIN (SELECT participant_id, session_id, window_start_ms, window_end_ms, label, count(*) AS n FROM predictions WHERE prediction = label GROUP BY ALL) r
ON l.participant_id = r.participant_id AND l.session_id = r.session_id AND l.window_start_ms = r.window_start_ms AND l.label = r.label
WHERE coalesce(l.n, 0) <> coalesce(r.n, 0)""", v.PREDICTIONS))
def paired_alignment(spark, sf):
    """The full predictions against only the right ones: every wrong row must be reported."""
    from strideframe.schema import IDENTITY
    p = v.predictions(spark, sf)
    return met.paired_alignment(p, p.where("prediction = label"), IDENTITY)


@query("prediction_parity", with_views("""
SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unmatched_rows, count(*) FILTER (WHERE row_key % 1000 = 7) AS label_mismatches,
  round(CAST(max(CASE WHEN row_key % 10 = 0 THEN 0.000004 ELSE 0 END) AS DOUBLE), 6) AS max_probability_gap, false AS parity FROM predictions""", v.PREDICTIONS))
def prediction_parity(spark, sf):
    """Predictions against a copy with slightly moved probabilities and some changed labels."""
    p = v.predictions(spark, sf)
    moved = p.withColumn("probability_1", F.col("probability_1") + F.when(F.col("row_key") % 10 == 0, 0.000004).otherwise(0.0))
    moved = moved.withColumn("prediction", F.when(F.col("row_key") % 1000 == 7, F.lit(9)).otherwise(F.col("prediction")))
    return rounded(met.prediction_parity(p, moved, ["row_key"], 3, 1e-5), "max_probability_gap")


ITERATIONS = 200


def child(source: str, state: str, part: str, name: str) -> str:
    """SQL of the child state `part` of a draw's state, as the library's mixing function gives it."""
    cut = f"& {2**64 - 1}::UHUGEINT"
    step = f"SELECT *, ({state} + ({part} + 1)::UHUGEINT * {STEP}::UHUGEINT) {cut} AS x1 FROM {source}"
    first = f"SELECT *, (xor(x1, x1 >> 30) * {FIRST}::UHUGEINT) {cut} AS x2 FROM ({step})"
    second = f"SELECT *, (xor(x2, x2 >> 27) * {SECOND}::UHUGEINT) {cut} AS x3 FROM ({first})"
    return f"(SELECT * EXCLUDE (x1, x2, x3), xor(x3, x3 >> 31) AS {name} FROM ({second}))"


def root(salt: str) -> str:
    return f"{stream(salt)}::UHUGEINT"


def place(state: str, size: str) -> str:
    return f"CAST({state} % {size}::UHUGEINT AS BIGINT)"


def cluster_draws() -> str:
    out = f"(SELECT i, s, size FROM generate_series(0, {ITERATIONS - 1}) AS a(i), (SELECT unit AS s, size FROM units))"
    for state, part, name in ((root("cluster"), "i", "s1"), ("s1", "0", "s2"), ("s2", "0", "s3"), ("s3", "s", "s4")):
        out = child(out, state, part, name)
    return f"SELECT i AS iteration, {place('s4', 'size')} AS unit FROM {out}"


CLUSTER_VIEWS = (
    v.PREDICTIONS,
    ("units", "SELECT *, row_number() OVER (ORDER BY md5(participant_id)) - 1 AS unit, count(*) OVER () AS size FROM ("
              + sums_sql("predictions", "participant_id") + ")"),
    ("draws", cluster_draws()),
    ("samples", "SELECT iteration, " + ", ".join(f"sum(n_{i}_{j}) AS n_{i}_{j}" for i in V for j in V) + " FROM draws JOIN units USING (unit) GROUP BY iteration"),
)


@query("cluster_bootstrap", with_views(" UNION ALL ".join(
    f"SELECT '{n}' AS metric, round(quantile_cont({e}, 0.025), 6) AS lower, round(quantile_cont({e}, 0.975), 6) AS upper, count({e}) AS samples FROM samples"
    for n, e in [(m, metric_sql(m)) for m in ("macro_f1", "balanced_accuracy", "minimum_class_recall")]
    + [(f"{name}.recall", f"CASE WHEN {sup(i)} > 0 THEN {recall(i)} END") for name, i in MODES]), *CLUSTER_VIEWS))
def cluster_bootstrap(spark, sf):
    samples = boot.cluster_samples(v.predictions(spark, sf), L, ITERATIONS, "cluster")
    return rounded(boot.cluster_intervals(samples, L), "lower", "upper")


def hierarchy(salt: str, by: str, iterations: int, names: list[str], cells: str):
    """SQL of the seed -> participant -> session bootstrap within each group `by`."""
    seeds = f"(SELECT {by}, n_seeds, i, s AS ss FROM seeds, generate_series(0, {iterations - 1}) AS a(i))"
    people = f"(SELECT d.{by}, i, ss, s2, x.seed, x.n_people, k AS ps FROM draw_seeds d JOIN seeds x ON x.s = d.s_pick AND x.{by} = d.{by}, LATERAL (SELECT unnest(range(x.n_people)) AS k))"
    sessions = (f"(SELECT d.{by}, i, x.seed, x.participant_id, x.n_sessions, s3, k FROM draw_people d JOIN people x ON x.seed = d.seed AND x.p = d.p_pick AND x.{by} = d.{by}, "
                "LATERAL (SELECT unnest(range(x.n_sessions)) AS k))")
    return (
        ("cells", cells),
        ("session_units", f"SELECT *, row_number() OVER (PARTITION BY {by}, seed, participant_id ORDER BY md5(session_id)) - 1 AS q FROM cells"),
        ("people", f"SELECT *, row_number() OVER (PARTITION BY {by}, seed ORDER BY md5(participant_id)) - 1 AS p FROM "
                   f"(SELECT {by}, seed, participant_id, count(*) AS n_sessions FROM cells GROUP BY ALL)"),
        ("seeds", f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(CAST(seed AS VARCHAR))) - 1 AS s, count(*) OVER (PARTITION BY {by}) AS n_seeds FROM "
                  f"(SELECT {by}, seed, count(*) AS n_people FROM people GROUP BY ALL)"),
        ("draw_seeds", f"SELECT *, {place('s2', 'n_seeds')} AS s_pick FROM {child(child(seeds, root(salt), 'i', 's1'), 's1', 'ss', 's2')}"),
        ("draw_people", f"SELECT *, {place('s3', 'n_people')} AS p_pick FROM {child(people, 's2', 'ps', 's3')}"),
        ("draw_sessions", f"SELECT {by}, i, seed, participant_id, {place('s4', 'n_sessions')} AS q FROM {child(sessions, 's3', 'k', 's4')}"),
        ("samples", f"SELECT d.{by}, i, " + ", ".join(f"sum({n}) AS {n}" for n in names)
         + f" FROM draw_sessions d JOIN session_units u ON u.seed = d.seed AND u.participant_id = d.participant_id AND u.q = d.q AND u.{by} = d.{by} GROUP BY ALL"),
    )


CELL_NAMES = [f"n_{i}_{j}" for i in V for j in V]


@query("hierarchical_bootstrap", with_views(" UNION ALL ".join(
    f"SELECT g.condition, g.fraction, '{m}' AS metric, round(quantile_cont({metric_sql(m)}, 0.025), 6) AS lower, round(quantile_cont({metric_sql(m)}, 0.975), 6) AS upper, "
    f"count(*) AS samples FROM samples JOIN run_groups AS g USING (g) GROUP BY g.condition, g.fraction" for m in met.STUDY_METRICS),
    v.PREDICTIONS, v.STUDY, ("run_groups", "SELECT DISTINCT condition, fraction, condition || '|' || fraction AS g FROM study_predictions"),
    *hierarchy("curve", "g", ITERATIONS, CELL_NAMES,
    sums_sql("(SELECT *, condition || '|' || fraction AS g FROM study_predictions)", "g, seed, participant_id, session_id"))))
def hierarchical_bootstrap(spark, sf):
    """Every condition and fraction of the study."""
    return rounded(boot.hierarchical_intervals(v.study_predictions(spark, sf), L, ["condition", "fraction"], ITERATIONS, "curve"), "lower", "upper")


PAIR_NAMES = [f"{x}{n}" for x in ("a_", "b_") for n in CELL_NAMES]


@query("paired_bootstrap", with_views(" UNION ALL ".join(
    f"SELECT fraction, '{m}' AS metric, round(quantile_cont({metric_sql(m, 'a_')} - ({metric_sql(m, 'b_')}), 0.025), 6) AS lower, "
    f"round(quantile_cont({metric_sql(m, 'a_')} - ({metric_sql(m, 'b_')}), 0.975), 6) AS upper, count(*) AS samples FROM samples GROUP BY fraction" for m in met.STUDY_METRICS),
    v.PREDICTIONS, v.STUDY,
    ("arm_a", sums_sql("study_predictions WHERE condition = 'pooled'", "fraction, seed, participant_id, session_id", "a_")),
    ("arm_b", sums_sql("study_predictions WHERE condition = 'source_only'", "seed, participant_id, session_id", "b_")),
    *hierarchy("paired", "fraction", ITERATIONS, PAIR_NAMES, "SELECT * FROM arm_a JOIN arm_b USING (seed, participant_id, session_id)")))
def paired_bootstrap(spark, sf):
    """Pooled against source-only training at every fraction, on the same draws."""
    study = v.study_predictions(spark, sf)
    treated = study.where("condition = 'pooled'")
    base = study.where("condition = 'source_only'").withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in v.GRID.fractions])))
    return rounded(boot.paired_intervals(treated, base, L, ["fraction"], ITERATIONS, "paired"), "lower", "upper")
