"""Participant-safe splits, nested calibration subsets, the study grid and leakage checks.

Shuffles are md5 orders over the group or session dimension, never over window rows; rows receive
their role by a join. Ranks run per md5 block, so one class holding most groups is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.config import StudyGrid, calibration_fractions
from strideframe.functions.digests import digest_text, id_numbers, numbers_digest, set_digest
from strideframe.functions.draws import hash_block, order_key
from strideframe.functions.scalars import lookup
from strideframe.operators.ordered import range_blocks, ranked
from strideframe.session import cut_lineage

MOST_FOLDS = 1000


def label_consistency(rows: DataFrame, labels: Mapping[str, int], group: str = "group_id") -> DataFrame:
    """Groups with more than one label, or with a label nobody configured."""
    found = rows.groupBy(group).agg(F.min("label").alias("lowest_label"), F.max("label").alias("highest_label"))
    mixed = F.col("lowest_label") != F.col("highest_label")
    unknown = ~F.col("lowest_label").isin(*labels.values())
    return found.withColumn("problem", F.when(mixed, "mixed labels").when(unknown, "unknown label")).where(
        "problem IS NOT NULL")


def group_labels(rows: DataFrame, labels: Mapping[str, int], group: str = "group_id") -> DataFrame:
    """One row per group with its single configured label; anything else raises."""
    found = rows.groupBy(group).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    good = (F.col("_lo") == F.col("_hi")) & F.col("_lo").isin(*labels.values())
    label = F.when(good, F.col("_lo")).otherwise(
        F.raise_error(F.concat(F.lit("group without exactly one configured label: "), F.col(group))))
    return found.select(group, label.cast("bigint").alias("label"))


def sparse_modes(rows: DataFrame, labels: Mapping[str, int], unit: str = "participant_id",
                 minimum: int = 2) -> DataFrame:
    """Distinct units per configured class (absent classes included) and whether they suffice."""
    counts = rows.select("label", unit).distinct().groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    columns = counts.agg(*[F.coalesce(F.max(F.when(F.col("label") == i, F.col("_n"))), F.lit(0)).alias(f"_{i}")
                           for i in labels.values()])
    return columns.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("transport_mode"), F.col(f"_{i}").alias("units"),
                 (F.col(f"_{i}") < minimum).alias("sparse")) for name, i in labels.items()])))


def shuffled_rank(df: DataFrame, keys: Sequence[str], *parts: Column | str | int, name: str = "rank") -> DataFrame:
    """Position of each row in the md5 order of `parts` within `keys`."""
    keyed = df.withColumn("_key", order_key(*parts)).withColumn("_block", hash_block(F.col("_key")))
    return ranked(keyed, list(keys), "_block", ["_key"], name).drop("_key", "_block")


def group_holdout_split(rows: DataFrame, labels: Mapping[str, int], fraction: float | Mapping[str, float],
                        seed: int, group: str = "group_id") -> DataFrame:
    """Role of every group: `calibration` or `holdout`, drawn per class; groups are never split.

    A class keeps clamp(floor(n * fraction), 1, n - 1) calibration groups and needs two groups.
    """
    shares = calibration_fractions(fraction, labels)
    groups = group_labels(rows, labels, group)
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    order = shuffled_rank(groups, ["label"], seed, F.col("label"), F.col(group)).join(F.broadcast(sizes), "label")
    share = lookup(F.col("label"), shares)
    take = F.greatest(F.lit(1).cast("bigint"), F.least(F.col("_n") - 1, F.floor(F.col("_n") * share)))
    role = F.when(F.col("_n") < 2, F.raise_error(F.concat(F.lit("fewer than two groups for label "), "label"))) \
        .when(F.col("rank") <= take, "calibration").otherwise("holdout")
    return order.select(group, "label", role.alias("role"))


def group_kfold(rows: DataFrame, group: str, seed: int, folds: int = 5) -> DataFrame:
    """Fold number per group; whole groups, as many folds as groups allow (at least two)."""
    groups = rows.select(group).distinct()
    n = groups.agg(F.count(F.lit(1))).scalar()
    k = F.when(n >= 2, F.least(F.lit(folds).cast("bigint"), n)).otherwise(
        F.raise_error(F.lit("grouped folds need at least two groups")))
    return shuffled_rank(groups, [], seed, F.col(group)).select(group, F.pmod(F.col("rank") - 1, k).alias("fold"))


def stratified_group_kfold(rows: DataFrame, group: str, seed: int, folds: int) -> DataFrame:
    """Fold per group with even class shares: groups are dealt in snake order.

    Dealing runs by dominant class, then by falling size, ties in md5 order.
    """
    counts = rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy(group).agg(
        F.sum("_n").alias("rows"), F.max_by("label", F.struct("_n", -F.col("label"))).alias("label"))
    if folds < 2:
        raise ValueError("stratified folds need at least two folds")
    keyed = groups.withColumn("_key", order_key(seed, F.col(group))).withColumn("_less", -F.col("rows"))
    dealt = ranked(range_blocks(keyed, [], ["label", "_less", "_key"]), [], "_block", ["label", "_less", "_key"], "rank")
    i = F.col("rank") - 1
    place = F.pmod(i, F.lit(folds))
    even = F.pmod(F.floor(i / folds), F.lit(2)) == 0
    return dealt.select(group, "label", "rows", F.when(even, place).otherwise(folds - 1 - place).alias("fold"))


def session_rollup(rows: DataFrame) -> DataFrame:
    """First participant and mode, window count and bounds per session."""
    first = F.struct("window_start_ms", "window_end_ms")
    return rows.groupBy("session_id").agg(
        F.min_by("participant_id", first).alias("participant_id"), F.min_by("vehicle_type", first).alias("vehicle_type"),
        F.count(F.lit(1)).alias("window_rows"), F.min("window_start_ms").alias("window_start_ms"),
        F.max("window_end_ms").alias("window_end_ms"))


def lopo_folds(sessions: DataFrame) -> DataFrame:
    """One fold per participant: sizes and digests of its test sessions and of the training pool.

    Set digests are sums, so the pool's digest is the total minus the participant's part and no
    (participant x session) table is built.
    """
    ids = sessions.select("participant_id", "session_id").distinct()
    parts = ids.groupBy("participant_id").agg(set_digest(F.col("session_id")).alias("_t"))
    whole = parts.agg(F.sum("_t.n").alias("_n"), F.sum("_t.a").alias("_a"), F.sum("_t.b").alias("_b"))
    both = parts.withColumn("_all", whole.select(F.struct("_n", "_a", "_b")).scalar()).select("*", "_all.*")
    t = F.col("_t")
    return both.select(
        F.col("participant_id").alias("held_out_participant_id"),
        t["n"].alias("test_sessions"), (F.col("_n") - t["n"]).alias("pool_sessions"),
        digest_text(t["n"], t["a"], t["b"]).alias("test_digest"),
        digest_text(F.col("_n") - t["n"], F.col("_a") - t["a"], F.col("_b") - t["b"]).alias("pool_digest"))


def calibration_cutoffs(keyed: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """The last order key of each (fold, seed, mode, fraction): a row for each, none for each session of a fold.

    `keyed` has sessions with `seed` and the order key `_key`. The md5 order of a seed and mode serves all folds. Of a
    participant's sessions, number j at place g of that order leaves g - j others before it, so k others end at
    place k + i, where i of the participant's sessions have g - j < k.
    """
    cell = ["seed", "vehicle_type"]
    placed = cut_lineage(ranked(ranked(keyed.select(*cell, "participant_id", "_key", "_block"), cell, "_block", ["_key"], "_g"),
                                [*cell, "participant_id"], "_block", ["_key"], "_j"))
    sizes = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    own = placed.groupBy(*cell, "participant_id").agg(F.count(F.lit(1)).alias("_own"))
    folds = placed.select(F.col("participant_id").alias("held_out_participant_id")).distinct()
    # seeds and modes are settings, so their cells are few and fit one value
    cells = sizes.agg(F.collect_list(F.struct(*cell, "_n"))).scalar()
    wanted = folds.select("held_out_participant_id", F.inline(cells)).join(own.withColumnRenamed("participant_id", "held_out_participant_id"),
                                    [*cell, "held_out_participant_id"], "left")
    n = F.col("_n") - F.coalesce("_own", F.lit(0))
    takes = F.array(*[F.struct(F.lit(float(f)).alias("fraction"),
                               (n if f == 1 else F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(float(f))))).alias("_k")) for f in fractions])
    levels = wanted.where(n > 0).select(*cell, "held_out_participant_id", F.inline(takes))
    skipped = levels.join(placed.select(*cell, F.col("participant_id").alias("held_out_participant_id"), (F.col("_g") - F.col("_j")).alias("_others")),
                          [*cell, "held_out_participant_id"], "left")
    ends = skipped.groupBy(*cell, "held_out_participant_id", "fraction", "_k").agg(F.count_if(F.col("_others") < F.col("_k")).alias("_i"))
    last = placed.select(*cell, F.col("_g").alias("_end"), F.col("_key").alias("_last"))
    return ends.withColumn("_end", F.col("_k") + F.col("_i")).join(last, [*cell, "_end"]).select(
        *cell, "held_out_participant_id", "fraction", "_last")


def nested_calibration(sessions: DataFrame, fractions: Sequence[float], seeds: Sequence[int]) -> DataFrame:
    """Calibration sessions per (fold, seed, fraction), drawn per mode from the training pool.

    One md5 order per seed and mode serves every fraction and condition, so smaller subsets are
    prefixes of larger ones: all sessions at fraction 1, else max(1, floor(n * fraction)). A fold's
    subset is what comes up to its cut-off key and is not its own participant's. Cut-off keys are a row
    for each fold, fraction, seed and mode and go to every task: by seed and mode, a few tasks would do all.
    """
    if any(not 0 < f <= 1 for f in fractions):
        raise ValueError("calibration fractions must be above 0 and at most 1")
    keyed = sessions.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    keyed = keyed.withColumn("_key", order_key(F.col("seed"), F.col("vehicle_type"), F.col("session_id"))).withColumn(
        "_block", hash_block(F.col("_key")))
    chosen = keyed.join(F.broadcast(calibration_cutoffs(keyed, fractions)), ["seed", "vehicle_type"]).where(
        (F.col("_key") <= F.col("_last")) & (F.col("participant_id") != F.col("held_out_participant_id")))
    return chosen.select(*sessions.columns, "held_out_participant_id", "seed", "fraction")


def numbered_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions written once with the digest numbers of their id, for the many steps and folds that read them."""
    return cut_lineage(sessions.withColumn("_numbers", id_numbers(F.col("session_id"))))


def effective_fractions(sessions: DataFrame, selection: DataFrame) -> DataFrame:
    """What share of the pool's sessions, windows and duration each selection holds.

    A selection has a session once for each fold and fraction, so its ids are hashed before, by `numbered_sessions`,
    or else here.
    """
    span = F.sum(F.col("window_end_ms") - F.col("window_start_ms")) / 1000.0
    parts = sessions.groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("_s"), F.sum("window_rows").alias("_w"), span.alias("_d"))
    whole = parts.agg(*[F.sum(c).alias(c) for c in ("_s", "_w", "_d")])
    pool = parts.withColumn("_all", whole.select(F.struct("_s", "_w", "_d")).scalar()).select(
        F.col("participant_id").alias("held_out_participant_id"), *[(F.col(f"_all.{c}") - F.col(c)).alias(c) for c in ("_s", "_w", "_d")])
    if "_numbers" not in selection.columns:
        selection = selection.withColumn("_numbers", id_numbers(F.col("session_id")))
    chosen = selection.groupBy("held_out_participant_id", "seed", "fraction").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("window_rows").alias("windows"), span.alias("duration_seconds"),
        numbers_digest(F.col("_numbers")).alias("_x"))
    return chosen.join(pool, "held_out_participant_id").select(
        "held_out_participant_id", "seed", "fraction", "sessions", "windows", "duration_seconds",
        (F.col("sessions") / F.col("_s")).alias("session_fraction"),
        (F.col("windows") / F.col("_w")).alias("window_fraction"),
        F.coalesce(F.try_divide(F.col("duration_seconds"), F.col("_d")), F.lit(0.0)).alias("duration_fraction"),
        digest_text(F.col("_x.n"), F.col("_x.a"), F.col("_x.b")).alias("session_digest"))


def run_key(condition: Column, fraction: Column, seed: Column) -> Column:
    share = F.replace(F.format_string("%.2f", fraction), F.lit("."), F.lit("p"))
    return F.concat_ws("-", condition, F.lit("local"), share, F.lit("seed"), seed.cast("string"))


def study_grid(seeds: DataFrame, grid: StudyGrid) -> DataFrame:
    """All runs of the study: the baseline once per seed, each condition at each fraction."""
    cells = [(grid.baseline, 0.0)] + [(c, float(f)) for f in grid.fractions for c in grid.conditions]
    rows = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(f).alias("fraction")) for c, f in cells])
    grown = seeds.select("seed").distinct().select("seed", F.inline(rows))
    return grown.withColumn("run_name", run_key(F.col("condition"), F.col("fraction"), F.col("seed")))


def grid_completeness(grid: DataFrame, runs: DataFrame) -> DataFrame:
    """Missing, duplicate and unexpected runs, and the number of evaluation digests, in one row."""
    seen = runs.groupBy("run_name").agg(F.count(F.lit(1)).alias("_n"))
    joined = grid.select("run_name").withColumn("_want", F.lit(1)).join(seen, "run_name", "full_outer")
    stats = joined.agg(
        F.count("_want").alias("expected_runs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("observed_runs"),
        F.count_if(F.col("_n").isNull()).alias("missing_runs"), F.count_if(F.col("_n") > 1).alias("duplicate_runs"),
        F.count_if(F.col("_want").isNull()).alias("unexpected_runs"))
    digests = runs.agg(F.count_distinct("evaluation_digest").alias("evaluation_digests"))
    valid = (F.col("missing_runs") == 0) & (F.col("duplicate_runs") == 0) & (F.col("evaluation_digests") == 1)
    return stats.withColumn("evaluation_digests", digests.scalar()).withColumn("valid", valid)


def leakage_check(training: DataFrame, predictions: DataFrame, evaluation: DataFrame,
                  row_key: Sequence[str]) -> DataFrame:
    """Violations of a fold-wise evaluation, one row each; empty when all is well.

    `training` and `predictions` carry `held_out_participant_id`; `evaluation` holds the rows that
    must be predicted exactly once.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(row_key)]
    part = lambda df, said, wanted: df.select(
        *keys, F.col("session_id").alias("_session"), said.alias("_said"), wanted.alias("_wanted"))
    # One signed count: predictions and evaluation are read once, and summed by row and by session together.
    rows = part(predictions, one, none).unionByName(part(evaluation, none, one))
    names = [f"_k{i}" for i in range(len(row_key))]
    sums = rows.groupingSets([names, ["_session"]], *names, "_session").agg(
        F.grouping("_session").alias("_by_row"), F.sum("_said").alias("_said"), F.sum("_wanted").alias("_wanted"))
    by_row, said, wanted = F.col("_by_row") == 1, F.col("_said"), F.col("_wanted")
    kind = (F.when(by_row & (said > 1), "row predicted more than once").when(by_row & (said == 0), "row not predicted")
            .when(~by_row & (wanted == 0), "unexpected session").when(~by_row & (said == 0), "session not predicted"))
    subject = F.when(by_row, F.concat_ws("|", *names)).otherwise(F.concat_ws("|", "_session"))
    found = sums.select(kind.alias("violation"), subject.alias("subject")).where("violation is not null")
    leaked = training.where(F.col("participant_id") == F.col("held_out_participant_id")).select(
        "held_out_participant_id", "session_id").distinct()
    return found.unionByName(leaked.select(F.lit("held-out participant in training").alias("violation"),
                                           F.concat_ws("|", "held_out_participant_id", "session_id").alias("subject")))


def not_nested(selection: DataFrame) -> DataFrame:
    """Sessions of a smaller calibration fraction missing from a larger one (empty when nested)."""
    keys = ["held_out_participant_id", "seed", "session_id"]
    levels = selection.select("held_out_participant_id", "seed", "fraction").distinct()
    larger = levels.withColumnRenamed("fraction", "larger")
    grown = (selection.select(*keys, "fraction").join(larger, ["held_out_participant_id", "seed"])
             .where("larger > fraction"))
    have = selection.select(*keys, F.col("fraction").alias("larger"))
    return grown.join(have, [*keys, "larger"], "left_anti")


def condition_training_frame(condition: str, source: DataFrame, local: DataFrame, selected: DataFrame,
                             grid: StudyGrid | None = None) -> DataFrame:
    """Training rows of a condition: source only, selected local sessions only, or both."""
    grid = grid or StudyGrid()
    chosen = local.join(selected.select("session_id").distinct(), "session_id", "left_semi").select(*source.columns)
    if condition == grid.baseline:
        return source
    if condition == grid.conditions[0]:
        return chosen
    if condition == grid.conditions[1]:
        return source.unionByName(chosen)
    raise ValueError(f"unknown training condition {condition!r}")


