"""Window features: statistical, temporal and spectral."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from strideframe.config import SENSOR_AXES, SPELLINGS, FeatureConfig
from strideframe.functions.stats import excess_kurtosis, mean_axis_correlation
from strideframe.functions.scalars import magnitude
from strideframe.operators import windows as win
from strideframe.schema import METADATA

# Each entry builds an aggregate over rows with `value`, `timestamp_ms`, `_mean`, `_jerk`.
REGISTRY: dict[str, Callable[[], Column]] = {}


def register(name: str):
    """Add an aggregate feature; the builder returns an aggregate Column. Configurations know it from then on."""
    def add(builder: Callable[[], Column]) -> Callable[[], Column]:
        if name in REGISTRY:
            raise ValueError(f"feature {name!r} is already registered")
        REGISTRY[name] = builder
        SPELLINGS.add(name)
        return builder
    return add


def _first() -> Column:
    return F.min_by("value", F.when(F.col("value").isNotNull(), F.col("timestamp_ms")))


def _last() -> Column:
    return F.max_by("value", F.when(F.col("value").isNotNull(), F.col("timestamp_ms")))


register("minimum")(lambda: F.min("value"))
register("maximum")(lambda: F.max("value"))
register("range")(lambda: F.max("value") - F.min("value"))
register("mean")(lambda: F.avg("value"))
register("variance")(lambda: F.var_pop("value"))
register("standard_deviation")(lambda: F.stddev_pop("value"))
register("kurtosis")(lambda: excess_kurtosis(F.col("value")))
register("interquartile_range")(
    lambda: F.expr("percentile(value, 0.75D)") - F.expr("percentile(value, 0.25D)"))
register("delta_from_window_start")(lambda: _last() - _first())
register("mean_absolute_deviation")(lambda: F.avg(F.abs(F.col("value") - F.col("_mean"))))
register("mean_absolute_jerk")(lambda: F.coalesce(F.avg(F.abs(F.col("_jerk"))), F.lit(0.0)))
register("jerk_standard_deviation")(lambda: F.coalesce(F.stddev_pop("_jerk"), F.lit(0.0)))

SPECTRAL = ("spectral_energy", "dominant_frequency_hz", "spectral_entropy")
BASELINED = "delta_from_session_baseline"
CORRELATION = "mean_axis_correlation"


def with_mean(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_mean", F.avg("value").over(W.partitionBy(*win.GROUP)))


def with_jerk(rows: DataFrame) -> DataFrame:
    """Change per second against the previous finite sample of the same group."""
    sample = F.when(F.col("value").isNotNull(), F.struct("timestamp_ms", "value"))
    before = F.last(sample, ignorenulls=True).over(win.group_order().rowsBetween(W.unboundedPreceding, -1))
    seconds = (F.col("timestamp_ms") - F.col("_before.timestamp_ms")) / F.lit(1000.0)
    return (rows.withColumn("_before", before)
            .withColumn("_jerk", (F.col("value") - F.col("_before.value")) / seconds).drop("_before"))


def resample_linear(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Uniform grid at the median gap from first to last sample, linearly interpolated.

    Each sample contributes the grid points up to the next one, so no as-of join is needed; points
    past the last sample keep its value. Rows are the distinct timestamps of bounded windows.
    """
    whole = W.partitionBy(*keys)
    ordered = whole.orderBy("timestamp_ms")
    t, v = F.col("timestamp_ms"), F.col("value")
    step = (rows.where(v.isNotNull())
            .withColumn("_t2", F.lead(t).over(ordered)).withColumn("_v2", F.lead(v).over(ordered))
            .withColumn("_t0", F.min(t).over(whole)).withColumn("_tn", F.max(t).over(whole))
            .withColumn("_count", F.count(F.lit(1)).over(whole))
            .withColumn("step_ms", F.expr("percentile(_t2 - timestamp_ms, 0.5D)").over(whole)))
    points = F.ceil((F.col("_tn") - F.col("_t0") + F.col("step_ms") / 2) / F.col("step_ms"))
    # floor/ceil in doubles; a grid point belongs to the segment [t, next t)
    low = F.ceil((t - F.col("_t0")) / F.col("step_ms"))
    high = F.when(F.col("_t2").isNull(), F.col("_points") - 1).otherwise(
        F.least(F.col("_points"), F.ceil((F.col("_t2") - F.col("_t0")) / F.col("step_ms"))) - 1)
    grid = (step.withColumn("_points", points).where((F.col("_count") >= 4) & (F.col("_points") >= 4))
            .withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
            .withColumn("grid_index", F.explode(F.sequence("_low", "_high"))))
    at = F.col("_t0") + F.col("grid_index") * F.col("step_ms")
    slope = F.coalesce((F.col("_v2") - v) / (F.col("_t2") - t), F.lit(0.0))
    return grid.select(*keys, "grid_index", "step_ms", F.col("_points").alias("grid_points"),
                       (v + slope * (at - t)).alias("grid_value"))


def spectrum_sql(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Spectral features by an explicit Fourier sum; right for short windows (n*n/2 products)."""
    whole = W.partitionBy(*keys)
    n = F.col("grid_points")
    centred = grid.withColumn("_y", F.col("grid_value") - F.avg("grid_value").over(whole))
    bins = centred.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor(n / 2))))
    angle = F.lit(2 * np.pi) * F.pmod(F.col("k") * F.col("grid_index"), n) / n
    power = bins.groupBy(*keys, "k").agg(
        F.first("step_ms").alias("step_ms"), F.first("grid_points").alias("grid_points"),
        F.sum(F.col("_y") * F.cos(angle)).alias("_re"), F.sum(F.col("_y") * F.sin(angle)).alias("_im"),
    ).withColumn("_p", (F.col("_re") ** 2 + F.col("_im") ** 2) / (n * n))
    shared = power.withColumn("_total", F.sum("_p").over(whole)).withColumn(
        "_share", F.try_divide(F.col("_p"), F.col("_total")))
    log_share = F.when(F.col("_share") > 0, -F.col("_share") * F.ln("_share"))
    count = F.count(F.lit(1))
    return shared.groupBy(*keys).agg(
        F.sum("_p").alias("spectral_energy"),
        F.coalesce(F.max_by("k", F.struct(F.round("_share", 9), -F.col("k")))
                   / (F.first("grid_points") * F.first("step_ms") / 1000.0), F.lit(0.0))
        .alias("dominant_frequency_hz"),
        F.coalesce(F.sum(log_share) / F.when(count > 1, F.ln(count)).otherwise(F.lit(1.0)), F.lit(0.0))
        .alias("spectral_entropy"))


def _spectrum_row(stamps: np.ndarray, values: np.ndarray) -> tuple[float, float, float]:
    nothing = (0.0, 0.0, 0.0)
    if len(values) < 4:
        return nothing
    step = float(np.median(np.diff(stamps)))
    points = int(np.ceil((stamps[-1] - stamps[0] + step / 2) / step))
    if points < 4:
        return nothing
    grid = np.interp(stamps[0] + step * np.arange(points), stamps, values)
    power = np.abs(np.fft.rfft(grid - grid.mean())[1:]) ** 2 / points**2
    energy = float(power.sum())
    if energy <= 0:
        return nothing
    share = power / energy
    peak = int(np.argmax(np.round(share, 9))) + 1
    used = share[share > 0]
    entropy = float(-(used * np.log(used)).sum()) / (np.log(len(share)) if len(share) > 1 else 1.0)
    return energy, peak / (points * step / 1000.0), entropy


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in SPECTRAL]))
def spectrum_fft(stamps: pd.Series, values: pd.Series) -> pd.DataFrame:
    """Spectral features of ordered samples; one FFT per window, Arrow batches in between."""
    rows = [_spectrum_row(np.asarray(t, dtype=float), np.asarray(v, dtype=float))
            for t, v in zip(stamps, values)]
    return pd.DataFrame(rows, columns=list(SPECTRAL))


def axis_correlations(events: DataFrame, clock: DataFrame, config: FeatureConfig) -> DataFrame:
    """Mean absolute axis correlation per (window, context, vector sensor), over all raw rows.

    Moments are partial aggregates, so copies and hot windows merge map-side.
    """
    vectors = [s for s, names in config.sensors.items() if CORRELATION in names and s != "pressure"]
    axes = [a for s in vectors for a in SENSOR_AXES[s]]
    placed = win.assign_windows(events.select(win.SESSION, "timestamp_ms", *axes), clock,
                                config.window_ms, config.step_ms)
    contexts = F.filter(F.array(*[F.lit(c).cast("bigint") for c in config.contexts_ms]),
                        lambda c: F.col("timestamp_ms") >= F.col("window_end_ms") - c)
    placed = placed.withColumn("context_ms", F.explode(contexts))
    aggs = []
    for s in vectors:
        xyz = [F.col(a) for a in SENSOR_AXES[s]]
        ok = magnitude(*xyz).isNotNull()
        aggs.append(mean_axis_correlation(*[F.when(ok, a) for a in xyz]).alias(s))
    return placed.groupBy(*win.WINDOW_KEYS, "context_ms").agg(*aggs)


def group_features(rows: DataFrame, config: FeatureConfig, names: list[str] | None = None) -> DataFrame:
    """Gate measures and requested aggregate features per (window, context, sensor)."""
    if names is None:
        names = sorted({a for aggs in config.sensors.values() for a in aggs})
    rows = win.with_gaps(rows)
    if "mean_absolute_deviation" in names:
        rows = with_mean(rows)
    if {"mean_absolute_jerk", "jerk_standard_deviation"} & set(names):
        rows = with_jerk(rows)
    aggs = [REGISTRY[n]().alias(n) for n in names if n in REGISTRY]
    if BASELINED in names:
        aggs += [F.avg("value").alias("_mean_value"), _first().alias("_first_value")]
    if set(SPECTRAL) & set(names):
        aggs.append(F.sort_array(F.collect_list(
            F.when(F.col("value").isNotNull(), F.struct("timestamp_ms", "value")))).alias("_series"))
    groups = rows.groupBy(*win.GROUP).agg(
        *win.gate_columns(), F.first("window_start_ms").alias("window_start_ms"),
        F.first("window_end_ms").alias("window_end_ms"),
        F.min_by("meta", "timestamp_ms").alias("meta"), F.min("timestamp_ms").alias("_from"),
        F.count("value").alias("finite_count"), *aggs)
    groups = groups.withColumn("passes", win.group_passes(config, F.col("meta.domain")))
    if set(SPECTRAL) & set(names):
        spectrum = spectrum_fft(F.col("_series.timestamp_ms"), F.col("_series.value"))
        groups = groups.withColumn("_spectrum", spectrum).select("*", "_spectrum.*").drop("_spectrum", "_series")
    return groups


def feature_frame(events: DataFrame, config: FeatureConfig, order: str | None = "seq",
                  expected_domain: str | None = None) -> DataFrame:
    """Wide float32 feature table: one row per window that passes the sampling gate.

    Shuffles: one to collapse copies per timestamp, one narrow one for the session clock, and one on
    (session, window) for everything else. A window kept by the gate whose only readings are
    infinite raises, as it has nothing to aggregate.
    """
    if expected_domain is not None:
        wrong = F.col("domain") != F.lit(expected_domain)
        events = events.withColumn("domain", F.when(wrong, F.raise_error(F.concat(
            F.lit(f"expected domain {expected_domain}, got "), "domain"))).otherwise(F.col("domain")))
    sensors = list(config.sensors)
    clock = win.keep_durations(win.session_clock(events, config.step_ms, config.bucket_ms),
                               config.minimum_seconds, config.maximum_seconds)
    samples = win.compact_samples(events, sensors, order=order)
    rows = win.windowed_sensors(samples, clock, config)
    if config.wants(*SPECTRAL):
        # Series are gathered and transformed for kept windows alone; the gate reads the rows of the same exchange.
        kept = win.quality_gate(rows, config).where("kept").select(*win.WINDOW_KEYS)
        rows = rows.join(kept, list(win.WINDOW_KEYS), "left_semi")
    groups = group_features(rows, config)

    layout = config.feature_columns()
    names = sorted({a for _, _, _, a in layout} - {BASELINED, CORRELATION})
    picks = []
    for c in config.contexts_ms:
        for s, aggs in config.sensors.items():
            here = (F.col("context_ms") == c) & (F.col("sensor") == s)
            for a in aggs:
                if a in names:
                    picks.append(F.max(F.when(here, F.col(a))).alias(f"_{s}_{c}_{a}"))
                if a == BASELINED:
                    picks += [F.max(F.when(here, F.col("_mean_value"))).alias(f"_{s}_{c}_m"),
                              F.max(F.when(here, F.col("_first_value"))).alias(f"_{s}_{c}_f")]
    wide = groups.groupBy(*win.WINDOW_KEYS).agg(
        F.first("window_start_ms").alias("window_start_ms"), F.first("window_end_ms").alias("window_end_ms"),
        F.min_by("meta", "_from").alias("meta"),
        F.count_if("passes").alias("_passing"), F.min("finite_count").alias("_fewest"), *picks,
    ).where(F.col("_passing") == len(config.contexts_ms) * len(sensors))

    baselined = [s for s, aggs in config.sensors.items() if BASELINED in aggs]
    anchored = [s for s in baselined if s in ("pressure", "magnetometer")]
    if anchored:
        wide = wide.join(win.session_baseline(events, anchored, order), win.SESSION, "left")
    if config.wants(CORRELATION):
        vectors = [s for s in sensors if CORRELATION in config.sensors[s] and s != "pressure"]
        if vectors:
            flat = axis_correlations(events, clock, config).groupBy(*win.WINDOW_KEYS).agg(*[
                F.max(F.when(F.col("context_ms") == c, F.col(s))).alias(f"_{s}_{c}_{CORRELATION}")
                for c in config.contexts_ms for s in vectors])
            wide = wide.join(flat, list(win.WINDOW_KEYS), "left")

    def output(c: int, s: str, a: str) -> Column:
        if a == BASELINED:
            first = F.col(f"_{s}_{c}_f")
            base = F.coalesce(F.col(f"{s}_baseline"), first) if s in anchored else first
            return F.col(f"_{s}_{c}_m") - base
        if a == CORRELATION and s == "pressure":
            return F.lit(0.0)
        return F.coalesce(F.col(f"_{s}_{c}_{a}"), F.lit(0.0))

    checked = F.when(F.col("_fewest") > 0, F.col("window_start_ms")).otherwise(
        F.raise_error(F.lit("a kept window has no finite sample to aggregate")))
    return wide.select(
        *[F.col(f"meta.{c}").alias(c) for c in METADATA],
        checked.cast("bigint").alias("window_start_ms"), "window_end_ms",
        *[output(c, s, a).cast("float").alias(name) for name, c, s, a in layout])
