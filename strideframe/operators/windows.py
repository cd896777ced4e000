"""Session-anchored sliding windows, sampling gate and session-level measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strideframe.config import SENSOR_AXES, FeatureConfig
from strideframe.functions.scalars import magnitude, present
from strideframe.operators.ordered import exact_quantiles, max_before, previous
from strideframe.schema import METADATA

SESSION = "session_id"
WINDOW_KEYS = (SESSION, "window_index")


def session_clock(events: DataFrame, step_ms: int, bucket_ms: int = 3_600_000) -> DataFrame:
    """Start, end and sample interval per session.

    The interval is the whole part of the median positive gap between timestamps, or the step
    where there is no gap. Copies collapse map-side first; the previous timestamp is found per time
    bucket (at most `bucket_ms` distinct stamps); the median is taken over a (gap, count) histogram,
    whose size is bounded by the square root of the session span.
    """
    stamps = (events.select(SESSION, "timestamp_ms").distinct()
              .withColumn("_bucket", F.floor(F.col("timestamp_ms") / F.lit(bucket_ms))))
    lagged = previous(stamps, [SESSION], "_bucket", "timestamp_ms", "_prev")
    gaps = (lagged.withColumn("_gap", F.col("timestamp_ms") - F.col("_prev"))
            .groupBy(SESSION, "_gap")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("timestamp_ms").alias("_lo"),
                 F.max("timestamp_ms").alias("_hi")))
    return gaps.groupBy(SESSION).agg(
        F.min("_lo").alias("session_start_ms"), F.max("_hi").alias("session_end_ms"),
        F.coalesce(F.floor(F.expr("percentile(_gap, 0.5D, _n)")).cast("bigint"),
                   F.lit(step_ms).cast("bigint")).alias("sample_interval_ms"))


def keep_durations(clock: DataFrame, minimum_seconds: float, maximum_seconds: float | None) -> DataFrame:
    """Sessions whose length lies in the inclusive range; no maximum means unlimited."""
    seconds = (F.col("session_end_ms") - F.col("session_start_ms")) / F.lit(1000.0)
    keep = seconds >= F.lit(float(minimum_seconds))
    if maximum_seconds is not None:
        keep = keep & (seconds <= F.lit(float(maximum_seconds)))
    return clock.where(keep)


def duration_filter(events: DataFrame, minimum_seconds: float, maximum_seconds: float | None) -> DataFrame:
    bounds = events.groupBy(SESSION).agg(F.min("timestamp_ms").alias("session_start_ms"),
                                         F.max("timestamp_ms").alias("session_end_ms"))
    kept = keep_durations(bounds, minimum_seconds, maximum_seconds).select(SESSION)
    return events.join(kept, SESSION, "left_semi")


def _div(top: Column, bottom: int) -> Column:
    """Whole-number division in 64 bits; operands must not be negative."""
    return F.call_function("div", top, F.lit(bottom).cast("bigint"))


def assign_windows(samples: DataFrame, clock: DataFrame, window_ms: int, step_ms: int) -> DataFrame:
    """Rows repeated for each window `[start + k*step, + window)` that holds them.

    Window k exists while it fits into session end plus one sample interval. The indices follow by
    arithmetic, so there is no interval join; each row is touched about window/step times.
    """
    room = (F.col("session_end_ms") + F.col("sample_interval_ms") - F.col("session_start_ms")
            - F.lit(window_ms))
    count = F.when(room >= 0, _div(room, step_ms) + 1).otherwise(F.lit(0).cast("bigint"))
    bounds = clock.select(SESSION, "session_start_ms", count.alias("_windows")).where("_windows > 0")
    offset = F.col("timestamp_ms") - F.col("session_start_ms")
    first = F.greatest(F.lit(0).cast("bigint"),
                       F.when(offset >= window_ms, _div(offset - window_ms, step_ms) + 1))
    last = F.least(F.col("_windows") - 1, _div(offset, step_ms))
    joined = (samples.join(bounds, SESSION)
              .withColumn("_first", first).withColumn("_last", last).where("_first <= _last"))
    return (joined.withColumn("window_index", F.explode(F.sequence("_first", "_last")))
            .withColumn("window_start_ms", F.col("session_start_ms") + F.col("window_index") * F.lit(step_ms))
            .withColumn("window_end_ms", F.col("window_start_ms") + F.lit(window_ms))
            .drop("_first", "_last", "_windows", "session_start_ms"))


def compact_samples(events: DataFrame, sensors: list[str], metadata: tuple[str, ...] = METADATA,
                    order: str | None = "seq") -> DataFrame:
    """One row per (session, timestamp): first finite magnitude and raw count per sensor.

    Copies of a timestamp, however many, collapse map-side here, so a window later holds no more rows
    than it has milliseconds. `order` breaks ties; without it all sensor values do.
    """
    tie = F.col(order) if order else F.struct(*[F.col(a) for s in sensors for a in SENSOR_AXES[s]])
    aggs = [F.min_by(F.struct(*metadata), tie).alias("meta")] if metadata else []
    for s in sensors:
        axes = [F.col(a) for a in SENSOR_AXES[s]]
        size = magnitude(*axes)
        aggs.append(F.min_by(size, F.when(size.isNotNull(), tie)).alias(f"{s}_value"))
        aggs.append(F.count(F.when(present(*axes), 1)).alias(f"{s}_raw"))
    return events.groupBy(SESSION, "timestamp_ms").agg(*aggs)


def sensor_rows(samples: DataFrame, sensors: list[str], keep: list[str]) -> DataFrame:
    """Wide samples -> one row per (row, sensor) that has a reading."""
    entries = F.array(*[
        F.struct(F.lit(s).alias("sensor"), F.col(f"{s}_value").alias("value"), F.col(f"{s}_raw").alias("raw"))
        for s in sensors])
    return samples.select(*keep, F.inline(F.filter(entries, lambda e: e["raw"] > 0)))


def windowed_sensors(samples: DataFrame, clock: DataFrame, config: FeatureConfig) -> DataFrame:
    """Samples per (session, window, context, sensor), hash-placed by window.

    One exchange on (session, window) serves every later window function and aggregate, since their
    keys all contain it.
    """
    sensors = list(config.sensors)
    placed = assign_windows(samples, clock, config.window_ms, config.step_ms).repartition(*WINDOW_KEYS)
    keep = [SESSION, "window_index", "window_start_ms", "window_end_ms", "timestamp_ms"]
    keep += [c for c in ("meta",) if c in samples.columns]
    rows = sensor_rows(placed, sensors, keep)
    if config.contexts_ms == (config.window_ms,):
        return rows.withColumn("context_ms", F.lit(config.window_ms).cast("bigint"))
    contexts = F.array(*[F.lit(c).cast("bigint") for c in config.contexts_ms])
    inside = F.filter(contexts, lambda c: F.col("timestamp_ms") >= F.col("window_end_ms") - c)
    return rows.withColumn("context_ms", F.explode(inside))


def policy_columns(config: FeatureConfig, domain: Column) -> tuple[Column, Column]:
    """(required samples, gap limit) for the row's domain, context and sensor, as CASE expressions."""
    required, limit = F.lit(1), F.lit(None).cast("bigint")
    for name, policy in config.policies.items():
        for c in config.contexts_ms:
            for s in config.sensors:
                here = (domain == name) & (F.col("context_ms") == c) & (F.col("sensor") == s)
                required = F.when(here, F.lit(policy.required(c, s))).otherwise(required)
        if policy.maximum_gap_ms is not None:
            limit = F.when(domain == name, F.lit(policy.maximum_gap_ms).cast("bigint")).otherwise(limit)
    return required, limit


GROUP = (*WINDOW_KEYS, "context_ms", "sensor")


def group_order() -> W:
    return W.partitionBy(*GROUP).orderBy("timestamp_ms")


def gate_columns() -> list[Column]:
    """Aggregates of the sampling gate over rows that carry `_gap` to the previous sample."""
    return [
        F.sum("raw").alias("sample_count"),
        F.greatest(
            F.min("timestamp_ms") - (F.first("window_end_ms") - F.col("context_ms")),
            F.max("_gap"), F.first("window_end_ms") - F.max("timestamp_ms")).alias("largest_gap_ms"),
    ]


def with_gaps(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_gap", F.col("timestamp_ms") - F.lag("timestamp_ms").over(group_order()))


def gate_groups(rows: DataFrame, config: FeatureConfig) -> DataFrame:
    """Sample count, largest gap (edges included) and verdict per (window, context, sensor)."""
    groups = with_gaps(rows).groupBy(*GROUP).agg(
        *gate_columns(), F.first("window_start_ms").alias("window_start_ms"),
        F.first("window_end_ms").alias("window_end_ms"), F.first("meta.domain").alias("domain"))
    return groups.withColumn("passes", group_passes(config, F.col("domain")))


def group_passes(config: FeatureConfig, domain: Column) -> Column:
    required, limit = policy_columns(config, domain)
    return (F.col("sample_count") >= required) & (limit.isNull() | (F.col("largest_gap_ms") <= limit))


def quality_gate(rows: DataFrame, config: FeatureConfig) -> DataFrame:
    """One row per window with any sample; kept only if every context x sensor pair passes.

    A sensor without samples has no group, so the passing groups fall short of the full number.
    """
    wanted = len(config.contexts_ms) * len(config.sensors)
    return gate_groups(rows, config).groupBy(*WINDOW_KEYS).agg(
        F.first("window_start_ms").alias("window_start_ms"),
        F.first("window_end_ms").alias("window_end_ms"),
        F.sum("sample_count").alias("gate_samples"),
        (F.count_if("passes") == wanted).alias("kept"))


def session_baseline(events: DataFrame, sensors: list[str], order: str | None = "seq") -> DataFrame:
    """First finite pressure and exact median magnetometer magnitude per session.

    Pressures at the same first timestamp are told apart by `order`, else by their value.
    """
    result = events.select(SESSION).distinct()
    if "pressure" in sensors:
        p = magnitude(F.col("p"))
        when = F.when(p.isNotNull(), F.struct("timestamp_ms", order or "p"))
        result = events.groupBy(SESSION).agg(F.min_by(p, when).alias("pressure_baseline"))
    if "magnetometer" in sensors:
        sizes = events.select(SESSION, magnitude(*[F.col(a) for a in SENSOR_AXES["magnetometer"]]).alias("_m"))
        medians = exact_quantiles(sizes, [SESSION], "_m", [0.5], ["magnetometer_baseline"])
        result = result.join(medians, SESSION, "left")
    return result


def window_metadata(samples: DataFrame, clock: DataFrame, config: FeatureConfig) -> DataFrame:
    """Metadata of the first row in each window."""
    placed = assign_windows(samples.select(SESSION, "timestamp_ms", "meta"), clock,
                            config.window_ms, config.step_ms)
    first = placed.groupBy(*WINDOW_KEYS).agg(
        F.first("window_start_ms").alias("window_start_ms"), F.first("window_end_ms").alias("window_end_ms"),
        F.min_by("meta", "timestamp_ms").alias("meta"))
    return first.select(
        SESSION, "window_index", "window_start_ms", "window_end_ms",
        *[F.col(f"meta.{c}").alias(c) for c in METADATA if c != SESSION])


def covered_duration(intervals: DataFrame, keys: list[str], start: str = "window_start_ms",
                     end: str = "window_end_ms", bucket_ms: int = 86_400_000) -> DataFrame:
    """Seconds covered by the union of intervals per group; touching intervals merge.

    Equal starts collapse to their longest interval; then every row adds what it reaches beyond all
    earlier ends, which needs the running maximum only.
    """
    longest = (intervals.groupBy(*keys, start).agg(F.max(end).alias(end))
               .withColumn("_bucket", F.floor(F.col(start) / F.lit(bucket_ms))))
    reach = max_before(longest, keys, "_bucket", [start], end, "_reach")
    added = F.greatest(F.lit(0).cast("bigint"),
                       F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("_reach"), F.col(start))))
    return reach.groupBy(*keys).agg((F.sum(added) / F.lit(1000.0)).alias("duration_seconds"))
