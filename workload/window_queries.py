"""Windows, gate and features over the sensor events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.config import SENSOR_AXES
from strideframe.functions.scalars import magnitude
from strideframe.operators import features as feat, windows as win
from workload import views as v
from workload.registry import query, with_views

KEYS = ["session_id", "window_index", "context_ms", "sensor"]
SENSORS = ["accelerometer", "pressure"]


def r(c, name=None):
    return F.round(F.col(c), 6).alias(name or c)


def clock(spark, sf):
    return win.session_clock(v.sensor_events(spark, sf), v.STEP, v.DAY)


def rows(spark, sf, config):
    events = v.sensor_events(spark, sf)
    samples = win.compact_samples(events, list(config.sensors), metadata=("domain",))
    return win.windowed_sensors(samples, clock(spark, sf), config)


def grouped(spark, sf, config, names):
    return feat.group_features(rows(spark, sf, config), config, names)


@query("vector_magnitude", with_views("""
SELECT seq, round(sqrt(ax*ax + ay*ay + az*az), 6) AS acceleration, round(sqrt(mx*mx + my*my + mz*mz), 6) AS field, p AS pressure
FROM sensor_events""", v.SENSOR_EVENTS))
def vector_magnitude(spark, sf):
    size = {s: magnitude(*[F.col(a) for a in SENSOR_AXES[s]]) for s in SENSOR_AXES}
    return v.sensor_events(spark, sf).select(
        "seq", F.round(size["accelerometer"], 6).alias("acceleration"),
        F.round(size["magnetometer"], 6).alias("field"), size["pressure"].alias("pressure"))


@query("sample_interval", with_views("SELECT * FROM clock", v.SENSOR_EVENTS, v.CLOCK))
def sample_interval(spark, sf):
    return clock(spark, sf)


@query("duration_filter", with_views("""
SELECT session_id, count(*) AS n_events, min(timestamp_ms) AS first_ms FROM sensor_events GROUP BY session_id
HAVING (max(timestamp_ms) - min(timestamp_ms)) / 1000.0 BETWEEN 2300000 AND 2480000""", v.SENSOR_EVENTS))
def duration_filter(spark, sf):
    kept = win.duration_filter(v.sensor_events(spark, sf), 2_300_000, 2_480_000)
    return kept.groupBy("session_id").agg(F.count("*").alias("n_events"), F.min("timestamp_ms").alias("first_ms"))


@query("sliding_windows", with_views("""
SELECT session_id, window_index, window_start_ms, window_end_ms, count(*) AS n_events,
  round(avg(sqrt(ax*ax + ay*ay + az*az)), 6) AS mean_acceleration
FROM window_rows GROUP BY ALL""", v.SENSOR_EVENTS, v.CLOCK, v.SESSION_WINDOWS, v.WINDOW_ROWS))
def sliding_windows(spark, sf):
    events = v.sensor_events(spark, sf).select(
        "session_id", "timestamp_ms", magnitude(F.col("ax"), F.col("ay"), F.col("az")).alias("a"))
    placed = win.assign_windows(events, clock(spark, sf), v.WINDOW, v.STEP)
    return placed.groupBy("session_id", "window_index", "window_start_ms", "window_end_ms").agg(
        F.count("*").alias("n_events"), F.round(F.avg("a"), 6).alias("mean_acceleration"))


@query("multiscale_contexts", with_views("""
SELECT session_id, window_index, context_ms, sensor, CAST(sum(raw) AS BIGINT) AS n_raw, count(*) AS n_stamps,
  min(timestamp_ms) AS first_ms FROM context_rows GROUP BY ALL""", *v.CONTEXT_VIEWS[:6]))
def multiscale_contexts(spark, sf):
    return rows(spark, sf, v.config(contexts=(v.SHORT, v.WINDOW))).groupBy(*KEYS).agg(
        F.sum("raw").alias("n_raw"), F.count("*").alias("n_stamps"), F.min("timestamp_ms").alias("first_ms"))


@query("quality_gate", with_views("""
SELECT session_id, window_index, any_value(window_start_ms) AS window_start_ms, any_value(window_end_ms) AS window_end_ms,
  CAST(sum(sample_count) AS BIGINT) AS gate_samples, count(*) FILTER (WHERE passes) = 4 AS kept
FROM gated GROUP BY ALL""", *v.CONTEXT_VIEWS, v.GATE_GROUPS, v.GATED))
def quality_gate(spark, sf):
    config = v.config(contexts=(v.SHORT, v.WINDOW))
    return win.quality_gate(rows(spark, sf, config), config)


@query("dedupe_timestamps", with_views("""
SELECT session_id, timestamp_ms, min_by(ax, seq) AS first_ax, count(*) AS n_copies FROM (
  SELECT *, timestamp_ms // 3600000 * 3600000 AS t FROM sensor_events WHERE ax IS NOT NULL) GROUP BY session_id, timestamp_ms
""".replace("timestamp_ms, min_by", "t AS timestamp_ms, min_by").replace("session_id, timestamp_ms\n", "session_id, t\n"),
    v.SENSOR_EVENTS))
def dedupe_timestamps(spark, sf):
    """Timestamps coarsened to the hour, so that copies exist; the first reading of each is kept."""
    hour = F.col("timestamp_ms") - F.pmod("timestamp_ms", F.lit(3_600_000))
    events = v.sensor_events(spark, sf).withColumn("timestamp_ms", hour).withColumn(
        "ay", F.lit(0.0)).withColumn("az", F.lit(0.0))
    samples = win.compact_samples(events, ["accelerometer"], metadata=())
    return samples.where("accelerometer_raw > 0").select(
        "session_id", "timestamp_ms", F.col("accelerometer_value").alias("first_ax"),
        F.col("accelerometer_raw").alias("n_copies"))


@query("session_baseline", with_views("""
SELECT session_id, min_by(p, struct_pack(t := timestamp_ms, s := seq)) FILTER (WHERE p IS NOT NULL) AS pressure_baseline,
  round(quantile_cont(sqrt(mx*mx + my*my + mz*mz), 0.5), 6) AS magnetometer_baseline
FROM sensor_events GROUP BY session_id""", v.SENSOR_EVENTS))
def session_baseline(spark, sf):
    base = win.session_baseline(v.sensor_events(spark, sf), ["pressure", "magnetometer"])
    return base.select("session_id", "pressure_baseline", r("magnetometer_baseline"))


@query("window_metadata", with_views("""
SELECT session_id, window_index, any_value(window_start_ms) AS window_start_ms, any_value(window_end_ms) AS window_end_ms,
  arg_min(domain, (timestamp_ms, seq)) AS domain, arg_min(participant_id, (timestamp_ms, seq)) AS participant_id,
  arg_min(device_id, (timestamp_ms, seq)) AS device_id, arg_min(trip_id, (timestamp_ms, seq)) AS trip_id,
  arg_min(group_id, (timestamp_ms, seq)) AS group_id, arg_min(vehicle_type, (timestamp_ms, seq)) AS vehicle_type,
  arg_min(label, (timestamp_ms, seq)) AS label, arg_min(phone_position, (timestamp_ms, seq)) AS phone_position
FROM window_rows GROUP BY session_id, window_index""", *v.WINDOW_VIEWS[:4]))
def window_metadata(spark, sf):
    samples = win.compact_samples(v.sensor_events(spark, sf), ["pressure"])
    return win.window_metadata(samples, clock(spark, sf), v.config())


BASE = "SELECT session_id, window_index, context_ms, sensor, {} FROM gaps GROUP BY session_id, window_index, context_ms, sensor"


def stats_oracle(columns: str) -> str:
    return with_views(BASE.format(columns), *v.WINDOW_VIEWS)


@query("basic_stats", stats_oracle("""round(min(value), 6) AS minimum, round(max(value), 6) AS maximum,
  round(max(value) - min(value), 6) AS range, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance,
  round(stddev_pop(value), 6) AS standard_deviation"""))
def basic_stats(spark, sf):
    return grouped(spark, sf, v.config(), list(v.ALL_STATS)).select(*KEYS, *[r(n) for n in v.ALL_STATS])


@query("kurtosis_unbiased", stats_oracle("""round(coalesce(CASE WHEN count(value) > 3 THEN
  (count(value) - 1) / ((count(value) - 2.0) * (count(value) - 3.0)) * ((count(value) + 1) * kurtosis_pop(value) + 6)
  ELSE CASE WHEN isfinite(kurtosis_pop(value)) THEN kurtosis_pop(value) END END, 0), 6) AS kurtosis"""))
def kurtosis_unbiased(spark, sf):
    return grouped(spark, sf, v.config(), ["kurtosis"]).select(*KEYS, r("kurtosis"))


@query("iqr", stats_oracle("round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS interquartile_range"))
def iqr(spark, sf):
    return grouped(spark, sf, v.config(), ["interquartile_range"]).select(*KEYS, r("interquartile_range"))


@query("mean_abs_deviation", stats_oracle("round(avg(abs(value - group_mean)), 9) AS mean_absolute_deviation"))
def mean_abs_deviation(spark, sf):
    return grouped(spark, sf, v.config(), ["mean_absolute_deviation"]).select(
        *KEYS, F.round("mean_absolute_deviation", 9).alias("mean_absolute_deviation"))


@query("jerk_features", stats_oracle("""round(coalesce(avg(abs(jerk)), 0), 9) AS mean_absolute_jerk,
  round(coalesce(stddev_pop(jerk), 0), 9) AS jerk_standard_deviation"""))
def jerk_features(spark, sf):
    names = ["mean_absolute_jerk", "jerk_standard_deviation"]
    return grouped(spark, sf, v.config(), names).select(*KEYS, *[F.round(n, 9).alias(n) for n in names])


@query("delta_features", with_views("""
SELECT g.session_id, window_index, context_ms, sensor,
  round(arg_max(value, timestamp_ms) - arg_min(value, timestamp_ms), 6) AS delta_from_window_start,
  round(avg(value) - coalesce(CASE WHEN sensor = 'pressure' THEN any_value(b.base) END, arg_min(value, timestamp_ms)), 6)
    AS delta_from_session_baseline
FROM gaps g LEFT JOIN (SELECT session_id, arg_min(p, (timestamp_ms, seq)) AS base FROM sensor_events
  WHERE p IS NOT NULL GROUP BY session_id) b ON b.session_id = g.session_id
GROUP BY g.session_id, window_index, context_ms, sensor""", *v.WINDOW_VIEWS))
def delta_features(spark, sf):
    names = ["delta_from_window_start", feat.BASELINED]
    groups = grouped(spark, sf, v.config(), names)
    base = win.session_baseline(v.sensor_events(spark, sf), ["pressure"])
    anchor = F.coalesce(F.when(F.col("sensor") == "pressure", F.col("pressure_baseline")), F.col("_first_value"))
    return groups.join(base, "session_id", "left").select(
        *KEYS, r(names[0]), F.round(F.col("_mean_value") - anchor, 6).alias(names[1]))


AXIS = """SELECT session_id, window_index, {context} AS context_ms, coalesce((coalesce(abs(xy), 0) + coalesce(abs(xz), 0) + coalesce(abs(yz), 0))
  / nullif((xy IS NOT NULL)::INT + (xz IS NOT NULL)::INT + (yz IS NOT NULL)::INT, 0), 0) AS mean_axis_correlation
FROM (SELECT session_id, window_index,
  covar_pop(ax, ay) / nullif(stddev_pop(ax) * stddev_pop(ay), 0) AS xy,
  covar_pop(ax, az) / nullif(stddev_pop(ax) * stddev_pop(az), 0) AS xz,
  covar_pop(ay, az) / nullif(stddev_pop(ay) * stddev_pop(az), 0) AS yz
  FROM window_rows WHERE timestamp_ms >= window_end_ms - {context} GROUP BY session_id, window_index)"""


@query("axis_correlation", with_views(
    f"SELECT session_id, window_index, context_ms, round(mean_axis_correlation, 6) AS mean_axis_correlation FROM ("
    f"{AXIS.format(context=v.SHORT)} UNION ALL {AXIS.format(context=v.WINDOW)})", *v.WINDOW_VIEWS[:4]))
def axis_correlation(spark, sf):
    config = v.config(accelerometer=(feat.CORRELATION,), contexts=(v.SHORT, v.WINDOW))
    found = feat.axis_correlations(v.sensor_events(spark, sf), clock(spark, sf), config)
    return found.select("session_id", "window_index", F.col("context_ms").cast("int").alias("context_ms"),
                        r("accelerometer", feat.CORRELATION))


GRID = (
    ("segments", """SELECT session_id, window_index, context_ms, sensor, timestamp_ms AS t, value AS v,
  lead(timestamp_ms) OVER o AS t2, lead(value) OVER o AS v2, min(timestamp_ms) OVER w AS t0, max(timestamp_ms) OVER w AS tn,
  count(*) OVER w AS n_rows
FROM gaps WINDOW w AS (PARTITION BY session_id, window_index, context_ms, sensor),
  o AS (PARTITION BY session_id, window_index, context_ms, sensor ORDER BY timestamp_ms)"""),
    ("steps", """SELECT session_id, window_index, context_ms, sensor, any_value(t0) AS t0, any_value(tn) AS tn,
  quantile_cont(t2 - t, 0.5) AS step_ms FROM segments WHERE n_rows >= 4 GROUP BY ALL"""),
    ("points", """SELECT * FROM (SELECT *, CAST(ceil((tn - t0 + step_ms / 2) / step_ms) AS BIGINT) AS grid_points FROM steps)
  WHERE grid_points >= 4"""),
    ("grid", """SELECT p.*, CAST(i AS BIGINT) AS grid_index, t0 + i * step_ms AS stamp FROM points p, generate_series(0, 2000) AS g(i)
  WHERE i < grid_points"""),
    # bracketing sample: the last one at or before the grid point
    ("resampled", """SELECT g.session_id, g.window_index, g.context_ms, g.sensor, grid_index, grid_points, step_ms,
  s.v + coalesce((s.v2 - s.v) / (s.t2 - s.t), 0) * (stamp - s.t) AS grid_value
FROM grid g JOIN segments s ON s.session_id = g.session_id AND s.window_index = g.window_index
  AND s.context_ms = g.context_ms AND s.sensor = g.sensor AND s.t <= stamp AND (s.t2 IS NULL OR stamp < s.t2)"""),
)


@query("resample_linear", with_views("""
SELECT session_id, window_index, context_ms, sensor, grid_index, grid_points, round(step_ms, 6) AS step_ms,
  round(grid_value, 6) AS grid_value FROM resampled""", *v.WINDOW_VIEWS, *GRID))
def resample_linear(spark, sf):
    grid = feat.resample_linear(rows(spark, sf, v.config()), KEYS)
    return grid.select(*KEYS, "grid_index", "grid_points", r("step_ms"), r("grid_value"))


SPECTRUM = (
    ("centred", "SELECT *, grid_value - avg(grid_value) OVER (PARTITION BY session_id, window_index, context_ms, sensor) AS y FROM resampled"),
    ("power", """SELECT session_id, window_index, context_ms, sensor, k, any_value(step_ms) AS step_ms, any_value(grid_points) AS n,
  (pow(sum(y * cos(2 * pi() * ((k * grid_index) % grid_points) / grid_points)), 2)
   + pow(sum(y * sin(2 * pi() * ((k * grid_index) % grid_points) / grid_points)), 2)) / (any_value(grid_points) * any_value(grid_points)) AS p
FROM centred, generate_series(1, 1000) AS b(k) WHERE k <= grid_points // 2 GROUP BY ALL"""),
    ("shares", "SELECT *, p / nullif(sum(p) OVER (PARTITION BY session_id, window_index, context_ms, sensor), 0) AS share FROM power"),
    ("spectrum", """SELECT session_id, window_index, context_ms, sensor, sum(p) AS energy,
  coalesce(arg_max(k, (round(share, 9), -k)) FILTER (WHERE share IS NOT NULL) / (any_value(n) * any_value(step_ms) / 1000), 0) AS dominant,
  coalesce(sum(CASE WHEN share > 0 THEN -share * ln(share) END) / CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1 END, 0) AS entropy
FROM shares GROUP BY session_id, window_index, context_ms, sensor"""),
    ("all_groups", "SELECT DISTINCT session_id, window_index, context_ms, sensor FROM gaps"),
)


@query("spectral_features", with_views("""
SELECT a.*, round(coalesce(energy, 0), 6) AS spectral_energy, round(coalesce(dominant, 0), 12) AS dominant_frequency_hz,
  round(coalesce(entropy, 0), 6) AS spectral_entropy
FROM all_groups a LEFT JOIN spectrum s USING (session_id, window_index, context_ms, sensor)""",
    *v.WINDOW_VIEWS, *GRID, *SPECTRUM))
def spectral_features(spark, sf):
    found = grouped(spark, sf, v.config(), list(feat.SPECTRAL))
    return found.select(*KEYS, r("spectral_energy"), F.round("dominant_frequency_hz", 12).alias("dominant_frequency_hz"),
                        r("spectral_entropy"))


@query("spectral_features_sql", with_views("""
SELECT session_id, window_index, context_ms, sensor, round(energy, 6) AS spectral_energy,
  round(dominant, 12) AS dominant_frequency_hz, round(entropy, 6) AS spectral_entropy FROM spectrum""",
    *v.WINDOW_VIEWS, *GRID, *SPECTRUM))
def spectral_features_sql(spark, sf):
    found = feat.spectrum_sql(feat.resample_linear(rows(spark, sf, v.config()), KEYS), KEYS)
    return found.select(*KEYS, r("spectral_energy"), F.round("dominant_frequency_hz", 12).alias("dominant_frequency_hz"),
                        r("spectral_entropy"))


FRAME_STATS = ("mean", "standard_deviation", "maximum", "interquartile_range", "mean_absolute_jerk", feat.CORRELATION)
PRESSURE_STATS = ("mean", "kurtosis", "delta_from_window_start", feat.BASELINED)


def frame_config():
    return v.config(accelerometer=FRAME_STATS, pressure=PRESSURE_STATS, contexts=(v.SHORT, v.WINDOW))


def _frame_columns() -> str:
    out = []
    for c in (v.SHORT, v.WINDOW):
        here = f"FILTER (WHERE context_ms = {c} AND sensor = '{{}}')"
        a, p = here.format("accelerometer"), here.format("pressure")
        tag = f"@{c // 1000}s"
        for name, expr in (
            ("mean", f"avg(value) {a}"), ("standard_deviation", f"stddev_pop(value) {a}"), ("maximum", f"max(value) {a}"),
            ("interquartile_range", f"quantile_cont(value, 0.75) {a} - quantile_cont(value, 0.25) {a}"),
            ("mean_absolute_jerk", f"coalesce(avg(abs(jerk)) {a}, 0)"),
            ("mean_axis_correlation", f"any_value(axis_{c})"),
        ):
            out.append(f'round(CAST({expr} AS FLOAT), 2) AS "accelerometer#{name}{tag}"')
        n = f"count(value) {p}"
        k = f"kurtosis_pop(value) {p}"
        for name, expr in (
            ("mean", f"avg(value) {p}"),
            ("kurtosis", f"coalesce(CASE WHEN {n} > 3 THEN ({n} - 1) / (({n} - 2.0) * ({n} - 3.0)) * (({n} + 1) * {k} + 6) "
                         f"ELSE CASE WHEN isfinite({k}) THEN {k} END END, 0)"),
            ("delta_from_window_start", f"arg_max(value, timestamp_ms) {p} - arg_min(value, timestamp_ms) {p}"),
            ("delta_from_session_baseline", f"avg(value) {p} - any_value(base)"),
        ):
            out.append(f'round(CAST({expr} AS FLOAT), 2) AS "pressure#{name}{tag}"')
    return ",\n".join(out)


AXES_WIDE = ("axes_wide", " UNION ALL ".join(
    AXIS.format(context=c) for c in (v.SHORT, v.WINDOW)))

FRAME_VIEWS = (
    *v.CONTEXT_VIEWS, v.GATE_GROUPS, v.GATED,
    ("kept", """SELECT session_id, window_index FROM gated GROUP BY ALL HAVING count(*) FILTER (WHERE passes) = 4"""),
    AXES_WIDE,
    ("enriched", f"""SELECT g.*, x.mean_axis_correlation AS axis_{v.SHORT}, y.mean_axis_correlation AS axis_{v.WINDOW}, base
FROM gaps g JOIN kept USING (session_id, window_index)
LEFT JOIN axes_wide x ON x.session_id = g.session_id AND x.window_index = g.window_index AND x.context_ms = {v.SHORT}
LEFT JOIN axes_wide y ON y.session_id = g.session_id AND y.window_index = g.window_index AND y.context_ms = {v.WINDOW}
LEFT JOIN (SELECT session_id, arg_min(p, (timestamp_ms, seq)) AS base FROM sensor_events WHERE p IS NOT NULL GROUP BY session_id) b
  ON b.session_id = g.session_id"""),
    ("meta", """SELECT session_id, any_value(domain) AS domain, any_value(participant_id) AS participant_id,
  any_value(device_id) AS device_id, any_value(trip_id) AS trip_id, any_value(group_id) AS group_id,
  any_value(vehicle_type) AS vehicle_type, any_value(label) AS label, any_value(phone_position) AS phone_position
FROM sensor_events GROUP BY session_id"""),
    ("features", f"""SELECT m.*, f.* EXCLUDE (session_id) FROM (SELECT session_id, any_value(window_start_ms) AS window_start_ms,
  any_value(window_end_ms) AS window_end_ms, {_frame_columns()} FROM enriched GROUP BY session_id, window_index) f
  JOIN meta m USING (session_id)"""),
)


@query("feature_frame", with_views("SELECT * FROM features", *FRAME_VIEWS))
def feature_frame(spark, sf):
    config = frame_config()
    frame = feat.feature_frame(v.sensor_events(spark, sf), config)
    names = {n for n, *_ in config.feature_columns()}
    return frame.select(*[F.round(f"`{c}`", 2).alias(c) if c in names else F.col(c) for c in frame.columns])
