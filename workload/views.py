"""Stand-in tables: sensor events, predictions, intervals and runs derived from the test tables.

Each view exists twice, as a DataFrame and as SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strideframe.config import FeatureConfig, QualityPolicy, StudyGrid
from strideframe.functions.scalars import composite_key

DAY = 86_400_000
LABELS = {"bus": 0, "car": 1, "train": 2}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def millis(c: str) -> Column:
    return F.unix_millis(F.col(c).cast("timestamp"))


def case(value: Column, *options: str) -> Column:
    out = F
    for i, o in enumerate(options[:-1]):
        out = out.when(value == i, o)
    return out.otherwise(options[-1])


# --- sensor events ----------------------------------------------------------------------------

def sensor_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    u = F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("double")
    pressure = F.col("event_type").isin("signup", "error")
    motion = ~pressure
    magnet = F.col("event_type") == "view"
    base = e.select(
        F.when(u % 5 < 2, "collector").otherwise("source").alias("domain"),
        F.concat(F.lit("p"), u % 7).alias("participant_id"), F.concat(F.lit("d"), u % 3).alias("device_id"),
        F.concat(F.lit("s"), u).alias("session_id"), F.concat(F.lit("s"), u).alias("trip_id"),
        case(u % 3, "bus", "car", "train").alias("vehicle_type"), (u % 3).cast("bigint").alias("label"),
        case(u % 4, "pocket", "hand", "bag", "unknown").alias("phone_position"),
        millis("ts").alias("timestamp_ms"), F.col("event_id").alias("seq"),
        F.when(motion, F.col("value")).alias("ax"), F.when(motion, k).alias("ay"),
        F.when(motion, (F.col("event_id") % 10).cast("double")).alias("az"),
        *[F.lit(None).cast("double").alias(c) for c in ("gx", "gy", "gz")],
        F.when(magnet, k).alias("mx"), F.when(magnet, F.col("value")).alias("my"),
        F.when(magnet, F.lit(1.0)).alias("mz"),
        F.when(pressure, F.col("value")).alias("p"))
    return base.withColumn("group_id", composite_key(F.col("participant_id"), F.col("device_id"), F.col("session_id")))


SENSOR_EVENTS = ("sensor_events", """
SELECT *, participant_id || '#' || device_id || '#' || session_id AS group_id FROM (
SELECT CASE WHEN user_id % 5 < 2 THEN 'collector' ELSE 'source' END AS domain,
  'p' || (user_id % 7) AS participant_id, 'd' || (user_id % 3) AS device_id,
  's' || user_id AS session_id, 's' || user_id AS trip_id,
  CASE user_id % 3 WHEN 0 THEN 'bus' WHEN 1 THEN 'car' ELSE 'train' END AS vehicle_type,
  CAST(user_id % 3 AS BIGINT) AS label,
  CASE user_id % 4 WHEN 0 THEN 'pocket' WHEN 1 THEN 'hand' WHEN 2 THEN 'bag' ELSE 'unknown' END AS phone_position,
  epoch_us(ts) // 1000 AS timestamp_ms, event_id AS seq,
  CASE WHEN event_type NOT IN ('signup','error') THEN value END AS ax,
  CASE WHEN event_type NOT IN ('signup','error') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS ay,
  CASE WHEN event_type NOT IN ('signup','error') THEN CAST(event_id % 10 AS DOUBLE) END AS az,
  CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS mx,
  CASE WHEN event_type = 'view' THEN value END AS my,
  CASE WHEN event_type = 'view' THEN CAST(1.0 AS DOUBLE) END AS mz,
  CASE WHEN event_type IN ('signup','error') THEN value END AS p
FROM events)""")

WINDOW, STEP, SHORT = 6 * DAY, 3 * DAY, 3 * DAY

GATE = QualityPolicy(
    maximum_gap_ms=int(2.5 * DAY),
    minimum_samples={(SHORT, "accelerometer"): 2, (SHORT, "pressure"): 1,
                     (WINDOW, "accelerometer"): 5, (WINDOW, "pressure"): 3})

ALL_STATS = ("minimum", "maximum", "mean", "range", "variance", "standard_deviation")


def config(accelerometer=ALL_STATS, pressure=ALL_STATS, contexts=(WINDOW,), gated=True) -> FeatureConfig:
    return FeatureConfig(
        window_ms=WINDOW, step_ms=STEP, contexts_ms=contexts,
        sensors={"accelerometer": accelerometer, "pressure": pressure},
        policies={"collector": GATE} if gated else {}, maximum_seconds=None, bucket_ms=DAY)


CLOCK = ("clock", """
SELECT session_id, min(timestamp_ms) AS session_start_ms, max(timestamp_ms) AS session_end_ms,
  CAST(coalesce(floor(quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5)), {step}) AS BIGINT) AS sample_interval_ms
FROM (SELECT session_id, timestamp_ms,
        timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY session_id ORDER BY timestamp_ms) AS gap
      FROM sensor_events)
GROUP BY session_id""".format(step=STEP))

# windows found by comparing every sample with every window of its session
SESSION_WINDOWS = ("session_windows", """
SELECT session_id, CAST(i AS BIGINT) AS window_index, session_start_ms + i * {step} AS window_start_ms,
  session_start_ms + i * {step} + {window} AS window_end_ms
FROM clock, generate_series(0, 200) AS g(i)
WHERE session_start_ms + i * {step} + {window} <= session_end_ms + sample_interval_ms""".format(step=STEP, window=WINDOW))

WINDOW_ROWS = ("window_rows", """
SELECT e.*, w.window_index, w.window_start_ms, w.window_end_ms
FROM session_windows w JOIN sensor_events e ON e.session_id = w.session_id
 AND e.timestamp_ms >= w.window_start_ms AND e.timestamp_ms < w.window_end_ms""")

# one row per (window, sensor, timestamp): first reading wins, copies counted
SENSOR_ROWS = ("sensor_rows", """
SELECT session_id, window_index, window_start_ms, window_end_ms, sensor, timestamp_ms, domain,
  min_by(v, seq) AS value, count(*) AS raw
FROM (SELECT *, 'accelerometer' AS sensor, sqrt(ax*ax + ay*ay + az*az) AS v FROM window_rows WHERE ax IS NOT NULL
      UNION ALL SELECT *, 'pressure' AS sensor, p AS v FROM window_rows WHERE p IS NOT NULL)
GROUP BY ALL""")


def context_rows(*contexts: int) -> tuple[str, str]:
    listed = ", ".join(f"({c})" for c in contexts)
    return ("context_rows", f"""
SELECT s.*, CAST(c.context_ms AS BIGINT) AS context_ms FROM sensor_rows s, (VALUES {listed}) AS c(context_ms)
WHERE s.timestamp_ms >= s.window_end_ms - c.context_ms""")


GAPS = ("gaps", """
SELECT *, timestamp_ms - lag(timestamp_ms) OVER g AS gap,
  (value - lag(value) OVER g) / ((timestamp_ms - lag(timestamp_ms) OVER g) / 1000.0) AS jerk,
  avg(value) OVER (PARTITION BY session_id, window_index, context_ms, sensor) AS group_mean
FROM context_rows WINDOW g AS (PARTITION BY session_id, window_index, context_ms, sensor ORDER BY timestamp_ms)""")

WINDOW_VIEWS = (SENSOR_EVENTS, CLOCK, SESSION_WINDOWS, WINDOW_ROWS, SENSOR_ROWS, context_rows(WINDOW), GAPS)
CONTEXT_VIEWS = (*WINDOW_VIEWS[:5], context_rows(SHORT, WINDOW), GAPS)

GATE_GROUPS = ("gate_groups", f"""
SELECT session_id, window_index, context_ms, sensor, any_value(window_start_ms) AS window_start_ms,
  any_value(window_end_ms) AS window_end_ms, CAST(sum(raw) AS BIGINT) AS sample_count,
  greatest(min(timestamp_ms) - (any_value(window_end_ms) - context_ms), coalesce(max(gap), 0),
           any_value(window_end_ms) - max(timestamp_ms)) AS largest_gap_ms,
  any_value(domain) AS domain
FROM gaps GROUP BY session_id, window_index, context_ms, sensor""")

GATED = ("gated", f"""
SELECT *, CASE WHEN domain <> 'collector' THEN true ELSE
  sample_count >= CASE WHEN context_ms = {SHORT} AND sensor = 'accelerometer' THEN 2 WHEN context_ms = {SHORT} THEN 1
                       WHEN sensor = 'accelerometer' THEN 5 ELSE 3 END
  AND largest_gap_ms <= {int(2.5 * DAY)} END AS passes
FROM gate_groups""")

# --- predictions ------------------------------------------------------------------------------

def predictions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    label = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    wrong = (F.col("label") + 1 + key % 2) % 3
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    a, b, c = [(1 + cents % m).cast("double") for m in (97, 89, 83)]
    return (o.withColumn("label", label.cast("bigint")).select(
        F.col("c_nationkey").cast("string").alias("participant_id"),
        F.concat(F.lit("c"), F.col("o_custkey"), F.lit("-"), F.col("label")).alias("session_id"),
        F.concat_ws("#", F.col("c_nationkey"), F.col("o_custkey"), F.col("label")).alias("group_id"),
        case(F.col("label"), "bus", "car", "train").alias("vehicle_type"), "label",
        F.col("o_orderpriority").alias("phone_position"),
        millis("o_orderdate").alias("window_start_ms"), (millis("o_orderdate") + 60000).alias("window_end_ms"),
        F.when(key % 5 < 3, F.col("label")).otherwise(wrong).cast("bigint").alias("prediction"),
        (a / (a + b + c)).alias("probability_0"), (b / (a + b + c)).alias("probability_1"),
        (c / (a + b + c)).alias("probability_2"), (42 + key % 3).alias("seed"), key.alias("row_key")))


PREDICTIONS = ("predictions", """
SELECT *, a / (a + b + c) AS probability_0, b / (a + b + c) AS probability_1, c / (a + b + c) AS probability_2 FROM (
SELECT CAST(c_nationkey AS VARCHAR) AS participant_id, 'c' || o_custkey || '-' || label AS session_id,
  c_nationkey || '#' || o_custkey || '#' || label AS group_id,
  CASE label WHEN 0 THEN 'bus' WHEN 1 THEN 'car' ELSE 'train' END AS vehicle_type, label,
  o_orderpriority AS phone_position, epoch_ms(o_orderdate) AS window_start_ms,
  epoch_ms(o_orderdate) + 60000 AS window_end_ms,
  CAST(CASE WHEN o_orderkey % 5 < 3 THEN label ELSE (label + 1 + o_orderkey % 2) % 3 END AS BIGINT) AS prediction,
  CAST(1 + CAST(round(o_totalprice * 100) AS BIGINT) % 97 AS DOUBLE) AS a,
  CAST(1 + CAST(round(o_totalprice * 100) AS BIGINT) % 89 AS DOUBLE) AS b,
  CAST(1 + CAST(round(o_totalprice * 100) AS BIGINT) % 83 AS DOUBLE) AS c,
  42 + o_orderkey % 3 AS seed, o_orderkey AS row_key
FROM (SELECT *, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS BIGINT) AS label
      FROM orders JOIN customer ON o_custkey = c_custkey))""")

# --- study runs: every evaluation row is predicted by each run of the grid ----------------------

GRID = StudyGrid(seeds=(42, 43, 44), fractions=(0.25, 1.0))
GRID_ROWS = [("source_only", 0.0, s) for s in GRID.seeds] + [
    (c, f, s) for s in GRID.seeds for f in GRID.fractions for c in GRID.conditions]


def run_number(condition: str, fraction: float, seed: int) -> int:
    base = {"source_only": 0, "local_only": 1, "pooled": 2}[condition]
    return base + int(fraction * 4) + (seed - 42)


def study_predictions(spark: SparkSession, sf: str) -> DataFrame:
    runs = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(f).alias("fraction"), F.lit(s).alias("seed"),
                              F.lit(run_number(c, f, s)).alias("run_number")) for c, f, s in GRID_ROWS])
    p = predictions(spark, sf).drop("seed", "prediction")
    e = p.select("*", F.inline(runs))
    h = F.col("row_key") * 7 + F.col("run_number") * 3
    right = h % 11 < 4 + F.col("run_number")
    return e.withColumn("prediction", F.when(right, F.col("label")).otherwise((F.col("label") + 1 + h % 2) % 3)
                        .cast("bigint"))


STUDY = ("study_predictions", """
SELECT *, CAST(CASE WHEN (row_key * 7 + run_number * 3) % 11 < 4 + run_number THEN label
  ELSE (label + 1 + (row_key * 7 + run_number * 3) % 2) % 3 END AS BIGINT) AS prediction
FROM (SELECT * EXCLUDE (seed, prediction) FROM predictions), (VALUES {runs}) AS r(condition, fraction, seed, run_number)""".format(runs=", ".join(
    f"('{c}', CAST({f} AS DOUBLE), {s}, {run_number(c, f, s)})" for c, f, s in GRID_ROWS)))

# --- collector sessions (snapshot rows) ---------------------------------------------------------

def sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """One metadata record per order; numbers arrive as text, some fields are missing."""
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    person = F.format_string("participant_%03d", F.col("c_nationkey").cast("int"))
    start = millis("o_orderdate")
    length = (k % 9000) * 1000
    return o.select(
        F.format_string("session-%08d", k).alias("session_id"),
        F.when(k % 13 == 0, F.concat(F.lit("test_"), k % 10)).otherwise(person).alias("participant_id"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "AU").when(k % 4 == 2, "KR").otherwise("AU")
        .alias("collection_country_code"),
        F.when(k % 11 != 0, F.concat(F.lit("dev"), k % 5)).alias("device_uuid"),
        F.when(k % 6 == 0, "").otherwise(case(k % 3, "Bus", "car", "TRAIN")).alias("vehicle_type"),
        F.when(k % 5 != 0, case(k % 4, "pocket", "hand", "bag", "")).alias("phone_position"),
        F.concat(F.lit("raw/"), person, F.lit("/"), F.format_string("session-%08d", k), F.lit(".json.gz")).alias("s3_key"),
        F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.lit("#"),
                 F.format_string("%08d", k)).alias("sync_key"),
        F.when(k % 17 == 0, "pending").otherwise("received").alias("status"),
        F.when(k % 3 == 0, (start + 1000).cast("string")).alias("trimmed_start_ms"),
        F.when(k % 3 == 0, (start + 1000 + length).cast("string")).alias("trimmed_end_ms"),
        F.when(k % 7 != 0, start.cast("string")).alias("started_at_ms"),
        F.when(k % 7 != 1, (start + length + 500 - F.when(k % 19 == 0, 9000000).otherwise(0)).cast("string"))
        .alias("stopped_at_ms"),
        F.when(k % 10 == 0, "n/a").otherwise((k % 5000).cast("string")).alias("sample_count"),
        k.alias("row_key"))


SIDECARS = ("sidecars", """
SELECT printf('session-%08d', k) AS session_id,
  CASE WHEN k % 13 = 0 THEN 'test_' || (k % 10) ELSE person END AS participant_id,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 2 THEN 'KR' ELSE 'AU' END AS collection_country_code,
  CASE WHEN k % 11 <> 0 THEN 'dev' || (k % 5) END AS device_uuid,
  CASE WHEN k % 6 = 0 THEN '' WHEN k % 3 = 0 THEN 'Bus' WHEN k % 3 = 1 THEN 'car' ELSE 'TRAIN' END AS vehicle_type,
  CASE WHEN k % 5 <> 0 THEN CASE k % 4 WHEN 0 THEN 'pocket' WHEN 1 THEN 'hand' WHEN 2 THEN 'bag' ELSE '' END END AS phone_position,
  'raw/' || person || '/' || printf('session-%08d', k) || '.json.gz' AS s3_key,
  strftime(o_orderdate, '%Y-%m-%d') || '#' || printf('%08d', k) AS sync_key,
  CASE WHEN k % 17 = 0 THEN 'pending' ELSE 'received' END AS status,
  CASE WHEN k % 3 = 0 THEN CAST(start + 1000 AS VARCHAR) END AS trimmed_start_ms,
  CASE WHEN k % 3 = 0 THEN CAST(start + 1000 + length AS VARCHAR) END AS trimmed_end_ms,
  CASE WHEN k % 7 <> 0 THEN CAST(start AS VARCHAR) END AS started_at_ms,
  CASE WHEN k % 7 <> 1 THEN CAST(start + length + 500 - CASE WHEN k % 19 = 0 THEN 9000000 ELSE 0 END AS VARCHAR) END AS stopped_at_ms,
  CASE WHEN k % 10 = 0 THEN 'n/a' ELSE CAST(k % 5000 AS VARCHAR) END AS sample_count, k AS row_key
FROM (SELECT o_orderkey AS k, o_orderdate, epoch_ms(o_orderdate) AS start, (o_orderkey % 9000) * 1000 AS length,
        printf('participant_%03d', c_nationkey) AS person
      FROM orders JOIN customer ON o_custkey = c_custkey)""")

# --- intervals ----------------------------------------------------------------------------------

def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Window intervals from line items: a session per order, its label and participant from the key."""
    k = F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), k).alias("session_id"), (k % 3).cast("bigint").alias("label"),
        F.concat(F.lit("p"), k % 11).alias("participant_id"),
        F.when(k % 4 == 0, "source").otherwise("collector").alias("domain"),
        millis("l_shipdate").alias("window_start_ms"),
        (millis("l_shipdate") + F.col("l_quantity").cast("bigint") * DAY).alias("window_end_ms"))


INTERVALS = ("intervals", f"""
SELECT 'o' || l_orderkey AS session_id, CAST(l_orderkey % 3 AS BIGINT) AS label, 'p' || (l_orderkey % 11) AS participant_id,
  CASE WHEN l_orderkey % 4 = 0 THEN 'source' ELSE 'collector' END AS domain,
  epoch_ms(l_shipdate) AS window_start_ms, epoch_ms(l_shipdate) + CAST(l_quantity AS BIGINT) * {DAY} AS window_end_ms
FROM lineitem""")
