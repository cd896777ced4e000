"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TEXT = ("domain", "participant_id", "device_id", "session_id", "trip_id", "group_id", "vehicle_type")
SENSOR_COLUMNS = ("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz", "p")
METADATA = (*EVENT_TEXT, "label", "phone_position")

EVENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in EVENT_TEXT]
    + [T.StructField("label", T.LongType()), T.StructField("phone_position", T.StringType()),
       T.StructField("timestamp_ms", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in SENSOR_COLUMNS]
)
EVENT_COLUMNS = tuple(EVENT.fieldNames())

RAGGED_LOG = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("time", "sensor_type", "value_0", "value_1", "value_2")]
)

# Header names of the row-oriented trip log.
ROW_LOG_COLUMNS = (
    "installationId", "journeyNumber", "tripNumber", "manufacturer", "model", "timestamp",
    "transportType", "typeString", "deviceLocation", "value_0", "value_1", "value_2", "OS",
)

SAMPLE = T.StructType(
    [T.StructField("ts", T.StringType())] + [T.StructField(c, T.StringType()) for c in SENSOR_COLUMNS]
)
_DOCUMENT_TEXT = ("session_id", "participant_id", "device_uuid", "vehicle_type", "phone_position",
                  "trimmed_start_ms", "trimmed_end_ms")
SESSION_DOCUMENT = T.StructType(
    [T.StructField(c, T.StringType()) for c in _DOCUMENT_TEXT]
    + [T.StructField("samples", T.ArrayType(SAMPLE))]
)
SIDECAR_COLUMNS = (
    "session_id", "participant_id", "collection_country_code", "device_uuid", "device_id", "vehicle_type",
    "phone_position", "s3_key", "sync_key", "status", "trimmed_start_ms", "trimmed_end_ms",
    "started_at_ms", "stopped_at_ms", "uploaded_at_ms", "sample_count",
)
SIDECAR = T.StructType([T.StructField(c, T.StringType()) for c in SIDECAR_COLUMNS])

SNAPSHOT_SESSION = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("participant_id", T.StringType()),
    T.StructField("vehicle_type", T.StringType()), T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("sample_count", T.LongType()),
])
SNAPSHOT = T.StructType([
    T.StructField("schema_version", T.IntegerType()), T.StructField("run_id", T.StringType()),
    T.StructField("session_count", T.LongType()), T.StructField("session_id_digest", T.StringType()),
    T.StructField("sessions", T.ArrayType(SNAPSHOT_SESSION)),
])
IDENTITY = ("participant_id", "session_id", "window_start_ms", "window_end_ms", "label")
