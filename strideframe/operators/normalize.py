"""Raw rows of the three source formats -> the common event table. Narrow transformations only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions import scalars as sc
from strideframe.schema import EVENT_COLUMNS, SENSOR_COLUMNS


def event_rows(df: DataFrame) -> DataFrame:
    """Event columns in order; rows without timestamp or label go."""
    keyed = df.withColumn("group_id", sc.composite_key(*[F.col(c) for c in ("participant_id", "device_id", "session_id")]))
    return keyed.select(
        *[F.col(c).cast("bigint").alias(c) if c in ("label", "timestamp_ms") else F.col(c) for c in EVENT_COLUMNS],
        *[c for c in keyed.columns if c not in EVENT_COLUMNS]).where(
            F.col("timestamp_ms").isNotNull() & F.col("label").isNotNull())


def bind(df: DataFrame) -> DataFrame:
    """The same rows with every column computed once.

    The optimizer copies an expression to each place that uses it; it doesn't look through a generator, so fields
    parsed here are read, not parsed again, by what follows.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def _extra(df: DataFrame, keep: tuple[str, ...]) -> list[Column]:
    return [F.col(c) for c in keep]


def normalize_path_logs(raw: DataFrame, labels: Mapping[str, int], domain: str = "source",
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Headerless logs: mode and participant come from `file_path`, unknown modes are dropped."""
    named = bind(raw.withColumn("_name", sc.path_name(F.col("file_path"))).withColumn(
        "_sensor_name", sc.path_sensor_name(F.col("sensor_type"))))
    part = sc.name_parts(F.col("_name"))
    rows = bind(named.select(
        F.lit(domain).alias("domain"), part["participant"].alias("participant_id"), part["stem"].alias("session_id"),
        part["mode"].alias("vehicle_type"), F.lit("unknown").alias("phone_position"),
        sc.digits_timestamp(F.col("time")).alias("timestamp_ms"), sc.lookup(F.col("_sensor_name"), sc.PATH_LOG_SENSORS).alias("_sensor"),
        *[sc.number(F.col(f"value_{i}")).alias(f"_v{i}") for i in range(3)], *_extra(raw, keep)))
    label = sc.lookup(F.col("vehicle_type"), labels)
    return _readings(rows.withColumn("device_id", F.col("participant_id")).withColumn("trip_id", F.col("session_id")).withColumn("label", label), keep)


def normalize_row_logs(raw: DataFrame, labels: Mapping[str, int], domain: str = "source",
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Logs with a header row: every row names its trip, mode, sensor, platform and device."""
    os = F.upper(F.col("OS"))
    named = bind(raw.where(F.col("installationId").isNotNull()).select(
        "*", F.lower(F.col("transportType")).alias("_mode"), sc.row_log_sensor(F.col("typeString")).alias("_sensor"),
        *[sc.number(F.col(f"value_{i}")).alias(f"_n{i}") for i in range(3)]))
    mode, sensor = F.col("_mode"), F.col("_sensor")
    unit = lambda i: sc.platform_units(F.col("OS"), sensor, F.col(f"_n{i}"))
    # pressure is scaled in its only value; the other two are unused there
    trip = sc.composite_key(F.col("journeyNumber"), F.col("tripNumber"))
    device = F.lower(F.concat_ws(":", F.coalesce(os, F.lit("")), F.coalesce("manufacturer", F.lit("unknown")),
                                 F.coalesce("model", F.lit("unknown"))))
    rows = bind(named.select(
        F.lit(domain).alias("domain"), F.col("installationId").cast("string").alias("participant_id"), device.alias("device_id"),
        sc.composite_key(F.col("installationId"), trip).alias("session_id"), trip.alias("trip_id"), mode.alias("vehicle_type"),
        sc.lookup(mode, labels).alias("label"), F.lower(F.col("deviceLocation")).alias("phone_position"),
        sc.iso_millis(F.col("timestamp")).alias("timestamp_ms"), sensor.alias("_sensor"),
        *[unit(i).alias(f"_v{i}") for i in range(3)], *_extra(raw, keep)))
    return _readings(rows, keep)


def _readings(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    s, v0, v1, v2 = [F.col(c) for c in ("_sensor", "_v0", "_v1", "_v2")]
    good = rows.where(s.isNotNull() & F.col("label").isNotNull() & F.col("timestamp_ms").isNotNull()
                      & sc.complete_reading(s, v0, v1, v2))
    return event_rows(good.select(
        "domain", "participant_id", "device_id", "session_id", "trip_id", "vehicle_type", "label", "phone_position",
        "timestamp_ms", *sc.sensor_columns(s, v0, v1, v2), *keep))


def in_trim(stamp: Column, low: Column, high: Column) -> Column:
    """Inclusive on both ends; only when both bounds are given."""
    return low.isNull() | high.isNull() | stamp.between(low, high)


def normalize_documents(documents: DataFrame, labels: Mapping[str, int], domain: str = "collector") -> DataFrame:
    """Session documents (with sidecar struct `side` and `file_path`) -> events.

    The document wins over the sidecar, except for the participant, where the sidecar wins. Documents
    without samples or with an unknown mode yield nothing; samples that never carry `ts` raise.
    """
    side = lambda c: F.col(f"side.{c}")
    mode = F.lower(sc.first_text(F.col("vehicle_type"), side("vehicle_type"), F.lit("")))
    bound = lambda c: F.coalesce(F.nullif(sc.text_or_null(F.col(c)), F.lit("0")), sc.text_or_null(side(c))).try_cast("bigint")
    stamped = F.exists("samples", lambda s: s["ts"].isNotNull())
    session = F.coalesce(sc.first_text(F.col("session_id"), side("session_id")), sc.path_parts(F.col("file_path"))["stem"])
    checked = F.when(stamped, session).otherwise(F.raise_error(F.concat(F.lit("samples without ts: "), "file_path")))
    docs = documents.where(F.size("samples") > 0).withColumn("vehicle_type", mode).where(
        F.col("vehicle_type").isin(*labels)).select(
        F.lit(domain).alias("domain"),
        F.coalesce(sc.first_text(side("participant_id"), F.col("participant_id")), F.lit("unknown_participant")).alias("participant_id"),
        F.coalesce(sc.first_text(F.col("device_uuid"), side("device_uuid"), side("device_id")), F.lit("unknown_device")).alias("device_id"),
        checked.alias("session_id"), checked.alias("trip_id"), "vehicle_type",
        sc.lookup(F.col("vehicle_type"), labels).alias("label"),
        F.coalesce(sc.first_text(F.col("phone_position"), side("phone_position")), F.lit("unknown")).alias("phone_position"),
        bound("trimmed_start_ms").alias("_low"), bound("trimmed_end_ms").alias("_high"), "samples")
    rows = docs.withColumn("s", F.explode("samples")).withColumn("timestamp_ms", sc.number(F.col("s.ts")).cast("bigint"))
    kept = rows.where(in_trim(F.col("timestamp_ms"), F.col("_low"), F.col("_high")))
    return event_rows(kept.select(
        "domain", "participant_id", "device_id", "session_id", "trip_id", "vehicle_type", "label", "phone_position",
        "timestamp_ms", *[sc.number(F.col(f"s.{c}")).alias(c) for c in SENSOR_COLUMNS]))


def label_lookup(rows: DataFrame, labels: DataFrame, column: str = "vehicle_type") -> DataFrame:
    """Attach labels from a (transport_mode, label) table of any size, one row per mode; rows of unknown modes go."""
    table = labels.where("label IS NOT NULL").select(F.col("transport_mode").alias("_mode"), "label")
    return rows.drop("label").join(table, F.col(f"`{column}`") == F.col("_mode")).drop("_mode")


def cohort_filter(sessions: DataFrame, country: str, quarantined: str, root: str = "raw") -> DataFrame:
    """Sessions of one country; a missing country is accepted except for the quarantined participant.

    The participant comes from the record, else from the path below `root`; a disagreement, or a
    country that is not two capitals, raises.
    """
    on_path = sc.text_or_null(F.regexp_extract("path", f"(?:^|/){root}/([^/]+)/", 1))
    stated = sc.text_or_null(F.col("participant_id"))
    nation = F.col("collection_country_code")
    keep = F.when(on_path.isNotNull() & (stated != on_path), F.raise_error(F.concat(F.lit("participant mismatch in "), "path"))) \
        .when(nation.isNotNull() & ~nation.rlike("^[A-Z]{2}$"), F.raise_error(F.concat(F.lit("bad country in "), "path"))) \
        .when(nation.isNull(), ~F.coalesce(stated, on_path).eqNullSafe(F.lit(quarantined))).otherwise(nation == country)
    return sessions.where(keep.cast("boolean"))


def eligible(participant: Column, key: Column, root: str = "raw") -> Column:
    """Upload belongs to a registered participant and lies below that participant's folder."""
    parts = F.filter(F.split(key, "/"), lambda p: ~p.isin("", "."))
    good = (participant.rlike("^participant_[0-9]{3}$") & (F.size(parts) >= 3) & ~key.startswith("/")
            & F.try_element_at(parts, F.lit(1)).eqNullSafe(F.lit(root))
            & F.try_element_at(parts, F.lit(2)).eqNullSafe(participant))
    return F.coalesce(good, F.lit(False))


def unsafe_key(key: Column) -> Column:
    """Absolute keys and keys that climb out of the target folder."""
    return key.startswith("/") | F.array_contains(F.split(key, "/"), "..")


SNAPSHOT_TEXT = ("session_id", "participant_id", "collection_country_code", "device_uuid", "vehicle_type",
                 "phone_position", "s3_key", "sync_key")
SNAPSHOT_NUMBERS = ("trimmed_start_ms", "trimmed_end_ms", "started_at_ms", "stopped_at_ms", "uploaded_at_ms", "sample_count")


def recorded_duration(df: DataFrame, explicit: str | None = None) -> Column:
    c = F.col
    return sc.duration_seconds(c(explicit) if explicit else None, (c("trimmed_start_ms"), c("trimmed_end_ms")),
                               (c("started_at_ms"), c("stopped_at_ms")))


def snapshot_projection(records: DataFrame) -> DataFrame:
    """Selected fields with types; empty text and unreadable numbers become NULL."""
    columns = [sc.text_or_null(F.col(c)).alias(c) for c in SNAPSHOT_TEXT if c in records.columns]
    columns += [F.col(c).try_cast("bigint").alias(c) for c in SNAPSHOT_NUMBERS if c in records.columns]
    return records.select(*columns, recorded_duration(records).alias("duration_seconds"))


def snapshot_facts(records: DataFrame) -> DataFrame:
    """Mode, participant, duration and samples of a snapshot, with `unknown` for what is missing."""
    return records.select(
        F.lower(F.trim(F.coalesce(sc.text_or_null(F.col("vehicle_type")), F.lit("unknown")))).alias("mode"),
        F.coalesce(sc.text_or_null(F.col("participant_id")), F.lit("unknown")).alias("participant"),
        recorded_duration(records).alias("duration_seconds"), F.col("sample_count").try_cast("bigint").alias("sample_count"))


def event_layout(events: DataFrame) -> DataFrame:
    """Events ordered by session and time; range partitions split long sessions over tasks."""
    return events.repartitionByRange("session_id", "timestamp_ms").sortWithinPartitions("session_id", "timestamp_ms")
