"""Normalization of raw fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strideframe.config import SENSOR_AXES
from strideframe.schema import SENSOR_COLUMNS

# Sensor names as they appear in the logs.
PATH_LOG_SENSORS = {
    "accelerometer": "accelerometer",
    "gyroscope": "gyroscope",
    "magnetic_field": "magnetometer",
    "magnetometer": "magnetometer",
    "pressure": "pressure",
}
ROW_LOG_SENSORS = {
    "android.sensor.accelerometer": "accelerometer",
    "cmaccelerometerdata": "accelerometer",
    "android.sensor.gyroscope": "gyroscope",
    "cmgyrodata": "gyroscope",
    "android.sensor.magnetic_field": "magnetometer",
    "cmmagnetometerdata": "magnetometer",
}
# Unit factors of the iOS platform.
STANDARD_GRAVITY = 9.80665
KILOPASCAL_TO_HECTOPASCAL = 10.0


def lookup(key: Column, table: dict) -> Column:
    """CASE over a small fixed table; NULL where nothing matches."""
    case = F
    for source, target in table.items():
        case = case.when(key == source, F.lit(target))
    return case.otherwise(F.lit(None))


def path_sensor_name(name: Column) -> Column:
    """Last part of a sensor's dotted name, cleaned."""
    cleaned = F.lower(F.regexp_replace(name, "[^a-zA-Z0-9._-]", ""))
    return F.element_at(F.split(cleaned, "\\."), -1)


def path_log_sensor(name: Column) -> Column:
    return lookup(path_sensor_name(name), PATH_LOG_SENSORS)


def row_log_sensor(name: Column) -> Column:
    text = F.lower(F.trim(name))
    return F.when(text.contains("pressure") | text.contains("altimeter"), F.lit("pressure")).otherwise(
        lookup(text, ROW_LOG_SENSORS))


def digits_timestamp(text: Column) -> Column:
    return F.regexp_extract(text, "\\d+", 0).try_cast("bigint")


def iso_millis(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def number(text: Column) -> Column:
    """Double or NULL; NaN becomes NULL, and Java-only spellings (`1d`, `0x1p3`) are no numbers."""
    java_only = text.cast("string").rlike("(?i)[0-9.][df]\\s*$|0x")
    value = F.when(java_only, F.lit(None)).otherwise(text.try_cast("double"))
    return no_nan(value)


def no_nan(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def text_or_null(value: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(value, F.lit(""))


def first_text(*values: Column) -> Column:
    return F.coalesce(*[text_or_null(v) for v in values])


def platform_units(os: Column, sensor: Column, value: Column) -> Column:
    ios = F.upper(os) == "IOS"
    return (F.when(ios & (sensor == "accelerometer"), value * F.lit(STANDARD_GRAVITY))
            .when(ios & (sensor == "pressure"), value * F.lit(KILOPASCAL_TO_HECTOPASCAL))
            .otherwise(value))


def sensor_columns(sensor: Column, v0: Column, v1: Column, v2: Column) -> list[Column]:
    """One row per sensor reading -> ten sensor columns, without a shuffle."""
    source = {}
    for name, axes in SENSOR_AXES.items():
        for axis, value in zip(axes, (v0, v1, v2)):
            source[axis] = F.when(sensor == name, value)
    return [source[c].cast("double").alias(c) for c in SENSOR_COLUMNS]


def complete_reading(sensor: Column, v0: Column, v1: Column, v2: Column) -> Column:
    """Pressure needs one value, a vector sensor three."""
    return v0.isNotNull() & ((sensor == "pressure") | (v1.isNotNull() & v2.isNotNull()))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("#", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def magnitude(*axes: Column) -> Column:
    """Vector length (the value itself for one axis) of finite readings, else NULL."""
    ok = finite(axes[0])
    for a in axes[1:]:
        ok = ok & finite(a)
    if len(axes) == 1:
        return F.when(ok, axes[0])
    total = axes[0] * axes[0]
    for a in axes[1:]:
        total = total + a * a
    return F.when(ok, F.sqrt(total))


def present(*axes: Column) -> Column:
    """All axes given; infinities count, as the sampling gate demands."""
    ok = axes[0].isNotNull() & ~F.isnan(axes[0])
    for a in axes[1:]:
        ok = ok & a.isNotNull() & ~F.isnan(a)
    return ok


def span_seconds(start: Column, end: Column) -> Column:
    start, end = start.try_cast("bigint"), end.try_cast("bigint")
    return F.when(end >= start, (end - start) / F.lit(1000.0))


def duration_seconds(explicit: Column | None, trimmed: tuple[Column, Column],
                     recorded: tuple[Column, Column]) -> Column:
    """Stated duration, else trimmed bounds, else start and stop."""
    options = [span_seconds(*trimmed), span_seconds(*recorded)]
    if explicit is not None:
        options.insert(0, number(explicit))
    return F.coalesce(*options)


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS with unbounded hours; halves round to even."""
    s = F.bround(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60),
                           F.pmod(s, F.lit(60)))


def path_parts(path: Column) -> dict[str, Column]:
    """Name, stem, participant (2nd token) and mode (3rd token) of a log path.

    A log may be one file, or a folder of part files carrying the log's name.
    """
    return name_parts(path_name(path))


def path_name(path: Column) -> Column:
    decoded = F.regexp_replace(path, "/part-[^/]*$", "")
    return F.regexp_replace(F.element_at(F.split(decoded, "/"), -1), "^[A-Za-z_]+=", "")


def name_parts(name: Column) -> dict[str, Column]:
    """The fields of a log's name."""
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    tokens = F.split(name, "_")
    return {
        "name": name,
        "stem": stem,
        "participant": F.coalesce(F.try_element_at(tokens, F.lit(2)), stem),
        "mode": F.coalesce(F.lower(F.try_element_at(tokens, F.lit(3))), F.lit("")),
    }


def class_name(value: Column, labels: dict[str, int]) -> Column:
    return lookup(value, {number_: name for name, number_ in labels.items()})
