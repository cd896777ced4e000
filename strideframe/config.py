"""Parameters of the operators, as plain dataclasses on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from collections.abc import Mapping, Sequence

# Sensor names and the event columns that hold their axes.
SENSOR_AXES: dict[str, tuple[str, ...]] = {
    "accelerometer": ("ax", "ay", "az"),
    "gyroscope": ("gx", "gy", "gz"),
    "magnetometer": ("mx", "my", "mz"),
    "pressure": ("p",),
}

# Feature names and the other spellings accepted for them.
AGGREGATIONS: dict[str, tuple[str, ...]] = {
    "minimum": ("min",),
    "maximum": ("max",),
    "mean": (),
    "range": (),
    "variance": ("var",),
    "standard_deviation": ("std",),
    "kurtosis": (),
    "interquartile_range": ("iqr",),
    "delta_from_window_start": (),
    "delta_from_session_baseline": (),
    "mean_absolute_deviation": (),
    "mean_absolute_jerk": (),
    "jerk_standard_deviation": (),
    "spectral_energy": (),
    "dominant_frequency_hz": ("dominant frequency",),
    "spectral_entropy": (),
    "mean_axis_correlation": (),
}

# Fixed value: longest session kept when no maximum is given, in seconds.
DEFAULT_MAXIMUM_SECONDS = 28_800



class Spellings(dict):
    """Names of aggregates by the words of every spelling they may be written in."""

    @staticmethod
    def words(text: str) -> tuple[str, ...]:
        return tuple(re.findall("[^\\s_-]+", text.lower()))

    def add(self, name: str, *others: str) -> None:
        for text in (name, *others):
            if self.setdefault(self.words(text), name) != name:
                raise ValueError(f"{text!r} already means {self[self.words(text)]!r}")

    def __missing__(self, words: tuple[str, ...]) -> str:
        raise ValueError(f"no aggregation is called {' '.join(words)!r}; there are {', '.join(sorted(set(self.values())))}")


#: Filled by the fixed names here, and by `operators.features.register` for any other aggregate.
SPELLINGS = Spellings()
for _name, _others in AGGREGATIONS.items():
    SPELLINGS.add(_name, *_others)


@dataclass(frozen=True)
class QualityPolicy:
    """Sampling demands on one domain: Hz per sensor and the longest silent gap.

    Without rates every sensor needs one sample; without a gap limit gaps are not looked at.
    `minimum_samples` names required counts per (context, sensor) directly.
    """

    rates_hz: Mapping[str, float] | None = None
    maximum_gap_ms: int | None = None
    minimum_samples: Mapping[tuple[int, str], int] | None = None

    def required(self, context_ms: int, sensor: str) -> int:
        if self.minimum_samples is not None:
            return self.minimum_samples[(context_ms, sensor)]
        if self.rates_hz is None:
            return 1
        return max(1, math.ceil(context_ms / 1000 * self.rates_hz[sensor]))


@dataclass(frozen=True)
class FeatureConfig:
    window_ms: int
    step_ms: int
    sensors: Mapping[str, Sequence[str]]
    contexts_ms: tuple[int, ...] = ()
    policies: Mapping[str, QualityPolicy] = field(default_factory=dict)
    minimum_seconds: float = 0.0
    maximum_seconds: float | None = DEFAULT_MAXIMUM_SECONDS
    bucket_ms: int = 3_600_000

    def __post_init__(self) -> None:
        if not self.contexts_ms:
            object.__setattr__(self, "contexts_ms", (self.window_ms,))
        if self.window_ms <= 0 or self.step_ms <= 0:
            raise ValueError("window and step must be positive")
        if any(not 0 < c <= self.window_ms for c in self.contexts_ms):
            raise ValueError("every context must fit in the window")
        unknown = sorted(set(self.sensors) - set(SENSOR_AXES))
        if unknown:
            raise ValueError(f"unknown sensors: {', '.join(unknown)}")
        object.__setattr__(
            self, "sensors",
            {s: tuple(SPELLINGS[Spellings.words(a)] for a in names) for s, names in self.sensors.items()},
        )

    def feature_columns(self) -> list[tuple[str, int, str, str]]:
        """(column, context, sensor, aggregation) in output order."""
        plain = self.contexts_ms == (self.window_ms,)
        return [
            (f"{s}#{a}" if plain else f"{s}#{a}@{c // 1000}s", c, s, a)
            for c in self.contexts_ms for s, names in self.sensors.items() for a in names
        ]

    def wants(self, *names: str) -> bool:
        return any(a in names for aggs in self.sensors.values() for a in aggs)


def calibration_fractions(value: float | Mapping[str, float], labels: Mapping[str, int]) -> dict[int, float]:
    """One share for all classes, or exactly one share per class name."""
    shares = dict(value) if isinstance(value, Mapping) else {name: value for name in labels}
    if set(shares) != set(labels):
        raise ValueError("calibration fractions must name exactly the configured classes")
    if any(not 0 < share < 1 for share in shares.values()):
        raise ValueError("calibration fractions must lie strictly between 0 and 1")
    return {labels[name]: float(share) for name, share in shares.items()}


@dataclass(frozen=True)
class StudyGrid:
    """Seeds x training conditions x calibration fractions; the baseline runs once per seed."""

    seeds: tuple[int, ...] = (42, 43, 44)
    fractions: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)
    baseline: str = "source_only"
    conditions: tuple[str, ...] = ("local_only", "pooled")
