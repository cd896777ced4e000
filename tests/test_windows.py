import math

import numpy as np
import pytest

from strideframe.config import FeatureConfig, QualityPolicy
from strideframe.operators import features as feat, windows as win
from tests.helpers import events, values

STATS = ("mean", "standard_deviation", "range", "minimum")


def config(rates=None, gap=None, window=1000, step=1000, stats=STATS, contexts=(), domain="collector"):
    policies = {domain: QualityPolicy(rates_hz=rates, maximum_gap_ms=gap)} if rates or gap else {}
    return FeatureConfig(window, step, {"accelerometer": stats, "pressure": stats}, contexts, policies, maximum_seconds=None)


def starts(frame):
    return [r[0] for r in values(frame, "window_start_ms")]


def rate(hz):
    return {"accelerometer": hz, "pressure": hz}


@pytest.mark.parametrize("stamps, pressure, rates, gap, expected", [
    ([0], None, rate(4), 500, []),                                   # too few samples
    ([0, 500], [], None, None, []),                                  # a sensor is missing
    ([0, 100, 800, 900], None, rate(4), 500, []),                    # gap inside
    ([0, 500], None, rate(2), 500, [0]),                             # gap equal to the limit
    ([0, 900], None, rate(2), None, [0]),                            # no gap limit
    ([0, 500, 1600, 1900, 2000, 2500], None, rate(2), 500, [0, 2000]),  # gap at the left edge
    ([0, 500, 1000, 1400, 2000, 2500], None, rate(2), 500, [0, 2000]),  # gap at the right edge
    ([0, 250, 500, 750], [0, 750], {"accelerometer": 4, "pressure": 2}, 500, []),  # gap of one sensor
])
def test_sampling_gate(spark, stamps, pressure, rates, gap, expected):
    frame = feat.feature_frame(events(spark, stamps, pressure=pressure), config(rates, gap))
    assert starts(frame) == expected


def test_gate_applies_to_its_domain_only(spark):
    frame = feat.feature_frame(events(spark, [0], domain="source"), config(rate(4), 500))
    assert starts(frame) == [0]


def test_wrong_domain_raises(spark):
    with pytest.raises(Exception, match="expected domain source"):
        feat.feature_frame(events(spark, [0, 500]), config(), expected_domain="source").collect()


def test_magnitudes_of_four_samples(spark):
    vectors = [(1, 2, 2), (2, 3, 6), (4, 0, 3), (1, 2, 3)]
    base = events(spark, [0, 50, 100, 150])
    rows = [r.asDict() | dict(zip(("ax", "ay", "az"), map(float, v))) for r, v in zip(base.orderBy("seq").collect(), vectors)]
    found = feat.feature_frame(spark.createDataFrame(rows, base.schema), config(window=200, step=200)).first()
    norms = np.array([3, 7, 5, math.sqrt(14)])
    expected = (norms.mean(), norms.std(), 4.0, 3.0)
    assert [found[f"accelerometer#{s}"] for s in STATS] == pytest.approx(expected, rel=1e-6)


def test_spectrum_of_a_sine(spark):
    e = events(spark, list(range(0, 4001, 100)), values=lambda t: 1000 + math.sin(2 * math.pi * t / 1000))
    c = config(window=4000, step=4000, stats=feat.SPECTRAL, contexts=(2000, 4000))
    found = feat.feature_frame(e, c).collect()
    assert len(found) == 1
    for context in (2, 4):
        assert found[0][f"pressure#dominant_frequency_hz@{context}s"] == pytest.approx(1.0, abs=0.1)
        assert 0 <= found[0][f"pressure#spectral_entropy@{context}s"] <= 1


def test_windows_equal_the_plain_enumeration(spark):
    """Arithmetic assignment against a loop, for stamps at and around the edges."""
    rng = np.random.default_rng(3)
    stamps = sorted({int(t) for t in rng.integers(0, 9000, 60)} | {0, 999, 1000, 1999, 2000, 2500, 3000})
    e = events(spark, stamps)
    window, step = 2000, 700
    clock = win.session_clock(e, step, bucket_ms=500).first()
    gaps = np.diff(stamps)
    interval = int(np.median(gaps[gaps > 0]))
    assert clock["sample_interval_ms"] == interval
    expected, k = set(), 0
    while stamps[0] + k * step + window <= stamps[-1] + interval:
        low = stamps[0] + k * step
        expected |= {(k, t) for t in stamps if low <= t < low + window}
        k += 1
    placed = win.assign_windows(e, win.session_clock(e, step, bucket_ms=500), window, step)
    assert values(placed, "window_index", "timestamp_ms") == sorted(expected)


def test_copies_keep_the_first_reading(spark):
    a = events(spark, [0, 500])
    copy = a.withColumn("ax", a.ax + 100).withColumn("seq", a.seq + 10)
    samples = win.compact_samples(copy.unionByName(a), ["accelerometer"])
    assert values(samples, "timestamp_ms", "accelerometer_raw") == [(0, 2), (500, 2)]
    assert min(r[0] for r in values(samples, "accelerometer_value")) == pytest.approx(math.sqrt(14))


@pytest.mark.parametrize("maximum, kept", [(None, 1), (7200, 0)])
def test_duration_limit(spark, maximum, kept):
    long = events(spark, [0, 10_800_000])
    assert win.duration_filter(long, 0, maximum).select("session_id").distinct().count() == kept


def test_covered_seconds_merge_overlaps(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", int(a), int(a + n)) for s in range(4)
            for a, n in zip(rng.integers(0, 200_000, 40), rng.integers(0, 20_000, 40))]
    rows += [("touch", 0, 1000), ("touch", 1000, 2000)]
    found = dict(values(win.covered_duration(spark.createDataFrame(
        rows, "session_id string, window_start_ms bigint, window_end_ms bigint"), ["session_id"], bucket_ms=7000)))
    for s in {r[0] for r in rows}:
        covered, reach = 0, -1
        for _, a, b in sorted(r for r in rows if r[0] == s):
            covered += max(0, b - max(a, reach))
            reach = max(reach, b)
        assert found[s] == pytest.approx(covered / 1000)
    assert found["touch"] == 2.0


def test_fft_and_fourier_sum_agree(spark):
    rng = np.random.default_rng(1)
    e = events(spark, sorted({int(t) for t in rng.integers(0, 8000, 80)}), values=lambda t: math.cos(t / 300) + t % 7)
    c = config(window=4000, step=2000, stats=feat.SPECTRAL)
    rows = win.windowed_sensors(win.compact_samples(e, ["accelerometer", "pressure"]), win.session_clock(e, 2000), c)
    fft = feat.group_features(rows, c).select(*win.GROUP, *feat.SPECTRAL)
    explicit = feat.spectrum_sql(feat.resample_linear(rows, list(win.GROUP)), list(win.GROUP)).select(*win.GROUP, *feat.SPECTRAL)
    left = {r[:4]: r[4:] for r in values(fft)}
    right = {r[:4]: r[4:] for r in values(explicit)}
    assert right and set(right) <= set(left)
    for key, row in right.items():
        assert left[key] == pytest.approx(row, rel=1e-6, abs=1e-9)


def test_spectra_are_taken_of_kept_windows_alone(spark):
    e = events(spark, list(range(0, 8000, 100)))
    frame = feat.feature_frame(e, config(window=4000, step=2000, stats=("mean", *feat.SPECTRAL)))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("spectrum_fft") < plan.index("LeftSemi") and frame.count() > 0


def test_features_arrive_once_without_a_sequence_column(spark, tmp_path):
    from strideframe.plans.prepare import build_features
    first, second = events(spark, [0, 500, 1000]).drop("seq"), events(spark, [0, 500, 900], session="s2").drop("seq")
    c = config(stats=("mean", feat.BASELINED))
    target = str(tmp_path / "features")
    assert starts(build_features(first, c, target)) == [0]
    for _ in range(2):
        found = build_features(first.unionByName(second), c, target)
        assert values(found, "session_id", "window_start_ms") == [("s1", 0), ("s2", 0)]
    # pressure 1000, 1001 in the window against 1000 at the start
    assert found.where("session_id = 's1'").first()["pressure#delta_from_session_baseline"] == pytest.approx(0.5)


def test_own_aggregates_are_known_to_configurations(spark):
    from pyspark.sql import functions as F
    from strideframe.config import SPELLINGS, Spellings
    from strideframe.operators.features import REGISTRY, register
    with pytest.raises(ValueError, match="no aggregation is called"):
        SPELLINGS[Spellings.words("middle value")]
    register("middle_value")(lambda: F.median("value"))
    try:
        assert SPELLINGS[Spellings.words("Middle-Value")] == "middle_value"
    finally:
        REGISTRY.pop("middle_value"), SPELLINGS.pop(Spellings.words("middle_value"))
