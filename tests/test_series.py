"""Operators on time series against brute force in Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly, pyramid, timestats, viewport, welch
from tidemark.operators.rows import with_previous, with_row_id, with_running_sum


def frame(spark, rows, schema="row_id long, tick long, value double"):
    return spark.createDataFrame(rows, schema)


def bucket(values, ticks):
    kept = [v for v in values if not math.isnan(v)]
    return (min(kept, default=math.inf), max(kept, default=-math.inf), ticks[0], ticks[-1], len(values) - len(kept))


@pytest.fixture(scope="module")
def noisy():
    r = random.Random(3)
    return [(i, 10 * i, math.nan if r.random() < 0.2 else r.choice([math.inf, r.uniform(-5, 5), r.uniform(-5, 5)])) for i in range(700)]


def test_rows_across_chunks(spark):
    rows = [(i, i * i, i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, x long, k long")
    got = {r["row_id"]: r["prev_x"] for r in with_previous(df, ["x"], ["k"], size=8).collect()}
    assert got == {i: (i - 3) ** 2 if i >= 3 else None for i in range(100)}
    sums = {r["row_id"]: r["s"] for r in with_running_sum(df, F.col("x"), "s", size=8).collect()}
    assert sums == {i: sum(j * j for j in range(i + 1)) for i in range(100)}


def test_row_ids_are_dense_and_ordered(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = with_row_id(spark.createDataFrame([(v,) for v in values], "v long").repartition(7), ["v"])
    assert {r["v"]: r["row_id"] for r in df.collect()} == {v: i for i, v in enumerate(sorted(values))}


@pytest.mark.parametrize("k", [0, 1, 7, 64, 699, 700, 5000])
def test_viewport_is_a_count_split(spark, noisy, k):
    got = sorted(tuple(r) for r in viewport.viewport(frame(spark, noisy), 100, 6000, k).collect())
    inside = [r for r in noisy if 100 <= r[1] <= 6000]
    n, want = len(inside), []
    for c in range(min(k, n) if k else 0):
        part = inside[c : c + 1] if n <= k else inside[c * n // k : (c + 1) * n // k]
        want.append((c, *bucket([p[2] for p in part], [p[1] for p in part])) if n > k else (c, part[0][2], part[0][2], part[0][1], part[0][1], int(math.isnan(part[0][2]))))
    assert str(got) == str(want)


def test_pyramid_levels_and_extension(spark, noisy):
    df = frame(spark, noisy)
    whole = sorted(tuple(r) for r in pyramid.build(df, "value").collect())
    want, n, k = [], -(-len(noisy) // 8), 0
    while True:
        size = 8 ** (k + 1)
        want += [(k, b, *bucket([r[2] for r in noisy[b * size : (b + 1) * size]], [r[1] for r in noisy[b * size : (b + 1) * size]])) for b in range(-(-len(noisy) // size))]
        if n < 8:
            break
        n, k = -(-n // 8), k + 1
    assert str(whole) == str(sorted(want))
    for cut in (3, 8, 100, 513):
        first = pyramid.build(df.filter(F.col("row_id") < cut), "value", rows=cut)
        both = pyramid.extend(first, df.filter(F.col("row_id") >= cut), "value", cut)
        assert str(sorted(tuple(r) for r in both.collect())) == str(whole)


@pytest.mark.parametrize(("first", "n", "k"), [(0, 700, 5), (13, 600, 3), (5, 80, 40), (0, 700, 1)])
def test_viewport_from_pyramid_is_exact(spark, noisy, first, n, k):
    df = frame(spark, noisy)
    fast = viewport.viewport_from_pyramid(df, pyramid.build(df, "value"), first, n, k)
    slow = viewport.viewport(df, 10 * first, 10 * (first + n - 1), k)
    assert str(sorted(tuple(r) for r in fast.collect())) == str(sorted(tuple(r) for r in slow.collect()))


def test_gaps_segments_and_classes(spark):
    ticks = [i * 1000 for i in range(10)] + [59_000 + i * 1000 for i in range(10)] + [88_000 + i * 1000 for i in range(10)]
    df = frame(spark, [(i, t, 0.0) for i, t in enumerate(ticks)])
    assert sorted(tuple(r) for r in timestats.gaps(df).collect()) == [(9, 10, 50_000), (19, 20, 20_000)]
    row = timestats.summarize(df).first()
    assert (row["gap_count"], row["sampling_class"]) == (2, "segmented_uniform")
    assert tuple(timestats.largest_uniform_range(df).first()) == (0, 9, 10)
    assert timestats.gap_share(df).first()["offer_compression"]


@pytest.mark.parametrize(("ticks", "label"), [([], "irregular"), ([5], "uniform"), ([1, 1, 1], "uniform"), ([0, 2, 3, 4, 16, 40], "irregular"), ([0, 1000, 2001, 3000, 4002], "uniform")])
def test_small_axes(spark, ticks, label):
    row = timestats.summarize(frame(spark, [(i, t, 0.0) for i, t in enumerate(ticks)])).first()
    assert row["n"] == len(ticks)
    assert not ticks or row["sampling_class"] == label


def test_monotonicity_counts(spark):
    df = frame(spark, [(i, t, 0.0) for i, t in enumerate([0, 1, 2, 1, 3, 4, 4, 5])])
    assert tuple(timestats.monotonicity(df).first()) == (1, 1)


def test_exact_kth(spark):
    values = random.Random(2).choices(range(-(10**12), 10**12), k=301)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [timestats.exact_kth(df, "v", k) for k in (0, 150, 300)] == [sorted(values)[k] for k in (0, 150, 300)]
    assert timestats.exact_kth(df, "v", 301) is None


def test_anomalies(spark):
    nan = math.nan
    df = frame(spark, [(i, i, v) for i, v in enumerate([1.0, nan, nan, 1.1, 1e12, 1.2, nan, 1.3])])
    assert sorted(tuple(r) for r in anomaly.nan_runs(df, "value").collect()) == [(1, 3), (6, 7)]
    assert [r["row_id"] for r in anomaly.outliers(df, "value").collect()] == [4]
    kinds = sorted(r["kind"] for r in anomaly.gutter(df, "value").collect())
    assert kinds == ["missing", "missing", "outlier"]
    flat = frame(spark, [(i, i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0])])
    assert [r["row_id"] for r in anomaly.outliers(flat, "value").collect()] == [3]


def test_state_bands_and_columns(spark):
    df = spark.createDataFrame([(i, i, s) for i, s in enumerate("aabbbac")], "row_id long, tick long, s string")
    assert sorted(tuple(r)[1:3] + (r["state"],) for r in anomaly.bands(df, "s").collect()) == [(0, 1, "a"), (2, 4, "b"), (5, 5, "a"), (6, 6, "c")]
    got = sorted((r["column"], r["state"], r["multiple"]) for r in viewport.state_columns(df, 0, 6, 3, "s").collect())
    assert got == [(0, "a", False), (1, "b", False), (2, None, True)]


class TestWelch:
    def spectrum(self, spark, x, **k):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, value double")
        return {r["bin"]: r["power"] for r in welch.welch(df, 1000.0, **k).collect()}

    def test_tone_has_its_power(self, spark):
        n = 1024
        got = self.spectrum(spark, 2 * np.sin(2 * np.pi * 64 / n * np.arange(4 * n)), length=n, window="rectangular")
        assert max(got, key=got.get) == 64
        assert sum(got.values()) * 1000 / n == pytest.approx(2.0, rel=1e-6)

    def test_constant_and_nyquist(self, spark):
        x = 3 + np.where(np.arange(2048) % 2, -1.0, 1.0)
        got = self.spectrum(spark, x, length=1024, window="rectangular", detrending="none")
        assert got[0] * 1000 / 1024 == pytest.approx(9.0, rel=1e-9)
        assert got[512] * 1000 / 1024 == pytest.approx(1.0, rel=1e-9)

    def test_noise_level(self, spark):
        x = np.random.default_rng(5).uniform(-1, 1, 65_536)
        got = self.spectrum(spark, x, length=1024)
        assert sum(got.values()) * 1000 / 1024 == pytest.approx(x.var(), rel=0.05)

    def test_no_window_crosses_a_gap(self, spark):
        n = 1024
        parts = [np.sin(2 * np.pi * 50 / n * np.arange(n)) + off for off in (500, -500, 500)]
        rows = [(i + s * n, s, float(v)) for s, p in enumerate(parts) for i, v in enumerate(p)] + [(3 * n, 3, 1.0)]
        df = spark.createDataFrame(rows, "row_id long, segment long, value double")
        spectrum, excluded = welch.welch_segmented(df, 1000.0, n)
        got = {r["bin"]: r["power"] for r in spectrum.collect()}
        assert max(got, key=got.get) == 50
        assert max(v for b, v in got.items() if abs(b - 50) > 3) < 1e-9
        assert [tuple(r) for r in excluded.collect()] == [(3, 1)]

    def test_lengths_and_missing(self, spark):
        assert [welch.default_segment_length(n) for n in (0, 2048, 8192, 10**7)] == [256, 256, 1024, 65_536]
        x = np.ones(600)
        x[10] = np.nan
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, value double")
        assert welch.welch(df, 1.0, 256).first()["segment_count"] == 2
        assert welch.welch(df.limit(5), 1.0, 256).count() == 0

    def test_irregular_axis_is_refused(self, spark):
        df = frame(spark, [(i, t, 0.0) for i, t in enumerate([0, 2, 3, 4, 16, 40])])
        with pytest.raises(welch.Refused):
            welch.spectrum_of(df, 1)


def test_constant_compares_bits(spark):
    df = spark.createDataFrame([(math.nan, 0.0, "x"), (math.nan, -0.0, "x")], "a double, b double, c string")
    assert {r["series"]: r["constant"] for r in anomaly.is_constant(df, ["a", "b", "c"]).collect()} == {"a": True, "b": False, "c": True}


def test_cursor_reads_exact_values(spark):
    rows = [(i, 1_770_000_000_000_000_000 + i * 10**9, 7200, 2**53 + 1 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, tick long, offset_seconds int, v long")
    got = viewport.cursor(df, 1_770_000_000_000_000_000 + 2 * 10**9 + 400, ["v"], "iso8601", "ns").first()
    assert tuple(got) == (2, "2026-02-02T04:40:02+02:00", "9007199254740995")
    assert viewport.point(df, 4, ["v"]).first()["v"] == "9007199254740997"
