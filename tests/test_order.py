"""Row order, medians and plans that don't grow with layers."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import timestats
from tidemark.operators.medians import medians
from tidemark.operators.rows import with_position, with_previous, with_row_id, with_running_sum

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(2)
    rows = [(i * 7 + rng.randrange(7), rng.choice(["a", "a", "a", "b", None]), rng.randrange(-5, 6) if rng.random() < 0.9 else None) for i in range(700)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "row_id long, k string, v long").repartition(5)


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("size", [3, 64, 1 << 20])
def test_chunks_agree_with_one_walk(series, by, size):
    rows, df = series
    last, total, place, want = {}, defaultdict(int), defaultdict(int), {}
    for i, k, v in sorted(rows):
        g = k if by else 0
        total[g] += v or 0
        want[i] = (last.get(g, (None, None)), total[g], place[g])
        place[g] += 1
        last[g] = (i, v)
    previous = {r["row_id"]: (r["prev_row_id"], r["prev_v"]) for r in with_previous(df, ["row_id", "v"], by, size=size).collect()}
    summed = {r["row_id"]: r["s"] for r in with_running_sum(df, F.col("v"), "s", by, size=size).collect()}
    placed = {r["row_id"]: (r["i"], r["n"]) for r in with_position(df, by, size=size).collect()}
    assert previous == {i: w[0] for i, w in want.items()} and summed == {i: w[1] for i, w in want.items()}
    count = {i: place[k if by else 0] for i, k, _ in rows}
    assert placed == {i: (w[2], count[i]) for i, w in want.items()}


def test_row_numbers(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 1, 1, 5, rng.randrange(1000)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "t long, i long").repartition(6)
    want = {r: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r)))}
    for parts in (1, 4, 50):
        assert {(r["t"], r["i"]): r["row_id"] for r in with_row_id(df, ["t", "i"], parts=parts).collect()} == want
    assert with_row_id(df.filter("false"), ["t", "i"]).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 40, 3])
def test_medians(spark, most):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, float(rng.randrange(50)), rng.gauss(0, 1e6)])) for k in ("a", "b", None) for _ in range(rng.randrange(1, 900))] + [("z", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for by in ([], ["k"]):
        want = defaultdict(list)
        for k, v in rows:
            if v is not None:
                want[k if by else 0].append(v)
        got = {r["k"] if by else 0: r["median"] for r in medians(df, "v", by, most=most).collect()}
        assert got == {k: statistics.median(v) for k, v in want.items()}


def test_median_without_values(spark):
    assert medians(spark.createDataFrame([], "k string, v double"), "v", ["k"]).count() == 0
    assert [r["median"] for r in medians(spark.createDataFrame([], "k string, v double"), "v").collect()] in ([], [None])


@pytest.mark.parametrize("name", ["time_stats_events", "time_stats_by_user", "compressed_axis", "anomaly_gutter", "pyramid_dataset", "viewport_by_user", "gaps_events", "outliers_mad", "state_bands_by_user"])
def test_plans_stay_small(spark, name):
    """Layers add up: no help from reuse is needed."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 8 and plan.count("Exchange") <= 16, plan


def test_a_single_row_and_no_rows(spark):
    one = spark.createDataFrame([(0, 5)], "row_id long, tick long")
    assert [tuple(r) for r in timestats.summarize(one).collect()] == [(1, 0, "uniform", 0, 0, None)]
    assert timestats.gaps(one).count() == 0 and timestats.segment_uniformity(one).count() == 1
