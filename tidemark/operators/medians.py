"""Exact medians of series of any size, in bounded memory.

Values are counted first, by series and distinct value, which the cluster shares out however hot a
series is. Up to ``MOST`` distinct values of a series are then ranked in one window. Beyond that,
quantiles cut the values into ranges, counts by range tell in which range a series' middle
values lie, and only that range is kept; again, until it is small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .rows import cut_at, join_series, quantiles

#: Ranges a pass, and distinct values of a series that one window may hold.
PARTS, MOST = 128, 1 << 20


def _ranked(counts: DataFrame, key: list[str], place: str) -> DataFrame:
    """Counts with __through, the values up to this row of the key, and with __rank, the middle place or the two."""
    whole = Window.partitionBy(*key)
    ranks = F.array_distinct(F.array(F.expr("(__whole - 1) div 2"), F.expr("__whole div 2")))
    summed = counts.withColumn("__whole", F.sum("n").over(whole)).withColumn("__through", F.sum("n").over(whole.orderBy(place)))
    return summed.withColumn("__rank", F.explode(ranks))


def _within(ranked: DataFrame) -> DataFrame:
    """The rows in which the rank lies, with the rank counted from the row's first."""
    found = ranked.filter((F.col("__rank") < F.col("__through")) & (F.col("__rank") >= F.col("__through") - F.col("n")))
    return found.withColumn("__rank", F.col("__rank") - (F.col("__through") - F.col("n")))


def medians(df: DataFrame, value: Column | str, by: list[str] | None = None, name: str = "median", most: int = MOST) -> DataFrame:
    """by, ``name``: the exact median of the series' values (the mean of the two middle ones of an even count; null without values). Stored."""
    by = by or []
    series = [f"__by{i}" for i in range(len(by))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, series, strict=True)], v.alias("__value")).filter("__value is not null")
    left, key, cut = settle(rows.groupBy(*series, "__value").agg(F.count(F.lit(1)).alias("n")), "median-values"), series, False
    while (left.groupBy(*key).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d")).first()[0] or 0) > most:
        place = cut_at(F.col("__value"), quantiles(left, F.col("__value"), PARTS)).alias("__place")
        if cut:
            line = Window.partitionBy(*key).orderBy("__place")
            ranked = left.groupBy(*key, "__rank", place).agg(F.sum("n").alias("n")).withColumn("__through", F.sum("n").over(line))
        else:
            ranked = _ranked(left.groupBy(*key, place).agg(F.sum("n").alias("n")), key, "__place").withColumn("__which", F.col("__rank"))
        key = [*series, "__which"]
        targets = settle(_within(ranked).select(*key, "__place", "__rank"), "median-ranges")
        placed = left.drop("__rank").withColumn("__place", place)
        left, cut = settle(join_series(placed, targets, [k for k in [*key, "__place"] if k in placed.columns]).select(*key, "__rank", "__value", "n"), "median-values"), True
    if cut:
        ranked = left.withColumn("__through", F.sum("n").over(Window.partitionBy(*key).orderBy("__value")))
    else:
        ranked = _ranked(left, key, "__value")
    out = _within(ranked).groupBy(*series).agg(F.avg("__value").alias(name))
    return settle(out.select(*[F.col(k).alias(b) for b, k in zip(by, series, strict=True)], name), "medians")


def with_median(df: DataFrame, by: list[str] | None = None, column: str = "dt", name: str = "median_dt") -> DataFrame:
    """Adds the exact median of ``column`` over the whole series. ``df`` should be a stored table, as it is read twice."""
    return join_series(df, medians(df, column, by, name), by or [], "left")
