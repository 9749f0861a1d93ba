"""The min/max pyramid: buckets of eight rows, of eight buckets, and so on.

Buckets are by row position (``row_id`` counts rows of a series from 0), so a level is one
group-by with map-side combining, and the next one reads only the level below. NaN and NULL
are left out of min and max and counted; infinities count as values; a bucket without
values has min = +Infinity and max = -Infinity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle

FACTOR = 8
#: Levels of so many buckets and more are stored before the next one is built, as level 0 always is.
STORED = 1 << 16
BUCKET = ["min", "max", "first_ts", "last_ts", "nan_count"]


def is_missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def raw_aggregates(value: str, tick: str, order: str) -> list[Column]:
    """The five bucket columns over rows."""
    v = F.col(value).cast("double")
    kept = F.when(~is_missing(v), v)
    inf = float("inf")
    return [
        F.coalesce(F.min(kept), F.lit(inf)).alias("min"),
        F.coalesce(F.max(kept), F.lit(-inf)).alias("max"),
        F.min_by(tick, order).alias("first_ts"),
        F.max_by(tick, order).alias("last_ts"),
        F.count_if(is_missing(v)).alias("nan_count"),
    ]


def merge_aggregates(order: str = "bucket_id") -> list[Column]:
    """The five bucket columns over buckets."""
    return [F.min("min").alias("min"), F.max("max").alias("max"), F.min_by("first_ts", order).alias("first_ts"), F.max_by("last_ts", order).alias("last_ts"), F.sum("nan_count").alias("nan_count")]


def level_zero(df: DataFrame, value: str, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    by = by or []
    bucket = F.floor(F.col(order) / FACTOR).cast("bigint").alias("bucket_id")
    return df.groupBy(*by, bucket).agg(*raw_aggregates(value, tick, order))


def next_level(level: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    up = F.floor(F.col("bucket_id") / FACTOR).cast("bigint").alias("up")
    return level.groupBy(*by, up).agg(*merge_aggregates()).withColumnRenamed("up", "bucket_id")


def build(df: DataFrame, value: str, by: list[str] | None = None, tick: str = "tick", order: str = "row_id", rows: int | None = None, keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(by, level, bucket_id, min, max, first_ts, last_ts, nan_count) of all levels.

    A level is added while the last one has eight buckets or more (in the longest series).
    ``rows``: rows of the longest series, counted if not given. ``keep(level, k)`` may store
    a level (e.g. as Parquet) and return it read back, so the next one reads that.
    """
    by = by or []
    if rows is None:
        last = df.agg(F.max(order)).first()[0]
        rows = 0 if last is None else last + 1
    return _levels(level_zero(df, value, by, tick, order), by, rows, keep)


def _levels(level: DataFrame, by: list[str], rows: int, keep: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Level 0 and all above it."""
    n, out, k = -(-rows // FACTOR), None, 0
    while True:
        if keep:
            level = keep(level, k)
        elif k == 0 or n >= STORED:
            level = settle(level, "pyramid-level")
        own = level.select(*by, F.lit(k).alias("level"), "bucket_id", *BUCKET)
        out = own if out is None else out.unionByName(own)
        if n < FACTOR:
            return out if not by else trimmed(out, by)
        level, n, k = next_level(level, by), -(-n // FACTOR), k + 1


def trimmed(pyramid: DataFrame, by: list[str]) -> DataFrame:
    """Drops, for series shorter than the longest, the levels above their last one.

    A series with n rows has levels up to the first with fewer than eight buckets.
    """
    counts = pyramid.filter("level = 0").groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg((F.max("bucket_id") + 1).alias("__n"))
    top = F.when(F.col("__n") < FACTOR, F.lit(0))
    least = FACTOR
    for k in range(1, 21):  # 8^21 buckets exceed BIGINT rows
        top = top.when(F.ceil(F.col("__n") / least) < FACTOR, F.lit(k))
        least *= FACTOR
    on = None
    for k in by:
        test = pyramid[k].eqNullSafe(F.col(f"__{k}"))
        on = test if on is None else on & test
    return pyramid.join(counts.withColumn("__top", top), on).filter(F.col("level") <= F.col("__top")).select(*pyramid.columns)


def of_dataset(df: DataFrame, columns: list[str], tick: str = "tick", order: str = "row_id") -> DataFrame:
    """One pyramid a numeric column (others have none): (series, level, bucket_id, ...)."""
    numeric = [f.name for f in df.schema.fields if f.name in columns and f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    if not numeric:
        raise ValueError("no numeric column")
    last = df.agg(F.max(order)).first()[0]
    bucket = F.floor(F.col(order) / FACTOR).cast("bigint").alias("bucket_id")
    # level 0 of all columns in one aggregate, then a row a column
    each = [F.struct(F.lit(c).alias("series"), *raw_aggregates(c, tick, order)).alias(f"__{i}") for i, c in enumerate(numeric)]
    wide = df.groupBy(bucket).agg(*each)
    level = wide.select("bucket_id", F.explode(F.array(*[F.col(f"__{i}") for i in range(len(numeric))])).alias("x")).select("x.series", "bucket_id", *[f"x.{c}" for c in BUCKET])
    return _levels(level, ["series"], 0 if last is None else last + 1)


def extend(pyramid: DataFrame, rows: DataFrame, value: str, before: int, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """The pyramid of the first ``before`` rows and the new ``rows`` (numbered on from ``before``; one series or equally long ones).

    Only the last, partial bucket of a level and those after it change: they are merged from
    the old bucket and what the new rows add to the level.
    """
    by = by or []
    last = rows.agg(F.max(order)).first()[0]
    total = before if last is None else last + 1
    n, k, out, old, fresh = -(-total // FACTOR), 0, None, None, None
    while True:
        old = pyramid.filter(F.col("level") == k).select(*by, "bucket_id", *BUCKET) if _has_level(before, k) else next_level(old, by)
        fresh = next_level(fresh, by) if k else level_zero(rows, value, by, tick, order)
        both = old.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)))
        own = both.groupBy(*by, "bucket_id").agg(*merge_aggregates("part")).select(*by, F.lit(k).alias("level"), "bucket_id", *BUCKET)
        out = own if out is None else out.unionByName(own)
        if n < FACTOR:
            return out
        n, k = -(-n // FACTOR), k + 1


def _has_level(rows: int, level: int) -> bool:
    n, k = -(-rows // FACTOR), 0
    while n >= FACTOR:
        n, k = -(-n // FACTOR), k + 1
    return level <= k
