"""Viewport queries: a time range reduced to as many buckets as the screen has columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import DATED, format_ticks, in_unit
from .pyramid import FACTOR, is_missing, merge_aggregates, raw_aggregates
from .rows import join_series, with_position, with_running_sum
from .timestats import with_segments


def in_range(df: DataFrame, low, high, tick: str = "tick") -> DataFrame:
    """Rows of the inclusive time range; a plain comparison, so it is pushed to the scan."""
    return df.filter((F.col(tick) >= F.lit(low)) & (F.col(tick) <= F.lit(high)))


def snap_range(df: DataFrame, low, high, tick: str = "tick") -> tuple:
    """The range, or the whole axis if it is invalid or meets no data."""
    first, last = df.agg(F.min(tick), F.max(tick)).first()
    if low is None or high is None or low > high or first is None or high < first or low > last:
        return first, last
    return low, high


def _placed(df: DataFrame, k: int, by: list[str], order: str, dense: bool) -> DataFrame:
    """Adds i (position in the range), n (rows in it) and, for rows to be merged, their column c."""
    if dense:  # positions follow from the row numbers
        grouped = df.groupBy(*by).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("n"))
        joined = join_series(df, grouped, by).withColumn("i", F.col(order) - F.col("__first"))
    else:
        joined = with_position(df, by, order)
    i = F.col("i")
    c = F.when(F.col("n") <= k, i).otherwise(F.expr(f"((i + 1) * {k} - 1) div n"))
    return joined.withColumn("column", c.cast("bigint"))


def viewport(df: DataFrame, low, high, k: int, value: str = "value", by: list[str] | None = None, tick: str = "tick", order: str = "row_id", dense: bool = False) -> DataFrame:
    """by, column, min, max, first_ts, last_ts, nan_count: at most ``k`` buckets of equally many rows.

    With n rows in the range, column c covers rows floor(c n / k) to floor((c + 1) n / k) - 1.
    With n <= k every row is its own bucket, min = max = value (NaN stays NaN). ``dense``:
    the range's rows are known to be neighbours in ``row_id`` (a monotonic axis, one
    series), so no running count is needed.
    """
    by = by or []
    ranged = in_range(df, low, high, tick)
    if k <= 0:
        ranged = ranged.filter("false")
        k = 1
    placed = _placed(ranged.select(*by, order, tick, value), k, by, order, dense)
    alone = F.max(F.col("n") <= k)
    v = F.coalesce(F.first(F.col(value).cast("double")), F.lit(float("nan")))
    columns = raw_aggregates(value, tick, order)
    return (
        placed.groupBy(*by, "column")
        .agg(*columns, alone.alias("__alone"), v.alias("__v"))
        .select(*by, "column", F.when(F.col("__alone"), F.col("__v")).otherwise(F.col("min")).alias("min"), F.when(F.col("__alone"), F.col("__v")).otherwise(F.col("max")).alias("max"), "first_ts", "last_ts", "nan_count")
    )


def pick_level(n: int, k: int) -> int:
    """The coarsest pyramid level whose buckets fit at least twice in a column; -1: raw rows."""
    level, size = -1, 1
    while size * FACTOR * 2 <= n // max(1, k):
        level, size = level + 1, size * FACTOR
    return level


def viewport_from_pyramid(df: DataFrame, pyramid: DataFrame, first: int, n: int, k: int, value: str = "value", tick: str = "tick", order: str = "row_id") -> DataFrame:
    """The same buckets for rows first .. first + n - 1 of one series, reading raw rows only at column edges.

    Buckets of the chosen level that lie inside one column stand for their rows; rows whose
    bucket crosses an edge are read raw (a semi-join by bucket number, whose list has at
    most two buckets a column).
    """
    level = pick_level(n, k)
    if level < 0 or n <= k:
        return _raw_columns(df, first, n, k, value, tick, order)
    size = FACTOR ** (level + 1)
    column = lambda row: F.floor(((row - first + 1) * k - 1) / F.lit(n)).cast("bigint")
    low, high = F.col("bucket_id") * size, F.col("bucket_id") * size + size - 1
    inside = pyramid.filter(F.col("level") == level).filter((low >= first) & (high <= first + n - 1))
    whole = inside.filter(column(low) == column(high)).select(column(low).alias("column"), F.col("bucket_id").alias("pos"), "min", "max", "first_ts", "last_ts", "nan_count")
    whole = whole.withColumn("pos", F.col("pos") * size)
    rows = df.filter(F.col(order).between(first, first + n - 1)).withColumn("bucket_id", F.floor(F.col(order) / size).cast("bigint"))
    edge_low, edge_high = F.greatest(F.col("bucket_id") * size, F.lit(first)), F.least(F.col("bucket_id") * size + size - 1, F.lit(first + n - 1))
    cut = (column(edge_low) != column(edge_high)) | (F.col("bucket_id") * size < first) | (F.col("bucket_id") * size + size > first + n)
    v = F.col(value).cast("double")
    missing = is_missing(v)
    inf = float("inf")
    raw = rows.filter(cut).select(column(F.col(order)).alias("column"), F.col(order).alias("pos"), F.when(missing, F.lit(inf)).otherwise(v).alias("min"), F.when(missing, F.lit(-inf)).otherwise(v).alias("max"), F.col(tick).alias("first_ts"), F.col(tick).alias("last_ts"), missing.cast("bigint").alias("nan_count"))
    return whole.unionByName(raw).groupBy("column").agg(*merge_aggregates("pos"))


def _raw_columns(df: DataFrame, first: int, n: int, k: int, value: str, tick: str, order: str) -> DataFrame:
    rows = df.filter(F.col(order).between(first, first + n - 1))
    return viewport(rows, *rows.agg(F.min(tick), F.max(tick)).first(), k, value, None, tick, order, True)


def is_converged(df: DataFrame, low, high, k: int, tick: str = "tick") -> DataFrame:
    """n, converged: whether every row of the range gets its own column."""
    return in_range(df, low, high, tick).agg(F.count(F.lit(1)).alias("n")).select("n", (F.col("n") <= k).alias("converged"))


def is_gap_bucket() -> Column:
    return F.isnan("min") | F.isnan("max") | (F.col("min") > F.col("max"))


def line_segments(buckets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, segment, first_column, last_column, n: runs of buckets that aren't gaps."""
    by = by or []
    marked = with_running_sum(buckets.withColumn("gap", is_gap_bucket()), F.col("gap").cast("int"), "segment", by, "column")
    return marked.filter(~F.col("gap")).groupBy(*by, "segment").agg(F.min("column").alias("first_column"), F.max("column").alias("last_column"), F.count(F.lit(1)).alias("n"))


def fit_bounds(df: DataFrame, values: list[str], tick: str = "tick") -> DataFrame:
    """x_min, x_max, y_min, y_max over finite values; equal bounds are padded by a tenth of their size, or by 1 around 0."""
    inf = float("inf")

    def finite(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~is_missing(v) & (F.abs(v) != inf), v)

    low = [F.min(finite(c)) for c in values]
    high = [F.max(finite(c)) for c in values]
    sums = df.agg(F.min(tick).cast("double").alias("x0"), F.max(tick).cast("double").alias("x1"), (F.least(*low) if len(low) > 1 else low[0]).alias("y0"), (F.greatest(*high) if len(high) > 1 else high[0]).alias("y1"))

    def padded(a: str, b: str, names: tuple[str, str]) -> list[Column]:
        pad = F.when(F.col(a) != F.col(b), F.lit(0.0)).when(F.col(a) == 0, F.lit(1.0)).otherwise(F.abs(a) * 0.1)
        return [(F.col(a) - pad).alias(names[0]), (F.col(b) + pad).alias(names[1])]

    return sums.select(*padded("x0", "x1", ("x_min", "x_max")), *padded("y0", "y1", ("y_min", "y_max")))


def nearest(df: DataFrame, target, by: list[str] | None = None, tick: str = "tick", order: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """The row nearest in time to ``target``, the earlier in row order of equals: one partial aggregate, no sort."""
    by = by or []
    columns = columns or [c for c in df.columns if c not in by]
    distance = F.struct(F.abs(F.col(tick) - F.lit(target)), F.col(order))
    best = df.filter(F.col(tick).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*columns), distance).alias("best")).filter("best is not null")
    return best.select(*by, *[F.col(f"best.{c}") for c in columns])


def time_bins(df: DataFrame, low: int, high: int, k: int, value: str = "value", by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, column and bucket columns, for ``k`` equal ranges of time instead of equally many rows."""
    by = by or []
    span = high - low + 1
    column = F.expr(f"((`{tick}` - {low}) * {k}) div {span}").cast("bigint")
    return in_range(df, low, high, tick).withColumn("column", column).groupBy(*by, "column").agg(*raw_aggregates(value, tick, order))


def compressed_axis(df: DataFrame, width: int, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """Adds x: time since the first row with every gap (see ``timestats.gaps``) shrunk to ``width`` ticks."""
    step = F.when(F.col("is_gap"), F.lit(width)).otherwise(F.coalesce(F.col("dt"), F.lit(0)))
    return with_running_sum(with_segments(df, by, tick, order), step, "x", by, order)


def state_columns(df: DataFrame, low, high, k: int, state: str, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, column, state (null if several), multiple: what a state timeline shows in a column."""
    by = by or []
    placed = _placed(in_range(df, low, high, tick).select(*by, order, tick, state), k, by, order, False)
    text = F.col(state).cast("string")
    both = placed.groupBy(*by, "column").agg(F.min(text).alias("a"), F.max(text).alias("b"), F.count(F.lit(1)).alias("n"), F.count(text).alias("m"))
    several = (F.col("m") > 0) & ((F.col("a") != F.col("b")) | (F.col("m") < F.col("n")))
    return both.select(*by, "column", F.when(~several, F.col("a")).alias("state"), several.alias("multiple"))



def point(df: DataFrame, row: int, columns: list[str], order: str = "row_id") -> DataFrame:
    """The exact native values of ``columns`` in one row, as text (integers never pass through doubles)."""
    return df.filter(F.col(order) == row).select(order, *[F.col(c).cast("string").alias(c) for c in columns])


def cursor(df: DataFrame, target, columns: list[str], fmt: str, unit: str, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """What a cursor reads: the nearest row's time in the column's own format, with its own offset, and its exact values."""
    offset = F.col("offset_seconds") if "offset_seconds" in df.columns else F.lit(None).cast("int").alias("offset_seconds")
    found = nearest(df.select(order, tick, offset, *columns), target, None, tick, order)
    stamp = F.struct(F.col(tick).cast("decimal(38,0)").alias("ticks"), F.lit(unit).alias("unit"), F.col("offset_seconds"))
    if fmt in DATED and unit != "ps":  # dates are written from nanoseconds
        stamp = F.struct(in_unit(stamp, "ns").alias("ticks"), F.lit("ns").alias("unit"), F.col("offset_seconds"))
    return found.withColumn("__stamp", stamp).select(order, format_ticks(F.col("__stamp"), fmt).alias("time"), *[F.col(c).cast("string").alias(c) for c in columns])
