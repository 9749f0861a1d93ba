"""Row order at scale: dense row numbers, the previous row, positions and running sums without one big partition.

Spark has no row order, so every order-dependent operator takes an order column (a dense or
at least unique BIGINT, ``row_id``) and optional series keys ``by``. Rows are cut into
chunks of neighbouring order values; windows run inside (series, chunk), and only a row or two a
chunk take part in the window that links chunks. A hot series so spreads over its chunks.

No operator reads its input twice in one plan: what a chunk is handed is worked out first
and kept as a small table (``with_running_sum``, ``with_position``), or goes through a second window
(``with_previous``). So layers add up and don't multiply, whatever the planner can reuse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle

#: Order values a chunk; the window that links chunks has a row or two for each.
CHUNK = 1 << 20


def _chunk(order: str, size: int) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("bigint")


def join_series(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on series keys, which may be null; ``other``'s copies of them go. No keys: ``other`` has one row, which all rows get."""
    if not keys:
        return df.crossJoin(F.broadcast(other))
    named = other.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"__of_{k}"]) for k in keys])
    return df.join(named, on, how).drop(*[f"__of_{k}" for k in keys])


def with_previous(df: DataFrame, columns: list[str], by: list[str] | None = None, order: str = "row_id", prefix: str = "prev_", size: int = CHUNK) -> DataFrame:
    """Adds prev_<column>: the value in the row before, in ``order``, of the same series (null in the first).

    Inside a chunk the row before is the last one of the window; the first and last rows of all chunks
    of a series meet in a second window, where the row before a chunk's first is the chunk before's last.
    """
    by = by or []
    inside = Window.partitionBy(*by, "__chunk").orderBy(order)
    marked = df.withColumn("__chunk", _chunk(order, size)).withColumn("__row", F.struct(*columns, F.lit(True).alias("__is")))
    marked = marked.withColumn("__near", F.lag("__row").over(inside)).withColumn("__next", F.lead(F.lit(1)).over(inside))
    first = F.col("__near.__is").isNull()
    edge = F.when(first | F.col("__next").isNull(), F.lit(-1)).otherwise(F.col("__chunk"))
    across = Window.partitionBy(*by, "__edge").orderBy(order)
    out = marked.withColumn("__edge", edge).withColumn("__before", F.lag("__row").over(across))
    before = F.when(first, F.col("__before")).otherwise(F.col("__near"))
    return out.withColumn("__prev", before).select(*df.columns, *[F.col(f"__prev.{c}").alias(prefix + c) for c in columns])


def _chunk_sums(df: DataFrame, value: Column, by: list[str], order: str, size: int) -> DataFrame:
    """by, __chunk, __before (sum of the chunks before) and __all (of the series), kept as a table."""
    totals = df.groupBy(*by, _chunk(order, size).alias("__chunk")).agg(F.coalesce(F.sum(value.cast("bigint")), F.lit(0)).alias("__total"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    return settle(totals.select(*by, "__chunk", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"), F.sum("__total").over(whole).alias("__all")), "chunk-sums")


def with_running_sum(df: DataFrame, value: Column, name: str, by: list[str] | None = None, order: str = "row_id", size: int = CHUNK) -> DataFrame:
    """Adds ``name``: the sum of ``value`` (BIGINT) over the series' rows up to this one."""
    by = by or []
    carried = _chunk_sums(df, value, by, order, size)
    inside = Window.partitionBy(*by, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    near = df.withColumn("__chunk", _chunk(order, size)).withColumn("__near", F.sum(value.cast("bigint")).over(inside))
    out = join_series(near, carried, [*by, "__chunk"])
    return out.select(*df.columns, (F.coalesce("__near", F.lit(0)) + F.col("__before")).cast("bigint").alias(name))


def with_position(df: DataFrame, by: list[str] | None = None, order: str = "row_id", size: int = CHUNK, name: str = "i", rows: str = "n") -> DataFrame:
    """Adds ``name``: the row's place in its series, from 0, and ``rows``: how many the series has."""
    by = by or []
    carried = _chunk_sums(df, F.lit(1), by, order, size)
    inside = Window.partitionBy(*by, "__chunk").orderBy(order)
    near = df.withColumn("__chunk", _chunk(order, size)).withColumn("__near", F.row_number().over(inside))
    out = join_series(near, carried, [*by, "__chunk"])
    return out.select(*df.columns, (F.col("__near") - 1 + F.col("__before")).cast("bigint").alias(name), F.col("__all").cast("bigint").alias(rows))


def cut_at(key: Column, bounds: list) -> Column:
    """The number of ``bounds`` (ascending) that are at most ``key``, as a balanced tree of comparisons."""

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < F.lit(bounds[mid]), part(lo, mid)).otherwise(part(mid + 1, hi))

    return part(0, len(bounds))


def quantiles(df: DataFrame, key: Column, parts: int) -> list:
    """At most ``parts`` - 1 values that cut ``key`` into parts of about as many rows."""
    if parts < 2:
        return []
    at = F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)
    return sorted({b for b in df.select(at).first()[0] or [] if b is not None})


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id", parts: int | None = None) -> DataFrame:
    """Adds dense row numbers 0, 1, ... in the order of the unique key ``order``.

    Quantiles of the first key column cut the rows into ``parts`` (the session's shuffle partitions); rows
    are counted by part, and numbered inside their part. The driver sees a bound and a count a part.
    Parts depend on values only, so counts and numbers agree whatever the physical plan does.
    """
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = F.col(order[0])
    bounds = quantiles(df, key, parts)
    part = F.when(key.isNull(), F.lit(-1)).otherwise(cut_at(key, bounds)) + 1
    counts = {r["p"]: r["n"] for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in range(len(bounds) + 2):
        offsets.append(total)
        total += counts.get(p, 0)
    inside = Window.partitionBy("__part").orderBy(*order)
    before = F.get(F.array(*[F.lit(x).cast("bigint") for x in offsets]), F.col("__part"))
    return df.withColumn("__part", part).select(*df.columns, (before + F.row_number().over(inside) - 1).cast("bigint").alias(name))
