"""Statistics of a time axis, always in row order (``row_id``), never in sorted time.

Steps between rows are worked out once and stored as a narrow table; medians, gaps, segments
and classes are counted on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .medians import medians, with_median
from .rows import join_series, with_previous, with_row_id, with_running_sum

#: A gap is a step of more than so many medians; a series is uniform up to this relative MAD.
GAP_FACTOR, UNIFORM_SHARE = 10, 0.01
#: Buckets of one refinement pass of ``exact_kth``.
PASS_BUCKETS = 1 << 16


def deltas(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """Adds prev_tick and dt = tick - prev_tick (null in a series' first row)."""
    return with_previous(df, [tick], by, order).withColumn("dt", F.col(tick) - F.col(f"prev_{tick}"))


def exact_kth(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest (0-based) of a BIGINT column, exactly, in few counting passes.

    Every pass counts values in ``PASS_BUCKETS`` equal ranges of the interval left, so no
    pass holds more than that many counts, however many distinct values there are.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if n == 0 or not 0 <= k < n:
        return None
    low, high = int(low), int(high)
    while high > low:
        width = max(1, -(-(high - low + 1) // PASS_BUCKETS))
        offset = F.col(column).cast("decimal(38,0)") - F.lit(low)
        ranged = df.filter(F.col(column).between(low, high)).groupBy(F.floor(offset / width).cast("bigint").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for b, many in sorted((r["b"], r["n"]) for r in ranged.collect()):
            if k < many:
                low, high = low + b * width, min(high, low + b * width + width - 1)
                break
            k -= many
    return low


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median of a BIGINT column by ``exact_kth``: the mean of the two middle values of an even count."""
    n = df.agg(F.count(column)).first()[0]
    if not n:
        return None
    upper = exact_kth(df, column, n // 2)
    return float(upper) if n % 2 else (exact_kth(df, column, n // 2 - 1) + upper) / 2


def steps(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, ``order``, ``tick``, prev_<order>, prev_<tick>, dt of every row, stored."""
    by = by or []
    found = with_previous(df.select(*by, order, tick), [tick, order], by, order)
    return settle(found.withColumn("dt", F.col(tick) - F.col(f"prev_{tick}")), "steps")


def gaps(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, before_index, after_index, delta of every step beyond ``GAP_FACTOR`` medians."""
    return gap_rows(df, by, tick, order).drop("before_tick", "after_tick")


def gap_rows(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """``gaps`` with before_tick and after_tick."""
    by = by or []
    stepped = with_median(steps(df, by, tick, order), by)
    return stepped.filter(F.col("dt") > GAP_FACTOR * F.col("median_dt")).select(*by, F.col(f"prev_{order}").alias("before_index"), F.col(order).alias("after_index"), F.col("dt").alias("delta"), F.col(f"prev_{tick}").alias("before_tick"), F.col(tick).alias("after_tick"))


def with_segments(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """Adds dt, median_dt, is_gap and segment: the number of gaps up to the row."""
    by = by or []
    stored = settle(deltas(df, by, tick, order), "deltas")
    return _segmented(stored, by, order)


def _segmented(stepped: DataFrame, by: list[str], order: str) -> DataFrame:
    marked = with_median(stepped, by).withColumn("is_gap", F.coalesce(F.col("dt") > GAP_FACTOR * F.col("median_dt"), F.lit(False)))
    return with_running_sum(marked, F.col("is_gap").cast("int"), "segment", by, order)


def _uniform(median: Column, mad: Column, nonzero: Column, steps: Column) -> Column:
    """MAD within a share of the median; fewer than two samples are uniform; a median of 0 asks for all steps 0."""
    return F.when(steps == 0, F.lit(True)).when(median == 0, nonzero == 0).otherwise(mad <= UNIFORM_SHARE * F.abs(median))


def _segments(df: DataFrame, by: list[str], tick: str, order: str) -> DataFrame:
    """Steps with their segments, stored; ``step``: those inside a segment."""
    marked = _segmented(steps(df, by, tick, order).drop(f"prev_{order}", f"prev_{tick}"), by, order)
    return settle(marked.withColumn("step", F.when(~F.col("is_gap"), F.col("dt").cast("double"))), "segments")


def segment_uniformity(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """One row a gap-free segment: by, segment, n, first_index, last_index, first_tick, last_tick, segment_median, uniform (by its own median)."""
    return _segment_uniformity(_segments(df, by or [], tick, order), by or [], tick, order)


def _segment_uniformity(marked: DataFrame, by: list[str], tick: str, order: str) -> DataFrame:
    key = [*by, "segment"]
    middle = medians(marked, "step", key, "segment_median")
    away = medians(join_series(marked, middle, key), F.abs(F.col("step") - F.col("segment_median")), key, "mad")
    sums = marked.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count("step").alias("steps"), F.count_if(F.col("step") != 0).alias("nonzero"), F.min(order).alias("first_index"), F.max(order).alias("last_index"), F.min_by(tick, order).alias("first_tick"), F.max_by(tick, order).alias("last_tick"))
    both = join_series(join_series(sums, middle, key, "left"), away, key, "left")
    uniform = _uniform(F.col("segment_median"), F.col("mad"), F.col("nonzero"), F.col("steps"))
    return both.select(*key, "n", "first_index", "last_index", "first_tick", "last_tick", "segment_median", uniform.alias("uniform"))


def is_uniform(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, uniform: over all steps of the series, gaps included."""
    by = by or []
    stepped = with_median(steps(df, by, tick, order), by)
    return _totals(stepped.withColumn("is_gap", F.lit(False)), by).select(*by, "uniform")


def _totals(stepped: DataFrame, by: list[str]) -> DataFrame:
    """by, n, gap_count, non_monotonic, duplicate_timestamp, median_dt and uniform (of all steps) of steps with their median."""
    away = medians(stepped, F.abs(F.col("dt") - F.col("median_dt")), by, "mad")
    sums = stepped.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("dt").alias("steps"), F.count_if(F.col("dt") != 0).alias("nonzero"), F.count_if("is_gap").alias("gap_count"), F.count_if(F.col("dt") < 0).alias("non_monotonic"), F.count_if(F.col("dt") == 0).alias("duplicate_timestamp"), F.max("median_dt").alias("median_dt"))
    both = join_series(sums, away, by, "left")
    return both.withColumn("uniform", _uniform(F.col("median_dt"), F.col("mad"), F.col("nonzero"), F.col("steps")))


def monotonicity(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, non_monotonic (backward steps) and duplicate_timestamp (zero steps)."""
    by = by or []
    return deltas(df, by, tick, order).groupBy(*by).agg(F.count_if(F.col("dt") < 0).alias("non_monotonic"), F.count_if(F.col("dt") == 0).alias("duplicate_timestamp"))


def summarize(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, n, gap_count, sampling_class, non_monotonic, duplicate_timestamp, median_dt."""
    by = by or []
    marked = _segments(df, by, tick, order)
    totals = settle(_totals(marked, by), "time-totals")
    pieces = _segment_uniformity(marked, by, tick, order).groupBy(*by).agg(F.bool_and("uniform").alias("each_uniform"))
    out = join_series(totals, pieces, by)
    label = F.when((F.col("gap_count") == 0) & F.col("uniform"), F.lit("uniform")).when((F.col("gap_count") > 0) & F.col("each_uniform"), F.lit("segmented_uniform")).otherwise(F.lit("irregular"))
    return out.select(*by, "n", "gap_count", label.alias("sampling_class"), "non_monotonic", "duplicate_timestamp", "median_dt")


def sample_rate(df: DataFrame, ticks_per_second: int, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, sample_rate_hz = ticks per second / median step (null without a positive median)."""
    by = by or []
    stepped = steps(df, by, tick, order)
    middle = join_series(stepped.groupBy(*by).agg(F.count("dt").alias("steps")), medians(stepped, "dt", by, "m"), by, "left")
    return middle.select(*by, F.when(F.col("m") > 0, F.lit(float(ticks_per_second)) / F.col("m")).alias("sample_rate_hz"))


def largest_uniform_range(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, first_index, last_index, n of the longest uniform gap-free segment (the earlier of equals)."""
    by = by or []
    pieces = segment_uniformity(df, by, tick, order).filter("uniform")
    best = pieces.groupBy(*by).agg(F.max_by(F.struct("first_index", "last_index", "n"), F.struct("n", -F.col("first_index"))).alias("best"))
    return best.select(*by, "best.first_index", "best.last_index", "best.n")


def gap_share(df: DataFrame, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, gap_share of the span, and offer_compression (over one half)."""
    by = by or []
    stepped = with_median(steps(df, by, tick, order), by).withColumn("is_gap", F.col("dt") > GAP_FACTOR * F.col("median_dt"))
    sums = stepped.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("is_gap"), F.col("dt"))), F.lit(0)).alias("g"), (F.max(tick) - F.min(tick)).alias("span"))
    share = F.when(F.col("span") > 0, F.col("g").cast("double") / F.col("span").cast("double")).otherwise(F.lit(0.0))
    return sums.select(*by, share.alias("gap_share"), (share > 0.5).alias("offer_compression"))


def sorted_axis(df: DataFrame, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """The rows numbered anew in order of time, equal times in their old order. Only on demand."""
    return with_row_id(df.withColumnRenamed(order, "__old"), [tick, "__old"], order).drop("__old")
