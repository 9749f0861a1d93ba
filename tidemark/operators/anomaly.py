"""Anomalies (missing runs, skipped rows, outliers, lossy integers) and states: flagged, never altered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .medians import with_median
from .pyramid import is_missing
from .rows import with_previous, with_running_sum
from .timestats import gap_rows

#: Largest integer below which every integer has an exact double.
EXACT = 9_007_199_254_740_992
#: Modified z-score beyond which a value is an outlier (Iglewicz and Hoaglin 1993).
OUTLIER = 3.5


def nan_runs(df: DataFrame, value: str, by: list[str] | None = None, order: str = "row_id") -> DataFrame:
    """by, start, end (exclusive) of every maximal run of missing values, in row positions."""
    return _missing(df, value, by or [], order, []).select(*(by or []), "start", "end")


def _missing(df: DataFrame, value: str, by: list[str], order: str, extra: list) -> DataFrame:
    marked = with_running_sum(df.withColumn("missing_", is_missing(F.col(value).cast("double"))), (~F.col("missing_")).cast("int"), "island", by, order)
    return marked.filter("missing_").groupBy(*by, "island").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), *extra)


def outliers(df: DataFrame, value: str, by: list[str] | None = None, order: str = "row_id", threshold: float = OUTLIER) -> DataFrame:
    """by, row, value, score: finite values whose modified z-score exceeds ``threshold``.

    The score is 0.6745 |x - median| / MAD. If the MAD is 0, at least half of the values
    equal the median, and every other value is flagged with an infinite score.
    """
    return _outliers(df.select(*(by or []), order, value), value, by or [], order, threshold)


def _outliers(df: DataFrame, value: str, by: list[str], order: str, threshold: float, keep: tuple[str, ...] = ()) -> DataFrame:
    v = F.col(value).cast("double")
    finite = settle(df.filter(~is_missing(v) & (F.abs(v) != float("inf"))).select(*by, order, *keep, v.alias("x")), "finite")
    centred = with_median(finite, by, "x", "m").withColumn("away", F.abs(F.col("x") - F.col("m")))
    scaled = with_median(centred, by, "away", "mad")
    score = F.when(F.col("mad") > 0, 0.6745 * F.col("away") / F.col("mad")).when(F.col("away") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return scaled.withColumn("score", score).filter(F.col("score") > threshold).select(*by, order, *keep, F.col("x").alias("value"), "score")


def precision_loss(df: DataFrame, columns: list[str]) -> DataFrame:
    """series, lossy: how many integers of each column are beyond exact doubles."""
    counts = df.agg(*[F.count_if((F.col(c) > EXACT) | (F.col(c) < -EXACT)).alias(c) for c in columns])
    return counts.unpivot([], columns, "series", "lossy")


def bands(df: DataFrame, state: str, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, state, first_index, last_index, first_tick, last_tick, n: runs of one state (a state timeline's bands)."""
    by = by or []
    stepped = with_previous(df.withColumn("here_", F.lit(1)), [state, "here_"], by, order)
    changed = F.col("prev_here_").isNull() | ~F.col(state).eqNullSafe(F.col(f"prev_{state}"))
    numbered = with_running_sum(stepped, changed.cast("int"), "band", by, order)
    out = numbered.groupBy(*by, "band", state).agg(F.min(order).alias("first_index"), F.max(order).alias("last_index"), F.min_by(tick, order).alias("first_tick"), F.max_by(tick, order).alias("last_tick"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col(state).alias("state"), "first_index", "last_index", "first_tick", "last_tick", "n")


def markers(df: DataFrame, column: str, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """row, tick, marker of every non-empty cell: single events, never decimated away."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(order, tick, F.col(column).alias("marker"))


def skipped_rows(df: DataFrame, reason: str = "skip_reason", order: str = "source_row") -> DataFrame:
    """source_row, reason of rows that a text source could not keep (see ``sources.text``)."""
    return df.filter(F.col(reason).isNotNull()).select(F.col(order), F.col(reason).alias("reason"))


def gutter(df: DataFrame, value: str, by: list[str] | None = None, tick: str = "tick", order: str = "row_id") -> DataFrame:
    """by, kind, first_index, last_index, first_tick, last_tick: missing runs, gaps and outliers as ranges of the axis."""
    by = by or []
    df = settle(df.select(*by, order, tick, value), "gutter")
    ends = [F.min_by(tick, order).alias("first_tick"), F.max_by(tick, order).alias("last_tick")]
    kind = lambda name: F.lit(name).alias("kind")
    at = lambda c, name: F.col(c).alias(name)
    missing = _missing(df, value, by, order, ends).select(*by, kind("missing"), at("start", "first_index"), (F.col("end") - 1).alias("last_index"), "first_tick", "last_tick")
    gaps = gap_rows(df, by, tick, order).select(*by, kind("gap"), at("before_index", "first_index"), at("after_index", "last_index"), at("before_tick", "first_tick"), at("after_tick", "last_tick"))
    far = _outliers(df, value, by, order, OUTLIER, (tick,)).select(*by, kind("outlier"), at(order, "first_index"), at(order, "last_index"), at(tick, "first_tick"), at(tick, "last_tick"))
    return missing.unionByName(gaps).unionByName(far)


def is_constant(df: DataFrame, columns: list[str]) -> DataFrame:
    """series, constant: whether all values are the same, float bits compared (NaN is NaN, -0.0 is not 0.0)."""
    def same(c: str):
        kind = df.schema[c].dataType.typeName()
        if kind in ("double", "float"):
            v = F.col(c).cast("double")
            sign = F.when(v == 0, F.when(F.concat(v.cast("string")).startswith("-"), F.lit(-1)).otherwise(F.lit(1))).otherwise(F.lit(0))
            key = F.struct(v.alias("v"), sign.alias("s"))
        else:
            key = F.struct(F.col(c).alias("v"))
        return F.coalesce(F.min(key) == F.max(key), F.lit(True)).alias(c)

    return df.agg(*[same(c) for c in columns]).unpivot([], columns, "series", "constant")
