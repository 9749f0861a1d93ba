"""Welch power spectral densities on raw samples.

Segments of L samples (by row position) are cut with an overlap, detrended, windowed and
transformed; one-sided power is averaged over segments. Rows are sent to packets of about ``PACKET``
samples (those at an edge to two, so no segment is lost), a packet's segments are transformed together, and
its sums of power by bin are all that leaves it. So a series of any length is spread over
the cluster and nothing larger than a packet meets in a task.

Decided here, as no definition says otherwise: windows are periodic; the hop is
L - floor(L * overlap); samples after the last full segment are left out; a series shorter
than L has no spectrum (it is reported by ``welch_segmented``); an odd L has no Nyquist
bin; a segment with a NaN or NULL is left out, never interpolated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle
from .pyramid import is_missing
from .rows import join_series, with_running_sum
from .timestats import largest_uniform_range, summarize, with_segments

SHORTEST, LONGEST = 256, 65_536
#: Samples of a packet of segments.
PACKET = 1 << 20


def default_segment_length(n: int) -> int:
    """The largest power of two up to n / 8, between 256 and 65536."""
    length = 1
    while length * 2 <= n // 8:
        length *= 2
    return min(LONGEST, max(SHORTEST, length))


def coefficients(window: str, length: int) -> np.ndarray:
    angle = 2 * np.pi * np.arange(length) / length
    if window == "rectangular":
        return np.ones(length)
    if window == "hann":
        return 0.5 - 0.5 * np.cos(angle)
    if window == "hamming":
        return 0.54 - 0.46 * np.cos(angle)
    raise ValueError(f"unknown window {window!r}")


def mean_square(weights: np.ndarray) -> float:
    return float(np.mean(weights**2))


def detrend(x: np.ndarray, how: str) -> np.ndarray:
    if how == "none":
        return x
    if how == "mean":
        return x - x.mean(axis=-1, keepdims=True)
    raise ValueError(f"unknown detrending {how!r}")


def hop_of(length: int, overlap: float) -> int:
    return max(1, length - int(length * overlap))


def periodogram(x: np.ndarray, rate: float, window: str = "hann", how: str = "mean") -> np.ndarray:
    """One-sided power density of one segment, or of several (rows)."""
    x = np.asarray(x, float)
    length = x.shape[-1]
    weights = coefficients(window, length)
    power = np.abs(np.fft.rfft(detrend(x, how) * weights)) ** 2 / (rate * length * mean_square(weights))
    power[..., 1 : -1 if length % 2 == 0 else None] *= 2
    return power


def _spectra(df: DataFrame, by: list[str], run_key: str | None, value: str, order: str, length: int, rate: float, window: str, overlap: float, how: str) -> DataFrame:
    """by, run, bin, power (summed), many (segments) of each packet. ``order`` counts a run's rows from 0."""
    hop = hop_of(length, overlap)
    packet = max(1, PACKET // hop)  # segments
    key = [*by, *([run_key] if run_key else [])]
    first = F.greatest(F.lit(0), F.floor((F.col(order) - length) / hop) + 1)
    packets = F.sequence(F.floor(first / packet).cast("bigint"), F.floor(F.col(order) / (hop * packet)).cast("bigint"))
    spread = df.withColumn("__packet", F.explode(packets))
    shaped = spread.select(*key, "__packet", F.col(order).alias("__i"), F.col(value).cast("double").alias("__x"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shaped.schema.fields[: len(key)])
    size = (packet - 1) * hop + length

    def transform(name, table):
        at = table.column("__i").to_numpy() - name[-1].as_py() * packet * hop
        x = np.full(min(size, int(at.max()) + 1), np.nan)  # what isn't there is missing, too
        x[at] = table.column("__x").to_numpy(zero_copy_only=False)
        power, many = np.zeros(0), 0
        if len(x) >= length:
            segments = np.lib.stride_tricks.sliding_window_view(x, length)[::hop]
            segments = segments[~np.isnan(segments).any(axis=1)]
            many = len(segments)
            power = sum((periodogram(segments[a : a + 64], rate, window, how).sum(axis=0) for a in range(0, many, 64)), np.zeros(length // 2 + 1)) if many else power
        keys = table.select(key).take(pa.array(np.zeros(len(power), np.int64))).columns if key else []
        return pa.Table.from_arrays([*keys, pa.array(np.arange(len(power))), pa.array(power), pa.array(np.full(len(power), many))], names=[*key, "bin", "power", "many"])

    schema = (fields + ", " if fields else "") + "bin bigint, power double, many bigint"
    return shaped.groupBy(*key, "__packet").applyInArrow(transform, schema)


def welch(df: DataFrame, rate: float, length: int | None = None, value: str = "value", by: list[str] | None = None, order: str = "row_id", window: str = "hann", overlap: float = 0.5, detrending: str = "mean") -> DataFrame:
    """by, bin, freq, power, segment_count. ``order`` counts a series' rows from 0."""
    by = by or []
    if length is None:
        last = df.agg(F.max(order)).first()[0]
        length = default_segment_length(0 if last is None else last + 1)
    spectra = _spectra(df, by, None, value, order, length, rate, window, overlap, detrending)
    means = spectra.groupBy(*by, "bin").agg((F.sum("power") / F.sum("many")).alias("power"), F.sum("many").alias("segment_count"))
    return means.select(*by, "bin", (F.col("bin") * F.lit(rate / length)).alias("freq"), "power", "segment_count")


def welch_segmented(df: DataFrame, rate: float, length: int, value: str = "value", run: str = "segment", by: list[str] | None = None, order: str = "row_id", window: str = "hann", overlap: float = 0.5, detrending: str = "mean") -> tuple[DataFrame, DataFrame]:
    """(spectrum, excluded): runs (gap-free stretches) averaged by their lengths, and those shorter than ``length``.

    No window crosses from one run into another.
    """
    by = by or []
    key = [*by, run]
    sizes = settle(df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first")), "runs")
    placed = join_series(df, sizes.filter(F.col("__n") >= length), key).withColumn("__at", F.col(order) - F.col("__first"))
    spectra = _spectra(placed, by, run, value, "__at", length, rate, window, overlap, detrending)
    each = spectra.groupBy(*key, "bin").agg((F.sum("power") / F.sum("many")).alias("power"), F.sum("many").alias("many"))
    weighed = join_series(each, sizes.drop("__first"), key)
    means = weighed.groupBy(*by, "bin").agg((F.sum(F.col("power") * F.col("__n")) / F.sum("__n")).alias("power"), F.sum("many").alias("segment_count"))
    spectrum = means.select(*by, "bin", (F.col("bin") * F.lit(rate / length)).alias("freq"), "power", "segment_count")
    excluded = sizes.filter(F.col("__n") < length).select(*key, F.col("__n").alias("n"))
    return spectrum, excluded


class Refused(ValueError):
    """The axis is irregular: no spectrum, but the largest uniform range can be offered."""

    def __init__(self, offer: DataFrame):
        super().__init__("the axis is irregular; the samples are never resampled")
        self.offer = offer


def spectrum_of(df: DataFrame, ticks_per_second: int, value: str = "value", tick: str = "tick", order: str = "row_id", length: int | None = None, **options) -> DataFrame:
    """The spectrum a time axis allows: ``welch`` if uniform, ``welch_segmented`` if uniform between gaps, else ``Refused``."""
    summary = summarize(df, None, tick, order).first()
    if summary["sampling_class"] == "irregular":
        raise Refused(largest_uniform_range(df, None, tick, order))
    rate = ticks_per_second / summary["median_dt"]
    if summary["sampling_class"] == "uniform":
        return welch(df, rate, length, value, None, order, **options)
    marked = with_segments(df, None, tick, order)
    length = length or default_segment_length(marked.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0])
    return welch_segmented(marked, rate, length, value, "segment", None, order, **options)[0]


def clean_runs(df: DataFrame, value: str = "value", by: list[str] | None = None, order: str = "row_id") -> DataFrame:
    """Rows with a value, with ``segment``: stretches between missing values, as gaps split an axis."""
    marked = with_running_sum(df, is_missing(F.col(value).cast("double")).cast("int"), "segment", by, order)
    return marked.filter(~is_missing(F.col(value).cast("double")))


