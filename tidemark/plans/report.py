"""Opening a file: rows with typed columns and an exact axis, a summary, and every guess with its confidence."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as cells
from ..functions import timestamps
from ..operators import timestats
from ..errors import InvalidTimestamp
from ..operators.rows import with_position
from ..sources import parquet, registry, text
from ..sources.scratch import settle
from ..streaming import progressive
from . import infer

log = logging.getLogger("tidemark")


@dataclass
class Summary:
    encoding: str
    delimiter: str
    decimal_separator: str
    time_column: str
    timestamp_format: str
    row_count: int
    skipped_row_count: int
    sampling_class: str
    gap_count: int
    non_monotonic: int
    duplicate_timestamp: int
    columns: list[str]
    dtypes: list[str]


@dataclass
class Report:
    """Confidence of every inference: high or low."""

    encoding: str
    delimiter: str
    decimal_separator: str
    header: str
    time_column: str
    timestamp_format: str
    columns: dict[str, str] = field(default_factory=dict)

    def has_low(self) -> bool:
        return any(v == infer.LOW for v in [self.encoding, self.delimiter, self.decimal_separator, self.header, self.time_column, self.timestamp_format, *self.columns.values()])


@dataclass
class Opened:
    rows: DataFrame  # row_id, tick, offset_seconds, c1 .. cN-1
    skipped: DataFrame  # source_row, skip_reason
    summary: Summary
    report: Report
    axis_unit: str
    axis: str  # absolute, progressive or ordinal


def open_text(spark: SparkSession, path: str, overrides: infer.Overrides | None = None, memory: int | None = None) -> Opened:
    """``memory``: bytes of the machine that will hold the values; a file beyond its budget is refused before it is read."""
    overrides = overrides or infer.Overrides()
    if memory is not None:
        infer.check_budget(memory, text.head_of(spark, path, 0)[1], text.sniff(spark, path, overrides))
    found, raw, columns = _raw(spark, path, overrides)
    return _typed(found, raw, columns, overrides)


def _raw(spark: SparkSession, path: str, overrides: infer.Overrides) -> tuple[text.Scan, DataFrame, list[str]]:
    """All rows as text, numbered and stored: the second pass reads this, not the file."""
    found = text.scan(spark, path, overrides)
    if found.skipped.take(1):
        raw = with_position(found.rows, order="source_row", name="row_id", rows="rows_").drop("rows_")
    else:  # nothing is left out, so rows are numbered already
        raw = found.rows.withColumn("row_id", F.col("source_row"))
    columns = [c for c in raw.columns if c not in ("source_row", "row_id")]
    if overrides.empty_as_nan:
        raw = raw.withColumns({c: F.when(F.trim(c) == "", F.lit("NaN")).otherwise(F.col(c)) for c in columns[1:]})
    return found, settle(raw, "raw"), columns


def open_progressive(spark: SparkSession, path: str, show: Callable[[Opened, int], None], overrides: infer.Overrides | None = None, first: int = progressive.FIRST_ROWS) -> Opened:
    """Opens a text file prefix by prefix, each twice as long as the one before: ``show(opened, rows)`` gets the prefix's rows, types, summary and report.

    A prefix that can't be opened alone is left out; what ``show`` raises is not caught. Returns the whole file's.
    """
    overrides = overrides or infer.Overrides()
    found, raw, columns = _raw(spark, path, overrides)
    whole: list[Opened] = []

    def shown(opened: Opened, rows: int) -> None:
        whole[:] = [opened]
        show(opened, rows)

    progressive.load_progressive(raw, raw.count(), shown, first, prepare=lambda prefix: _typed(found, prefix, columns, overrides))
    return whole[0] if whole else _typed(found, raw, columns, overrides)


def _typed(found: text.Scan, raw: DataFrame, columns: list[str], overrides: infer.Overrides) -> Opened:
    time, data = columns[0], columns[1:]
    dtypes = {r["series"]: r for r in infer.scan_dtypes(raw, data).collect()}  # one row a column
    fmt, ambiguous = (overrides.timestamp_format, False) if overrides.timestamp_format else infer.infer_timestamp_format(raw, time)
    values = [infer.cast_column(c, dtypes[c]["dtype"]) for c in data]
    axis, unit, format_confidence = "absolute", "ns", infer.LOW if ambiguous else infer.HIGH
    if fmt:
        parsed = timestamps.parse(F.coalesce(F.col(time), F.lit("")), fmt)
        # stored with its values in their types, so cells are parsed once
        with_time = settle(raw.select("row_id", parsed.alias("parsed"), *values), "typed")
        values = data
        checks = with_time.agg(F.count_if(F.col("parsed").isNull()).alias("bad"), *[F.coalesce(F.bool_or(F.col("parsed.unit") == u), F.lit(False)).alias(u) for u in timestamps.DIGITS]).first()
        if checks["bad"]:
            raise InvalidTimestamp(checks["bad"], fmt)
        unit = next((u for u in ("ps", "ns", "us", "ms", "s") if checks[u]), "ns")
        tick, offset = timestamps.in_unit(F.col("parsed"), unit), F.col("parsed.offset_seconds")
        if unit != "ps":
            tick = tick.cast("bigint")
    else:
        with_time, offset = raw, F.lit(None).cast("int")
        numbers = raw.agg(F.coalesce(F.bool_and(cells.parse_f64(F.coalesce(F.col(time), F.lit(""))).isNotNull()), F.lit(False))).first()[0]
        if numbers:
            axis, tick = "progressive", timestamps.progressive_ticks(cells.parse_f64(F.col(time)))
        else:
            axis, tick, format_confidence = "ordinal", F.col("row_id"), infer.LOW
    typed = with_time.select("row_id", tick.alias("tick"), offset.alias("offset_seconds"), *values)
    if axis == "absolute":
        stats = timestats.summarize(typed).first()
        facts = (stats["sampling_class"], stats["gap_count"], stats["non_monotonic"], stats["duplicate_timestamp"]) if stats and stats["n"] else ("uniform", 0, 0, 0)
    else:
        facts = ("progressive_index", 0, 0, 0)
    s = found.sniff
    labels = {c: s.header[int(c[1:])] for c in columns}
    summary = Summary(s.encoding, "WS" if s.delimiter == "whitespace" else s.delimiter, s.decimal_separator, labels[time], fmt or "none", raw.count(), found.skipped.count(), *facts, [labels[c] for c in data], [dtypes[c]["dtype"] for c in data])
    report = Report(s.encoding_confidence, s.delimiter_confidence, s.decimal_confidence, s.header_confidence, infer.LOW if axis == "ordinal" else s.header_confidence, format_confidence, {c: infer.LOW if dtypes[c]["ambiguous"] else infer.HIGH for c in data})
    for name, confidence in asdict(report).items():
        if confidence == infer.LOW:
            log.warning("low confidence: %s", name)
    if summary.skipped_row_count:
        log.warning("%d rows skipped", summary.skipped_row_count)
    return Opened(typed, found.skipped, summary, report, unit if axis == "absolute" else "ns", axis)


def inspect(spark: SparkSession, path: str, overrides: infer.Overrides | None = None) -> Summary:
    """The summary alone, of any registered format."""
    return open_path(spark, path, overrides).summary


def open_path(spark: SparkSession, path: str, overrides: infer.Overrides | None = None, memory: int | None = None) -> Opened:
    """Any registered format. ``overrides`` settle an inference at high confidence; opening again with others is the correction."""
    reader = registry.reader_of(path, spark)
    if reader.open:
        return reader.open(spark, path, overrides)
    return open_text(spark, path, overrides, memory) if reader.name == "csv" else open_parquet(spark, path)


def open_parquet(spark: SparkSession, path: str) -> Opened:
    rows = parquet.read_series(spark, path)
    stats = timestats.summarize(rows).first()
    data = [c for c in rows.columns if c not in ("row_id", "tick")]
    kinds = [{"boolean": "bool", "string": "string", "bigint": "i64", "double": "f64"}.get(t, t) for n, t in rows.dtypes if n in data]
    summary = Summary("n/a", "n/a", "n/a", "timestamp", parquet.FORMAT_LABEL, stats["n"], 0, stats["sampling_class"], stats["gap_count"], stats["non_monotonic"], stats["duplicate_timestamp"], data, kinds)
    high = infer.HIGH
    return Opened(rows, rows.filter("false").select(F.col("row_id").alias("source_row"), F.lit("").alias("skip_reason")), summary, Report(high, high, high, high, high, high, dict.fromkeys(data, high)), "us", "absolute")


def corrections(opened: Opened) -> dict[str, list[str]]:
    """What a user may choose instead, for every inference of low confidence."""
    out: dict[str, list[str]] = {}
    if opened.report.delimiter == infer.LOW:
        out["delimiter"] = list(infer.DELIMITERS)
    if opened.report.decimal_separator == infer.LOW:
        out["decimal_separator"] = [".", ","]
    if opened.report.timestamp_format == infer.LOW:
        swapped = swap_day_and_month(opened.summary.timestamp_format)
        out["timestamp_format"] = [swapped] if swapped else [*timestamps.FORMATS, *timestamps.SLASHED]
    return out


def swap_day_and_month(fmt: str) -> str | None:
    """The other reading of a slashed date; None for other formats."""
    return {"dd_mm_yyyy": "mm_dd_yyyy", "mm_dd_yyyy": "dd_mm_yyyy"}.get(fmt)
