"""Inference of a text file's shape (on its head) and of its columns' types (on every row)."""

from __future__ import annotations

import codecs
import csv
import io
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BudgetExceeded, EmptyFile, OpenError, SingleColumnFile  # noqa: F401
from ..functions import text as cells
from ..functions import timestamps

HEAD_BYTES = 1 << 20
#: Delimiters in the order in which they are tried; whitespace means runs of blanks.
DELIMITERS = (",", ";", "\t", "|", "whitespace")
HIGH, LOW = "high", "low"
csv.field_size_limit(2 * HEAD_BYTES)  # a cell may fill the head


@dataclass
class Sniff:
    encoding: str
    encoding_confidence: str
    delimiter: str
    delimiter_confidence: str
    decimal_separator: str
    decimal_confidence: str
    header: list[str]
    header_confidence: str
    data_start_row: int
    bom: int = 0
    row_bytes: float = 1.0
    before: list = field(default_factory=list)  # records before the data


@dataclass
class Overrides:
    delimiter: str | None = None
    decimal_separator: str | None = None
    timestamp_format: str | None = None
    empty_as_nan: bool = False
    extra: dict = field(default_factory=dict)


def detect_encoding(head: bytes) -> tuple[str, str, int]:
    """(encoding, confidence, bytes of its mark). A mark decides; else UTF-8 if at most one byte in a hundred is invalid."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if head.startswith(mark):
            return name, HIGH, len(mark)
    if head and head.count(0) * 4 >= len(head):  # UTF-16 of mostly Latin text has a zero in every other byte
        even, odd = head[::2].count(0), head[1::2].count(0)
        return ("utf-16le" if odd > even else "utf-16be"), LOW, 0
    bad = invalid_bytes(head)
    if bad * 100 <= len(head):
        return "utf-8", HIGH, 0
    return "windows-1252", LOW, 0


def invalid_bytes(head: bytes) -> int:
    """Bytes that are no part of a UTF-8 sequence; one cut off at the end doesn't count."""
    bad, at = 0, 0
    while at < len(head):
        try:
            head[at:].decode("utf-8")
            break
        except UnicodeDecodeError as e:
            if e.reason == "unexpected end of data" and at + e.end >= len(head):
                break
            bad += e.end - e.start
            at += e.end
    return bad


def aligned(head: bytes, whole: bool) -> bytes:
    """The head up to its last line end, unless it is the whole file."""
    if whole:
        return head
    cut = head.rfind(b"\n")
    return head[: cut + 1] if cut >= 0 else head


def records_of(text: str, delimiter: str) -> list[list[str]]:
    """Non-blank records, quotes and line ends in quotes respected."""
    if delimiter == "whitespace":
        return [line.split() for line in text.splitlines() if line.strip()]
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r and any(r) or len(r) > 1]


def infer_delimiter(text: str) -> tuple[str, str]:
    """The delimiter whose most frequent field count (at least two; the larger of equals) covers most records."""
    best, score = ",", 0.0
    for candidate in DELIMITERS:
        records = records_of(text, candidate)
        counts = Counter(len(r) for r in records)
        if not counts:
            continue
        width, many = max(counts.items(), key=lambda x: (x[1], x[0]))
        if width >= 2 and many / len(records) > score:
            best, score = candidate, many / len(records)
    return best, HIGH if score == 1.0 else LOW


def infer_decimal(records: list[list[str]]) -> tuple[str, str]:
    """A comma if strictly more cells look like comma decimals than like point decimals; a tie is of low confidence."""
    votes = Counter(m[1] for r in records for c in r if (m := re.fullmatch(r"-?\d+([.,])\d+", c.strip())))
    comma, point = votes[","], votes["."]
    return ("," if comma > point else "."), HIGH if comma != point else LOW


def _is_number(cell: str) -> bool:
    cell = cell.strip()
    return bool(re.fullmatch(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?(?:inf|infinity|nan)", cell, re.I)) or bool(re.fullmatch(r"-?\d+,\d+", cell))


def infer_header(records: list[list[str]]) -> tuple[list[str], str, int]:
    """(names, confidence, first data record). Records before the first with a data-like cell are preamble; its last one of the data's width is the header.

    The confidence is low only if there is a preamble and none of it has the data's width. Without a data record there are no names.
    """
    start = next((i for i, r in enumerate(records) if any(_is_number(c) or re.match(r"\d{4}-", c.strip()) for c in r)), len(records))
    width = len(records[start]) if start < len(records) else 0
    before = [i for i in range(start) if len(records[i]) == width]
    names = [c.strip() for c in records[before[-1]]] if before else [f"column_{i}" for i in range(width)]
    return names, LOW if start and not before else HIGH, start


def sniff(head: bytes, whole: bool, overrides: Overrides | None = None) -> Sniff:
    """Encoding, delimiter, decimal mark and header from the head of a file."""
    overrides = overrides or Overrides()
    if not head.strip(b"\x00\r\n \t\xff\xfe\xef\xbb\xbf"):
        raise EmptyFile
    encoding, encoding_confidence, bom = detect_encoding(head)
    body = head[bom:]
    text = (aligned(body, whole) if not encoding.startswith("utf-16") else body).decode(encoding.replace("windows-", "cp"), errors="replace")
    delimiter, delimiter_confidence = (overrides.delimiter, HIGH) if overrides.delimiter else infer_delimiter(text)
    records = records_of(text, delimiter)
    decimal, decimal_confidence = (overrides.decimal_separator, HIGH) if overrides.decimal_separator else infer_decimal(records)
    header, header_confidence, start = infer_header(records)
    if len(header) < 2:
        raise SingleColumnFile
    return Sniff(encoding, encoding_confidence, delimiter, delimiter_confidence, decimal, decimal_confidence, header, header_confidence, start, bom, len(body) / max(1, len(records)), records[:start])


def scan_dtypes(df: DataFrame, columns: list[str]) -> DataFrame:
    """series, dtype, ambiguous, n for text columns, all in one aggregate: bool, else i64, else f64, else string.

    A column without rows is a bool; a bool of only 0 and 1 is ambiguous.
    """
    flags = []
    for c in columns:
        cell = F.coalesce(F.col(c), F.lit(""))
        every = lambda test: F.coalesce(F.bool_and(F.coalesce(test, F.lit(False))), F.lit(True))
        flags.append(
            F.struct(
                every(cells.is_bool(cell)).alias("b"),
                every(cells.is_i64(cell)).alias("i"),
                every(cells.is_f64(cell)).alias("f"),
                (every(F.trim(cell).isin("0", "1")) & (F.count(F.lit(1)) > 0)).alias("z"),
                F.count(F.lit(1)).alias("n"),
            ).alias(c)
        )
    one = df.agg(*flags).unpivot([], columns, "series", "x")
    dtype = F.when(F.col("x.b"), "bool").when(F.col("x.i"), "i64").when(F.col("x.f"), "f64").otherwise("string")
    return one.select("series", dtype.alias("dtype"), (F.col("x.b") & F.col("x.z")).alias("ambiguous"), F.col("x.n").alias("n"))


def cast_column(name: str, dtype: str):
    c = F.col(name)
    return {"bool": cells.parse_bool(c), "i64": cells.parse_i64(c), "f64": cells.parse_f64(c), "string": F.coalesce(c, F.lit(""))}[dtype].alias(name)


def infer_timestamp_format(df: DataFrame, column: str) -> tuple[str | None, bool]:
    """(format, ambiguous) that every cell has, in two aggregates over all rows; None if there is none.

    Nine formats are tried in order; then slashed dates, where a first number above 12 means
    day first, a second above 12 month first, both nothing, neither day first but ambiguous.
    """
    cell = F.coalesce(F.col(column), F.lit(""))
    slashed = F.regexp_like(cell, F.lit(r"^\s*\d+\s*/\s*\d+\s*/"))
    first = F.regexp_extract(cell, r"^\s*(\d+)\s*/", 1).try_cast("bigint")
    second = F.regexp_extract(cell, r"^\s*\d+\s*/\s*(\d+)\s*/", 1).try_cast("bigint")
    # first the cheap shapes, then exact parsing for formats whose shape every cell has
    every = [*timestamps.FORMATS, *timestamps.SLASHED]
    shapes = [F.bool_and(timestamps.has_shape(cell, f)).alias(f) for f in every]
    row = df.agg(*shapes, F.bool_and(slashed).alias("slashed"), F.coalesce(F.bool_or(first > 12), F.lit(False)).alias("day_first"), F.coalesce(F.bool_or(second > 12), F.lit(False)).alias("month_first"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return None, False
    likely = [f for f in every if row[f]]
    fits = df.agg(*[F.bool_and(timestamps.matches(cell, f)).alias(f) for f in likely]).first().asDict() if likely else {}
    for f in timestamps.FORMATS:
        if fits.get(f):
            return f, f == "epoch_s" and bool(fits.get("labview_epoch"))
    if not row["slashed"] or row["day_first"] and row["month_first"]:
        return None, False
    fmt = "mm_dd_yyyy" if row["month_first"] else "dd_mm_yyyy"
    return (fmt, not (row["day_first"] or row["month_first"])) if fits.get(fmt) else (None, False)


def footprint(file_bytes: int, mean_row_bytes: float, columns: int, timestamp_bytes: int = 32) -> int:
    """Estimated bytes of a whole file in memory, before reading it."""
    rows = file_bytes / max(1.0, mean_row_bytes)
    return int(file_bytes + rows * (16 * columns + timestamp_bytes + 8 * (columns - 1)))


def budget(total_memory: int) -> int:
    """A quarter of the memory, at most 4 GiB."""
    return min(total_memory // 4, 4 << 30)


def affords(total_memory: int, needed: int) -> bool:
    return needed <= budget(total_memory)


def check_budget(total_memory: int, file_bytes: int, found: Sniff) -> None:
    """Refuses a file that would need more than the budget, before it is read."""
    needed = footprint(file_bytes, found.row_bytes, len(found.header))
    if not affords(total_memory, needed):
        raise BudgetExceeded(needed, budget(total_memory))

