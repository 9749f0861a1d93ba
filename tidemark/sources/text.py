"""Messy delimited text as DataFrames: any supported encoding, quotes, line ends in quotes, ragged rows.

Lines are read in splits and carry their place: a split's first line number is the sum of
the lines of the splits before it, so order needs no sort and lines aren't shuffled. windows-1252 is read as single bytes and
mapped, so it is read in splits as UTF-8 is; only UTF-16 is decoded in one task a file (and
up to 2 GiB). Quotes are counted line by line; where a line leaves a quote open, lines are joined
to records by the parity of a running quote count, which is summed chunk by chunk. Records are split once and stored, then numbered.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SingleColumnFile, Unreadable
from ..functions.text import normalize_decimal
from ..operators.rows import with_position, with_running_sum
from ..plans import infer
from .scratch import settle

#: Extensions that are read as delimited text.
EXTENSIONS = ("csv", "tsv", "txt")


def recognises(path: str) -> bool:
    return path.rsplit(".", 1)[-1].lower() in EXTENSIONS and "." in path.rsplit("/", 1)[-1]


def head_of(spark: SparkSession, path: str, most: int = infer.HEAD_BYTES) -> tuple[bytes, int]:
    """The first bytes of a file and its size, through Spark's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise Unreadable(f"could not read {path}: no such file")
    status = system.getFileStatus(place)
    if status.isDirectory():
        raise Unreadable(f"could not read {path}: a directory is no delimited file")
    size = status.getLen()
    stream = system.open(place)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(min(size, most)))), size
    finally:
        stream.close()


def sniff(spark: SparkSession, path: str, overrides: infer.Overrides | None = None) -> infer.Sniff:
    head, size = head_of(spark, path)
    return infer.sniff(head, len(head) == size, overrides)


#: What the bytes 0x80 to 0x9F are in windows-1252 (U+FFFD: nothing).
_HIGH = "".join(bytes([b]).decode("cp1252", "replace") for b in range(0x80, 0xA0))
_LOW = "".join(map(chr, range(0x80, 0xA0)))


def _lines(spark: SparkSession, path: str, found: infer.Sniff) -> DataFrame:
    """line_id (increasing in file order) and line."""
    if found.encoding in ("utf-8", "windows-1252"):
        # ids rise within a split, and splits of one file are ordered by their start
        df = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
        blocks = df.groupBy("__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("n"))
        line = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        # one row a split
        blocks = settle(blocks.select("__block", (F.coalesce(F.sum("n").over(line), F.lit(0)) - F.col("__first")).alias("__shift")), "blocks")
        numbered = df.join(blocks, "__block").select((F.col("__id") + F.col("__shift")).alias("line_id"), "line")
        if found.encoding == "windows-1252":
            # the reader keeps a line's bytes as they are
            numbered = numbered.withColumn("line", F.translate(F.decode(F.col("line").cast("binary"), "ISO-8859-1"), _LOW, _HIGH))
        if found.bom:
            numbered = numbered.withColumn("line", F.when(F.col("line_id") == 0, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))
        return numbered

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = found.encoding
        for batch in batches:
            for content in batch.column(0):
                data, at = content.as_py()[found.bom :], 0
                decoder, rest = codecs.getincrementaldecoder(codec)(errors="replace"), ""
                for a in range(0, max(1, len(data)), 1 << 18):
                    rest += decoder.decode(data[a : a + (1 << 18)], a + (1 << 18) >= len(data))
                    *lines, rest = rest.replace("\r\n", "\n").split("\n")
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["line_id", "line"])
                    at += len(lines)
                if rest:
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([rest], pa.string())], names=["line_id", "line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "line_id bigint, line string")


def _records(lines: DataFrame, delimiter: str) -> DataFrame:
    """record_id and record: lines joined where a quote is open at their end."""
    if delimiter == "whitespace":
        return lines.select(F.col("line_id").alias("record_id"), F.col("line").alias("record"))
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    counted = lines.withColumn("__quotes", quotes)
    if not counted.filter(F.col("__quotes") % 2 == 1).take(1):
        return lines.select(F.col("line_id").alias("record_id"), F.col("line").alias("record"))
    summed = with_running_sum(counted, F.col("__quotes") % 2, "open_", order="line_id")
    starts = (F.col("open_") - F.expr("(length(line) - length(replace(line, '\"', ''))) % 2")) % 2 == 0
    grouped = with_running_sum(summed, starts.cast("int"), "record_id", order="line_id")
    pieces = F.array_sort(F.collect_list(F.struct("line_id", "line")))
    return grouped.groupBy("record_id").agg(F.array_join(F.transform(pieces, lambda x: x["line"]), "\n").alias("record"))


def split_fields(record: str, delimiter: str):
    """Fields of a record as a column: quoted ones without their quotes, doubled quotes as one. The patterns are possessive, so a cell of any length is matched without recursion."""
    text = F.col(record)
    if delimiter == "whitespace":
        return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    d = "\\" + delimiter if delimiter in "|.^$*+?()[]{}\\" else delimiter
    plain = F.split(text, d, -1)
    found = F.regexp_extract_all(text, F.lit(rf'(?:^|{d})("(?:[^"]++|"")*+"?[^{d}]*+|[^{d}]*+)'), F.lit(1))
    unquoted = F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, r'^"((?:[^"]++|"")*+)"?', "$1"), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(F.contains(text, F.lit('"')), unquoted).otherwise(plain)


@dataclass
class Scan:
    """``rows``: source_row and c0 .. cN-1 as text; ``skipped``: source_row, skip_reason; ``sniff``: what was inferred."""

    rows: DataFrame
    skipped: DataFrame
    sniff: infer.Sniff


def scan(spark: SparkSession, path: str, overrides: infer.Overrides | None = None) -> Scan:
    """All rows of a file as text columns; records before the data, blank ones and ragged ones apart.

    Columns are named c0, c1, ...; the header's names, which may repeat or be empty, are in
    each field's metadata as ``label``.
    """
    found = sniff(spark, path, overrides)
    parsed, width = _parsed(spark, path, found), len(found.header)
    numbered = _numbered(parsed, found.data_start_row)
    marked = numbered.withColumn("skip_reason", F.when(F.size("f") != width, F.lit("ragged")))
    cells = [normalize_decimal(F.col("f")[i], found.decimal_separator if i else ".").alias(f"c{i}", metadata={"label": found.header[i]}) for i in range(width)]
    return Scan(marked.filter("skip_reason is null").select("source_row", *cells), marked.filter("skip_reason is not null").select("source_row", "skip_reason"), found)


def _parsed(spark: SparkSession, path: str, found: infer.Sniff) -> DataFrame:
    """record_id and f (fields) of every record that isn't blank, stored."""
    if found.delimiter == "":
        raise SingleColumnFile
    try:
        records = _records(_lines(spark, path, found), found.delimiter)
        blank = F.trim(F.regexp_replace("record", r"[\r\n]", "")) == ""
        return settle(records.filter(~blank).select("record_id", split_fields("record", found.delimiter).alias("f")), "records")
    except PySparkException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise Unreadable(f"could not read {path}: no such file") from e
        raise


def counts(spark: SparkSession, path: str, overrides: infer.Overrides | None = None) -> tuple[int, int]:
    """(rows, skipped rows): a parse that keeps no values and numbers nothing."""
    found = sniff(spark, path, overrides)
    records = _records(_lines(spark, path, found), found.delimiter)
    blank = F.trim(F.regexp_replace("record", r"[\r\n]", "")) == ""
    fits = F.size(split_fields("record", found.delimiter)) == len(found.header)
    fitting, every = records.filter(~blank).agg(F.count_if(fits), F.count(F.lit(1))).first()
    # records before the data are known from the head
    before = [len(r) == len(found.header) for r in found.before]
    return fitting - sum(before), every - len(before) - (fitting - sum(before))


def _numbered(fields: DataFrame, start: int) -> DataFrame:
    """source_row: the place among non-blank records, counted from the first data record."""
    first, last, n = fields.agg(F.min("record_id"), F.max("record_id"), F.count(F.lit(1))).first()
    if n and last - first + 1 == n:  # no number is left out, so none has to be given
        placed = fields.withColumn("source_row", F.col("record_id") - F.lit(first + start))
    else:
        placed = with_position(fields, order="record_id", name="__at", rows="__of").withColumn("source_row", F.col("__at") - F.lit(start))
    return placed.filter("source_row >= 0").drop("__at", "__of", "record_id")
