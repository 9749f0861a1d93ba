"""Parquet files and partitioned folders as time series: the same axis and statistics as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import with_row_id
from .scratch import settle

FORMAT_LABEL = "parquet_timestamp"


def recognises(path: str, spark: SparkSession | None = None) -> bool:
    """A path ending in .parquet or, where a session can look, a folder with Parquet files in it or in its partitions."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return True
    if spark is None or "." in path.rstrip("/").rsplit("/", 1)[-1]:
        return False
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place) or not system.getFileStatus(place).isDirectory():
        return False
    files = system.listFiles(place, True)
    while files.hasNext():
        if files.next().getPath().getName().lower().endswith(".parquet"):
            return True
    return False


def read_series(spark: SparkSession, path: str, time: str | None = None, order: list[str] | None = None) -> DataFrame:
    """row_id, tick (microseconds for timestamps) and the other columns.

    ``time``: the axis, by default the first timestamp column. Rows are numbered as they stand:
    by file name, then by place in the file; they are never sorted by time unasked, so steps back and
    repeats of the axis stay what they are. ``order`` (a unique key) numbers them otherwise. NULL in a numeric
    column is a missing value, as NaN is. Types are kept; FLOAT and small integers are promoted where used.
    """
    df = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    stamps = (T.TimestampType, T.TimestampNTZType, T.DateType)
    time = time or next((n for n, t in kinds.items() if isinstance(t, stamps)), df.columns[0])
    tick = F.unix_micros(F.col(time).cast("timestamp")) if isinstance(kinds[time], stamps) else F.col(time)
    data = [c for c in df.columns if c not in (time, "row_id", "tick")]
    if order:
        return with_row_id(df.withColumn("tick", tick), order).select("row_id", "tick", *data)
    placed = df.select(tick.alias("tick"), *data, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = placed.groupBy("__file").agg((F.max("__row") + 1).alias("n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    files = settle(files.select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")), "files")  # a row a file
    return placed.join(files, "__file").select((F.col("__before") + F.col("__row")).alias("row_id"), "tick", *data)
