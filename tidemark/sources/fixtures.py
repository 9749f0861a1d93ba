"""Bulk test series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a time stamp and of a value with its comma, on average.
STAMP_BYTES, VALUE_BYTES = 24, 12


def wave_table(spark: SparkSession, rows: int, channels: int = 8, seed: int = 1) -> DataFrame:
    """timestamp (ISO 8601 with milliseconds, one a millisecond) and ``channels`` uniform columns in +-1000 with six decimals."""
    millis = F.lit(1_700_000_000_000) + F.col("id")
    stamp = F.concat(F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return spark.range(rows).select(stamp.alias("timestamp"), *[F.round(F.rand(seed + k) * 2000 - 1000, 6).alias(f"ch{k}") for k in range(channels)])


def write_waves(spark: SparkSession, path: str, target_bytes: int, channels: int = 8, seed: int = 1) -> int:
    """One CSV file of about ``target_bytes`` at ``path``, with a header; returns its rows."""
    rows = max(1, target_bytes // (STAMP_BYTES + 1 + channels * VALUE_BYTES))
    table = wave_table(spark, rows, channels, seed)
    cells = F.concat_ws(",", "timestamp", *[F.format_string("%.6f", f"ch{k}") for k in range(channels)])
    header = spark.range(1).select(F.lit(",".join(table.columns)).alias("value"))
    # one file, as a logger writes it: the parts are in order, so they are only put end to end
    header.unionByName(table.select(cells.alias("value"))).coalesce(1).write.text(path + ".parts")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path + ".parts")
    system = folder.getFileSystem(conf)
    part = next(f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    system.rename(part, jvm.org.apache.hadoop.fs.Path(path))
    system.delete(folder, True)
    return rows
