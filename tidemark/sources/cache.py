"""Derived tables kept as Parquet: raw columns (level -1) and pyramids, keyed by what they come from.

A key covers path, size, time of change, column and overrides, so a changed file or another
reading of it has another key. Writes go through Spark's commit protocol; a table that
can't be read is built anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pyramid


def key(spark: SparkSession, path: str, column: str | None = None, overrides: object = None) -> str:
    """16 hexadecimal digits for a source as it is now. Files are hashed where they are listed; the driver sees one row."""
    meta = spark.read.format("binaryFile").load(path).select(F.xxhash64("path", "length", F.col("modificationTime").cast("string")).alias("h"))
    parts = tuple(meta.agg(F.count("h"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string")).first())
    return hashlib.sha256(repr((path, parts, column, overrides)).encode()).hexdigest()[:16]


def build_or_open(spark: SparkSession, place: str, build: Callable[[], DataFrame], partition: str | None = None) -> DataFrame:
    """The table at ``place``; built and written first if it isn't there or can't be read."""
    found = try_open(spark, place)
    if found is not None:
        return found
    writer = build().write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(place)
    return spark.read.parquet(place)


def try_open(spark: SparkSession, place: str) -> DataFrame | None:
    try:
        df = spark.read.parquet(place)
        df.limit(1).collect()
        return df
    except (PySparkException, OSError):
        return None
    except Exception as e:  # a damaged file surfaces as a JVM error of the scan
        if "parquet" in str(e).lower() or "footer" in str(e).lower():
            return None
        raise


def raw_columns(spark: SparkSession, folder: str, source_key: str, df: DataFrame, columns: list[str], tick: str = "tick", order: str = "row_id") -> DataFrame:
    """Ticks and values of ``columns``, each in its own type, sorted by row within files so that ranges prune."""
    return build_or_open(spark, f"{folder}/{source_key}/raw", lambda: df.select(order, tick, *columns).repartitionByRange(order).sortWithinPartitions(order))


def pyramids(spark: SparkSession, folder: str, source_key: str, df: DataFrame, columns: list[str], tick: str = "tick", order: str = "row_id") -> DataFrame:
    """Pyramids of ``columns`` from the cached raw columns, one folder a level."""
    raw = raw_columns(spark, folder, source_key, df, columns, tick, order)
    return build_or_open(spark, f"{folder}/{source_key}/pyramid", lambda: pyramid.of_dataset(raw, columns, tick, order), "level")
