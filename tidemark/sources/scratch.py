"""Tables between steps, as Parquet in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only in local mode may it be unset, then it is a temporary folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(place)
    return f"{place.rstrip('/')}/tidemark"


def new_place(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back: a step that several later ones read is worked out once, survives lost executors, and has a size the planner knows."""
    spark, place = df.sparkSession, new_place(df.sparkSession, label)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)
