"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written
as Parquet and read again as the next one's docs. Corpus statistics of a stage are those of
the documents its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, mixing, pii, quality
from tidemark.llm.base import settle, table

#: Not expressible in SQL: the classifier and the span classifier are trained.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", modulus=5, held_out=0)
    # under other names, so a column called score or predicted comes through
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    scored = quality.apply(docs.withColumnsRenamed(names), net, list(names.values()), text_col=names["text"], threshold=0.3)
    return scored.filter("predicted = 1").select(*[F.col(n).alias(c) for c, n in names.items()])


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group linked by word shingles."""
    return jaccard.keep_one(docs, size=5, percent=75)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's question and answer."""
    marked = docs.withColumn("__hash", F.xxhash64("text"))
    leaks = decontaminate.contaminated(marked, table(spark, sf_dir, "benchmark"), ["doc_id", "__hash"], edited=True)
    leaks = settle(leaks.select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__leak")).distinct(), "leaks")
    return marked.join(leaks, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__leak")), "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many."""
    return mixing.mix(docs, weights=(5, 2, 1), max_repeat=3).filter("taken > 0")


STAGES = [
    ("quality", keep_quality),
    ("near duplicates", keep_one_of_similar),
    ("decontamination", drop_leaks),
    ("personal data", hide_personal_data),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
