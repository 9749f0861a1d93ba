"""Bounded, repeatable samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out as held


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text", largest: int | None = None) -> list[tuple[bytes, int]]:
    """At most ``most`` labelled training rows as (text bytes, label), by a hash of the id.

    Rows whose crc32(id) mod ``modulus`` is ``held_out`` and rows without a label are never
    taken; an id with several labels has its largest. ``most_bytes`` bounds the texts together: rows are taken in
    hash order until it is reached, each whole. Texts of more than ``largest`` characters (an eighth
    of ``most_bytes`` unless given) are not taken. These three parameters are the only bound in
    fitting: labels of ids without such a row in ``docs`` take no place.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull()).filter(~held(labels, id_col, modulus, held_out))
    known = known.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("__label")).withColumn("__order", F.xxhash64(F.col(id_col).cast("string")))
    size = F.length(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__text"), size.alias("__size")).filter(F.col(id_col).isNotNull() & (F.col("__size") <= (most_bytes // 8 if largest is None else largest)))
    chosen = known.join(rows.select(id_col), id_col, "left_semi").orderBy("__order", id_col).limit(most)
    found, taken = [], 0
    for row in rows.join(F.broadcast(chosen), id_col).orderBy("__order", "__text").limit(most).toLocalIterator():
        taken += len(row["__text"])
        if taken > most_bytes:
            break
        found.append((bytes(row["__text"]), int(row["__label"] > 0)))
    return found
