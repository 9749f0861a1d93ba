"""Shared helpers: tables, scratch storage, words and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of anything but the ASCII white space space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Whole texts handed to Python at once, at most, in jobs whose result is stored.
ARROW_ROWS = 2000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only in local mode, where all tasks run on the driver's machine, an unset one is set to
    a temporary folder. On a cluster it must be set: a folder of one machine would hold
    only what that machine's tasks wrote.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, label: str, packed: bool = False, by: str | None = None, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    This cuts the lineage at a place that survives the loss of executors, and gives the
    planner the real size, so it broadcasts the table only below the session's threshold.
    Shuffle files of the job go when it ends (Spark 4.1; before that, when the driver collects its plan). ``packed`` compresses harder;
    ``by`` partitions the table by a column; ``rows_a_file`` bounds files of large rows. The returned
    table's ``discard(part)`` deletes it, or one partition folder, once no later step reads
    it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd") if packed else df.write
    if rows_a_file:
        writer = writer.option("maxRecordsPerFile", rows_a_file)
    rows = int(spark.conf.get(_ARROW))
    rows = min(ARROW_ROWS, rows) if rows > 0 else ARROW_ROWS
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(spark, _ARROW, str(rows)):
        (writer.partitionBy(by) if by else writer).parquet(path)
    fields = [f for f in df.schema.fields if f.name != by] + [f for f in df.schema.fields if f.name == by]
    out = spark.read.schema(StructType(fields)).parquet(path).select(*df.columns)
    out.discard = lambda part="": _delete(spark, path + part)
    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Jobs run inside have another value of a runtime setting."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def one_by_one(spark: SparkSession):
    """Jobs run inside hand rows to Python one at a time: for tables whose rows are large."""
    return setting(spark, _ARROW, "1")


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def size_hint(df: DataFrame) -> int:
    """Bytes of the input as the planner sees them (file sizes for Parquet)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(size, 1 << 50)


def power_of_two(x: float, least: int) -> int:
    return max(least, 1 << max(0, int(np.ceil(np.log2(max(1.0, x))))))


def held_out(df: DataFrame, column: str, modulus: int, remainder: int) -> Column:
    """The hold-out rule: crc32 of the id's decimal text, modulo, is the remainder. A row with a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class WordHash(dict):
    """bytes -> 64-bit hash, computed once per distinct word; emptied when large."""

    limit = 250_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of one whole text, A-Z in lower case. bytes.split() splits on exactly WORD's white space."""
    return text.lower().split() if text else []


def mix(a: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    a = a ^ (a >> np.uint64(32))
    a = a * np.uint64(0xD6E8FEB86659FD93)
    a = a ^ (a >> np.uint64(32))
    a = a * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ranges(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (many[0] numbers), then the same of the others."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - many), many)


def narrow(x: np.ndarray | bytes) -> bytes | np.ndarray:
    """Whole numbers below 2^32 as bytes of the narrowest type that holds all of them, whose width comes first; from bytes, the numbers."""
    if isinstance(x, bytes):
        return np.frombuffer(x, f"<u{x[0]}", -1, 8)
    most = int(x.max()) if len(x) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + bytes(7) + np.asarray(x).astype(f"<u{width}").tobytes()
