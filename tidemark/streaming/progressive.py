"""Progressive loading: a growing source's pyramid and statistics, kept up to date batch by batch.

A Structured Streaming query reads new rows (numbered on by the source) and ``foreachBatch``
merges their buckets into the pyramid table: only what the batch adds and the partial last
bucket of a level change. State is the table itself, written under a new name each batch,
then entered with its rows in a list of versions, which is read when a state is made: so a restart goes on from
the last version entered, and a repeated batch after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import OpenError
from ..operators import pyramid

FIRST_ROWS = 20_000


def checkpoints(total: int, first: int = FIRST_ROWS) -> Iterator[int]:
    """Row counts at which a prefix is shown: the first, then twice as many, at last all."""
    n = first
    while n < total:
        yield n
        n *= 2
    yield total


def load_progressive(df: DataFrame, total: int, show: Callable[..., None], first: int = FIRST_ROWS, order: str = "row_id", prepare: Callable[[DataFrame], object] | None = None) -> int:
    """Calls ``show(prefix, rows)`` at every checkpoint, or ``show(prepare(prefix), rows)``. Returns how many were shown.

    A prefix that ``prepare`` can't open (``OpenError``) is left out, if it isn't the whole; any other error is the caller's to see. ``df``
    should be a stored table, as each checkpoint reads its prefix.
    """
    shown = 0
    for n in checkpoints(total, first):
        prefix = df.filter(F.col(order) < n)
        try:
            ready = prepare(prefix) if prepare else prefix
        except OpenError:
            if n == total:
                raise
            continue
        show(ready, n)
        shown += 1
    return shown


class PyramidState:
    """The pyramid of a growing series, stored under ``folder``; one table a version."""

    def __init__(self, spark: SparkSession, folder: str, value: str = "value", tick: str = "tick", order: str = "row_id"):
        self.spark, self.folder, self.value, self.tick, self.order = spark, folder.rstrip("/"), value, tick, order
        self.rows, self.version = 0, None
        try:
            last = spark.read.schema("version long, rows long").parquet(f"{self.folder}/versions").agg(F.max(F.struct("version", "rows"))).first()[0]
        except AnalysisException:  # nothing entered yet
            return
        if last is not None:
            self.version, self.rows = last["version"], last["rows"]

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{self.version}")

    def merge(self, batch: DataFrame, version: int) -> None:
        """Takes in rows numbered from ``self.rows`` on; a version already taken in is left as it is."""
        if self.version is not None and version <= self.version:
            return
        new = batch.filter(F.col(self.order) >= self.rows)
        top = new.agg(F.max(self.order)).first()[0]
        if top is None:
            return
        if self.rows == 0:
            out = pyramid.build(new, self.value, None, self.tick, self.order, top + 1)
        else:
            out = pyramid.extend(self.table(), new, self.value, self.rows, None, self.tick, self.order)
        out.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        entry = self.spark.createDataFrame([(version, top + 1)], "version long, rows long")
        entry.coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        self.rows, self.version = top + 1, version


def stream_pyramid(source: DataFrame, state: PyramidState, checkpoint: str):
    """Starts the streaming query that keeps ``state`` up to date; take all available rows, then stop."""
    return source.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Generations:
    """Results of an older request are dropped: each request has a generation, and only the latest counts."""

    def __init__(self, spark: SparkSession):
        self.spark, self.current = spark, 0

    def begin(self, description: str = "") -> int:
        """A new generation; jobs of the one before are cancelled."""
        context = self.spark.sparkContext
        context.cancelJobGroup(f"generation-{self.current}")
        self.current += 1
        context.setJobGroup(f"generation-{self.current}", description, True)
        return self.current

    def is_current(self, generation: int) -> bool:
        return generation == self.current
