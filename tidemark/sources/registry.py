"""Which reader takes a path, and how it opens it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..errors import UnrecognizedFormat
from . import parquet, text


@dataclass
class Reader:
    """``open(spark, path, overrides)`` gives an ``Opened``; None for the two formats that ``plans.report`` opens itself."""

    name: str
    recognises: Callable[[str, SparkSession | None], bool]
    open: Callable | None = None


_READERS: list[Reader] = [Reader("csv", lambda path, spark: text.recognises(path)), Reader("parquet", parquet.recognises)]


def register(name: str, recognises: Callable[[str, SparkSession | None], bool], open: Callable) -> None:
    """Adds a reader, asked after those before it; one of the same name takes its place."""
    _READERS[:] = [r for r in _READERS if r.name != name] + [Reader(name, recognises, open)]


def reader_of(path: str, spark: SparkSession | None = None) -> Reader:
    for reader in _READERS:
        if reader.recognises(path, spark):
            return reader
    raise UnrecognizedFormat(path)


def route(path: str, spark: SparkSession | None = None) -> str:
    return reader_of(path, spark).name
