"""Parsing of single text cells as column expressions: stricter than Spark's casts, and exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_WORDY = r"^[+-]?(?:inf|infinity|nan)$"
_COMMA = r"^-?[0-9]+,[0-9]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def is_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "false", "0", "1"), F.lit(False))


def parse_bool(text: Column) -> Column:
    """true/false in any case and 1/0 only; null otherwise (Spark's cast also takes t, y, yes)."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "1"), F.lit(True)).when(t.isin("false", "0"), F.lit(False))


def is_i64(text: Column) -> Column:
    t = F.trim(text)
    # up to 18 digits always fit; only longer ones are tried
    return F.regexp_like(t, F.lit(r"^[+-]?[0-9]{1,18}$")) | F.coalesce(parse_i64(text).isNotNull(), F.lit(False))


def is_f64(text: Column) -> Column:
    """Whether ``parse_f64`` gives a number."""
    t = F.trim(text)
    return F.regexp_like(t, F.lit(_FLOAT)) | F.regexp_like(F.lower(t), F.lit(_WORDY))


def parse_i64(text: Column) -> Column:
    """Trimmed decimal integers within BIGINT, a leading + allowed; null otherwise."""
    t = F.trim(text)
    return F.when(F.regexp_like(t, F.lit(_INT)), t.try_cast("bigint"))


def parse_f64(text: Column) -> Column:
    """Trimmed decimal numbers, exponents, inf/infinity/nan in any case with a sign; null otherwise (no 1d, no 1.5f)."""
    t = F.trim(text)
    low = F.lower(t)
    wordy = F.when(low.contains("nan"), F.lit(float("nan"))).when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(F.regexp_like(low, F.lit(_WORDY)), wordy).when(F.regexp_like(t, F.lit(_FLOAT)), t.try_cast("double"))


def normalize_decimal(text: Column, separator: str) -> Column:
    """With a decimal comma, a cell that is a comma decimal as a whole gets a point; any other stays as it is."""
    if separator != ",":
        return text
    t = F.trim(text)
    return F.when(F.regexp_like(t, F.lit(_COMMA)), F.replace(t, F.lit(","), F.lit("."))).otherwise(text)


def promote(value: Column) -> Column:
    """A numeric value as DOUBLE (integers beyond 2^53 are rounded; ``anomaly.precision_loss`` counts them)."""
    return value.cast("double")


def view_kind(dtype: str) -> str:
    """How a column of the dtype is shown."""
    return "state_timeline" if dtype in ("bool", "string") else "time_domain"


def unit_label(header: str) -> str | None:
    """The unit in a header such as ``Temp [°C]``, verbatim."""
    low, high = header.rfind("["), header.rfind("]")
    return header[low + 1 : high] if 0 <= low < high else None
