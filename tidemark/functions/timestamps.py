"""Exact timestamps: text <-> (ticks DECIMAL(38,0), unit, offset_seconds), as column expressions.

Spark's TIMESTAMP keeps microseconds only, so it is never used for ticks. Times are UTC
instants; calendar arithmetic is done on days, hours and digits, so no session time zone
matters. Ticks are nanoseconds, or picoseconds where more than nine fraction digits (or an
epoch in nanoseconds with a fraction) ask for them; epoch integers keep their own unit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Format labels, in the order in which inference tries them, then the two day/month forms.
FORMATS = ("iso8601", "iso8601_naive", "datetime_space", "epoch_ns", "epoch_us", "epoch_ms", "epoch_s", "labview_epoch", "excel_serial")
SLASHED = ("dd_mm_yyyy", "mm_dd_yyyy")
#: Fraction digits of each unit, and the offsets of two epochs.
DIGITS = {"s": 0, "ms": 3, "us": 6, "ns": 9, "ps": 12}
LABVIEW_SECONDS, EXCEL_DAYS, DAY = 2_082_844_800, 25_569, 86_400
#: Whole Unix seconds that an epoch column may plausibly hold.
PLAUSIBLE = (1_000_000_000, 10_000_000_000)
#: Nanoseconds of 64 bits end here.
_NANO_SECONDS = 9_223_372_036

_DATED = {
    "iso8601": r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?([Zz]|[+-]\d{2}:\d{2})$",
    "iso8601_naive": r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?()$",
    "datetime_space": r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?()$",
    "dd_mm_yyyy": r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2}):(\d{2})()()$",
    "mm_dd_yyyy": r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2}):(\d{2})()()$",
}
#: Formats that name a calendar date.
DATED = tuple(_DATED)
#: Stands in no time stamp.
_MARK = "\u0001"
_NUMBER = r"^([+-]?)(\d+)(?:\.(\d*))?$"
_BIG = "decimal(38,0)"


def _big(x: Column | int) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast(_BIG)


def _fraction(digits: Column, n: int) -> Column:
    """The first ``n`` fraction digits as an integer."""
    return F.rpad(F.substring(F.coalesce(digits, F.lit("")), 1, n), n, "0").cast(_BIG) if n else _big(0)


def _made(ticks: Column, unit: Column, offset: Column) -> Column:
    return F.when(ticks.isNotNull(), F.struct(ticks.alias("ticks"), unit.alias("unit"), offset.alias("offset_seconds")))


def _dated(text: Column, fmt: str) -> Column:
    # one match writes all parts with a mark between them; a text that doesn't match has no mark
    parts = F.split(F.regexp_replace(text, _DATED[fmt], _MARK.join(f"${i}" for i in range(1, 9))), _MARK, -1)
    return let(parts, lambda p: F.when(F.size(p) == 8, _of_parts(p, fmt)))


def _of_parts(found: Column, fmt: str) -> Column:
    part = [found[i] for i in range(8)]
    year, month, day = {"dd_mm_yyyy": (2, 1, 0), "mm_dd_yyyy": (2, 0, 1)}.get(fmt, (0, 1, 2))
    date = F.concat_ws("-", part[year], F.lpad(part[month], 2, "0"), F.lpad(part[day], 2, "0")).try_cast("date")
    hour, minute, second = (part[i].try_cast("int") for i in (3, 4, 5))
    zone = part[7]
    away = F.when(F.lower(zone) == "z", F.lit(0)).when(zone != "", F.concat(F.substring(zone, 1, 1), F.lit("1")).try_cast("int") * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60))
    valid = date.isNotNull() & (hour < 24) & (minute < 60) & (second < 60)
    clock = F.when(valid, F.unix_date(date).cast("bigint") * DAY + hour * 3600 + minute * 60 + second - F.coalesce(away, F.lit(0)))
    return let(F.struct(clock.alias("whole"), part[6].alias("fraction"), away.alias("away")), _ticks_of_parts)


def _ticks_of_parts(x: Column) -> Column:
    whole, fraction, away = x["whole"], x["fraction"], x["away"]
    fine = F.length(fraction) > 9
    ticks = F.when(fine, _big(whole) * _big(10**12) + _fraction(fraction, 12)).otherwise(_big(whole) * _big(10**9) + _fraction(fraction, 9))
    ticks = F.when(F.abs(whole) <= _NANO_SECONDS, ticks.cast(_BIG))
    return _made(ticks, F.when(fine, "ps").otherwise("ns"), away)


def _parts(text: Column) -> tuple[Column, Column, Column, Column]:
    """is a number, sign, whole, fraction digits. The sign comes from the text, so -0.5 is negative."""
    sign = F.when(F.regexp_extract(text, _NUMBER, 1) == "-", _big(-1)).otherwise(_big(1))
    whole = F.regexp_extract(text, _NUMBER, 2)
    return F.regexp_like(text, F.lit(_NUMBER)) & (F.length(whole) <= 20), sign, whole.try_cast(_BIG), F.coalesce(F.regexp_extract(text, _NUMBER, 3), F.lit(""))


def _epoch(text: Column, unit: str) -> Column:
    valid, sign, whole, digits = _parts(text)
    finer = "ps" if unit == "ns" else "ns"
    shift = DIGITS[finer] - DIGITS[unit]
    scaled = sign * (whole * _big(10**shift) + _fraction(digits, shift))
    ticks = F.when(digits == "", sign * whole).otherwise(scaled).cast(_BIG)
    return _made(F.when(valid, ticks), F.when(digits == "", unit).otherwise(finer), F.lit(None).cast("int"))


def _labview(text: Column) -> Column:
    valid, sign, whole, digits = _parts(text)
    ticks = sign * (whole * _big(10**9) + _fraction(digits, 9)) - _big(LABVIEW_SECONDS * 10**9)
    return _made(F.when(valid, ticks.cast(_BIG)), F.lit("ns"), F.lit(None).cast("int"))


def _excel(text: Column) -> Column:
    valid, sign, whole, digits = _parts(text)
    # 12 digits of a day are finer than a nanosecond's share
    part = F.floor(_fraction(digits, 12) * _big(DAY) / F.lit(1000)).cast(_BIG)
    ticks = sign * (whole * _big(DAY * 10**9) + part) - _big(EXCEL_DAYS * DAY * 10**9)
    return _made(F.when(valid, ticks.cast(_BIG)), F.lit("ns"), F.lit(None).cast("int"))


def parse(text: Column, fmt: str) -> Column:
    """STRUCT<ticks DECIMAL(38,0), unit STRING, offset_seconds INT>, null if the text isn't of the format."""
    t = F.trim(text)
    if fmt in _DATED:
        return _dated(t, fmt)
    if fmt.startswith("epoch_"):
        return _epoch(t, fmt[6:])
    if fmt == "labview_epoch":
        return _labview(t)
    if fmt == "excel_serial":
        return _excel(t)
    raise ValueError(f"unknown timestamp format {fmt!r}")


def has_shape(text: Column, fmt: str) -> Column:
    """Whether the cell looks like the format: necessary for ``matches``, and cheap."""
    return F.regexp_like(F.trim(text), F.lit(_DATED.get(fmt, _NUMBER)))


def matches(text: Column, fmt: str) -> Column:
    """Whether inference may take the cell for the format: it parses and, for numbers, its size is plausible."""
    t = F.trim(text)
    low, high = PLAUSIBLE
    if fmt in _DATED:
        return F.coalesce(_dated(t, fmt).isNotNull(), F.lit(False))
    valid, sign, whole, digits = _parts(t)
    if fmt.startswith("epoch_"):
        per = 10 ** DIGITS[fmt[6:]]
        test = valid & (whole >= _big(low * per)) & (whole < _big(high * per)) & ((digits == "") | F.regexp_like(digits, F.lit("[1-9]")))
    else:
        first, last = (low + LABVIEW_SECONDS, high + LABVIEW_SECONDS) if fmt == "labview_epoch" else (low // DAY + EXCEL_DAYS, high // DAY + EXCEL_DAYS)
        test = valid & (sign * whole >= _big(first)) & (sign * whole < _big(last))
    return F.coalesce(test, F.lit(False))


def in_unit(parsed: Column, unit: str) -> Column:
    """Ticks of a parsed timestamp in ``unit`` (which must be as fine as its own)."""
    out = F.lit(None).cast(_BIG)
    for own, digits in DIGITS.items():
        if digits <= DIGITS[unit]:
            out = F.when(parsed["unit"] == own, parsed["ticks"] * _big(10 ** (DIGITS[unit] - digits))).otherwise(out)
    return out.cast(_BIG)


def _divided(ticks: Column, by: int) -> tuple[Column, Column]:
    """Quotient rounded down, and the remainder, of exact decimals."""
    rest = F.pmod(ticks, _big(by)).cast(_BIG)
    return F.expr("1").cast(_BIG) * ((ticks - rest) / _big(by)).cast(_BIG), rest


def _clock(ticks: Column, digits: int, date_format: str, between: str) -> tuple[Column, Column]:
    """Date and time text of whole seconds, and the fraction's digits padded to ``digits``."""
    seconds, rest = _divided(ticks, 10**digits)
    days, clock = _divided(seconds, DAY)
    date = F.date_format(F.date_from_unix_date(days.cast("int")), date_format)
    s = clock.cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    time = F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))
    return F.concat(date, F.lit(between), time), F.lpad(rest.cast("string"), digits, "0") if digits else F.lit("")


def _grouped(fraction: Column) -> Column:
    """.fff, .ffffff or .fffffffff, the shortest that loses nothing; nothing for a whole second."""
    return F.when(F.regexp_like(fraction, F.lit("^0{9}$")), "").when(F.regexp_like(fraction, F.lit("0{6}$")), F.concat(F.lit("."), F.substring(fraction, 1, 3))).when(F.regexp_like(fraction, F.lit("0{3}$")), F.concat(F.lit("."), F.substring(fraction, 1, 6))).otherwise(F.concat(F.lit("."), fraction))


def _shortest(digits: Column) -> Column:
    stripped = F.regexp_replace(digits, "0+$", "")
    return F.when(stripped == "", "").otherwise(F.concat(F.lit("."), stripped))


def _numeric(ticks: Column, digits: int) -> Column:
    size = F.abs(ticks)
    whole, rest = _divided(size, 10**digits) if digits else (size, _big(0))
    fraction = _shortest(F.lpad(rest.cast("string"), digits, "0")) if digits else F.lit("")
    return F.concat(F.when(ticks < 0, "-").otherwise(""), whole.cast("string"), fraction)


def format_ticks(parsed: Column, fmt: str) -> Column:
    """The text of a timestamp: the inverse of ``parse`` (``Z`` comes back as +00:00)."""
    fine = parsed["unit"] == "ps"
    ticks = parsed["ticks"]
    if fmt in _DATED:
        shift = F.coalesce(parsed["offset_seconds"], F.lit(0)).cast(_BIG)
        form, between = {"iso8601": ("yyyy-MM-dd", "T"), "iso8601_naive": ("yyyy-MM-dd", "T"), "datetime_space": ("yyyy-MM-dd", " "), "dd_mm_yyyy": ("dd/MM/yyyy", " "), "mm_dd_yyyy": ("MM/dd/yyyy", " ")}[fmt]
        clock_ns, frac_ns = _clock((ticks + shift * _big(10**9)).cast(_BIG), 9, form, between)
        clock_ps, frac_ps = _clock((ticks + shift * _big(10**12)).cast(_BIG), 12, form, between)
        text = F.when(fine, F.concat(clock_ps, F.lit("."), frac_ps)).otherwise(F.concat(clock_ns, _grouped(frac_ns)))
        if fmt != "iso8601":
            return text
        size = F.abs(F.coalesce(parsed["offset_seconds"], F.lit(0)))
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        return F.concat(text, F.when(parsed["offset_seconds"] < 0, "-").otherwise("+"), two(F.floor(size / 3600)), F.lit(":"), two(F.floor(size / 60) % 60))
    if fmt.startswith("epoch_"):
        unit = fmt[6:]
        finer = "ps" if unit == "ns" else "ns"
        return F.when(parsed["unit"] == unit, ticks.cast("string")).otherwise(_numeric(ticks, DIGITS[finer] - DIGITS[unit]))
    if fmt == "labview_epoch":
        return _numeric((ticks + _big(LABVIEW_SECONDS * 10**9)).cast(_BIG), 9)
    if fmt == "excel_serial":
        nanos = (ticks + _big(EXCEL_DAYS * DAY * 10**9)).cast(_BIG)
        whole, rest = _divided(F.abs(nanos), DAY * 10**9)
        # the shortest digits that parse back to the same nanosecond are at most 12
        digits = F.lpad(F.ceil(rest * _big(1000) / F.lit(DAY)).cast("string"), 12, "0")
        return F.concat(F.when(nanos < 0, "-").otherwise(""), whole.cast("string"), _shortest(digits))
    raise ValueError(f"unknown timestamp format {fmt!r}")


def progressive_ticks(value: Column) -> Column:
    """A plain numeric index in billionths, rounded half away from zero."""
    return F.round(value.cast("double") * 1e9).cast(_BIG)


def progressive_value(ticks: Column) -> Column:
    return ticks.cast("double") / 1e9


def seconds_of(ticks: Column, unit: str) -> Column:
    return ticks.cast("double") / float(10 ** DIGITS[unit])


def ticks_of(seconds: Column, unit: str) -> Column:
    return F.round(seconds * float(10 ** DIGITS[unit])).cast(_BIG)
