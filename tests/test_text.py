"""Cells, timestamps, inference and messy files."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timestamps
from tidemark.plans import infer, report
from tidemark.sources import cache, fixtures, parquet, registry
from tidemark.streaming import progressive

ROUND_TRIPS = [
    ("iso8601", "2026-01-25T08:00:00.123+02:00", None),
    ("iso8601", "2026-01-25T08:00:00Z", "2026-01-25T08:00:00+00:00"),
    ("iso8601", "2026-01-25T08:00:00.123456789012+00:00", None),
    ("iso8601_naive", "2026-01-25T08:00:00.000001", None),
    ("datetime_space", "1969-12-31 23:59:59.500", None),
    ("dd_mm_yyyy", "25/01/2026 08:00:00", None),
    ("mm_dd_yyyy", "01/25/2026 08:00:00", None),
    ("epoch_s", "1770000000", None),
    ("epoch_s", "-0.5", None),
    ("epoch_ms", "1770000000123.5", None),
    ("epoch_us", "1770000000123456", None),
    ("epoch_ns", "1770000000123456789.25", None),
    ("labview_epoch", "3850027200", None),
    ("excel_serial", "46023.5", None),
]


@pytest.mark.parametrize(("fmt", "text", "back"), ROUND_TRIPS)
def test_round_trip(spark, fmt, text, back):
    df = spark.createDataFrame([(text,)], "t string").select(timestamps.parse(F.col("t"), fmt).alias("p"))
    assert df.select(timestamps.format_ticks(F.col("p"), fmt)).first()[0] == (back or text)


def test_ticks(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00.123456789012Z",), ("2026-01-01T00:00:00.5Z",), ("2026-02-30T00:00:00Z",)], "t string")
    p = timestamps.parse(F.col("t"), "iso8601")
    got = [tuple(r) for r in df.select(p["ticks"].cast("string"), p["unit"], timestamps.in_unit(p, "ps").cast("string")).collect()]
    assert got == [("1767225600123456789012", "ps", "1767225600123456789012"), ("1767225600500000000", "ns", "1767225600500000000000"), (None, None, None)]


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        (["25/01/2026 08:00:00", "01/02/2026 08:00:00"], ("dd_mm_yyyy", False)),
        (["01/25/2026 08:00:00"], ("mm_dd_yyyy", False)),
        (["01/02/2026 08:00:00"], ("dd_mm_yyyy", True)),
        (["25/01/2026 08:00:00", "01/25/2026 08:00:00"], (None, False)),
        (["1770000000"], ("epoch_s", False)),
        (["3850027200"], ("epoch_s", True)),
        (["3850027200.0"], ("labview_epoch", False)),
        (["46023", "46024.25"], ("excel_serial", False)),
        (["0", "1"], (None, False)),
    ],
)
def test_timestamp_inference(spark, cells, want):
    assert infer.infer_timestamp_format(spark.createDataFrame([(c,) for c in cells], "t string"), "t") == want


STAMPS = [f"2026-01-01T00:00:0{i}Z" for i in range(6)]


def made(sep=",", value="10.{}", head=True, stamps=STAMPS, more=""):
    lines = [sep.join(("timestamp", "value", "pressure"))] if head else []
    return "\n".join(lines + [sep.join((s, value.format(i), "1" + value[2] + "5")) for i, s in enumerate(stamps)]) + "\n" + more


CASES = {
    "comma": (made(), {"delimiter": ",", "timestamp_format": "iso8601", "row_count": 6, "sampling_class": "uniform", "dtypes": ["f64", "f64"]}),
    "semicolon": (made(";", "10,{}"), {"delimiter": ";", "decimal_separator": ",", "dtypes": ["f64", "f64"]}),
    "tab": (made("\t"), {"delimiter": "\t"}),
    "pipe": (made("|"), {"delimiter": "|"}),
    "blanks": (made("   "), {"delimiter": "WS", "row_count": 6}),
    "quoted": ("timestamp,site,value\n" + "\n".join(f'{s},"Site ""A"", North",1.5' for s in STAMPS), {"columns": ["site", "value"], "dtypes": ["string", "f64"], "row_count": 6}),
    "newline": ("timestamp,note,value\n" + "\n".join(f'{s},"one\ntwo",1.5' for s in STAMPS), {"row_count": 6, "dtypes": ["string", "f64"]}),
    "bom": ("﻿" + made(), {"time_column": "timestamp", "encoding": "utf-8"}),
    "preamble": ("# made by\n# a device\n" + made(), {"row_count": 6, "time_column": "timestamp"}),
    "headless": (made(head=False), {"time_column": "column_0", "columns": ["column_1", "column_2"], "row_count": 6}),
    "repeated names": (made().replace("pressure", "value"), {"columns": ["value", "value"]}),
    "ragged": (made(more="2026-01-01T00:00:09Z,1.0\n2026-01-01T00:00:10Z,1.0,2.0,3.0\n"), {"row_count": 6, "skipped_row_count": 2}),
    "steps back": (made(stamps=[STAMPS[i] for i in (0, 2, 1, 3, 4, 5)]), {"non_monotonic": 1}),
    "repeats": (made(stamps=[STAMPS[i] for i in (0, 1, 2, 2, 3, 4)]), {"duplicate_timestamp": 1}),
    "index": (made(stamps=list("012345")), {"timestamp_format": "none", "sampling_class": "progressive_index"}),
    "odd dates": (made(stamps=[f"0{i + 1}-Jan-2026" for i in range(6)]), {"timestamp_format": "none", "sampling_class": "progressive_index", "row_count": 6}),
    "nan": (made().replace("10.3", "NaN"), {"dtypes": ["f64", "f64"]}),
    "mixed": (made().replace("10.3", "ERR"), {"dtypes": ["string", "f64"]}),
}


@pytest.mark.parametrize("name", CASES)
def test_open(spark, tmp_path, name):
    content, want = CASES[name]
    path = tmp_path / "case.csv"
    path.write_bytes(content.encode())
    summary = report.inspect(spark, str(path))
    assert {k: getattr(summary, k) for k in want} == want


def test_encodings(spark, tmp_path):
    path = tmp_path / "case.csv"
    text = made().replace("value", "Temp [°C]").replace("pressure", "µm/s² äöü éè")
    for codec, name in (("cp1252", "windows-1252"), ("utf-16", "utf-16le"), ("utf-16-le", "utf-16le")):
        path.write_bytes(text.encode(codec))
        summary = report.inspect(spark, str(path))
        assert (summary.row_count, summary.columns[0]) == (6, "Temp [°C]")
        assert summary.encoding == name or codec == "cp1252"


@pytest.mark.parametrize(("content", "message"), [("", "empty file: no data to read"), ("timestamp\n2026-01-01T00:00:00Z\n", "single-column file: only the time index is present, no data series to plot")])
def test_errors(spark, tmp_path, content, message):
    path = tmp_path / "case.csv"
    path.write_text(content)
    with pytest.raises(infer.OpenError, match=message):
        report.inspect(spark, str(path))


def test_overrides_and_exact_integers(spark, tmp_path):
    path = tmp_path / "case.csv"
    path.write_text("timestamp,value\n" + "\n".join(f"0{i + 1}/02/2026 00:00:00,{9007199254740993 + i}" for i in range(3)))
    opened = report.open_path(spark, str(path))
    assert opened.report.timestamp_format == infer.LOW and "timestamp_format" in report.corrections(opened)
    assert [r["c1"] for r in opened.rows.orderBy("row_id").collect()] == [9007199254740993 + i for i in range(3)]
    again = report.open_path(spark, str(path), infer.Overrides(timestamp_format="mm_dd_yyyy", decimal_separator="."))
    assert again.summary.timestamp_format == "mm_dd_yyyy" and not again.report.has_low()
    with pytest.raises(infer.OpenError):
        report.open_path(spark, str(path), infer.Overrides(timestamp_format="iso8601"))


def test_routing():
    assert [registry.route(p) for p in ("a.CSV", "b.txt", "c/d.parquet")] == ["csv", "csv", "parquet"]
    with pytest.raises(infer.OpenError):
        registry.route("a.docx")


def test_parquet_cache_and_fixture(spark, tmp_path):
    df = spark.range(200).select((F.col("id") * 1000 + F.when(F.col("id") > 100, 10**6).otherwise(0)).alias("t"), F.when(F.col("id") % 7 != 0, F.col("id") * 1.5).alias("v"))
    place = str(tmp_path / "x.parquet")
    df.repartitionByRange(3, "t").sortWithinPartitions("t").select(F.timestamp_micros("t").alias("time"), "v").write.parquet(place)
    opened = report.open_path(spark, place)
    assert (opened.summary.row_count, opened.summary.gap_count, opened.summary.timestamp_format) == (200, 1, "parquet_timestamp")
    rows = parquet.read_series(spark, place)
    k = cache.key(spark, place, overrides=infer.Overrides())
    folder = str(tmp_path / "cache")
    first = cache.pyramids(spark, folder, k, rows, ["v"])
    assert first.filter("level = 0").agg(F.sum("nan_count")).first()[0] == 29
    assert cache.pyramids(spark, folder, k, rows, ["v"]).count() == first.count()
    assert k == cache.key(spark, place, overrides=infer.Overrides()) != cache.key(spark, place, "v")
    assert fixtures.wave_table(spark, 5).first()["timestamp"] == "2023-11-14T22:13:20.000Z"


def test_streaming_pyramid_equals_batch(spark, tmp_path):
    from tidemark.operators import pyramid

    whole = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("tick"), F.sin("id").alias("value"))
    state = progressive.PyramidState(spark, str(tmp_path / "state"))
    source = tmp_path / "in"
    for low, high in ((0, 1000), (1000, 1003), (1003, 5000)):
        whole.filter(F.col("row_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(whole.schema).parquet(str(source))
        progressive.stream_pyramid(stream, state, str(tmp_path / "checkpoint")).awaitTermination()
        state = progressive.PyramidState(spark, str(tmp_path / "state"))  # as after a restart
    assert (state.rows, state.version) == (5000, 2)
    assert sorted(map(tuple, state.table().collect())) == sorted(map(tuple, pyramid.build(whole, "value").collect()))
    assert list(progressive.checkpoints(100_000)) == [20_000, 40_000, 80_000, 100_000]
    shown = []
    progressive.load_progressive(whole, 5000, lambda df, n: shown.append((n, df.count())), first=2000)
    assert shown == [(2000, 2000), (4000, 4000), (5000, 5000)]
    with pytest.raises(ValueError, match="mine"):
        progressive.load_progressive(whole, 5000, lambda df, n: int("mine"))
