"""Opening files: the messy corpus, re-made case by case, and what once went wrong."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.operators import timestats
from tidemark.plans import infer, report
from tidemark.sources import fixtures, parquet, registry, text

ISO = [f"2026-02-01T10:00:{i:02d}Z" for i in range(9)]


def table(head, *columns, sep=","):
    """A header and columns of cells as delimited text."""
    return "\n".join([head, *(sep.join(map(str, r)) for r in zip(*columns, strict=True))]) + "\n"


def one(stamps, values=None, head="timestamp,value"):
    return table(head, stamps, values or [f"{i}.5" for i in range(len(stamps))])


PLAIN = table("timestamp,value,pressure", ISO[:6], [f"2{i}.25" for i in range(6)], [f"101{i}.5" for i in range(6)])
COMMA = {"encoding": "utf-8", "delimiter": ",", "decimal_separator": ".", "timestamp_format": "iso8601", "row_count": 6, "skipped_row_count": 0, "sampling_class": "uniform", "gap_count": 0}
TWO = {"columns": ["value", "pressure"], "dtypes": ["f64", "f64"]}
V = {"columns": ["value"], "dtypes": ["f64"]}
SECONDS = [1770000000 + i for i in range(6)]

#: name, content, expected beyond COMMA
CORPUS = {
    "01 comma": (PLAIN, TWO),
    "02 semicolon, decimal comma": (table("timestamp;value;pressure", ISO[:6], [f"2{i},25" for i in range(6)], [f"101{i},5" for i in range(6)], sep=";"), TWO | {"delimiter": ";", "decimal_separator": ","}),
    "03 tabs": (PLAIN.replace(",", "\t"), TWO | {"delimiter": "\t"}),
    "04 blanks": (PLAIN.replace(",", "    "), TWO | {"delimiter": "WS"}),
    "05 pipes": (PLAIN.replace(",", "|"), TWO | {"delimiter": "|"}),
    "06 quoted delimiter": (table("timestamp,site,value", ISO[:6], ['"Hall 2, ""north"""'] * 6, range(6)).replace("5\n", "5.5\n"), {"columns": ["site", "value"], "dtypes": ["string", "f64"]}),
    "07 quoted line end": (table("timestamp,note,value", ISO[:6], ['"first\nsecond"'] * 6, [1.5] * 6), {"columns": ["note", "value"], "dtypes": ["string", "f64"]}),
    "08 degree and micro in one byte": (PLAIN.replace("value", "T [°C]").replace("pressure", "v [µm/s²]").encode("cp1252"), {"encoding": "windows-1252", "columns": ["T [°C]", "v [µm/s²]"]}),
    "09 smart quotes": (table("timestamp,value,note", ISO[:6], [1.5] * 6, ["“öäü” – ’s €"] * 6).encode("cp1252"), {"encoding": "windows-1252", "dtypes": ["f64", "string"]}),
    "10 mark": ("\ufeff" + PLAIN, TWO),
    "11 utf-16": (PLAIN.encode("utf-16"), TWO | {"encoding": "utf-16le"}),
    "12 invalid bytes": (table("timestamp,value,note", ISO[:6], [1.5] * 6, ["x" * 60] * 6).encode().replace(b"xxxxx", b"xx\xffxx", 1), {"dtypes": ["f64", "string"]}),
    "13 units": (PLAIN.replace("value", "Temp [°C]").replace("pressure", "Speed [m/s]"), {"columns": ["Temp [°C]", "Speed [m/s]"]}),
    "14 preamble": ("device: X\nserial: none\n\n" + one(ISO[:4]), V | {"row_count": 4}),
    "15 no header": (one(ISO[:5]).split("\n", 1)[1], {"time_column": "column_0", "columns": ["column_1"], "row_count": 5}),
    "16 repeated names": (table("timestamp,value,value", ISO[:4], [1.5] * 4, [2.5] * 4), {"columns": ["value", "value"], "row_count": 4}),
    "17 empty name": (table("timestamp,,pressure", ISO[:4], [1.5] * 4, [2.5] * 4), {"columns": ["", "pressure"], "row_count": 4}),
    "18 one column": ("timestamp\n" + "\n".join(ISO[:3]) + "\n", errors.SingleColumnFile),
    "19 one row": (one(ISO[:1]), V | {"row_count": 1}),
    "20 empty lines at the end": (table("timestamp,value,pressure,", ISO[:4], [1.5] * 4, [2.5] * 4, [""] * 4) + "\n\n\n", {"columns": ["value", "pressure", ""], "dtypes": ["f64", "f64", "string"], "row_count": 4}),
    "21 ragged": (table("timestamp,value,pressure", [ISO[i] for i in (0, 3, 8)], [1.5] * 3, [2.5] * 3).replace("2.5\n", f"2.5\n{ISO[1]},1.0\n{ISO[2]},1,2,3\n", 1), TWO | {"row_count": 3, "skipped_row_count": 2, "sampling_class": "irregular"}),
    "22 cut off": (one(ISO[:4]) + "2026-02-01T10:0", V | {"row_count": 4, "skipped_row_count": 1}),
    "23 empty": ("", errors.EmptyFile),
    "24 offset": (one([f"2026-02-01T10:00:0{i}+02:00" for i in range(6)]), V),
    "25 naive": (one([s[:-1] for s in ISO[:6]]), V | {"timestamp_format": "iso8601_naive"}),
    "26 day first": (one([f"2{i}/01/2026 08:00:00" for i in range(6)]), V | {"timestamp_format": "dd_mm_yyyy"}),
    "27 month first": (one([f"01/2{i}/2026 08:00:00" for i in range(6)]), V | {"timestamp_format": "mm_dd_yyyy"}),
    "28 either": (one([f"03/04/2026 08:00:0{i}" for i in range(6)]), V | {"timestamp_format": "dd_mm_yyyy"}),
    "29 seconds": (one(SECONDS), V | {"timestamp_format": "epoch_s"}),
    "30 milliseconds": (one([s * 1000 for s in SECONDS]), V | {"timestamp_format": "epoch_ms"}),
    "31 microseconds": (one([s * 10**6 for s in SECONDS]), V | {"timestamp_format": "epoch_us"}),
    "32 nanoseconds": (one([s * 10**9 for s in SECONDS]), V | {"timestamp_format": "epoch_ns"}),
    "33 excel": (one([46000 + i for i in range(6)]), V | {"timestamp_format": "excel_serial"}),
    "34 labview": (one([f"{3850027200 + i}.0" for i in range(6)]), V | {"timestamp_format": "labview_epoch"}),
    "35 index": (one(range(6), head="sample,value"), V | {"timestamp_format": "none", "sampling_class": "progressive_index"}),
    "36 steps back": (one([ISO[i] for i in (0, 1, 3, 2, 3, 4)]).replace(ISO[3], "2026-02-01T10:00:03Z", 1), V | {"non_monotonic": 1}),
    "37 repeats": (one([ISO[i] for i in (0, 1, 2, 2, 3, 4)]), V | {"duplicate_timestamp": 1, "non_monotonic": 0}),
    "38 jitter": (one([f"2026-02-01T10:00:{i:02d}.{j:03d}Z" for i, j in enumerate((0, 2, 1, 3, 0, 1))]), V),
    "39 events": (one([f"2026-02-01T{h}Z" for h in ("10:00:00", "10:00:07", "10:00:09", "10:00:31", "10:01:02", "12:40:00")]), V | {"sampling_class": "irregular", "gap_count": 1}),
    "40 bursts": (one([f"2026-02-01T{h}:00:0{i}Z" for h in (10, 12, 15) for i in range(3)]), V | {"sampling_class": "segmented_uniform", "gap_count": 2, "row_count": 9}),
    "41 picoseconds": (one([f"2026-02-01T10:00:00.{i:012d}Z" for i in range(6)]), V),
    "42 years": (one([f"20{20 + i}-06-01T00:00:00Z" for i in range(6)]), V),
    "43 runs of NaN": (one(ISO[:7], ["1.5", "NaN", "NaN", "2.5", "NaN", "3.5", "4.5"]), V | {"row_count": 7}),
    "44 infinities": (one(ISO[:5], ["1.5", "inf", "-inf", "Infinity", "2.5"]), V | {"row_count": 5}),
    "45 outliers": (one(ISO[:5], ["1.5", "1e300", "1.5", "-1e300", "1.5"]), V | {"row_count": 5}),
    "46 numbers and text": (one(ISO[:5], ["1.5", "ERR", "2.5", "3.5", "4.5"]), {"dtypes": ["string"], "row_count": 5}),
    "47 booleans": (table("timestamp,flag_lower,flag_numeric,flag_upper", ISO[:4], ["true", "false"] * 2, ["1", "0"] * 2, ["TRUE", "FALSE"] * 2), {"dtypes": ["bool"] * 3, "row_count": 4}),
    "48 states": (one(ISO[:6], ["idle", "run", "run", "stop", "idle", "idle"], "timestamp,state"), {"columns": ["state"], "dtypes": ["string"]}),
    "49 markers": (table("timestamp,value,marker", ISO, [1.5] * 9, ["", "", "start", "", "", "", "end", "", ""]), {"dtypes": ["f64", "string"], "row_count": 9}),
    "50 large integers": (one(ISO[:3], [9007199254740993, 9007199254740995, -9223372036854775808]), {"dtypes": ["i64"], "row_count": 3}),
    "51 constant": (one(ISO[:4], ["7.5"] * 4), V | {"row_count": 4}),
    "52 all NaN": (one(ISO[:4], ["NaN"] * 4), V | {"row_count": 4}),
    "57 date and time": (one([f"2026-02-01 10:00:0{i}" for i in range(6)]), V | {"timestamp_format": "datetime_space"}),
    "58 unknown stamps": (table("timestamp,temperature,pressure", [f"{i} o'clock" for i in range(6)], [1.5] * 6, [2.5] * 6), {"timestamp_format": "none", "sampling_class": "progressive_index", "columns": ["temperature", "pressure"]}),
}
ENDINGS = {"03": "tsv", "04": "txt"}


@pytest.mark.parametrize("name", CORPUS)
def test_corpus(spark, tmp_path, name):
    content, want = CORPUS[name]
    path = tmp_path / f"case.{ENDINGS.get(name[:2], 'csv')}"
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    if isinstance(want, type):
        with pytest.raises(want):
            report.open_path(spark, str(path))
        return
    summary = report.inspect(spark, str(path))
    assert {k: getattr(summary, k) for k in COMMA | want} == COMMA | want


def micros(*seconds):
    return pa.array([1_770_000_000_000_000 + int(s * 1e6) for s in seconds], pa.timestamp("us", "UTC"))


def test_parquet_corpus(spark, tmp_path):
    """Cases 53 to 56: clean, with nulls, a folder of partitions with a gap, and strings from a dictionary."""
    cases = {"clean": ([1.5] * 6, pa.float64()), "nulls": ([1.5, None, 2.5, None, None, 3.5], pa.float64()), "strings": (["a", "b"] * 3, pa.dictionary(pa.int32(), pa.string()))}
    for name, (values, kind) in cases.items():
        pq.write_table(pa.table({"time": micros(*range(6)), "v": pa.array(values, kind)}), tmp_path / f"{name}.parquet")
        opened = report.open_path(spark, str(tmp_path / f"{name}.parquet"))
        s = opened.summary
        assert (s.timestamp_format, s.row_count, s.sampling_class, s.gap_count) == ("parquet_timestamp", 6, "uniform", 0)
        assert [r["v"] for r in opened.rows.orderBy("row_id").collect()] == values
    for day, start in (("2026-02-01", 0), ("2026-02-02", 86_400)):
        (tmp_path / "log" / f"day={day}").mkdir(parents=True)
        pq.write_table(pa.table({"time": micros(start, start + 1, start + 2), "v": pa.array([1.0, 2.0, 3.0])}), tmp_path / "log" / f"day={day}" / "part.parquet")
    s = report.inspect(spark, str(tmp_path / "log"))
    assert (s.row_count, s.sampling_class, s.gap_count) == (6, "segmented_uniform", 1)


def test_parquet_rows_stay_as_they_stand(spark, tmp_path):
    """Steps back and repeats are counted, not sorted away; over row groups and files, too."""
    pq.write_table(pa.table({"time": pa.array([5, 3, 4, 4]), "v": pa.array([1.0, 2.0, 3.0, 4.0])}), tmp_path / "a.parquet", row_group_size=2)
    rows = parquet.read_series(spark, str(tmp_path / "a.parquet"))
    assert [r["tick"] for r in rows.orderBy("row_id").collect()] == [5, 3, 4, 4]
    s = timestats.summarize(rows).first()
    assert (s["non_monotonic"], s["duplicate_timestamp"]) == (1, 1)
    (tmp_path / "many.parquet").mkdir()
    for i, ticks in enumerate(([7, 8], [1, 2, 3], [2])):
        pq.write_table(pa.table({"time": pa.array(ticks)}), tmp_path / "many.parquet" / f"part-{i}.parquet")
    again = parquet.read_series(spark, str(tmp_path / "many.parquet")).orderBy("row_id").collect()
    assert [(r["row_id"], r["tick"]) for r in again] == list(enumerate([7, 8, 1, 2, 3, 2]))


@pytest.mark.parametrize("cell", ["x" * 1_000_000, 'say ""so"" ' * 50_000, "a\n" * 2000])
def test_a_very_long_quoted_cell(spark, tmp_path, cell):
    path = tmp_path / "long.csv"
    path.write_text(table("timestamp,value,note", ISO[:6], [1.5] * 6, ["short"] * 3 + [f'"{cell}"'] + ["short"] * 2))
    opened = report.open_path(spark, str(path))
    assert (opened.summary.row_count, opened.summary.skipped_row_count) == (6, 0)
    assert opened.rows.filter("row_id = 3").first()["c2"] == cell.replace('""', '"')


def test_cells_of_the_corpus(spark, tmp_path):
    """What a summary doesn't show: infinities, booleans, large integers, markers, picosecond ticks, mapped bytes."""
    def cells(name, column):
        path = tmp_path / f"{name[:2]}.csv"
        content = CORPUS[name][0]
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return [r[column] for r in report.open_path(spark, str(path)).rows.orderBy("row_id").collect()]

    inf = float("inf")
    assert cells("44 infinities", "c1") == [1.5, inf, -inf, inf, 2.5]
    assert cells("47 booleans", "c2") == [True, False] * 2
    assert cells("50 large integers", "c1") == [9007199254740993, 9007199254740995, -9223372036854775808]
    assert [c for c in cells("49 markers", "c2") if c] == ["start", "end"]
    assert [int(t) - int(cells("41 picoseconds", "tick")[0]) for t in cells("41 picoseconds", "tick")] == list(range(6))
    assert cells("09 smart quotes", "c2")[0] == "“öäü” – ’s €"


def test_header_confidence():
    rows = [["a device"], ["made"], ["time", "v"], ["2026-01-01", "1"]]
    assert infer.infer_header(rows) == (["time", "v"], infer.HIGH, 3)
    assert infer.infer_header([["x"], *rows[3:]]) == (["column_0", "column_1"], infer.LOW, 1)
    assert infer.infer_header(rows[3:]) == (["column_0", "column_1"], infer.HIGH, 0)
    assert infer.infer_header([["a", "b"], ["c", "d"]])[0] == []


def test_confidences_of_axis_and_format(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(CORPUS["28 either"][0])
    r = report.open_path(spark, str(path)).report
    assert (r.time_column, r.timestamp_format) == (infer.HIGH, infer.LOW)
    assert report.corrections(report.open_path(spark, str(path)))["timestamp_format"] == ["mm_dd_yyyy"]
    path.write_text(CORPUS["58 unknown stamps"][0])
    r = report.open_path(spark, str(path)).report
    assert (r.time_column, r.timestamp_format) == (infer.LOW, infer.LOW)


def test_a_registered_reader_opens_what_it_takes(spark, tmp_path):
    registry.register("lines", lambda path, spark: path.endswith(".lines"), lambda spark, path, overrides: spark.read.text(path))
    (tmp_path / "x.lines").write_text("a\nb\n")
    assert report.open_path(spark, str(tmp_path / "x.lines")).count() == 2
    assert registry.route("a.csv") == "csv"
    with pytest.raises(errors.UnrecognizedFormat):
        report.open_path(spark, str(tmp_path / "x.docx"))
    with pytest.raises(errors.Unreadable):
        report.open_path(spark, str(tmp_path / "absent.csv"))


def test_a_file_beyond_the_budget_is_refused(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(PLAIN)
    with pytest.raises(errors.BudgetExceeded) as e:
        report.open_path(spark, str(path), memory=1000)
    assert e.value.cap == 250 < e.value.needed
    assert report.open_path(spark, str(path), memory=1 << 30).summary.row_count == 6


def test_counts_without_values(spark, tmp_path):
    for name in ("01 comma", "07 quoted line end", "14 preamble", "15 no header", "21 ragged", "22 cut off"):
        path = tmp_path / "a.csv"
        path.write_text(CORPUS[name][0])
        s = report.inspect(spark, str(path))
        assert text.counts(spark, str(path)) == (s.row_count, s.skipped_row_count), name


def test_progressive_open(spark, tmp_path):
    """Each checkpoint is a whole opened prefix: types, gaps, report; a prefix that can't be opened is left out."""
    path = tmp_path / "a.csv"
    stamps = [dt.datetime(2026, 2, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=i + (3600 if i >= 50 else 0)) for i in range(90)]
    path.write_text(one([s.strftime("%Y-%m-%dT%H:%M:%SZ") for s in stamps], [str(i) for i in range(60)] + ["7.5"] * 30))
    seen = []
    whole = report.open_progressive(spark, str(path), lambda o, n: seen.append((n, o.summary.row_count, o.summary.gap_count, o.summary.dtypes[0])), first=20)
    assert seen == [(20, 20, 0, "i64"), (40, 40, 0, "i64"), (80, 80, 1, "f64"), (90, 90, 1, "f64")]
    assert whole.summary.row_count == 90
    seen.clear()
    path.write_text(path.read_text().replace("2026-02-01T00:00:30Z", "bad"))
    fixed = infer.Overrides(timestamp_format="iso8601")
    with pytest.raises(errors.InvalidTimestamp):
        report.open_progressive(spark, str(path), lambda o, n: seen.append(n), fixed, first=20)
    assert seen == [20] or not seen


def test_fixture_file(spark, tmp_path):
    path = str(tmp_path / "waves.csv")
    rows = fixtures.write_waves(spark, path, 200_000)
    assert abs((tmp_path / "waves.csv").stat().st_size - 200_000) < 20_000
    s = report.inspect(spark, path)
    assert (s.row_count, s.sampling_class, len(s.columns)) == (rows, "uniform", 8)


def test_native_types_in_the_cache(spark, tmp_path):
    from tidemark.sources import cache

    df = spark.range(5).select(F.col("id").alias("row_id"), F.col("id").alias("tick"), (F.lit(9007199254740993) + F.col("id")).alias("n"))
    cache.raw_columns(spark, str(tmp_path), "k", df, ["n"])
    assert [r["n"] for r in cache.raw_columns(spark, str(tmp_path), "k", df, ["n"]).orderBy("row_id").collect()] == [9007199254740993 + i for i in range(5)]
