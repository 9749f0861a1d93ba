"""Queries over files, cells, time stamps, caches and streams, beside those of ``queries``, with equal DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as cells
from .functions import timestamps
from .operators import viewport, welch
from .plans import infer, report
from .queries import _A, _BUCKET, _E, _PYRAMID, _SUM, axes, dtype_scan, events, query, write_text
from .queries import _DTYPE, _TEXT
from .sources import cache, fixtures, parquet, text
from .sources.scratch import folder, new_place
from .streaming import progressive

_F = "f AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, epoch_us(ts) AS tick, event_id, user_id, event_type, value FROM events)"


@query(f"WITH {_F} SELECT row_id, tick, event_id, event_type FROM f")
def parquet_axis(spark, sf_dir):
    """A Parquet file's rows as they stand (the tables are written in the order of their ids)."""
    return parquet.read_series(spark, f"{sf_dir}/events.parquet").select("row_id", "tick", "event_id", "event_type")


@query("WITH o AS (SELECT 1 AS one, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, epoch_us(o_orderdate) AS tick FROM orders), " + _SUM.format(by="one", of="o").replace("SELECT one, n, gap_count, CASE", "SELECT n AS row_count, gap_count, CASE").replace("non_monotonic, duplicate_timestamp, median_dt\nFROM t", "non_monotonic, duplicate_timestamp, 'parquet_timestamp' AS timestamp_format\nFROM t"))
def parquet_open(spark, sf_dir):
    """The summary of a Parquet file whose time steps back again and again."""
    s = report.open_path(spark, f"{sf_dir}/orders.parquet").summary
    row = (s.row_count, s.gap_count, s.sampling_class, s.non_monotonic, s.duplicate_timestamp, s.timestamp_format)
    return spark.createDataFrame([row], "row_count long, gap_count long, sampling_class string, non_monotonic long, duplicate_timestamp long, timestamp_format string")


def _stamped(spark, sf_dir, made, fmt: str) -> DataFrame:
    out = events(spark, sf_dir).select("row_id", made.alias("text")).withColumn("p", timestamps.parse(F.col("text"), fmt))
    return out.select("row_id", "text", F.col("p.ticks").cast("string").alias("ticks"), F.col("p.unit").alias("unit"), F.col("p.offset_seconds").alias("offset_seconds"), timestamps.format_ticks(F.col("p"), fmt).alias("back"))


def _iso(pattern: str):
    return F.date_format(F.timestamp_micros("tick"), pattern)


@query(f"""WITH {_E}, s AS (SELECT row_id, tick, strftime(make_timestamp(tick), '%Y-%m-%dT%H:%M:%S.%f') AS text FROM e)
SELECT row_id, text, (tick * 1000)::VARCHAR AS ticks, 'ns' AS unit, NULL::INT AS offset_seconds, CASE WHEN tick % 1000000 = 0 THEN substr(text, 1, 19) WHEN tick % 1000 = 0 THEN substr(text, 1, 23) ELSE text END AS back FROM s""")
def parse_iso_naive(spark, sf_dir):
    return _stamped(spark, sf_dir, _iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "iso8601_naive")


@query(f"""WITH {_E}, s AS (SELECT row_id, tick, 1 + row_id % 999999 AS pico, strftime(make_timestamp(tick + 7200000000), '%Y-%m-%dT%H:%M:%S.%f') || lpad((1 + row_id % 999999)::VARCHAR, 6, '0') || '+02:00' AS text FROM e)
SELECT row_id, text, (tick::HUGEINT * 1000000 + pico)::VARCHAR AS ticks, 'ps' AS unit, 7200 AS offset_seconds, text AS back FROM s WHERE pico % 1000 <> 0""")
def parse_picoseconds(spark, sf_dir):
    local = F.date_format(F.timestamp_micros(F.col("tick") + 7_200_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    pico = F.lpad((1 + F.col("row_id") % 999_999).cast("string"), 6, "0")
    return _stamped(spark, sf_dir, F.concat(local, pico, F.lit("+02:00")), "iso8601").filter((1 + F.col("row_id") % 999_999) % 1000 != 0)


def _slashed(pattern: str) -> str:
    return f"""WITH {_E}, s AS (SELECT row_id, tick // 1000000 AS s, strftime(make_timestamp(tick), '{pattern}') AS text FROM e) SELECT row_id, text, (s * 1000000000)::VARCHAR AS ticks, 'ns' AS unit, NULL::INT AS offset_seconds, text AS back FROM s"""


@query(_slashed("%d/%m/%Y %H:%M:%S"))
def parse_day_first(spark, sf_dir):
    return _stamped(spark, sf_dir, _iso("dd/MM/yyyy HH:mm:ss"), "dd_mm_yyyy")


@query(_slashed("%m/%d/%Y %H:%M:%S"))
def parse_month_first(spark, sf_dir):
    return _stamped(spark, sf_dir, _iso("MM/dd/yyyy HH:mm:ss"), "mm_dd_yyyy")


@query(f"""WITH {_E}, s AS (SELECT row_id, tick // 86400000000 + 25569 AS d, (tick // 864000) % 100000 AS f FROM e)
SELECT row_id, d || '.' || lpad(f::VARCHAR, 5, '0') AS text, ((d - 25569) * 86400000000000 + f * 864000000)::VARCHAR AS ticks, 'ns' AS unit, NULL::INT AS offset_seconds, CASE WHEN f = 0 THEN d::VARCHAR ELSE rtrim(d || '.' || lpad(f::VARCHAR, 5, '0'), '0') END AS back FROM s""")
def parse_excel_fraction(spark, sf_dir):
    day, part = F.expr("tick div 86400000000 + 25569"), F.expr("(tick div 864000) % 100000")
    return _stamped(spark, sf_dir, F.concat(day.cast("string"), F.lit("."), F.lpad(part.cast("string"), 5, "0")), "excel_serial")


@query(f"""WITH {_E}, s AS (SELECT row_id, tick // 1000000 + 2082844800 AS s, (tick // 1000) % 1000 AS f FROM e)
SELECT row_id, s || '.' || lpad(f::VARCHAR, 3, '0') AS text, ((s - 2082844800) * 1000000000 + f * 1000000)::VARCHAR AS ticks, 'ns' AS unit, NULL::INT AS offset_seconds, CASE WHEN f = 0 THEN s::VARCHAR ELSE rtrim(s || '.' || lpad(f::VARCHAR, 3, '0'), '0') END AS back FROM s""")
def parse_labview_fraction(spark, sf_dir):
    whole, part = F.expr("tick div 1000000 + 2082844800"), F.expr("(tick div 1000) % 1000")
    return _stamped(spark, sf_dir, F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), 3, "0")), "labview_epoch")


@query(f"WITH {_E} SELECT row_id, tick::DOUBLE / 1000000 AS seconds, tick AS back, row_id * 500000000 AS index_ticks, row_id * 0.5::DOUBLE AS index_value FROM e")
def tick_units(spark, sf_dir):
    seconds = timestamps.seconds_of(F.col("tick"), "us")
    index = timestamps.progressive_ticks(F.col("row_id") * 0.5)
    return events(spark, sf_dir).select("row_id", seconds.alias("seconds"), timestamps.ticks_of(seconds, "us").cast("bigint").alias("back"), index.cast("bigint").alias("index_ticks"), timestamps.progressive_value(index).alias("index_value"))


@query("""WITH x AS (SELECT unnest(['day', 'month', 'either', 'neither']) AS series, unnest([strftime(ts, '%d/%m/%Y %H:%M:%S'), strftime(ts, '%m/%d/%Y %H:%M:%S'), '0' || (1 + event_id % 9) || '/0' || (1 + event_id % 7) || '/2024 00:00:00',
  CASE WHEN event_id % 2 = 0 THEN '25/01/2024 00:00:00' ELSE '01/25/2024 00:00:00' END]) AS cell FROM events),
f AS (SELECT series, bool_or(split_part(cell, '/', 1)::INT > 12) AS d, bool_or(split_part(cell, '/', 2)::INT > 12) AS m FROM x GROUP BY series)
SELECT series, CASE WHEN d AND m THEN NULL WHEN m THEN 'mm_dd_yyyy' ELSE 'dd_mm_yyyy' END AS format, NOT d AND NOT m AS ambiguous FROM f""")
def infer_day_month(spark, sf_dir):
    ts, n = F.timestamp_micros("tick"), F.col("event_id")
    df = parquet.read_series(spark, f"{sf_dir}/events.parquet").select(
        F.date_format(ts, "dd/MM/yyyy HH:mm:ss").alias("day"),
        F.date_format(ts, "MM/dd/yyyy HH:mm:ss").alias("month"),
        F.concat(F.lit("0"), (1 + n % 9).cast("string"), F.lit("/0"), (1 + n % 7).cast("string"), F.lit("/2024 00:00:00")).alias("either"),
        F.when(n % 2 == 0, F.lit("25/01/2024 00:00:00")).otherwise(F.lit("01/25/2024 00:00:00")).alias("neither"),
    )
    return spark.createDataFrame([(c, *infer.infer_timestamp_format(df, c)) for c in df.columns], "series string, format string, ambiguous boolean")


@query(f"WITH {_TEXT} SELECT series, CASE WHEN {_DTYPE} IN ('bool', 'string') THEN 'state_timeline' ELSE 'time_domain' END AS shown FROM x GROUP BY series")
def view_kinds(spark, sf_dir):
    return spark.createDataFrame([(r["series"], cells.view_kind(r["dtype"])) for r in dtype_scan(spark, sf_dir).collect()], "series string, shown string")


@query("SELECT n_name || ' [' || n_regionkey || ' m/s²]' AS header, regexp_extract(n_name || ' [' || n_regionkey || ' m/s²]', '\\[(.*)\\]$', 1) AS unit FROM nation UNION ALL SELECT n_name, NULL FROM nation")
def unit_labels(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    headers = [h for r in names for h in (f"{r['n_name']} [{r['n_regionkey']} m/s²]", r["n_name"])]
    return spark.createDataFrame([(h, cells.unit_label(h)) for h in headers], "header string, unit string")


@query(f"WITH {_E} SELECT row_id, user_id::VARCHAR AS user_id, event_type, (9007199254740993 + row_id)::VARCHAR AS large FROM e WHERE row_id = (SELECT count(*) // 3 FROM e)")
def point_access(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("large", F.lit(9007199254740993) + F.col("row_id"))
    return viewport.point(df, df.count() // 3, ["user_id", "event_type", "large"])


@query(f"""WITH {_E}, t AS (SELECT (min(tick) + max(tick)) // 2 AS t FROM e)
SELECT row_id, CASE WHEN tick % 1000000 = 0 THEN strftime(make_timestamp(tick), '%Y-%m-%dT%H:%M:%S') WHEN tick % 1000 = 0 THEN substr(strftime(make_timestamp(tick), '%Y-%m-%dT%H:%M:%S.%f'), 1, 23) ELSE strftime(make_timestamp(tick), '%Y-%m-%dT%H:%M:%S.%f') END AS "time", user_id::VARCHAR AS user_id, event_type FROM e, t ORDER BY abs(tick - t), row_id LIMIT 1""")
def cursor_readout(spark, sf_dir):
    df = events(spark, sf_dir)
    a, z = viewport.snap_range(df, None, None)
    return viewport.cursor(df, (a + z) // 2, ["user_id", "event_type"], "iso8601_naive", "us")


_SKIP = "(row_id % 97 = 5 OR row_id % 89 = 3)"


def _ragged(spark: SparkSession, sf_dir: str) -> str:
    """A file of events in which rows have a cell too many or one too few, whose last line is cut off."""
    df, comma = events(spark, sf_dir), F.lit(",")
    line = F.concat_ws(",", _iso("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "user_id", F.col("value").cast("string"))
    line = F.when(F.col("row_id") % 97 == 5, F.concat(line, comma, F.lit("x"))).when(F.col("row_id") % 89 == 3, F.substring_index(line, ",", 2)).otherwise(line)
    last = spark.range(1).select(F.lit(1 << 40).cast("bigint").alias("row_id"), F.lit("2024-01-01T00").alias("line"))
    return write_text(spark, "time,user,value", df.select("row_id", line.alias("line")).unionByName(last))


@query(f"WITH {_E} SELECT row_id AS source_row, 'ragged' AS skip_reason FROM e WHERE {_SKIP} UNION ALL SELECT count(*), 'ragged' FROM e")
def skipped_rows(spark, sf_dir):
    return text.scan(spark, _ragged(spark, sf_dir)).skipped


@query(f"WITH {_E}, o AS (SELECT 1 AS one, row_number() OVER (ORDER BY row_id) - 1 AS row_id, tick * 1000 AS tick FROM e WHERE NOT {_SKIP}), " + _SUM.format(by="one", of="o").replace("SELECT one, n, gap_count, CASE", "SELECT n AS row_count, (SELECT count(*) + 1 FROM e WHERE " + _SKIP + ") AS skipped_row_count, gap_count, CASE").replace("non_monotonic, duplicate_timestamp, median_dt\nFROM t", "non_monotonic, duplicate_timestamp, 'iso8601' AS timestamp_format, (SELECT count(*) FROM e WHERE " + _SKIP + ") > 0 AS low\nFROM t"))
def open_summary(spark, sf_dir):
    """A ragged file opened: counts, class and gaps of the rows that are left, and whether any guess is doubtful."""
    opened = report.open_path(spark, _ragged(spark, sf_dir))
    s = opened.summary
    row = (s.row_count, s.skipped_row_count, s.gap_count, s.sampling_class, s.non_monotonic, s.duplicate_timestamp, s.timestamp_format, opened.report.has_low())
    return spark.createDataFrame([row], "row_count long, skipped_row_count long, gap_count long, sampling_class string, non_monotonic long, duplicate_timestamp long, timestamp_format string, low boolean")


@query(f"WITH {_E} SELECT count(*) FILTER (WHERE NOT {_SKIP}) AS kept, count(*) FILTER (WHERE {_SKIP}) + 1 AS skipped FROM e")
def counts_only(spark, sf_dir):
    return spark.createDataFrame([text.counts(spark, _ragged(spark, sf_dir))], "kept long, skipped long")


@query(f"WITH {_E} SELECT row_id, row_id * 500000000 AS tick, value AS c1 FROM e")
def index_axis(spark, sf_dir):
    """A decimal-comma file whose time column is a plain index: progressive ticks, and values with a point."""
    index = F.concat(F.expr("row_id div 2").cast("string"), F.when(F.col("row_id") % 2 == 1, F.lit(".5")).otherwise(F.lit("")))
    lines = events(spark, sf_dir).select("row_id", F.concat_ws(";", index, F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(","))).alias("line"))
    opened = report.open_path(spark, write_text(spark, "index;value", lines))
    return opened.rows.select("row_id", F.col("tick").cast("bigint").alias("tick"), "c1")


@query(f"WITH {_E} SELECT row_id, row_id AS tick, user_id AS c1 FROM e")
def ordinal_axis(spark, sf_dir):
    """A file whose first column is neither time nor number: rows are numbered."""
    lines = events(spark, sf_dir).select("row_id", F.concat_ws(",", F.concat(F.lit("at "), "event_type"), "user_id").alias("line"))
    return report.open_path(spark, write_text(spark, "when,user", lines)).rows.select("row_id", "tick", "c1")


@query(f"WITH {_E} SELECT row_id, tick, value, event_type, user_id FROM e")
def cached_columns(spark, sf_dir):
    """Raw columns through the cache, numbers and text in their own types."""
    columns = ["value", "event_type", "user_id"]
    key, place = cache.key(spark, f"{sf_dir}/events.parquet", "raw"), f"{folder(spark)}/cache"
    cache.raw_columns(spark, place, key, events(spark, sf_dir), columns)
    return cache.raw_columns(spark, place, key, None, columns)


@query(f"WITH {_F}, n AS (SELECT count(*) AS n FROM f), l AS (SELECT unnest(generate_series(0, 12)) AS level) SELECT 'value' AS series, level::INT AS level, row_id // (8 ** (level + 1))::BIGINT AS bucket_id, {_BUCKET.format('row_id')} FROM f, n, l WHERE level = 0 OR ceil(n / (8 ** level)) >= 8 GROUP BY ALL")
def cached_pyramid(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    return cache.pyramids(spark, f"{folder(spark)}/cache", cache.key(spark, path, "pyramid"), parquet.read_series(spark, path), ["value"]).select("series", "level", "bucket_id", "min", "max", "first_ts", "last_ts", "nan_count")


@query(_PYRAMID)
def streaming_pyramid(spark, sf_dir):
    """Rows that arrive in three files, taken in by a stream; after a restart the state goes on where it was."""
    df, place = events(spark, sf_dir).select("row_id", "tick", "value"), new_place(spark, "stream")
    third = df.count() // 3 + 1
    for k in range(3):
        df.filter(F.expr(f"row_id div {third}") == k).coalesce(1).write.mode("append").parquet(f"{place}/in")
        state = progressive.PyramidState(spark, f"{place}/state")
        source = spark.readStream.schema(df.schema).parquet(f"{place}/in")
        progressive.stream_pyramid(source, state, f"{place}/checkpoint").awaitTermination()
    return state.table().select("level", "bucket_id", "min", "max", "first_ts", "last_ts", "nan_count")


@query(f"""WITH RECURSIVE {_E}, n AS (SELECT count(*) AS n FROM e), c AS (SELECT 500 AS rows UNION ALL SELECT rows * 2 FROM c, n WHERE rows * 2 < n), d AS (SELECT rows FROM c, n WHERE rows < n UNION SELECT n FROM n)
SELECT rows::BIGINT AS rows, max(tick) AS last_tick, min(value) AS low, max(value) AS high FROM d JOIN e ON row_id < rows GROUP BY rows""")
def progressive_prefixes(spark, sf_dir):
    df, seen = parquet.read_series(spark, f"{sf_dir}/events.parquet"), []
    progressive.load_progressive(df, df.count(), lambda prefix, n: seen.append((n, *prefix.agg(F.max("tick"), F.min("value"), F.max("value")).first())), first=500)
    return spark.createDataFrame(seen, "rows long, last_tick long, low double, high double")


@query("SELECT k, floor(k * 1000000 + k * 1000000 / (40.0::DOUBLE + k) * (16 * k + 32 + 8 * (k - 1)))::BIGINT AS needed, least(k * 3000000000 // 4, 4294967296) AS cap, k * 1000000 + k * 1000000 / (40.0::DOUBLE + k) * (16 * k + 32 + 8 * (k - 1)) <= least(k * 3000000000 // 4, 4294967296) AS fits FROM (SELECT unnest(range(1, 9)) AS k)")
def memory_budget(spark, sf_dir):
    rows = [(k, infer.footprint(k * 1_000_000, 40.0 + k, k), infer.budget(k * 3_000_000_000)) for k in range(1, 9)]
    return spark.createDataFrame([(*r, r[1] <= r[2]) for r in rows], "k long, needed long, cap long, fits boolean")


@query("SELECT strftime(make_timestamp(1700000000000000 + 1000 * i), '%Y-%m-%dT%H:%M:%S.') || lpad((i % 1000)::VARCHAR, 3, '0') || 'Z' AS timestamp, TRUE AS inside FROM range(0, 3000) t(i)")
def wave_fixture(spark, sf_dir):
    table = fixtures.wave_table(spark, 3000)
    inside = F.lit(True)
    for k in range(8):
        inside = inside & F.col(f"ch{k}").between(-1000, 1000)
    return table.select("timestamp", inside.alias("inside"))


@query(f"""WITH {_A}, c AS (SELECT series, count(*) AS n FROM a GROUP BY series), r AS (SELECT series, least(50, n - 50 * g) AS n FROM c, (SELECT unnest(range(0, 100000)) AS g) WHERE 50 * g < n)
SELECT series, FALSE AS refused, 9::BIGINT AS bins, (n - 16) // 8 + 1 AS segment_count FROM c WHERE series = 0
UNION ALL SELECT series, FALSE, 9, sum((n - 16) // 8 + 1)::BIGINT FROM r WHERE series = 1 AND n >= 16 GROUP BY series UNION ALL SELECT 2, TRUE, NULL, NULL""")
def spectrum_gate(spark, sf_dir):
    """A spectrum is given of a uniform axis, of one uniform between gaps by its runs, and refused of an irregular one."""
    df, out = axes(spark, sf_dir).withColumn("value", (F.col("row_id") * 37 % 101).cast("double")), []
    for k in range(3):
        try:
            s = welch.spectrum_of(df.filter(F.col("series") == k), 1_000_000, length=16).agg(F.count(F.lit(1)), F.max("segment_count")).first()
            out.append((k, False, s[0], s[1]))
        except welch.Refused:
            out.append((k, True, None, None))
    return spark.createDataFrame(out, "series long, refused boolean, bins long, segment_count long")
