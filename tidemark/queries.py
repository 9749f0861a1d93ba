"""The time-series queries over the driver's tables, each with equal DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os.path
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, timestamps
from .operators import anomaly, pyramid, timestats, viewport, welch
from .operators.rows import with_position, with_previous, with_row_id
from .plans import infer, report
from .sources import cache
from .sources.scratch import folder, new_place

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COLUMNS = 64


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id (by time, then id), tick in microseconds, user_id, event_type, value."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("tick"), "event_id", "user_id", "event_type", "value")
    return with_row_id(df, ["tick", "event_id"])


def by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with i: the row's position in its user's series."""
    return with_position(events(spark, sf_dir), ["user_id"]).drop("n")


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three made-up axes from the rows' positions: 0 uniform, 1 uniform between gaps, 2 irregular."""
    rows = events(spark, sf_dir).withColumn("series", F.col("user_id") % 3)
    rows = with_position(rows, ["series"])
    made = F.when(F.col("series") == 0, 1000 * F.col("i")).when(F.col("series") == 1, 1000 * F.col("i") + F.expr("i div 50") * 1_000_000).otherwise(7 * F.col("i") * F.col("i"))
    return rows.select("series", F.col("i").alias("row_id"), made.cast("bigint").alias("tick"))


def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events whose value is NaN in errors."""
    return events(spark, sf_dir).withColumn("value", F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")))


_E = "e AS (SELECT row_number() OVER (ORDER BY epoch_us(ts), event_id) - 1 AS row_id, epoch_us(ts) AS tick, event_id, user_id, event_type, value FROM events)"
_U = f"{_E}, u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_id) - 1 AS i FROM e)"
_A = f"""{_E}, s AS (SELECT user_id % 3 AS series, row_number() OVER (PARTITION BY user_id % 3 ORDER BY row_id) - 1 AS i FROM e),
a AS (SELECT series, i AS row_id, CASE series WHEN 0 THEN 1000 * i WHEN 1 THEN 1000 * i + (i // 50) * 1000000 ELSE 7 * i * i END AS tick FROM s)"""
_BUCKET = """coalesce(min(value) FILTER (WHERE NOT isnan(value)), 'inf'::DOUBLE) AS min, coalesce(max(value) FILTER (WHERE NOT isnan(value)), '-inf'::DOUBLE) AS max,
arg_min(tick, {0}) AS first_ts, arg_max(tick, {0}) AS last_ts, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS nan_count"""
_M = f"{_E}, m AS (SELECT row_id, tick, user_id, event_type, CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE ELSE value END AS value FROM e)"


def _columns(source: str, k: int, low: str = "NULL", high: str = "NULL") -> str:
    return f"""r AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM {source}
  WHERE tick >= coalesce({low}, tick) AND tick <= coalesce({high}, tick)),
c AS (SELECT *, CASE WHEN n <= {k} THEN i ELSE ((i + 1) * {k} - 1) // n END AS "column" FROM r)"""


_VIEW = f"""SELECT "column", CASE WHEN any_value(n) <= {{k}} THEN any_value(value) ELSE min END AS min, CASE WHEN any_value(n) <= {{k}} THEN any_value(value) ELSE max END AS max,
first_ts, last_ts, nan_count FROM (SELECT "column", any_value(n) AS n, any_value(value) AS value, {_BUCKET.format("row_id")} FROM c GROUP BY "column") GROUP BY ALL"""
_WHOLE = f"""WITH {_E}, {_columns("e", COLUMNS)} SELECT "column", {_BUCKET.format("row_id")} FROM c GROUP BY "column" """


@query(_WHOLE)
def viewport_events(spark, sf_dir):
    df = events(spark, sf_dir)
    low, high = viewport.snap_range(df, None, None)
    return viewport.viewport(df, low, high, COLUMNS, dense=True)


@query(f"WITH {_M}, {_columns('m', COLUMNS)} SELECT \"column\", {_BUCKET.format('row_id')} FROM c GROUP BY \"column\"")
def viewport_missing(spark, sf_dir):
    df = missing(spark, sf_dir)
    return viewport.viewport(df, *viewport.snap_range(df, 5, 3), COLUMNS)


@query(f"""WITH {_U}, r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM u),
c AS (SELECT *, CASE WHEN n <= 60 THEN i ELSE ((i + 1) * 60 - 1) // n END AS "column" FROM r)
SELECT user_id, "column", {_BUCKET.format("row_id")} FROM c GROUP BY user_id, "column" """)
def viewport_by_user(spark, sf_dir):
    df = events(spark, sf_dir)
    return viewport.viewport(df, *viewport.snap_range(df, None, None), 60, by=["user_id"])


@query(_WHOLE)
def viewport_pyramid(spark, sf_dir):
    """The first call builds the cached columns and levels; from then on only the level asked for is read, and raw rows at column edges."""
    key, place = cache.key(spark, f"{sf_dir}/events.parquet", "value"), f"{folder(spark)}/cache"
    levels = cache.pyramids(spark, place, key, events(spark, sf_dir).select("row_id", "tick", "value"), ["value"])
    raw = cache.raw_columns(spark, place, key, None, ["value"])
    return viewport.viewport_from_pyramid(raw, levels, 0, raw.count(), COLUMNS)


@query(f"""WITH {_E}, b AS (SELECT min(tick) AS a, max(tick) AS z FROM e)
SELECT row_id, tick, value FROM e, b WHERE tick BETWEEN a + (z - a) // 4 AND a + (z - a) // 2""")
def time_range_filter(spark, sf_dir):
    df = events(spark, sf_dir)
    a, z = viewport.snap_range(df, None, None)
    return viewport.in_range(df, a + (z - a) // 4, a + (z - a) // 2).select("row_id", "tick", "value")


@query(f"SELECT count(*) AS n, count(*) <= {COLUMNS} AS converged FROM events")
def viewport_converged(spark, sf_dir):
    df = events(spark, sf_dir)
    return viewport.is_converged(df, *viewport.snap_range(df, None, None), COLUMNS)


_PYRAMID = f"""WITH {_E}, n AS (SELECT count(*) AS n FROM e), l AS (SELECT unnest(generate_series(0, 12)) AS level)
SELECT level::INT AS level, row_id // (8 ** (level + 1))::BIGINT AS bucket_id, {_BUCKET.format("row_id")}
FROM e, n, l WHERE level = 0 OR ceil(n / (8 ** level)) >= 8 GROUP BY ALL"""


@query(_PYRAMID)
def pyramid_events(spark, sf_dir):
    return pyramid.build(events(spark, sf_dir), "value")


@query(_PYRAMID)
def pyramid_extended(spark, sf_dir):
    df = events(spark, sf_dir)
    half = df.count() * 3 // 7
    return pyramid.extend(pyramid.build(df.filter(F.col("row_id") < half), "value", rows=half), df.filter(F.col("row_id") >= half), "value", half)


@query(f"""WITH {_U}, n AS (SELECT user_id, count(*) AS n FROM u GROUP BY user_id), l AS (SELECT unnest(generate_series(0, 12)) AS level)
SELECT user_id, level::INT AS level, i // (8 ** (level + 1))::BIGINT AS bucket_id, {_BUCKET.format("i")}
FROM u JOIN n USING (user_id), l WHERE level = 0 OR ceil(n / (8 ** level)) >= 8 GROUP BY ALL""")
def pyramid_by_user(spark, sf_dir):
    return pyramid.build(by_user(spark, sf_dir), "value", ["user_id"], order="i")


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, epoch_us(o_orderdate) AS tick, o_totalprice AS a, o_custkey AS b FROM orders),
v AS (SELECT row_id, tick, 'o_totalprice' AS series, a AS value FROM p UNION ALL SELECT row_id, tick, 'o_custkey', b::DOUBLE FROM p), n AS (SELECT count(*) AS n FROM p), l AS (SELECT unnest(generate_series(0, 12)) AS level)
SELECT series, level::INT AS level, row_id // (8 ** (level + 1))::BIGINT AS bucket_id, min(value) AS min, max(value) AS max, arg_min(tick, row_id) AS first_ts, arg_max(tick, row_id) AS last_ts, 0::BIGINT AS nan_count
FROM v, n, l WHERE level = 0 OR ceil(n / (8 ** level)) >= 8 GROUP BY ALL""")
def pyramid_dataset(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("tick", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return pyramid.of_dataset(with_row_id(df, ["o_orderkey"]), ["o_totalprice", "o_custkey", "o_orderstatus"])


_D = "d AS (SELECT *, tick - lag(tick) OVER (PARTITION BY {by} ORDER BY row_id) AS dt, lag(row_id) OVER (PARTITION BY {by} ORDER BY row_id) AS before FROM {of})"
_G = _D + ", m AS (SELECT {by}, median(dt::DOUBLE) AS median_dt FROM d GROUP BY {by}), g AS (SELECT d.*, m.median_dt, coalesce(dt > 10 * median_dt, FALSE) AS is_gap FROM d JOIN m USING ({by}))"
_SEG = _G + ", q AS (SELECT *, sum(is_gap::INT) OVER (PARTITION BY {by} ORDER BY row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment, CASE WHEN NOT is_gap THEN dt::DOUBLE END AS step FROM g)"
_UNI = _SEG + """, sm AS (SELECT {by}, segment, count(*) AS n, count(step) AS steps, count(*) FILTER (WHERE step <> 0) AS nonzero, median(step) AS sm, min(row_id) AS first_index, max(row_id) AS last_index, arg_min(tick, row_id) AS first_tick, arg_max(tick, row_id) AS last_tick FROM q GROUP BY {by}, segment),
sa AS (SELECT {by}, segment, median(abs(step - sm)) AS mad FROM q JOIN sm USING ({by}, segment) WHERE step IS NOT NULL GROUP BY {by}, segment),
su AS (SELECT sm.*, CASE WHEN steps = 0 THEN TRUE WHEN sm = 0 THEN nonzero = 0 ELSE mad <= 0.01 * abs(sm) END AS uniform FROM sm LEFT JOIN sa USING ({by}, segment)),
wa AS (SELECT {by}, count(dt) AS steps, count(*) FILTER (WHERE dt <> 0) AS nonzero, any_value(median_dt) AS m, median(abs(dt - median_dt)) AS mad FROM g GROUP BY {by}),
wu AS (SELECT {by}, CASE WHEN steps = 0 THEN TRUE WHEN m = 0 THEN nonzero = 0 ELSE mad <= 0.01 * abs(m) END AS uniform FROM wa)"""
_SUM = _UNI + """, t AS (SELECT {by}, count(*) AS n, count(*) FILTER (WHERE is_gap) AS gap_count, count(*) FILTER (WHERE dt < 0) AS non_monotonic, count(*) FILTER (WHERE dt = 0) AS duplicate_timestamp, any_value(median_dt) AS median_dt FROM g GROUP BY {by}),
eu AS (SELECT {by}, bool_and(uniform) AS each FROM su GROUP BY {by})
SELECT {by}, n, gap_count, CASE WHEN gap_count = 0 AND wu.uniform THEN 'uniform' WHEN gap_count > 0 AND each THEN 'segmented_uniform' ELSE 'irregular' END AS sampling_class, non_monotonic, duplicate_timestamp, median_dt
FROM t JOIN eu USING ({by}) JOIN wu USING ({by})"""
_USER, _SERIES = {"by": "user_id", "of": "e"}, {"by": "series", "of": "a"}


@query(f"WITH {_E}, {_SUM.format(**_USER)}")
def time_stats_by_user(spark, sf_dir):
    return timestats.summarize(events(spark, sf_dir), ["user_id"])


@query(f"WITH {_A}, {_SUM.format(**_SERIES)}")
def sampling_class_axes(spark, sf_dir):
    return timestats.summarize(axes(spark, sf_dir), ["series"])


@query(f"WITH e0 AS (SELECT 1), {_E}, o AS (SELECT 1 AS one, * FROM e), {_SUM.format(by='one', of='o').replace('SELECT one, n, gap_count, CASE', 'SELECT n, gap_count, CASE')}")
def time_stats_events(spark, sf_dir):
    return timestats.summarize(events(spark, sf_dir))


@query(f"WITH {_E}, {_G.format(**_USER)} SELECT user_id, before AS before_index, row_id AS after_index, dt AS delta FROM g WHERE is_gap")
def gaps_by_user(spark, sf_dir):
    return timestats.gaps(events(spark, sf_dir), ["user_id"])


@query(f"WITH {_E}, o AS (SELECT 1 AS one, * FROM e), {_G.format(by='one', of='o')} SELECT before AS before_index, row_id AS after_index, dt AS delta FROM g WHERE is_gap")
def gaps_events(spark, sf_dir):
    return timestats.gaps(events(spark, sf_dir))


@query(f"WITH {_A}, {_UNI.format(**_SERIES)} SELECT series, segment, n, first_index, last_index, first_tick, last_tick, sm AS segment_median, uniform FROM su")
def segments_axes(spark, sf_dir):
    return timestats.segment_uniformity(axes(spark, sf_dir), ["series"])


@query(f"WITH {_E}, {_UNI.format(**_USER)} SELECT user_id, uniform FROM wu")
def is_uniform_by_user(spark, sf_dir):
    return timestats.is_uniform(events(spark, sf_dir), ["user_id"])


@query(f"WITH {_A}, {_UNI.format(**_SERIES)}, b AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, first_index) AS r FROM su WHERE uniform) SELECT series, first_index, last_index, n FROM b WHERE r = 1")
def largest_uniform_range(spark, sf_dir):
    return timestats.largest_uniform_range(axes(spark, sf_dir), ["series"])


@query(f"""WITH {_A}, {_G.format(**_SERIES)}, s2 AS (SELECT series, coalesce(sum(dt) FILTER (WHERE is_gap), 0)::DOUBLE AS g, (max(tick) - min(tick))::DOUBLE AS span FROM g GROUP BY series)
SELECT series, CASE WHEN span > 0 THEN g / span ELSE 0.0 END AS gap_share, CASE WHEN span > 0 THEN g / span ELSE 0.0 END > 0.5 AS offer_compression FROM s2""")
def gap_share(spark, sf_dir):
    return timestats.gap_share(axes(spark, sf_dir), ["series"])


@query(f"WITH {_E}, {_D.format(**_USER)}, m AS (SELECT user_id, median(dt::DOUBLE) AS m FROM d GROUP BY user_id) SELECT user_id, CASE WHEN m > 0 THEN 1000000.0::DOUBLE / m END AS sample_rate_hz FROM m")
def sample_rate_by_user(spark, sf_dir):
    return timestats.sample_rate(events(spark, sf_dir), 1_000_000, ["user_id"])


@query("""WITH d AS (SELECT epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey) AS dt FROM orders)
SELECT count(*) FILTER (WHERE dt < 0) AS non_monotonic, count(*) FILTER (WHERE dt = 0) AS duplicate_timestamp FROM d""")
def monotonicity_orders(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return timestats.monotonicity(df.select(F.col("o_orderkey").alias("row_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("tick")))


@query(f"WITH {_E} SELECT row_id, tick, lag(tick) OVER (ORDER BY row_id) AS prev_tick, tick - lag(tick) OVER (ORDER BY row_id) AS dt FROM e")
def deltas_events(spark, sf_dir):
    return timestats.deltas(events(spark, sf_dir).select("row_id", "tick"))


@query("WITH d AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY epoch_us(ts), event_id) AS dt FROM events) SELECT median(dt)::DOUBLE AS median_dt FROM d")
def exact_median(spark, sf_dir):
    found = timestats.exact_median(timestats.deltas(events(spark, sf_dir).select("row_id", "tick")), "dt")
    return spark.range(1).select(F.lit(found).cast("double").alias("median_dt"))


@query("SELECT row_number() OVER (ORDER BY epoch_us(o_orderdate), o_orderkey) - 1 AS row_id, o_orderkey, epoch_us(o_orderdate) AS tick FROM orders")
def sorted_axis(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return timestats.sorted_axis(df.select(F.col("o_orderkey").alias("row_id"), "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("tick")))


@query(f"""WITH {_E}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY row_id) AS b FROM e),
q AS (SELECT *, sum((b IS NULL OR b <> event_type)::INT) OVER (PARTITION BY user_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS band FROM p)
SELECT user_id, event_type AS state, min(row_id) AS first_index, max(row_id) AS last_index, arg_min(tick, row_id) AS first_tick, arg_max(tick, row_id) AS last_tick, count(*) AS n FROM q GROUP BY user_id, band, event_type""")
def state_bands_by_user(spark, sf_dir):
    return anomaly.bands(events(spark, sf_dir), "event_type", ["user_id"])


_NAN = "k AS (SELECT row_id, row_id - row_number() OVER (ORDER BY row_id) AS g FROM m WHERE isnan(value))"


@query(f'WITH {_M}, {_NAN} SELECT min(row_id) AS start, max(row_id) + 1 AS "end" FROM k GROUP BY g')
def nan_runs(spark, sf_dir):
    return anomaly.nan_runs(missing(spark, sf_dir), "value")


_OUT = """x AS (SELECT row_id, value, abs(value - (SELECT median(value) FROM m WHERE NOT isnan(value))) AS away FROM m WHERE NOT isnan(value)),
z AS (SELECT row_id, value, CASE WHEN (SELECT median(away) FROM x) > 0 THEN 0.6745 * away / (SELECT median(away) FROM x) WHEN away > 0 THEN 'inf'::DOUBLE ELSE 0 END AS score FROM x)"""


@query(f"WITH {_M}, {_OUT} SELECT row_id, value, score FROM z WHERE score > 3.5")
def outliers_mad(spark, sf_dir):
    return anomaly.outliers(missing(spark, sf_dir), "value")


@query(f"""WITH {_M}, {_NAN}, {_OUT}, o AS (SELECT 1 AS one, row_id, tick FROM m), {_G.format(by="one", of="o").replace(", m AS", ", md AS").replace("JOIN m USING", "JOIN md USING").replace("m.median_dt", "md.median_dt")},
w AS (SELECT 'missing' AS kind, min(row_id) AS first_index, max(row_id) AS last_index FROM k GROUP BY k.g
 UNION ALL SELECT 'gap', before, row_id FROM g WHERE is_gap UNION ALL SELECT 'outlier', row_id, row_id FROM z WHERE score > 3.5)
SELECT kind, first_index, last_index, a.tick AS first_tick, b.tick AS last_tick FROM w JOIN m a ON a.row_id = first_index JOIN m b ON b.row_id = last_index""")
def anomaly_gutter(spark, sf_dir):
    return anomaly.gutter(missing(spark, sf_dir).select("row_id", "tick", "value"), "value")


@query(f"WITH {_E} SELECT row_id, tick, event_type AS marker FROM e WHERE event_type = 'signup'")
def markers(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_type")).otherwise(F.lit("")))
    return anomaly.markers(df, "mark")


@query(f"""WITH {_E}, {_columns("e", COLUMNS)} SELECT "column", CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS state, count(DISTINCT event_type) > 1 AS multiple FROM c GROUP BY "column" """)
def state_decimation(spark, sf_dir):
    df = events(spark, sf_dir)
    return viewport.state_columns(df, *viewport.snap_range(df, None, None), COLUMNS, "event_type")


@query("""SELECT 'l_orderkey' AS series, count(*) FILTER (WHERE abs(l_orderkey) > 9007199254740992) AS lossy FROM lineitem
UNION ALL SELECT 'big', count(*) FILTER (WHERE l_orderkey * 400000000000 > 9007199254740992) FROM lineitem""")
def precision_flag(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_orderkey") * 400_000_000_000).alias("big"))
    return anomaly.precision_loss(df, ["l_orderkey", "big"])


@query("""SELECT 'l_quantity' AS series, min(l_quantity) = max(l_quantity) AS constant FROM lineitem UNION ALL SELECT 'one', count(DISTINCT 1 + 0 * l_linenumber) = 1 FROM lineitem
UNION ALL SELECT 'zero', count(DISTINCT CASE WHEN l_linenumber = 1 THEN '-0' ELSE '0' END) = 1 FROM lineitem""")
def is_constant(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", F.lit(1).alias("one"), F.when(F.col("l_linenumber") == 1, -(F.col("l_quantity") * 0.0)).otherwise(F.col("l_quantity") * 0.0).alias("zero"))
    return anomaly.is_constant(df, ["l_quantity", "one", "zero"])


_TEXT = "x AS (SELECT unnest(['o_orderkey', 'o_totalprice', 'o_orderstatus', 'flag']) AS series, unnest([o_orderkey::VARCHAR, o_totalprice::VARCHAR, o_orderstatus, (o_orderkey % 2)::VARCHAR]) AS cell FROM orders)"
_DTYPE = "CASE WHEN bool_and(lower(cell) IN ('true', 'false', '0', '1')) THEN 'bool' WHEN bool_and(regexp_full_match(cell, '[+-]?[0-9]+') AND try_cast(cell AS BIGINT) IS NOT NULL) THEN 'i64' WHEN bool_and(try_cast(cell AS DOUBLE) IS NOT NULL) THEN 'f64' ELSE 'string' END"


@query(f"WITH {_TEXT} SELECT series, {_DTYPE} AS dtype, bool_and(cell IN ('0', '1')) AS ambiguous, count(*) AS n FROM x GROUP BY series")
def dtype_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderstatus")], (F.col("o_orderkey") % 2).cast("string").alias("flag"))
    return infer.scan_dtypes(as_text, as_text.columns)


@query(f"WITH {_M} SELECT min(tick)::DOUBLE AS x_min, max(tick)::DOUBLE AS x_max, min(value) FILTER (WHERE NOT isnan(value)) AS y_min, max(value) FILTER (WHERE NOT isnan(value)) AS y_max FROM m")
def fit_bounds(spark, sf_dir):
    return viewport.fit_bounds(missing(spark, sf_dir), ["value"])


@query(f"WITH {_E}, t AS (SELECT (min(tick) + max(tick)) // 2 AS t FROM e) SELECT row_id, tick, value FROM e, t ORDER BY abs(tick - t), row_id LIMIT 1")
def nearest_sample(spark, sf_dir):
    df = events(spark, sf_dir)
    a, z = viewport.snap_range(df, None, None)
    return viewport.nearest(df, (a + z) // 2, columns=["row_id", "tick", "value"])


@query(f"""WITH {_E}, b AS (SELECT min(tick) AS a, max(tick) AS z FROM e)
SELECT ((tick - a) * {COLUMNS}) // (z - a + 1) AS "column", {_BUCKET.format("row_id")} FROM e, b GROUP BY ALL""")
def viewport_time_bins(spark, sf_dir):
    df = events(spark, sf_dir)
    return viewport.time_bins(df, *viewport.snap_range(df, None, None), COLUMNS)


@query(f"WITH {_A}, {_G.format(**_SERIES)} SELECT series, row_id, tick, sum(CASE WHEN is_gap THEN 500 ELSE coalesce(dt, 0) END) OVER (PARTITION BY series ORDER BY row_id ROWS UNBOUNDED PRECEDING)::BIGINT AS x FROM g")
def compressed_axis(spark, sf_dir):
    return viewport.compressed_axis(axes(spark, sf_dir), 500, ["series"]).select("series", "row_id", "tick", "x")


@query(f"""WITH {_M}, {_columns("m", 5000)}, b AS (SELECT "column", {_BUCKET.format("row_id")}, any_value(n) AS n, any_value(value) AS v FROM c GROUP BY "column"),
g AS (SELECT "column", min > max AS gap FROM b), s AS (SELECT *, sum(gap::INT) OVER (ORDER BY "column" ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM g)
SELECT segment, min("column") AS first_column, max("column") AS last_column, count(*) AS n FROM s WHERE NOT gap GROUP BY segment""")
def line_segments(spark, sf_dir):
    df = missing(spark, sf_dir)
    return viewport.line_segments(viewport.viewport(df, *viewport.snap_range(df, None, None), 5000))


def _stamp(spark, sf_dir, make, fmt: str) -> DataFrame:
    df = events(spark, sf_dir).select("row_id", make.alias("text"))
    parsed = timestamps.parse(F.col("text"), fmt)
    out = df.withColumn("p", parsed)
    return out.select("row_id", "text", F.col("p.ticks").cast("bigint").alias("ticks"), F.col("p.unit").alias("unit"), timestamps.format_ticks(F.col("p"), fmt).alias("back"))


@query(f"WITH {_E} SELECT row_id, tick::VARCHAR AS text, tick AS ticks, 'us' AS unit, tick::VARCHAR AS back FROM e")
def parse_epoch_us(spark, sf_dir):
    return _stamp(spark, sf_dir, F.col("tick").cast("string"), "epoch_us")


@query(f"WITH {_E}, s AS (SELECT row_id, tick // 1000000 + 2082844800 AS s FROM e) SELECT row_id, s::VARCHAR AS text, (s - 2082844800) * 1000000000 AS ticks, 'ns' AS unit, s::VARCHAR AS back FROM s")
def parse_labview(spark, sf_dir):
    return _stamp(spark, sf_dir, (F.expr("tick div 1000000") + 2_082_844_800).cast("string"), "labview_epoch")


@query(f"WITH {_E}, s AS (SELECT row_id, tick // 86400000000 + 25569 AS d FROM e) SELECT row_id, d::VARCHAR AS text, (d - 25569) * 86400000000000 AS ticks, 'ns' AS unit, d::VARCHAR AS back FROM s")
def parse_excel_serial(spark, sf_dir):
    return _stamp(spark, sf_dir, (F.expr("tick div 86400000000") + 25_569).cast("string"), "excel_serial")


@query(f"""WITH {_E}, s AS (SELECT row_id, tick - tick % 1000 AS t FROM e), w AS (SELECT row_id, t, strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S') || '.' || lpad(((t // 1000) % 1000)::VARCHAR, 3, '0') AS text FROM s)
SELECT row_id, text, t * 1000 AS ticks, 'ns' AS unit, CASE WHEN t % 1000000 = 0 THEN substr(text, 1, 19) ELSE text END AS back FROM w""")
def parse_datetime_space(spark, sf_dir):
    return _stamp(spark, sf_dir, F.date_format(F.timestamp_micros("tick"), "yyyy-MM-dd HH:mm:ss.SSS"), "datetime_space")


@query(f"""WITH {_E}, x AS (SELECT unnest(['iso8601', 'micros', 'type']) AS series, unnest([strftime(make_timestamp(tick), '%Y-%m-%dT%H:%M:%S.%fZ'), tick::VARCHAR, event_type]) AS cell FROM e)
SELECT series, CASE WHEN bool_and(regexp_full_match(cell, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:.]+Z')) THEN 'iso8601' WHEN bool_and(try_cast(cell AS BIGINT) BETWEEN 1000000000000000 AND 9999999999999999) THEN 'epoch_us' END AS format, FALSE AS ambiguous FROM x GROUP BY series""")
def infer_timestamps(spark, sf_dir):
    df = events(spark, sf_dir).select(F.concat(F.date_format(F.timestamp_micros("tick"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("iso8601"), F.col("tick").cast("string").alias("micros"), F.col("event_type").alias("type"))
    found = [(c, *infer.infer_timestamp_format(df, c)) for c in df.columns]
    return spark.createDataFrame(found, "series string, format string, ambiguous boolean")


@query(f"WITH {_E} SELECT row_id, tick * 1000 AS tick, user_id AS c1, event_type AS c2, value AS c3 FROM e")
def text_round_trip(spark, sf_dir):
    """events written as delimited text with odd quotes and opened again by inference."""
    df = events(spark, sf_dir)
    stamp = F.concat(F.date_format(F.timestamp_micros("tick"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    lines = df.select("row_id", F.concat_ws(";", stamp, "user_id", F.concat(F.lit('"'), F.col("event_type"), F.lit('"')), F.format_string("%s", "value")).alias("line"))
    opened = report.open_text(spark, write_text(spark, "time;user;type;value", lines))
    return opened.rows.select("row_id", "tick", "c1", "c2", "c3")


def write_text(spark: SparkSession, header: str, lines: DataFrame) -> str:
    """One text file of a header and ``lines`` (row_id, line) in order; its path."""
    place = new_place(spark, "text") + ".csv"
    first = spark.range(1).select(F.lit(-1).cast("bigint").alias("row_id"), F.lit(header).alias("line"))
    lines.unionByName(first).coalesce(1).sortWithinPartitions("row_id").select("line").write.text(place)
    part = spark.read.text(place).select(F.input_file_name()).first()[0]
    target = f"{place}/whole.csv"
    jvm = spark.sparkContext._jvm
    source, goal = jvm.org.apache.hadoop.fs.Path(f"{place}/{os.path.basename(part)}"), jvm.org.apache.hadoop.fs.Path(target)
    source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(source, goal)
    return target


@query(f"WITH {_E} SELECT user_id, max_by(event_type, row_id) AS last_type, sum(i)::BIGINT AS points FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_id) AS i FROM e) GROUP BY user_id")
def row_positions(spark, sf_dir):
    df = with_previous(by_user(spark, sf_dir), ["event_type"], ["user_id"])
    return df.groupBy("user_id").agg(F.max_by("event_type", "row_id").alias("last_type"), F.sum(F.col("i") + 1).alias("points"))


#: A discrete Fourier transform by sums of cosines; segments of L samples of runs, by Hann windows, averaged by run and over runs by their lengths.
_DFT = """w AS (SELECT run, n, L, unnest(range(0, (n - L) // (L // 2) + 1)) AS s FROM runs WHERE n >= L),
g AS (SELECT w.run, w.n, w.L, w.s, x.i - w.s * (w.L // 2) AS j, x.value FROM w JOIN x ON x.run = w.run AND x.i >= w.s * (w.L // 2) AND x.i < w.s * (w.L // 2) + w.L),
av AS (SELECT run, s, avg(value) AS mu FROM g GROUP BY run, s),
y AS (SELECT run, n, L, s, j, (value - mu) * (0.5 - 0.5 * cos(2 * pi() * j / L)) AS v FROM g JOIN av USING (run, s)),
k AS (SELECT unnest(range(0, (SELECT max(L) FROM runs) // 2 + 1)) AS bin),
t AS (SELECT run, n, L, s, bin, sum(v * cos(2 * pi() * ((bin * j) % L) / L)) AS re, sum(v * sin(2 * pi() * ((bin * j) % L) / L)) AS im FROM y, k GROUP BY ALL),
p AS (SELECT run, n, L, bin, avg((re * re + im * im) / (1000.0::DOUBLE * L * 0.375) * CASE WHEN bin = 0 OR 2 * bin = L THEN 1 ELSE 2 END) AS power, count(*) AS many FROM t GROUP BY run, n, L, bin)
SELECT bin, bin * (1000.0::DOUBLE / any_value(L)) AS freq, round(sum(power * n) / sum(n), 6) AS power, sum(many)::BIGINT AS segment_count FROM p GROUP BY bin"""


@query(f"""WITH {_E}, x AS (SELECT 0 AS run, row_id AS i, value FROM e), runs AS (SELECT 0 AS run, count(*) AS n, least(65536, greatest(256, (2 ** floor(log2(count(*) // 8)))::BIGINT)) AS L FROM e), {_DFT}""")
def welch_psd(spark, sf_dir):
    return welch.welch(events(spark, sf_dir).select("row_id", "value"), 1000.0).withColumn("power", F.round("power", 6))


@query(f"""WITH {_M}, h AS (SELECT *, sum(isnan(value)::INT) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS run FROM m),
x AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY row_id) - 1 AS i, value FROM h WHERE NOT isnan(value)), runs AS (SELECT run, count(*) AS n, 16::BIGINT AS L FROM x GROUP BY run), {_DFT}""")
def welch_segmented(spark, sf_dir):
    runs = anomaly_free_runs(spark, sf_dir)
    return welch.welch_segmented(runs, 1000.0, 16)[0].withColumn("power", F.round("power", 6))


def anomaly_free_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return welch.clean_runs(missing(spark, sf_dir).select("row_id", "value"))


@query("""SELECT 'true' AS cell, TRUE AS as_bool, NULL::BIGINT AS as_i64, NULL::DOUBLE AS as_f64 UNION ALL SELECT '1', TRUE, 1, 1.0 UNION ALL SELECT 'yes', NULL, NULL, NULL
UNION ALL SELECT ' +7 ', NULL, 7, 7.0 UNION ALL SELECT '1e3', NULL, NULL, 1000.0 UNION ALL SELECT '1d', NULL, NULL, NULL UNION ALL SELECT '9223372036854775807', NULL, 9223372036854775807, 9223372036854775807.0
UNION ALL SELECT '-Infinity', NULL, NULL, '-inf'::DOUBLE UNION ALL SELECT '', NULL, NULL, NULL""")
def parse_cells(spark, sf_dir):
    cells = spark.createDataFrame([(c,) for c in ("true", "1", "yes", " +7 ", "1e3", "1d", "9223372036854775807", "-Infinity", "")], "cell string")
    c = F.col("cell")
    return cells.select(c, text.parse_bool(c).alias("as_bool"), text.parse_i64(c).alias("as_i64"), text.parse_f64(c).alias("as_f64"))
