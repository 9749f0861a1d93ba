"""URL filters by a temporal list join, in DataFrame operations only.

A dated list is a table of events: a list adds or removes an entry (a host, a domain with
all below it, or a host's first path segment) at a time, to block or to allow. Events of an
entry, in order of time, become validity intervals [from, until). A capture's keys (its
host, every parent domain, its host and first path segment) meet the entries by an
equi-join, kept to those active when the capture was fetched. A capture is blocked if an
entry to block is active and none to allow.

Captures with the same host, segment and time have the same verdict, so keys are only made
for distinct ones (pre-aggregated before the shuffle); verdicts return by a join on all
three, which spreads a hot host over its times and segments; AQE splits what is left. A bare
top-level domain, which a large part of all hosts share, is a key only if a list has such an entry.

Defined results: a null or malformed URL has a null host and isn't blocked, nor is a capture
without a time; of events of one entry at the same time a removal counts last; a repeated
event changes nothing; repeated rows each get theirs; an empty table of either kind works
(no captures: no rows; no events: nothing blocked); extra columns ride along except those
named like a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(F.length(host) > 0, host)


def segment_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)


def intervals(events: DataFrame) -> DataFrame:
    """kind, pattern, action, since, until of every stretch in which an entry is on a list.

    ``events``: list, kind (host, domain, path), pattern, action (block, allow), op (add, remove), at.
    """
    line = Window.partitionBy("list", "kind", "pattern", "action").orderBy("at", "op")
    return events.filter(F.col("at").isNotNull()).withColumn("until", F.lead("at").over(line)).filter("op = 'add'").select("list", "kind", "pattern", "action", F.col("at").alias("since"), "until").filter("until is null or until > since")


def judge(captures: DataFrame, events: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with host, n_block, n_allow (active entries met) and blocked."""
    keep = [c for c in captures.columns if c not in ("host", "n_block", "n_allow", "blocked")]
    marked = captures.select(*keep, host_of(F.col(url_col)).alias("host"), segment_of(F.col(url_col)).alias("__segment"), F.col(time_col).alias("__at"))
    known = marked.filter("host is not null and __at is not null").select("host", "__segment", "__at").distinct()
    labels, entries = F.split("host", r"\."), intervals(events)
    bare = bool(entries.filter((F.col("kind") == "domain") & ~F.contains("pattern", F.lit("."))).take(1))
    last = F.size(labels) if bare else F.greatest(F.size(labels) - 1, F.lit(1))
    parents = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("pattern")), F.struct(F.lit("path").alias("kind"), F.concat("host", F.lit("/"), "__segment").alias("pattern")))
    keyed = known.withColumn("key", F.explode(F.concat(exact, parents))).select("host", "__segment", "__at", "key.kind", "key.pattern")
    active = keyed.join(entries, ["kind", "pattern"]).filter((F.col("since") <= F.col("__at")) & (F.col("until").isNull() | (F.col("__at") < F.col("until"))))
    verdicts = active.groupBy("host", "__segment", "__at").agg(F.count_if(F.col("action") == "block").alias("n_block"), F.count_if(F.col("action") == "allow").alias("n_allow"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_block", "n_allow")]
    return marked.join(verdicts, ["host", "__segment", "__at"], "left").select(*keep, "host", *counts).withColumn("blocked", (F.col("n_block") > 0) & (F.col("n_allow") == 0))


def sample_events(hosts: DataFrame, start: str) -> DataFrame:
    """A dated list over a table of hosts (column host), made by rule from md5 digits.

    One host in four is blocked from some day; half of these are taken off 60 days later and
    put back after 40 more. One in five has its English pages allowed. A spam domain is blocked from day 10.
    """
    day = lambda n: F.expr(f"timestamp_ntz '{start}'") + F.make_dt_interval(days=n)
    number = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 4), 16, 10).cast("int")
    one = hosts.select("host", number.alias("n")).distinct()

    def events(df: DataFrame, kind: str, pattern: Column, action: str, op: str, at: Column) -> DataFrame:
        return df.select(F.lit("daily").alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), F.lit(op).alias("op"), day(at).alias("at"))

    blocked = one.filter("n % 4 = 0")
    first = (F.col("n") % 200).cast("int")
    out = events(blocked, "host", F.col("host"), "block", "add", first)
    out = out.unionByName(events(blocked.filter("n % 8 = 0"), "host", F.col("host"), "block", "remove", first + 60))
    out = out.unionByName(events(blocked.filter("n % 8 = 0"), "host", F.col("host"), "block", "add", first + 100))
    out = out.unionByName(events(one.filter("n % 5 = 0"), "path", F.concat("host", F.lit("/en")), "allow", "add", (F.col("n") % 150).cast("int")))
    spam = hosts.sparkSession.range(1).select(F.lit("spam-farm.example.org").alias("host"))
    return out.unionByName(events(spam, "domain", F.col("host"), "block", "add", F.lit(10)))
