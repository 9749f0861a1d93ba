"""The corpus queries opN_<name>, each its operator with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, lm, mixing, pii, quality, search, tokens, toxicity, urlfilter
from .base import held_out, table

TOKENIZER = "byte_bpe_50k.json"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeat=3, keep=["doc_id"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels, "toxic", modulus=3, held_out=1)
    scored = toxicity.apply(docs, net, ["doc_id"], threshold=0.7)
    return scored.select("doc_id", held_out(scored, "doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), modulus=10, remainder=0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"], edited=True)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=512)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), size=5, percent=75).select("doc_id", "n_shingles", "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels, "quality", modulus=5, held_out=0)
    scored = quality.apply(docs, net, ["doc_id"], threshold=0.3)
    return scored.select("doc_id", held_out(scored, "doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on day page_id mod 365; the dated list comes from their hosts by a rule."""
    start = "2024-01-01 00:00:00"
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.make_dt_interval(days=F.pmod(F.col("page_id"), F.lit(365)).cast("int"))
    captures = pages.withColumn("fetched_at", F.expr(f"timestamp_ntz '{start}'") + day)
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    judged = urlfilter.judge(captures, urlfilter.sample_events(hosts, start))
    return judged.select("page_id", "host", "n_block", "n_allow", "blocked")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"), ["doc_id"])


def op10_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "documents"), every=20, k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_toxicity, op3_katz_scores, op4_decontaminate, op5_token_counts, op6_jaccard_join, op7_quality, op8_url_filter, op9_personal_data, op10_search)
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HEX = "('0x' || substr({0}, 1, {1}))::BIGINT"

ORACLES: dict[str, str] = {
    "op1_mix_sources": f"""
WITH d AS (
  SELECT doc_id, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         md5('7:' || coalesce(doc_id::VARCHAR, '')) AS o, md5(coalesce(text, '')) AS t
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS ss FROM d GROUP BY k),
r AS (SELECT k, ss, ss * 3.0::DOUBLE AS cap, sum(ss) OVER ()::BIGINT AS total,
             [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS w FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
                / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS here FROM r),
f AS (SELECT k, ss, cap, w, total, max(CASE WHEN here <= cap / w THEN here END) OVER () AS level FROM l),
g AS (SELECT k, ss, total, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM f),
c AS (SELECT k, ss, target, floor(total / 8 + 0.5)::BIGINT AS seats, target / (2 * i + 1) AS q, i
      FROM (SELECT *, unnest(generate_series(0, (ceil(ss / 8) * 3)::BIGINT - 1)) AS i FROM g)),
e AS (SELECT *, row_number() OVER (ORDER BY q DESC, k, i) <= seats AS won FROM c),
q AS (SELECT g.k, g.ss, g.target, coalesce(n, 0) AS seats, greatest(1, ceil(g.ss / 32768))::BIGINT AS shards
      FROM g LEFT JOIN (SELECT k, count(*) FILTER (WHERE won) AS n FROM e GROUP BY k) USING (k)),
p AS (SELECT d.*, q.ss, q.target, q.seats, {_HEX.format("o", 8)} % q.shards AS sh FROM d JOIN q USING (k)),
h AS (SELECT k, sh, sum(size)::BIGINT AS words, any_value(seats) AS seats FROM p GROUP BY k, sh),
hc AS (SELECT k, sh, seats, words / (2 * i + 1) AS q, i
       FROM (SELECT *, unnest(generate_series(0, (ceil(words / 8) * 3)::BIGINT - 1)) AS i FROM h)),
he AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q DESC, sh, i) <= seats AS won FROM hc),
hq AS (SELECT h.k, h.sh, greatest(1, ceil(h.words / 8))::BIGINT AS nb, coalesce(n, 0)::BIGINT AS quota
       FROM h LEFT JOIN (SELECT k, sh, count(*) FILTER (WHERE won) AS n FROM he GROUP BY k, sh) USING (k, sh)),
z AS (SELECT p.*, hq.nb, quota // nb AS passes, quota % nb AS extra,
             {_HEX.format("md5('7:' || p.k || ':' || p.sh::VARCHAR)", 7)} % nb AS off,
             sum(size) OVER (PARTITION BY p.k, p.sh ORDER BY o, size, t ROWS UNBOUNDED PRECEDING)::BIGINT AS fin
      FROM p JOIN hq ON p.k = hq.k AND p.sh = hq.sh),
y AS (SELECT *, fin - size AS beg FROM z)
SELECT doc_id, size, ss AS source_size, target,
  (passes * size
   + ((fin // 8 * extra + off) // nb - off // nb) * 8 + (((fin // 8 + 1) * extra + off) // nb - (fin // 8 * extra + off) // nb) * (fin % 8)
   - ((beg // 8 * extra + off) // nb - off // nb) * 8 - (((beg // 8 + 1) * extra + off) // nb - (beg // 8 * extra + off) // nb) * (beg % 8))::BIGINT AS taken
FROM y""",
    "op6_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT o.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(o.doc_id, coalesce(m.b, o.doc_id)) AS component_id
FROM documents o LEFT JOIN n ON n.doc_id = o.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = o.doc_id""",
    "op8_url_filter": r"""
WITH p AS (SELECT page_id, url, page_id % 365 AS at, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)', 1) AS seg FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 4))::BIGINT AS n FROM p WHERE host IS NOT NULL),
e AS (SELECT host AS pattern, 'block' AS action, n % 200 AS since, CASE WHEN n % 8 = 0 THEN n % 200 + 60 ELSE 100000 END AS until FROM h WHERE n % 4 = 0
      UNION ALL SELECT host, 'block', n % 200 + 100, 100000 FROM h WHERE n % 8 = 0
      UNION ALL SELECT 'spam-farm.example.org', 'domain', 10, 100000
      UNION ALL SELECT host || '/en', 'allow', n % 150, 100000 FROM h WHERE n % 5 = 0),
v AS (SELECT p.page_id, p.url, count(*) FILTER (WHERE e.action <> 'allow') AS b, count(*) FILTER (WHERE e.action = 'allow') AS a
      FROM p JOIN e ON (e.action = 'block' AND e.pattern = p.host OR e.action = 'allow' AND e.pattern = p.host || '/' || p.seg
                        OR e.action = 'domain' AND (p.host = e.pattern OR ends_with(p.host, '.' || e.pattern)))
                   AND e.since <= p.at AND p.at < e.until GROUP BY p.page_id, p.url)
SELECT p.page_id, p.host, coalesce(v.b, 0)::BIGINT AS n_block, coalesce(v.a, 0)::BIGINT AS n_allow, coalesce(v.b > 0 AND v.a = 0, FALSE) AS blocked
FROM p LEFT JOIN v ON p.page_id = v.page_id AND p.url = v.url""",
    "op10_search": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, len(w) AS dl, w FROM d WHERE len(w) > 0),
t AS (SELECT doc_id, dl, u AS word, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS u FROM x) GROUP BY ALL),
g AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avg FROM x),
f AS (SELECT word, count(*) AS df, ln(1 + ((SELECT n FROM g) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t GROUP BY word HAVING count(*) > 1),
q AS (SELECT doc_id AS query_id, word, idf FROM t JOIN f USING (word) WHERE doc_id % 20 = 0),
s AS (SELECT query_id, t.doc_id, sum(floor(q.idf * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / (SELECT avg FROM g))) * 1000000 + 0.5))::BIGINT AS points
      FROM q JOIN t USING (word) WHERE t.doc_id <> query_id GROUP BY ALL HAVING points > 0)
SELECT query_id, r::INT AS rank, doc_id, points / 1000000.0::DOUBLE AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, doc_id) AS r FROM s) WHERE r <= 10""",
}
