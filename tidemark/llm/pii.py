"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from four patterns and their checks (e-mail, IP, card with Luhn, phone) and
always stay. Wider patterns propose candidates beyond them. Labelers vote on every
candidate and base span (1 yes, -1 no, 0 no opinion): pattern labelers (form, length,
placeholders), gazetteers (mail domains, number prefixes) and context labelers (words before, what
touches the span). Votes are counted by pattern of votes; expectation-maximisation over
these counts estimates each labeler's reliability and every pattern's probability, and a
logistic span classifier is trained on those probabilities over the votes, the kind and the
length. Counting runs on the cluster; the driver sees one row a pattern of votes, whose
number is bounded by the labelers (3^7 times kinds and lengths), not by the data. The
classifier is applied as a column expression.

Positions: splitting by a pattern and extracting its matches give alternating pieces, whose
lengths add up to code-point positions; sums run in blocks of about the square root of their
number (``running``), and text at a position is cut from pieces of ``PIECE`` characters (``cut``), so a text of very many
spans costs little more than its length. Patterns start only at the start of a run of their
first class (or where the last match ended) and take runs possessively, which finds the
same matches in linear time. Wider patterns take runs of any length, too.

Defined results: null text is empty and has no spans; repeated rows each get theirs; texts
are searched whole; without candidates nothing is added; an empty table gives an empty
result; extra columns ride along except those named like a result column.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import settle

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, as linear-time equals (see above).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}
#: Wider patterns for candidates.
WIDER = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,}+)++",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
ALL_KINDS = KINDS + ("national_id", "iban")
#: Gazetteers.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|us|ca|au|ch|at|it|nl"
COUNTRIES = "AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK"
#: Context words.
BEFORE_YES = r"(?i)(?:mail|contact|write|reach|tel|phone|call|mobile|fax|whatsapp|card|visa|ip|host|address|ssn|social security|iban|account|konto|telefon|tel[eé]fono|correo)\W{0,6}(?:\w+\W{1,3}){0,2}$"
BEFORE_NO = r"(?i)(?:version|release|licen[sc]e|isbn|issn|doi|page|chapter|section|order|invoice|item|sku|part|model|build|id|no\.?|nr\.?|figure|table)\W{0,4}$"
PLACEHOLDER = r"(?:0{5,}|1{6,}|9{6,}|1234567|example\.(?:com|org|net)$|^127\.0\.0\.1$|^0\.0\.0\.0$|555-01[0-9]{2})"
LABELERS = 7
PIECE = 512
_SPANS = "array<struct<kind:string,start:int,end:int,votes:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda uses it for every element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running sums of an array of INT (or largest ones so far, as ``add`` says), block by block: a growing array is copied with every element."""

    def scan(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(add(F.element_at(acc, -1), x)))))

    def joined(parts: Column, heads: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda x: add(F.get(heads, i - 1), x)))))

    def blocks(v: Column, size: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: scan(F.slice(v, i * size + 1, size)))

    def whole(v: Column) -> Column:
        return let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: let(blocks(v, size), lambda parts: let(scan(F.transform(parts, lambda p: F.element_at(p, -1))), lambda heads: joined(parts, heads))))

    return let(values, lambda v: F.when(F.size(v) <= 16, scan(v)).otherwise(whole(v)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code-point positions, end exclusive."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))

    def placed(b: Column) -> Column:
        lengths = F.transform(b["found"], lambda x, i: F.length(x) + F.length(F.get(b["pieces"], i)))
        return let(running(lengths, _sum), lambda ends: F.transform(b["found"], lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end"), x.alias("value"))))

    return let(both, placed)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The text from ``start`` to before ``end``, of its ``pieces``."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    one = F.substr(piece(first), start % PIECE + 1, end - start)
    many = F.concat(F.substr(piece(first), start % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substr(piece(last), F.lit(1), end % PIECE))
    return F.when(end <= start, F.lit("")).when(first == last, one).otherwise(many)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        doubled = 2 * d
        return acc + F.when(i % 2 == 1, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _checked(kind: str, found: Column) -> Column:
    return F.filter(found, lambda x: _valid(kind, x["value"]))


def _count(kind: str) -> Column:
    return F.size(F.filter("__base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _hinted(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(HINT[kind])) if kind in ("email", "phone") else F.regexp_like(text, F.lit(HINT[kind]))


def _votes(kind: str, x: Column, parts: Column, based: bool) -> Column:
    """The seven votes on a span as one string of 0 (no), 1 (no opinion), 2 (yes). ``parts``: the text's ``pieces``."""
    value = x["value"]
    before = cut(parts, F.greatest(x["start"] - 40, F.lit(0)), x["start"])
    near = F.concat(F.when(x["start"] > 0, cut(parts, x["start"] - 1, x["start"])).otherwise(F.lit(" ")), F.lit("\n"), cut(parts, x["end"], x["end"] + 1))
    length = F.length(value)
    usual = {"email": (8, 60), "ip": (7, 15), "card": (16, 23), "phone": (9, 22), "national_id": (11, 11), "iban": (15, 42)}[kind]
    listed = {
        "email": F.regexp_like(value, F.lit(rf"(?i)(?:\.|\bdot\b\W*)(?:{DOMAINS})$")),
        "ip": ~F.regexp_like(value, F.lit(r"^(?:0|22[4-9]|2[34][0-9]|25[0-5])\.")),
        "card": F.regexp_like(value, F.lit(r"^(?:4|5[1-5]|2[2-7]|3[47]|6)")),
        "phone": F.regexp_like(value, F.lit(r"^(?:\+[1-9]|\(?[2-9][0-9]{2}\)?[ .-]?[2-9])")),
        "national_id": ~F.regexp_like(value, F.lit(r"^(?:000|666|9)|-00-|-0000$")),
        "iban": F.regexp_like(value, F.lit(rf"^(?:{COUNTRIES})")),
    }[kind]
    vote = lambda yes, no=None: F.when(yes, F.lit("2")).when(no if no is not None else F.lit(False), F.lit("0")).otherwise(F.lit("1"))
    return F.concat(
        F.lit("2" if based else "1"),
        vote(length.between(*usual), ~length.between(*usual)),
        vote(listed, ~listed),
        vote(F.regexp_like(before, F.lit(BEFORE_YES))),
        vote(F.lit(False), F.regexp_like(before, F.lit(BEFORE_NO))),
        vote(F.regexp_like(near, F.lit(r"^[\s(<\[\"']\n(?:[\s)>\]\"',.;:]|$)")), F.regexp_like(near, F.lit(r"^[\w/=&#-]|\n[\w/=&#-]"))),
        vote(F.lit(False), F.regexp_like(value, F.lit(PLACEHOLDER))),
    )


def find(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and, as arrays of (kind, start, end, votes), ``__base`` and ``__more``: base spans and candidates."""
    text = F.col("__text")
    df = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    none = F.array().cast(_SPANS)

    def shaped(kind: str, found: Column, based: bool) -> Column:
        voted = lambda xs: let(pieces(text), lambda parts: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _votes(kind, x, parts, based).alias("votes"))))
        return let(found, lambda xs: F.when(F.size(xs) == 0, none).otherwise(voted(xs)))

    base = {k: F.when(_hinted(text, k), shaped(k, _checked(k, matches(text, BASE[k])), True)).otherwise(none) for k in KINDS}
    spelled = F.contains(text, F.lit("[at]")) | F.contains(text, F.lit("(at)"))
    numbered = F.regexp_like(text, F.lit(r"[0-9]{3}[) .-]|[A-Z]{2}[0-9]{2}"))
    wider = [F.when(spelled if k == "email" else numbered, shaped(k, matches(text, p), False)).otherwise(none) for k, p in WIDER.items()]
    df = df.select("*", F.struct(F.concat(*base.values()).alias("base"), F.concat(*wider).alias("wide")).alias("__found"))
    return df.select(*keep, "__text", F.col("__found.base").alias("__base"), let(F.col("__found"), _apart).alias("__more"))


def _apart(found: Column) -> Column:
    """Wider spans that no base span overlaps. Of all spans in order of start, a wider one is clear if every base span before it ends before it, and the next after it starts behind it."""
    shape = lambda based: lambda x: F.struct(x["start"].alias("start"), F.lit(based).alias("based"), x["end"].alias("end"), x.alias("span"))
    line = F.array_sort(F.concat(F.transform(found["base"], shape(True)), F.transform(found["wide"], shape(False))))
    never = 1 << 30

    def clear(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: F.when(x["based"], x["end"]).otherwise(F.lit(-1))), F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(xs), lambda x: F.when(x["based"], -x["start"]).otherwise(F.lit(-never))), F.greatest))
        kept = lambda e, s: F.filter(xs, lambda x, i: ~x["based"] & (F.get(e, i) <= x["start"]) & (-F.get(s, i) >= x["end"]))
        return let(ends, lambda e: let(starts, lambda s: F.transform(kept(e, s), lambda x: x["span"])))

    return F.when((F.size(found["base"]) == 0) | (F.size(found["wide"]) == 0), found["wide"]).otherwise(let(line, clear))


def _length_class(x: Column) -> Column:
    return F.least(F.floor((x["end"] - x["start"]) / 8), F.lit(5)).cast("int")


def expectation(counts: dict[str, float], rounds: int = 50) -> tuple[dict[str, float], list[list[list[float]]]]:
    """Two-class EM over patterns of votes: each pattern's probability, and each labeler's vote probabilities by class."""
    total = sum(counts.values())
    belief = {p: min(0.95, max(0.05, 0.5 + 0.15 * sum(int(v) - 1 for v in p))) for p in counts}
    rates: list[list[list[float]]] = []
    for _ in range(rounds):
        yes = sum(n * belief[p] for p, n in counts.items())
        prior = min(0.99, max(0.01, (yes + 1) / (total + 2)))
        rates = []
        for j in range(LABELERS):
            of = [[0.3, 0.3, 0.3], [0.3, 0.3, 0.3]]
            for p, n in counts.items():
                of[1][int(p[j])] += n * belief[p]
                of[0][int(p[j])] += n * (1 - belief[p])
            rates.append([[x / sum(c) for x in c] for c in of])
        moved = 0.0
        for p in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[j][1][int(p[j])] / rates[j][0][int(p[j])]) for j in range(LABELERS))
            new = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            moved = max(moved, abs(new - belief[p]))
            belief[p] = new
        if moved < 1e-6:
            break
    return belief, rates


def fit(spans: DataFrame, rounds: int = 300) -> dict[str, float]:
    """Weights of the span classifier, by feature: v<labeler><vote>, k<kind>, l<length class>, and bias."""
    seen = spans.select(F.explode(F.concat("__base", "__more")).alias("x")).groupBy(F.col("x.kind").alias("kind"), F.col("x.votes").alias("votes"), _length_class(F.col("x")).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r["kind"], r["votes"], r["length"], float(r["n"])) for r in seen.toLocalIterator())
    weights = {f"v{j}{v}": 0.0 for j, v in product(range(LABELERS), "012")} | {f"k{k}": 0.0 for k in ALL_KINDS} | {f"l{n}": 0.0 for n in range(6)} | {"bias": 0.0}
    if not rows:
        return weights
    counts: dict[str, float] = {}
    for _, votes, _, n in rows:
        counts[votes] = counts.get(votes, 0.0) + n
    belief, _ = expectation(counts)
    total = sum(counts.values())
    examples = [([f"v{j}{v}" for j, v in enumerate(votes)] + [f"k{kind}", f"l{length}", "bias"], belief[votes], n / total) for kind, votes, length, n in rows]
    for _ in range(rounds):
        slope = {f: 0.001 * w for f, w in weights.items()}
        for features, wanted, share in examples:
            p = 1 / (1 + math.exp(-sum(weights[f] for f in features)))
            for f in features:
                slope[f] += share * (p - wanted)
        weights = {f: w - 2.0 * slope[f] for f, w in weights.items()}
    return weights


def accept(spans: DataFrame, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """``spans`` with ``__spans``: base spans and accepted candidates, by kind and start."""
    odds = math.log(threshold / (1 - threshold))

    def chosen(x: Column) -> Column:
        score = F.lit(weights["bias"])
        for j in range(LABELERS):
            vote = F.substr(x["votes"], F.lit(j + 1), F.lit(1))
            score = score + F.when(vote == "0", F.lit(weights[f"v{j}0"])).when(vote == "1", F.lit(weights[f"v{j}1"])).otherwise(F.lit(weights[f"v{j}2"]))
        kind = F.lit(0.0)
        for k in ALL_KINDS:
            kind = F.when(x["kind"] == k, F.lit(weights[f"k{k}"])).otherwise(kind)
        length = F.element_at(F.array(*[F.lit(weights[f"l{n}"]) for n in range(6)]), _length_class(x) + 1)
        return score + kind + length >= odds

    rank = F.create_map(*[F.lit(v) for k, n in zip(ALL_KINDS, range(len(ALL_KINDS)), strict=True) for v in (k, n)])
    keyed = F.transform(F.concat(F.col("__base"), F.filter("__more", chosen)), lambda x: F.struct(rank[x["kind"]].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return spans.withColumn("__spans", F.array_sort(keyed)).drop("__more")


def text_of(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep``, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    keep = [c for c in keep if c not in ("spans", "base_sha256") and c not in {f"n_{k}" for k in KINDS}]
    found = settle(find(docs, keep, text_col).drop("__text"), "pii-spans")
    done = accept(found, fit(found))
    counts = [_count(k) for k in KINDS]
    return done.select(*keep, *counts, F.sha2(text_of("__base").cast("binary"), 256).alias("base_sha256"), text_of("__spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span's text replaced by its kind in square brackets; other columns as they are."""
    columns = docs.columns
    found = settle(find(docs, columns, text_col), "pii-texts")
    done = accept(found, fit(found))
    # in order of place; a span that begins inside the one before it goes with it
    line = F.array_sort(F.transform("__spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def replaced(xs: Column, ends: Column, parts: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            past = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            return F.when(x["start"] < past, F.lit("")).otherwise(F.concat(cut(parts, past, x["start"]), F.lit("["), x["kind"], F.lit("]")))

        return F.concat(F.array_join(F.transform(xs, piece), ""), cut(parts, F.element_at(ends, -1), F.length("__text")))

    clean = let(line, lambda xs: let(running(F.transform(xs, lambda x: x["end"]), F.greatest), lambda ends: let(pieces(F.col("__text")), lambda parts: replaced(xs, ends, parts))))
    clean = F.when(F.size("__spans") == 0, F.col(text_col)).otherwise(clean)
    return done.withColumn("__clean", clean).select(*[F.col("__clean").alias(c) if c == text_col else F.col(c) for c in columns])
