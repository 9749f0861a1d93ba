"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

Every source gets a target in words: its weight's share of the total, at most
``max_repeat`` times what it holds, the excess going to the others by weight until none is
above (a water level: target = min(cap, level * weight)). Equal blocks of ``block`` words
are seats. Sainte-Lague gives them to sources by the highest quotients target / (2k+1),
then each source's seats to ranges of ``RANGE`` to some power of its shards by their sizes, a range's to its parts, and so on down to shards. Within a shard the documents stand
in seeded random order; the shard's seats beyond whole passes go to blocks at a seeded
offset and equal steps. A document takes the words of its that chosen blocks cover.

Seats that no quotient race can change are given in closed form; only the last few seats
of each party compete, so the race has a few
rows a party however large the corpus is. A source is split into shards of about
``shard`` words, and no race has more than ``RANGE`` parties but that of the sources, so a hot source spreads over many tasks.

Defined results: null text counts 0 words and takes 0; a null source is a source of its
own, ordered last, an empty one an ordinary source; repeated rows are separate documents
(tied ones have equal sizes, so it does not matter which comes first); an empty table gives
an empty result; when no words exist at all, targets are 0.0. Other columns ride along,
except those named like a result column, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import WORD, settle

BLOCK = 8
SHARD, RANGE = 32_768, 1024
_KEY = "__source"


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def _key(column: str) -> Column:
    """Null and text sources as one non-null key that sorts by code point, null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def source_targets(sizes: DataFrame, weights: list[float], max_repeat: float) -> DataFrame:
    """One row a source: __source, source_size, target. ``sizes`` has one row a source."""
    order = Window.orderBy(_KEY)
    cap = F.col("source_size") * F.lit(float(max_repeat))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything))
    up = Window.orderBy("ratio", _KEY)
    # with the sources below this one (by cap a weight) at their caps, the level at which the rest share what is left
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    since = up.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.withColumn("level_here", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(since))
    first = levels.withColumn("level", F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return first.select(_KEY, "source_size", target.alias("target"), "total")


def sainte_lague(parties: DataFrame, by: list[str], key: list[str], votes: str, seats: str, most: str, out: str) -> DataFrame:
    """Give ``seats`` (a column, constant within ``by``) to the parties of each group.

    Highest quotients votes / (2k + 1), ties by ``key``; no party gets more than ``most``.
    The divisor d at which rounded votes / d fill S seats lies, for P parties with V votes,
    between V / (S + P/2) and V / (S - P/2). So a party surely gets its votes rounded at the
    larger divisor, and competes only for those up to the smaller one (and some more, for
    what full parties pass on): in all, a few rows a party.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy()
    half = F.col("__parties") / 2
    sure = F.floor(F.try_divide(F.col(votes), F.col("__votes")) * (F.col(seats) - half) + 0.5).cast("long") - 1
    based = parties.withColumn("__votes", F.sum(votes).over(group)).withColumn("__parties", F.count(F.lit(1)).over(group))
    based = based.withColumn("__sure", F.when(F.col("__votes") > 0, F.greatest(F.lit(0), F.least(F.col(most), sure))).otherwise(F.lit(0)).cast("long"))
    based = based.withColumn("__left", F.col(seats) - F.sum("__sure").over(group))
    room = F.least(F.col(most) - F.col("__sure"), F.ceil(F.try_divide(F.col(votes), F.col("__votes")) * F.col("__parties")).cast("long") + 8)
    races = based.withColumn("__k", F.explode_outer(F.when((room > 0) & (F.col(votes) > 0), F.sequence(F.lit(0), room.cast("int") - 1))))
    quotient = F.col(votes) / (2 * (F.col("__sure") + F.col("__k")) + 1)
    rank = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(F.desc_nulls_last("__quotient"), *key, "__k")
    won = races.withColumn("__quotient", quotient).withColumn("__won", (F.row_number().over(rank) <= F.col("__left")) & F.col("__quotient").isNotNull())
    rest = [c for c in parties.columns if c not in by + key]
    return won.groupBy(*by, *key).agg(*[F.first(c).alias(c) for c in rest], (F.first("__sure") + F.sum(F.col("__won").cast("long"))).alias(out))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), max_repeat: int = 3, block: int = BLOCK, shard: int = SHARD, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and taken; ``keep``: columns to return (all)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "source_size", "target", "taken")]
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    key = _key(source_col)
    sized = docs.select(*[F.col(c) for c in keep], word_count(text_col).alias("size"), key.alias(_KEY), order.alias("__order"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("__text"))
    carried = [c for c in keep if c != text_col]
    slim = keep == carried
    if slim:  # no text among the results: the text is read once
        sized = settle(sized, "mix-sizes")
    sizes = settle(sized.groupBy(_KEY).agg(F.sum("size").alias("source_size")), "mix-sources")
    targets = source_targets(sizes, list(weights), max_repeat)
    seats = targets.withColumn("__seats", F.floor(F.col("total") / block + 0.5).cast("long")).withColumn("__most", F.ceil(F.col("source_size") / block).cast("long") * max_repeat)
    quotas = sainte_lague(seats, [], [_KEY], "target", "__seats", "__most", "source_seats").select(_KEY, "source_size", "target", "source_seats")
    quotas = settle(quotas.withColumn("__shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long")), "mix-quotas")

    # a document's place: its shard and the words before it there, in seeded order
    place = F.pmod(F.conv(F.substring("__order", 1, 8), 16, 10).cast("long"), F.col("__shards"))
    placed = sized.join(quotas, _KEY).withColumn("__shard", place)
    shards = placed.groupBy(_KEY, "__shard").agg(F.sum("size").alias("__words"))
    shards = shards.withColumn("__blocks", F.ceil(F.col("__words") / block).cast("long")).withColumn("__most", F.col("__blocks") * max_repeat)
    seated = _seats_of_shards(settle(shards, "mix-shards"), quotas)
    line = Window.partitionBy(_KEY, "__shard").orderBy("__order", "size", "__text")
    lined = placed.withColumn("__end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(seated, [_KEY, "__shard"])
    return lined.select(*keep, "size", "source_size", "target", _taken(block, seed).alias("taken"))


def _seats_of_shards(shards: DataFrame, quotas: DataFrame, ranged: int = RANGE) -> DataFrame:
    """Every shard's quota: a source's seats go to ranges of its shards, a range's to its parts, the last ones are shards."""
    widest, width = quotas.agg(F.max("__shards")).first()[0] or 1, 1
    while widest > width * ranged:
        width *= ranged
    seats = quotas.select(_KEY, F.lit(0).cast("long").alias("__range"), F.col("source_seats").alias("__seats"))
    while True:
        of = lambda n: F.floor(F.col("__shard") / n).cast("long")
        parts = shards.groupBy(_KEY, of(width * ranged).alias("__range"), of(width).alias("__part")).agg(*[F.sum(c).alias(c) for c in ("__words", "__blocks", "__most")])
        given = sainte_lague(parts.join(seats, [_KEY, "__range"]), [_KEY, "__range"], ["__part"], "__words", "__seats", "__most", "__quota")
        if width == 1:
            return settle(given.select(_KEY, F.col("__part").alias("__shard"), "__blocks", "__words", "__quota"), "mix-quotas-of-shards")
        seats = settle(given.select(_KEY, F.col("__part").alias("__range"), F.col("__quota").alias("__seats")), "mix-ranges")
        width //= ranged


def _taken(block: int, seed: int) -> Column:
    """Words of [end - size, end) that the chosen blocks of the shard cover, passes included."""
    blocks, quota = F.greatest(F.col("__blocks"), F.lit(1)), F.col("__quota")
    passes, extra = F.floor(quota / blocks).cast("long"), quota % blocks
    offset = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__source"), F.lit(":"), F.col("__shard").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long"), blocks)

    def chosen(j: Column) -> Column:  # how many of the blocks 0 .. j-1 have a seat
        return F.floor((j * extra + offset) / blocks).cast("long") - F.floor(offset / blocks).cast("long")

    def covered(p: Column) -> Column:  # words before p in blocks with a seat
        j = F.floor(p / block).cast("long")
        return chosen(j) * block + (chosen(j + 1) - chosen(j)) * (p - j * block)

    end = F.col("__end")
    return (passes * F.col("size") + covered(end) - covered(end - F.col("size"))).cast("long")
