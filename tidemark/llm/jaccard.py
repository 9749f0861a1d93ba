"""N-gram Jaccard join with set-relation skipping.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
``percent`` in a hundred. Exact, in these steps:

1. Every task hashes its documents' shingles and sends each (shingle, document) pair, packed
   in eight bytes, to the shingle's part. A shingle that many documents of one batch hold is
   counted there first and sent once with its count.
2. A part counts in how many documents each of its shingles stands and returns those of two
   and more to the batches, with the counts.
3. A batch then knows, for each document, which shingles it shares and how common they are.
   A document that shares less than ``percent`` of its set has no partner at all. The others
   keep their shared shingles (only these can be in an intersection) and, in the global order
   rarest first, those of the prefix in which two linked sets must meet.
4. Equal sets become one. Sets that meet in a prefix shingle form candidate groups (connected
   components of stars, not of pairs).
5. Within a candidate group the index join runs on small chunks of sets: first every chunk
   with the group's first one; then, of what that left unconnected, everything against the
   rest of the group. Index lists are skipped block by block, and a set's answers derived from
   those of a highly similar set (``Join``). Of a chunk's links as many leave the task as connect its sets.

No step forms all pairs of a group, and none collects a group into one task.

A shingle is told by 64 bits of its hash (in the parts by the 48 below the part's, 57 and more together).

Defined results: null, empty and word-less texts have no set and link with nothing; texts
with fewer words than a shingle are one shingle; repeated rows each get their row; rows with
a null id get a null component_id unless linked with others, whose smallest id they get; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import WordHash, mix, power_of_two, settle, signed, size_hint, words_of
from .graph import components

SIZE, PERCENT = 5, 75
#: A batch holds at most so many documents (their numbers take 16 bits) and pairs.
BATCH_DOCS, BATCH_PAIRS = 8192, 1_000_000
#: In more documents of a batch than this, a shingle is counted in the batch first.
COMMON = 64
#: Stored bytes of input a part of the shingles; there are as many parts as the input needs.
PART_BYTES = 4 << 20
#: Sets a chunk in step 5.
CHUNK = 64
_LOW = np.uint64((1 << 48) - 1)
_MANY = np.uint64(0xFFFF)


def shingle_hashes(text: bytes | None, known: WordHash, size: int = SIZE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = known.of(words)
    n = min(size, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + len(out)]
    return np.unique(mix(out))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


_PAIRS = "kind int, batch long, part long, data binary, counts binary, idx int, id long, th long, n long, sig binary"
_NAMES = [x.split()[0] for x in _PAIRS.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _send_pairs(bits: int, size: int):
    """Step 1: kind 0 documents, kind 1 pairs and kind 2 counts for a part, kind 3 pairs that stay with the batch."""

    def emit(batch: int, docs: list[tuple], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield _record([(0, batch, (batch * BATCH_DOCS + i) % (1 << bits), None, None, i, d, th, len(s), xxhash.xxh3_128_digest(s.tobytes())) for i, ((d, th), s) in enumerate(zip(docs, sets, strict=True))], _PAIRS)
        if not sum(map(len, sets)):
            return
        hashes = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        counts = np.diff(np.append(first, len(hashes)))
        common = counts > COMMON
        stays = np.repeat(common, counts)
        kinds = ((1, hashes[~stays], owner[~stays], None), (2, hashes[first[common]], np.full(int(common.sum()), _MANY), counts[common].astype(np.uint32)), (3, hashes[stays], owner[stays], None))
        rows = []
        for kind, h, who, more in kinds:
            if not len(h):
                continue
            parts = (h >> np.uint64(64 - bits)).astype(np.int64)
            packed = ((h & _LOW) << np.uint64(16)) | who
            starts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(h)), strict=True):
                rows.append((kind, batch, int(parts[a]), packed[a:b].tobytes(), None if more is None else more[a:b].tobytes(), None, None, None, None, None))
        for a in range(0, len(rows), 512):
            yield _record(rows[a : a + 512], _PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = WordHash(), TaskContext.get().partitionId() << 20
        docs, sets, pairs = [], [], 0
        for record in batches:
            for d, th, text in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), record.column(2), strict=True):
                found = shingle_hashes(text.as_py(), known, size)
                docs.append((d, th))
                sets.append(found)
                pairs += len(found)
                if len(docs) >= BATCH_DOCS or pairs >= BATCH_PAIRS:
                    yield from emit(number, docs, sets)
                    number, docs, sets, pairs = number + 1, [], [], 0
        if docs:
            yield from emit(number, docs, sets)

    return run


def _count_part(key, table):
    """Step 2: the shingles of one part that stand in two and more documents, by batch. Other rows pass on to their batch."""
    kinds = np.array(table.column("kind").to_pylist())
    on = table.filter(pa.array((kinds == 0) | (kinds == 3)))
    mine = table.filter(pa.array((kinds == 1) | (kinds == 2)))
    if not mine.num_rows:
        return on
    batches, data, counts = (mine.column(c).to_pylist() for c in ("batch", "data", "counts"))
    packed = np.concatenate([np.frombuffer(d, np.uint64) for d in data])
    ends = np.cumsum([len(d) // 8 for d in data])
    weight = np.concatenate([np.ones(len(d) // 8, np.uint32) if c is None else np.frombuffer(c, np.uint32) for d, c in zip(data, counts, strict=True)]).astype(np.int64)
    h = packed >> np.uint64(16)
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    df = np.empty(len(h), np.int64)
    df[order] = np.repeat(np.add.reduceat(weight[order], first), np.diff(np.append(first, len(h))))
    rows, part, a = [], key[0].as_py(), 0
    for batch, end in zip(batches, ends, strict=True):
        shared = a + np.flatnonzero(df[a:end] >= 2)
        if len(shared):
            rows.append((1, batch, part, packed[shared].tobytes(), np.minimum(df[shared], 0xFFFFFFFF).astype(np.uint32).tobytes(), *[None] * 5))
        a = end
    return pa.concat_tables([on, pa.Table.from_batches([_record(rows, _PAIRS)]).cast(on.schema)])


_SETS = "ref long, id long, th long, n long, sig binary, shared binary, keys binary"


def _select(percent: int, bits: int):
    """Step 3, for one batch: its documents, with the shared set and the prefix of those that may link."""

    def run(key, table):
        kinds = table.column("kind").to_pylist()
        parts, data, counts = table.column("part").to_pylist(), table.column("data").to_pylist(), table.column("counts").to_pylist()
        hashes, owners, dfs, common_h, common_df, stay_h, stay_o = [], [], [], [], [], [], []
        for kind, part, d, c in zip(kinds, parts, data, counts, strict=True):
            if kind == 0:
                continue
            packed = np.frombuffer(d, np.uint64)
            h = (packed >> np.uint64(16)) | (np.uint64(part) << np.uint64(64 - bits))
            who = packed & _MANY
            if kind == 3:
                stay_h.append(h)
                stay_o.append(who)
                continue
            df, many = np.frombuffer(c, np.uint32), who == _MANY
            common_h.append(h[many])
            common_df.append(df[many])
            hashes.append(h[~many])
            owners.append(who[~many])
            dfs.append(df[~many])
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        h, who, df = join(hashes, np.uint64), join(owners, np.uint64), join(dfs, np.uint32)
        if stay_h:
            ch, cd = join(common_h, np.uint64), join(common_df, np.uint32)
            order = np.argsort(ch)
            sh, so = join(stay_h, np.uint64), join(stay_o, np.uint64)
            h, who, df = np.concatenate([h, sh]), np.concatenate([who, so]), np.concatenate([df, cd[order][np.searchsorted(ch[order], sh)]])
        order = np.lexsort((h, df, who))
        h, who = h[order], who[order]
        docs = sorted((r for r in zip(*(table.column(c).to_pylist() for c in ("idx", "kind", "id", "th", "n", "sig")), strict=True) if r[1] == 0), key=lambda r: r[0])
        starts = np.searchsorted(who, np.arange(len(docs) + 1, dtype=np.uint64))
        rows, batch = [], key[0].as_py()
        for i, _, d, th, n, sig in docs:
            own = h[starts[i] : starts[i + 1]]
            shared = keys = None
            if n and len(own) >= least_overlap(n, percent):
                prefix = n - least_overlap(n, percent) + 1 - (n - len(own))
                shared, keys = np.sort(own).tobytes(), own[:prefix].tobytes()
            rows.append(((batch << 16) | i, d, th, n, sig, shared, keys))
        return pa.Table.from_batches([_record(rows, _SETS)])

    return run


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for record in batches:
        keys = [np.frombuffer(k, np.uint64) for k in record.column(1).to_pylist()]
        refs = np.repeat(np.array(record.column(0).to_pylist(), np.int64), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)), pa.array(refs)], names=["key", "ref"])


class Join:
    """The index join of a few sets, in order of size, with set-relation skipping.

    Index lists hold a set under the shingles of its prefix, in blocks of equal size and
    position (shingles after this one): a block whose size, or whose position and the asking set's, leave too small an
    overlap is skipped whole, as are the sets of a block that have been answered. Once a highly similar set
    is found, the answers of that set are taken over: an overlap with each of them is the similar
    set's, corrected by the few shingles in which the two differ; and as the similar set isn't larger, a
    set that isn't among its answers can only be one if it holds a shingle that only the asking set has.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int], groups: list[int], percent: int):
        self.sizes, self.groups, self.percent = sizes, groups, percent
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        rank = np.empty(len(tokens), np.int64)
        rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))  # rarest first
        self.own = [np.sort(rank[np.searchsorted(tokens, s)]).tolist() for s in sets]
        self.sets = [frozenset(o) for o in self.own]
        self.alone = int((counts < 2).sum())  # shingles of one set only have the least ranks
        self.index: dict[int, dict[tuple[int, int], set[int]]] = {}
        self.answers: list[dict[int, int]] = [{} for _ in sets]
        self.compared = 0

    def linked(self, i: int, j: int, both: int) -> bool:
        return 100 * both >= self.percent * (self.sizes[i] + self.sizes[j] - both)

    def _derive(self, i: int, j: int, done: set[int]) -> frozenset[int]:
        """Takes over what holds of j's answers; returns the shingles that i has and j hasn't."""
        more, less = self.sets[i] - self.sets[j], self.sets[j] - self.sets[i]
        for z, both in self.answers[j].items():
            if z != i and z not in done:
                done.add(z)
                both += len(more & self.sets[z]) - len(less & self.sets[z])
                if self.linked(i, z, both):
                    self.answers[i][z] = both
        return more

    def add(self, i: int) -> None:
        """All answers of set i among those before it; then i is one of these."""
        own, size, percent = self.own[i], self.sizes[i], self.percent
        prefix = own[: max(0, size - least_overlap(size, percent) + 1 - (size - len(own)))]
        done, more = {i}, None
        for at, token in enumerate(prefix):
            if token < self.alone:
                continue
            rest = len(own) - at - 1
            for (other, after), members in reversed(self.index.get(token, {}).items()):
                if other * 100 < percent * size:
                    break  # all blocks before hold smaller sets
                if (1 + min(rest, after)) * (100 + percent) < percent * (size + other):
                    continue
                for j in sorted(members - done, reverse=True):
                    if j in done:
                        continue
                    done.add(j)
                    if self.groups[i] >= 0 and self.groups[i] == self.groups[j] or more is not None and more.isdisjoint(self.sets[j]):
                        continue
                    both = len(self.sets[i] & self.sets[j])
                    self.compared += 1
                    if self.linked(i, j, both):
                        self.answers[i][j] = both
                        if more is None and 10 * both >= 9 * size:
                            more = self._derive(i, j, done)
        for j, both in self.answers[i].items():
            self.answers[j][i] = both
        for at, token in enumerate(prefix):
            if token >= self.alone:
                self.index.setdefault(token, {}).setdefault((size, len(own) - at - 1), set()).add(i)


def skip_join(sets: list[np.ndarray], sizes: list[int], groups: list[int], percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """Every linked pair (i, j, overlap), i < j.

    ``groups``: pairs of sets with one number >= 0 are known to be connected and aren't asked for. ``sizes`` are whole
    sizes, ``sets`` the shared shingles, sorted.
    """
    join = Join(sets, sizes, groups, percent)
    for i in sorted(range(len(sets)), key=lambda i: (sizes[i], i)):
        join.add(i)
    return [(i, j, both) for i, found in enumerate(join.answers) for j, both in found.items() if i < j and not (groups[i] >= 0 and groups[i] == groups[j])]


def spanning(n: int, links: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """As many of the links as connect what all of them connect."""
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j, _ in links:
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append((i, j))
    return out


def _link_chunks(percent: int):
    def run(key, table):
        rows = {r: (n, s, g) for r, n, s, g in zip(*(table.column(c).to_pylist() for c in ("ref", "n", "shared", "label")), strict=True)}
        refs = sorted(rows)
        sets = [np.frombuffer(rows[r][1], np.uint64) for r in refs]
        names: dict[int, int] = {}
        groups = [names.setdefault(rows[r][2], len(names)) if rows[r][2] is not None else -1 for r in refs]
        found = spanning(len(refs), skip_join(sets, [rows[r][0] for r in refs], groups, percent))
        return pa.Table.from_arrays([pa.array([refs[i] for i, _ in found], pa.int64()), pa.array([refs[j] for _, j in found], pa.int64())], names=["a", "b"])

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, component_id for every row of ``docs``."""
    return _classes(docs, id_col, text_col, size, percent).drop("class")


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """``classes`` with ``class``, the same for linked documents only, with ids or without."""
    bits = int(np.log2(power_of_two(size_hint(docs) / PART_BYTES, 1 << 9)))
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counted = text.mapInArrow(_send_pairs(bits, size), _PAIRS).groupBy("part").applyInArrow(_count_part, _PAIRS)
    sets = settle(counted.groupBy("batch").applyInArrow(_select(percent, bits), _SETS), "shingle-sets")

    # equal sets are one: the least ref stands for them
    alike = settle(sets.filter("shared is not null").groupBy("sig", "n").agg(F.min("ref").alias("rep")), "set-reps")
    chosen = settle(sets.filter("shared is not null").join(alike.select(F.col("rep").alias("ref")), "ref", "left_semi").select("ref", "n", "shared", "keys"), "set-chosen")
    postings = chosen.select("ref", "keys").mapInArrow(_explode, "key long, ref long")
    linked = settle(_connect(chosen, postings, percent), "set-components")

    by_rep = alike.join(linked, F.col("rep") == F.col("node"), "left").select("sig", "n", F.coalesce("component", "rep").alias("class"))
    # a document that may link has its set's class, any other its own ref
    may = sets.filter("shared is not null").select("ref", "id", "th", "n", "sig").join(by_rep, ["sig", "n"]).select("id", "th", "n", "class")
    may = settle(may, "set-classes")
    least = settle(may.groupBy("class").agg(F.min("id").alias("component_id")), "set-least")
    joined = may.join(least, "class").select("id", "th", "n", "component_id", "class")
    alone = sets.filter("shared is null").select("id", "th", "n", F.col("id").alias("component_id"), F.col("ref").alias("class"))
    return joined.unionByName(alone).select(F.col("id").alias("doc_id"), "th", F.col("n").alias("n_shingles"), "component_id", "class")


def _connect(chosen: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Steps 4 and 5: (node, component) of every set that is linked with another."""
    stars = settle(postings, "prefixes")
    centre = stars.groupBy("key").agg(F.min("ref").alias("a"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", "a")
    candidates = components(stars.join(centre, "key").filter("ref <> a").select("a", F.col("ref").alias("b")).distinct())
    # settled, so their real size decides whether they are broadcast and the members stay where they are
    counts = settle(candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "set-counts")
    grouped = candidates.join(counts, "component").withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("long"))
    grouped = grouped.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    members = settle(chosen.select("ref", "n", "shared").join(grouped.select(F.col("node").alias("ref"), "component", "chunk", "chunks"), "ref"), "set-members")

    # every chunk meets the first one; groups of one chunk are done with that
    first = members.filter("chunk = 0").withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rest = members.filter("chunk > 0").withColumn("task", F.col("chunk"))
    tasks = first.unionByName(rest).select("component", "task", "ref", "n", "shared", F.lit(None).cast("long").alias("label"))
    star_links = settle(tasks.groupBy("component", "task").applyInArrow(_link_chunks(percent), "a long, b long"), "links-first")
    labels = components(star_links)

    # what is left: sets outside their group's largest component, against all of the group
    large = members.filter("chunks > 1").select("component", "chunks", "ref", "n", "shared").join(labels.withColumnRenamed("component", "label"), F.col("ref") == F.col("node"), "left").drop("node")
    large = settle(large.withColumn("label", F.coalesce("label", "ref")), "set-labels")
    sizes = large.groupBy("component", "label").agg(F.count(F.lit(1)).alias("many")).groupBy("component").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.sum("many").alias("members"), F.max("many").alias("most"))
    left = sizes.filter("members > most").withColumn("strips", F.ceil((F.col("members") - F.col("most")) / CHUNK).cast("long")).withColumn("mains", F.ceil(F.col("most") / CHUNK).cast("long"))
    open_groups = large.join(settle(left, "set-open"), "component")
    outside, inside = open_groups.filter("label <> main"), open_groups.filter("label = main")
    strip, other = F.pmod(F.xxhash64("ref"), F.col("strips")), F.pmod(F.xxhash64("ref"), F.col("mains"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    main_tasks = inside.withColumn("x", other).withColumn("y", to(F.col("strips"))).unionByName(outside.withColumn("y", strip).withColumn("x", to(F.col("mains"))))
    low = outside.withColumn("own", strip).withColumn("y", to(F.col("strips")))
    strip_tasks = low.withColumn("x", -1 - F.least("own", "y")).withColumn("y", F.greatest("own", "y")).drop("own")
    again = main_tasks.unionByName(strip_tasks).select("component", "x", "y", "ref", "n", "shared", "label")
    more = again.groupBy("component", "x", "y").applyInArrow(_link_chunks(percent), "a long, b long")
    return components(star_links.unionByName(settle(more, "links-rest")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, one of each group of linked documents: the one with the least id; of a group without any id, the one with the least hash of its text."""
    found = settle(_classes(docs, id_col, text_col, size, percent), "dedup-classes")
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"))
    rows = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows"))
    stay = first.groupBy(F.col("f.doc_id").alias("__id"), F.col("f.th").alias("__th")).agg(F.count(F.lit(1)).alias("__stay"))
    stay = settle(stay.join(rows, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__th") == F.col("th"))).select("__id", "__th", "__stay", (F.col("rows") == F.col("__stay")).alias("__all")), "dedup-kept")
    hashed = docs.withColumn("__hash", F.xxhash64(F.col(text_col)))
    kept = hashed.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th")))
    # of rows that agree in id and text only some may stay; which ones makes no difference
    line = Window.partitionBy("__id", "__th").orderBy(F.lit(1))
    some = kept.filter(~F.col("__all")).withColumn("__place", F.row_number().over(line)).filter(F.col("__place") <= F.col("__stay"))
    return kept.filter("__all").select(*docs.columns).unionByName(some.select(*docs.columns))
