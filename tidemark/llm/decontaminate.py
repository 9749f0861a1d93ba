"""Benchmark decontamination: a BM25 inverted index of test items with block-max WAND.

Items are classed by length: a class's window is the least power of two, 64 or more, that
holds its items' words. Every document is cut into passages of each class's window, stepping by
half, and every passage is a query against the index of that class's items; so what is found of an
item depends on the item and the document only. Scores are BM25 as a share of the item's own
best score, so one threshold fits items of any length; all items at or above it are
retrieved. Pruning is exact: a passage's lists stand in order of their largest impacts, and
an item that is only in those behind the pivot, which together stay below the threshold, can't reach it; so only
blocks of items that the lists before the pivot touch, and in which the largest impacts of
all lists together reach the threshold, are scored (many passages at once). A retrieved item is verified in the document's passage
widened on both sides by the item's length: the shares of its question's and of its answer's
five-word shingles that stand there must both reach ``overlap``. With ``edited``, as op4 and the
pipeline ask for it, also an item is found of whose whole the share reaches ``overlap``, so its
answer may be edited or cut off, and of parts too short for five words to survive two
edits shorter shingles count too (``gram``).

An item's question is what stands before its last line break (else its last sentence; else
its first two thirds), the answer the rest.

Items are read in shards of bounded bytes (``SHARD_BYTES``), each indexed once on the driver and sent to the
executors, so the broadcast has a proven bound; BM25's statistics are those of all items. The
corpus is read once for each shard.

Defined results: null and empty texts match nothing, and null or word-less items are left
out; repeated documents are reported each; repeated items by their ids; an empty table of
either kind gives an empty result; extra columns are not read; id columns named like a
result column (item_id, score, question_overlap, answer_overlap) are left out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ranges, settle

THRESHOLD, OVERLAP, GRAM = 0.5, 0.5, 5
K1, B, BLOCK = 1.2, 0.75, 8
#: Passages whose bounds are added up together.
SLAB = 256
SHARD_BYTES = 32 << 20
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z), ASCII marks counting as space."""
    return text.lower().translate(_SPACED).split() if text else []


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    text = text.strip()
    for cut in (text.rfind("\n") + 1, max((m.end() for m in re.finditer(r"[.?!]\s", text)), default=0)):
        q, a = words_of(text[:cut].encode()), words_of(text[cut:].encode())
        if q and a:
            return q, a
    words = words_of(text.encode())
    cut = max(1, len(words) * 2 // 3)
    return words[:cut], words[cut:] or words[:cut]


def shingles(words: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def gram(n: int) -> int:
    """Words a shingle for a part of ``n`` words: two edited words leave about half of the shingles."""
    return 1 if n <= 4 else 2 if n < 16 else 3 if n < 24 else GRAM


def window(n: int) -> int:
    """Words a passage for items of ``n`` words."""
    return max(64, 1 << (n - 1).bit_length())


class Lists:
    """Postings of the items of one class, in blocks, with the largest impact of each block and list. Lists are numbered by their largest impact, largest first."""

    def __init__(self, size: int, postings: dict[int, list[tuple[int, float]]], n_items: int):
        self.step, self.n_blocks = size // 2, -(-n_items // BLOCK)
        terms = sorted(postings, key=lambda t: (-max(x for _, x in postings[t]), t))
        self.row = {t: i for i, t in enumerate(terms)}
        self.items = [np.array([n for n, _ in postings[t]], np.int64) for t in terms]
        self.impacts = [np.array([x for _, x in postings[t]]) for t in terms]
        blocks, tops = [], []
        for items, impacts in zip(self.items, self.impacts, strict=True):
            block, start = np.unique(items // BLOCK, return_index=True)
            blocks.append(block)
            tops.append(np.maximum.reduceat(impacts, start))
        self.many = np.array([len(b) for b in blocks], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.blocks, self.block_tops = np.concatenate(blocks), np.concatenate(tops)
        self.tops = np.array([t.max() for t in tops])

    def rows_of(self, n_terms: int) -> np.ndarray:
        out = np.full(n_terms + 1, -1, np.int64)
        out[list(self.row)] = list(self.row.values())
        return out

    def live(self, passages: np.ndarray, lists: np.ndarray, n: int, threshold: float) -> np.ndarray:
        """passage x block: whether the block's bound reaches the threshold. (passages, lists): distinct pairs, in order."""
        tops = self.tops[lists]
        whole = np.bincount(passages, weights=tops, minlength=n)
        some = whole[passages] >= threshold  # else no list of the passage is opened
        passages, lists, tops = passages[some], lists[some], tops[some]
        if not len(passages):
            return np.zeros((n, self.n_blocks), bool)
        through = np.cumsum(tops)
        start = np.concatenate([[True], passages[1:] != passages[:-1]])
        before = (through - tops)[start][np.cumsum(start) - 1]
        opened = whole[passages] - (through - tops - before) >= threshold  # what this list and those behind it can give
        touched = self._sums(passages[opened], lists[opened], n) > 0
        return touched & (self._sums(passages, lists, n) >= threshold)

    def _sums(self, passages: np.ndarray, lists: np.ndarray, n: int) -> np.ndarray:
        """passage x block: the lists' largest impacts in the block together."""
        many = self.many[lists]
        at = ranges(self.first[lists], many)
        cell = np.repeat(passages * self.n_blocks, many) + self.blocks[at]
        return np.bincount(cell, weights=self.block_tops[at], minlength=n * self.n_blocks).reshape(n, self.n_blocks)

    def search(self, lists: np.ndarray, live: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items of live blocks whose score for the distinct ``lists`` is at least ``threshold``."""
        items, impacts = np.concatenate([self.items[t] for t in lists]), np.concatenate([self.impacts[t] for t in lists])
        inside = live[items // BLOCK]
        scores = np.bincount(items[inside], weights=impacts[inside])
        return [(int(i), float(scores[i])) for i in np.flatnonzero(scores >= threshold)]

    def candidates(self, rows: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(first word of the passage, item, score) of every passage and item that reach the threshold. ``rows``: each word's list, or -1."""
        at = np.flatnonzero(rows >= 0)
        slack, total = threshold * (1 - 1e-9), max(1, -(-len(rows) // self.step) - 1)
        pairs, lists = np.concatenate([at // self.step, at // self.step - 1]), np.concatenate([rows[at], rows[at]])
        inside = (pairs >= 0) & (pairs < total)
        pairs = np.unique(pairs[inside] * len(self.items) + lists[inside])
        passages, lists = pairs // len(self.items), pairs % len(self.items)
        for low in range(0, total, SLAB):
            a, b = np.searchsorted(passages, [low, low + SLAB])
            if a == b:
                continue
            live = self.live(passages[a:b] - low, lists[a:b], SLAB, slack)
            for k in np.flatnonzero(live.any(axis=1)):
                i, j = np.searchsorted(passages, [low + k, low + k + 1])
                for item, score in self.search(lists[i:j], live[k], slack):
                    yield (low + int(k)) * self.step, item, score


class Index:
    """One shard of items: words, parts, and a class's posting lists by its window."""

    def __init__(self, items: list[tuple[int, str]], idf: dict[bytes, float], average: float):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(t) for _, t in items]
        self.wholes = [words_of(t.encode()) for _, t in items]
        self.term: dict[bytes, int] = {}
        classes: dict[int, dict[int, list[tuple[int, float]]]] = defaultdict(lambda: defaultdict(list))
        members: dict[int, list[int]] = defaultdict(list)
        for n, words in enumerate(self.wholes):
            impact = {w: idf[w] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average)) for w, tf in Counter(words).items()}
            total, size = sum(impact.values()), window(len(words))
            for w, x in impact.items():
                classes[size][self.term.setdefault(w, len(self.term))].append((len(members[size]), x / total))
            members[size].append(n)
        self.lists = [(Lists(size, postings, len(members[size])), np.array(members[size])) for size, postings in sorted(classes.items())]
        self.rows = [lists.rows_of(len(self.term)) for lists, _ in self.lists]

    def matches(self, text: bytes, threshold: float, overlap: float, edited: bool = False) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of every verified item."""
        words = words_of(text)
        if not words:
            return []
        terms = np.fromiter(map(self.term.get, words, repeat(len(self.term))), np.int64, len(words))
        best: dict[int, float] = {}
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (lists, members), rows in zip(self.lists, self.rows, strict=True):
            for start, at, score in lists.candidates(rows[terms], threshold):
                item = int(members[at])
                best[item] = max(best.get(item, 0.0), score)
                wide = len(self.wholes[item])
                places[item].append((max(0, start - wide), min(len(words), start + 2 * lists.step + wide)))
        out = []
        for item, score in best.items():
            question, answer = self.parts[item]
            top, whole = (0.0, 0.0), 0.0
            for a, b in places[item]:
                region = words[a:b]
                top = max(top, (self._share(region, question, edited), self._share(region, answer, edited)), key=min)
                if edited:
                    whole = max(whole, self._share(region, self.wholes[item], edited, 2))
            if min(top) >= overlap or whole >= overlap:
                out.append((self.ids[item], score, *top))
        return out

    @staticmethod
    def _share(region: list[bytes], part: list[bytes], edited: bool, least: int = 1) -> float:
        """The share of the part's shingles in the region: of five words or, if ``edited`` and more, of ``gram``'s and ``least`` at least."""
        share = 0.0
        for n in {min(GRAM, len(part)), min(max(least, gram(len(part))) if edited else GRAM, len(part))} - {0}:
            wanted = shingles(part, n)
            have = shingles(region, n) if len(region) >= n else set()
            share = max(share, len(wanted & have) / len(wanted))
        return share


def indexes(items: DataFrame, item_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> Iterator[Index]:
    """The shards' indexes, one at a time, all with the statistics of all items."""
    spaced = F.regexp_replace(F.lower(F.col(text_col)), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " ")
    clean = items.filter(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).filter(F.length(F.trim(spaced)) > 0).select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    total, n = clean.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not n:
        return
    shards = max(1, -(-int(total) // shard_bytes))
    sharded = clean.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lengths, of = [], [], []
            for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words_of(text.encode())
                for w in set(found):
                    words.append(w)
                    lengths.append(None)
                    of.append(shard)
                words.append(None)
                lengths.append(len(found))
                of.append(shard)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(words, pa.binary()), pa.array(lengths, pa.int64())], names=["shard", "word", "dl"])

    seen = settle(sharded.select("shard", "text").mapInArrow(counted, "shard long, word binary, dl long"), "bench-words")
    average = seen.agg(F.sum("dl")).first()[0] / n
    frequency = seen.filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    for shard in range(shards):
        own = seen.filter((F.col("shard") == shard) & F.col("word").isNotNull()).select("word").distinct().join(frequency, "word")
        idf = {bytes(r["word"]): float(np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in own.toLocalIterator()}
        rows = sorted((r["item"], r["text"]) for r in sharded.filter(F.col("shard") == shard).toLocalIterator())
        if rows:
            yield Index(rows, idf, average)


def contaminated(docs: DataFrame, items: DataFrame, id_cols: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES, edited: bool = False) -> DataFrame:
    """One row for each document and test item found in it: ids, item_id, score, question_overlap, answer_overlap."""
    id_cols = [c for c in id_cols if c not in ("item_id", "score", "question_overlap", "answer_overlap")]
    item_arrow = items.select(item_col).limit(0).toArrow().schema.field(0).type
    kept = docs.select(*[F.col(c) for c in id_cols], F.col(text_col).cast("string").cast("binary").alias("__bytes"))
    item_type = items.schema[item_col].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + f", item_id {item_type}, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(items, item_col, item_text_col, shard_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                rows, found = [], []
                for n, text in enumerate(batch.column(batch.num_columns - 1)):
                    for match in index.matches(text.as_py() or b"", threshold, overlap, edited):
                        rows.append(n)
                        found.append(match)
                ids = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
                values = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([*ids, pa.array(values[0], item_arrow), *[pa.array(v, pa.float64()) for v in values[1:]]], names=[*id_cols, "item_id", "score", "question_overlap", "answer_overlap"])

        part = kept.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out

