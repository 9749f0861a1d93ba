"""LM scoring by a Katz back-off model of word n-grams.

Tokens are a text's words (A-Z in lower case), then one end. Counts are discounted by
Good-Turing up to ``K`` (Katz 1987), for each length of n-gram by its own counts of counts;
every n-gram of the training rows counts, those seen once too. A token's probability is, recursively,
that of its n-gram if it was seen, else the history's back-off weight times the probability
after the history without its first word, down to the word distribution, which is the discounted
share or, for a word without a count, all the mass that discounting freed. Back-off weights
are exact: what a history's n-grams leave of it, over what the words of those n-grams leave
of the distribution below, so every history's distribution sums to one. A history all of
whose n-grams are too common to be discounted counts once more than it was seen, so
something is left for the unseen.

Counts come from every training row. Texts are read and hashed once: a batch of some
documents becomes one row of a table, with its words and, for each token, the word's number
(frequent words have small numbers, so this is much smaller than the text). Then, for words,
pairs and so on up to ``order``, every batch asks and the parts answer:

- A batch sends its distinct n-grams, packed by history, with their counts in its training rows to
  the parts of their histories, and with each the count of the n-gram below (without the
  first word), which it knows from the answers of the round before. Histories that make up a thousandth of
  all tokens and more (a thousand at most) are spread over parts by the next word as well.
- A part adds up its n-grams, tallies counts of counts, and answers each batch, in the order
  in which it asked, with the n-grams' counts and, for every history, how many of its n-grams were
  seen once, twice, ..., and the sum of their words' probabilities below. The answers are a table by part and batch.

So a batch has all that its tokens' probabilities need, and nothing but packed asks and answers is
shuffled. A word is told by 64 bits of its hash, a longer history by 64 bits, and the words after one
history by 48 bits.

Defined results: null and empty texts are one end token; repeated rows are scored each; rows
with a null id count as training rows; an empty training set gives every text score 0.0 and base score 0.0; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WordHash, held_out, mix, narrow, one_by_one, power_of_two, settle, size_hint, words_of

K, ORDER = 5, 2
#: Tokens and documents a batch, and stored bytes of input a part of the n-grams.
BATCH_TOKENS, BATCH_DOCS, PART_BYTES = 2_000_000, 1 << 16, 4 << 20
#: No word holds a newline, so these can't be words.
END, START = (xxhash.xxh3_64_intdigest(x) for x in (b"\n</s>", b"\n<s>"))
_END = np.array([END], np.uint64)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _fields(schema: str) -> list[list[str]]:
    return [x.split() for x in schema.split(", ")]


def _table(rows: list[dict], schema: str) -> pa.Table:
    """Rows as a table of ``schema``; what a row lacks is null."""
    return pa.Table.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[t]) for c, t in _fields(schema)], names=[c for c, _ in _fields(schema)])


def pack(x: np.ndarray) -> bytes:
    """The upper 48 bits of hashes, in six bytes each."""
    return (x >> np.uint64(32)).astype(np.uint32).tobytes() + ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return (np.frombuffer(data, np.uint32, n).astype(np.uint64) << np.uint64(32)) | (np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(16))


def pack_counts(x: np.ndarray) -> bytes:
    """Whole numbers of any size, as runs of their lowest bytes, their second ones and so on (as many as the largest needs), compressed."""
    x = np.asarray(x)
    most = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unpack_counts(data: bytes, kind: type = np.int64) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel().astype(kind)


def gram_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of a history's hash and the upper 48 bits of the next word's."""
    return mix((h * np.uint64(0x9E3779B97F4A7C15)) ^ (w >> np.uint64(16)))


def discounts(tallies: dict[int, int], k: int = K) -> np.ndarray:
    """d[r] for counts r = 0 .. k + 1 (more are not discounted): Good-Turing by Katz's formula, (r - 1/2) / r where counts of counts don't allow it."""
    out = np.ones(k + 2)
    n = [float(tallies.get(r, 0)) for r in range(k + 2)]
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.minimum(c, len(d) - 1)]


class Words:
    """The word distribution: base and Katz probabilities from counts."""

    def __init__(self, n: int, v: int, tallies: dict[int, int]):
        self.n, self.v, self.d = n, v, discounts(tallies)
        kept = n - sum(tallies.get(r, 0) * r * (1 - self.d[r]) for r in range(1, K + 1))
        self.unknown = 1.0 if not n else max(1 - kept / n, 1 / (n + 1))
        self.scale = (1 - self.unknown) / kept if n else 0.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.scale, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.n + 0.1 * (self.v + 1))) if self.n else np.zeros(len(c))


@dataclass
class Model:
    """What the rounds so far have found: training texts, the word distribution, bits of a part's number; by length of n-gram, discounts and the hashes of those that are hot histories.

    ``tallied``: for each hot history, n-grams seen once, twice, ... and the sum of their words' probabilities below, as its n-grams lie in many parts.
    """

    texts: int
    tokens: int
    bits: int
    words: Words | None
    d: list[np.ndarray]
    hot: list[np.ndarray]
    tallied: list[np.ndarray]


_BATCH = "batch long, texts long, training long, words binary, tokens binary, lengths binary, held binary, ids array<long>"


def _batches(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, number = WordHash(), TaskContext.get().partitionId() << 20
    tokens: list[np.ndarray] = []
    ids: list[int | None] = []
    held: list[bool] = []

    def emit() -> pa.RecordBatch:
        words, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")  # frequent words first
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        lengths, out = np.array([len(t) for t in tokens], np.uint32), np.array(held, bool)
        row = {"batch": number, "texts": int((~out).sum()), "training": int(lengths[~out].sum()), "words": words[order].tobytes(), "tokens": pack_counts(rank[inverse]), "lengths": lengths.tobytes(), "held": out.tobytes(), "ids": list(ids)}
        for x in (tokens, ids, held):
            x.clear()
        return _table([row], _BATCH).to_batches()[0]

    total = 0
    for record in records:
        for d, h, text in zip(record.column(0).to_pylist(), record.column(1).to_pylist(), record.column(2), strict=True):
            words = words_of(text.as_py())
            tokens.append(np.concatenate([known.of(words), _END]) if words else _END)
            ids.append(d)
            held.append(h)
            total += len(tokens[-1])
            if total >= BATCH_TOKENS or len(tokens) >= BATCH_DOCS:
                yield emit()
                number, total = number + 1, 0
    if tokens:
        yield emit()


def sorted_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ascending order of ``key`` (whole numbers), and where in that order a new key begins."""
    low, high = len(key).bit_length(), int(key.max()).bit_length() if len(key) else 0
    if low + high < 63:  # sorting numbers is faster than sorting places
        key = key << low
        key |= np.arange(len(key))
        key.sort()
        order = key & ((1 << low) - 1)
        key >>= low
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


class Level:
    """The distinct n-grams of a batch, for one n, and what has been answered about them.

    ``of``: each token's n-gram; ``history``: an n-gram's history, an n-gram of the level below
    (one past the last: a text's start); ``low``: the n-gram below without the first word.
    """

    def __init__(self, batch: Batch, below: Level | None, model: Model):
        self.batch, self.below, self.model = batch, below, model
        if below is None:
            self.of, self.hash, keyed = batch.tokens, batch.words, batch.words
        else:
            history = np.empty(len(below.of), np.int32)
            history[1:], history[batch.starts] = below.of[:-1], len(below.hash)
            order, first = sorted_runs(history.astype(np.int64) * len(batch.words) + batch.tokens)
            self.of = np.empty(len(order), np.int32)
            self.of[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(order))))
            some = order[first]
            del order, first
            self.history, self.low, self.word = history[some], below.of[some], batch.words[batch.tokens[some]]
            self.history_hash = np.append(below.hash, np.uint64(START))
            keyed = self.history_hash[self.history]
            self.hash = gram_hash(keyed, self.word)
        spread = mix(keyed)
        if below is not None:
            many = self.hot(keyed)[0]
            spread[many] = mix(keyed[many] ^ (mix(self.word[many]) >> np.uint64(56)))
        part = (spread >> np.uint64(64 - model.bits)).astype(np.int64)
        order, self.part_starts = sorted_runs(part)
        self.order = order.astype(np.int32)  # n-grams as they are asked about
        self.parts = part[self.order[self.part_starts]]

    def hot(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether histories are hot, and their places among the hot ones."""
        known = self.model.hot[self.batch.level - 1]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return known[at] == hashes, at

    def asks(self, number: int) -> Iterator[dict]:
        """What the batch asks each part: histories, how many n-grams of each, next words, training counts, and what is known of the n-grams below."""
        batch = self.batch
        counts = np.bincount(self.of[np.repeat(~batch.held, batch.lengths)], minlength=len(self.hash))
        ends = np.append(self.part_starts[1:], len(self.order))
        for part, a, b in zip(self.parts.tolist(), self.part_starts, ends, strict=True):
            own = self.order[a:b]
            row = {"batch": number, "part": part, "counts": pack_counts(counts[own])}
            if self.below is None:
                yield row | {"heads": self.hash[own].tobytes()}
                continue
            heads = self.heads(own)
            row |= {"heads": self.history_hash[self.history[own[heads]]].tobytes(), "runs": pack_counts(np.diff(np.append(heads, len(own)))), "next": pack(self.word[own]), "lower": pack_counts(self.below.counts[self.low[own]])}
            if self.below.below is not None:
                row["whole"] = pack_counts(self.below.whole[self.below.history[self.low[own[heads]]]])
            yield row

    def heads(self, own: np.ndarray) -> np.ndarray:
        """Where among n-grams in order of asking a new history begins."""
        h = self.history[own]
        return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))

    def take(self, answers: list[dict]) -> None:
        """Counts, and each n-gram's probability, from the parts' answers."""
        answers = sorted(answers, key=lambda r: r["part"])
        self.counts = np.empty(len(self.hash), np.int64)
        self.counts[self.order] = np.concatenate([unpack_counts(r["counts"]) for r in answers])
        if self.below is None:
            self.probability = self.model.words.probability(self.counts)
            return
        ends, size = np.append(self.part_starts[1:], len(self.order)), len(self.history_hash)
        of = np.concatenate([self.history[(own := self.order[a:b])[self.heads(own)]] for a, b in zip(self.part_starts, ends, strict=True)])
        told = [np.concatenate([np.frombuffer(r["sums"]) for r in answers]), *(np.concatenate([narrow(x["tallies"][r]) for x in answers]) for r in range(K))]
        below, *tallies = (np.bincount(of, weights=x, minlength=size) for x in told)
        many, at = self.hot(self.history_hash)
        below[many] = self.model.tallied[self.batch.level][at[many], 0]
        d, freed = self.model.d[self.batch.level], np.zeros(size)
        for r, tally in enumerate(tallies, 1):
            tally[many] = self.model.tallied[self.batch.level][at[many], r]
            freed += r * (1 - d[r]) * tally
        seen = np.append(self.below.counts, self.model.texts)
        more = (seen > 0) & (freed < 0.499999)  # half a count, but for rounding
        self.whole = seen + more
        weight = np.ones(size)
        some = seen > 0
        weight[some] = (freed + more)[some] / self.whole[some] / (1 - below[some])
        lower = weight[self.history] * self.below.probability[self.low]
        self.probability = np.where(self.counts > 0, discounted(self.counts, d) / np.maximum(self.whole[self.history], 1), lower)


class Batch:
    """A row of the table of batches with its answers so far, unpacked."""

    def __init__(self, row: dict, answers: list[list[dict]], model: Model, ask: bool):
        self.words = np.frombuffer(row["words"], np.uint64)
        self.tokens = unpack_counts(row["tokens"], np.int32)
        self.lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
        self.held = np.frombuffer(row["held"], bool)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.top = None
        self.level = 0
        for own in answers:
            self.top = Level(self, self.top, model)
            self.top.take(own)
            self.level += 1
        if ask:
            self.top = Level(self, self.top, model)


_ASK = "batch long, part long, heads binary, runs binary, next binary, counts binary, lower binary, whole binary"


def _ask_words(model: Model):
    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for i in range(record.num_rows):
                row = {c: record.column(c)[i].as_py() for c in ("batch", "words", "tokens", "lengths", "held")}
                rows = list(Batch(row, [], model, True).top.asks(row["batch"]))
                for a in range(0, len(rows), 512):
                    yield from _table(rows[a : a + 512], _ASK).to_batches()

    return run


def _known(table: pa.Table, rounds: int) -> tuple[dict, list[list[dict]]]:
    """The batch's own row, and its answers by round."""
    rows = table.to_pylist()
    return next(r for r in rows if r["round"] == 0), [[r for r in rows if r["round"] == n] for n in range(1, rounds + 1)]


def _ask(model: Model, rounds: int):
    def run(key, table):
        own, answers = _known(table, rounds)
        return _table(list(Batch(own, answers, model, True).top.asks(own["batch"])), _ASK)

    return run


_TELL = "kind int, batch long, part long, counts binary, sums binary, tallies array<binary>, r long, n int, c long"
_TYPES["array<binary>"] = pa.list_(pa.binary())


def _tell(model: Model, length: int):
    """For one part: kind 1, answers to batches; kind 2, counts of counts (r, c; r 0: of all); kind 3, hashes (r) of n-grams that make up a thousandth of all tokens; kind 4, for hot histories (r), the sum of probabilities in 2^-52 (n 0) and how many n-grams were seen n times (c)."""

    def run(key, table):
        rows = table.to_pylist()
        heads = [np.frombuffer(r["heads"], np.uint64) for r in rows]
        counts = [unpack_counts(r["counts"]) for r in rows]
        ends = np.cumsum([len(c) for c in counts])
        c = np.concatenate(counts)
        if length == 1:
            h = np.concatenate(heads)
            order = np.argsort(h, kind="stable")
            w = None
            changed = h[order][1:] != h[order][:-1]
        else:
            runs = [unpack_counts(r["runs"]) for r in rows]
            h, w = np.repeat(np.concatenate(heads), np.concatenate(runs)), np.concatenate([unpack(r["next"]) for r in rows])
            order = np.lexsort((w, h))
            changed = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        first = np.flatnonzero(np.concatenate([[True], changed]))
        total = np.add.reduceat(c[order], first)
        of_all = np.empty(len(c), np.int64)
        of_all[order] = np.repeat(total, np.diff(np.append(first, len(c))))
        some = order[first]
        tally = np.bincount(total[total <= K + 1], minlength=K + 2)
        tally[0] = (total > 0).sum()
        out = [{"kind": 2, "r": r, "c": int(x)} for r, x in enumerate(tally.tolist())]
        hot = np.flatnonzero(total * 1000 >= max(1, model.tokens))
        out += [{"kind": 3, "r": int(x)} for x in (h[some[hot]] if w is None else gram_hash(h[some[hot]], w[some[hot]])).view(np.int64)]
        if w is not None:
            lower = np.concatenate([unpack_counts(r["lower"]) for r in rows])[some]
            if length == 2:
                below = model.words.probability(lower)
            else:
                whole = np.repeat(np.concatenate([unpack_counts(r["whole"]) for r in rows]), np.concatenate(runs))[some]
                below = discounted(lower, model.d[-1]) / np.maximum(whole, 1)
            start = np.flatnonzero(np.concatenate([[True], h[some][1:] != h[some][:-1]]))
            names = h[some[start]]
            sums = np.add.reduceat(np.where(total > 0, below, 0.0), start)
            tallies = [np.add.reduceat((total == r).astype(np.int64), start) for r in range(1, K + 1)]
            for i in np.flatnonzero(np.isin(names, model.hot[length - 2])).tolist():
                out += [{"kind": 4, "r": int(names[i : i + 1].view(np.int64)[0]), "n": n, "c": int(x)} for n, x in enumerate((round(sums[i] * 2.0**52), *(t[i] for t in tallies)))]
        for row, own, b in zip(rows, heads, ends, strict=True):
            told = {"kind": 1, "batch": row["batch"], "part": key[0].as_py(), "counts": pack_counts(of_all[b - len(unpack_counts(row["counts"])) : b])}
            if w is not None:
                at = np.searchsorted(names, own)
                told |= {"sums": sums[at].tobytes(), "tallies": [narrow(t[at]) for t in tallies]}
            out.append(told)
        return _table(out, _TELL)

    return run


def _of_hot(told: DataFrame, hot: np.ndarray) -> np.ndarray:
    """Hot histories' sums over all parts, in their order: at most a thousand and one, each holding a thousandth of all tokens."""
    out = np.zeros((len(hot), K + 1))
    for r in told.filter("kind = 4").groupBy("r", "n").agg(F.sum("c").alias("many")).collect():
        out[np.searchsorted(hot, np.array(r["r"]).view(np.uint64)), r["n"]] = r["many"] / 2.0**52 if r["n"] == 0 else r["many"]
    return out


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model, rounds: int):
    def run(key, table):
        own, answers = _known(table, rounds)
        batch = Batch(own, answers, model, False)
        words = batch.top
        while words.below is not None:
            words = words.below
        known, base, logs = (words.counts > 0).astype(np.int64), model.words.base(words.counts), np.log10(batch.top.probability)
        sums = [np.add.reduceat(values, batch.starts) for values in (known[words.of], base[words.of], logs[batch.top.of])]
        return pa.Table.from_arrays([pa.array(own["ids"], pa.int64()), pa.array(batch.held), pa.array(batch.lengths), pa.array(sums[0]), pa.array(np.full(len(batch.lengths), model.tokens)), pa.array(sums[1]), pa.array(sums[2])], names=[c for c, _ in _fields(RESULT)])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 10, remainder: int = 0, order: int = ORDER) -> DataFrame:
    """Base and Katz log10 probability of every row's text; training rows are those whose crc32(id) mod ``modulus`` isn't ``remainder``. ``order``: words of the longest n-grams."""
    bits = int(math.log2(power_of_two(size_hint(docs) / PART_BYTES, 64)))
    base = docs.select(F.col(id_col).cast("long").alias("id"), held_out(docs, id_col, modulus, remainder).alias("held"), F.col(text_col).cast("string").cast("binary").alias("text"))
    batches = settle(base.mapInArrow(_batches, _BATCH), "lm-batches", packed=True, rows_a_file=1)
    texts, tokens = batches.agg(F.sum("texts"), F.sum("training")).first()
    model = Model(texts or 0, tokens or 0, bits, None, [], [], [])
    answers: list[DataFrame] = []

    def everything() -> DataFrame:
        out = batches.withColumn("round", F.lit(0))
        for n, told in enumerate(answers, 1):
            out = out.unionByName(told.select("batch", "part", "counts", "sums", "tallies", F.lit(n).alias("round")), allowMissingColumns=True)
        return out.groupBy("batch")

    for length in range(1, order + 1):
        told = _round(batches.mapInArrow(_ask_words(model), _ASK) if length == 1 else everything().applyInArrow(_ask(model, length - 1), _ASK), model, length)
        tallies = {r["r"]: r["many"] for r in told.filter("kind = 2").groupBy("r").agg(F.sum("c").alias("many")).collect()}
        model.tallied.append(_of_hot(told, model.hot[-1]) if answers else np.zeros((0, K + 1)))
        hot = np.array([r["r"] for r in told.filter("kind = 3").select("r").collect()], np.int64).view(np.uint64)  # at most a thousand, as each holds a thousandth
        if length == 1:
            model.words = Words(model.tokens, tallies.get(0, 0), tallies)
        model.d.append(discounts(tallies))
        model.hot.append(np.unique(np.append(hot, np.uint64(START))))
        answers.append(told.filter("kind = 1"))
    return everything().applyInArrow(_score(model, order), RESULT)


def _round(asked: DataFrame, model: Model, length: int) -> DataFrame:
    """All parts' answers, stored."""
    with one_by_one(asked.sparkSession):
        return settle(asked.groupBy("part").applyInArrow(_tell(model, length), _TELL), f"lm-{length}", packed=True, by="kind")
