"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams (with word
marks < and >) and of itself, so an unseen misspelling shares most of its vectors with the
word it comes from. A window of ``SPAN`` neighbouring words is the mean of its words'
vectors; a linear softmax over two classes gives it log-odds; the document has those of
its windows' softened maximum, so a few words weigh as much in a long text as in a short
one. Embeddings and softmax are trained jointly (Adam) on a bounded sample of labelled
rows, with classes weighed alike, then calibrated by a slope and a shift on a quarter of it that a second net hasn't seen (or, of few rows, on the sample itself).
Because all is linear up to the maximum, a word's log-odds is one number, computed once
for each distinct word of a task.

Defined results: null, empty and white-space-only texts have one empty window; no labelled rows give 0 for
all weights and so the prior; texts are scored whole, whatever their length; repeated rows
score alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import labelled_sample

BUCKETS, DIM, SPAN, GRAMS = 1 << 16, 8, 4, (3, 4, 5)
MASK = (1 << 64) - 1
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, RATE, SEED = 6000, 24 << 20, 12, 0.03, 5
#: Rows of each class that the quarter must hold to calibrate on; with fewer, the net is calibrated on its own sample.
APART = 30
_WORD = re.compile(r"[^\W_]+")


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each marked word and of the whole word: flat, and how many a word has.

    All words are hashed together: their code points stand in one array, and a window's hash
    folds its points; windows that would cross into the next word are left out.
    """
    marked = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = ends[owner] - np.arange(len(points))  # code points left in the word
    found, of = [], []
    for n in GRAMS:
        h = np.full(max(0, len(points) - n + 1), n * 0x9E3779B97F4A7C15 & MASK, np.uint64)
        for k in range(n):
            h = (h ^ points[k : k + len(h)]) * np.uint64(0x100000001B3F)
        whole = room[: len(h)] >= n
        found.append(h[whole])
        of.append(owner[: len(h)][whole])
    place = np.arange(len(points)) - (ends - lengths)[owner]
    found.append(np.add.reduceat((points + np.uint64(77)) * powers(place), ends - lengths) if len(words) else np.zeros(0, np.uint64))
    of.append(np.arange(len(words)))
    h, of = np.concatenate(found), np.concatenate(of)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(of, kind="stable")
    return ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[order], np.bincount(of, minlength=len(words))


def powers(place: np.ndarray) -> np.ndarray:
    """A fixed odd multiplier for each place in a word."""
    x = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x | np.uint64(1)


@dataclass
class Bag:
    embed: np.ndarray  # BUCKETS x DIM
    classes: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2
    slope: float = 1.0
    shift: float = 0.0


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def window_means(values: np.ndarray) -> np.ndarray:
    """Means of every window of SPAN words (one shorter window in a shorter text)."""
    if len(values) <= SPAN:
        return np.array([values.mean() if len(values) else 0.0])
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[SPAN:] - sums[:-SPAN]) / SPAN


def train(sample: list[tuple[bytes, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Bag:
    """A net of the whole sample, calibrated by one that hasn't seen the sample's first quarter, on that quarter (if that has ``APART`` rows of each class)."""
    net = _train(sample, epochs, rate, seed)
    apart = sample[: len(sample) // 4]
    labels = [label for _, label in apart]
    if net.slope and min(labels.count(0), labels.count(1)) >= APART:
        other = _train(sample[len(apart) :], epochs, rate, seed)
        if other.slope:
            z = scorer(other, raw=True)([t.decode("utf-8", "replace") for t, _ in apart])
            net.slope, net.shift = calibrate(z, np.array(labels, float))
    return net


def _train(sample: list[tuple[bytes, int]], epochs: int, rate: float, seed: int) -> Bag:
    random = np.random.default_rng(seed)
    net = Bag(random.normal(0, 0.1, (BUCKETS, DIM)), random.normal(0, 0.5, (DIM, 2)), np.zeros(2))
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        net.classes[:] = 0
        share = (y.sum() + 1) / (len(y) + 2)
        net.slope, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in words_of(t.decode("utf-8", "replace"))], np.int64) for t, _ in sample]
    flat, sizes = bags(list(index))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    weigh = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    parts = [net.embed, net.classes, net.bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step, epochs = 0, max(epochs, min(60, -(-12_000 // len(sample))))
    for epoch in range(epochs):
        sharp = 2.0 + 10.0 * epoch / epochs  # from a soft mean of the windows to their maximum
        order = random.permutation(len(sample))
        for a in range(0, len(order), 128):
            some = order[a : a + 128]
            step += 1
            used, inverse = np.unique(np.concatenate([docs[i] for i in some]), return_inverse=True)
            lengths = np.array([len(docs[i]) for i in some])
            heads = np.cumsum(sizes[used]) - sizes[used]
            take = flat[np.repeat(starts[used] - heads, sizes[used]) + np.arange(sizes[used].sum())]
            vectors = np.add.reduceat(parts[0][take], heads, axis=0) / sizes[used][:, None]
            odds = parts[1][:, 1] - parts[1][:, 0]
            word_z = vectors @ odds
            word_slope = np.zeros(len(used))
            at, bias_slope = 0, 0.0
            for i, n in zip(some, lengths, strict=True):
                ids = inverse[at : at + n]
                at += n
                z = window_means(word_z[ids]) + parts[2][1] - parts[2][0]
                p = np.exp(sharp * (z - z.max()))
                p /= p.sum()
                doc_z = float(p @ z)
                error = weigh[i] * (1 / (1 + np.exp(-doc_z)) - y[i]) / len(some)
                to_windows = error * p
                bias_slope += error
                if n:
                    spread = np.convolve(to_windows, np.ones(min(n, SPAN)) / min(n, SPAN))
                    np.add.at(word_slope, ids, spread)
            g_odds = vectors.T @ word_slope
            # every n-gram of a word gets the same share, along the direction of the odds
            share = np.bincount(take, weights=np.repeat(word_slope / sizes[used], sizes[used]), minlength=BUCKETS)
            g_embed = share[:, None] * odds[None, :]
            for i, g in enumerate((g_embed, np.stack([-g_odds, g_odds], axis=1), np.array([-bias_slope, bias_slope]))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                parts[i] = parts[i] - rate * (1 - 0.9 * epoch / epochs) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Bag(*parts)
    z = scorer(net, raw=True)([t.decode("utf-8", "replace") for t, _ in sample])
    net.slope, net.shift = calibrate(z, y)
    return net


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit by Newton steps, with a weak pull to slope 1."""
    scale = max(float(z.std()), 1e-6)
    w = np.array([1.0, 0.0])
    x = np.stack([(z - z.mean()) / scale, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + np.array([0.1 * (w[0] - 1), 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 1e-6])
        move = np.linalg.solve(h, g)
        w = w - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * z.mean() / scale)


class WordOdds(dict):
    """word -> log-odds share, computed for all new words of a batch together; emptied when large."""

    def __init__(self, net: Bag):
        super().__init__()
        self.values_of = net.embed @ (net.classes[:, 1] - net.classes[:, 0])

    def learn(self, words: set[str]) -> None:
        if len(self) > 1_000_000:
            self.clear()
        new = [w for w in words if w not in self]
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            flat, sizes = bags(part)
            self.update(zip(part, (np.add.reduceat(self.values_of[flat], np.cumsum(sizes) - sizes) / sizes).tolist(), strict=True))


def scorer(net: Bag, raw: bool = False):
    known = WordOdds(net)
    bias = float(net.bias[1] - net.bias[0])
    sharp = 12.0

    def score(texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):  # groups of about a million characters
            group, chars = [], 0
            while at + len(group) < len(texts) and (not group or chars < 1 << 20):
                text = texts[at + len(group)]
                chars += len(text)
                group.append(words_of(text))
            known.learn({w for words in group for w in words})
            for words in group:
                z = window_means(np.fromiter(map(known.__getitem__, words), float, len(words))) + bias
                p = np.exp(sharp * (z - z.max()))
                out[at] = float(p @ z / p.sum())
                at += 1
        return out if raw else 1 / (1 + np.exp(-np.clip(net.slope * out + net.shift, -500, 500)))

    return score


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Bag:
    return train(labelled_sample(docs, labels, label, modulus, held_out, sample_rows, sample_bytes))


def apply(docs: DataFrame, net: Bag, keep: list[str], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``keep`` columns of every row, with score and predicted."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    kept = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(net)
        for batch in batches:
            found = score([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], names=[*keep, "score", "predicted"])

    return kept.mapInArrow(run, schema)
