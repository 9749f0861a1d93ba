"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters of ``WIDTH`` bytes slide over the text byte by byte
in overlapping chunks that together cover the whole document, a rectifier and a
maximum give each chunk's features, and the document has, per filter, the largest and the
mean of its chunks' features; a linear layer and a sigmoid combine them into one
probability. Training (Adam on the logistic loss) runs on the driver over a bounded sample
of labelled rows; scoring runs over all bytes of every row.

Defined results: null and empty texts are one chunk of padding and get that chunk's
score; texts of any length are scored whole in bounded slabs; repeated rows score alike; no
labelled rows give the score of the prior (0.5); an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import labelled_sample

WIDTH, FILTERS, DIM = 8, 16, 6
#: Window positions a chunk, and its bytes.
PLACES = 512
CHUNK = PLACES - 1 + WIDTH
SLAB = 64

#: Bounds of the training sample, and training settings.
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS, RATE, SEED = 5000, 24 << 20, 14, 0.01, 11


@dataclass
class Net:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH x DIM x FILTERS
    bias: np.ndarray  # FILTERS
    top: np.ndarray  # 2 * FILTERS: weights of the largest, then of the mean
    shift: float

    def tables(self) -> np.ndarray:
        """WIDTH x 256 x FILTERS: what a byte at a place of the window adds to each filter."""
        return np.ascontiguousarray(np.einsum("bd,kdf->kbf", self.embed, self.filters).astype(np.float32))


def chunks_of(text: bytes) -> np.ndarray:
    """Overlapping chunks (rows of CHUNK bytes) that cover ``text``; the last is padded with zeros."""
    n = max(0, len(text) - WIDTH) + 1
    rows = -(-n // PLACES)
    padded = np.zeros(rows * PLACES - 1 + WIDTH, np.uint8)
    raw = np.frombuffer(text, np.uint8)[: len(padded)]
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded, (rows, CHUNK), (PLACES, 1))


def features(rows: np.ndarray, tables: np.ndarray, bias: np.ndarray, places: bool = False):
    """Largest activation of each filter in each chunk (before the rectifier), and where."""
    best = np.empty((len(rows), FILTERS), np.float32)
    where = np.empty((len(rows), FILTERS), np.int32) if places else None
    for a in range(0, len(rows), SLAB):
        part = rows[a : a + SLAB]
        out = tables[0].take(part[:, :PLACES], axis=0)
        for k in range(1, WIDTH):
            out += tables[k].take(part[:, k : k + PLACES], axis=0)
        if places:
            where[a : a + SLAB] = out.argmax(axis=1)
        best[a : a + SLAB] = out.max(axis=1)
    return best + bias.astype(np.float32), where


def train(sample: list[tuple[bytes, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Net:
    random = np.random.default_rng(seed)
    net = Net(random.normal(0, 0.3, (256, DIM)), random.normal(0, 0.3, (WIDTH, DIM, FILTERS)), np.zeros(FILTERS), random.normal(0, 0.1, 2 * FILTERS), 0.0)
    if not sample:
        net.top[:] = 0
        return net
    rows = [chunks_of(text) for text, _ in sample]
    y = np.array([label for _, label in sample], float)
    share = min(max(y.mean(), 0.02), 0.98)
    net.shift = float(np.log(share / (1 - share)))
    parts = [net.embed, net.filters, net.bias, net.top, np.array([net.shift])]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    epochs = max(epochs, min(60, -(-6000 // len(sample))))
    for epoch in range(epochs):
        order = random.permutation(len(sample))
        for a in range(0, len(order), 32):
            some = order[a : a + 32]
            step += 1
            batch = np.concatenate([rows[i] for i in some])
            starts = np.cumsum([0] + [len(rows[i]) for i in some])[:-1]
            counts = np.array([len(rows[i]) for i in some])
            net = Net(*parts[:4], float(parts[4][0]))
            best, where = features(batch, net.tables(), net.bias, places=True)
            active = np.maximum(best, 0).astype(float)
            doc = np.repeat(np.arange(len(some)), counts)
            largest, mean = np.maximum.reduceat(active, starts), np.add.reduceat(active, starts) / counts[:, None]
            z = largest @ net.top[:FILTERS] + mean @ net.top[FILTERS:] + net.shift
            error = (1 / (1 + np.exp(-z)) - y[some]) / len(some)
            slope = error[doc, None] * net.top[None, FILTERS:] / counts[doc, None]
            slope = slope + np.where(active == largest[doc], error[doc, None] * net.top[None, :FILTERS], 0)
            slope = np.where(best > 0, slope, 0)
            g_top = np.concatenate([error @ largest, error @ mean]) + 1e-4 * net.top
            windows = batch[np.arange(len(batch))[:, None, None], where[:, :, None] + np.arange(WIDTH)]  # chunk x filter x WIDTH
            seen = net.embed[windows]
            g_filters = np.einsum("cf,cfkd->kdf", slope, seen)
            g_embed = np.zeros_like(net.embed)
            np.add.at(g_embed, windows, np.einsum("cf,kdf->cfkd", slope, net.filters))
            for i, g in enumerate((g_embed, g_filters, slope.sum(0), g_top, np.array([error.sum()]))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                parts[i] = parts[i] - rate * (1 - epoch / epochs) * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Net(*parts[:4], float(parts[4][0]))


def scorer(net: Net):
    """texts -> probabilities; each text whole, in slabs of chunks."""
    tables = net.tables()

    def score(texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        group: list[int] = []
        waiting: list[np.ndarray] = []

        def flush() -> None:
            if not group:
                return
            counts = np.array([len(r) for r in waiting])
            best, _ = features(np.concatenate(waiting), tables, net.bias)
            active = np.maximum(best, 0)
            starts = np.cumsum(counts) - counts
            largest, mean = np.maximum.reduceat(active, starts), np.add.reduceat(active, starts) / counts[:, None]
            z = largest @ net.top[:FILTERS] + mean @ net.top[FILTERS:] + net.shift
            out[group] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            group.clear()
            waiting.clear()

        held = 0
        for i, text in enumerate(texts):
            group.append(i)
            waiting.append(chunks_of(text))
            held += len(text)
            if held > 1 << 20:
                flush()
                held = 0
        flush()
        return out

    return score


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Net:
    return train(labelled_sample(docs, labels, label, modulus, held_out, sample_rows, sample_bytes))


def apply(docs: DataFrame, net: Net, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``keep`` columns of every row, with score and predicted."""
    keep = [c for c in keep if c not in ("score", "predicted")]
    kept = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").cast("binary").alias("__bytes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(net)
        for batch in batches:
            found = score([t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())], names=[*keep, "score", "predicted"])

    return kept.mapInArrow(run, schema)
