"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A place between a character and a single space that follows it is always a token boundary:
every pattern of byte-level pre-tokenisation that takes a character other than white space
ends before white space, and no special string contains any (checked). Ordinary texts are cut there, and
each distinct segment is encoded once by the library and remembered. A text longer than ``chunk`` characters is encoded in
overlapping chunks with offsets. Two neighbours are spliced at a position inside their
overlap that is a token boundary in both and that is proven stable: a letter stands before
it and white space or plain punctuation after it. Byte-level pre-tokenisation ends a run of
letters at such a place whatever stands around it, and no special string may contain one
(checked when the tokenizer is loaded), so tokens on either side don't depend on the other.
If an overlap holds no such place it is doubled, at last to the rest of the text. Memory
per text is that of one chunk, however long the text is.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each for itself; an empty table gives an empty result; extra columns are not read, and
clashing names are replaced by the result's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 32_768
OVERLAP = 256
#: Characters of ordinary texts encoded at once.
GROUP = 1 << 20
#: Remembered segments; beyond that many they are forgotten and encoded anew.
KNOWN = 500_000
_TWO_SPACES = re.compile(r"\s ")
#: Marks after a letter that end a token.
MARKS = " \n\t\r.,;:!?)]}。、，"


class Counter:
    """Counts tokens as ``tokenizers`` gives them, special strings handled by its default."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.spaced: dict[str, int] = {}
        for added in self.tokenizer.get_added_tokens_decoder().values():
            text = str(added.content)
            if any(text[i - 1].isalpha() and text[i] in MARKS for i in range(1, len(text))) or any(c.isspace() for c in text) or text[:1] in MARKS or added.lstrip or added.rstrip:
                raise ValueError(f"special string {text!r} allows no stable boundary")

    def segments(self, text: str) -> tuple[str, list[str]]:
        """The text cut before every space that follows a character other than white space: the first piece, and the others without their space."""
        pieces = text.split(" ")
        if pieces[0] and not _TWO_SPACES.search(text):
            return pieces[0], pieces[1:]
        out, held = [], pieces[0]
        for piece in pieces[1:]:
            if held and not held[-1].isspace():
                out.append(held)
                held = " " + piece
            else:
                held += " " + piece
        out.append(held)
        return out[0], [s[1:] for s in out[1:]]

    def _count(self, texts: list[str]) -> list[int]:
        """Whole texts, by their segments."""
        cut = [self.segments(t) for t in texts]
        if len(self.spaced) > KNOWN:
            self.spaced.clear()
        new = [s for s in set().union(*(rest for _, rest in cut)) if s not in self.spaced]
        self.spaced.update(zip(new, map(len, self.tokenizer.encode_batch_fast([" " + s for s in new], add_special_tokens=False)), strict=True))
        first = map(len, self.tokenizer.encode_batch_fast([f for f, _ in cut], add_special_tokens=False))
        return [n + sum(map(self.spaced.__getitem__, rest)) for n, (_, rest) in zip(first, cut, strict=True)]

    def counts(self, texts: list[str]) -> list[int]:
        out, at = [0] * len(texts), 0
        while at < len(texts):
            if len(texts[at]) > self.chunk:
                out[at] = self.count_long(texts[at])
                at += 1
                continue
            end, chars = at, 0
            while end < len(texts) and len(texts[end]) <= self.chunk and (end == at or chars + len(texts[end]) <= GROUP):
                chars += len(texts[end])
                end += 1
            out[at:end] = self._count(texts[at:end])
            at = end
        return out

    def _spans(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        offsets = self.tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        return [start + a for a, _ in offsets], [start + b for _, b in offsets]

    def count_long(self, text: str) -> int:
        total, at, size, n = 0, 0, self.chunk, len(text)
        while True:  # text[:at] is counted; at is a stable boundary or 0
            end = min(n, at + size)
            starts, ends = self._spans(text, at, end)
            if end == n:
                return total + len(starts)
            place = self._splice(text, at, end, set(ends))
            if place is None:  # no agreement within this chunk: take a longer one
                size *= 2
                continue
            total += sum(1 for s in starts if s < place)
            at, size = place, self.chunk

    def _splice(self, text: str, at: int, end: int, left_ends: set[int]) -> int | None:
        """The last stable boundary on which this chunk and the next one agree."""
        overlap = self.overlap
        while True:
            low = max(at + 1, end - overlap)
            stable = [p for p in range(end - 1, low, -1) if text[p] in MARKS and text[p - 1].isalpha() and p in left_ends]
            if stable:
                right_starts = set(self._spans(text, low, min(len(text), end + overlap))[0])
                for p in stable:
                    if p in right_starts:
                        return p
            if low == at + 1:
                return None
            overlap *= 2


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row. The tokenizer file must be at the same path on every node."""
    schema = docs.select(F.col(id_col)).schema.simpleString()[len("struct<") : -1] + ",n_bytes:bigint,n_tokens:bigint,over_limit:boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path, chunk, overlap)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = counter.counts(texts)
            n_bytes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
