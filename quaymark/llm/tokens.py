"""Encoding of a corpus with a public byte-level tokenizer (problem 7).

A text is encoded by a monoid tree reduction.  Leaves are encoded alone; two
neighbours are joined by re-encoding a window around their boundary.  The
window grows until both of its ends lie on split points: places where the
tokenizer's pattern splits whatever stands before or behind, so that tokens
outside the window can't change.  A split point needs a character on each
side, which is why the window never ends at the boundary itself.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# fixed value: the public pattern that cuts a text into the pieces that are merged on their own
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_CHARS = 512
WINDOW_CHARS = 64

# A piece never holds a character of the first class followed by one of the second: runs of letters,
# digits and signs take white space only before them.
_SPLIT = regex.compile(r"(?<=[\p{L}0-9.,;:!?()\[\]{}<>/\\|=+*#&%$@^~_`\"-])[ \t\r\n]|(?<=[。、！？])(?=[\p{Hiragana}\p{Katakana}\p{Han}])")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _plain(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.array(enc.encode_ordinary(text), np.int32)


def _last_split(text: str, window: int) -> int:
    """Start of the shortest tail, of ``window`` characters or more by doubling, that begins on a split point; 0 if there is none."""
    while True:
        low = max(0, len(text) - window)
        found = -1
        for m in _SPLIT.finditer(text, max(low, 1)):
            if m.start() < len(text):
                found = m.start()
        if found > 0:
            return found
        if low == 0:
            return 0
        window *= 2


def _first_split(text: str, window: int) -> int:
    """End of the shortest head that ends on a split point; the whole length if there is none."""
    while True:
        m = _SPLIT.search(text, 1, min(len(text), window + 1))
        if m and m.start() < len(text):
            return m.start()
        if window >= len(text):
            return len(text)
        window *= 2


def join(enc: tiktoken.Encoding, a: tuple[str, np.ndarray], b: tuple[str, np.ndarray], window: int = WINDOW_CHARS) -> tuple[str, np.ndarray]:
    """The encoding of a's text followed by b's, from their encodings."""
    if not a[0] or not b[0]:
        return b if not a[0] else a
    p, q = _last_split(a[0], window), _first_split(b[0], window)
    tail, head = a[0][p:], b[0][:q]
    keep_a = a[1][: len(a[1]) - len(enc.encode_ordinary(tail))]
    keep_b = b[1][len(enc.encode_ordinary(head)) :]
    return a[0] + b[0], np.concatenate([keep_a, _plain(enc, tail + head), keep_b])


def encode_text(enc: tiktoken.Encoding, text: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> np.ndarray:
    """Ids of a text of any length; strings that look like special tokens are ordinary text."""

    def reduce(lo: int, hi: int) -> tuple[str, np.ndarray]:
        if hi - lo <= leaf:
            part = text[lo:hi]
            return part, _plain(enc, part)
        mid = (lo + hi) // 2
        return join(enc, reduce(lo, mid), reduce(mid, hi), window)

    return reduce(0, len(text))[1]


def encode_corpus(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}", leaf: int = LEAF_CHARS, out: str = "ids") -> DataFrame:
    """key, ids of every row.  Null and empty texts give an empty list; repeated and null keys stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            parts = [encode_text(enc, t, leaf) if t else np.empty(0, np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=offsets[1:])
            values = np.concatenate(parts) if parts else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["k", out])

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, {out} array<int>").withColumnRenamed("k", key)


def count_tokens(df: DataFrame, key: str, text: str, path: str = f"{TOKENIZER_DIR}/{VOCABULARY}") -> DataFrame:
    """key, n_tokens of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            n = [len(encode_text(enc, t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["k", "n_tokens"])

    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, n_tokens long").withColumnRenamed("k", key)
