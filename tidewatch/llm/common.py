"""Vectorised word and line hashing on Arrow buffers, and small Spark helpers shared by the text operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 keeps all other characters clear of those
bytes.  Hashes are 64-bit polynomials over a fixed random byte table, computed for a whole slice of documents with
prefix sums, so that no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import quoted
from tidewatch.session import cut_lineage

SLICE_BYTES = 2_000_000  # bytes of text that are vectorised at once
BROADCAST_KEYS = 1_000_000  # keys of at most 24 bytes that may be broadcast
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    start = U64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + start)


BYTE = seeded(256, 1)
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15 | 1
STEP = U64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), b, dtype=U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of every span ``data[start:end]``; spans are ascending and disjoint."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + (1 << 18), side="right")))
        block = data[first : ends[j - 1]]
        up, down = _power(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=U64)
        np.cumsum(table[block] * up[: len(block)], out=sums[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * STEP
        i = j
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, per-document offsets into them)`` of all words of the documents."""
    sep = SPACE[data]
    edge = offsets[1:-1]
    before = np.empty(len(data), dtype=bool)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = after[-1] = True
        before[1:], after[:-1] = sep[:-1], sep[1:]
        before[edge[edge < len(data)]] = True
        after[edge[edge > 0] - 1] = True
    solid = ~sep
    starts = np.flatnonzero(solid & before)
    return starts, np.flatnonzero(solid & after) + 1, np.searchsorted(starts, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False):
    """``(hashes, starts, ends, per-document offsets into them)`` of all words of the documents."""
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends, LOWER if lower else BYTE), starts, ends, bounds


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive values, regardless of document borders."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= STEP
        out += hashes[j : j + n]
    return mix(out)


def sequence_hash(hashes: np.ndarray, seed: int) -> int:
    """Hash of a whole sequence, as a signed 64-bit integer."""
    factors, _ = _power(len(hashes) + 1)
    total = (mix(hashes ^ U64(seed)) * factors[: len(hashes)]).sum(dtype=U64) + U64(len(hashes) * 0x10001)
    return int(mix(np.array([total], dtype=U64)).view(np.int64)[0])


def slices(batch: pa.RecordBatch, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into slices of about ``SLICE_BYTES``: ``(rows, bytes, offsets)``; null texts are empty."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], (offsets[i : j + 1] - offsets[i]).astype(np.int64)
        i = j


def per_slice(make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None], text: str = "text"):
    """An Arrow map over the slices of every batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                out = make(rows, data, offsets)
                if out is not None and out.num_rows:
                    yield out

    return run


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def held(key: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as empty text)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns under internal names, whatever else the table carries."""
    return df.select(*[quoted(source).alias(name) for name, source in columns.items()])


def numbered(docs: DataFrame) -> DataFrame:
    """The table with its columns named ``c0``, ``c1``, …, for maps that must not meet dots or clashes in names."""
    return docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])


def renamed(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of a ``numbered`` table under the names of ``docs``."""
    return df.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def without(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` are not in ``gone``; broadcast if the keys that go are few, else one shuffle."""
    gone = cut_lineage(gone.select(*keys).distinct())
    if gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, keys, "left_anti")


__all__ = [
    "BROADCAST_KEYS", "BYTE", "LOWER", "SLICE_BYTES", "SPACE", "STEP", "U64", "cut_lineage", "grams", "held", "mix", "numbered", "only", "per_slice", "renamed", "seeded", "sequence_hash",
    "signed", "slices", "span_hashes", "table_path", "without", "word_spans", "words_of",
]
