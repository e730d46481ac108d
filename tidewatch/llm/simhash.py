"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has 64 bits, one per bit of the hashes of its document's three-word shingles.  Fingerprints are linked when
they differ in at most two bits.  They are cut into three segments; two errors leave at least one segment whole and put at
most two into the next one, so for each segment a key is made of its exact bits and of the codewords near the next segment
(``golay.nearby``): linked fingerprints always share a key.  The work is done per distinct fingerprint:

* keys with at most ``LEAF`` fingerprints are joined with themselves and every pair is verified;
* fingerprints of larger keys are never paired: each sends the 65 values within one bit of itself, and those that meet
  at a value (65 at most, for each lies within a bit of it) are linked to the smallest id there.  Two fingerprints meet
  at such a value exactly if they differ in at most two bits, so nothing is lost and nothing needs a check.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut_lineage, only, per_slice, word_spans
from tidewatch.llm.components import components
from tidewatch.llm.golay import nearby

SHINGLE = 3
SEED = 42
SEGMENTS = (22, 21, 21)
ERRORS = 2
LEAF = 32
CHUNK = 1 << 17  # shingle hashes unpacked to bits at once


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of every document of a slice, unsigned."""
    starts, ends, bounds = word_spans(data, offsets)
    raw = data.tobytes().lower()  # of bytes, this touches A-Z alone
    joined = b" ".join([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    stop = np.cumsum(ends - starts + 1) - 1
    start = stop - (ends - starts)
    words = np.diff(bounds)
    size = np.minimum(words, SHINGLE)
    count = np.where(words > 0, words - size + 1, 0)
    doc = np.repeat(np.arange(len(words)), count)
    first = bounds[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    ones = np.zeros((len(words), 64), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(doc), CHUNK):
        own, at = doc[k : k + CHUNK], first[k : k + CHUNK]
        places = zip(start[at].tolist(), stop[at + size[own] - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in places), dtype="<u8", count=len(own))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: the keys of every fingerprint, by its row."""
    parts, low = [], 0
    for width in SEGMENTS:
        parts.append((prints >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64))
        low += width
    rows, out = [], []
    for i, exact in enumerate(parts):
        row, code = nearby(parts[(i + 1) % len(parts)])
        rows.append(row)
        out.append(i << 40 | exact[row] << 12 | code)
    return np.concatenate(rows), np.concatenate(out)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)


def _prints(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints(data, offsets).view(np.int64))], names=["id", "fp"])


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, prints = _columns(batch)
        row, key = keys(prints)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(prints[row].view(np.int64)), pa.array(key)], names=["id", "fp", "key"])


def _balls(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate((np.zeros(1, dtype=np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
    for batch in batches:
        ids, prints = _columns(batch)
        points = (prints[:, None] ^ flips).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(flips))), pa.array(points.view(np.int64))], names=["id", "point"])


def links(nodes: DataFrame) -> DataFrame:
    """``(u, v)`` that join what fingerprints at most two bits apart join; ``nodes(id, fp)`` with distinct fingerprints."""
    keyed = nodes.select("id", "fp").mapInArrow(_keyed, "id long, fp long, key long")
    size = keyed.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    kept = cut_lineage(keyed.join(size, "key"))
    small = kept.where(F.col("k") <= LEAF)
    a, b = (small.select("key", F.col("id").alias(x), F.col("fp").alias(f"f{x}")) for x in "ab")
    near = (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= ERRORS) & (F.col("a") < F.col("b"))
    pairs = a.join(b, (a["key"] == b["key"]) & near).select(F.col("a").alias("u"), F.col("b").alias("v"))
    points = kept.where(F.col("k") > LEAF).select("id", "fp").distinct().mapInArrow(_balls, "id long, point long")
    hubs = points.withColumn("hub", F.min("id").over(Window.partitionBy("point"))).where("id > hub").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    return pairs.union(hubs)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Null, empty and wordless texts have the fingerprint zero, which links like any other; texts of fewer than three words
    have one shingle, the whole sequence.  Rows with equal fingerprints are one node with the smallest of their ids; an id
    names one text, and repeated rows get equal results.  A row without id keeps its fingerprint, has a null component
    and links nothing.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = only(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("long"))
    prints = cut_lineage(rows.mapInArrow(per_slice(_prints), "id long, fp long"))
    nodes = cut_lineage(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    labels = components(links(nodes)).select(F.col("u").alias("id"), "component")
    named = nodes.join(labels, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    return prints.join(named, "fp", "left").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id")
    )
