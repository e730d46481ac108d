"""Repeated 13-word passages across documents.

No suffix trees are built.  Winnowed anchors of five words find where texts meet (every 13-word run holds one), and around
anchors that occur in two documents all 13-word windows are hashed whole and joined; overlapping windows of one document
join to its maximal repeats.  Every shared anchor takes this path, whatever its frequency, with one row per distinct
window of a slice of documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut_lineage, grams, only, per_slice, sequence_hash, words_of
from tidewatch.llm.repeats import Windows, apply_starts, covered, ordered_rows, repeated, start_lists

WINDOW = 13
PREFIX = 5


def word_windows(size: int = WINDOW, prefix: int = PREFIX):
    """Windows of ``size`` words, each anchored at its smallest ``prefix``-word run."""
    span = size - prefix + 1

    def make(data: np.ndarray, offsets: np.ndarray) -> Windows:
        hashes, _, _, bounds = words_of(data, offsets)
        whole, short = grams(hashes, size), grams(hashes, prefix)
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        start = np.flatnonzero(np.arange(len(doc)) + size <= bounds[1:][doc])
        if not len(start):
            return Windows(start, whole[:0], start, short[:0], doc[:0], bounds)
        low = sliding_window_view(short, span)
        anchor = np.empty(len(start), dtype=np.int64)
        for i in range(0, len(start), 1 << 16):
            part = start[i : i + (1 << 16)]
            anchor[i : i + len(part)] = part + low[part].argmin(axis=1)
        return Windows(start, whole[start], anchor, short[anchor], doc[start], bounds)

    return make


def _content(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    hashes, _, _, bounds = words_of(data, offsets)
    words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sums = [pa.array([sequence_hash(w, seed) for w in words], pa.int64()) for seed in (21, 22)]
    return pa.RecordBatch.from_arrays([rows.column(0), *sums, pa.array(np.diff(bounds), pa.int64())], names=["id", "c1", "c2", "n"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, kept_text)``, one row per input row.

    A word is removed when a window of ``size`` consecutive words that covers it also starts in a document with a smaller
    id.  Words are runs outside ``[\\x20\\x09-\\x0D]``, compared as they are; windows are judged on the input.  Texts of
    fewer words, null and empty texts lose nothing.  A row without id has no order: it loses nothing and is no source.
    Rows repeated with one id and one text are one document and get equal results.  Other columns are ignored.
    """
    rows = only(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("long"))
    # whole copies lose all their words; only the first of them goes on
    content = cut_lineage(ordered_rows(rows).mapInArrow(per_slice(_content), "id long, c1 long, c2 long, n long"))
    first = content.groupBy("c1", "c2").agg(F.min("id").alias("first"))
    copies = cut_lineage(content.where(F.col("n") >= size).join(first, ["c1", "c2"]).where("id > first").select("id", "n"))
    rows = rows.join(copies.select("id").distinct(), "id", "left_anti")
    starts = repeated(ordered_rows(rows), word_windows(size), across=True)

    def run(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        _, begin, end, bounds = words_of(data, offsets)
        raw = data.tobytes()
        counts, gone, shas, texts = [], [], [], []
        for d, at in enumerate(start_lists(batch)):
            a, b = bounds[d], bounds[d + 1]
            out = covered(at, size, int(b - a))
            left = np.flatnonzero(~out) + a
            kept = b" ".join([raw[s:e] for s, e in zip(begin[left].tolist(), end[left].tolist(), strict=True)])
            counts.append(int(b - a))
            gone.append(int(out.sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        text_column = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("id")), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas), text_column],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    gone = copies.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_words"), F.col("n").alias("n_removed"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept_text"),
    )
    return apply_starts(rows, starts, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string").union(gone)
