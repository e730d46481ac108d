"""Repeated runs of lines, by winnowing over line hashes.

Lines are trimmed and hashed; blank lines do not count.  A window is the shortest run of lines from a given line that
holds at least ``MIN_WORDS`` words, its smallest line hash is the fingerprint, so any repeated run of that many words has
a common fingerprint.  Positions of equal fingerprints are joined, matches extended to whole windows on both sides, and
every window that occurred before (in a smaller document id, or higher up in the same document) is deleted; neighbouring
windows make up the run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.common import quoted
from tidewatch.llm.common import BYTE, U64, mix, only, span_hashes, words_of
from tidewatch.llm.repeats import Windows, apply_starts, covered, ordered_rows, repeated, start_lists

MIN_WORDS = 8


def lines_of(data: np.ndarray, offsets: np.ndarray):
    """``(hash, first byte, last byte + 1, words, bounds)`` of the non-blank lines; bytes include the line's margins."""
    _, ws, we, _ = words_of(data, offsets)
    ends = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate((offsets[:-1], ends))) if len(data) else np.empty(0, dtype=np.int64)
    starts = starts[starts < len(data)]
    stops = np.append(starts[1:], len(data))[: len(starts)]
    first, last = np.searchsorted(ws, starts), np.searchsorted(ws, stops)
    full = last > first
    starts, stops, first, last = starts[full], stops[full], first[full], last[full]
    hashes = span_hashes(data, ws[first], we[last - 1], BYTE)
    return hashes, starts, stops, last - first, np.searchsorted(starts, offsets)


def window_ends(words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First line, number of lines and document of every window that has enough words inside its document."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    total = np.concatenate(([0], np.cumsum(words)))
    end = np.searchsorted(total, total[:-1] + least)
    start = np.flatnonzero(end <= bounds[1:][doc])
    return start, end[start] - start, doc[start]


def line_windows(least: int):
    def make(data: np.ndarray, offsets: np.ndarray) -> Windows:
        hashes, _, _, words, bounds = lines_of(data, offsets)
        start, length, doc = window_ends(words, bounds, least)
        whole, anchor = np.zeros(len(start), dtype=U64), start.copy()
        for n in np.unique(length):  # at most ``least`` different lengths
            of = np.flatnonzero(length == n)
            content = hashes[start[of][:, None] + np.arange(n)]
            anchor[of] = start[of] + content.argmin(axis=1)
            value = np.full(len(of), n, dtype=U64)
            for j in range(n):
                value = mix(value ^ content[:, j])
            whole[of] = value
        # the order of anchors must not fall; a window's anchor never lies before that of the window above it
        return Windows(start, whole, anchor, hashes[anchor] if len(anchor) else whole, doc, bounds)

    return make


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, clean_text)``, one row per input row.

    ``n_lines`` counts non-blank lines and ``n_removed`` those in a window that occurred before.  Lines that stay keep their
    bytes and line ends; blank lines go with the text around them untouched.  Null text gives null; a document of fewer than
    ``least`` words, and a row without id, lose nothing.  Rows repeated with one id are one document.  Other columns are
    ignored.
    """
    return _cut(only(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("long")), least)


def _cut(rows: DataFrame, least: int) -> DataFrame:
    """``dedup_lines`` of ``(id, text, …)``; the columns after the text pass through."""
    starts = repeated(ordered_rows(rows), line_windows(least), across=False)
    passed = [f for f in rows.schema if f.name not in ("id", "text")]

    def run(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        _, begin, end, words, bounds = lines_of(data, offsets)
        first, length, owner = window_ends(words, bounds, least)
        raw = data.tobytes()
        n_lines, gone, texts = [], [], []
        null = batch.column(batch.schema.get_field_index("text")).is_null().to_pylist()
        for d, at in enumerate(start_lists(batch)):
            a, b = int(bounds[d]), int(bounds[d + 1])
            where = np.searchsorted(first, at + a)
            out = covered(at, length[where], b - a)
            n_lines.append(b - a)
            gone.append(int(out.sum()))
            pieces, here = [], int(offsets[d])
            for i in np.flatnonzero(out):
                pieces.append(raw[here : begin[a + i]])
                here = int(end[a + i])
            pieces.append(raw[here : offsets[d + 1]])
            texts.append(None if null[d] else b"".join(pieces))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(batch.schema.get_field_index("id")), pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()),
                *[batch.column(batch.schema.get_field_index(f.name)) for f in passed],
            ],
            names=["doc_id", "n_lines", "n_removed", "clean_text", *[f.name for f in passed]],
        )

    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("clean_text", T.StringType()), *passed,
    ])
    return apply_starts(rows, starts, run, schema)


def without_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated lines cut out of ``text`` (and ``n_chars`` kept true).

    A document that had lines and loses all of them goes.  Null and empty texts, texts of fewer than ``least`` words and rows
    without id stay as they are; rows repeated with one id are one document (an id names one text) and stay as often as they come.  The other
    columns travel with the text as one struct, under any name, so texts are moved once and joined with nothing but the
    positions to cut.  An empty table gives an empty result.
    """
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rest = F.struct(*[quoted(c).alias(at[c]) for c in docs.columns if c != "text"])
    clean = _cut(docs.select(quoted("doc_id").cast("long").alias("id"), quoted("text").alias("text"), rest.alias("rest")), least)
    kept = clean.where(~((F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines"))))
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return kept.select(*[(changed[c] if c in changed else F.col(f"rest.{at[c]}")).alias(c) for c in docs.columns])
