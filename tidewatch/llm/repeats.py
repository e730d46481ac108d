"""Repeated passages of a corpus: winnowed anchors find where texts meet, 13-word (or line-run) nodes decide.

A *window* is a run of consecutive units (words or lines) of one document.  Each window is represented by one *anchor*,
the smallest hash inside it, so equal windows always share an anchor.  Three steps:

1. every document sends its anchors, one row per distinct anchor of a slice of documents; anchors that occur only once
   in the corpus end here;
2. around shared anchors all windows are hashed whole, extended to both sides of the anchor, again one row per distinct
   window of a slice; the smallest place of every window is found by its hash;
3. windows with a smaller place elsewhere are handed back to their documents.

Occurrences that meet inside a slice are settled there, which keeps a passage that a third of all documents share down
to one row per slice.  Nothing is capped: an anchor or window of any frequency takes the same path.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import STEP, U64, mix, per_slice


@dataclass
class Windows:
    """Windows of a slice: first unit, number of units, hash; anchor position (in units) and hash; owning document."""

    start: np.ndarray
    hash: np.ndarray
    anchor: np.ndarray
    anchor_hash: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray  # first unit of every document


#: Turns the bytes and offsets of a slice into its windows.
Maker = Callable[[np.ndarray, np.ndarray], Windows]


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column(rows.schema.get_field_index("id")).to_numpy(zero_copy_only=False).astype(np.int64)


def _first_of(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (key, id, place), and for every row of that order the index of the first row of its key."""
    order = np.lexsort((places, ids, keys))
    sorted_keys = keys[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _rows(key: np.ndarray, ids: np.ndarray, pos: np.ndarray, take: np.ndarray, open_rows: int) -> pa.RecordBatch:
    """Rows to send, in text order as that compresses best; the settled ones spread by their place instead of their key."""
    settled = np.arange(len(take)) >= open_rows
    key, ids, pos = key[take], ids[take], pos[take]
    key = np.where(settled, mix(ids.astype(U64) * STEP + pos.astype(U64)), key)
    order = np.lexsort((pos, ids))
    return pa.RecordBatch.from_arrays(
        [pa.array(key[order].view(np.int64)), pa.array(settled[order]), pa.array(ids[order]), pa.array(pos[order].astype(np.int32))],
        names=["part", "settled", "id", "pos"],
    )


def anchors(docs: DataFrame, make: Maker, across: bool) -> DataFrame:
    """``(id, pos)`` of the anchors that occur elsewhere, with ``across`` in another document."""

    def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
        w = make(data, offsets)
        if not len(w.start):
            return None
        new = np.ones(len(w.anchor), dtype=bool)
        new[1:] = w.anchor[1:] != w.anchor[:-1]
        doc, key = w.doc[new], w.anchor_hash[new]
        pos = w.anchor[new] - w.bounds[doc]
        ids = _ids(rows)[doc]
        order, first = _first_of(key, ids, pos)
        key, ids, pos = key[order], ids[order], pos[order]
        at = np.arange(len(key))
        # what meets an earlier row of its slice is shared; the first row then needs no proof either
        met = ids != ids[first] if across else at != first
        both = np.zeros(len(key), dtype=bool)
        both[first[met]] = True
        settled = met | (both[first] if across else both)
        ask = ids == ids[first] if across else at == first
        if across:  # one row per key and document asks
            ask &= np.concatenate(([True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
            extra = (ids == ids[first]) & ~ask & ~settled  # further places in the only document of the slice
            ask |= extra
        a, s = np.flatnonzero(ask), np.flatnonzero(settled)
        return _rows(key, ids, pos, np.concatenate((a, s)), len(a))

    sent = docs.mapInArrow(per_slice(run), "part long, settled boolean, id long, pos int")
    group = Window.partitionBy("part")
    meets = F.max("id").over(group) > F.min("id").over(group) if across else F.count("*").over(group) > 1
    return sent.withColumn("meets", meets).where("settled or meets").select("id", "pos")


def repeated(docs: DataFrame, make: Maker, across: bool) -> DataFrame:
    """``(id, starts)``: windows, by their first unit, whose content also starts at a smaller place.

    ``docs(id, text)`` has no null ids.  With ``across`` a smaller place is a document with a smaller id, else also an
    earlier unit of the same document.
    """
    shared = anchors(docs, make, across).groupBy("id").agg(F.collect_set("pos").alias("at"))

    def run(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch | None:
        w = make(data, offsets)
        at = rows.column(rows.schema.get_field_index("at"))
        lengths = np.diff(at.offsets.to_numpy())
        places = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.bounds[: len(lengths)], lengths)
        keep = np.isin(w.anchor, places)
        doc, key = w.doc[keep], w.hash[keep]
        if not len(key):
            return None
        pos, ids = w.start[keep] - w.bounds[doc], _ids(rows)[doc]
        order, first = _first_of(key, ids, pos)
        key, ids, pos = key[order], ids[order], pos[order]
        later = ids != ids[first]
        if not across:  # a place repeated with its row is one place
            later |= pos != pos[first]
        a, s = np.flatnonzero(~later), np.flatnonzero(later)
        return _rows(key, ids, pos, np.concatenate((a, s)), len(a))

    sent = docs.join(shared, "id").mapInArrow(per_slice(run), "part long, settled boolean, id long, pos int")
    group = Window.partitionBy("part")
    first = F.min("id").over(group) if across else F.min(F.struct("id", "pos")).over(group)
    later = F.col("id") > F.col("first") if across else F.struct("id", "pos") > F.col("first")
    return sent.withColumn("first", first).where(F.col("settled") | later).groupBy("id").agg(F.collect_set("pos").alias("starts"))


def apply_starts(docs: DataFrame, starts: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """Hand every document its repeated windows (null if none) and map ``run`` over the slices.

    Rows that took no part in ``repeated``, without id or text, are mapped aside; the others are filtered exactly as there,
    so that both joins read one shuffle of the texts.
    """
    aside = docs.where("id is null or text is null").withColumn("starts", F.lit(None).cast("array<int>"))
    return ordered_rows(docs).join(starts, "id", "left").mapInArrow(per_slice(run), schema).union(aside.mapInArrow(per_slice(run), schema))


def ordered_rows(docs: DataFrame) -> DataFrame:
    """Rows with a place in the order and something to compare."""
    return docs.where("id is not null and text is not null")


def start_lists(rows: pa.RecordBatch) -> list[np.ndarray]:
    column = rows.column(rows.schema.get_field_index("starts"))
    return [np.sort(np.asarray(x, dtype=np.int64)) if x is not None else np.empty(0, dtype=np.int64) for x in column.to_pylist()]


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a window."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


__all__ = ["Windows", "apply_starts", "covered", "ordered_rows", "repeated", "start_lists"]
