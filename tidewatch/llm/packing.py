"""Order-preserving packing of documents into sequences.

Documents are read in order and cut into blocks of ``BLOCK`` rows, whatever the values of their ids, and every block is
packed on its own.  Ranges of the order are dealt to partitions, whose rows are numbered.  Inside a block dynamic
programming chooses the window cuts: at the end of a document for free, at the end of a sentence for a small penalty,
after a full window anywhere for a larger one.  A window costs its padding (none if its length is a power of two) and a
constant.  The best start of a window for the padded case is the smallest ``cost + position`` of the last ``limit``
positions, which a monotone queue yields in constant time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import only, slices
from tidewatch.llm.encode import encoder

LIMIT = 1024
BLOCK = 512  # rows per block
FLUSH = 1 << 20  # tokens of a block that are planned at once
SENTENCE_COST, TRUNCATION_COST, WINDOW_COST = 2, 6, 8
LOCAL_BITS = 40  # sequences per partition that an id has room for


def window_cuts(ends: np.ndarray, costs: np.ndarray, limit: int = LIMIT) -> list[int]:
    """Ends of the windows over ``ends[-1]`` tokens; ``ends`` are the ascending places for cuts, ``costs`` their penalties.

    The last place is the end of the tokens and costs nothing.
    """
    total = int(ends[-1])
    cost: dict[int, float] = {0: 0.0}  # best cost of a plan that cuts here
    back: dict[int, int] = {}
    queue: deque[tuple[float, int]] = deque()
    full: deque[int] = deque()  # places one full window after a place, in order
    powers = [p for p in (1 << k for k in range(limit.bit_length())) if 64 <= p <= limit]
    last_powers = [1 << k for k in range(limit.bit_length()) if 1 << k <= limit]

    def settle(at: int, penalty: float) -> None:
        while queue and queue[0][1] < at - limit:
            queue.popleft()
        best, start = queue[0][0] - at + limit, queue[0][1]
        for p in last_powers if at == total else powers:
            other = cost.get(at - p)
            if other is not None and other < best:
                best, start = other, at - p
        push(at, best + penalty + WINDOW_COST, start)

    def push(at: int, value: float, start: int) -> None:
        cost[at], back[at] = value, start
        key = value + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, at))

    queue.append((0.0, 0))
    full.append(limit)
    places, penalties, i = ends.tolist(), costs.tolist(), 0
    while i < len(places):
        at = places[i]
        while full and full[0] < at:  # a cut after a full window, inside a sentence
            place = full.popleft()
            start = place - limit
            if place in cost:
                continue
            push(place, cost[start] + TRUNCATION_COST + WINDOW_COST, start)
            if places[i] - place > limit:  # no place for a cut within reach
                full.append(place + limit)
        while full and full[0] == at:
            full.popleft()
        settle(at, penalties[i])
        full.append(at + limit)
        i += 1
    cuts, at = [], total
    while at:
        cuts.append(at)
        at = back[at]
    return cuts[::-1]


class _Block:
    """Tokens of a block that wait for their plan."""

    def __init__(self, base: int, limit: int):
        self.base, self.limit, self.local, self.rows = base, limit, 0, 0
        self.clear()

    def clear(self) -> None:
        self.docs: list[tuple[int | None, int, int]] = []  # id, tokens of the document, its tokens already packed
        self.ids: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, ids: np.ndarray, ends: np.ndarray) -> None:
        self.rows += 1
        self.docs.append((doc, len(ids), 0))
        self.ids.append(ids)
        self.ends.append(ends + self.size)
        self.size += len(ids)

    def pack(self) -> list[tuple]:
        """Pieces of all waiting tokens: ``(doc, start, length, crc, doc tokens, sequence, offset)``."""
        if not self.size:
            return []
        stops = np.cumsum([n for _, n, _ in self.docs])
        places = np.union1d(np.concatenate(self.ends), stops)
        costs = np.where(np.isin(places, stops), 0, SENTENCE_COST)
        cuts = window_cuts(places, costs, self.limit)
        data = np.concatenate(self.ids).astype("<u4").tobytes()
        out, d, here = [], 0, 0
        starts = (stops - [n for _, n, _ in self.docs]).tolist()
        stops = stops.tolist()
        for cut in cuts:
            begin = here
            while here < cut:
                stop = min(cut, stops[d])
                doc, n, _ = self.docs[d]
                out.append((doc, here - starts[d], stop - here, zlib.crc32(memoryview(data)[4 * here : 4 * stop]), n, self.base + self.local, here - begin))
                here = stop
                d += here == stops[d]
            self.local += 1
            if self.local >> LOCAL_BITS:
                raise OverflowError(f"more than {1 << LOCAL_BITS} sequences in a partition")
        self.clear()
        return out


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = 0) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``, one row per piece of a document.

    A document's ids are those of its text and ``end_id``; a null or empty text is ``end_id`` alone.  Documents follow each
    other by id, equal ids by the hash of their text, so repeated rows are packed one by one.  Rows without id come first.
    Other columns are ignored, an empty table gives no rows.  ``sequence_id`` is unique and ascends with the ids.
    """
    rows = only(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("long"))
    # the last key parts rows that are equal in all else, so that many copies are no single task
    keys = ["id", F.xxhash64("text"), "copy"]
    rows = rows.withColumn("copy", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", F.spark_partition_id().cast("long").alias("range"), "text")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        stops = sentence_stops(enc.tokenizer)
        block: _Block | None = None

        def out(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            if pieces:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)], names=names)

        for batch in batches:
            for part, data, offsets in slices(batch):
                ids, firsts = enc.encode(data, offsets)
                for d, (doc, own) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    if block is None:
                        block = _Block(own << LOCAL_BITS, limit)
                    elif block.rows == BLOCK:
                        yield from out(block.pack())
                        block.rows = 0
                    tokens = np.append(ids[firsts[d] : firsts[d + 1]], np.uint32(end_id))
                    block.add(doc, tokens, np.flatnonzero(stops[tokens]) + 1)
                    if block.size >= FLUSH:
                        yield from out(block.pack())
        if block is not None:
            yield from out(block.pack())

    return ordered.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def sentence_stops(tokenizer) -> np.ndarray:
    """For every id, whether its token ends a sentence or a line."""
    vocabulary = tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, i in vocabulary.items():
        out[i] = token.endswith((".", "!", "?", "Ċ"))  # Ċ is how byte-level vocabularies write a line end
    return out
