"""Token ids in Arrow stream files of equal-length sequences.

A file is one Arrow stream.  Each record batch holds ``ROWS`` sequences: a fixed-size list of ids, a fixed-size list of
mask bits (false on the padding of the last sequence), and the documents that begin in the sequence, with their offsets.
As all lists have the same size, sequence ``i`` is a view at a known place of batch ``i // ROWS``: reading it copies
nothing.  Documents lie in ascending id order across the files, whose names ascend as well.

Every task writes to a name of its own and renames the finished file, so a repeated task replaces its own output.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut_lineage, only, slices
from tidewatch.llm.encode import encoder
from tidewatch.session import checkpoint_dir

LENGTH = 1024
ROWS = 256  # sequences per record batch
FILE_TOKENS = 1 << 25  # a file is closed after the document that reaches this


def file_schema(length: int, wide: bool = False) -> pa.Schema:
    starts = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int32())]))
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length)), ("docs", starts)])


class Writer:
    """One file; documents are appended in order."""

    def __init__(self, target: str, length: int = LENGTH, wide: bool = False):
        self.fs, self.path = pa.fs.FileSystem.from_uri(target)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.sink = self.fs.open_output_stream(self.own)
        self.schema, self.length = file_schema(length, wide), length
        self.stream = pa.ipc.new_stream(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.starts: list[tuple[int | None, int]] = []  # id and place among the waiting ids
        self.held = self.tokens = self.docs = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.starts.append((doc, self.held))
        self.waiting.append(ids)
        self.held += len(ids)
        self.tokens += len(ids)
        self.docs += 1
        if self.held >= self.length * ROWS:
            self._flush(self.held // (self.length * ROWS) * ROWS)

    def _flush(self, sequences: int) -> None:
        size = sequences * self.length
        flat = np.concatenate(self.waiting)
        kind = self.schema.field("ids").type.value_type.to_pandas_dtype()
        for i in range(0, size, self.length * ROWS):
            part = flat[i : min(size, i + self.length * ROWS)].astype(kind)
            n = -(-len(part) // self.length)
            mask = np.ones(n * self.length, dtype=bool)
            mask[len(part) :] = False
            part = np.concatenate((part, np.zeros(n * self.length - len(part), dtype=kind)))
            own = [(d, p - i) for d, p in self.starts if i <= p < i + n * self.length]
            bounds = np.searchsorted([p for _, p in own], np.arange(n + 1) * self.length)
            places = pa.StructArray.from_arrays(
                [pa.array([d for d, _ in own], pa.int64()), pa.array([p % self.length for _, p in own], pa.int32())], names=["doc_id", "offset"]
            )
            self.stream.write_batch(
                pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), places),
                    ],
                    schema=self.schema,
                )
            )
        self.waiting = [flat[size:]] if len(flat) > size else []
        self.starts = [(d, p - size) for d, p in self.starts if p >= size]
        self.held = max(0, self.held - size)

    def close(self) -> None:
        if self.held:
            self._flush(-(-self.held // self.length))
        self.stream.close()
        self.sink.close()
        self.fs.move(self.own, self.path)


class Reader:
    """Random access to the sequences of a file; local files are mapped, not read."""

    def __init__(self, source: str):
        fs, path = pa.fs.FileSystem.from_uri(source)
        if isinstance(fs, pa.fs.LocalFileSystem):
            self.source = pa.memory_map(path)
        else:
            self.source = pa.BufferReader(fs.open_input_file(path).read_buffer())
        self.batches = list(pa.ipc.open_stream(self.source))
        self.rows = self.batches[0].num_rows if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> np.ndarray:
        """Ids of sequence ``i``: a view of the file."""
        column = self.batches[i // self.rows].column(0)
        return column.values.to_numpy(zero_copy_only=True)[i % self.rows * column.type.list_size :][: column.type.list_size]

    def mask(self, i: int) -> pa.Array:
        """Mask bits of sequence ``i``: a view of the file."""
        column = self.batches[i // self.rows].column(1)
        return column.values.slice(i % self.rows * column.type.list_size, column.type.list_size)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(id, ids before it in the file, its ids)`` of all documents, a batch of sequences at a time."""
        doc: tuple[int | None, int] | None = None
        parts: list[np.ndarray] = []
        before = 0
        for batch in self.batches:
            length = batch.column(0).type.list_size
            bits = batch.column(1).values
            ids = batch.column(0).values.to_numpy(zero_copy_only=True)
            ids = ids[: len(ids) if bits.false_count == 0 else bits.true_count]
            lists = batch.column(2)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            found = lists.flatten()
            places = row * length + found.field("offset").to_numpy()
            here = 0
            for name, place in zip(found.field("doc_id").to_pylist(), places.tolist(), strict=True):
                if doc is not None:
                    yield (*doc, np.concatenate([*parts, ids[here:place]]))
                doc, parts, here = (name, before + place), [], place
            parts.append(ids[here:])
            before += len(ids)
        if doc is not None:
            yield (*doc, np.concatenate(parts))


def write(docs: DataFrame, folder: str, tokenizer: str, keeps_space: bool, end_id: int, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Write the documents' ids in ascending id order; ``(part, number, file, tokens, docs)`` of the files.

    Equal ids follow each other by the hash of the text; rows without id come first.  A null or empty text is ``end_id``
    alone.  Other columns are ignored; an empty table writes no file.  The files are written while this runs.
    """
    rows = only(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("long")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_space)
        wide = enc.tokenizer.get_vocab_size() > 1 << 16
        part, number = TaskContext.get().partitionId(), 0
        writer: Writer | None = None

        def closed(w: Writer, n: int) -> pa.RecordBatch:
            w.close()
            return pa.RecordBatch.from_pydict({"part": [part], "number": [n], "file": [f"{folder}/part-{part:06d}-{n:05d}.arrows"], "tokens": [w.tokens], "docs": [w.docs]})

        for batch in batches:
            for some, data, offsets in slices(batch):
                ids, firsts = enc.encode(data, offsets)
                for d, doc in enumerate(some.column(0).to_pylist()):
                    if writer is None:
                        writer = Writer(f"{folder}/part-{part:06d}-{number:05d}.arrows", length, wide)
                    writer.add(doc, np.append(ids[firsts[d] : firsts[d + 1]], np.uint32(end_id)))
                    if writer.tokens >= FILE_TOKENS:
                        yield closed(writer, number)
                        writer, number = None, number + 1
        if writer is not None:
            yield closed(writer, number)

    return cut_lineage(ordered.mapInArrow(run, "part long, number long, file string, tokens long, docs long"))


def read(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents in the files; ``start`` counts over all files."""
    # one row per file, so this window is as short as the list of files
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", "number", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out: list[tuple] = []
                for doc, start, ids in Reader(file).documents():
                    out.append((part, number, doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 5000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    found = files.select("part", "number", "file").mapInArrow(run, "part long, number long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(base, ["part", "number"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def new_folder(spark) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    root = checkpoint_dir(spark)
    return f"{root if ':' in root else 'file://' + root}/token-files-{uuid.uuid4().hex}"
