"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Two words one insertion, deletion or replacement apart, the shorter of ``m`` code points, share their first ``m // 2`` or
their last ``m - m // 2``.  Words are grouped by such shared ends, and groups of more than ``LIMIT`` words are cut again by
the halves of what is left between their ends, until at most one code point is left; a group then has no more words than
the alphabet allows.  No group is capped, and of the groups that hold a pair one, by a rule, reports it.

Inside a group the words are sorted.  A list prefix is an interval of the sorted words, bounded where the longest common
prefix of neighbours is shorter, and has one row of the edit matrix per query, of which only the band of three cells around
the diagonal can stay at one edit.  Rows are computed once per prefix and used by all words that share it; an interval
whose row exceeds one edit is skipped with all words in it.  Groups of one word length run through the columns together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut_lineage, only

LETTERS = "A-Za-zÀ-ÿ"
RUN, REST = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
SHORTEST = 5  # code points of a word
LEAST = 3  # occurrences of a word
SLIP = 97  # of the hash of document and word: those that it divides lose a code point
PIECE = 1 << 20  # code points of a text whose words are listed at once
HELD = 200_000  # words counted in a task before they are sent on
LIMIT = 4096  # words of a group that are compared in one go
ROWS = 8192  # words of small groups that are compared together
CELLS = 1 << 24  # code points held for that
FAR = 9  # any number of edits over one
GROUP = ("m", "a", "b", "pre", "suf")


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces that end between words."""
    at = 0
    while len(text) - at > PIECE:
        found = REST.search(text, at + PIECE)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def slipped(doc: str, word: str) -> str:
    """The word as counted: one in ``SLIP`` pairs of document and word loses a code point."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    return word if h % SLIP else word[: h % len(word)] + word[h % len(word) + 1 :]


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if not text:
                continue
            doc = "" if doc is None else str(doc)
            start = zlib.crc32(f"{doc}:".encode())
            for piece in _pieces(text):
                # of bytes, lower() touches A-Z alone
                for word, n in Counter(RUN.findall(piece.encode().lower().decode())).items():
                    if zlib.crc32(word.encode(), start) % SLIP == 0:
                        word = slipped(doc, word)
                    if len(word) >= SHORTEST:
                        total[word] += n
                if len(total) >= HELD:
                    yield flush()
    yield flush()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: words of at least ``SHORTEST`` code points and ``LEAST`` occurrences in all texts.

    Words are runs of letters with A-Z in lower case, each spoilt once in ``SLIP`` documents.  Null texts have none; the
    words of rows without id are counted, with an empty id; repeated rows count each time.
    """
    rows = only(docs, id=doc_id, text=text)
    return rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def _refined(rows: DataFrame) -> DataFrame:
    """Every group by either half of what lies between its shared ends."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    rest = F.col("m") - F.col("a") - F.col("b") - half
    ends = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), "b"), F.struct("a", (F.col("b") + rest).alias("b"))))
    out = rows.select("word", "n", "m", ends.alias("x")).select("word", "n", "m", "x.a", "x.b")
    return out.select("word", "n", "m", "a", "b", F.expr("substring(word, 1, a)").alias("pre"), F.expr("right(word, b)").alias("suf"))


def groups(words: DataFrame) -> DataFrame:
    """``(word, n, m, a, b, pre, suf)``: words with ``a`` first and ``b`` last code points shared, for pairs whose shorter word has ``m``."""
    size = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= SHORTEST)
    now = _refined(rows.withColumns({"a": F.lit(0), "b": F.lit(0)}))
    out = None
    while True:
        large = cut_lineage(now.groupBy(*GROUP).agg(F.count("*").alias("k")).where((F.col("k") > LIMIT) & (F.col("m") - F.col("a") - F.col("b") > 1)))
        if large.isEmpty():
            return now if out is None else out.union(now)
        small = now.join(large, list(GROUP), "left_anti").select(now.columns)
        out = small if out is None else out.union(small)
        now = _refined(now.join(large, list(GROUP), "left_semi"))


def one_edit(codes: np.ndarray, length: np.ndarray, border: np.ndarray, m: int, most: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """``(query, other)`` rows exactly one edit apart inside their group.

    ``codes`` holds the sorted words of length ``m`` or ``m + 1`` in rows, two columns wider than ``m``, with zeros behind
    the words; ``border`` marks the first row of every group.  The rows of length ``m`` are the queries, ``most`` at a time.
    """
    n = len(codes)
    differ = codes[1:] != codes[:-1]
    lcp = np.concatenate(([-1], differ.argmax(axis=1)))
    lcp[border] = -1
    starts = np.append(np.flatnonzero(border), n)
    group = np.cumsum(border) - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    asked = np.flatnonzero(length == m)
    for k in range(0, len(asked), most):
        q = asked[k : k + most]
        low, high = starts[group[q]], starts[group[q] + 1]
        band = [np.full(len(q), x, dtype=np.int8) for x in (FAR, 0, 1)]
        for d in range(m + 1):
            edge = np.append(np.flatnonzero(lcp <= d), n)
            first = np.searchsorted(edge, low)
            count = np.searchsorted(edge, high) - first
            own = np.repeat(np.arange(len(q)), count)
            child = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(own))
            q, low, high = q[own], edge[child], edge[child + 1]
            old = [x[own] for x in band]
            c = codes[low, d]
            cell0 = np.minimum(old[1] + 1, old[0] + (c != codes[q, d - 1]))
            cell1 = np.minimum(np.minimum(old[2], cell0) + 1, old[1] + (c != codes[q, d])) if d < m else np.full_like(cell0, FAR)
            cell2 = np.minimum(cell1 + 1, old[2] + (c != codes[q, d + 1])) if d + 1 < m else np.full_like(cell0, FAR)
            last = cell1 if d + 1 == m else cell0 if d == m else None
            if last is not None:
                hit = (length[low] == d + 1) & (last == 1)
                found.append((q[hit], low[hit]))
            live = (np.minimum(np.minimum(cell0, cell1), cell2) <= 1) & (c != 0)
            q, low, high = q[live], low[live], high[live]
            band = [x[live].astype(np.int8) for x in (cell0, cell1, cell2)]
            if not len(q):
                break
    empty = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate([empty, *x]) for x in zip(*found, strict=True)) if found else (empty, empty)


def _reports(lcp: np.ndarray, m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a group of shared ends ``a`` and ``b`` is the one that reports a pair with this common prefix."""
    x, y = np.zeros_like(a), np.zeros_like(b)
    while (open_ := x + y < a + b).any():
        rest = m - x - y
        front = lcp >= x + rest // 2
        x, y = np.where(open_ & front, x + rest // 2, x), np.where(open_ & ~front, y + rest - rest // 2, y)
    return (x == a) & (y == b)


def _compared(words: list[str], n: np.ndarray, ends: np.ndarray, border: np.ndarray, m: int) -> pa.RecordBatch | None:
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.zeros((len(words), m + 2), dtype=np.uint8)
    row = np.repeat(np.arange(len(words)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    codes[row, at] = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    q, t = one_edit(codes, length, border, m)
    keep = _reports((codes[q] != codes[t]).argmax(axis=1), m, ends[q, 0], ends[q, 1])
    q, t = q[keep], t[keep]
    if not len(q):
        return None
    longer = length[t] > m  # words of one length ask each other
    own, other = np.concatenate((q, t[longer])), np.concatenate((t, q[longer]))
    text = pa.array(words, pa.string())
    return pa.RecordBatch.from_arrays([text.take(pa.array(own)), text.take(pa.array(other)), pa.array(n[other])], names=["word", "near", "k"])


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every group; groups come one after the other, of one ``m`` together, with sorted words."""
    words: list[str] = []
    values: list[tuple] = []
    borders: list[int] = []
    last = None

    def flush() -> Iterator[pa.RecordBatch]:
        if len(words) > 1:
            border = np.zeros(len(words), dtype=bool)
            border[borders] = True
            table = np.array(values, dtype=np.int64)
            out = _compared(words, table[:, 0], table[:, 1:], border, last[0])
            if out is not None:
                yield out
        words.clear(), values.clear(), borders.clear()

    for batch in batches:
        for word, n, *key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                if last is not None and (key[0] != last[0] or len(words) >= ROWS or len(words) * key[0] >= CELLS):
                    yield from flush()
                if borders and borders[-1] == len(words) - 1:  # a group of one
                    words.pop(), values.pop(), borders.pop()
                borders.append(len(words))
                last = key
            words.append(word)
            values.append((n, key[1], key[2]))
    yield from flush()


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, k)``: both directions of every pair of ``words(word, n)`` one edit apart, with the other word's ``n``."""
    dealt = groups(words).repartition(*GROUP).sortWithinPartitions(*GROUP, "word").select("word", "n", *GROUP)
    return dealt.mapInArrow(_pairs, "word string, near string, k long")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form: forms are followed to the last, in steps that double."""
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        then = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        then = cut_lineage(then.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if then.where("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every row of ``words(word, n)``, words distinct, of code points up to U+00FF.

    A word's form is its near word of largest ``n`` (ties: smallest in code-point order) if that is at least ``factor``
    times the word's own, else null; the root is where forms lead in the end, the word itself without one.  An empty table
    gives an empty result.
    """
    words = cut_lineage(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("k")).alias("k"), "near")).alias("best"))
    chosen = -F.col("best.k") >= F.lit(factor) * F.col("n")
    found = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.k")).alias("form_n"),
    ))
    roots = _roots(found.where("form is not null"))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
