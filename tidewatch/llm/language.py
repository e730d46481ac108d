"""Languages of a document as a mixture.

Letter trigrams of labelled texts give one likelihood per language.  For every document expectation-maximisation over
its words estimates the proportions of the languages, and the set of languages is the one with the best likelihood after
a penalty for every further language.  The model is fitted on a bounded sample of labelled rows and has a fixed number
of buckets; documents are scored whole, a slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import quoted
from tidewatch.llm.common import SLICE_BYTES, held, numbered, only, renamed, slices

BUCKETS = 1 << 16
MAX_LABELLED = 3000  # labelled rows per language that the model is fitted on
ROUNDS = 8
REFITS = 4
PENALTY = 6.0  # log-likelihood that a further language has to gain, besides half the log of the number of words


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str | None]):
    """``(bucket per letter, first letter of every word, first word of every document)``."""
    lowered = [(t or "").lower() for t in texts]
    joined = " " + " ".join(lowered) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    letter = _letters()[points]
    points[~letter] = 32
    at = np.flatnonzero(letter)
    code = points[at - 1] * np.uint32(0x85EBCA6B) + points[at] * np.uint32(0xC2B2AE35) + points[at + 1] * np.uint32(0x27D4EB2F)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x9E3779B1)
    first = np.flatnonzero(~letter[at - 1])
    edges = 1 + np.cumsum([0] + [len(t) + 1 for t in lowered])
    return code >> np.uint32(16), first, np.searchsorted(at[first], edges)


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t or "")
        if size >= SLICE_BYTES // 2:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", limit: int = MAX_LABELLED) -> tuple[list[str], np.ndarray]:
    """``(languages, log-likelihood per bucket and language)`` from about ``limit`` rows of each language, chosen by hash."""
    rows = only(labelled, text=text, lang=lang, key=key).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    share = F.create_map(*[F.lit(x) for n in names for x in (n, min(1.0, limit / counts[n]))])
    chosen = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in _groups(texts):
                bucket, first, docs = trigrams(texts[i:j])
                letters = np.append(first, len(bucket))[docs]
                for d in range(j - i):
                    own = totals.setdefault(langs[i + d], np.zeros(BUCKETS, dtype=np.int64))
                    own += np.bincount(bucket[letters[d] : letters[d + 1]], minlength=BUCKETS)
        for name, own in totals.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "bucket", "n"])

    found = chosen.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BUCKETS, len(names)))
    table[found["bucket"].to_numpy(dtype=np.int64), [names.index(x) for x in found["lang"]]] = found["n"].to_numpy(dtype=np.float64)
    table = np.log(table + 0.5) - np.log(table.sum(axis=0) + 0.5 * BUCKETS)
    return names, table.astype(np.float32)


def mixture(words: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Proportions of the languages: one row per document, from the words' log-likelihoods; wordless rows are zero."""
    n_docs, n_langs = len(docs) - 1, words.shape[1]
    counts = np.diff(docs)
    full = np.flatnonzero(counts)
    out = np.zeros((n_docs, n_langs), dtype=np.float32)
    if not len(full):
        return out
    starts, counts = docs[full], counts[full]
    owner = np.repeat(np.arange(len(full)), counts)
    top = words.max(axis=1, keepdims=True)
    likelihood = np.exp(words - top)  # of a word, its best language being one

    def em(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds + 1):
            part = likelihood * share[owner]
            total = part.sum(axis=1)
            last = share
            share = np.add.reduceat(part / total[:, None], starts, axis=0) / counts[:, None].astype(np.float32)
        return last, np.add.reduceat(np.log(total), starts)

    share, _ = em(np.full((len(full), n_langs), 1.0 / n_langs, dtype=np.float32), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, best_value = share, np.full(len(full), -np.inf)
    for k in range(1, n_langs + 1):
        inside = np.zeros(share.shape, dtype=bool)
        np.put_along_axis(inside, order[:, :k], True, axis=1)
        start = np.where(inside, np.maximum(share, 1e-3), np.float32(1e-30)).astype(np.float32)
        start /= start.sum(axis=1, keepdims=True)
        own, value = em(start, REFITS if k > 1 else 0)
        value = value - (k - 1) * (PENALTY + 0.5 * np.log(counts))
        better = value > best_value
        best = np.where(better[:, None], own, best)
        best_value = np.where(better, value, best_value)
    out[full] = best
    return out


def _shares(texts: list[str | None], model: tuple[list[str], np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(first, last + 1, shares)``: language proportions of groups of texts; all zero without letters."""
    names, table = model
    for i, j in _groups(texts):
        bucket, first, bounds = trigrams(texts[i:j])
        if names and len(first):
            yield i, j, mixture(np.add.reduceat(table[bucket], first, axis=0), bounds)
        else:
            yield i, j, np.zeros((j - i, max(1, len(names))), dtype=np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, languages)``, one row per input row.

    ``score`` is the share of words in the main language, ``languages`` maps every language of the chosen set to its share.
    Text that is null or has no letter gives ``und``, score 0 and an empty map, as does a model without languages.  Ties go
    to the language that comes first by name.  Other columns are ignored.
    """
    names, _ = model

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, shares in _shares(batch.column(1).to_pylist(), model):
                best, value = shares.argmax(axis=1), shares.max(axis=1)
                sets = [[(names[k], float(s[k])) for k in np.flatnonzero(s > 1e-6)] if v > 0 else [] for s, v in zip(shares, value, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([names[k] if v > 0 else "und" for k, v in zip(best, value, strict=True)], pa.string()),
                        pa.array(np.clip(value.astype(np.float64), 0.0, 1.0)),
                        pa.array(sets, pa.map_(pa.string(), pa.float64())),
                    ],
                    names=["doc_id", "lang_pred", "score", "languages"],
                )

    rows = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: language known, and the id's crc32 modulo 4 is not 2."""
    return docs.where(quoted("lang").isNotNull() & (held("doc_id", 4) != 2))


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float = 0.4) -> DataFrame:
    """The documents with letters whose main language makes up at least ``least`` of the words; columns stay.

    Every row is judged by its text alone, in one pass without a shuffle: rows without id like all others, repeated rows
    alike, null and empty texts go.  Other columns pass through under any name; an empty table gives an empty result.
    """
    at = docs.columns.index("text")
    text = f"c{at}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, _ in slices(batch, text):
                keep = np.zeros(rows.num_rows, dtype=bool)
                for i, j, shares in _shares(rows.column(at).to_pylist(), model):
                    value = np.clip(shares.max(axis=1).astype(np.float64), 0.0, 1.0)
                    keep[i:j] = (value > 0) & (value >= least)
                yield rows.filter(pa.array(keep))

    plain = numbered(docs)
    return renamed(plain.mapInArrow(run, plain.schema), docs)
