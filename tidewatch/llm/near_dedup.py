"""Near-duplicate documents by a Chosen-Path forest of minwise tokens.

Every distinct word sequence is one node of the similarity graph.  Each tree sends a document down the path of its
minwise shingles: at level ``l`` of tree ``t`` the shingle with the smallest value of hash function ``(t, l)``.  Nodes
with one document end; nodes of at most ``LEAF`` documents are compared exhaustively; larger ones offer every document
against the node's smallest id and branch again by the next token.  Independent trees are repeated until the chance
that a pair at a similarity of 0.80 never meets, ``(1 - 0.8 ** LEVELS) ** TREES`` = 9.2e-6, is below one in a hundred
thousand.  Nodes that are still large at the lowest level and hold several of the components found so far are compared
exhaustively as well, every pair of different components: no node, bucket or pair is left out.

These comparisons run in blocks cut by the hash of the id.  Each pair of blocks is first compared by signatures, which
keeps the documents that have a near partner, and then by full shingle sets, as a product of incidence matrices; only
links that join two components are handed on, fewer than the documents of the block.

A group of documents that is such a node in many trees is compared once.

Offered pairs are screened by their signatures and confirmed on the full shingle sets.  Confirmation runs in two rounds: one
pair per document first, then all that would join two different components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import U64, cut_lineage, grams, numbered, only, per_slice, renamed, seeded, sequence_hash, slices, without, words_of
from tidewatch.llm.components import components, joined

SHINGLE = 5
TREES = 22
LEVELS = 4
LEAF = 8
SCREEN = 0.55  # least share of equal minwise values; six standard deviations below a similarity of 0.8
BLOCK = 1024  # documents of a large node per block of signatures
BLOCK_SHINGLES = 1 << 19  # shingles of a large node per block of sets
COLUMNS = 4096  # shingles per slice of an incidence matrix
BROADCAST_IDS = 1_000_000  # ids of 8 bytes that may be broadcast to find their texts; beyond that the texts are shuffled
FUNCTIONS = TREES * LEVELS
_FACTORS = seeded(FUNCTIONS, 7) | U64(1)
_MASKS = seeded(FUNCTIONS, 8)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per document: its word hashes and the sorted distinct hashes of its shingles."""
    hashes, _, _, bounds = words_of(data, offsets, lower=True)
    runs = grams(hashes, size)
    words, sets = [], []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        words.append(hashes[a:b])
        own = runs[a : b - size + 1] if b - a >= size else grams(hashes[a:b], int(b - a)) if b > a else hashes[:0]
        sets.append(np.unique(own))
    return words, sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise values (upper 32 bits) of every set under all functions; empty sets give zeros."""
    out = np.zeros((len(sets), FUNCTIONS), dtype=np.int32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for f in range(FUNCTIONS):
            low = np.minimum.reduceat((values ^ _MASKS[f]) * _FACTORS[f], starts)
            out[full, f] = (low >> U64(32)).astype(np.uint32).view(np.int32)
    return out


def _features(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    words, sets = shingle_sets(data, offsets)
    sig = signatures(sets)
    return pa.RecordBatch.from_arrays(
        [
            rows.column(0),
            pa.array([sequence_hash(w, 11) for w in words], pa.int64()),
            pa.array([sequence_hash(w, 12) for w in words], pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * FUNCTIONS), pa.array(sig.ravel())),
        ],
        names=["id", "c1", "c2", "n", "sig"],
    )


def _sets(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    _, sets = shingle_sets(data, offsets)
    return pa.RecordBatch.from_arrays([rows.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "s"])


@F.pandas_udf(T.LongType())
def _common(a, b):
    import pandas as pd

    def size(x: bytes, y: bytes) -> int:
        return len(np.intersect1d(np.frombuffer(x, dtype=U64), np.frombuffer(y, dtype=U64), assume_unique=True))

    return pd.Series([size(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def offered_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` offered by the forest, and the members ``(path, tree, id)`` of nodes still large at the lowest level."""
    here = nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select(
        "id", "tree", F.xxhash64("tree", F.element_at("sig", F.col("tree") * LEVELS + 1)).alias("path"),
        F.slice("sig", F.col("tree") * LEVELS + 2, LEVELS - 1).alias("rest"),
    )
    offers: list[DataFrame] = []
    leaves: list[DataFrame] = []
    for level in range(LEVELS):
        size = here.groupBy("path").agg(F.count("*").alias("k"), F.min("id").alias("hub")).where("k > 1")
        kept = cut_lineage(here.join(size, "path"))
        leaves.append(kept.where(F.col("k") <= LEAF).select("path", "id"))
        large = kept.where(F.col("k") > LEAF)
        offers.append(large.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
        if level < LEVELS - 1:
            here = large.select("id", "tree", F.xxhash64("path", F.element_at("rest", level + 1)).alias("path"), "rest")
    # a leaf holds at most LEAF ids, so its list is bounded
    leaf = reduce(DataFrame.union, leaves).groupBy("path").agg(F.collect_set("id").alias("ids"))
    pairs = leaf.select("ids", F.explode("ids").alias("a")).select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    return reduce(DataFrame.union, offers, pairs).distinct(), large.select("path", "tree", "id")


def _low_bytes(sig: str) -> Column:
    """One byte of every minwise value: other values agree once in 256, which a screen lets through rather than holds back."""
    return F.transform(sig, lambda x: (x.bitwiseAND(255) - 128).cast("tinyint"))


def screened(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose signatures agree often enough, with that share."""
    sig = nodes.select("id", _low_bytes("sig").alias("sig"), "n")
    near = (
        pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), "a")
        .join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb")), "b")
    )
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(FUNCTIONS))
    # a pair over the threshold cannot differ in size by more than the threshold allows
    return near.where("least(na, nb) * 2 >= greatest(na, nb)").select("a", "b", "na", "nb", equal.alias("share")).where(F.col("share") >= SCREEN)


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the component of each side; those inside one component are done."""
    side = lambda x: labels.select(F.col("u").alias(x), F.col("component").alias(f"c{x}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return out.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")


def linked_groups(texts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(u, component)`` of the nodes; ``texts(id, text)`` holds their texts."""

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        return cut_lineage(texts.join(wanted, "id", "left_semi").mapInArrow(per_slice(_sets), "id long, s binary"))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = (
            pairs.select("a", "b", "na", "nb")
            .join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        )
        same = both.select("a", "b", (F.col("na") + F.col("nb")).alias("total"), _common("sa", "sb").alias("x"))
        return same.where(F.col("x") * 100 >= F.lit(percent) * (F.col("total") - F.col("x"))).select(F.col("a").alias("u"), F.col("b").alias("v"))

    pairs, large = offered_pairs(nodes)
    left = cut_lineage(screened(pairs, nodes))
    sets = sets_of(left)
    # first one pair per document, then all that would join different components
    best = F.max_by(F.struct("a", "b", "na", "nb"), F.struct("share", -F.col("a"), -F.col("b")))
    labels = components(confirmed(left.groupBy("b").agg(best.alias("x")).select("x.*"), sets))
    labels = joined(labels, _between(cut_lineage(confirmed(_labelled(left, labels), sets)), labels))
    found = cross_links(large, nodes, labels, percent, sets_of)
    return labels if found is None else joined(labels, _between(found, labels))


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links ``(u, v)`` of documents as links of their components."""
    return _labelled(links.select(F.col("u").alias("a"), F.col("v").alias("b")), labels).select(F.col("ca").alias("u"), F.col("cb").alias("v"))


def cross_links(large: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Links ``(u, v)`` between different components inside nodes that are large at the lowest level of the forest.

    Every pair of different components of a node is compared; the links returned join the same components as all links.
    """
    member = large.select("path", "id").join(labels.select(F.col("u").alias("id"), "component"), "id", "left")
    member = cut_lineage(_new_nodes(member.select("path", "id", F.coalesce("component", "id").alias("c"))))
    if member.isEmpty():
        return None
    short = nodes.select("id", "n", F.unhex(F.array_join(F.transform(_low_bytes("sig"), lambda x: F.substring(F.hex(x.cast("long") + 384), 2, 2)), "")).alias("x"))
    near = _blocks(member.join(short, "id"), F.lit(1), BLOCK).applyInArrow(_partners, "path long, id long, c long, n long").distinct()
    near = cut_lineage(_new_nodes(cut_lineage(near)))
    if near.isEmpty():
        return None
    sets = sets_of(near.select(F.col("id").alias("a"), F.col("id").alias("b")))
    # a document counts as 512 shingles at least, so that a block also bounds the documents
    whole = _blocks(near.join(sets.withColumnRenamed("s", "x"), "id"), F.greatest("n", F.lit(BLOCK_SHINGLES // BLOCK)), BLOCK_SHINGLES)
    return cut_lineage(whole.applyInArrow(_joining(percent), "u long, v long").distinct())


def _new_nodes(member: DataFrame) -> DataFrame:
    """Members of nodes that hold several components, only one node (of the smallest path) of those with the same members.

    A group that stays together in many trees is so compared once; two digests and the count stand for the members.
    """
    digest = [F.count("*"), F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64("id", F.lit(1)))]
    nodes = member.groupBy("path").agg(F.min("c").alias("x"), F.max("c").alias("y"), *[d.alias(f"d{i}") for i, d in enumerate(digest)])
    first = nodes.where("x < y").groupBy("d0", "d1", "d2").agg(F.min("path").alias("path")).select("path")
    return member.join(first, "path")


def _blocks(member: DataFrame, weight: Column, most: int) -> GroupedData:
    """``member(path, id, c, n, x)`` grouped by pairs of blocks of a node, each block of about ``most`` in ``weight``."""
    count = member.groupBy("path").agg(F.ceil(F.sum(weight) / F.lit(most)).cast("int").alias("m"))
    placed = member.join(count, "path").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("m")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return dealt.select("path", "id", "c", "n", "x", "salt", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j")).groupBy("path", "i", "j")


def _asked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Components, sizes and blocks of the rows of a pair of blocks, and the rows outside the largest component."""
    c, n, salt = (table.column(x).to_numpy() for x in ("c", "n", "salt"))
    values, which, counts = np.unique(c, return_inverse=True, return_counts=True)
    return c, n, salt, np.flatnonzero(which != counts.argmax())


def _open(c: np.ndarray, salt: np.ndarray, rows: np.ndarray, cross: bool) -> np.ndarray:
    """Which pairs of ``rows`` with all rows are of different components, and of different blocks if ``cross``."""
    out = c[rows, None] != c[None]
    return out & (salt[rows, None] != salt[None]) if cross else out


def _partners(table: pa.Table) -> pa.Table:
    """Rows with a near partner in another component."""
    c, n, salt, rest = _asked(table)
    cross = table.column("i")[0] != table.column("j")[0]
    sig = np.ascontiguousarray(np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.uint8).reshape(len(c), FUNCTIONS).T)
    hit = np.zeros(len(c), dtype=bool)
    for k in range(0, len(rest), 128):
        rows = rest[k : k + 128]
        equal = np.zeros((len(rows), len(c)), dtype=np.uint8)
        for f in range(FUNCTIONS):
            equal += sig[f][rows, None] == sig[f][None]
        near = (equal >= SCREEN * FUNCTIONS) & _open(c, salt, rows, cross)
        near &= np.minimum(n[rows, None], n) * 2 >= np.maximum(n[rows, None], n)
        hit[rows] |= near.any(axis=1)
        hit |= near.any(axis=0)
    return table.select(["path", "id", "c", "n"]).filter(pa.array(hit))


def _joining(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links of a pair of blocks, by full sets, as few as join the components that all links join."""

    def run(table: pa.Table) -> pa.Table:
        c, n, salt, rest = _asked(table)
        cross = table.column("i")[0] != table.column("j")[0]
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x, dtype=U64) for x in table.column("x").to_pylist()]
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts[column] > 1  # the others add nothing to a product
        row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(rest), len(c)), dtype=np.float32)
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, (k, k + COLUMNS))
            part = np.zeros((len(c), COLUMNS), dtype=np.float32)
            part[row[a:b], column[a:b] - k] = 1
            common += part[rest] @ part.T
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        out = []
        for k, r in enumerate(rest.tolist()):
            x = common[k].astype(np.int64)
            linked = (x * 100 >= percent * (n[r] + n - x)) & _open(c, salt, rest[k : k + 1], cross)[0]
            for other in np.flatnonzero(linked).tolist():
                p, q = root(int(c[r])), root(int(c[other]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((int(ids[r]), int(ids[other])))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Two documents are linked when their sets of distinct five-word shingles (lower-cased A-Z) have a Jaccard similarity of
    at least ``percent`` / 100; documents of fewer words have one shingle, their whole word sequence.  ``component_id`` is
    the smallest id that is reachable and ``kept`` marks the document that has it.  Null or wordless texts have no shingles
    and are their own component.  A row without id is kept, with a null component, and links nothing.  Rows repeated with
    the same id get the same values, so both are kept.  Other columns are ignored; an empty table gives an empty result.
    """
    return _components(docs, doc_id, text, percent).drop("c1", "c2")


def _components(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """``near_duplicates`` with the content hashes ``c1``, ``c2`` of the words."""
    rows = only(docs, id=doc_id, text=text).withColumn("id", F.col("id").cast("long"))
    features = rows.mapInArrow(per_slice(_features), "id long, c1 long, c2 long, n long, sig array<int>")
    features = cut_lineage(features)
    usable = features.where("id is not null and n > 0")
    nodes = cut_lineage(usable.groupBy("c1", "c2").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n")))
    labels = linked_groups(rows.where("id is not null"), nodes.select("id", "sig", "n"), percent)
    named = nodes.select("c1", "c2", "id").join(labels.select(F.col("u").alias("id"), "component"), "id", "left").select(
        "c1", "c2", F.coalesce("component", "id").alias("component")
    )
    out = features.select("id", "c1", "c2", "n").join(named, ["c1", "c2"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "c1", "c2",
    )


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without the later members of near-duplicate groups; columns stay, under any name.

    Rows go by id and content, so another text under the id of one that goes stays.  Rows without id, and null, empty and
    wordless texts, stay; repeated rows stay or go together.  An empty table gives an empty result.
    """
    plain, text, own = numbered(docs), f"c{docs.columns.index('text')}", f"c{docs.columns.index('doc_id')}"
    keys = ["key_id", "key_a", "key_b"]

    def named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                hashes, _, _, bounds = words_of(data, offsets, lower=True)
                words = [hashes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sides = [pa.array([sequence_hash(w, seed) for w in words], pa.int64()) for seed in (11, 12)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *sides], names=[*rows.schema.names, *keys[1:]])

    wide = plain.mapInArrow(named, T.StructType([*plain.schema, *[T.StructField(k, T.LongType()) for k in keys[1:]]]))
    gone = _components(docs, "doc_id", "text", percent).where("not kept").select(F.col("doc_id").alias(keys[0]), F.col("c1").alias(keys[1]), F.col("c2").alias(keys[2]))
    return renamed(without(wide.withColumn(keys[0], F.col(own).cast("long")), gone, keys), docs)
