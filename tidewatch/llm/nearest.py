"""Nearest neighbours by multi-index hashing.

Vectors are centred, turned by learned rotations (iterative quantisation) and cut to sign bits.  A code of ``BITS`` bits
is split into ``PARTS`` substrings, each with its own index.  Two codes within Hamming distance ``r`` agree in one of the
substrings up to ``r // PARTS`` bits, so probing every index within that distance finds all of them; the candidates are
checked on the whole code and ranked by the distance of the original vectors.  A query is searched twice.  First it meets
the codes that share a whole substring with it, of which about ``WANTED`` are ranked.  The worst of the distances found
bounds the true one from above, and the second radius is the Hamming distance that pairs of the sample so far apart stay
within (mean and ``MARGIN`` deviations), so the candidates grow with the table as the codes demand.

Probing pays only while few cells are met.  Where the codes of the sample say that a radius meets so many that comparing
the query with all vectors is cheaper, or that more than ``MOST`` codes lie inside, the query is compared with all vectors
instead: block by block, by one matrix product in short floats, of which only pairs below the bound (widened by all that
rounding can do) are ranked.  This misses nothing, takes a few nanoseconds a pair and ships a vector once per block of
queries, but grows with queries times vectors; vectors without structure leave no other way.

Copies of one vector are one entry of the index, with the smallest ids that a result can need.  Index cells are cut into
blocks of bounded size by counts, queries and vectors into blocks of bounded bytes, so neither a frequent cell nor many
queries fill a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import quoted
from tidewatch.llm.common import U64, cut_lineage, mix, only

BITS, PARTS = 256, 16
SUB = BITS // PARTS
FIT_ROWS = 8192  # vectors that the rotations are learned from
SAMPLE_CODES = 4096  # codes that the radii are estimated with
WANTED = 600  # codes in the first radius
MARGIN = 3.0  # standard deviations of the Hamming distance above its mean at a float distance
MOST = 4096  # codes of a second radius that are ranked one by one
CELL = 4096  # codes per block of a cell
PACK = 1 << 16  # codes that are dealt to cells at once
BLOCK_BYTES = 64_000_000  # vectors of a block, as short floats
SAMPLE_VALUES = 2_000_000  # components of sampled vectors that bound the distances
PAIRS = 8_000_000  # pairs that a block may be asked to rank
TILE = (256, 4096)  # queries and vectors of one matrix product
# nanoseconds: to probe a cell, to meet a code there, to rank a pair, to compare with a vector per dimension
PROBE, MEET, RANK, SCAN = 2000.0, 4.0, 400.0, 0.1
ONES = np.bitwise_count(np.arange(1 << SUB, dtype=np.uint32)).astype(np.uint8)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, v)``: vectors with an id, without null or non-finite components, not zero, of the most frequent length.

    Vectors of short floats stay so, all others become double.
    """
    v = F.col("v")
    kind = "float" if df.select(quoted(vector)).schema[0].dataType.simpleString() == "array<float>" else "double"
    rows = only(df, id=key, v=vector).where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), v.cast(f"array<{kind}>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0.0)
    rows = rows.where(fine)
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (top["n"] if top else 0)).distinct()


def learn(sample: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, projection)``: rotations side by side, each learned so that signs lose least."""
    mean = sample.mean(axis=0)
    x = sample - mean
    dims, rng = x.shape[1], np.random.default_rng(3)
    turns = []
    for _ in range(-(-BITS // dims)):
        turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(x @ turn >= 0, 1.0, -1.0).T @ x)
            turn = (u @ w).T
        turns.append(turn)
    return mean, np.concatenate(turns, axis=1)[:, :BITS]


def encode(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Codes as rows of ``BITS // 8`` bytes."""
    return np.packbits((vectors - model[0]) @ model[1] >= 0, axis=1)


def learn_radii(vectors: np.ndarray, codes: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(distances, radii)``: ascending float distances, and the Hamming radius of pairs up to each of them.

    For distances shorter than those of the sample its vectors are moved so far, towards others of the sample and any way,
    and the wider radius counts; below the shortest of these the radius stays.
    """
    some = min(512, len(vectors))
    square = (vectors**2).sum(axis=1)
    d = np.sqrt(np.maximum(0.0, square[:some, None] + square[None] - 2 * vectors[:some] @ vectors.T))
    h = np.concatenate([hamming(codes[i : min(i + 64, some), None, :], codes[None]) for i in range(0, some, 64)])
    other = np.arange(some)[:, None] != np.arange(len(vectors))[None]
    d, h = d[other], h[other]
    order = np.argsort(d)
    d, h = d[order], h[order].astype(np.float64)
    reach = lambda part: part.mean() + MARGIN * max(part.std(), 1.0)
    edges, radii, here, size = [], [], 0, 256
    while here < len(d):
        edges.append(d[here : here + size][-1])
        radii.append(reach(h[here : here + size]))
        here, size = here + size, size * 2
    if not radii:
        return np.empty(0), np.empty(0, dtype=np.int32)
    ways = [np.roll(vectors, 1, axis=0)[:some] - vectors[:some], np.random.default_rng(5).normal(size=(some, vectors.shape[1]))]
    ways = [w / np.maximum(np.linalg.norm(w, axis=1), 1e-300)[:, None] for w in ways]
    short = edges[0] * 2.0 ** (np.arange(-20, 0) / 2)
    moved = [max(reach(hamming(codes[:some], encode(vectors[:some] + step * w, model))) for w in ways) for step in short]
    edges, radii = np.concatenate((short, edges)), np.concatenate((moved, radii))
    return edges, np.minimum(np.ceil(np.maximum.accumulate(radii)), BITS).astype(np.int32)


def radius_at(distance: np.ndarray, learned: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    edges, radii = learned
    return radii[np.minimum(np.searchsorted(edges, distance), len(radii) - 1)] if len(radii) else np.full(len(distance), BITS, dtype=np.int32)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two code arrays (bytes), paired or broadcast."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    return sum(np.bitwise_count(a[..., i] ^ b[..., i]).astype(np.int32) for i in range(BITS // 64))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)


def substrings(code: np.ndarray) -> np.ndarray:
    return code.view(">u2").astype(np.uint16)


class Planner:
    """What a radius costs, judged by the codes of the sample: of ``n`` vectors with ``dims`` components."""

    def __init__(self, sample: np.ndarray, n: int, dims: int):
        self.sample, self.n, self.top = sample, n, _top(n)
        self.all = n * dims * SCAN

    def worth(self, code: np.ndarray, radius: int, ring: int) -> bool:
        """Whether to probe the indexes up to ``ring`` bits for codes within ``radius`` rather than compare with all vectors."""
        shift = np.uint16(SUB - self.top)
        away = ONES[(substrings(self.sample) >> shift) ^ (substrings(code[None]) >> shift)] <= ring
        cells = sum(comb(self.top, i) for i in range(min(ring, self.top) + 1))
        met = max(away.sum(axis=1).mean(), PARTS * cells / (1 << self.top))
        d = hamming(code[None], self.sample)
        inside = min(self._share(d <= radius, NormalDist(d.mean(), max(d.std(), 1e-9)).cdf(radius + 0.5)), met) * self.n
        return inside <= MOST and PARTS * cells * PROBE + met * self.n * MEET + inside * RANK < self.all

    def first(self, code: np.ndarray) -> tuple[int, bool]:
        """``(radius, probed)`` of the first search: about ``WANTED`` of the codes that share a substring lie inside."""
        same = (substrings(self.sample) == substrings(code[None])).any(axis=1)
        level = WANTED / max(1.0, self._share(same, PARTS / (1 << SUB)) * self.n)
        if level >= 1:
            return BITS, True
        d = hamming(code[None], self.sample)
        rest = 1 - SUB / BITS  # what is left to differ
        if same.sum() >= 16:
            radius = int(np.quantile(d[same], level))
        else:
            radius = int(np.clip(d.mean() * rest + NormalDist().inv_cdf(level) * d.std() * rest**0.5, 0, BITS))
        return radius, self._share(same & (d <= radius), 0.0) * self.n <= MOST and self.worth(code, 0, 0)

    @staticmethod
    def _share(hits: np.ndarray, model: float) -> float:
        """Of all codes: what the model says, or the sample if it holds more than a few."""
        return max(model, float(hits.mean()) if hits.sum() >= 4 else 0.0)


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for every id divisible by ``every``.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id, a query is no result of its own.
    Vectors that are null, zero, of another length than most, or hold null or non-finite components, and rows without id
    take no part; repeated rows count once.  Copies of a vector are all found.  Fewer candidates give fewer rows, an empty
    table none.  The radii, and the codes of a bounded sample, are computed while the plan is built.
    """
    spark = df.sparkSession
    rows = cut_lineage(usable(df, key, vector)).withColumn("h", F.xxhash64("v"))  # sorts compare whole vectors only where hashes meet
    same = Window.partitionBy("h", "v").orderBy("id")
    ranked = rows.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1)
    ids = cut_lineage(ranked.withColumn("rep", F.min("id").over(Window.partitionBy("h", "v"))))
    reps = ids.where("rn = 1").select("rep", "v")
    queries = rows.where(F.col("id") % every == 0)
    asked = cut_lineage(queries.join(ids.where("rn = 1").select("h", "v", "rep"), ["h", "v"]).select(F.col("id").alias("query_id"), "rep").distinct())
    n = reps.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n or asked.isEmpty():
        return empty
    draw = lambda most: reps.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / n))).select("v").limit(2 * most)
    model = learn(np.array([r["v"] for r in draw(FIT_ROWS).collect()] or [reps.first()["v"]]))
    floats = np.array([r["v"] for r in draw(SAMPLE_CODES).collect()] or [reps.first()["v"]])
    sample = encode(floats, model)
    learned = learn_radii(floats, sample, model)
    dims = floats.shape[1]
    some = floats[: max(1, SAMPLE_VALUES // dims)] - model[0]

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(_matrix(batch.column(1)), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], names=["rep", "code"])

    wanted = cut_lineage(reps.join(asked.select("rep").distinct(), "rep"))
    grid = _grid(wanted.count(), n, dims)
    if n <= WANTED:
        best = _ranked(None, wanted.select("rep", "v", F.lit(None).cast("double").alias("bound"), F.lit(True).alias("scan")), reps, grid, dims, k)
    else:
        codes = cut_lineage(reps.mapInArrow(coded, "rep long, code binary"))
        planner = Planner(sample, n, dims)

        def begun(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                plans = [planner.first(c) for c in _codes(batch.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([r for r, _ in plans], pa.int32()), pa.array([0] * len(plans), pa.int32()), pa.array([p for _, p in plans], pa.bool_())],
                    names=["rep", "code", "radius", "ring", "probed"],
                )

        spread = lambda some: some.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rep")
        first = cut_lineage(spread(codes.join(wanted.select("rep").distinct(), "rep")).mapInArrow(begun, "rep long, code binary, radius int, ring int, probed boolean"))
        probed = first.where("probed")
        vectors = lambda some: some.join(wanted, "rep").select("rep", "v", "bound", "scan")
        best = spark.createDataFrame([], "q long, c long, score double")
        if not probed.isEmpty():
            best = cut_lineage(_ranked(_search(codes, probed, n, grid), vectors(probed.select("rep", F.lit(None).cast("double").alias("bound"), F.lit(False).alias("scan"))), reps, grid, dims, k))
        worst = best.groupBy(F.col("q").alias("rep")).agg(F.max("score").alias("score"), F.count("*").alias("hits"))

        def widened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound = batch.column(3).to_numpy(zero_copy_only=False).copy()
                few = np.isnan(bound)  # found too few to go by the index
                if len(some) > k:  # vectors of the sample bound the distances as well
                    v = _matrix(batch.column(4)) - model[0]
                    for i in range(0, len(v), 256):
                        gap = (some**2).sum(axis=1) - 2 * v[i : i + 256] @ some.T
                        gap = np.partition(gap, k, axis=1)[:, k] + (v[i : i + 256] ** 2).sum(axis=1)
                        bound[i : i + 256] = np.fmin(bound[i : i + 256], np.sqrt(np.maximum(gap, 0.0)) * (1 + 1e-9))
                known = ~np.isnan(bound)
                radius = np.full(len(bound), BITS, dtype=np.int32)
                radius[known] = radius_at(bound[known], learned)
                ring = (radius // PARTS).astype(np.int32)
                more = few | (radius > batch.column(2).to_numpy())
                plans = [bool(m and planner.worth(c, int(r), int(i))) for m, c, r, i in zip(more & ~few, _codes(batch.column(1)), radius, ring, strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(radius), pa.array(ring), pa.array(plans, pa.bool_()), pa.array(bound, mask=~known)], names=["rep", "code", "radius", "ring", "probed", "bound"])
                yield out.filter(pa.array(more))

        known = F.when(F.col("hits") >= min(k + 1, n), F.col("score"))
        done = F.when(F.col("probed"), F.least("radius", F.lit(PARTS - 1))).otherwise(F.lit(-1))  # what shares no substring differs in each
        wide = first.join(worst, "rep", "left").join(wanted, "rep").select("rep", "code", done.cast("int").alias("done"), F.coalesce(known, F.lit(float("nan"))).alias("score"), "v")
        wide = cut_lineage(spread(wide).mapInArrow(widened, "rep long, code binary, radius int, ring int, probed boolean, bound double"))
        if not wide.isEmpty():
            probed = wide.where("probed")
            found = None if probed.isEmpty() else _search(codes, probed, n, grid)
            again = _ranked(found, vectors(wide.select("rep", "bound", (~F.col("probed")).alias("scan"))), reps, grid, dims, k)
            best = _first(best.union(again).groupBy("q", "c").agg(F.min("score").alias("score")), k)
    out = asked.select("query_id", F.col("rep").alias("q")).join(best.select("q", F.col("c").alias("rep"), "score"), "q").join(ids.select("rep", F.col("id").alias("vec_id")), "rep")
    out = out.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _top(n: int) -> int:
    """Leading bits of a substring that name its cell."""
    return int(min(SUB, max(0, np.ceil(np.log2(max(1, n / CELL))))))


def _search(codes: DataFrame, queries: DataFrame, n: int, grid: tuple[int, int]) -> DataFrame:
    """``(qb, cb, pairs)``: for every query all codes within its radius that an index holds within its ring.

    ``pairs`` holds two ids each, a query of block ``qb`` and a vector of block ``cb``.
    """
    top = _top(n)
    shift = SUB - top
    near = np.bitwise_count(np.arange(1 << top, dtype=np.uint32))

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACK:
                yield pa.concat_batches(held)
                held = []
        if held:
            yield pa.concat_batches(held)

    def marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probed = np.zeros((PARTS, 1 << SUB), dtype=bool)
        for batch in batches:
            sub, rings = substrings(_codes(batch.column(0))), batch.column(1).to_numpy()
            for ring in np.unique(rings):
                flips = np.flatnonzero(ONES <= ring).astype(np.uint16)
                own = sub[rings == ring]
                if len(flips) * len(own) >= probed.shape[1] * 64:
                    probed[:] = True
                for x in () if probed.all() else own:
                    probed[np.arange(PARTS)[:, None], x[:, None] ^ flips] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(probed).tobytes()], pa.binary())], names=["probed"])

    # substrings that any query asks for, a bit each: other entries of the index are not shipped
    bits = np.zeros((PARTS << SUB) // 8, dtype=np.uint8)
    for row in queries.select("code", "ring").coalesce(8).mapInArrow(marked, "probed binary").collect():
        bits |= np.frombuffer(row["probed"], dtype=np.uint8)

    def entries(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, part, cell)`` of all substrings that are asked for."""
        sub = substrings(code)
        row, part = np.nonzero(np.unpackbits(bits).reshape(PARTS, -1)[np.arange(PARTS), sub])
        return row, part, sub[row, part].astype(np.int64) >> shift

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            _, part, cell = entries(_codes(batch.column(0)))
            count = np.bincount((part << top) | cell, minlength=PARTS << top)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array((at >> top).astype(np.int32)), pa.array((at & ((1 << top) - 1)).astype(np.int32)), pa.array(count[at].astype(np.int64))], names=["part", "cell", "n"])

    def packed(rows: np.ndarray, part: np.ndarray, cell: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        """One row per cell and at most ``CELL`` of its entries; ``rows`` are their places in ``columns``."""
        key = (part.astype(np.int64) << SUB) | cell
        order = np.argsort(key, kind="stable")
        key, rows = key[order], rows[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.concatenate((starts[1:], [len(key)]))
        cuts = [(x, min(x + CELL, b)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) for x in range(a, b, CELL)]
        first = np.array([a for a, _ in cuts], dtype=np.int64)
        taken = [c[rows] for c in columns]
        arrays = [pa.array((key[first] >> SUB).astype(np.int32)), pa.array((key[first] & ((1 << SUB) - 1)).astype(np.int32))]
        arrays += [pa.array([t[a:b].tobytes() for a, b in cuts], pa.binary()) for t in taken]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "cell", "ids", "codes", "radii", "rings"][: len(arrays)])

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            code = _codes(batch.column(1))
            row, part, cell = entries(code)
            if len(row):
                yield packed(row, part, cell, [batch.column(0).to_numpy().astype("<i8"), code])

    def probing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            code = _codes(batch.column(1))
            cells = substrings(code).astype(np.int64) >> shift
            columns = [batch.column(0).to_numpy().astype("<i8"), code, batch.column(2).to_numpy().astype("<i4"), batch.column(3).to_numpy().astype("<i4")]
            for ring in np.unique(columns[3]):
                flips = np.flatnonzero(near <= ring)
                rows = np.flatnonzero(columns[3] == ring)
                step = max(1, (1 << 20) // (PARTS * len(flips)))
                for i in range(0, len(rows), step):
                    some = rows[i : i + step]
                    cell = cells[some][:, :, None] ^ flips
                    yield packed(np.repeat(some, PARTS * len(flips)), np.broadcast_to(np.arange(PARTS)[None, :, None], cell.shape).ravel(), cell.ravel(), columns)

    # a row per cell that holds a code, at most PARTS << SUB of them
    sizes = F.broadcast(cut_lineage(codes.select("code").mapInArrow(counted, "part int, cell int, n long").groupBy("part", "cell").agg(F.ceil(F.sum("n") / F.lit(CELL)).cast("int").alias("blocks"))))
    index = codes.select("rep", "code").mapInArrow(indexed, "part int, cell int, ids binary, codes binary").join(sizes, ["part", "cell"])
    index = index.select("part", "cell", F.pmod(F.xxhash64("ids"), "blocks").alias("salt"), "ids", "codes")
    asked = queries.select("rep", "code", "radius", "ring").mapInArrow(probing, "part int, cell int, ids binary, codes binary, radii binary, rings binary").join(sizes, ["part", "cell"])
    asked = asked.select("part", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("salt"), "ids", "codes", "radii", "rings")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            part = left.column("part")[0].as_py()
            ids, qids, radius, ring = (np.frombuffer(b"".join(t.column(c).to_pylist()), dtype=kind) for t, c, kind in ((left, "ids", "<i8"), (right, "ids", "<i8"), (right, "radii", "<i4"), (right, "rings", "<i4")))
            code, qcode = _codes(left.column("codes")), _codes(right.column("codes"))
            sub, qsub = substrings(code), substrings(qcode)
            own = np.ascontiguousarray(sub[:, part])
            for i in range(0, len(qids), 64):
                least = ring[i : i + 64].astype(np.uint8)
                a, b = np.nonzero(ONES[qsub[i : i + 64, part][:, None] ^ own[None]] <= least[:, None])
                kept = hamming(qcode[i + a], code[b]) <= radius[i + a]
                a, b = a[kept], b[kept]
                # a pair is reported by the first index that finds it
                first = (ONES[qsub[i + a] ^ sub[b]] <= least[a][:, None]).argmax(axis=1) == part
                out.append((qids[i + a[first]], ids[b[first]]))
        q, c = (np.concatenate([o[i] for o in out]) if out else np.empty(0, dtype=np.int64) for i in (0, 1))
        qb, cb = _block(q, grid[0]), _block(c, grid[1])
        order = np.lexsort((cb, qb))
        q, c, qb, cb = q[order], c[order], qb[order], cb[order]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), dtype=bool), (qb[1:] != qb[:-1]) | (cb[1:] != cb[:-1]))))
        both = np.stack((q, c), axis=1).astype("<i8")
        pairs = [both[x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(q)], strict=True)] if len(q) else []
        return pa.table({"qb": qb[starts], "cb": cb[starts], "pairs": pa.array(pairs, pa.binary())})

    by = ["part", "cell", "salt"]
    return index.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(compare, "qb int, cb int, pairs binary")


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) % U64(blocks)).astype(np.int32)


def _grid(asked: int, n: int, dims: int) -> tuple[int, int]:
    """Blocks of queries and of vectors in the ranking: vectors in 32 blocks or more, queries in as few as memory allows."""
    rows = max(1, BLOCK_BYTES // (4 * dims))
    vectors = -(-n // min(rows, max(8192, n // 32)))
    return max(1, -(-asked // rows), -(-asked * MOST // (PAIRS * vectors))), vectors


def exact(asked: np.ndarray, vectors: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of ``asked[a]`` and ``vectors[b]`` in double precision."""
    score = np.empty(len(a))
    for i in range(0, len(a), 1 << 15):
        gap = vectors[b[i : i + (1 << 15)]].astype(np.float64) - asked[a[i : i + (1 << 15)]].astype(np.float64)
        score[i : i + (1 << 15)] = np.sqrt((gap * gap).sum(axis=1))
    return score


def _best(a: np.ndarray, b: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` of every ``a`` that are least by score, then ``b``."""
    order = np.lexsort((b, score, a))
    a, b, score = a[order], b[order], score[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < most
    return a[kept], b[kept], score[kept]


def _rows(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place in wanted, place in ids)`` of all matches; ``ids`` ascending."""
    first = np.searchsorted(ids, wanted)
    count = np.searchsorted(ids, wanted, side="right") - first
    at = np.repeat(np.arange(len(wanted)), count)
    return at, np.arange(len(at)) + (first - (np.cumsum(count) - count))[at]


def closest(asked: np.ndarray, bound: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of asked, row of vectors, distance)``: the ``most`` nearest, none left out that is not beyond ``bound``.

    Short floats sort out: with ``s = |v|^2 / 2 - q v`` rounding moves ``s`` by less than ``slack``, so what is kept has the
    nearest; ties go to the earlier row.  A null bound is infinite.
    """
    empty = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    if not len(asked) or not len(vectors):
        return empty
    middle = vectors.mean(axis=0, dtype=np.float64)
    v, q = vectors - middle, asked - middle
    half, size = (v * v).sum(axis=1) / 2, (q * q).sum(axis=1)
    reach = np.sqrt(2 * half.max())
    long = max(reach, np.sqrt(size.max()))
    kind = np.float32 if 1e-12 < long < 1e12 else np.float64
    slack = 2 * (vectors.shape[1] + 16) * float(np.finfo(kind).eps) * (np.sqrt(size) + reach) ** 2
    v, q = np.column_stack((v, half)).astype(kind), np.column_stack((-q, np.ones(len(q)))).astype(kind)
    limit = np.where(np.isnan(bound), np.inf, (np.square(bound) - size) / 2 + slack)
    out = []
    for i in range(0, len(q), TILE[0]):
        some, lim, give = q[i : i + TILE[0]], limit[i : i + TILE[0]].copy(), slack[i : i + TILE[0]]
        held = [empty]
        for j in range(0, len(v), TILE[1]):
            s = some @ v[j : j + TILE[1]].T
            width = s.shape[1]
            free = np.flatnonzero(np.isinf(lim))
            if len(free) and width >= most:
                lim[free] = np.partition(s[free], most - 1, axis=1)[:, most - 1] + 2 * give[free]
            a, b = np.divmod(np.flatnonzero((s <= lim.astype(kind)[:, None]).ravel()), width)
            if len(a) > most * len(some):  # the most-th of the tile is a bound as well
                x, _, near = _best(a, b, s[a, b].astype(np.float64), most)
                full = np.flatnonzero(np.bincount(x, minlength=len(some)) == most)
                lim[full] = np.minimum(lim[full], near[np.searchsorted(x, full, side="right") - 1] + 2 * give[full])
                kept = s[a, b] <= lim[a]
                a, b = a[kept], b[kept]
            held.append((a, j + b, exact(asked[i : i + TILE[0]], vectors, a, j + b)))
            if sum(len(h[0]) for h in held) > 8 * most * len(some):
                held = [_best(*(np.concatenate(x) for x in zip(*held, strict=True)), most)]
        a, b, score = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), most)
        out.append((i + a, b, score))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ranked(found: DataFrame | None, queries: DataFrame, reps: DataFrame, grid: tuple[int, int], dims: int, k: int) -> DataFrame:
    """``(q, c, score)``: the ``k + 1`` nearest of the pairs found by ``_search`` and, for queries to ``scan``, of all vectors.

    A block of queries meets a block of vectors in one task and hands on its own ``k + 1`` best of every query, so nothing
    that ranks among them is lost.
    """
    kind = "<f4" if dict(reps.dtypes)["v"] == "array<float>" else "<f8"

    def placed(which: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, v = batch.column(0).to_numpy().astype("<i8"), _matrix(batch.column(1)).astype(kind)
                block = _block(ids, grid[which])
                order = np.argsort(block, kind="stable")
                starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(ids)), dtype=bool), np.diff(block[order]) != 0)))
                cuts = [order[x:y] for x, y in zip(starts, [*starts[1:], len(ids)], strict=True)] if len(ids) else []
                bound, scan = (batch.column(2).to_numpy(zero_copy_only=False).astype("<f8"), batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint8)) if not which else (np.empty(len(ids)), np.empty(len(ids), dtype=np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[order][starts])] + [pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (ids, v, bound, scan)], names=["b", "ids", "vectors", "bounds", "scans"]
                )

        return run

    schema = "b int, ids binary, vectors binary, bounds binary, scans binary"
    every = lambda which: F.explode(F.sequence(F.lit(0), F.lit(grid[which] - 1)))
    sides = queries.mapInArrow(placed(0), schema).select(F.col("b").alias("qb"), every(1).alias("cb"), F.lit(0).alias("side"), "ids", "vectors", "bounds", "scans").union(
        reps.mapInArrow(placed(1), schema).select(every(0).alias("qb"), F.col("b").alias("cb"), F.lit(1).alias("side"), "ids", "vectors", "bounds", "scans")
    )

    def block(table: pa.Table, which: int) -> list[np.ndarray]:
        own = table.take(pa.array(np.flatnonzero(table.column("side").to_numpy() == which)))
        ids, v, bound, scan = (np.frombuffer(b"".join(own.column(c).to_pylist()), dtype=t) for c, t in (("ids", "<i8"), ("vectors", kind), ("bounds", "<f8"), ("scans", np.uint8)))
        order = np.argsort(ids, kind="stable")
        return [x[order] for x in (ids, v.reshape(-1, dims), bound, scan)]

    def rank(pairs: pa.Table | None, right: pa.Table) -> pa.Table:
        (qids, asked, bound, scan), (ids, vectors, _, _) = block(right, 0), block(right, 1)
        most = k + 1 + len(ids) - len(np.unique(ids))  # an id with several vectors is as near as the nearest of them
        own = np.flatnonzero(scan)
        a, b, score = closest(asked[own], bound[own], vectors, most)
        a = own[a]
        if pairs is not None and pairs.num_rows:
            q, c = np.frombuffer(b"".join(pairs.column("pairs").to_pylist()), dtype="<i8").reshape(-1, 2).T
            at, x = _rows(qids, q)
            to, y = _rows(ids, c[at])
            x = x[to]
            x, y, near = _best(x, y, exact(asked, vectors, x, y), most)
            a, b, score = np.concatenate((a, x)), np.concatenate((b, y)), np.concatenate((score, near))
        q, c = qids[a], ids[b]
        order = np.lexsort((score, c, q))
        q, c, score = q[order], c[order], score[order]
        new = np.concatenate((np.ones(min(1, len(q)), dtype=bool), (q[1:] != q[:-1]) | (c[1:] != c[:-1])))
        q, c, score = _best(q[new], c[new], score[new], k + 1)
        return pa.table({"q": q, "c": c, "score": score})

    out = "q long, c long, score double"
    if found is None:
        near = sides.groupBy("qb", "cb").applyInArrow(lambda table: rank(None, table), out)
    else:
        near = found.groupBy("qb", "cb").cogroup(sides.groupBy("qb", "cb")).applyInArrow(rank, out)
    return _first(near, k)


def _first(near: DataFrame, k: int) -> DataFrame:
    """The ``k + 1`` nearest of every query."""
    return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "c"))).where(F.col("r") <= k + 1).select("q", "c", "score")
