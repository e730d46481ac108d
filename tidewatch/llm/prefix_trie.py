"""The trie of conversation prefixes, from sorted conversations and range minima over their common prefixes.

Conversations become sequences of 16-byte turn keys, sorted over the whole cluster.  What two neighbours have in common is
the array of longest common prefixes (LCPs), and every distinct prefix is an interval of the order.  A sorted block of
conversations finds its intervals without a stack: a sparse table answers the least LCP of any range, and every candidate
prefix, row and depth, searches its left and its right end by itself, by halving steps, all candidates at once.  In the
order of (row, depth) a subtree is one range of candidates, so sums over subtrees are differences of running sums.

Blocks know nothing of each other.  Prefixes of a block's first or last conversation may go on next door: these *open*
nodes, a few per block, are named by a hash of their turns, put together by one aggregate, and their sums run up the tree
by doubled parent pointers.  A prefix of any number of members, also one of all conversations, thus takes part as one row
a block.  Only the digest of the ids that end at one node has to read them in order; blocks hand them over as pieces of
text and one task streams the pieces of a node.  A conversation's turn keys (20 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.common import union_all
from tidewatch.llm.common import cut_lineage, only

BLOCK = 1 << 18  # turns and conversations per block
PIECE = 1000  # ids in a piece of text
BROADCAST_NODES = 200_000  # open nodes, under 100 bytes each, that may be broadcast
ROOT = bytes(16)
NOBODY = hashlib.sha256(b"").hexdigest()
CLOSED, OPEN, ENDS = 0, 1, 2
PARTS = (
    "kind int, key binary, pkey binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, size long, ends string"
)


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(id, turns)``: per conversation its turns in order, as structs of a 16-byte ``key`` of role and text and the text's ``size`` in code points.

    Turns without number come first; turns of one number follow the order of their keys.  Null roles and texts are empty,
    rows without conversation id take no part, repeated rows are repeated turns.  Other columns are ignored.
    """
    t = only(turns, id=conv_id, turn=turn, role=role, text=text).where("id is not null")
    t = t.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    key = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    t = t.select(F.col("id").cast("long").alias("id"), "turn", key.alias("key"), F.char_length("text").alias("size"))
    lists = t.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "key", "size"))).alias("all"))
    return lists.select("id", F.transform("all", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("turns"))


def grafted(convs: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their group of ``group`` ids.

    The first ``crc32(id) % (most + 1)`` turns come from there (fewer if it has fewer, none if it is absent), the rest
    are the conversation's own turns after as many.
    """
    heads = convs.where(F.col("id") % group == 0).select(F.col("id").alias("base"), F.slice("turns", 1, most).alias("head"))
    own = convs.select("id", "turns", (F.col("id") - F.col("id") % group).alias("base"), F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(most + 1)).cast("int").alias("h"))
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return own.join(heads, "base", "left").select("id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def common_prefixes(keys: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """LCP of every row with the row before it; ``keys`` of row ``i`` lie at ``first[i]``; -1 for the first row."""
    lcp = np.minimum(length[1:], length[:-1])
    row = np.repeat(np.arange(len(lcp)), lcp)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lcp) - lcp, lcp)
    differ = (keys[first[row] + at] != keys[first[row + 1] + at]).any(axis=1)
    out = lcp.copy()
    np.minimum.at(out, row[differ], at[differ])
    return np.concatenate(([-1], out))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima of every range of a power of two rows, by the logarithm of its length and its first row."""
    out = [values]
    while 2 << (len(out) - 1) <= len(values):
        half = 1 << (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def least(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range of rows, both ends included."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=table[0].dtype)
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(table[k][low[own]], table[k][high[own] - (1 << k) + 1])
    return out


def extents(table: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share ``depth`` turns with each ``row``; both ends are searched for by themselves."""
    left, right, n = row.copy(), row.copy(), len(table[0])
    for k in range(len(table) - 1, -1, -1):
        step = 1 << k
        may = np.flatnonzero(left >= step)
        left[may[table[k][left[may] - step + 1] >= depth[may]]] -= step
        may = np.flatnonzero(right + step < n)
        right[may[table[k][right[may] + 1] >= depth[may]]] += step
    return left, right


def _names(keys: np.ndarray) -> list[bytes]:
    """Name of every prefix of a sequence, the empty one first."""
    out = [ROOT]
    for k in keys:
        out.append(hashlib.md5(out[-1] + k.tobytes()).digest())
    return out


def block(ids: np.ndarray, length: np.ndarray, keys: np.ndarray, sizes: np.ndarray, piece: int = PIECE) -> pa.RecordBatch:
    """Nodes of a sorted block: whole ones, parts of open ones, and pieces of the ids that end at open ones."""
    n = len(ids)
    first = np.cumsum(length) - length
    lcp = common_prefixes(keys, first, length)
    table = sparse_table(lcp)
    new = length - lcp  # prefixes that begin at a row
    start = np.concatenate(([0], np.cumsum(new)))
    row = np.repeat(np.arange(n), new)
    depth = np.arange(len(row)) - start[row] + lcp[row] + 1
    left, right = extents(table, row, depth)
    conv = least(sparse_table(ids), left, right)
    above, _ = extents(table, row, depth - 1)
    parent = start[above] + depth - 1 - (lcp[above] + 1)
    parent[0] = -1
    is_open = (left == 0) | (right == n - 1)
    size = np.zeros(len(row), dtype=np.int64)
    size[1:] = sizes[first[row[1:]] + depth[1:] - 1]
    size[0] = 0
    whole = ~is_open
    children = np.bincount(parent[1:][whole[1:]], minlength=len(row))
    leaf = whole & (children == 0)
    saved = np.where(whole, (right - left) * size, 0)
    behind = start[right + 1]
    total = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[behind] - c[:-1]
    leaves, saved = total(leaf), total(saved)
    top = np.flatnonzero(whole)[is_open[parent[whole]]]  # an open node sums up what hangs on itself, not on open nodes below
    for x in (leaves, saved):
        x[is_open] = np.bincount(parent[top], weights=x[top], minlength=len(row))[is_open]
    names: dict[int, bytes] = {}
    for r in (n - 1, 0):
        chain = _names(keys[first[r] : first[r] + length[r]])
        mine = np.flatnonzero((left == 0) if r == 0 else (right == n - 1))
        names.update((int(c), chain[depth[c]]) for c in mine)
    # equal sequences are neighbours, with ascending ids
    heads = np.flatnonzero(new > 0)
    tails = np.append(heads[1:], n)
    ends, pieces = [NOBODY] * len(row), []
    for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
        c = int(start[a + 1]) - 1
        if is_open[c]:
            pieces += [(names[c], int(ids[k]), ",".join(map(str, ids[k : min(b, k + piece)].tolist()))) for k in range(a, b, piece)]
        else:
            ends[c] = hashlib.sha256(",".join(map(str, ids[a:b].tolist())).encode()).hexdigest()
    count = len(row)
    up = [names.get(p) for p in parent.tolist()]
    fill = lambda x, t: pa.concat_arrays([pa.array(x, t), pa.nulls(len(pieces), t)])
    kinds = np.concatenate((np.where(is_open, OPEN, CLOSED), np.full(len(pieces), ENDS)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(kinds, pa.int32()),
            pa.array([names.get(c) for c in range(count)] + [p[0] for p in pieces], pa.binary()),
            fill(up, pa.binary()),
            pa.array(np.concatenate((conv, np.array([p[1] for p in pieces], dtype=np.int64))), pa.int64()),
            fill(depth, pa.int64()), fill(conv[parent], pa.int64()), fill(right - left + 1, pa.int64()), fill(children, pa.int64()),
            fill(leaves, pa.int64()), fill(saved, pa.int64()), fill(size, pa.int64()),
            pa.array(ends + [p[2] for p in pieces], pa.string()),
        ],
        names=[x.split()[0] for x in PARTS.split(", ")],
    )


def _blocks(most: int, piece: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        whole = lambda: block(*(np.concatenate(x) for x in zip(*held, strict=True)), piece)
        for batch in batches:
            at = 0
            ids, keys, sizes = batch.columns
            lengths = np.diff(keys.offsets.to_numpy()).astype(np.int64)
            while at < batch.num_rows:
                room = int(np.searchsorted(np.cumsum(lengths[at:] + 1), most - weight, side="right"))
                if not room and held:
                    yield whole()
                    held, weight = [], 0
                    continue
                to = at + max(room, 1)
                flat = np.frombuffer(b"".join(keys.slice(at, to - at).flatten().to_pylist()), dtype="<u8").reshape(-1, 2)
                held.append((ids.slice(at, to - at).to_numpy(), lengths[at:to], flat, sizes.slice(at, to - at).flatten().to_numpy().astype(np.int64)))
                weight += int(lengths[at:to].sum()) + to - at
                at = to
        if held:
            yield whole()

    return run


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the pieces of every node, which come together and in order."""
    key, digest = None, None
    row = lambda: pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [digest.hexdigest()]})
    for batch in batches:
        for k, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    yield row()
                key, digest = k, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
    if digest is not None:
        yield row()


def _subtree_sums(nodes: DataFrame, hint) -> DataFrame:
    """``(key, n_leaves, saved_tokens)`` of open nodes ``(key, pkey, n_leaves, saved_tokens)``, summed over their subtrees.

    Each round adds the sums of the nodes 1, 2, 4 … steps below and doubles the reach, so the rounds grow with the logarithm
    of the depth.
    """
    now = nodes.select("key", F.col("pkey").alias("up"), "n_leaves", "saved_tokens")
    while not now.where("up is not null").isEmpty():
        below = now.where("up is not null").groupBy("up").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).withColumnRenamed("up", "key")
        over = now.where("up is not null").select(F.col("key").alias("up"), F.col("up").alias("next"))
        now = now.join(below, "key", "left").join(hint(over), "up", "left")
        now = cut_lineage(now.select("key", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")))
    return now.drop("up")


def nodes(convs: DataFrame, block_turns: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """One row per distinct prefix of the conversations ``(id, turns)``, ids distinct: the nodes of their trie.

    ``conv_id`` smallest member, ``depth`` turns (0 for the root), ``parent_conv_id`` the parent's ``conv_id`` (root: null),
    ``n_convs`` members, ``n_children``, ``n_leaves`` childless nodes of the subtree (itself included), ``saved_tokens`` code
    points of last turns that the subtree's members need not repeat, ``ends_sha256`` of the ids that end at the node.
    Conversations without turns are members of the root; an empty table has no nodes.  ``block_turns`` bounds what a task
    holds at once, ``piece`` the ids in a row of text; neither changes the result.
    """
    split = convs.select("id", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))
    ordered = split.repartitionByRange("keys", "id").sortWithinPartitions("keys", "id")
    parts = cut_lineage(ordered.mapInArrow(_blocks(block_turns, piece), PARTS))
    part = parts.where(F.col("kind") == OPEN)
    total = lambda *cs: [F.sum(c).alias(c) for c in cs]
    merged = part.groupBy("key").agg(
        F.min("pkey").alias("pkey"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("size").alias("size"),
        *total("n_convs", "n_children", "n_leaves", "saved_tokens"),
    )
    merged = cut_lineage(merged)
    hint = F.broadcast if merged.count() <= BROADCAST_NODES else lambda df: df
    kids = merged.where("pkey is not null").groupBy(F.col("pkey").alias("key")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
    own = merged.select(
        "key", "pkey", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    sums = _subtree_sums(own, hint)
    pieces = parts.where(F.col("kind") == ENDS).repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends")
    digests = pieces.mapInArrow(_digests, "key binary, ends string")
    parents = merged.select(F.col("key").alias("pkey"), F.col("conv_id").alias("above"))
    shape = ["conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    opened = merged.drop("n_leaves", "saved_tokens").join(sums, "key").join(digests, "key", "left").join(hint(parents), "pkey", "left").withColumn("ends", F.coalesce("ends", F.lit(NOBODY)))
    closed = parts.where(F.col("kind") == CLOSED)
    under = closed.where("pkey is not null").join(hint(parents), "pkey")
    inside = closed.where("pkey is null").withColumn("above", F.col("parent_conv_id"))
    return union_all([x.select(*shape) for x in (opened, under, inside)])
