"""The trie of conversation prefixes against a plain one."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import prefix_trie
from tidewatch.llm.queries import ORACLES, QUERIES


def rebuilt(rows):
    """Rebuilt conversations of ``(conv_id, turn, role, text)``; turns of one number must not differ."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = [*own.get(c - c % 100, [])[:h], *turns[h:]]
    return out


def plain(convs):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def result(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_extents_are_those_of_a_scan():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 17, 64, 100):
        values = np.concatenate(([-1], rng.integers(0, 4, n - 1)))
        row, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(5)))
        left, right = prefix_trie.extents(prefix_trie.sparse_table(values), row, depth)
        for i, d, a, b in zip(row, depth, left, right, strict=True):
            x = y = i
            while x > 0 and values[x] >= d:
                x -= 1
            while y + 1 < n and values[y + 1] >= d:
                y += 1
            assert (a, b) == (x, y)
        low = rng.integers(0, n, 50)
        high = np.minimum(low + rng.integers(0, n, 50), n - 1)
        assert prefix_trie.least(prefix_trie.sparse_table(values), low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]


def test_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_prefix_trie"](spark, data_dir)) == plain(rebuilt(rows))


def test_query_against_sql(spark, data_dir):
    from compare import connect, difference

    assert difference(QUERIES["op12_prefix_trie"](spark, data_dir), connect(data_dir), ORACLES["op12_prefix_trie"]) is None


@pytest.mark.parametrize("size", [1, 7, 60, 1 << 18])
def test_blocks_of_any_size(spark, size):
    """Copies, shared starts, long chains and turnless conversations over many small blocks."""
    rng = random.Random(size)
    convs = {}
    for c in range(400):
        kind = rng.random()
        if kind < 0.3:
            convs[c * 7] = [("user", "one"), ("assistant", "two"), ("user", "thrée")]
        elif kind < 0.35:
            convs[c * 7] = []
        elif kind < 0.4:
            convs[c * 7] = [("user", f"t{i}") for i in range(rng.choice([20, 45, 45]))]
        else:
            convs[c * 7] = [("user" if i % 2 else "system", rng.choice("abc")) for i in range(rng.randrange(7))]
    rows = [(c, [(hashlib.md5(repr(t).encode()).digest(), len(t[1])) for t in turns]) for c, turns in convs.items()]
    df = spark.createDataFrame(rows, "id long, turns array<struct<key: binary, size: int>>").repartition(5)
    assert result(prefix_trie.nodes(df, block_turns=size, piece=3)) == plain(convs)


def test_odd(spark):
    rows = [
        (0, 1, "user", "hi"), (0, 0, None, "system"), (0, None, "first", None), (5, 3, "user", "x"), (5, 3, "user", "x"), (7, 0, "user", "x" * 50_000),
        (100, 0, "user", "hi"), (101, 0, "user", "hi"), (205, 1, "", ""), (206, None, None, None), (None, 0, "user", "lost"), (207, 2, "user", None),
        *[(300 + i, j, "user", f"turn {j}") for i in range(12) for j in range(3)],
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit(0).alias(c) for c in ("id", "key", "pkey", "keys", "kind", "ends", "size", "turns", "base", "h", "numbered")])
    got = prefix_trie.nodes(prefix_trie.grafted(prefix_trie.conversations(df)))
    assert result(got) == plain(rebuilt(rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    none = prefix_trie.nodes(prefix_trie.grafted(prefix_trie.conversations(df.limit(0))))
    assert none.count() == 0
