"""SimHash groups and the Golay code against plain versions."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import golay, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    hashes = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest id reachable, for every id of ``prints`` (id to fingerprint)."""
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for d in sorted(prints):
        first.setdefault(prints[d], d)
        parent[d] = first[prints[d]]
    for (f, d), (g, e) in itertools.combinations(first.items(), 2):
        if (f ^ g).bit_count() <= 2:
            a, b = root(d), root(e)
            parent[max(a, b)] = min(a, b)
    return {d: root(d) for d in prints}


def test_code_is_perfect():
    """Every remainder has one error of weight three or less, and values two bits apart share a codeword nearby."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 1 << golay.BITS, 400)
    words = values ^ golay._NEAR[golay.remainders(values), 0]
    assert not golay.remainders(words).any() and max(int(x).bit_count() for x in words ^ values) == 3
    assert sorted(set(golay._COUNT.tolist())) == [1, golay.MOST]

    def near(v):
        return set(golay.nearby(np.array([v]))[1].tolist())

    for v in values[:40].tolist():
        own = near(v)
        assert all(own & near(v ^ 1 << i ^ 1 << j) for i, j in itertools.combinations_with_replacement(range(golay.BITS), 2))


def test_linked_fingerprints_share_a_key():
    rng = random.Random(5)
    for _ in range(300):
        f = rng.getrandbits(64)
        g = f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        row, key = simhash.keys(np.array([f, g], dtype=np.uint64))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_simhash(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    prints = {r.doc_id: fingerprint(r.text) for r in docs.select("doc_id", "text").collect()}
    want = components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", want[d]) for d, f in prints.items()}
    assert len(got) == len(prints) and len(set(want.values())) < len(prints)


@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_links_in_crowded_keys(spark, monkeypatch, leaf):
    """Fingerprints within a few bits of each other, with chains, beside scattered ones: larger keys lose no link."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(leaf)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(400):
        f = rng.choice([centre, rng.choice(sorted(prints))])
        for _ in range(rng.choice([1, 2, 3, 5])):
            f ^= 1 << rng.randrange(64)
        prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1}
    ids = dict(enumerate(sorted(prints, key=lambda f: f * 7919 % 65537)))
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in ids.items()]
    from tidewatch.llm.components import components as joined

    labels = {r.u: r.component for r in joined(simhash.links(spark.createDataFrame(signed, "id long, fp long"))).collect()}
    want = components(ids)
    assert {d: labels.get(d, d) for d in ids} == want and 1 < len(set(want.values())) < len(ids)


def test_simhash_odd(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [
        (1, "One two\tthree  four"), (2, "one TWO three four"), (2, "one TWO three four"), (3, None), (4, ""), (5, " \n\t"), (6, "one two"),
        (7, long), (8, long), (None, "one two three four"), (None, None), (9, "Ä b c"), (10, "ä b c"), (11, "one two three"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("doc_id", "text", *[F.lit(0).alias(c) for c in ("id", "fp", "key", "k", "point", "hub", "component", "u", "v")])
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    known = {d: fingerprint(t) for d, t in rows if d is not None}
    want = components(known)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.fingerprint, r.component_id) == (f"{known[r.doc_id]:016x}", want[r.doc_id])
    assert want[2] == 1 and want[4] == want[5] == 3 and want[8] == 7 and known[9] != known[10]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
