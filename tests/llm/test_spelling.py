"""Spelling variants against a plain version."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import spelling
from tidewatch.llm.queries import ORACLES, QUERIES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    out = collections.Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def near_of(words):
    """By patterns: a replacement leaves a hole, a deletion a word."""
    holes = collections.defaultdict(set)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain(words):
    near = near_of(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def result(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abé", min_size=4, max_size=6), min_size=1, max_size=40), st.integers(4, 5))
def test_sorted_list_finds_all(words, m):
    words = sorted(w for w in words if m <= len(w) <= m + 1)
    if not words:
        return
    codes = np.zeros((len(words), m + 2), dtype=np.uint8)
    for i, w in enumerate(words):
        codes[i, : len(w)] = list(w.encode("latin-1"))
    border = np.arange(len(words)) == 0
    q, t = spelling.one_edit(codes, np.array([len(w) for w in words]), border, m, most=3)
    got = sorted(zip(q.tolist(), t.tolist(), strict=True))
    assert got == [(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if len(u) == m and one_apart(u, v)]


def test_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(counted(rows))
    assert result(QUERIES["op13_spelling"](spark, data_dir)) == want and any(form for _, form, *_ in want)


def test_query_against_sql(spark, data_dir):
    from compare import connect, difference

    assert difference(QUERIES["op13_spelling"](spark, data_dir), connect(data_dir), ORACLES["op13_spelling"]) is None


@pytest.mark.parametrize("limit", [1, 5, 4096])
def test_groups_of_any_size(spark, monkeypatch, limit):
    """Dense words, repeated letters and long ones; with a small limit every group is cut to its end."""
    monkeypatch.setattr(spelling, "LIMIT", limit)
    rng = random.Random(limit)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 60) for _ in range(500)}
    words |= {"a" * k: 3 * k for k in range(5, 12)}
    long = "".join(rng.choice("abcdef") for _ in range(3000))
    words |= {long: 100, long[:1000] + "z" + long[1001:]: 20, long + "q": 7, long[1:] + "q": 4}
    assert result(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == plain(words)


def test_odd(spark):
    rows = [
        (1, "Receive receive RECEIVE recieve"), (2, None), (3, ""), (4, " 12 \n"), (5, "receive receves receives Étés étés×"), (5, "receive receives"), (5, "receive receives"),
        (None, "receive receiver receiver receiver"), (None, None), (6, "x" * 200_000), (7, "word " * 50_000), (8, "words " * 9), (9, "swords swords swords"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.select("*", *[F.lit(0).alias(c) for c in ("id", "word", "n", "m", "a", "b", "pre", "suf", "near", "k", "form", "root")])
    assert result(spelling.variants(spelling.vocabulary(df))) == plain(counted(rows))
    assert spelling.variants(spelling.vocabulary(df.limit(0))).count() == 0


def test_pieces_end_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "one twothree  fourfivesixé seven" * 5
    assert [w for p in spelling._pieces(text) for w in RUN.findall(p)] == RUN.findall(text) and "".join(spelling._pieces(text)) == text
