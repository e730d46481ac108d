"""The text operators against plain versions, and their defined results on odd rows."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import decontamination, language, line_dedup, near_dedup, nearest, packing, pii, substring_dedup, token_files, toxicity
from tidewatch.llm.components import components
from tidewatch.llm.queries import ORACLES, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PASSAGE = " ".join(f"Shared{i}" for i in range(40))
ROWS = [
    (1, PASSAGE + "\nown line one two three four five six seven eight", "en"),
    (2, PASSAGE + "\nown line one two three four five six seven eight", "en"),
    (2, PASSAGE + "\nown line one two three four five six seven eight", "en"),
    (3, "other words before " + PASSAGE + " and after", "en"),
    (4, None, None), (5, "", "en"), (6, "  \n\t ", None), (7, "one two", "en"), (8, "ONE two", "de"),
    (9, LONG, "en"), (10, LONG + " tail", "en"), (None, PASSAGE, "en"), (None, None, None),
    (11, "same line again and again and here now\n" * 4, "fr"), (12, "a@b.example tel +1 (499) 555-6503 at 8.8.8.8 or 1.2.3.4.5 card 4111 1111 1111 1111", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    df = spark.createDataFrame(ROWS, schema)
    # columns that clash with internal names
    return df.select("doc_id", "text", "lang", *[F.lit(0).alias(c) for c in ("id", "n", "sig", "path", "starts", "key", "block", "part", "u", "component", "token", "item")])


@pytest.fixture(scope="module")
def docs(spark, data_dir):
    return spark.read.parquet(f"{data_dir}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def groups(pairs, percent):
    sets, parent = {}, {}
    for d, t in pairs:
        w = words(lowered(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        parent[d] = d

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverse = collections.defaultdict(list)
    for d in sorted(sets):
        common = collections.Counter(e for s in sets[d] for e in inverse[s])
        for e, k in common.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[e]) - k):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            inverse[s].append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, plain, percent):
    want = groups(plain, percent)
    for r in near_dedup.near_duplicates(docs, percent=percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_large_group(spark):
    """More near copies than a leaf holds, and as many texts that only share a passage with them."""
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i * 3], f"changed{i}", *base[i * 3 + 1 :]])) for i in range(60)]
    rows += [(100 + i, " ".join([*base[:60], *[f"o{i}_{j}" for j in range(40)]])) for i in range(60)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == {d: root for d, (_, root) in groups(rows, 85).items()}


def test_near_duplicates_large_nodes_are_whole(spark, monkeypatch):
    """Hundreds of texts just under the threshold to each other, among them pairs just over it, and blocks smaller than the group."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1 << 16)
    rows = []
    for i in range(17 * 17):  # two texts change the same place at most once; pairs have the word there in common too
        x, y = divmod(i, 17)
        own = [f"b{k}" for k in range(17 * 5 * 6)]
        for j in range(5):
            own[6 * (17 * j + (x * j + y) % 17) + 2] = f"own{i}_{j}" if j else f"own{x // 2}_{y}"
        rows.append((i, " ".join(own)))
    want = {d: root for d, (_, root) in groups(rows, 85).items()}
    assert len(set(want.values())) == 17 * 17 - 17 * 8
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect()}
    assert got == want


def test_near_duplicates_odd(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1 and not by[2].kept and by[10].component_id == 9
    assert by[8].component_id == 7 and by[7].n_shingles == 1
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[5].kept
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (12, 2), (12, 9)], "u long, v long")
    assert {r.u: r.component for r in components(links).collect()} == {3: 2, 4: 2, 5: 2, 8: 2, 9: 2, 12: 2}


def removed(pairs, size=13):
    first, out = {}, {}
    for d, t in pairs:
        w = words(t)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    for d, t in pairs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(docs, plain):
    want = removed(plain)
    for r in substring_dedup.remove_repeats(docs).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_substring_dedup_odd(odd):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == len(ROWS)
    want = removed(sorted({(d, t) for d, t, _ in ROWS if d is not None and t is not None}))
    for r in got:
        if r.doc_id in want:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        else:
            assert r.n_removed == 0


def clean_lines(pairs, least=8):
    def windows(t):
        lines = [(i, x) for i, x in enumerate(t.split("\n")) if words(x)]
        for a in range(len(lines)):
            count, b = 0, a
            while b < len(lines) and count < least:
                count += len(words(lines[b][1]))
                b += 1
            if count >= least:
                yield a, [i for i, _ in lines[a:b]], tuple(x.strip(" \t\n\v\f\r") for _, x in lines[a:b])

    first, out = {}, {}
    for d, t in pairs:
        for a, _, key in windows(t):
            first.setdefault(key, (d, a))
    for d, t in pairs:
        cut = {i for a, at, key in windows(t) if first[key] < (d, a) for i in at}
        parts = t.split("\n")
        out[d] = (len(cut), "".join(x + ("\n" if i < len(parts) - 1 else "") for i, x in enumerate(parts) if i not in cut))
    return out


def test_line_dedup(docs, plain):
    want = clean_lines(plain)
    for r in line_dedup.dedup_lines(docs).collect():
        assert (r.n_removed, r.clean_text) == want[r.doc_id]


def test_line_dedup_odd(odd):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == len(ROWS)
    want = clean_lines(sorted({(d, t) for d, t, _ in ROWS if d is not None and t is not None}))
    for r in got:
        if r.doc_id in want:
            assert (r.n_removed, r.clean_text) == want[r.doc_id]
    kept = line_dedup.without_repeats(odd.withColumn("n_chars", F.lit(0)).drop("starts"))
    assert kept.columns[-1] == "n_chars" and kept.count() < len(ROWS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a0123456789.@+-() %_é\n", max_size=60))
def test_pii_base_kinds(text):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    want = []
    for rank, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            want.append((m.start(), rank, kind, m.end()))
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == [(k, a, b) for a, _, k, b in sorted(want)]


def test_pii_added_kinds():
    text = "see https://a.example/x, IBAN DE89370400440532013000 at 12 High Street; token = \"0123456789abcdef\""
    assert [k for k, _, _ in pii.find(text)] == ["url", "account", "address", "secret"]
    assert pii.masked("mail a@b.cd now") == "mail <email> now" and pii.masked(None) is None


def test_pii_odd(odd):
    got = pii.spans(odd).collect()
    assert len(got) == len(ROWS)
    row = next(r for r in got if r.doc_id == 12)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 2, 1, 1)
    assert next(r for r in got if r.doc_id == 4).spans == ""


def test_decontamination(docs, data_dir, spark):
    from compare import connect, difference

    found = decontamination.contained(docs, spark.read.parquet(f"{data_dir}/benchmark.parquet"))
    assert difference(found, connect(data_dir), ORACLES["op8_decontamination"]) is None
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_decontamination_sketch_misses_nothing(spark):
    item = [f"t{i}" for i in range(44)]
    texts = [" ".join([*item[:k], "x", *item[k + 1 :]]) for k in range(0, 44, 3)] + [" ".join(item[:36]), " ".join(item[:35])]
    found = decontamination.contained(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    )
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = {i for i, t in enumerate(texts) if len(shingles(t.split()) & shingles(item)) * 100 >= 80 * len(shingles(item))}
    assert {r.doc_id for r in found.collect()} == want


def test_decontamination_odd(odd, spark):
    bench = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, None), (3, ""), (4, "one TWO"), (None, "x")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontamination.contained(odd, bench).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (7, 4), (8, 4)]
    assert decontamination.decontaminate(odd, bench).count() == len(ROWS) - 6


def test_packing(odd):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(odd, path).collect()
    want = collections.Counter((d, len(t.encode(x or "").ids) + 1) for d, x, _ in ROWS)
    assert collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    ids = np.array([*t.encode(LONG).ids, 0], dtype="<u4")
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 9)
    here = 0
    for start, length, crc in pieces:
        assert start == here and crc == zlib.crc32(ids[start : start + length].tobytes())
        here += length
    assert here == len(ids)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == list(np.cumsum([0] + [n for _, n in s[:-1]])) and sum(n for _, n in s) <= 1024


@pytest.mark.parametrize("ids", ["sparse", "hashed", "none"])
def test_packing_fills_sequences_of_any_ids(spark, ids):
    """Short documents share sequences however their ids lie, and ids follow the order."""
    make = {"sparse": lambda i: i * 4096, "hashed": lambda i: zlib.crc32(str(i).encode()) << 31 if i % 2 else -(zlib.crc32(str(i).encode()) << 31), "none": lambda i: None}[ids]
    rows = [(make(i), "one short text of a few words" if ids == "none" else f"one short text of a few words, number {i}") for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer("byte_bpe_50k.json")).collect()
    assert sum(r.start == 0 for r in got) == len(rows)
    tokens = sum(r.length for r in got)
    assert len({r.sequence_id for r in got}) <= tokens / 1024 * 1.2 + 16
    assert collections.Counter(r.doc_id for r in got if r.start == 0) == collections.Counter(d for d, _ in rows)
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.doc_id is not None]
    assert order == sorted(order)


def test_window_cuts_are_best():
    """Against all plans of the documented kind over the same places."""
    rng = np.random.default_rng(1)
    limit = 64
    for _ in range(30):
        ends = np.unique(rng.integers(1, 200, 12))
        costs = np.append(rng.choice([0, packing.SENTENCE_COST], len(ends) - 1), 0)
        penalty = dict(zip(ends.tolist(), costs.tolist(), strict=True))
        cuts = packing.window_cuts(ends, costs, limit)
        assert cuts[-1] == ends[-1] and all(0 < b - a <= limit for a, b in zip([0, *cuts], cuts, strict=False))

        def price(plan):
            out = 0
            for a, b in zip([0, *plan], plan, strict=False):
                n = b - a
                free = n & (n - 1) == 0 and (n >= 64 or b == ends[-1])
                out += packing.WINDOW_COST + (0 if free else limit - n) + penalty.get(b, packing.TRUNCATION_COST)
            return out

        best = {0: 0}
        for b in range(1, int(ends[-1]) + 1):
            for a in list(best):
                n = b - a
                # a window ends at a place, or is full and starts at a place, or has no place within reach
                may = b in penalty or (n == limit and (a == 0 or a in penalty or not any(a < x <= b for x in penalty)))
                if 0 < n <= limit and may:
                    free = n & (n - 1) == 0 and (n >= 64 or b == ends[-1])
                    value = best[a] + packing.WINDOW_COST + (0 if free else limit - n) + penalty.get(b, packing.TRUNCATION_COST)
                    best[b] = min(value, best.get(b, value))
        assert price(cuts) == best[int(ends[-1])]


def test_token_files(odd, spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    files = token_files.write(odd, f"file://{tmp_path}/ids", path, keeps_space=False, end_id=2)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(files).collect()), key=lambda r: r[2])
    assert len(got) == len(ROWS) and [g[:2] for g in got] == sorted(g[:2] for g in got)
    here = 0
    for known, doc, start, n, crc in got:
        assert start == here
        here += n
        if known:
            text = next(x for d, x, _ in ROWS if d == doc)
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert (n, crc) == (len(ids), zlib.crc32(ids.tobytes()))
    reader = token_files.Reader(files.orderBy("part").first().file)
    base = np.frombuffer(reader.source.read_buffer() if reader.source.seek(0) is not None else b"", dtype=np.uint8)
    view = reader.sequence(len(reader) - 1)
    assert len(view) == token_files.LENGTH and np.shares_memory(view, reader.sequence(len(reader) - 1)) and len(base)
    assert token_files.read(token_files.write(odd.limit(0), f"file://{tmp_path}/none", path, False, 2)).count() == 0


def test_language(docs, odd):
    model = language.fit(language.training_rows(docs))
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    held = [r for r in docs.select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("c")).collect() if r.c % 4 == 2 and r.lang]
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)
    got = language.predict(odd, model).collect()
    assert len(got) == len(ROWS) and {r.doc_id for r in got if r.lang_pred == "und"} == {4, 5, 6, None}
    assert {r.doc_id for r in language.identified(odd, model).select("doc_id").collect()} >= {1, 2, 3, 7, 9}
    assert {r.lang_pred for r in language.predict(odd, language.fit(odd.limit(0))).collect()} == {"und"}


def test_language_mixture():
    names = 3
    rng = np.random.default_rng(2)
    ll = np.full((200, names), -30.0, dtype=np.float32) + rng.normal(size=(200, names)).astype(np.float32)
    ll[:150, 0] += 20
    ll[150:, 2] += 20
    share = language.mixture(ll, np.array([0, 200, 200]))
    assert abs(share[0, 0] - 0.75) < 0.02 and share[0, 1] < 1e-6 and not share[1].any()


def test_toxicity_grammar():
    weights = lambda ws: [2.0 if w == "idiot" else 0.0 for w in ws]
    value = lambda s: toxicity.clause_output(s.split(), weights(s.split()))
    assert value("you idiot") > value("an idiot") > value("not an idiot") > 0
    assert value("he said you idiot") < value("you idiot") and value("nice day") == 0
    assert value("kill you") > value("kill time")


def test_toxicity(docs, odd, spark):
    rows = [(i, f"some plain text number {i} with words of all kinds " + ("you grobian here. utter grobian" if i % 5 == 0 else "and peace"), int(i % 5 == 0)) for i in range(400)]
    table = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert all((got[d] >= 0.7) == bool(y) for d, _, y in rows)
    assert toxicity.score(odd, model).count() == len(ROWS)
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).where("score >= 0.7").count() == 0


def test_nearest(spark, data_dir):
    df = spark.read.parquet(f"{data_dir}/embeddings.parquet")
    rows = df.collect()
    x = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}
    ids = np.array(sorted(x))
    m = np.array([x[i] for i in ids])
    got = collections.defaultdict(list)
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hit = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        d = np.sqrt(((m - x[q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]])
        hit, total = hit + len(want & {r.vec_id for r in got[q]}), total + 10
        assert all(abs(r.score - np.sqrt(((x[r.vec_id] - x[q]) ** 2).sum())) < 1e-12 for r in got[q])
    assert hit >= 0.9 * total


def test_nearest_recall_does_not_fall_with_the_table(spark):
    """Many vectors without any structure, of which the first radius holds a small share."""
    x = np.random.default_rng(4).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nearest.nearest(df, every=400).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, len(x), 400):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d)[:10].tolist()) & got[q])
    assert len(got) == 50 and hit >= 0.99 * 500, hit


def test_nearest_ranks_few_pairs(spark, monkeypatch):
    """Vectors without any structure, whose radii hold a tenth of all codes, are not ranked pair by pair."""
    x = np.random.default_rng(4).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    ranked, pairs = nearest._ranked, []

    def counted(found, *rest):
        pairs.append(0 if found is None else found.agg(F.sum(F.length("pairs"))).first()[0] or 0)
        return ranked(found, *rest)

    monkeypatch.setattr(nearest, "_ranked", counted)
    assert nearest.nearest(df, every=400).count() == 500
    assert sum(pairs) / 16 <= 2 * 50 * nearest.WANTED, pairs


def test_nearest_probes_what_is_close(spark, monkeypatch):
    """Clusters are found by the index alone if comparing with all vectors costs too much, with copies, sparse ids and short floats."""
    monkeypatch.setattr(nearest, "SCAN", 1e9)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(100, 32)), 60, axis=0)
    x = (x + rng.normal(size=x.shape) * 0.02).astype(np.float32)
    x[1] = x[0]
    ids = np.arange(len(x)) * 1_000_003 + 7
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    ranked, scans = nearest._ranked, []

    def counted(found, queries, *rest):
        scans.append(queries.where("scan").count())
        return ranked(found, queries, *rest)

    monkeypatch.setattr(nearest, "_ranked", counted)
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, every=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    asked = np.flatnonzero(ids % 7 == 0)
    hit = 0
    for q in asked:
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        near = np.lexsort((ids, d))[:10]
        hit += len({int(i) for i in ids[near]} & {r.vec_id for r in got[int(ids[q])]})
        assert all(r.score == d[(r.vec_id - 7) // 1_000_003] for r in got[int(ids[q])])
    assert sum(scans) == 0 and len(got) == len(asked) and hit >= 0.99 * 10 * len(asked), (scans, hit)


def test_nearest_repeated_ids(spark):
    """An id with several vectors is one result, as far away as the nearest of its vectors."""
    x = np.random.default_rng(9).normal(size=(900, 6))
    ids = np.arange(900) % 800
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    df = df.union(df.limit(50))
    got = collections.defaultdict(list)
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 12)))
    for q in range(0, 800, 100):
        d = np.min([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in x[ids == q]], axis=0)
        best = sorted((min(d[ids == i]), i) for i in range(800) if i != q)[:10]
        assert got[q] == [(n, i, round(s, 12)) for n, (s, i) in enumerate(best, 1)]


def test_nearest_plans():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4096, 64))
    x[:400] = x[0] + rng.normal(size=(400, 64)) * 0.01
    sample = nearest.encode(x, nearest.learn(x))
    plan = nearest.Planner(sample, 4_000_000, 64)
    assert plan.worth(sample[1000], 20, 1)  # few codes are so near
    assert not plan.worth(sample[1000], 105, 6)  # nearly all cells would be met
    assert not plan.worth(sample[0], 60, 3)  # a tenth of all vectors lies inside
    assert not plan.first(sample[0])[1] or plan.first(sample[0])[0] < 60
    assert nearest._grid(6154, 615_384, 64) == (1, 33)  # a vector is sent once, a query to every block


@pytest.mark.parametrize("kind", ["random", "far from zero", "ties", "few", "huge", "tiny", "copies"])
def test_nearest_in_a_block(kind, monkeypatch):
    """Short floats only sort out: the same rows and distances as in double precision, also where rounding is coarse."""
    monkeypatch.setattr(nearest, "TILE", (16, 256))
    rng = np.random.default_rng(8)
    x = {
        "random": lambda: rng.normal(size=(1500, 64)).astype(np.float32), "far from zero": lambda: 1e4 + rng.normal(size=(1500, 16)) * 1e-3,
        "ties": lambda: rng.integers(0, 3, size=(1500, 6)).astype(np.float32), "few": lambda: rng.normal(size=(5, 8)),
        "huge": lambda: rng.normal(size=(1500, 8)) * 1e30, "tiny": lambda: rng.normal(size=(1500, 8)) * 1e-30, "copies": lambda: np.ones((1500, 4)),
    }[kind]()
    asked = x[::41]
    want = []
    for i, q in enumerate(asked.astype(float)):
        d = np.sqrt(((x.astype(float) - q) ** 2).sum(axis=1))
        want += [(i, j, d[j]) for j in np.lexsort((np.arange(len(x)), d))[:11].tolist()]
    bounds = np.array([max(d for a, _, d in want if a == i) for i in range(len(asked))])
    for bound in (np.full(len(asked), np.nan), bounds):
        a, b, score = nearest.closest(asked, bound, x, 11)
        assert list(zip(a.tolist(), b.tolist(), score.tolist(), strict=True)) == want


def test_nearest_odd(spark):
    v = [float(i) for i in range(1, 9)]
    rows = [(i, v) for i in range(0, 300)] + [(1000, [x + 1 for x in v]), (1001, None), (1002, [0.0] * 8), (1003, [1.0, None] * 4), (1004, [float("nan")] * 8), (1005, [1.0]), (None, v), (0, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id) for r in nearest.nearest(df).collect()]
    assert sorted(x for x in got if x[0] == 0) == [(0, i, i) for i in range(1, 11)]
    assert sorted(x[2] for x in got if x[0] == 100) == list(range(10)) and len([x for x in got if x[0] == 1000]) == 10
    assert nearest.nearest(df.limit(0)).count() == 0


def test_empty_tables(odd):
    none = odd.limit(0)
    assert near_dedup.near_duplicates(none).count() == substring_dedup.remove_repeats(none).count() == line_dedup.dedup_lines(none).count() == 0
    assert pii.spans(none).count() == packing.pack(none, tokenizer("byte_bpe_50k.json")).count() == 0


def test_pipeline_stages(spark, data_dir, docs, plain):
    import corpus_pipeline

    now, ids = docs, {d for d, _ in plain}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in now.select("doc_id", "text").collect()}
        out = stage(spark, now, data_dir)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        assert set(after) <= set(before) <= ids
        if name == "lines":
            want = clean_lines(sorted(before.items()))
            assert all(after[d] == want[d][1] for d in after) and all(not want[d][1].strip() for d in set(before) - set(after))
        if name == "near_duplicates":
            assert set(after) == {d for d, (_, root) in groups(sorted(before.items()), 80).items() if root == d}
        now = spark.createDataFrame(out.collect(), out.schema)
