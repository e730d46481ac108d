"""The runnable queries of the text operators, over whole tables, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, language, line_dedup, near_dedup, nearest, packing, pii, prefix_trie, simhash, spelling, substring_dedup, token_files, toxicity
from tidewatch.llm.common import held, table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from labelled rows that are not held out."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (held("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op2_near_duplicates")
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents with a shingle similarity of 0.85 or more."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), percent=85)


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of lines, and what stays of every text."""
    return line_dedup.dedup_lines(documents(spark, sf_dir))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to Arrow stream files and read back."""
    files = token_files.write(documents(spark, sf_dir), token_files.new_folder(spark), tokenizer("word_bpe_49k.json"), keeps_space=False, end_id=2)
    return token_files.read(files)


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from rows that are not held out."""
    docs = documents(spark, sf_dir)
    found = language.predict(docs, language.fit(language.training_rows(docs)))
    return found.select("doc_id", (held("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.spans(documents(spark, sf_dir))


@query(
    "op8_decontamination",
    r"""
    WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
           FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
    items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
    bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
           FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
    sizes AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
    SELECT doc_id, item_id, n AS item_shingles, count(*) AS found, round(count(*) / n, 6) AS containment
    FROM ds JOIN bs USING (s) JOIN sizes USING (item_id)
    GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80
    """,
)
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return decontamination.contained(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 13-word passages that a document with a smaller id has as well."""
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept_text")


@query("op10_nearest")
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and groups of those at most two bits apart."""
    return simhash.near_duplicates(documents(spark, sf_dir))


# DuckDB has no crc32: the bytes of the id go through the polynomial bit by bit
@query(
    "op12_prefix_trie",
    """
    WITH own AS (SELECT conv_id AS c, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS t
                 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    crc AS (SELECT c, t, xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT), lambda a, x:
                list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)), 4294967295) % 6 AS h FROM own),
    convs AS (SELECT k.c, list_transform(coalesce(b.t, [])[1:k.h] || k.t[k.h + 1:], lambda x: md5(length(x[1]) || ':' || x[1] || x[2])) AS p,
                     list_transform(coalesce(b.t, [])[1:k.h] || k.t[k.h + 1:], lambda x: length(x[2])) AS s
              FROM crc k LEFT JOIN own b ON b.c = k.c - k.c % 100),
    steps AS (SELECT c, p, s, unnest(range(0, len(p) + 1)) AS d FROM convs),
    members AS (SELECT p[1:d] AS prefix, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN s[d] ELSE 0 END) AS size,
                       sha256(coalesce(string_agg(CASE WHEN d = len(p) THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
                FROM steps GROUP BY p[1:d], d),
    kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM members WHERE depth > 0 GROUP BY prefix[1:depth - 1]),
    full_nodes AS (SELECT m.*, coalesce(k.n, 0) AS n_children FROM members m LEFT JOIN kids k ON k.prefix = m.prefix),
    sums AS (SELECT prefix[1:d] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
             FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY prefix[1:d])
    SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM full_nodes n JOIN sums s ON s.prefix = n.prefix LEFT JOIN full_nodes u ON n.depth > 0 AND u.prefix = n.prefix[1:n.depth - 1]
    """,
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    turns = prefix_trie.conversations(table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(prefix_trie.grafted(turns))


# DuckDB has no crc32: its table of 256 values comes first; of the letters, those over U+00BF have two bytes, 195 and the code less 64
@query(
    "op13_spelling",
    r"""
    WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END) AS c FROM range(256) r(i))),
    found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
    runs AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM found GROUP BY ALL),
    hashed AS (SELECT w, k, xor(list_reduce([4294967295::UBIGINT] || flatten(list_transform(string_split(doc_id || ':' || w, ''),
                   lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [195::UBIGINT, (unicode(x) - 64)::UBIGINT] END)),
                   lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255)::BIGINT + 1])), 4294967295)::BIGINT AS h FROM runs, crc),
    slips AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM hashed),
    vocab AS (SELECT word, sum(k)::BIGINT AS n FROM slips WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
    cuts AS (SELECT word, n, word[:i] AS front, word[i + 2:] AS back FROM (SELECT *, unnest(range(0, length(word))) AS i FROM vocab)),
    pairs AS (SELECT a.word, b.word AS near, b.n AS k FROM cuts a JOIN cuts b ON a.front = b.front AND a.back = b.back AND a.word <> b.word
              UNION SELECT c.word, v.word, v.n FROM cuts c JOIN vocab v ON v.word = c.front || c.back
              UNION SELECT v.word, c.word, c.n FROM cuts c JOIN vocab v ON v.word = c.front || c.back),
    best AS (SELECT word, count(*) AS n_near, arg_min(near, (-k, near)) AS near, max(k) AS k FROM pairs GROUP BY word),
    forms AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.k >= 2 * v.n THEN b.near END AS form, CASE WHEN b.k >= 2 * v.n THEN b.k END AS form_n
              FROM vocab v LEFT JOIN best b USING (word)),
    steps AS (SELECT word, word AS root FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL),
    ends AS (SELECT s.word, s.root FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
    """,
)
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return spelling.variants(spelling.vocabulary(documents(spark, sf_dir)))
