"""TF-IDF over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.common import attach, quoted

# Fixed value: a token is a run of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def words(text: str) -> Column:
    """All tokens of a text, lower case, in order."""
    return F.regexp_extract_all(F.lower(quoted(text)), F.lit(TOKEN), F.lit(0))


def vocabulary(df: DataFrame, text: str, max_terms: int = 100) -> DataFrame:
    """The ``max_terms`` most frequent terms: ``(term, total)``.

    Occurrences are counted inside each task before the shuffle, so even a term
    that is in every document travels as one row per task.
    """
    found = df.select(F.explode(words(text)).alias("term"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "term").limit(max_terms)


def tfidf(df: DataFrame, doc_id: str, text: str, max_terms: int = 100) -> DataFrame:
    """Sparse TF-IDF ``(doc_id, term, weight)`` over the ``max_terms`` most frequent terms.

    ``idf = ln((1 + n) / (1 + df)) + 1`` and rows of length 1; one input row
    per document.  The vocabulary (at most ``max_terms`` rows) is the only
    thing that is broadcast, and only its terms reach the per-document shuffle.
    """
    kept = F.broadcast(vocabulary(df, text, max_terms).select("term"))
    occurrences = df.select(quoted(doc_id).alias(doc_id), F.explode(words(text)).alias("term")).join(kept, "term")
    counted = occurrences.groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))
    in_docs = F.broadcast(counted.groupBy("term").agg(F.count(F.lit(1)).alias("docs")))  # at most max_terms rows
    size = df.filter(quoted(text).isNotNull()).agg(F.count(F.lit(1)).alias("__docs"))
    weighted = attach(counted.join(in_docs, "term"), size, []).withColumn(
        "raw", F.col("tf") * (F.ln((F.col("__docs") + 1) / (F.col("docs") + 1)) + 1)
    )
    by_doc = Window.partitionBy(doc_id)  # at most max_terms rows each
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(by_doc))
    return weighted.select(doc_id, "term", (F.col("raw") / norm).alias("weight"))


def first_term_weight(df: DataFrame, doc_id: str, text: str, max_terms: int = 100) -> DataFrame:
    """The scalar feature: weight of the alphabetically first kept term, 0 where a document lacks it."""
    weights = tfidf(df, doc_id, text, max_terms)
    first = weights.agg(F.min("term").alias("__first"))
    chosen = attach(weights, first, []).filter(F.col("term") == F.col("__first")).select(doc_id, "weight")
    docs = df.filter(quoted(text).isNotNull()).select(doc_id)
    return docs.join(chosen, doc_id, "left").select(doc_id, F.coalesce("weight", F.lit(0.0)).alias("feature"))
