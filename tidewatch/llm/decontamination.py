"""Benchmark items inside documents: size-partitioned MinHash containment search, DataFrame functions only.

Test items are partitioned by the size of their shingle sets.  An item of a partition with at most ``q`` shingles is
sketched by its ``floor((1 - t) * q) + 1`` smallest shingle hashes: a document that holds a share ``t`` of the item's
shingles misses at most ``floor((1 - t) * q)`` of them, so it holds one of the sketch for certain, however long it is.
Documents probe the sketches with all their shingles; the pairs that meet are verified on the exact shingle texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, only, renamed, without

SHINGLE = 5
PERCENT = 80
BROADCAST_ROWS = 500_000  # sketch rows of 16 bytes that may be broadcast; beyond that the join shuffles

# Fixed value: a word is a run of letters and digits, compared in lower case.
WORD = r"[\p{L}\p{N}]+"


def shingles(text: Column, hashed: bool) -> Column:
    """All shingles of a text as an array, hashed or as texts; a shorter text is one shingle, a wordless one has none."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        one = (lambda i: F.xxhash64(F.slice(w, i, SHINGLE))) if hashed else (lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
        return F.transform(at, one)

    # the words are bound to a variable, else the optimizer would split the text again for every shingle
    return F.element_at(F.transform(F.array(words), runs), 1)


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """``(token, item)``: the smallest hashes of every item, their number given by the item's size partition."""
    sized = items.select("item", F.array_distinct(shingles(F.col("text"), hashed=True)).alias("s")).where(F.size("s") > 0)
    most = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("s").cast("double"))))
    many = F.floor(most * F.lit(100 - percent) / F.lit(100)).cast("int") + F.lit(1)
    return sized.select("item", F.explode(F.slice(F.array_sort("s"), F.lit(1), many)).alias("token"))


def contained(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``(doc_id, item_id, item_shingles, found, containment)`` for every item of which a document holds ``percent`` or more.

    Shingles are five words (letters and digits, lower case); a text of fewer words is one shingle, so a very short item is
    found only in a document of the same words.  Null, empty and wordless texts, rows without id, and items without words
    match nothing.  Repeated documents or items with one id and one text give one row.  Other columns are ignored.
    """
    corpus = only(docs, doc=doc_id, text=text).where("doc is not null")
    items = only(benchmark, item=item_id, text=text).where("item is not null").distinct()
    tokens = sketches(items, percent)
    if tokens.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        tokens = F.broadcast(tokens)
    probes = corpus.select("doc", F.explode(shingles(F.col("text"), hashed=True)).alias("token"))
    meets = probes.join(tokens, "token").select("doc", "item").distinct()
    wanted = items.select("item", F.array_distinct(shingles(F.col("text"), hashed=False)).alias("s"))
    both = meets.join(wanted, "item").join(corpus, "doc")
    counted = both.select("doc", "item", F.size("s").cast("long").alias("n"), F.size(F.array_intersect("s", shingles(F.col("text"), hashed=False))).cast("long").alias("found"))
    return (
        counted.where(F.col("found") * 100 >= F.col("n") * percent).groupBy("doc", "item").agg(F.max("n").alias("n"), F.max("found").alias("found"))
        .select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("n").alias("item_shingles"), "found", F.round(F.col("found") / F.col("n"), 6).alias("containment"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that hold no benchmark item; columns stay, under any name.

    Rows without id stay, as do null, empty and wordless texts; of rows repeated with one id all go if one holds an item.  An
    empty benchmark takes nothing, an empty table gives an empty result.
    """
    own = f"c{docs.columns.index('doc_id')}"
    return renamed(without(numbered(docs), contained(docs, benchmark, percent=percent).select(F.col("doc_id").alias(own)), [own]), docs)
