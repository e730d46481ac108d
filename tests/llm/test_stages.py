"""The pipeline's stages on odd rows: clashing columns, repeated ids, empty tables."""

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, language, line_dedup, near_dedup

A = " ".join(f"alpha{i}" for i in range(30))
B = " ".join(f"beta{i}" for i in range(30))
ROWS = [(1, A), (2, A), (2, B), (3, B + " tail"), (3, B + " tail"), (4, None), (5, ""), (None, A), (None, None), (6, " \n"), (7, "one two"), (8, A + "\n" + "own line with more than eight words in it here")]
CLASH = ("id", "__id", "n_removed", "n_lines", "clean_text", "rest", "key_id", "key_a", "KEY_B", "doc_key", "c1", "component", "starts", "__row", "n.dots", "n`tick")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(str(i)).alias(c) for i, c in enumerate(CLASH)], F.length("text").cast("long").alias("n_chars"))


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def same(df, docs):
    assert df.columns == docs.columns
    want = {c: str(i) for i, c in enumerate(CLASH)}
    for r in df.collect():
        assert {c: v for c, v in r.asDict().items() if c in want} == want
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_keep_one_goes_by_content(docs):
    out = near_dedup.keep_one(docs)
    same(out, docs)
    assert rows(out) == sorted([(1, A), (2, B), (4, None), (5, ""), (None, A), (None, None), (6, " \n"), (7, "one two"), (8, ROWS[-1][1])], key=repr)


def test_lines(docs):
    out = line_dedup.without_repeats(docs.where("doc_id is null or doc_id <> 2 or text is null or text like 'alpha%'"))
    same(out, docs)
    want = [(1, A), (3, B + " tail"), (3, B + " tail"), (4, None), (5, ""), (None, A), (None, None), (6, " \n"), (7, "one two"), (8, ROWS[-1][1].split("\n")[1])]
    assert rows(out) == sorted(want, key=repr)


def test_decontamination(docs, spark):
    out = decontamination.decontaminate(docs, spark.createDataFrame([(1, B), (2, None)], "item_id long, text string"))
    same(out, docs)
    assert rows(out) == sorted([r for r in ROWS if r[0] not in (2, 3)], key=repr)
    assert decontamination.decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(ROWS)


def test_language_judges_rows_alone(spark, docs, data_dir):
    model = language.fit(language.training_rows(spark.read.parquet(f"{data_dir}/documents.parquet")))
    out = language.identified(docs, model)
    same(out, docs)
    judged = {(r.doc_id, r.lang_pred != "und" and r.score >= 0.4) for r in language.predict(docs, model).collect()}
    assert all((r.doc_id, True) in judged for r in out.collect())
    assert out.where("text is null or trim(text) = ''").isEmpty() and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, B)], "item_id long, text string")
    model = language.fit(none.withColumn("lang", F.lit("en")))
    for out in (near_dedup.keep_one(none), line_dedup.without_repeats(none), decontamination.decontaminate(none, bench), language.identified(none, model)):
        assert out.columns == docs.columns and out.count() == 0


def test_texts_are_moved_once_by_the_lines_stage(docs):
    plan = line_dedup.without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("BroadcastHashJoin") <= 2
