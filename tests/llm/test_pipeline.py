import pytest
from pyspark.sql import functions as F

pytest.importorskip("pagewright.llm")
from pagewright.llm import common  # noqa: E402

pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() >= sizes[-1]


def test_stages_of_odd_rows_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.orderBy("doc_id").where("length(text) > 200").first()["text"]
    odd = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (None, text, "en", None, 9), (-3, "long text here " * 20_000, "en", "s", 300_000), (-4, text, None, "s", 9), (-4, text, None, "s", 9)]
    docs = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumns({"_lang": F.lit(1), "size": F.lit("x"), "times": F.lit(2)})
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        before, columns = docs, docs.columns
        docs = pipeline.saved(stage(spark, docs, SF), "odd")
        if name != "packing":
            assert docs.columns == columns
            known = lambda d: {(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()}
            assert known(docs) <= known(before)
        if name == "language ID":
            ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert not ids & {-1, -2} and None in ids and docs.where("doc_id = -4").count() == 2
        if name == "SimHash near-dedup":
            # of the copies the least id stays with its repeated row, and the row without an id
            assert {r["doc_id"] for r in docs.where(F.col("text") == text).collect()} == {-4, None} and docs.where("doc_id = -4").count() == 2
    totals = docs.groupBy("doc_id").agg(F.sum("length").alias("ids"), F.max("doc_tokens").alias("one")).collect()
    assert totals and all(r["ids"] % r["one"] == 0 for r in totals)


def test_batches_end_with_the_run(spark, monkeypatch):
    option = common.BATCH_OPTION
    seen = []
    monkeypatch.setattr(pipeline, "STAGES", [("a", lambda s, d, sf: (common.short_batches(s), seen.append(s.conf.get(option)), d)[2])])
    spark.conf.unset(option)
    pipeline.run(spark, SF)
    assert seen == ["1000"] and option not in spark.conf.getAll
    spark.conf.set(option, "10000")
    pipeline.run(spark, SF)
    assert seen[1] == spark.conf.get(option) == "10000"
    spark.conf.unset(option)
