"""Postings of a query's terms without those of all other words."""

from pyspark.sql import functions as F

from siltstone import plans
from siltstone.operators import retrieval

TEXTS = ["Gold band-gap", "band gap of GOLD, gold", "band-gap gold-", "marigold band", "gold gap\x1cband", "the gold", "Kelvin gold", "", None, "gold\ngap\tband", "golden gap", "égoldé band"]


def test_terms_of_a_query_are_met_as_in_all_postings(spark):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, "gold"])), "i long, t string").unionByName(spark.createDataFrame([(None, "gold"), (1, "gap")], "i long, t string"))
    for query in ("the gold band gap gold", "band-gap gold- kelvin", "-gold", "the of", ""):
        terms = [r[0] for r in retrieval.postings(spark.createDataFrame([(0, query)], "i long, t string"), "i", "t", unicode=False).select("term").collect()]
        want = retrieval.postings(docs, "i", "t", unicode=False).where(F.col("term").isin(terms))
        got = retrieval.postings_of(docs, "i", "t", query)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), query


def test_the_search_reads_texts_once_and_cuts_none_into_words(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, t in enumerate(["worthless license", "erst while", "none"])], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = plans.QUERIES["retrieval_idf"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "documents.parquet" not in plan and "text#" not in plan
    assert {r["doc_id"]: r["score"] for r in out.collect()} == {0: round(3 * 1.0986122886681098, 6), 1: round(1.0986122886681098, 6)}
