"""The pipeline, stage by stage, on the smallest tables."""

import re

import corpus_pipeline
from siltstone.llm import bpe
from siltstone.llm.common import materialise, release

SF = "/root/testdata/sf0.001"


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash", "mixing", "bpe"]
    toxic = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns and after.count() <= before.count(), name
        seen[name] = {r["doc_id"]: r["text"] for r in after.collect()}
        before = after
    good = [i for i, r in toxic.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert all(toxic[i]["quality"] == 1 for i in seen["quality_rules"] if i in toxic)
    exact = {}
    for i, t in seen["quality_rules"].items():
        exact.setdefault(squeezed(t), []).append((-len(t), i))
    assert set(seen["exact_dedup"]) == {min(v)[1] for v in exact.values()}
    assert set(seen["simhash"]) <= set(seen["exact_dedup"])
    lost = set(seen["simhash"]) - set(seen["mixing"])
    assert not lost & set(good)
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in final} == set(seen["mixing"])
    v = bpe.load_vocabulary(bpe.public_vocabulary())
    import numpy as np

    for r in final[:20]:
        assert bpe.decode(v, np.array(r["ids"])).decode() == seen["mixing"][r["doc_id"]]


def test_odd_rows(spark):
    """Nulls in any column, an empty table, rows that repeat an id, extra columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = docs.selectExpr("*", "1 as kept", "'x' as node", "2 as _id")
    odd = odd.union(odd.limit(3)).union(odd.limit(2).selectExpr("cast(null as bigint)", "text", "cast(null as string)", "cast(null as string)", "cast(null as int)", "1", "'x'", "2"))
    odd = odd.union(odd.limit(1).selectExpr("-1", "cast(null as string)", "lang", "source", "n_chars", "1", "'x'", "2"))
    for rows in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = materialise(stage(spark, rows, SF), name)
            release()
            assert rows.columns == odd.columns, name
        assert rows.where("text is null").count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
