"""Queries over whole tables against brute force; their SQL, where there is one, reads a part of them."""

import re

import numpy as np
import pytest

from siltstone import plans
from siltstone.functions import fixed
from siltstone.operators import runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet").toPandas() for n in ("part", "lineitem", "documents", "benchmark")}


def got(spark, name, key):
    return {r[key]: r for r in plans.QUERIES[name](spark, SF).collect()}


def test_claims_meet_all_line_items(spark, tables):
    part = tables["part"]
    items = tables["lineitem"].merge(part[["p_partkey", "p_brand"]], left_on="l_partkey", right_on="p_partkey")
    item, value, unit = (items.l_orderkey * 10 + items.l_linenumber).to_numpy(), (items.l_extendedprice / items.l_quantity).to_numpy(), items.p_brand.to_numpy()
    first, status, brands = got(spark, "claim_band_join", "claim"), got(spark, "claim_status", "claim"), {}
    assert len(first) == len(status) == len(part)
    for claim, brand, lo in zip(part.p_partkey, part.p_brand, part.p_retailprice, strict=True):
        hi, mine = lo * 1.05, unit == brand
        within = mine & (value >= lo * 0.9) & (value <= hi * 1.1)
        assert (first[claim]["n_match"], first[claim]["item"]) == (within.sum(), item[within].min() if within.any() else -1)
        n, mid = (mine & (value >= lo * 0.85) & (value <= hi * (1 + 0.15))).sum(), (lo + hi) / 2
        far = mine.any() and (abs(value[mine] - mid) / mid).min() > 0.5
        want = "verified" if n >= 2 else "partial" if n == 1 else "contradicted" if far else "unverified"
        assert (status[claim]["n_match"], status[claim]["status"]) == (n, want)
        brands.setdefault(brand, []).append(want in ("verified", "partial"))
    roll = got(spark, "claim_roll_up", "unit")
    assert {u: (r["n_claims"], r["n_unverified"]) for u, r in roll.items()} == {u: (len(x), len(x) - sum(x)) for u, x in brands.items()}
    assert all(abs(roll[u]["share"] - np.mean(x)) <= 0.0051 for u, x in brands.items())


def test_priors_of_all_parts(spark, tables):
    part, rows = tables["part"], got(spark, "literature_prior", "p_partkey")
    assert set(rows) == set(part.p_partkey)
    for key, brand, x in zip(part.p_partkey, part.p_brand, part.p_retailprice, strict=True):
        known = part.p_retailprice[(part.p_brand == brand) & (part.p_partkey != key)].to_numpy()
        if not len(known):
            assert rows[key]["prior"] == 0 and rows[key]["nearest"] is None
            continue
        mid = np.median(known)
        kept = known[(known >= mid * 0.02) & (known <= mid * 50)]
        kept = kept if len(kept) else known
        relative = abs(x - kept) / kept
        assert rows[key]["prior"] == pytest.approx(min(0.6 / (1 + relative.min()) + 0.4 * (relative <= 0.25).mean(), 1), abs=2e-6)
        assert rows[key]["nearest"] == pytest.approx((abs(x - known) / known).min(), abs=2e-6)


def test_priors_guard_outliers(spark):
    values = [10.0, 10.0, 12.0, 1000.0, 0.1, 11.0, -3.0, None]
    rows = spark.createDataFrame([(i, "g", v) for i, v in enumerate(values)] + [(9, "one", 5.0)], "id long, g string, v double")
    out = {r["id"]: r for r in runs.prior_among_others(rows, "g", "v").collect()}
    assert out[9]["prior"] == out[6]["prior"] == out[7]["prior"] == 0 and out[9]["nearest"] is None
    for i, v in enumerate(values[:6]):
        known = np.array([x for j, x in enumerate(values[:6]) if j != i])
        kept = known[(known >= np.median(known) * 0.02) & (known <= np.median(known) * 50)]
        assert out[i]["prior"] == pytest.approx(min(0.6 / (1 + (abs(v - kept) / kept).min()) + 0.4 * (abs(v - kept) / kept <= 0.25).mean(), 1))
        assert out[i]["nearest"] == pytest.approx((abs(v - known) / known).min())


def test_names_of_all_passages(spark, tables):
    words = lambda x: {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s-]", " ", (x or "").lower())) if len(w) > 2 and w not in fixed.STOPWORDS}
    names, marks, want = set().union(*map(words, tables["benchmark"].text)), {"license", "idiot", "scum", "token", "trash"}, {}
    for text in tables["documents"].text:
        w = words(text)
        if w & marks:
            for n in w & names:
                want.setdefault(n, set()).update(w & marks)
    assert {n: set(r["words"]) for n, r in got(spark, "paragraph_cooccurrence", "name").items()} == want


def test_whole_texts(spark, tables):
    docs, passages = tables["documents"], tables["benchmark"]
    distinct = got(spark, "ordered_distinct", "doc_id")
    assert {i: r["n"] for i, r in distinct.items()} == {i: len({w for w in x.split(" ") if w}) for i, x in zip(docs.doc_id, docs.text, strict=True)}
    grams = {i: {x[k : k + 3] for k in range(len(x) - 2)} for i, x in zip(passages.item_id, passages.text, strict=True)}
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in grams for b in grams if a < b}
    pairs = {(r["a"], r["b"]): r["similarity"] for r in plans.QUERIES["trigram_similarity"](spark, SF).collect()}
    assert pairs == {k: pytest.approx(s, abs=1e-6) for k, s in want.items() if s >= 0.2}
    numbered = docs.sort_values("doc_id").groupby("lang").cumcount() + 1
    assert {i: r["label"] for i, r in got(spark, "positional_labels", "doc_id").items()} == {docs.doc_id[k]: f"SPR-{docs.lang[k]}-{n:02d}" for k, n in numbered.items()}
