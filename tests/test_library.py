"""Operators of the library on literal fixtures and published numbers."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import expressions, scores, text
from siltstone.operators import claims, graph, quality, resampling, resolve, retrieval, search_space, stats, symbolic, windows
from siltstone.plans import discovery
from siltstone.sources import readers, writers


def value(spark, column, **inputs):
    frame = spark.range(1)
    for k, v in inputs.items():
        frame = frame.withColumn(k, v if isinstance(v, type(F.lit(1))) else F.lit(v))
    return frame.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw,doi", [("10.1000/abc.123", "10.1000/abc.123"), ("https://doi.org/10.1000/abc.123", "10.1000/abc.123"), ("DOI: 10.1000/ABC", "10.1000/abc"), ("  10.1/a.; ", "10.1/a"), ("", None), (None, None), ("  ", None)])
def test_doi(spark, raw, doi):
    assert value(spark, text.normalize_doi(F.lit(raw).cast("string"))) == doi


def test_text(spark):
    assert value(spark, text.normalize_title(F.lit("Test 测试 Title"))) == "test  title"
    assert value(spark, text.normalize_title(F.lit("Hello, World! How's it?"))) == "hello world hows it"
    j = lambda a, b: value(spark, text.jaccard(text.ngrams(F.lit(a)), text.ngrams(F.lit(b))))
    assert j("abcd", "abcd") == 1.0 and j("ab", "ab") == 0.0 and j("thermally stable under moisture", "thermally stable under heat") > 0.5
    assert [value(spark, text.unit_b(F.lit(u))) for u in ("mmol / g", "eV", "kj mol⁻¹", "mAh/g", "", "% RH")] == ["mmol/g", "ev", "kj/mol", "mah/g", "", "%"]
    assert value(spark, text.unit_a(F.lit("% RH"))) == "% rh"
    assert value(spark, text.tokenize(F.lit("The band-gap of MAPbI3 is 1.6 eV"))) == ["band-gap", "mapbi3"]
    assert value(spark, text.query_terms(F.lit('"band gap" of a perovskite in x air'))) == ["band gap", "perovskite", "air"]
    assert value(spark, text.accepted_units(F.lit("Band gap"))) == ["ev"] and value(spark, text.accepted_units(F.lit("ZT"))) == ["dimensionless"] and value(spark, text.accepted_units(F.lit("x"))) is None
    assert value(spark, text.unit_from_header(F.lit("T (K)"))) == "K" and value(spark, text.unit_from_header(F.lit("P / bar"))) == "bar" and value(spark, text.unit_from_header(F.lit("x"))) is None
    assert value(spark, text.unit_range(F.lit("eV")))["hi"] == 50.0
    assert value(spark, text.parsed_json(F.lit('x ```json\n{"a": 1}\n``` y')).isNotNull()) and value(spark, text.parsed_json(F.lit("no"))) is None
    assert [tuple(m) for m in value(spark, text.find_all(F.lit("a1é22b"), r"(\d)(\d)?", 2))] == [(1, "1", "1", ""), (3, "22", "2", "2")]
    assert value(spark, text.material_keys(F.lit("Mg-MOF (74)"))) == ["mgmof74", "mgmof"]
    assert value(spark, text.to_base_unit(F.lit(25.0), F.lit("°c"))) == 298.15


def test_scores(spark):
    s = lambda x: value(spark, scores.stretch(F.lit(x).cast("double")))
    assert [s(None), s(0.0), s(0.3), s(1.0), s(2.0)] == [0.02, 0.02, pytest.approx(0.22), 1.0, 1.0]
    t = lambda v: value(spark, scores.trapezoid(F.lit(v), F.lit(25.0), F.lit(40.0)))
    assert [t(32.0), t(17.5), t(60.0)] == [1.0, 0.0, 0.0] and t(20.0) == pytest.approx(1 - 5 / 7.5)
    p = lambda v, k: value(spark, scores.literature_prior(F.lit(v), F.array(*map(F.lit, k))))
    assert p(4.5, [4.5]) == 1.0 and p(0.0, [4.5]) == 0.0 and p(100.0, [4.5]) < 0.2
    assert value(spark, scores.quadrant(F.lit(0.5), F.lit(0.49))) == "underexplored"
    assert value(spark, scores.harmonic([(F.lit(0.5), F.lit(1.0)), (F.lit(0.0), F.lit(1.0))])) == 0.5
    assert 0.1 <= value(spark, scores.empty_evidence(F.lit("[('a', 1)]"))) <= 0.22
    assert value(spark, scores.type_weights(F.lit("gap_link_1")))["cooccurrence"] == 0.45


def test_expressions(spark):
    assert value(spark, expressions.compile_expression("2*x^2 - 1/(x-x) + sqrt(abs(-4))", {"x": F.lit(3.0)})) == pytest.approx(19.0)
    assert expressions.simplified("0 + x*1 + 2*3") == "x + 6"
    for bad in ("__import__('os')", "x.y", "open(x)", "lambda: 1"):
        with pytest.raises((ValueError, SyntaxError)):
            expressions.compile_expression(bad, {"x": F.lit(1.0)})


POINTS = list(zip([0, 0.14, 0.5, 0.86, 1], [5.03, 6.4, 8.3, 3.62, 3.99], strict=True))


def test_published_fits(spark):
    p = spark.createDataFrame([("a", float(a), float(b)) for a, b in POINTS], "g string, x double, y double")
    line = stats.ols(p, ["g"], "x", "y").first()
    assert (round(line["slope"], 3), round(line["intercept"], 3), round(line["r2"], 4), round(line["rmse"], 4)) == (-2.003, 6.470, 0.2075, 1.5254)
    curve = stats.polynomial(p, ["g"], "x", "y", 2).first()
    assert (round(curve["c2"], 3), round(curve["c1"], 3), round(curve["c0"], 3), round(curve["r2"], 4), round(curve["rmse"], 4)) == (-13.799, 11.796, 5.115, 0.7694, 0.8229)
    peak = resampling.gaussian_peak(p, "g", "x", "y").first()
    assert round(peak["r2"], 3) >= 0.977
    f = ((1.525383**2 - 0.8229**2) * 5) / (0.8229**2 * 5 / 2)
    assert abs(f - 4.872) < 0.01 and abs(stats.f_tail(4.872, 1, 2) - 0.1580) < 1e-4 and abs(stats.t_two_sided(5.456, 3) - 0.01209) < 1e-4
    end = stats.endpoint_line(p, ["g"], "x", "y").first()
    assert round(end["r2"], 4) == -0.1530
    ranked = {r["model"]: r["rank"] for r in stats.rank_models(p, ["g"], "x", "y").collect()}
    assert ranked["cubic"] == 1 and ranked["quadratic"] == 2
    b = resampling.bootstrap(p, "g", "x", "y", n_boot=100).first()
    assert b["n_ok"] >= 50 and b["slope_low"] <= line["slope"] <= b["slope_high"]
    d = stats.cooks_distance(p, ["g"], "x", "y").collect()
    assert len(d) == 5 and abs(sum(r["leverage"] for r in d) - 2) < 1e-9
    loo = stats.leave_one_out(p, ["g"], "x", "y").first()
    x, y = np.array(POINTS).T
    errors = [y[i] - np.polyval(np.polyfit(np.delete(x, i), np.delete(y, i), 1), x[i]) for i in range(5)]
    assert loo["loo_rmse"] == pytest.approx(math.sqrt(np.mean(np.square(errors))))
    flat = spark.createDataFrame([("f", 1.0, 2.0), ("f", 1.0, 2.0)], "g string, x double, y double")
    assert stats.polynomial(flat, ["g"], "x", "y", 2).first()["c0"] is None and stats.polynomial(flat, ["g"], "x", "y", 3).count() == 1


def test_slack_and_symbolic(spark):
    t = np.linspace(100, 800, 40)
    e = 2.5 - 2.3 * 8.617333262e-5 * 300 * (1 / np.tanh(300 / (2 * t)) - 1)
    rows = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(t, e, strict=True)], "g string, t double, e double")
    fit = resampling.slack_grid(rows, "g", "t", "e", [100.0, 200.0, 300.0, 400.0]).first()
    assert fit["theta"] == 300.0 and fit["e0"] == pytest.approx(2.5, rel=0.01) and fit["s"] == pytest.approx(2.3, rel=0.05)
    pts = spark.createDataFrame([("a", float(v), 3.0 * v + 1) for v in range(1, 9)], "g string, x double, y double")
    best = symbolic.symbolic_regression(pts, "g", "x", "y", seeds=2, generations=5, size=20).first()
    assert best["r2"] > 0.999 and value(spark, expressions.compile_expression(best["expression"], {"x": F.lit(2.0)})) == pytest.approx(7.0, abs=0.1)


def test_claims(spark):
    evidence = spark.createDataFrame([("e1", "mmol/g", 4.2), ("e2", "mmol/g", 4.5)], "item string, unit string, value double")
    c = spark.createDataFrame([("a", "mmol/g", 3.0, 5.0), ("b", "mmol/g", 30.0, 40.0), ("c", "kj/mol", 3.0, 5.0), ("d", "mmol/g", 3.7, 3.7)], "claim string, unit string, lo double, hi double")
    assert {r["claim"]: r["status"] for r in claims.claim_status(c, evidence).collect()} == {"a": "verified", "b": "contradicted", "c": "unverified", "d": "partial"}
    hyps = spark.createDataFrame([(1, "capacity 3-5 mmol/g", 0.8), (2, "capacity 30-40 mmol/g", 0.8), (3, "none", 0.8)], "id long, text string, confidence double")
    docs = spark.createDataFrame([(7, "reached 4.2 mmol/g here, showed 4.5 mmol/g there")], "id long, text string")
    got = {r["id"]: (r["share"], r["confidence"]) for r in discovery.verify_hypotheses(hyps, docs).collect()}
    assert got == {1: (1.0, 0.8), 2: (0.0, 0.6), 3: (1.0, 0.8)}


def test_dedupe_order(spark):
    rows = [(1, "A study of band gaps in lead halides", "10.1/a"), (2, "A study of band gaps in lead halides!", None), (3, "Other words entirely here", None), (4, "A study of band gaps in lead halides", "10.1/b"), (5, "other words entirely here", ""), (6, "x", "https://doi.org/10.1/A")]
    got = {r["id"]: r["into"] for r in resolve.dedupe_papers(spark.createDataFrame(rows, "ord long, title string, doi string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 6: 1}


def test_graph_and_windows(spark):
    e = spark.createDataFrame([("a", "mof74"), ("b", "mgmof74"), ("b", "co2"), ("c", "co2"), ("a", "h2"), ("c", "h2")], "topic string, entity string")
    links = {(r["group_a"], r["group_b"], r["key"]) for r in graph.containment_links(e, "topic", "entity").collect()}
    assert links == {("a", "b", "mof74"), ("b", "c", "co2"), ("a", "c", "h2")}
    ev = spark.createDataFrame([("a", "mof74", f"p{i}") for i in range(5)], "topic string, entity string, item string")
    assert discovery.link_topics(e, ev).first()["strength"] == "high"
    log = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.1, 0.3, 0.2, 0.3])], "k long, i long, s double")
    assert [r["best"] for r in windows.running_best(log, ["k"], [F.col("i")], "s").orderBy("i").collect()] == [0.1, 0.3, 0.3, 0.3]
    assert quality.stalled(log, ["k"], "s").first()["stalled"] is False
    assert quality.sentinels(spark.createDataFrame([("ok",), ("score None",), ("{'a': 1}",)], "t string"), "t").count() == 2
    top = retrieval.search(retrieval.postings(spark.createDataFrame([(1, "zeolite water"), (2, "zeolite")], "id long, t string"), "id", "t"), "water zeolite zeolite").orderBy(F.col("raw").desc()).collect()
    assert [(r["doc"], r["raw"]) for r in top] == [(1, 3.0), (2, 2.0)]


def test_search(spark):
    log = search_space.bayesian_search(lambda v: -((v[0] - 0.3) ** 2), [(0.0, 1.0)], 1, iterations=8)
    best = [r["best_score"] for r in log]
    assert best == sorted(best) and best[-1] > -0.01 and len(log) == 18
    kept = search_space.bayesian_search(lambda v: float(v[0]), [(0.0, 1.0)], 1, iterations=5, pruned=[(0, 0.5, 1.0)])
    assert max(r["score"] for r in kept[10:]) <= 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "f.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>https://arxiv.org/abs/2401.00001v1</id><title>T1\n x</title><summary>s</summary><author><name>A B</name></author><author><name>C</name></author><published>2024-01-02T00:00:00Z</published><link href="http://x/p.pdf" title="pdf" rel="related"/></entry><entry><id>u2</id><title>T2</title><published>2023-01-02</published></entry></feed>')
    rows = readers.atom_entries(spark, str(tmp_path / "f.xml")).orderBy("title").collect()
    assert [(r["title"], r["year"], r["pdf_url"]) for r in rows] == [("T1 x", 2024, "http://x/p.pdf"), ("T2", 2023, None)]
    (tmp_path / "r.json").write_text(json.dumps({"results": [{"Title": "a", "DOI": "doi:10.1/X", "citationCount": 3}, {"x": 1}, {"title": "b", "year": "2020"}]}))
    got = {r["title"]: r for r in readers.search_response(spark, str(tmp_path / "r.json")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["doi"] == "10.1/x" and got["a"]["citation_count"] == 3 and got["b"]["year"] == 2020
    (tmp_path / "h.json").write_text(json.dumps({"hypotheses": [{"id": "h1", "confidence": 0.4}, {"id": "h2"}]}))
    (tmp_path / "search_h1.json").write_text(json.dumps({"best_score": 0.7, "search_method": "bayesian", "iteration_log": [{"iteration": 1, "score": 0.7, "best_score": 0.7}]}))
    rep = readers.report(readers.hypotheses(spark, str(tmp_path / "h.json")), readers.search_scores(spark, str(tmp_path / "search_h*.json"))).orderBy("pos").collect()
    assert [(r["id"], r["best_score"]) for r in rep] == [("h1", None), ("h2", 0.7)]
    (tmp_path / "b.bib").write_text("@article{k1,\n title = {A {B} c},\n doi = {10.2/Z},\n year = {2019}\n}\n@misc{k2,\n title = {D},\n}\n")
    assert [(r["key"], r["title"], r["doi"], r["year"]) for r in readers.bibliography(spark, str(tmp_path / "b.bib")).orderBy("key").collect()] == [("k1", "A B c", "10.2/z", 2019), ("k2", "D", None, None)]
    frame = spark.createDataFrame([("q", {"query": "x", "api_key": "abc"})], "id string, p map<string,string>")
    writers.append_log(frame, str(tmp_path / "log"))
    writers.append_log(frame, str(tmp_path / "log"))
    back = readers.log(spark, str(tmp_path / "log"), "id string, p map<string,string>").collect()
    assert len(back) == 2 and back[0]["p"]["api_key"] == "***"
    assert readers.documents(spark, str(tmp_path), "*.bib").count() == 1
    old = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, None)], "k long, best_score double")
    assert sorted((r["k"], r["best_score"]) for r in writers.backfill(old, spark.createDataFrame([(1, 0.9), (3, 0.8), (2, 0.1)], "k long, best_score double"), "k").collect()) == [(1, 0.9), (2, 0.5), (3, 0.8)]


def test_recorded_source(spark, tmp_path):
    from siltstone.sources.recorded import RecordedSearch

    for k in range(3):
        (tmp_path / f"{k}.json").write_text(json.dumps({"results": [{"title": f"t{k}", "year": 2018 + k}, {"year": 1}]}))
    (tmp_path / "broken.json").write_text("{")
    spark.dataSource.register(RecordedSearch)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    assert [r["title"] for r in spark.read.format("recorded_search").option("path", str(tmp_path)).load().where("year >= 2019").orderBy("title").collect()] == ["t1", "t2"]


def test_discovery(spark):
    docs = spark.createDataFrame([(1, "| T (K) | Capacity (mmol/g) |\n|---|---|\n" + "\n".join(f"| {t} | {9 - (t / 100 - 3) ** 2 + t % 7 / 1000} |" for t in (200, 250, 300, 350, 400, 450)))], "id long, text string")
    r = discovery.compare_models(docs, "id", "text", ["K"], ["mmol/g"]).first()
    assert r["verdict"] == "candidate_better" and r["r2_curve"] > 0.999
    rows = spark.createDataFrame([(1, 0.8, 0.2, "pending"), (2, 0.4, 0.8, "inconclusive"), (3, 0.6, 0.6, "pending")], "id long, confidence double, plausibility double, validation_status string")
    assert [x["validation_status"] for x in discovery.settle(rows).orderBy("id").collect()] == ["contested", "underexplored", "pending"]


def test_entities(spark):
    from siltstone.functions import entities as e

    v = lambda c: value(spark, c)
    assert v(e.property_keywords(F.lit("CO2 容量"))) == ["capacity", "co2", "loading", "uptake"] and v(e.property_keywords(F.lit(""))) == ["adsorption", "capacity", "selectivity"]
    assert v(e.property_keys(F.lit("缺陷")))[:2] == ["缺陷", "defect"]
    assert [x["name"] for x in v(e.formulas(F.lit("Bi₂Te3 and PV101 with MAPbI3, NiO NiO and HKUST")))] == ["Bi2Te3", "NiO"]
    q = v(e.query_entities(F.lit("band gap of TiO2 by DFT")))
    assert (q["property"], q["method"]) == ("band gap", "DFT") and q["material"] is not None
    assert v(e.document_entities(F.lit("TiO2 perovskite and Band Gap"), "materials")) == ["TiO2", "perovskite"] and v(e.document_entities(F.lit("Band Gap"), "properties")) == ["band gap"]
    assert v(e.evidence_codes(F.lit("see TE113/TE126, p24 and 10.1234/ab.c"))) == ["TE113", "TE126", "p24", "10.1234/ab.c"]
    assert v(e.evidence_order(F.array(F.lit("2020.1"), F.lit("p2"), F.lit("TE1")))) == ["TE1", "p2", "2020.1"]
    assert v(e.paper_ids(F.lit("p12, 10.1234/x, **ID:** abc"))) == ["p12", "10.1234/x", "abc"]
    w = v(e.window_of(F.lit("2016-2020 and 25-40 kJ/mol"), F.lit("1-2 K")))
    assert (w["lo"], w["hi"]) == (25.0, 40.0) and v(e.window_of(F.lit("10-20 区间")))["hi"] == 20.0 and v(e.window_of(F.lit("none"))) is None
    assert v(e.result_summary(F.array(*[F.lit(x) for x in "abcdefg"]))) == "a | b | c | d | e (+2 more)"
    assert v(e.claim_semantics(F.lit("at 50 % RH"))) == "humidity" and v(e.evidence_class(F.lit("p12: x"))) == "papers" and v(e.is_placeholder(F.lit("your-key")))
    s = v(scores.evidence_score(F.array(F.lit("Ni-MOF")), F.lit("容量"), F.lit("NiMOF has capacity 4.5\nother"), F.lit(4.5), F.array(F.lit(4.5)), F.lit("x"), F.lit(None).cast("struct<lo:double,hi:double>"), F.lit(0.0)))
    assert (s["coverage"], s["cooccurrence"], s["numerical"]) == (1.0, 1.0, 1.0) and s["score"] == pytest.approx(0.93)
    assert v(scores.diversity_bonus(F.array(F.lit(0.0)), F.array(F.array(F.lit(0.3))))) == pytest.approx(0.1)
    p = spark.createDataFrame([("a", float(k), 2.0 * k + (k % 2)) for k in range(12)], "g string, x double, y double")
    assert stats.bayes_factor(p, ["g"], "x", "y").first()["band"] == "strong line"
    assert stats.diagnostics(p, ["g"], "x", "y").first()["adjusted_r2"] > 0.98


def test_json_repair(spark):
    from siltstone.functions.json_repair import repair_json, repaired_json

    assert repair_json('x ```json\n{"a": "b\nc", "d": [1, 2,],}\n``` y') == '{"a": "b\\nc", "d": [1, 2]}'
    assert repair_json('{"a": [1, {"b": "c') == '{"a": [1, {"b": "c"}]}' and repair_json("no") is None and repair_json(None) is None and repair_json("{]") is None
    rows = spark.createDataFrame([('[1,]',), (None,)], "t string").select(repaired_json("t").alias("j")).collect()
    assert [r["j"] for r in rows] == ["[1]", None]


def test_tiered_points(spark):
    from siltstone.operators import points

    table = "## Data on several materials in one table\n| Material | T (K) | Capacity (mmol/g) |\n|---|---|---|\n" + "\n".join(f"| m{t} | {t} | {9 - t / 100} |" for t in (200, 300, 400, 200))
    text = table + "\n## More data in sentences about it\nAt 500 K the uptake was 3 mmol/g. At 600 K the uptake was 2 mmol/g. Heat was 30 kJ/mol at 300 K."
    docs = spark.createDataFrame([(1, text), (2, "At 300 K the uptake was 1 mmol/g.")], "id long, text string")
    p = points.literature_points(docs, "id", "text", "CO2 uptake capacity")
    assert [(r["x"], r["y"]) for r in p.where("provenance = 'table'").orderBy("x").collect()] == [(200.0, 7.0), (300.0, 6.0), (400.0, 5.0)]
    assert [(r["x"], r["y"]) for r in p.where("provenance = 'sequence'").orderBy("x").collect()] == [(500.0, 3.0), (600.0, 2.0)]
    tiers = {r["tier"]: r["n"] for r in discovery.tiered_fit(p).collect()}
    assert tiers["A"] == 3 and p.where("doc = 2").count() == 0
