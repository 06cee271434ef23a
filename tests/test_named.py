"""Names in texts, by windows, against containment of all pairs; hypotheses from gaps without renamed names."""

import random

from siltstone.operators import graph, hypotheses
from siltstone.plans import discovery


def test_names_anywhere(spark, monkeypatch):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abC-# é") for _ in range(n))
    texts = [(i, word(draw.randint(0, 60))) for i in range(80)] + [(90, None), (None, "abc"), (91, ""), (7, "aBc-"), (92, "a"), (93, "x" * 5000 + "ab#c")]
    names = [(word(n),) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 6)] + [("ABC",), ("ab#c",), (None,), ("",), ("abc",), ("abc",), ("zzz",)]
    want = {(i, n) for i, t in texts for (n,) in names if i is not None and t and n and n.lower() in t.lower()}
    for most in (100_000, 3):
        monkeypatch.setattr(graph, "BROADCAST_NAMES", most)
        got = [tuple(r) for r in graph.named_in(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame(names, "name string"), "name").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    long = [(n,) for (n,) in names if n is None or len(n) >= 3]
    got = graph.named_in(spark.createDataFrame(texts, "k long, t string"), "k", "t", spark.createDataFrame(long, "name string"), "name").collect()
    assert {tuple(r) for r in got} == {(i, n) for i, n in want if len(n) >= 3}
    assert graph.named_in(spark.createDataFrame([], "k long, t string"), "k", "t", spark.createDataFrame([], "name string"), "name").count() == 0


def test_gaps_name_materials_of_several_words(spark):
    gaps = [(1, 1, "unexplored", "high", "one", "The Band Gap is open", []), (1, 2, "missing_link", "medium", "two", "x", ["heat", "Light"]), (1, 3, "missing_link", "high", "three", "x", ["heat", "none"]), (1, 4, "unexplored", "low", "four", "band gap", []), (2, 1, "unexplored", "high", None, None, None)]
    schema = "doc int, gap int, type string, severity string, title string, description string, entities array<string>"
    materials = [("Lead halide",), ("MOF-74/Mg",), ("TiO2",), ("Zn",), (None,), ("",)]
    texts = [("MOF-74/Mg has a band gap",), ("lead halide under heat",), ("LEAD HALIDE in light and tio2 in heat",), (None,), ("",)]
    out = hypotheses.from_gaps(spark.createDataFrame(gaps, schema), spark.createDataFrame(materials, "material string"), spark.createDataFrame([("band gap", 0), ("gap", 1)], "property string, ord int"), spark.createDataFrame(texts, "text string"))
    rows = {(r["doc"], r["id"]): (r["title"], r["materials"], r["property"]) for r in out.collect()}
    assert [rows[1, f"hypo_unexplored_{i}"][1] for i in (1, 2, 3)] == [["lead halide"], ["tio2"], ["zn"]] and (1, "hypo_unexplored_4") not in rows
    assert rows[1, "hypo_unexplored_1"][0] == "lead halide may exhibit enhanced band gap"
    assert [rows[1, f"hypo_link_{i}"][1] for i in (1, 2)] == [["Lead halide", "heat", "Light"], ["TiO2", "heat", "Light"]]
    assert [rows[1, f"hypo_link_{i}"][1][0] for i in (3, 4, 5, 6)] == ["Lead halide", "MOF-74/Mg", "TiO2", "Zn"]
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()


def test_checked_hypotheses(spark):
    hyps = spark.createDataFrame([(1, ["Mg-MOF 74"], "CO2 uptake, BET"), (2, ["mof"], "colour"), (3, [None, ""], "qst"), (4, None, None)], "id int, materials array<string>, property string")
    known = spark.createDataFrame([("MOF-74", "capacity", 1.0, 2.0), ("MOF-74", "area", 5.0, 9.0), ("MOF-5", "area", None, None)], "name string, kind string, lo double, hi double")
    out = {r["id"]: (r["found"], r["entries"], r["validation_status"]) for r in discovery.known_ranges(hyps, known).collect()}
    assert out == {1: (1, ["MOF-74: area = 5.0-9.0", "MOF-74: capacity = 1.0-2.0"], "validated"), 2: (2, [], "inconclusive"), 3: (0, [], "pending"), 4: (0, [], "pending")}
    proxies = spark.createDataFrame([("MOF-74", "MgO"), ("MOF-5", "ZnO"), (None, "x")], "name string, proxy string")
    assert {tuple(r) for r in discovery.proxies_of(hyps, proxies).collect()} == {(1, "MgO"), (2, "MgO"), (2, "ZnO")}
    rows = spark.createDataFrame([(1, ["e"] * 9, 0.0, 2, 2, 0.9), (2, None, None, None, None, None), (3, ["e"], 1.0, 0, 0, 0.5)], "id int, evidence_chain array<string>, share double, n_claims int, n_unverified int, confidence double")
    got = {r["id"]: round(r["plausibility"], 6) for r in discovery.plausibility(rows).collect()}
    assert got == {1: 0.41, 2: 0.35, 3: 0.56}
