"""Parsing, hypotheses, reports, caches and evidence indexes on small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import fixed, text
from siltstone.operators import extract, hypotheses, parsing, reports, retrieval, stats
from siltstone.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_headers(spark):
    text = "x\n# A title \n\nAuthors: Ann Lee; Bo, Cy Fox\n\n## ABSTRACT\n\nSome words.\n## Next\n"
    assert one(spark, parsing.paper_title(F.lit(text), F.lit("f"))) == "A title" and one(spark, parsing.paper_abstract(F.lit(text))) == "Some words."
    assert one(spark, parsing.paper_authors(F.lit(text))) == ["Ann Lee", "Cy Fox"]
    plain = "short\nthe first long line\n\n" + "w" * 101
    assert one(spark, parsing.paper_title(F.lit(plain), F.lit("f"))) == "the first long line" and one(spark, parsing.paper_abstract(F.lit(plain))) == "w" * 101
    assert one(spark, parsing.paper_title(F.lit("a\nb"), F.lit("file"))) == "file" and one(spark, parsing.paper_abstract(F.lit("a"))) == "" and one(spark, parsing.paper_authors(F.lit("a"))) == []
    assert one(spark, parsing.paper_authors(F.lit("t\nLee A., Ray B., Moe C.\n"))) == ["Lee A.", "Ray B.", "Moe C."]


def test_parse_errors_stay_rows(spark):
    files = spark.createDataFrame([("a.md", b"fine"), ("b.pdf", b"bad")], "path string, content binary")

    def parse(path, content):
        if path.endswith("pdf"):
            raise ValueError("no engine")
        return content.decode(), "text"

    got = {r["path"]: (r["text"], r["parse_engine"]) for r in parsing.parse_all(files, parse).collect()}
    assert got == {"a.md": ("fine", "text"), "b.pdf": ("[Parse Error: no engine]", "error")}


def test_round_text(spark):
    assert one(spark, parsing.strategy(F.lit("a。b\n。c。"))) == "b。c" and one(spark, parsing.strategy(F.lit("only"))) == "only" and one(spark, parsing.strategy(F.lit(" "))) == " "
    tools = F.array(*[F.struct(F.lit(t).alias("tool"), F.lit(f).alias("file")) for t, f in (("write_file", "x.py"), ("read", "y"), ("edit_file", ""))])
    assert one(spark, parsing.touched_files(tools)) == ["x.py"]


def test_plain_pairs(spark):
    table = "| T (K) | Cap (mmol/g) |\n|---|---|\n| 300 | 1,5 |\n| x | 2 |\n| 310 | 2.5 |\n\n"
    texts = [
        table + "at 298 K, 4.5 mmol/g and 3, 5 kJ/mol", "| a | b | c |\n|--|--|--|\n| n | 1 | 2 |\n\n", None, "", "| a |\n|--|\n", "| a | b |\n|--|--|\n| only | words |",
        "said | K | eV |\n|-|-|\n| 1 | 2 |\n## next\n| x | y | z |\n|-|-|-|\n" + "| n | m | o |\n" * 5 + "| 7 | 8 | 9 |", "| p (bar) | q |\n|-|-|\nno bars here\n| 1 | | 4 |\n| 5 |",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in parsing.own_pairs(docs, "id", "t").orderBy("doc", "pair").collect():
        got.setdefault(r["doc"], []).append((r["x"], r["y"], r["source"]))
    assert got == {0: [(300, 1.5, "table"), (310, 2.5, "table"), (298, 4.5, "sentence"), (3, 5, "list_pair")], 1: [(1, 2, "table")], 6: [(1, 2, "table")], 7: [(1, 4, "table")]}
    assert parsing.own_pairs(docs.limit(0), "id", "t").count() == 0


def test_query_entities(spark):
    e = lambda *x: one(spark, hypotheses.query_entities(*x))
    words = F.lit("Effect of moisture on Mg-MOF-74 and the discovery of large things")
    assert e(words, F.lit(""), F.array(F.lit("Mg-MOF-74"), F.lit("7")), F.lit("uptake"), F.lit("吸附容量 关系")) == ["Mg-MOF-74", "moisture", "uptake", "吸附容量"]
    assert e(F.lit("moisture and uptake"), F.lit(None), F.lit(None).cast("array<string>"), F.lit(None), F.lit(None)) == []


def test_external_payloads(spark):
    payload = '{"pagination": {"total": 7}, "data": [{"entry_id": "e1", "results": {"material": {"chemical_formula_hill": "H2O"}}}, {"entry_id": null, "results": {"material": {"chemical_formula": "CO2"}}}]}'
    assert tuple(one(spark, hypotheses.nomad_entries(F.lit(payload)))) == (7, ["H2O", "CO2"], ["e1"])
    assert tuple(one(spark, hypotheses.nomad_entries(F.lit("{}")))) == (0, [], [])


def test_report_phrases(spark):
    assert one(spark, reports.novelty_line(F.lit("plain"))) == "plain"
    none = lambda k: F.lit(None).cast(k)
    assert one(spark, reports.model_summary(none("string"), none("double"), none("boolean"))) == "有模型比较"
    assert one(spark, reports.model_summary(F.lit("supported"), none("double"), F.lit(True))) == "支持，F 检验通过"


def test_json_in_prose(spark):
    cases = {
        '\ufeff {"a": 1} ': '{"a":1}', 'x ```json\n[1, 2]\n``` y': "[1,2]", 'see {bad} and {"a": {"b": ["}", "\\"{"]}} tail }': '{"a":{"b":["}","\\"{"]}}', "so [1, {\"k\": [2]}] it": '[1,{"k":[2]}]',
        "none": None, "": None, "{open": None, 'deep {"a":{"b":{"c":{"d":{"e":1}}}}} end': '{"a":{"b":{"c":{"d":{"e":1}}}}}',
    }
    frame = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = [r["j"] for r in frame.orderBy("i").select(F.to_json(text.parsed_json("t")).alias("j")).collect()]
    assert got == list(cases.values())


def test_dois_of_any_name(spark):
    items = ['{"DOI": "10.1/A."}', '{"ids": {"doi": "doi:10.2/b"}}', '{"external_ids": {"DOI": "10.3/c"}}', '{"url": "https://doi.org/10.4/D"}', '{"url": "http://x"}']
    frame = spark.createDataFrame(list(enumerate(items)), "i int, t string").select("i", F.parse_json("t").alias("v"))
    assert [r["d"] for r in frame.orderBy("i").select(readers.any_doi(F.col("v")).alias("d")).collect()] == ["10.1/a", "10.2/b", "10.3/c", "10.4/d", None]


def test_sources(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.cached(spark, str(tmp_path), {"q": "a", "n": 3}, build).count() == 3
    assert writers.cached(spark, str(tmp_path), {"q": "b"}, build).count() == 3 and len(calls) == 2
    paths = spark.createDataFrame([("/a/run1",), ("/a/Test_x",), ("/test/run2/",), ("/a/smoke",)], "path string")
    assert {r["path"] for r in readers.run_folders(paths).collect()} == {"/a/run1", "/test/run2/"}
    assert retrieval.available_sources({"scibase": paths, "gone": None}) == ["arxiv", "semantic_scholar", "scibase"]
    row = spark.createDataFrame([("Thermal conductivity of BaTiO3", "by sol-gel")], "t string, a string")
    assert row.select(retrieval.smart_query("t", "a").alias("q")).first()["q"].startswith("Thermal conductivity of BaTiO3 ")


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        stats.classical_fit("cubic?", spark.range(1), ["id"], "id", "id")


def test_evidence_index_windows(spark):
    """Values near keywords, cut as the windows are; against plain Python."""
    text = "# One\n" + "far 9.5 ppm " * 20 + "the stability is 3.25 ppm here " + "x" * 150 + " 7 ppm\n## Two, a block that is long enough to be one of its own, with nothing in it at all"
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    hyps = spark.createDataFrame([(1, "d", ["MOF-5/Zn", "12345", "ab"], "weird stability")], "id int, doc string, materials array<string>, property string")
    r = extract.evidence_index(docs, "doc", "text", hyps).first()
    assert len(r["blocks"]) == 2 and r["material_tokens"] == ["mof-5"]
    units = None if not any(w in "weird stability" for _, words in fixed.UNIT_BUCKETS for w in words) else {u for us, words in fixed.UNIT_BUCKETS for u in us if any(w in "weird stability" for w in words)}
    want = set()
    for block in r["blocks"]:
        low = block.lower()
        texts = [low[max(0, m.start() - 120) : m.end() + 160] for k in r["keywords"] for m in re.finditer(re.escape(k), low)] + ([low] if units else [])
        want |= {round(float(m[1]), 4) for t in texts for m in re.finditer(fixed.VALUE_UNIT, t) if units is None or m[2] in units}
    assert r["values"] == sorted(v for v in want if 0 < v < 1e6)


def test_published_fits(spark):
    # Nickel content and retention after a hundred cycles, and the r2 published for them.
    points = spark.createDataFrame([("a", x, y) for x, y in ((0.33, 95.0), (0.50, 92.0), (0.60, 90.0), (0.80, 85.0), (0.83, 82.0), (1.00, 70.0))], "k string, x double, y double")
    r = stats.audit_fits(points, ["k"], "x", "y").first()
    assert (round(r["linear"], 3), round(r["quadratic"], 3), round(r["end_points"], 3)) == (0.887, 0.983, -0.032)
