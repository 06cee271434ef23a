"""Points: a text is searched once for its structure variables and values, with the results of searching it for each group."""

from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.operators import points

ODD = ["at 1.5 K, 2 °C 3℃ 4kPa 5 GPa 6 MPa 7 bar 8 atm", "x = 0.5; 比例：2 组分 : 3 composition:4.25 doping=5", "6 % and 7 %RH, 8% 湿度 and 9%h", "1.2.3 K 5 5 bar 10\n K 12kpa", "", None, "x: K 300 k"]
VALUES = ["1.5 mmol/g 2mol/kg 3\tK 4 %a 5% 6 min 7 h 8 W/mK", "1.2.3 K 10\n eV 4K5 x7 bar", "", None]


def test_structure_values_in_one_search(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    for scaled in (False, True):
        groups = F.transform(points.matches(F.col("t"), fixed.POINT_X, 4), lambda m: F.array(*[m[f"g{k}"] for k in range(5)]))
        for r in rows.select(points.structure_values(F.col("t"), scaled).alias("got"), groups.alias("groups")).collect():
            want = []
            for whole, warm, press, part, percent in r["groups"] or []:
                low = whole.lower()
                if warm:
                    want.append(("temperature", round(float(warm) + (273.15 if "°c" in low or "℃" in low else 0), 3)))
                elif press:
                    by = 0.01 if "kpa" in low else 10000 if "gpa" in low and scaled else 10 if "mpa" in low and scaled else 1
                    want.append(("pressure", round(float(press) * by, 5)))
                else:
                    want.append(("composition", float(part)) if part else ("percentage", float(percent)))
            assert [tuple(x) for x in r["got"] or []] == want


def test_value_units_in_one_search(spark):
    rows = spark.createDataFrame([(t,) for t in VALUES], "t string")
    groups = F.transform(points.matches(F.col("t"), fixed.POINT_VALUE, 2), lambda m: F.struct(m["g1"].alias("v"), m["g2"].alias("u")))
    for r in rows.select(points.value_units(F.col("t")).alias("got"), groups.alias("want")).collect():
        assert r["got"] == r["want"]


def test_each_text_is_searched_once(spark):
    blocks = spark.createDataFrame([(1, "at 300 K the uptake was 5 mmol/g")], "id long, text string").withColumn("y_unit", F.lit("mmol/g"))
    plan = points.sentence_pairs(blocks, ["id"], F.col("y_unit"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("GPa") == 1 and plan.count("mmol/g|mol/kg") == 1  # before, each of five groups where the array was named, and again for its size
