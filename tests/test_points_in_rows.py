"""Points are found inside the rows of documents: no text is shuffled or written, and pairs only where documents do not lie by their id."""

from pyspark.sql import functions as F

from siltstone.operators import points
from siltstone.plans import QUERIES


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_texts_are_neither_shuffled_nor_written(spark, tmp_path):
    text = F.concat(F.lit("## Values of a sample that was measured at some time\nat 300 K it was 5 mmol/g; at 310 K it was "), F.col("id"), F.lit(" mmol/g; at 320 K 6 mmol/g"))
    docs = spark.range(1, 9).select("id", text.alias("text"))
    lying = plan_of(points.literature_points(docs.repartition(4, "id"), "id", "text", "uptake"))
    assert lying.count("Exchange") == 1 and "ExistingRDD" not in lying  # before, texts were shuffled and written twice, pairs once
    assert points.literature_points(docs.repartition(4, "id"), "id", "text", "uptake").count() == points.literature_points(docs, "id", "text", "uptake").count() > 0
    spark.range(1, 30).select((F.col("id") % 7).alias("sale_id"), F.col("id").cast("int").alias("line_no"), F.col("id").alias("item_id"), (F.col("id") % 50).cast("int").alias("quantity")).write.parquet(str(tmp_path / "sale_lines.parquet"))
    spark.range(7).select(F.col("id").alias("sale_id"), F.col("id").alias("client_id"), F.lit(1).alias("priority")).write.parquet(str(tmp_path / "sales.parquet"))
    of_sales = plan_of(QUERIES["literature_points"](spark, str(tmp_path)))
    assert of_sales.count("Exchange hashpartitioning") == 2 and "ExistingRDD" not in of_sales


def test_half_empty_cells_are_filled_down(spark):
    rows = [(["", None, "a", "", None, "b", "c", ""],), ([],), (["", ""],), ([None],), (["x"],)]
    got = spark.createDataFrame(rows, "c array<string>").select(points.filled_down(F.col("c")).alias("f")).collect()
    assert [r["f"] for r in got][:1] + [r["f"] for r in got][2:] == [[None, None, "a", "a", "a", "b", "c", "c"], [None, None], [None], ["x"]]
    text = "## Table of half empty rows, of which each is to be read\n| T (K) | Uptake (mmol/g) |\n|---|---|\n| 300 | 1 |\n| | 2 |\n| 310 | 3 |\n| 320 | 4 |\n"
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    tables = lambda **o: sorted((r["x"], r["y"]) for r in points.literature_points(docs, "id", "text", "uptake", **o).where("provenance = 'table'").collect())
    assert tables() == [(300, 1), (310, 3), (320, 4)] and tables(carry=("x",)) == [(300, 1), (300, 2), (310, 3), (320, 4)]
