"""Sinks: append-only logs, graphs, rendered reports, back-filled scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECRET_NAMES = "(?i)(api_?key|token|secret|password|authorization)"


def redacted(parameters: Column | str) -> Column:
    """K3: values of secret-looking names are masked."""
    return F.transform_values(parameters, lambda k, v: F.when(k.rlike(SECRET_NAMES), F.lit("***")).otherwise(v))


def append_log(rows: DataFrame, path: str) -> None:
    """K2, K3: JSON lines, appended under the commit protocol."""
    for name, kind in rows.dtypes:
        if kind == "map<string,string>":
            rows = rows.withColumn(name, redacted(name))
    rows.write.mode("append").json(path)


def save_graph(tables: dict[str, DataFrame], path: str) -> None:
    """K5: one table per record type, never one nested row."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def save_index(posts: DataFrame, table: str, buckets: int = 64) -> None:
    """Postings bucketed by term, so that later joins on term need no shuffle."""
    posts.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(table)


def paper_lines(papers: DataFrame) -> DataFrame:
    """K4, K7: one Markdown block per paper; abstract cut at 500 characters, three authors."""
    authors = F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(F.size("authors") > 3, " et al.").otherwise(""))
    block = F.concat_ws(
        "\n", F.concat(F.lit("### "), "title"), F.concat(F.lit("**Authors:** "), authors), F.concat(F.lit("**Year:** "), F.col("year").cast("string")),
        F.concat(F.lit("**DOI:** "), "doi"), F.left(F.coalesce("abstract", F.lit("")), F.lit(500)),
    )
    return papers.select(block.alias("value"))


def save_text(lines: DataFrame, path: str) -> None:
    """Rendered lines as text files."""
    lines.select("value").write.mode("overwrite").text(path)


def backfill(rows: DataFrame, scores: DataFrame, key: str, column: str = "best_score") -> DataFrame:
    """Missing or non-positive scores from a second table."""
    new = scores.select(key, F.col(column).alias("_new"))
    old = F.col(column)
    return rows.join(new, key, "left").withColumn(column, F.when(old.isNull() | (old <= 0), F.coalesce("_new", old)).otherwise(old)).drop("_new")


def cached(spark, folder: str, parameters: dict, build) -> DataFrame:
    """What ``build()`` gives, kept under the MD5 of the parameters; an entry counts once it is written whole."""
    import hashlib
    import json

    path = f"{folder.rstrip('/')}/{hashlib.md5(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
