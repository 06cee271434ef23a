"""Lines of reports: evidence chains, validations, model comparisons, discovery reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col, lookup

# The block of ids that can't be traced, and the labels of verdicts.
HIGH_RISK_HEAD = "高风险不可追溯"
HIGH_RISK_LINE = r"(?i)^-\s*`([a-zA-Z]{1,4}\d+)`\s*[（(]\s*paper_id"
VERDICTS = {"insufficient": "无法判定", "no_improvement": "无显著提升", "supported": "支持", "strong_support": "强支持", "improvement": "有提升"}


def audited_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, ref): ids in the high-risk blocks of an audit, in lower case; a block ends with the next heading of level two or three."""
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.coalesce(col(text_col), F.lit("")), "\n")).alias("line", "s"))
    opens = F.col("s").contains(HIGH_RISK_HEAD)
    mark = F.when(opens, True).when(F.col("s").rlike("^#{2,3} "), False)
    lines = lines.withColumn("_in", F.last(mark, ignorenulls=True).over(Window.partitionBy("doc").orderBy("line")))
    ref = F.lower(F.regexp_extract(F.trim("s"), HIGH_RISK_LINE, 1))
    return lines.where(F.col("_in") & ~opens & (ref != "")).select("doc", ref.alias("ref")).distinct()


def novelty_line(item: Column | str) -> Column:
    """Novelty, queries and results of a verification entry; an entry without them stays as it is."""
    part = lambda name, pattern, before, after: F.when(
        F.regexp_extract(col(item), pattern, 1) != "", F.concat(F.lit(before), F.regexp_extract(col(item), pattern, 1), F.lit(after))
    )
    line = F.concat_ws("；", part("n", r"Novelty:\s*([\d.]+)", "新颖性 ", ""), part("q", r"Queries:\s*(\d+)", "查询 ", " 次"), part("r", r"Results:\s*(\d+)", "结果 ", " 条"))
    return F.when(line != "", line).otherwise(col(item))


def validation_lines(rows: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, place, line) of external validations: rows of (key, db, match, entries, queries), one for each database that was asked."""
    n = F.size("entries")
    hit = F.transform(F.slice("entries", 1, most), lambda e: F.concat(F.lit("- 数据库记录（"), F.col("db"), F.lit("）：命中 → "), e))
    more = F.when(n > most, F.array(F.concat(F.lit("- 数据库记录（"), F.col("db"), F.lit("）：另有 "), (n - most).cast("string"), F.lit(" 条命中略")))).otherwise(F.array().cast("array<string>"))
    asked = F.when(F.size("queries") > 0, F.array_join(F.slice("queries", 1, 5), ", ")).otherwise("—")
    miss = F.array(F.concat(F.lit("- 数据库记录（"), F.col("db"), F.lit("）：未命中（查询 "), asked, F.lit("）")))
    lines = F.when(F.col("match"), F.concat(hit, more)).otherwise(miss)
    return rows.select(key, "db", F.posexplode(lines).alias("place", "line"))


def model_summary(verdict: Column, delta_r2: Column, f_supported: Column) -> Column:
    """One line on a model comparison: the verdict's label, the gain of R², whether the F test supports it."""
    sign = F.when(F.round(delta_r2, 3) >= 0, F.lit("+")).otherwise("")
    line = F.concat_ws(
        "，", F.coalesce(lookup(verdict, VERDICTS), verdict), F.when(delta_r2.isNotNull(), F.concat(F.lit("ΔR²="), sign, F.format_string("%.3f", F.round(delta_r2, 3)))), F.when(f_supported, "F 检验通过").when(~f_supported, "F 检验未通过")
    )
    return F.when(line != "", line).otherwise("有模型比较")


def evidence_chain(hyps: DataFrame, evidence: DataFrame, high_risk: DataFrame) -> DataFrame:
    """(id, papers, high_risk, novelty, other) of hypotheses: evidence (id, item) by class; ids that an audit flags are marked."""
    kind = F.when(F.col("item").startswith("[Novelty Verification]"), "novelty").when(F.col("item").rlike(r"^(?:p\d{1,3}|[A-Z]{2,4}\d{2,4})$"), "papers").otherwise("other")
    rows = evidence.where(F.trim("item") != "").withColumn("kind", kind).withColumn("_k", F.lower("item"))
    rows = rows.join(high_risk.select(F.col("ref").alias("_k"), F.lit(True).alias("risk")).distinct(), "_k", "left")
    names = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.when(F.col("kind") == "novelty", novelty_line("item")).otherwise(F.col("item"))))), "、")
    chain = rows.groupBy("id").agg(*[names(F.col("kind") == k).alias(k) for k in ("papers", "novelty", "other")], names((F.col("kind") == "papers") & F.col("risk")).alias("high_risk"))
    return hyps.select("id").join(chain, "id", "left").na.fill("", ["papers", "novelty", "other", "high_risk"])


def discovery_lines(hyps: DataFrame) -> DataFrame:
    """(place, line) of a discovery report over (id, title, status, best_score): counters, then a section for each hypothesis, best first."""
    counts = hyps.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "validated").alias("v"), F.count_if(F.col("status") == "inconclusive").alias("i"))
    head = counts.select(F.lit(-1e18).alias("place"), F.lit("").alias("id"), F.array(F.lit("# Discovery report"), F.format_string("- hypotheses: %d", "n"), F.format_string("- validated: %d, inconclusive: %d", "v", "i")).alias("lines"))
    body = hyps.select((-F.col("best_score")).alias("place"), "id", F.array(F.concat(F.lit("## "), "title"), F.format_string("- best score: %.3f", F.round("best_score", 3)), F.concat(F.lit("- status: "), "status")).alias("lines"))
    return head.unionByName(body).select("place", "id", F.posexplode("lines").alias("n", "line"))
