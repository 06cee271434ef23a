"""Record matching, evidence lists, rankings and renderings with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import entities, scores, text
from ..operators import quality, resolve, retrieval
from ..sources import writers
from .registry import Tables, query


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '<<missing>>') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def labelled_or_missing(t: Tables) -> DataFrame:
    """J11."""
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("<<missing>>")).alias("quality"))


@query("""WITH h AS (SELECT DISTINCT p_brand, left(p_type, 4) AS pre FROM part WHERE p_size > 40), c AS (SELECT p_partkey, p_brand, left(p_type, 4) AS pre FROM part),
m AS (SELECT DISTINCT c.p_partkey, c.p_brand FROM c JOIN h ON c.pre = h.pre AND c.p_brand <> h.p_brand), k AS (SELECT DISTINCT p_partkey FROM part WHERE p_size > 40)
SELECT p_partkey, p_brand FROM m WHERE p_partkey NOT IN (SELECT p_partkey FROM k)""")
def same_prefix_missing(t: Tables) -> DataFrame:
    """Parts whose type starts like that of a large part of another brand, and that are not large themselves."""
    large = t.part.where("p_size > 40")
    h = large.select(F.col("p_brand").alias("b"), F.left("p_type", F.lit(4)).alias("pre")).distinct()
    c = t.part.select("p_partkey", "p_brand", F.left("p_type", F.lit(4)).alias("pre"))
    return c.join(h, "pre").where("p_brand <> b").select("p_partkey", "p_brand").distinct().join(large.select("p_partkey"), "p_partkey", "left_anti")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def high_risk_ids(t: Tables) -> DataFrame:
    """J16."""
    return t.orders.select("o_orderkey", "o_custkey").join(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 0 OR o_orderkey % 7 = 0 THEN coalesce(m.best, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END) ELSE o_totalprice END AS best_score FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) m ON l_orderkey = o_orderkey""")
def backfilled_scores(t: Tables) -> DataFrame:
    """Every seventh score is taken away and filled from the line items."""
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("best_score"))
    best = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("best_score"))
    return writers.backfill(rows, best, "o_orderkey")


@query("""SELECT c_custkey, coalesce(s.s_name, n.n_name, 'placeholder') AS name FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey AND c_custkey % 2 = 0""")
def priority_lookup(t: Tables) -> DataFrame:
    """Metadata by the first source that has it."""
    c = t.customer.select("c_custkey", "c_nationkey").join(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), "s_name"), "c_custkey", "left")
    n = t.nation.select("n_nationkey", "n_name")
    out = c.join(F.broadcast(n), (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_custkey") % 2 == 0), "left")  # nations
    return out.select("c_custkey", F.coalesce("s_name", "n_name", F.lit("placeholder")).alias("name"))


@query("SELECT source, count(*) AS n, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source")
def source_histogram(t: Tables) -> DataFrame:
    """Papers by source, and the set of their keywords."""
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("SELECT left(text, 40) AS title, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_titles(t: Tables) -> DataFrame:
    """A20."""
    return t.documents.groupBy(F.left("text", F.lit(40)).alias("title")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""WITH r AS (SELECT DISTINCT l_partkey, l_shipmode_, l_orderkey FROM (SELECT l_partkey, l_returnflag AS l_shipmode_, l_orderkey FROM lineitem)), n AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_shipmode_ ORDER BY l_orderkey) AS k FROM r)
SELECT l_partkey AS part, l_shipmode_ AS db, bool_or(l_orderkey % 5 = 0) AS any_match, array_to_string(list_sort(list(l_orderkey) FILTER (WHERE k <= 3)), ',') AS evidence FROM n GROUP BY 1, 2""")
def external_matches(t: Tables) -> DataFrame:
    """Whether anything matches, and up to three pieces of evidence per database."""
    rows = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("db"), "l_orderkey").distinct()
    any_match = rows.groupBy("part", "db").agg(F.bool_or(F.col("l_orderkey") % 5 == 0).alias("any_match"))
    few = resolve.capped(rows, ["part", "db"], [F.col("l_orderkey")], 3).groupBy("part", "db").agg(F.array_sort(F.collect_list("l_orderkey")).alias("e"))
    return any_match.join(few, ["part", "db"]).select("part", "db", "any_match", F.array_join(F.transform("e", lambda x: x.cast("string")), ",").alias("evidence"))


@query("""WITH e AS (SELECT o_custkey, o_orderpriority AS ev, left(o_orderstatus || ' ' || o_orderkey, 160) AS c, o_orderkey FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM e)
SELECT o_custkey AS entity, array_to_string(list_sort(list(DISTINCT ev)), ',') AS evidence, array_to_string(list(c ORDER BY o_orderkey) FILTER (WHERE k <= 3), '|') AS contexts FROM n GROUP BY 1""")
def entity_evidence(t: Tables) -> DataFrame:
    """Evidence set and first three contexts of each entity."""
    e = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("ev"), F.left(F.concat_ws(" ", "o_orderstatus", F.col("o_orderkey").cast("string")), F.lit(160)).alias("c"))
    sets = e.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("ev")), ",").alias("evidence"))
    first = resolve.capped(e, ["o_custkey"], [F.col("o_orderkey")], 3).groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "c"))), lambda x: x["c"]), "|").alias("contexts"))
    return sets.join(first, "o_custkey").withColumnRenamed("o_custkey", "entity")


@query("""WITH v AS (SELECT DISTINCT p_brand, round(p_retailprice, 4) AS v FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v) AS k FROM v)
SELECT p_brand, count(*) AS n_values, min(v) AS lo, max(v) AS hi FROM n WHERE k <= 500 GROUP BY p_brand""")
def evidence_index(t: Tables) -> DataFrame:
    """Distinct rounded values of each hypothesis, the first 500 in order (the cap is the index's)."""
    v = t.part.select("p_brand", F.round("p_retailprice", 4).alias("v")).distinct()
    return resolve.capped(v, ["p_brand"], [F.col("v")], 500).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_values"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("""SELECT c_custkey, round(((c_acctbal + 1000) / 11003) * ((c_custkey % 97) / 97.0), 9) AS rank_score FROM customer ORDER BY rank_score DESC, c_custkey LIMIT 25""")
def novelty_ranking(t: Tables) -> DataFrame:
    """The 25 best by novelty times confidence."""
    s = F.round((F.col("c_acctbal") + 1000) / 11003 * ((F.col("c_custkey") % 97) / 97.0), 9)
    return retrieval.top(t.customer.select("c_custkey", s.alias("rank_score")), 25, F.col("rank_score").desc(), F.col("c_custkey"))


@query("""WITH r AS (SELECT p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, round(avg(p_retailprice), 6) AS top3 FROM r WHERE k <= 3 GROUP BY 1""")
def top_three_mean(t: Tables) -> DataFrame:
    """T3."""
    return resolve.capped(t.part, ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")], 3).groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("top3"))


@query(r"""SELECT p_partkey, lower(regexp_replace(translate(p_name, '₀₁', '01'), '[\s\-_()\[\]{}·.,]+', '', 'g')) AS formula_key, CASE WHEN length(p_name) <= 12 THEN p_name ELSE left(p_name, 11) || '…' END AS short,
 round(0.10 + 0.12 * ((('0x' || left(md5(p_name), 6))::BIGINT % 1000) / 1000.0), 6)::DOUBLE AS fallback FROM part""")
def part_keys(t: Tables) -> DataFrame:
    """P14, P41, M14."""
    return t.part.select("p_partkey", text.formula_key("p_name").alias("formula_key"), text.truncated("p_name", 12).alias("short"), F.round(scores.empty_evidence(F.col("p_name")), 6).alias("fallback"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\\bNone\\b|\\bnan\\b') OR regexp_matches(text, '\\{\\{.*\\}\\}|<<.*>>') OR regexp_matches(text, '\\{''[A-Za-z_]+'':')""")
def render_sentinels(t: Tables) -> DataFrame:
    """K13."""
    return quality.sentinels(t.documents, "text").select("doc_id")


@query("""SELECT event_id, CASE WHEN value >= 80 THEN 'high' WHEN value >= 65 THEN 'medium' WHEN event_type = 'click' THEN 'incremental' ELSE 'low' END AS label, CASE WHEN value - 50 >= 0.8 THEN 'bayesian_wins' WHEN value - 50 <= -0.3 THEN 'random_wins' ELSE 'parity' END AS verdict FROM events""")
def label_bands(t: Tables) -> DataFrame:
    """P46, A15 (scaled by a hundred)."""
    from ..operators.search_space import verdict

    inc = F.when(F.col("event_type") == "click", "x").otherwise("")
    return t.events.select("event_id", entities.novelty_label(F.col("value"), inc, 100).alias("label"), verdict(F.col("value"), F.lit(50.0), 100).alias("verdict"))


@query("""SELECT doc_id, list_distinct(string_split(text, ' ')) IS NOT NULL AS ok, len(list_distinct(list_filter(string_split(text, ' '), lambda w: w <> ''))) AS n FROM documents""")
def ordered_distinct(t: Tables) -> DataFrame:
    """E7."""
    w = F.filter(F.split("text", " "), lambda x: x != "")
    return t.documents.select("doc_id", F.array_distinct(w).isNotNull().alias("ok"), F.size(F.array_distinct(w)).cast("long").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS rank FROM lineitem""")
def window_frames(t: Tables) -> DataFrame:
    """Frames and ranks as an interface."""
    w = Window.partitionBy("l_orderkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax").rowsBetween(-2, 0)).alias("moving"), F.rank().over(w.orderBy(F.col("l_quantity").desc())).cast("long").alias("rank"))
