"""Points of a property out of texts written from sales: tables with empty cells, sequences, and both together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import points
from .registry import Tables, query


def by_sale(rows: DataFrame) -> DataFrame:
    """Rows by sale, in a given number of tasks: a row here becomes a text to be searched, so rows are what counts, and adaptive execution would deal them by bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sale_id")


#: Lines of a sale in a fixed order, numbered from 0; x is missing on every third quantity, y where there is no item.
SALE_ROWS = """l AS (SELECT sale_id, quantity, item_id, row_number() OVER (PARTITION BY sale_id ORDER BY line_no, coalesce(item_id, -1), coalesce(quantity, -1)) - 1 AS pos FROM sale_lines WHERE sale_id IS NOT NULL),
c AS (SELECT sale_id, pos, CASE WHEN quantity % 3 > 0 THEN CASE WHEN quantity % 5 = 0 THEN quantity + 273.15 ELSE 200 + quantity END END::DOUBLE AS x, 1 + item_id % 40 AS y FROM l)"""


def sale_tables(t: Tables) -> DataFrame:
    """A text for each sale: a table of its lines, some of whose cells are empty, in kelvin or degrees Celsius.  Numbers are shuffled, and written out as text where they meet."""

    def row(r: Column) -> Column:
        q = r["quantity"]
        x = F.when(q % 3 > 0, F.when(q % 5 == 0, F.concat(q.cast("string"), F.lit(" °C"))).otherwise(F.concat((200 + q).cast("string"), F.lit(" K"))))
        return F.concat(F.lit("| ref "), F.coalesce(r["line_no"].cast("string"), F.lit("")), F.lit(" | "), F.coalesce(x, F.lit("")), F.lit(" | "), F.coalesce((1 + r["item_id"] % 40).cast("string"), F.lit("-")), F.lit(" |"))

    lines = t.sale_lines.where("sale_id IS NOT NULL").select("sale_id", F.struct("line_no", F.coalesce("item_id", F.lit(-1)).alias("i"), F.coalesce("quantity", F.lit(-1)).alias("q"), "item_id", "quantity").alias("r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("r")), row), "\n")
    return by_sale(lines).groupBy("sale_id").agg(F.concat(F.lit("Lines of one sale in a table\n| Ref | T | Uptake (mmol/g) |\n|---|:---:|---|\n"), body).alias("text"))


@query(f"""WITH {SALE_ROWS}
SELECT sale_id, 0 AS carried, pos + 3 AS line, x, y::DOUBLE AS y FROM c WHERE x IS NOT NULL AND y IS NOT NULL
UNION ALL SELECT sale_id, 1, pos + 3, x, y FROM (SELECT sale_id, pos, last_value(x IGNORE NULLS) OVER (PARTITION BY sale_id ORDER BY pos) AS x, last_value(y::DOUBLE IGNORE NULLS) OVER (PARTITION BY sale_id ORDER BY pos) AS y, y IS NULL AS dash FROM c) WHERE x IS NOT NULL AND NOT dash""")
def table_points(t: Tables) -> DataFrame:
    """(x, y) of every table row below its head; once as it stands, once with empty cells of x filled from above."""
    blocks = sale_tables(t).select("sale_id", "text", F.lit("mmol/g").alias("y_unit"), F.array(F.lit("mmol/g")).alias("wanted"))
    both = None
    for k, carry in enumerate(((), ("x", "y"))):
        one = points.table_pairs(blocks, ["sale_id"], F.col("y_unit"), F.col("wanted"), carry).select("sale_id", F.lit(k).alias("carried"), "line", "x", "y")
        both = one if both is None else both.unionByName(one)
    return both


#: Small integers of a sale for its sentence.
SALE_NUMBERS = """n AS (SELECT sale_id, 1 + client_id % 9 AS a, 1 + client_id % 7 AS b, 200 + client_id % 50 AS c, 300 + sale_id % 90 AS d, coalesce(priority, 0) AS p, sale_id % 4 AS k FROM sales WHERE sale_id IS NOT NULL AND client_id IS NOT NULL)"""


def sale_numbers(t: Tables) -> DataFrame:
    s = t.sales.where("sale_id IS NOT NULL AND client_id IS NOT NULL")
    return s.select("sale_id", (1 + F.col("client_id") % 9).alias("a"), (1 + F.col("client_id") % 7).alias("b"), (200 + F.col("client_id") % 50).alias("c"), (300 + F.col("sale_id") % 90).alias("d"), F.coalesce("priority", F.lit(0)).alias("p"), (F.col("sale_id") % 4).alias("k"))


def said_of_sale() -> Column:
    """Of a sale's numbers: a change of y with a change of x, then two values of x with one or two of y."""
    change = F.format_string("Uptake fell from %d to %d mmol / g as T rose from %d to %d %s; ", "a", "b", "c", "d", F.when(F.col("k") == 1, "°C").otherwise("K"))
    change = F.when(F.col("k") == 2, F.format_string("The price went from %d to %d EUR as T rose from %d to %d K; ", "a", "b", "c", "d")).otherwise(change)
    values = F.when(F.col("k") == 3, F.format_string("at %d K and %d K the uptake was %d mmol/g!", "c", "d", "p")).otherwise(F.format_string("at %d K and %d K the uptake was %d mmol/g and %d mmol/g!", "c", "d", "a", "p"))
    return F.concat(change, values)


def sale_sentences(t: Tables) -> DataFrame:
    """A text for each sale: what :func:`said_of_sale` says."""
    return sale_numbers(t).select("sale_id", said_of_sale().alias("text"))


@query(f"""WITH {SALE_NUMBERS}, w AS (SELECT *, CASE WHEN k = 1 THEN 273.15 ELSE 0 END AS up FROM n)
SELECT sale_id, 'temperature' AS kind, (c + up)::DOUBLE AS x, a::DOUBLE AS y FROM w WHERE k <> 2 UNION ALL SELECT sale_id, 'temperature', d + up, b FROM w WHERE k <> 2
UNION ALL SELECT sale_id, 'temperature', c, a FROM w WHERE k <> 3 AND p > 0 UNION ALL SELECT sale_id, 'temperature', d, p FROM w WHERE k <> 3 AND p > 0""")
def sequence_points(t: Tables) -> DataFrame:
    """U16: changes of y zipped with changes of x, and sentences with as many values of one as of the other."""
    blocks = sale_sentences(t).withColumn("y_unit", F.lit("mmol/g"))
    return points.sentence_pairs(blocks, ["sale_id"], F.col("y_unit")).select("sale_id", "kind", "x", "y")


@query()
def literature_points(t: Tables) -> DataFrame:
    """Points of a sale's table and sentence together."""
    both = sale_tables(t).join(by_sale(sale_numbers(t)), "sale_id").select("sale_id", F.concat("text", F.lit("\n\n## What was said about this sale, in a block of its own\n"), said_of_sale()).alias("text"))
    return points.literature_points(both, "sale_id", "text", "CO2 uptake capacity")
