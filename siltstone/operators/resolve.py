"""Entity resolution, set operations and ordered dedupe."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, ngrams
from ..session import cut


def first_wins(frame: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    return ranked(frame, keys, order).where("_rank = 1").drop("_rank")


def ranked(frame: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    return frame.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def capped(frame: DataFrame, keys: list, order: list[Column], n: int) -> DataFrame:
    """T5: the first n rows of each group; Spark turns the filter into a group limit before the shuffle."""
    return ranked(frame, keys, order).where(F.col("_rank") <= n).drop("_rank")


def upsert_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows whose key is new are appended; the first of several wins; nothing is overwritten."""
    fresh = first_wins(incoming.join(existing.select(key), key, "left_anti"), [key], order)
    return existing.unionByName(fresh, allowMissingColumns=True)


def missing_keys(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys in use that are not known."""
    return used.select(key).distinct().join(known.select(key), key, "left_anti")


#: Similarity from which pairs are found by parts of gram sets that agree, and not by rare grams.
BY_PARTS = 0.8


#: Words of 64 bits in the sign of a gram set.
SIGN = 4


def _sign(grams: Column) -> Column:
    """struct(n, w0, ...): the size of a gram set, and bits that each gram turns over, so that the bits in which two signs differ are no more than the grams in which the sets do."""
    turn = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 22).bitwiseAND(F.lit(63)).cast("int"))
    own = lambda h, w: F.shiftright(h, 20).bitwiseAND(F.lit(SIGN - 1)) == w
    word = lambda hs, w: F.aggregate(hs, F.lit(0).cast("long"), lambda bits, h: F.when(own(h, w), bits.bitwiseXOR(turn(h))).otherwise(bits))
    return let(F.transform(grams, lambda x: F.xxhash64(x)), lambda hs: F.struct(F.size(hs).alias("n"), *[word(hs, w).alias(f"w{w}") for w in range(SIGN)]))


def _met(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Candidate pairs by parts that agree, without those whose signs differ in more bits than sets of Jaccard ``least`` may in grams."""
    marked = lambda side, key, sign: _parted(side, key, least).withColumnRenamed("sign", sign)
    differ = sum((F.bit_count(F.col(f"_a.w{w}").bitwiseXOR(F.col(f"_b.w{w}"))) for w in range(SIGN)), F.lit(0))
    may = F.floor((1 - least) / least * F.least("_a.n", "_b.n") + 1e-9)
    return marked(a, "a", "_a").join(marked(b, "b", "_b"), ["level", "part", "mark"]).where(differ <= may).select("a", "b")


def _parted(side: DataFrame, key: str, least: float) -> DataFrame:
    """key, sign, level, part, mark: what two gram sets of Jaccard ``least`` or more have in common at least once, and the set's sign.

    Such sets differ in few grams, K of them at most for their sizes.  Dealt into
    K + 1 parts by hash, one part at least is the same in both, so its mark (size
    and exclusive or of hashes) is.  Sizes fall into levels that grow by 1 / least;
    a pair lies in one level or in two that touch, so a set is marked at its own
    and the level below.  A part that is empty in both says little: its mark is
    joined by the first grams in hash order, of which such sets share one.
    """
    step = -math.log(least)
    sized = side.select(key, _sign(F.col("g")).alias("sign"), F.size("g").alias("n"), F.transform("g", lambda x: F.xxhash64(x)).alias("h"))  # no grams: no level
    own = F.floor(F.log("n") / step + 1e-9)
    levels = sized.withColumn("level", F.explode(F.array(own, own - 1)))
    # The largest pair of a level: a set at its upper end with one 1 / least as large.
    most = F.ceil(F.exp((F.col("level") + 1) * step)) + 1
    rows = levels.withColumn("m", F.floor((1 - least) / least * most + 1e-9) + 1)
    each = rows.select(key, "sign", "level", "m", F.explode("h").alias("h"))
    marks = each.groupBy(key, "sign", "level", "m", F.pmod("h", F.col("m")).alias("part")).agg(F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("h"))).alias("mark"))
    parts = let(F.struct("h", "m"), lambda s: F.array_distinct(F.transform(s["h"], lambda x: F.pmod(x, s["m"]))))
    held = rows.select(key, "sign", "level", "m", parts.alias("held"), F.slice(F.array_sort("h"), F.lit(1), (F.floor((1 - least) * F.col("n") + 1e-9) + 1).cast("int")).alias("ahead"))
    # Outer, for a plain explode makes Spark test the array's size below, and compute it twice.
    empty = held.select(key, "sign", "level", "ahead", F.explode_outer(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), "held")).alias("part"))
    empty = empty.where("part IS NOT NULL").select(key, "sign", "level", "part", F.explode_outer("ahead").alias("gram")).select(key, "sign", "level", "part", F.concat(F.lit("-:"), F.col("gram").cast("string")).alias("mark"))
    return marks.select(key, "sign", "level", "part", "mark").unionByName(empty)


def _rare(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Candidate pairs by the floor((1 - least) * size) + 1 rarest grams of either set, one of which is shared."""
    rows = a.select(F.explode("g").alias("x")).unionByName(b.select(F.explode("g").alias("x"))).groupBy("x").agg(F.count(F.lit(1)).alias("df"))

    def prefix(side: DataFrame, key: str) -> DataFrame:
        exploded = side.select(key, F.size("g").alias("n"), F.explode("g").alias("x")).join(rows, "x")
        w = Window.partitionBy(key).orderBy("df", "x")
        length = F.floor((1 - least) * F.col("n") + 1e-9) + 1
        return exploded.withColumn("r", F.row_number().over(w)).where(F.col("r") <= length).select(key, "x")

    return prefix(a, "a").join(prefix(b, "b"), "x").select("a", "b")


def similar_titles(left: DataFrame, right: DataFrame, least: float = 0.9, n: int = 3, earlier: bool = False) -> DataFrame:
    """Pairs (a, b, similarity) with n-gram Jaccard of at least ``least``; ``earlier``: of those only the ones whose b is less than a.

    Both sides have (id, title); an id has one title.  From BY_PARTS on, sets
    meet where a hashed part of one is the same in the other, so titles that
    merely look alike (one template, one alphabet) do not; below, sets meet by
    their rarest grams.  Either way no pair is missed, and the exact similarity
    is checked afterwards.  Titles without grams are similar to none.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = [cut(side.repartition(tasks, "id").select("id", ngrams("title", n).alias("g"))) for side in ([left] if right is left else [left, right])]  # read three times each
    a, b = sets[0].withColumnRenamed("id", "a"), sets[-1].withColumnRenamed("id", "b")
    met = _met(a, b, least) if least >= BY_PARTS else _rare(a, b, least)
    met = (met.where("b < a") if earlier else met).distinct()
    both = met.join(a.withColumnRenamed("g", "ga"), "a").join(b.withColumnRenamed("g", "gb"), "b")
    shared, sizes = F.size(F.array_intersect("ga", "gb")), F.size("ga") + F.size("gb")  # sets, so their union needs no search
    scored = both.select("a", "b", let(F.struct(shared.alias("n"), sizes.alias("of")), lambda x: F.coalesce(F.try_divide(x["n"], x["of"] - x["n"]), F.lit(0.0))).alias("similarity"))
    return scored.where(F.col("similarity") >= least)


def dedupe_papers(papers: DataFrame, order_col: str = "ord", least: float = 0.9) -> DataFrame:
    """Keeps the ``order_col`` of rows that survive, and names the row each one merged into.

    A DOI merges only with the same DOI.  A row without one merges into the
    first earlier survivor whose title is over ``least`` similar; a later row
    with a DOI never merges into it.  Rows that are similar to no earlier row
    survive at once, and so do the rows of the pair table; only rows with a
    similar row before them are settled in rounds, a round for each link of the
    longest chain of them.  Rounds read the pair table, not the papers.  Rows of
    one title without a DOI fare alike, as a later one meets what the first met
    and the first itself: only the first of each title is compared.
    """
    from ..functions.text import normalize_doi, normalize_title

    # Read for titles, for heads, for copies and for what is alone: normalised once, and not wherever a gram of a title is named.
    rows = cut(papers.select(F.col(order_col).alias("id"), normalize_title("title").alias("title"), normalize_doi("doi").alias("doi")))
    with_doi = rows.where("doi is not null").withColumn("into", F.min("id").over(Window.partitionBy("doi"))).select("id", "title", "into")
    plain = rows.where("doi is null").select("id", "title")
    heads = with_doi.where("id = into").select("id", "title")
    # Copies of a title would meet in all pairs of them; titles without grams are similar to none, not even to their copies.
    one = lambda side: side.where(F.length("title") >= 3).groupBy("title").agg(F.min("id").alias("id")).select("id", "title")
    firsts = cut(one(plain))
    pairs = cut(similar_titles(firsts, one(heads).unionByName(firsts), least, 3, True).where("similarity > " + str(least)).select("a", "b"))
    # 0: open, 1: survives, 2: merged.  What has no similar row before it survives from the start.
    later = pairs.select(F.col("a").alias("id")).distinct().withColumn("state", F.lit(0))
    first = pairs.select(F.col("b").alias("id")).distinct().join(later.select("id"), "id", "left_anti").withColumn("state", F.lit(1))
    state = cut(later.unionByName(first).withColumn("into", F.col("id")))
    while state.where("state = 0").limit(1).count():
        near = pairs.join(state.withColumnRenamed("id", "b"), "b").groupBy("a").agg(
            F.min(F.when(F.col("state") == 1, F.col("b"))).alias("live"), F.min(F.when(F.col("state") == 0, F.col("b"))).alias("open")
        )
        settled = F.when(F.col("live").isNotNull() & (F.col("open").isNull() | (F.col("live") < F.col("open"))), 2).when(F.col("open").isNull(), 1).otherwise(0)
        step = state.join(near.withColumnRenamed("a", "id"), "id", "left")
        now = F.when(F.col("state") != 0, F.col("state")).otherwise(settled)
        state = cut(step.select("id", now.alias("state"), F.when((F.col("state") == 0) & (now == 2), F.col("live")).otherwise(F.col("into")).alias("into")))
    merged = state.where("id <> into").select("id", "into")
    if least < 1:
        copies = plain.join(firsts.withColumnRenamed("id", "first"), "title").where("id > first").select("id", "first").distinct()
        met = copies.join(merged.withColumnRenamed("id", "first"), "first", "left")
        merged = cut(merged.unionByName(met.select("id", F.coalesce("into", "first").alias("into"))))
    alone = heads.select("id").unionByName(plain.select("id")).join(merged.select("id"), "id", "left_anti")
    return with_doi.where("id <> into").select("id", "into").unionByName(merged).unionByName(alone.select("id", F.col("id").alias("into")))


def last_sections(sections: DataFrame, doc: str, heading: str, position: str) -> DataFrame:
    """Of equal headings in a document the last one stays, in its own place."""
    return first_wins(sections, [doc, heading], [F.col(position).desc()])


def intersect_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def subtract_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
