"""Entity-relation graphs: statistics, fusion, links between topics, gaps."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .resolve import first_wins


def graph_statistics(materials: DataFrame, properties: DataFrame, syntheses: DataFrame, relations: DataFrame) -> DataFrame:
    """A4: one row of counts and distinct counts."""
    m = materials.agg(F.count(F.lit(1)).alias("materials"))
    p = properties.agg(F.count(F.lit(1)).alias("properties"), F.countDistinct("property_name").alias("unique_property_types"))
    s = syntheses.agg(F.count(F.lit(1)).alias("syntheses"), F.countDistinct("method").alias("unique_methods"))
    r = relations.agg(F.count(F.lit(1)).alias("relations"))
    return m.crossJoin(p).crossJoin(s).crossJoin(r)  # four single rows


def property_matrix(properties: DataFrame, entity: str, prop: str) -> DataFrame:
    """A5: entity -> sorted set of its properties."""
    return properties.groupBy(F.lower(entity).alias("entity")).agg(F.array_sort(F.collect_set(prop)).alias("properties"))


def fuse(left: DataFrame, right: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """E5: union of two graphs' rows; the left row of a key wins, then the earlier one."""
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return first_wins(both, keys, [F.col("_side"), *[F.col(o) for o in order]]).drop("_side")


def fuse_sets(left: DataFrame, right: DataFrame, key: str, items: str) -> DataFrame:
    """E5 (materials, papers): union of the item arrays of a key."""
    both = left.select(key, F.explode(items).alias("_i")).unionByName(right.select(key, F.explode(items).alias("_i")))
    return both.groupBy(key).agg(F.array_sort(F.collect_set("_i")).alias(items))


def containment_links(entities: DataFrame, group: str, name: str, least: int = 3) -> DataFrame:
    """(group_a, group_b, key) of entities of two groups that are equal or contain one another.

    The contained name is at least ``least`` characters long, so each of its
    windows of that many characters lies in the other name as well: names join on
    the rarest of them instead of all pairs, and the containment is checked
    afterwards.  A window that most names hold is no key unless nothing rarer is.
    """
    # Distinct names first: a name met in many groups is compared once.
    names = entities.select(F.col(name).alias("k")).distinct().where(F.length("k") > 0)
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("k") - (least - 1)), lambda i: F.col("k").substr(i, F.lit(least))))).alias("g")
    bodies = names.where(F.length("k") >= least).select(F.col("k").alias("outer"), grams)
    held = bodies.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    head = bodies.join(held, "g").groupBy(F.col("outer").alias("inner")).agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    inside = bodies.join(head, "g").where(F.expr("contains(outer, inner)")).select("inner", "outer").distinct()
    short = names.where(F.length("k") < least).select(F.col("k").alias("inner"), F.col("k").alias("outer"))
    inside = inside.unionByName(short)
    at = entities.select(F.col(group).alias("grp"), F.col(name).alias("k")).distinct()
    a = at.select(F.col("grp").alias("g1"), F.col("k").alias("inner"))
    b = at.select(F.col("grp").alias("g2"), F.col("k").alias("outer"))
    linked = inside.join(a, "inner").join(b, "outer").where("g1 <> g2")
    return linked.select(F.least("g1", "g2").alias("group_a"), F.greatest("g1", "g2").alias("group_b"), F.col("inner").alias("key")).distinct()


def link_strength(links: DataFrame, evidence: DataFrame, group: str, name: str, item: str) -> DataFrame:
    """Evidence of each link and its band: four or more high, two or more medium."""
    e = evidence.select(F.col(group).alias("grp"), F.col(name).alias("key"), F.col(item).alias("item")).distinct()
    # Items of both groups less those that both have: no item is copied to each link of its group.
    sizes = e.groupBy("grp", "key").agg(F.count("item").alias("n"))
    several = e.where("item is not null").groupBy("key", "item").agg(F.collect_set("grp").alias("grps")).where(F.size("grps") > 1)
    one = several.select("key", "grps", F.explode("grps").alias("one"))
    shared = one.select("key", "one", F.explode("grps").alias("two")).where("one < two").groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("n_both"))
    n = links.select("group_a", "group_b", "key").distinct()
    for side in ("a", "b"):
        n = n.join(sizes.select(F.col("grp").alias(f"group_{side}"), "key", F.col("n").alias(f"n_{side}")), [f"group_{side}", "key"], "left")
    n = n.where("n_a is not null or n_b is not null").withColumns({"one": F.least("group_a", "group_b"), "two": F.greatest("group_a", "group_b")}).join(shared, ["key", "one", "two"], "left")
    same = F.when(F.col("group_a") == F.col("group_b"), F.col("n_b"))
    total = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0)) - F.coalesce(same, "n_both", F.lit(0))
    n = n.select("group_a", "group_b", "key", total.alias("n_evidence"))
    return n.withColumn("strength", F.when(F.col("n_evidence") >= 4, "high").when(F.col("n_evidence") >= 2, "medium").otherwise("low"))


#: Properties of a structure in a block, and pairs that a task makes.
BLOCK_PROPS, TASK_PAIRS = 1024, 1 << 23


def unexplored_pairs(members: DataFrame, known: DataFrame, entity: str, structure: str, prop: str, asked: DataFrame | None = None) -> DataFrame:
    """Properties known for another entity of the same structure but not for this one; ``asked``: only for these entities.

    For all entities the result has a row for each missing pair: :func:`unexplored_counts` counts them without making them.
    Properties lie in blocks by their hash, those of a structure and those of an entity alike: an entity's blocks meet the
    structure's and what it has is taken out there, so pairs are made last and not shuffled.  Only pairs of entities of
    several structures are, for two of those may give the same one.
    """
    have = known.select(entity, prop).distinct()
    of = members.select(entity, structure).distinct()
    of_structure = cut(of.join(have, entity).select(structure, prop).distinct())
    of = of if asked is None else of.join(asked.select(entity).distinct(), entity, "left_semi")
    several = F.count(F.lit(1)).over(Window.partitionBy(entity)) > 1
    of = cut(of.where(F.col(structure).isNotNull()).withColumn("_several", several))
    sizes = of_structure.groupBy(structure).agg(F.count(F.lit(1)).alias("_n"))
    told = of.groupBy(structure).agg(F.count(F.lit(1)).alias("_e")).join(sizes, structure).agg(F.max("_n").alias("n"), F.sum(F.col("_n").cast("double") * F.col("_e")).alias("pairs")).first()
    n_blocks = max(math.ceil((told["n"] or 0) / BLOCK_PROPS), 1)
    tasks = int(min(max((told["pairs"] or 0) / TASK_PAIRS, int(of.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 100_000))
    block = F.pmod(F.xxhash64(prop), F.lit(n_blocks)).cast("int")
    every = F.transform(F.collect_list(F.struct(prop)), lambda x: x[prop])  # nulls as well, which a list of values leaves out
    theirs = of_structure.groupBy(structure, block.alias("_b")).agg(every.alias("_all"))
    own = have.join(of.select(entity).distinct(), entity, "left_semi").groupBy(entity, block.alias("_b")).agg(every.alias("_own"))
    # A block with all entities of a structure is dealt over as many tasks as its share asks for.
    deals = max(math.ceil(tasks * 4 / n_blocks), 1)
    deal = F.pmod(F.xxhash64(entity), F.lit(deals)).cast("int")
    rows = of.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(own, [entity, "_b"], "left").withColumn("_d", deal)
    rows = rows.repartition(tasks, structure, "_b", "_d")
    theirs = theirs.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    none = F.array().cast(own.schema["_own"].dataType)
    out = rows.join(theirs, [structure, "_b", "_d"]).select(entity, "_several", F.explode(F.array_except("_all", F.coalesce("_own", none))).alias(prop))
    alone, shared = out.where("not _several").drop("_several"), out.where("_several").drop("_several").distinct()
    return alone.unionByName(shared) if not of.where("_several").isEmpty() else alone


def unexplored_counts(members: DataFrame, known: DataFrame, entity: str, structure: str, prop: str) -> DataFrame:
    """J12 counted: (entity, n, total): how many properties of its structure an entity lacks, and their sum (of a numeric property).

    What a structure has less what the entity has: no pair is made.  An entity belongs to one structure.
    """
    have = known.select(entity, prop).distinct()
    of = members.select(entity, structure).distinct()
    of_structure = of.join(have, entity).select(structure, prop).distinct().groupBy(structure).agg(F.count(F.lit(1)).alias("_all"), F.sum(prop).alias("_sum"))
    own = have.groupBy(entity).agg(F.count(F.lit(1)).alias("_own"), F.sum(prop).alias("_part"))
    out = of.join(of_structure, structure).join(own, entity, "left").na.fill(0, ["_own", "_part"])
    return out.select(entity, (F.col("_all") - F.col("_own")).alias("n"), (F.col("_sum") - F.col("_part")).alias("total"))


def bridges(facts: DataFrame, entity: str, prop: str, first: str, second: str) -> DataFrame:
    """Entities that occur with both properties."""
    names = facts.select(entity).distinct()
    one = facts.where(F.col(prop) == first).select(entity)
    two = facts.where(F.col(prop) == second).select(entity)
    return names.join(one, entity, "left_semi").join(two, entity, "left_semi")


def strong_relations(gaps: DataFrame, relations: DataFrame, gap: str, order: list[str], least: float = 0.6, n: int = 8) -> DataFrame:
    """Each gap beside the strongest relations.  The n strongest are the same for all gaps and at most n rows, so they are broadcast."""
    best = relations.where(F.col("confidence") > least).orderBy(F.col("confidence").desc(), *order).limit(n)
    return gaps.select(gap).crossJoin(F.broadcast(best))


#: Names whose windows are broadcast to the texts; with more of them, texts and names meet by a shuffle of windows.
BROADCAST_NAMES = 100_000


def _windows(c: Column, width: int) -> Column:
    """All windows of so many characters, in one pass (``substr`` would count from the start for each)."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def _held(low: DataFrame, names: list[str]) -> DataFrame:
    """_id, held: for each text (_id, _text) the places in ``names`` of those that its words contain; names have no blank."""
    place = {k: i for i, k in enumerate(names)}
    starts = {k[:n] for k in names for n in range(1, len(k) + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=100_000)
        def inside(word: str) -> frozenset[int]:
            found = set()
            for i in range(len(word)):
                n = i + 1
                while n <= len(word) and (w := word[i:n]) in starts:
                    if w in place:
                        found.add(place[w])
                    n += 1
            return frozenset(found)

        for b in batches:
            held = [sorted(frozenset().union(*map(inside, set(text.split(" "))))) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.list_(pa.int32()))], ["_id", "held"])

    return low.select("_id", "_text").mapInArrow(run, T.StructType([low.schema["_id"], T.StructField("held", T.ArrayType(T.IntegerType()))]))


def named_in(texts: DataFrame, id_col: str, text_col: str, names: DataFrame, name: str) -> DataFrame:
    """(id, name): the texts that contain a name in either case, as a word, a part of one or several words.

    A name without a blank lies in a single word (between two blanks) of a text, so the distinct words of a text are
    looked at, each word's names being known after it was met once; a text gives its names as one row and no pair is
    shuffled unless ids repeat.  The others, and all if there are more than BROADCAST_NAMES, look by windows
    (:func:`_named_by_windows`).  Texts and names that are null or empty, and null ids, name nothing; repeated ones count once.
    """
    low = texts.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_text")).where("_id is not null and _text <> ''")
    keys = names.select(F.col(name).alias("name"), F.lower(name).alias("k")).where("name <> ''").distinct()
    words = keys.where(~F.contains("k", F.lit(" ")))
    listed = [r["k"] for r in words.select("k").distinct().orderBy("k").limit(BROADCAST_NAMES + 1).collect()]
    if not listed or len(listed) > BROADCAST_NAMES:
        return _named_by_windows(low, keys)
    spark = texts.sparkSession
    at = F.broadcast(spark.createDataFrame(list(enumerate(listed)), "place int, k string").join(words, "k").select("place", "name"))
    found = _held(low, listed).select(F.col("_id").alias("id"), F.explode("held").alias("place")).join(at, "place").select("id", "name")
    ids = texts.select(F.col(id_col).alias("_id")).where("_id is not null")
    if not ids.groupBy("_id").count().where("count > 1").isEmpty():
        found = found.distinct()
    phrases = keys.where(F.contains("k", F.lit(" ")))
    return found if phrases.isEmpty() else found.unionByName(_named_by_windows(low, phrases))


def _named_by_windows(low: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, name) of texts (_id, _text) and names (name, k) in lower case.

    Each name looks for its rarest window of three characters (rarest among names; a shorter name for itself) in the
    windows of a text; only ids and names meet there, and the texts join the candidates by id, where containment is
    checked.
    """
    grams = keys.select("name", "k", F.explode(F.when(F.length("k") < 3, F.array("k")).otherwise(F.array_distinct(_windows(F.col("k"), 3)))).alias("g"))
    held = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    head = grams.join(held, "g").groupBy("name", "k").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    size = head.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(F.length("g")), F.lit(3)).alias("least")).first()
    widths = range(min(size["least"], 3), 4)  # windows of one or two characters only where a name is as short
    at = low.select("_id", F.explode(F.array_distinct(F.concat(*[_windows(F.col("_text"), w) for w in widths]))).alias("g"))
    met = at.join(F.broadcast(head) if size["n"] <= BROADCAST_NAMES else head, "g").select(F.col("_id").alias("id"), "name", "k")
    return met.join(low, (F.col("id") == F.col("_id")) & F.contains("_text", "k")).select("id", "name").distinct()


def either_holds(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """(a, b): pairs of names of which one contains the other, in either case; null and empty ones never."""
    one = named_in(left.select(a).distinct(), a, a, right.select(b).distinct(), b).select(F.col("id").alias(a), F.col("name").alias(b))
    two = named_in(right.select(b).distinct(), b, b, left.select(a).distinct(), a).select(F.col("name").alias(a), F.col("id").alias(b))
    return one.unionByName(two).distinct()


def evidence_or_topic(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Entities (entity, topic) with the sorted distinct items of evidence (entity, item), else those of their topic; from_topic says which.

    An entity of several topics has a row for each; one without evidence in a topic without any gets an empty set.
    """
    sets = evidence.where("item is not null").groupBy("entity").agg(F.array_sort(F.collect_set("item")).alias("_own"))
    rows = entities.distinct().join(sets, "entity", "left")
    # Sets of items are merged, not their rows: a topic's set holds each item once.
    topics = rows.select("topic", F.explode("_own").alias("item")).groupBy("topic").agg(F.array_sort(F.collect_set("item")).alias("_all"))
    none = F.array().cast(sets.schema["_own"].dataType)
    return rows.join(topics, "topic", "left").select("entity", "topic", F.coalesce("_own", "_all", none).alias("evidence"), F.col("_own").isNull().alias("from_topic"))


def cooccurrence(paragraphs: DataFrame, names: DataFrame, words: DataFrame) -> DataFrame:
    """Name -> sorted set of words that share a paragraph with it.

    paragraphs (pid, tokens): both sides join on tokens, not by containment in
    every paragraph.
    """
    at = paragraphs.select("pid", F.explode(F.array_distinct("tokens")).alias("t"))
    n = at.join(names.select(F.col("name").alias("t")).distinct(), "t").select("pid", F.col("t").alias("name"))
    w = at.join(words.select(F.col("word").alias("t")).distinct(), "t").select("pid", F.col("t").alias("word"))
    return n.join(w, "pid").groupBy("name").agg(F.array_sort(F.collect_set("word")).alias("words"))
