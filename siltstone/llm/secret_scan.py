"""Operator 10, secret scans: patterns, then corpus-wide ownership (native).

Spans come from built-in expressions alone: a text is split at a pattern, and
the lengths of the pieces and of the matches give every start and end in code
points.  Values of all spans are hashed and counted over the corpus by distinct
repositories and owners.  A value that many owners share, or that many
repositories hold whoever owns them, is a copied example; a value that few
owners hold in few repositories looks live.  Spans of the further kinds are
reported only when they look live; base spans always stay.

Only spans are shuffled, never texts: (hash, owner, repository) is pre-aggregated
before the shuffle, and a hot value is split by adaptive execution when the
counts are joined back.

Edge cases: null and empty texts have no spans; a null owner counts as one owner
of its own; repeated rows get the same result; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, let, spread_join, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: kind, pattern, group whose length counts and whose text is the value, least length, substrings one of which each match holds (lower case).
BASE = [
    ("assign", ASSIGN, 2, 8, ["password", "passwd", "secret", "token", "apikey", "api_key"]),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, ["akia"]),
    ("hex", r"[0-9a-f]{32,}", 0, 32, []),
]
#: Kinds that the method adds when they look live.
FURTHER = [
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40, ["gho_", "ghp_", "ghs_", "ghu_", "ghr_"]),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 25, ["xox"]),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39, ["aiza"]),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24, ["k_live_"]),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36, ["eyj"]),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}", 0, 80, ["private key"]),
    ("url_password", r"://[A-Za-z0-9._%+-]+:([A-Za-z0-9._%+!$*-]{8,})@", 1, 8, ["://"]),
]
#: A value that looks live has this many owners and repositories at most.
MAX_OWNERS, MAX_REPOS = 3, 8
KINDS = [k[0] for k in BASE + FURTHER]
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def find_spans(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches whose group has ``least`` or more characters, as an array of (start, rank, end, value)."""

    def placed(pieces: Column) -> Column:
        whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        rows = F.arrays_zip(F.slice(F.transform(pieces, lambda x: F.length(x)), 1, F.size(pieces) - 1).alias("gap"), whole.alias("whole"), part.alias("part"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["pos"] + x["gap"]
            end = start + F.length(x["whole"])
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["part"].alias("value"))
            return F.struct(end.alias("pos"), F.when(F.length(x["part"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("out"))
        return F.when(F.size(pieces) > 1, F.aggregate(rows, start, step)["out"]).otherwise(F.array().cast(SPAN))

    return let(F.split(text, pattern, -1), placed)


def _all_spans(text: Column, lower: Column, kinds: list, first: int) -> Column:
    found = []
    for k, (_, pattern, group, least, needs) in enumerate(kinds):
        spans = find_spans(text, first + k, pattern, group, least)
        if needs:  # a substring test is far cheaper than the pattern
            holds = F.lit(False)
            for x in needs:
                holds = holds | lower.contains(x)
            spans = F.when(holds, spans).otherwise(F.array().cast(SPAN))
        found.append(spans)
    return F.concat(*found)


def _spell(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per document: counts and digest of the base spans, all spans, and how many of them look live or are widely copied.

    ``owner_col`` and ``repo_cols`` name the owner and the repository of a row;
    a value held by at most ``max_owners`` owners in at most ``max_repos``
    distinct repositories looks live.
    """
    text = F.col("_text")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.xxhash64(*[F.col(c) for c in repo_cols]).alias("repo"), text_or_empty(text_col).alias("_text"),
    )
    lower = F.lower(text)
    rows = rows.select(
        "doc_id", "owner", "repo",
        _all_spans(text, lower, BASE, 0).alias("base"), _all_spans(text, lower, FURTHER, len(BASE)).alias("further"),
    )
    # Values leave as digests: the cached table holds no secret.
    hide = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value")))
    rows = rows.select("doc_id", "owner", "repo", hide(F.col("base")).alias("base"), hide(F.col("further")).alias("further"))
    rows = keep(rows).withColumn("key", F.sha2(F.concat_ws("|", _spell(F.col("base")), _spell(F.col("further")), "owner"), 256))
    spans = rows.where((F.size("base") > 0) | (F.size("further") > 0)).select(
        "doc_id", "owner", "repo", "key", F.explode(F.concat("base", "further")).alias("s")
    ).select("doc_id", "owner", "repo", "key", "s", F.col("s.value").alias("value"))
    held = (
        spans.groupBy("value", "owner", "repo").count()
        .groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    )
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = spread_join(spans, held, ["value"], "inner").groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(
        F.collect_set(F.when(live, F.col("s"))).alias("live"), F.collect_set(F.when(~live, F.col("s"))).alias("copied")
    )
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    out = rows.join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(
        "doc_id", "base", F.coalesce("live", none).alias("live"), F.coalesce("copied", none).alias("copied")
    )
    added = F.filter("live", lambda s: s["rank"] >= len(BASE))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_spell(F.col("base")), 256).alias("base_sha256"), _spell(F.concat("base", added)).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("copied").cast("long").alias("n_copied"),
    )


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_spans(rank: int, pattern: str, group: int, least: int) -> str:
    """A list of spans in SQL; letters of the first pattern in either case are spelled out, for RE2 folds more than ASCII."""
    if pattern.startswith("(?i)"):
        head, tail = pattern[4:].split(")", 1)
        pattern = re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head) + ")" + tail
    quoted = "'" + pattern.replace("'", "''") + "'"
    length = "coalesce(list_sum(list_transform({0}, lambda y: length(y))), 0)"
    start = f"({length.format(f'string_split_regex(text, {quoted})[1:i]')} + {length.format(f'regexp_extract_all(text, {quoted})[1:i - 1]')})::INT"
    rows = f"""list_transform(range(1, len(regexp_extract_all(text, {quoted})) + 1), lambda i: {{'start': {start}, 'rank': {rank},
      'end': ({start} + length(regexp_extract_all(text, {quoted})[i]))::INT, 'value': regexp_extract_all(text, {quoted}, {group})[i]}})"""
    return f"list_filter({rows}, lambda z: length(z['value']) >= {least})"


def _sql() -> str:
    lists = lambda kinds, first: "list_concat(" + ", ".join(_sql_spans(first + k, p, g, n) for k, (_, p, g, n, _) in enumerate(kinds)) + ")"
    spell = "list_transform(list_sort({0}), lambda z: (" + repr(KINDS) + ")[z['rank'] + 1] || ':' || z['start'] || ':' || z['end'])"
    text = lambda x: f"coalesce(array_to_string({spell.format(x)}, ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, {{'source': source, 'lang': lang}} AS repo, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, owner, repo, {lists(BASE, 0)} AS base, {lists(FURTHER, len(BASE))} AS further FROM d),
v AS (SELECT doc_id, owner, repo, unnest(list_concat(base, further)) AS z FROM s),
o AS (SELECT z['value'] AS value, count(DISTINCT owner) AS owners, count(DISTINCT repo) AS repos FROM v GROUP BY 1),
j AS (SELECT doc_id, list(DISTINCT z) FILTER (WHERE owners <= {MAX_OWNERS} AND repos <= {MAX_REPOS}) AS live, list(DISTINCT z) FILTER (WHERE owners > {MAX_OWNERS} OR repos > {MAX_REPOS}) AS copied FROM v JOIN o ON z['value'] = o.value GROUP BY doc_id)
SELECT s.doc_id, len(list_filter(base, lambda z: z['rank'] = 0)) AS n_assign, len(list_filter(base, lambda z: z['rank'] = 1)) AS n_access, len(list_filter(base, lambda z: z['rank'] = 2)) AS n_hex,
       sha256({text("base")}) AS base_sha256, {text("list_concat(base, list_filter(coalesce(live, []), lambda z: z['rank'] >= 3))")} AS spans,
       coalesce(len(live), 0) AS n_live, coalesce(len(copied), 0) AS n_copied
FROM s LEFT JOIN j USING (doc_id)
"""


OP10_SQL = _sql()
