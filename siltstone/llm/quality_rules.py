"""Operator 5, quality rules: weak supervision over abstaining rules (native).

Every rule looks at a few counts of a text and votes good (+1), bad (-1) or
abstains (0).  Expectation-maximisation over the table of vote patterns (at
most 3 ** rules rows, whatever the corpus size) estimates how each rule votes on
good and on bad texts, and the posterior probability of good quality replaces
an all-rules-must-pass filter.  Counting is one narrow pass of built-in
expressions; no text is shuffled, and the narrow table of counts is cached, so the
estimate and the verdict read the same rows.

Edge cases: a null or empty text has no words and fails the base rule; null ids
are kept as they are; repeated rows are judged alike; an empty table fits
nothing and gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, keep, let, only, strip_spaces, text_or_empty

#: Frequent short words of the corpus languages, as written in running text.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "that", "is", "with", "for", "this",
    "de", "la", "le", "les", "et", "des", "que", "du", "un", "une",
    "der", "die", "und", "das", "den", "nicht", "von", "ein", "mit", "zu",
    "el", "los", "en", "y", "se", "por", "las", "del", "no", "una",
]
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    same = lambda a, b: (
        (a["h"] == b["h"])
        & (F.get(words, a["i"]) == F.get(words, b["i"]))
        & (F.get(words, a["i"] + 1) == F.get(words, b["i"] + 1))
        & (F.get(words, a["i"] + 2) == F.get(words, b["i"] + 2))
    )

    def covered(starts: Column) -> Column:
        # Starts are sorted: a window adds what the one before it did not cover.
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step)["n"]

    def repeated(sorted_windows: Column) -> Column:
        near = lambda x, i, d: F.coalesce(same(x, F.get(sorted_windows, i + d)), F.lit(False))
        hit = F.filter(sorted_windows, lambda x, i: near(x, i, -1) | near(x, i, 1))
        return covered(F.sort_array(F.transform(hit, lambda x: x["i"])))

    def count(hashes: Column) -> Column:
        indexed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(indexed), repeated))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules look at, one row per document, in one narrow pass."""
    text = text_or_empty(text_col)
    words = F.filter(F.split(F.col("_text"), SPACE_CLASS + "+"), lambda w: w != "")
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ended = lambda x: F.right(F.rtrim(x), F.lit(1)).isin(".", "!", "?")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    rows = rows.select(
        "doc_id",
        F.length(strip_spaces(F.col("_text"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        )).alias("_w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, ended)).cast("long").alias("n_ended"),
        )).alias("_l"),
    )
    return rows.select(
        "doc_id", "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words",
        "_w.n_stop", "n_upper", "_l.n_lines", "_l.n_ended",
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rule_votes() -> dict[str, Column]:
    """Each rule's vote on a row of :func:`text_counts`; ratios are written as products, so nothing divides by zero."""
    n, c = F.col("n_words"), F.col("word_chars")
    return {
        "length": _vote(n >= 100, n < MIN_WORDS),
        "word_length": _vote((10 * c >= 35 * n) & (10 * c <= 66 * n), (c < 3 * n) | (c > 7 * n)),
        "symbols": _vote(F.col("n_symbols") == 0, 10 * F.col("n_symbols") > n),
        "same_lines": _vote(F.col("n_dup_lines") <= 1, 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": _vote(10 * F.col("n_repeat_words") <= n, 10 * F.col("n_repeat_words") > 3 * n),
        "stop_words": _vote(100 * F.col("n_stop") >= 6 * n, 100 * F.col("n_stop") < 3 * n),
        "capitals": _vote(100 * F.col("n_upper") <= 6 * c, 10 * F.col("n_upper") > 3 * c),
        "line_ends": _vote(10 * F.col("n_ended") >= 9 * F.col("n_lines"), 2 * F.col("n_ended") < F.col("n_lines")),
    }


@dataclass
class VoteModel:
    """Probability of good, and of each rule's votes (-1, 0, 1) on good and bad texts."""

    rules: list[str]
    good: float
    table: dict[str, list[dict[int, float]]]  # rule -> [on bad, on good]

    def log_odds(self, rule: str, vote: int) -> float:
        bad, good = self.table[rule]
        return math.log(good[vote] / bad[vote])

    def posterior(self, votes: dict[str, Column]) -> Column:
        """P(good | votes): one term per rule and vote, plain column arithmetic."""
        total = F.lit(math.log(self.good / (1 - self.good)))
        for rule in self.rules:
            by = {v: F.lit(self.log_odds(rule, v)) for v in (-1, 0, 1)}
            total = total + F.when(votes[rule] < 0, by[-1]).when(votes[rule] > 0, by[1]).otherwise(by[0])
        return 1 / (1 + F.exp(-total))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], rules: list[str], iterations: int = 50, smoothing: float = 1.0) -> VoteModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from rules that are right four times in five, and a good vote
    stays at least as likely on good texts as on bad ones, so the two classes
    can't change places.  No pattern at all (an empty table) leaves the start.
    """
    patterns = sorted(patterns)
    start = [{-1: 0.6, 0: 0.25, 1: 0.15}, {-1: 0.05, 0: 0.25, 1: 0.7}]
    model = VoteModel(rules, 0.8, {r: [dict(x) for x in start] for r in rules})
    total = sum(n for _, n in patterns)
    for _ in range(iterations if total else 0):
        weights = []
        for votes, _n in patterns:
            s = math.log(model.good / (1 - model.good)) + sum(model.log_odds(r, v) for r, v in zip(rules, votes, strict=True))
            weights.append(1 / (1 + math.exp(-max(-500.0, min(500.0, s)))))
        mass = [sum(n * (1 - w) for (_, n), w in zip(patterns, weights, strict=True)), sum(n * w for (_, n), w in zip(patterns, weights, strict=True))]
        for k, rule in enumerate(rules):
            for y in (0, 1):
                seen = {v: smoothing * start[y][v] for v in (-1, 0, 1)}
                for (votes, n), w in zip(patterns, weights, strict=True):
                    seen[votes[k]] += n * (w if y else 1 - w)
                model.table[rule][y] = {v: seen[v] / (mass[y] + smoothing) for v in seen}
            bad, good = model.table[rule]
            if good[1] < bad[1]:
                both = {v: (good[v] + bad[v]) / 2 for v in good}
                model.table[rule] = [dict(both), both]
        model.good = min(0.999, max(0.001, mass[1] / total))
    return model


#: Least probability of being good: a text goes only if bad is a thousand times as likely.  The rules are not independent
#: given the class (votes on length, lines and repeats go together), so posteriors are too extreme and 0.5 costs good texts
#: without catching one more bad one; README has the figures by labels.
THRESHOLD = 0.001


def judge(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """base_failed, p_good and kept beside the counts; the model is fitted on all rows of ``counts``."""
    votes = rule_votes()
    rules = list(votes)
    voted = counts.select(*[v.alias(k) for k, v in votes.items()]).groupBy(*rules).count()
    patterns = [(tuple(r[k] for k in rules), r["count"]) for r in voted.collect()]  # 3 ** 8 rows at most
    model = fit_votes(patterns, rules)
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n)
    return counts.withColumns({"base_failed": failed, "p_good": F.round(model.posterior(votes), 9)}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)
    )


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    counts = keep(text_counts(docs, id_col, text_col))
    return judge(counts, threshold)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that pass, with all their columns; rows that repeat an id are judged together (one bad row drops them)."""
    verdict = score_quality(docs, id_col, text_col).groupBy("doc_id").agg(F.min("kept").alias("_kept")).where("_kept")
    return only(docs, verdict.select("doc_id"), id_col)


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
