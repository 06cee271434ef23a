"""Operator 2, substring dedup: words covered by a window that also starts in an earlier document.

Prefix-partitioned suffix trees: suffixes are split by a prefix of a few words
into groups that one task can hold; a prefix with too many suffixes is
lengthened to the whole window.  Each group's tree is its sorted suffixes; the
internal nodes of depth ``length`` or more are its repeats, and a repeat is
removed from every document but the one of smallest id.

Only suffixes at content-chosen anchors are shuffled (a fifth of all; no repeat
is missed by that), and only those whose prefix is met with several contexts
carry words (:mod:`.repeats`).

Edge cases: a null text has no words; texts of fewer words than ``length`` keep
all; null ids come after all others; rows that repeat an id with another text are
documents of their own, none earlier than the other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import Search, remove_repeats


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 (and kept_text); ``length`` from 2 to 255 words."""
    out = remove_repeats(docs, Search("word", length, max(1, min(5, length // 2)), other_doc=True), id_col, text_col, with_text)
    return out.withColumnRenamed("n_units", "n_words")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
p AS (SELECT *, string_agg(word, ' ') OVER w AS win, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT win, min(doc_id) AS first FROM p WHERE n = 13 GROUP BY win),
h AS (SELECT p.*, CASE WHEN n = 13 AND first < doc_id THEN 1 ELSE 0 END AS hit FROM p LEFT JOIN m USING (win)),
c AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS opens FROM c)
SELECT d.doc_id, count(word) AS n_words, coalesce(sum(gone), 0)::BIGINT AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id
"""
