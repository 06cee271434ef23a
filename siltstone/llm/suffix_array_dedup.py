"""Operator 3, suffix-array dedup: bytes covered by a 100-byte string that starts earlier.

Induced sorting: the contexts that meet in a task are one shard; its suffixes
are classified as smaller or larger than their right neighbours, the substrings
between leftmost-smaller positions are sorted and named, the names are ranked,
and the shard's suffix array is induced in linear time (:mod:`.suffix`).
Permuted common prefixes of ``length`` or more tie equal windows together; all
but the one that starts first are removed.

A suffix array over all bytes of the corpus would shuffle every suffix (eight
bytes and more for each byte of text), so only suffixes at content-chosen
anchors are shuffled, and only contexts whose prefix is met with several
contexts reach a shard; no repeat is missed by that (:mod:`.repeats`).

Edge cases: a null text is empty; texts shorter than ``length`` keep all bytes;
null ids come after all others; rows that repeat an id with another text are
documents of their own, none earlier than the other, with the same text one document;
kept text is decoded with U+FFFD where a removed run cuts a character (the digest
is of the bytes); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import Search, remove_repeats


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text); ``length`` from 16 to 255."""
    out = remove_repeats(docs, Search("byte", length, min(24, length // 2), other_doc=False), id_col, text_col, with_text)
    return out.withColumnRenamed("n_units", "n_bytes")


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
u AS (SELECT doc_id, n, x, unnest(range(1, n + 1)) AS pos FROM t),
p AS (SELECT doc_id, pos, substr(x, 2 * pos - 1, 2) AS b, CASE WHEN pos <= n - 99 THEN md5(substr(x, 2 * pos - 1, 200)) END AS win FROM u),
m AS (SELECT win, min((doc_id, pos)) AS first FROM p WHERE win IS NOT NULL GROUP BY win),
h AS (SELECT doc_id, pos, b, CASE WHEN first < (doc_id, pos) THEN 1 ELSE 0 END AS hit FROM p LEFT JOIN m USING (win)),
c AS (SELECT *, max(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM h),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 AS opens FROM c)
SELECT d.doc_id, count(b) AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
       sha256(unhex(coalesce(string_agg(b, '' ORDER BY pos) FILTER (WHERE gone = 0), ''))) AS kept_sha256
FROM documents d LEFT JOIN e USING (doc_id) GROUP BY d.doc_id
"""
