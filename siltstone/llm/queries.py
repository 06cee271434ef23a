"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op4_bpe
from .clustered_layout import OP11_SQL, op11_clustered_layout
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .html_extract import op6_html_extract
from .importance_resampling import OP12_SQL, op12_importance_resampling
from .license_scan import OP1_SQL, op1_license_scan
from .mixing import op8_mixing
from .quality_rules import op5_quality_rules
from .secret_scan import OP10_SQL, op10_secret_scan
from .sentence_pieces import op13_sentencepiece
from .simhash import op9_simhash
from .substring_dedup import OP2_SQL, op2_substring_dedup
from .suffix_array_dedup import OP3_SQL, op3_suffix_array_dedup

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_extract": op6_html_extract,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_secret_scan": op10_secret_scan,
    "op11_clustered_layout": op11_clustered_layout,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE = {
    "op1_license_scan": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_suffix_array_dedup": OP3_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op10_secret_scan": OP10_SQL,
    "op11_clustered_layout": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
}

if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
