"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .exact_dedup import OP3_SQL, op3_exact_dedup
from .line_dedup import OP10_SQL, op10_line_dedup
from .lm_scoring import op8_lm_scoring
from .near_dedup import op6_minhash_near_dedup
from .packing import op7_best_fit_packing
from .pieces import op4_sentencepiece
from .quality_rules import op2_quality_rules
from .suffix_dedup import op1_suffix_dedup
from .url_filters import OP9_SQL, op9_url_filters
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_warc": op5_warc,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_url_filters": op9_url_filters,
    "op10_line_dedup": op10_line_dedup,
}

SQL = {
    "op3_exact_dedup": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op9_url_filters": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
}
