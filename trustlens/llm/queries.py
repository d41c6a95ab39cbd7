"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from trustlens.llm.kd_shards import op7_kd_shards
from trustlens.llm.collocations import ORACLE as COLLOCATIONS_ORACLE
from trustlens.llm.collocations import op12_collocations
from trustlens.llm.importance import ORACLE as IMPORTANCE_ORACLE
from trustlens.llm.importance import op11_importance
from trustlens.llm.line_dedup import ORACLE as LINES_ORACLE
from trustlens.llm.line_dedup import op13_line_dedup
from trustlens.llm.lm import op2_lm_scores
from trustlens.llm.ngram_jaccard import op6_ngram_jaccard
from trustlens.llm.packing import op10_packing
from trustlens.llm.pii import op3_pii
from trustlens.llm.quality_mcd import op5_quality
from trustlens.llm.reputation import op9_url_reputation
from trustlens.llm.reputation import oracle_sql as reputation_sql
from trustlens.llm.tiling import op1_decontaminate
from trustlens.llm.token_files import op4_token_files
from trustlens.llm.warc import ORACLE as WARC_ORACLE
from trustlens.llm.warc import op8_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_lm_scores": op2_lm_scores,
    "op3_pii": op3_pii,
    "op4_token_files": op4_token_files,
    "op5_quality": op5_quality,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_kd_shards": op7_kd_shards,
    "op8_warc": op8_warc,
    "op9_url_reputation": op9_url_reputation,
    "op10_packing": op10_packing,
    "op11_importance": op11_importance,
    "op12_collocations": op12_collocations,
    "op13_line_dedup": op13_line_dedup,
}

#: the other queries' methods are not SQL; their tests hold them against brute force
ORACLE_SQL: dict[str, str] = {"op8_warc": WARC_ORACLE, "op9_url_reputation": reputation_sql(), "op11_importance": IMPORTANCE_ORACLE,
                              "op12_collocations": COLLOCATIONS_ORACLE, "op13_line_dedup": LINES_ORACLE}
