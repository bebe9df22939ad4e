"""Queries of the operators in this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from webloom.llm.bpe import op3_bpe_encoding
from webloom.llm.chat import OP13_SQL, op13_chat_formatting
from webloom.llm.chroma import op1_chroma_fingerprints
from webloom.llm.divergence import OP11_SQL, op11_source_divergence
from webloom.llm.jaccard import OP9_SQL, op9_ngram_jaccard_join
from webloom.llm.resampling import OP12_SQL, op12_importance_resampling
from webloom.llm.rules import op8_quality_classifier
from webloom.llm.secrets import op7_secret_scans
from webloom.llm.substring import OP6_SQL, op6_substring_dedup
from webloom.llm.suffix_array import OP2_SQL, op2_suffix_array_dedup
from webloom.llm.token_counts import op10_token_counts
from webloom.llm.warc import op4_warc_derivatives
from webloom.llm.winnowing import OP5_SQL, op5_benchmark_decontamination


def queries() -> dict:
    return {
        "op1_chroma_fingerprints": op1_chroma_fingerprints,
        "op2_suffix_array_dedup": op2_suffix_array_dedup,
        "op3_bpe_encoding": op3_bpe_encoding,
        "op4_warc_derivatives": op4_warc_derivatives,
        "op5_benchmark_decontamination": op5_benchmark_decontamination,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_secret_scans": op7_secret_scans,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
        "op10_token_counts": op10_token_counts,
        "op11_source_divergence": op11_source_divergence,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_chat_formatting": op13_chat_formatting,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_array_dedup": OP2_SQL,
        "op5_benchmark_decontamination": OP5_SQL,
        "op6_substring_dedup": OP6_SQL,
        "op9_ngram_jaccard_join": OP9_SQL,
        "op11_source_divergence": OP11_SQL,
        "op12_importance_resampling": OP12_SQL,
        "op13_chat_formatting": OP13_SQL,
    }
