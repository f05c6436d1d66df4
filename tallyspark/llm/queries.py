"""The operators' registered queries and their SQL."""

from __future__ import annotations

from . import (ann, chat, decontaminate, exact_dedup, html_text, language, line_dedup, ngram_join, packing, phrases, quality,
               token_files, vector_codes)
from .oracle import ORACLE  # noqa: F401

QUERIES = {
    "op1_language": language.op1_language,
    "op2_token_files": token_files.op2_token_files,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_html_text": html_text.op5_html_text,
    "op6_chat": chat.op6_chat,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_nearest_vectors": ann.op9_nearest_vectors,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_phrases": phrases.op11_phrases,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
