"""The queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from curatrix.llm import audit, embeddings, exact, html_text, jaccard, language, leaks, mixing, quality, substring, suffix, warc, whitening


def queries() -> dict:
    return {
        "op1_embeddings": embeddings.op1_embeddings,
        "op2_quality": quality.op2_quality,
        "op3_mixing": mixing.op3_mixing,
        "op4_decontamination": leaks.op4_decontamination,
        "op5_substring": substring.op5_substring,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_language": language.op7_language,
        "op8_html": html_text.op8_html,
        "op9_warc": warc.op9_warc,
        "op10_suffix": suffix.op10_suffix,
        "op11_whitening": whitening.op11_whitening,
        "op12_exact": exact.op12_exact,
        "op13_audit": audit.op13_audit,
        "language_of_pages": language.language_of_pages,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embeddings": embeddings.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op5_substring": substring.OP5_SQL,
        "op6_jaccard": jaccard.OP6_SQL,
        "op9_warc": warc.OP9_SQL,
        "op10_suffix": suffix.OP10_SQL,
        "op12_exact": exact.OP12_SQL,
        "op13_audit": audit.OP13_SQL,
    }
