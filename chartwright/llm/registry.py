"""The queries of this package and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartwright.llm import archives, decontaminate, fingerprints, language, neardup, packing, privacy, quotations, scoring, secrets


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": archives.op1_warc,
        "op2_secrets": secrets.op2_secrets,
        "op3_language": language.op3_language,
        "op4_neardup": neardup.op4_neardup,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_scoring": scoring.op6_scoring,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_pii": privacy.op8_pii,
        "op9_quotations": quotations.op9_quotations,
        "op10_packing": packing.op10_packing,
        "edited_texts": fingerprints.edited_texts,
        "word_scores": scoring.word_scores,
        "pii_spans": privacy.pii_spans,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": archives.OP1_SQL, "op2_secrets": secrets.OP2_SQL, "op4_neardup": neardup.OP4_SQL, "op7_decontaminate": decontaminate.OP7_SQL, "op9_quotations": quotations.OP9_SQL, "edited_texts": fingerprints.EDITED_SQL, "word_scores": scoring.WORD_SQL, "pii_spans": privacy.PII_SQL}
