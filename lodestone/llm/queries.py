"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, html, language, licenses, near_copies, packing, quality, token_counts, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_near_copies": near_copies.op2_near_copies,
        "op3_language": language.op3_language,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_licenses": licenses.op5_licenses,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_html": html.op7_html,
        "op8_quality": quality.op8_quality,
        "op9_packing": packing.op9_packing,
        "op10_vectors": vectors.op10_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_near_copies": near_copies.OP2_SQL, "op5_licenses": licenses.op5_sql(), "op10_vectors": vectors.OP10_SQL}
