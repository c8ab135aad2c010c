"""The ten operators' queries and their SQL."""

from __future__ import annotations

from . import decontaminate, language, licenses, lm, mixing, neighbours, quality, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_lm_scoring": lm.op1,
        "op2_simhash_dedup": simhash.op2,
        "op3_license_scan": licenses.op3,
        "op4_toxicity": toxicity.op4,
        "op5_nearest_neighbours": neighbours.op5,
        "op6_decontamination": decontaminate.op6,
        "op7_warc_revisits": warc.op7,
        "op8_language_id": language.op8,
        "op9_quality": quality.op9,
        "op10_source_mixing": mixing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": decontaminate.ORACLE_SQL,
        "op7_warc_revisits": warc.ORACLE_SQL,
        "op10_source_mixing": mixing.oracle_sql(),
    }
