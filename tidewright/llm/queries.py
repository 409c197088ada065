"""The queries of this subpackage, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, langid, mixing, neardup, neighbours, oracles, packing, personal_data, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_deobfuscated_pii": personal_data.op1_deobfuscated_pii,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_recurrent_toxicity": toxicity.op3_recurrent_toxicity,
        "op4_text_density": html_text.op4_text_density,
        "op5_positional_index": decontamination.op5_positional_index,
        "op6_projection_forest": neighbours.op6_projection_forest,
        "op7_fair_mix": mixing.op7_fair_mix,
        "op8_hyperminhash": neardup.op8_hyperminhash,
        "op9_two_pass_shuffle": sharding.op9_two_pass_shuffle,
        "op10_viterbi_language": langid.op10_viterbi_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_positional_index": oracles.CONTAMINATION, "op7_fair_mix": mixing.ORACLE, "op8_hyperminhash": oracles.NEAR_DUPLICATES}
