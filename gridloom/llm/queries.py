"""The corpus operators' queries, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import langid, lmscore, media, mixing, packing, phrases, sharding, simhash, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.query,
    "op2_hilbert_sharding": sharding.query,
    "op3_ogg_demux": media.query,
    "op4_mixing": mixing.query,
    "op5_fingerprints": phrases.query,
    "op6_toxicity": toxicity.query,
    "op7_simhash": simhash.query,
    "op8_suffix_array": suffixes.query,
    "op9_lm_score": lmscore.query,
    "op10_packing": packing.query,
}

#: The others train, search, or solve by dynamic programming; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {"op1_language_id": langid.SQL, "op2_hilbert_sharding": sharding.sql(), "op4_mixing": mixing.sql(), "op8_suffix_array": suffixes.sql()}
