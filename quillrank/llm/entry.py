"""The queries of this folder for the driver's entry module, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import extraction, langid, media, mixing, mtree, packing, quality, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        toxicity.op1_toxicity,
        mixing.op2_mix_sources,
        mtree.op3_topk,
        sharding.op4_shard_balance,
        extraction.op5_extract_html,
        media.op6_media_sequences,
        langid.op7_language_id,
        simhash.op8_simhash,
        quality.op9_quality,
        packing.op10_pack_sequences,
    )
}

ORACLES: dict[str, str] = {"op2_mix_sources": mixing.ORACLE, "op3_topk": mtree.ORACLE}
