"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import functools

from . import ann, common, decontaminate, heavy, jaccard, language, lm, nearsets, packing, periodic, resample, shards, substrings, token_files

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_token_files": token_files.op3_token_files,
    "op4_sharding": shards.op4_sharding,
    "op5_nearest": ann.op5_nearest,
    "op6_language_id": language.op6_language_id,
    "op7_suffix_dedup": substrings.op7_suffix_dedup,
    "op8_lm_score": lm.op8_lm_score,
    "op9_resample": resample.op9_resample,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_near_sets": nearsets.op12_near_sets,
    "op13_heavy_hitters": heavy.op13_heavy_hitters,
}


def queries() -> dict:
    def ready(query):
        @functools.wraps(query)
        def run(spark, sf_dir):
            common.make_importable(spark)
            return query(spark, sf_dir)

        return run

    return {name: ready(query) for name, query in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": shards.OP4_SQL, "op13_heavy_hitters": heavy.OP13_SQL}
