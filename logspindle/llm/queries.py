"""The subpackage's queries and their SQL for the driver contract."""

from __future__ import annotations

from . import decontaminate, hostrep, jaccard, langid, lines, media, packing, pii, shards, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": lines.query,
        "op2_decontamination": decontaminate.query,
        "op3_toxicity": toxicity.query,
        "op4_language_id": langid.query,
        "op5_url_filter": hostrep.query,
        "op6_jaccard_join": jaccard.query,
        "op7_media_columns": media.query,
        "op8_sharding": shards.query,
        "op9_pii": pii.query,
        "op10_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.SQL, "op5_url_filter": hostrep.SQL, "op8_sharding": shards.SQL}
