"""The registered queries of this subpackage and their DuckDB forms, where SQL can express them."""

from __future__ import annotations

from . import decontaminate, jaccard_join, language_id, license_scan, minimax_shards, piece_codec, quality_cascade, token_store, toxicity_fm, warc_revisit

QUERIES = {
    "op1_token_store": token_store.query,
    "op2_language_hierarchy": language_id.query,
    "op3_quality_cascade": quality_cascade.query,
    "op4_piece_codec": piece_codec.query,
    "op5_jaccard_join": jaccard_join.query,
    "op5_jaccard_links": jaccard_join.links_query,
    "op6_toxicity_fm": toxicity_fm.query,
    "op7_warc_revisit": warc_revisit.query,
    "op8_minimax_shards": minimax_shards.query,
    "op9_decontamination": decontaminate.query,
    "op10_license_scan": license_scan.query,
}
ORACLES = {"op3_quality_cascade": quality_cascade.SQL, "op5_jaccard_join": jaccard_join.SQL, "op7_warc_revisit": warc_revisit.SQL, "op9_decontamination": decontaminate.SQL}
