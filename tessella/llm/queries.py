"""The queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, group_join, line_dedup, mixture, mtree, multi_index, phrase_automata, piece_codec, spot_signatures, tag_paths, token_alignment, token_store, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": piece_codec.op1_pieces,
    "op2_mix": mixture.op2_mix,
    "op3_multi_index": multi_index.op3_multi_index,
    "op4_phrases": phrase_automata.op4_phrases,
    "op5_token_store": token_store.op5_token_store,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_group_join": group_join.op8_group_join,
    "op9_tag_paths": tag_paths.op9_tag_paths,
    "op10_mtree": mtree.op10_mtree,
    "op11_divergence": divergence.op11_divergence,
    "op12_spot_signatures": spot_signatures.op12_spot_signatures,
    "op13_alignment": token_alignment.op13_alignment,
}

ORACLE_SQL: dict[str, str] = {**divergence.SQL, **group_join.SQL, **line_dedup.SQL, **mtree.SQL, **phrase_automata.SQL}
