"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing to target weights, piece ids.

``run(spark, sf_dir)`` takes ``documents`` through STAGES. Each stage is written to the shared folder and read again as
the next one's documents, so a lost executor never reaches back beyond one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import dropped, table, written
from tessella.llm.group_join import near_stage
from tessella.llm.line_dedup import line_stage
from tessella.llm.mixture import mix
from tessella.llm.piece_codec import piece_stage
from tessella.llm.toxicity import toxicity_stage


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as many times as the mix takes it, with the columns of ``docs``.

    Null, empty, very long and repeated rows as mixture.allocate() says; columns with clashing names stay as they were."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_stage),
    ("mixture", mix_stage),
    ("pieces", piece_stage),
]

#: The trained model, the hash draws and the tokenizer are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made: list[DataFrame] = []
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(*made)
        made = [docs]
    return docs
