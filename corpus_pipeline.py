"""The corpus pipeline: language ID, n-gram Jaccard join, suffix-array dedup, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the
columns of ``documents``; the last returns the encoded rows. A stage's result is written as Parquet
and read again as the next one's ``docs``. Each stage starts by deleting the scratch tables of the
pipeline's stages before it, which their written results no longer need; tables of others stay.

All stages: a null text is empty; texts are processed whole, however long; repeated rows and rows
that tie in doc_id are told apart by their text, and equal rows are treated alike; an empty table
gives an empty one; columns beyond those of ``documents`` are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.jaccard_join import jaccard_join, keep_one
from sievework.llm.language_id import without_unsettled
from sievework.llm.mixing import mix_sources, repeat_rows
from sievework.llm.piece_lattice import encode_pieces
from sievework.llm.suffix_dedup import without_repeats
from sievework.scratch import delete, new_dir, owned, release

OWNER = "pipeline"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Callable[[DataFrame], DataFrame]) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, OWNER)
        with owned(OWNER):
            return f(docs)

    run_stage.__doc__ = f.__doc__
    return run_stage


@stage
def language(docs: DataFrame) -> DataFrame:
    """Documents whose language the evidence does not settle, or that have no letter, go. A null lang or source is no evidence."""
    return without_unsettled(docs)


@stage
def near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 stays, that of the smallest doc_id; a group without any doc_id keeps one too."""
    return keep_one(docs, jaccard_join(docs))


@stage
def repeats(docs: DataFrame) -> DataFrame:
    """Strings of 200 bytes that start more than once go from the texts; all rows stay, and n_chars is counted again."""
    return without_repeats(docs)


@stage
def mix(docs: DataFrame) -> DataFrame:
    """Documents stand as often as the mix of sources takes them: not at all, once or twice; null sources are one source."""
    return repeat_rows(docs, mix_sources(docs))


@stage
def encode(docs: DataFrame) -> DataFrame:
    """doc_id and the best segmentation's piece ids, with the N best scores and the round trip; an empty text has no pieces."""
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("language_id", language), ("jaccard_join", near_copies), ("suffix_dedup", repeats), ("mixing", mix), ("piece_encoding", encode)]
#: MinHash, a trained model and a lattice search are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        folder = new_dir(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if last:
            delete(spark, last)
        last = folder
    release(spark, OWNER)
    return docs
