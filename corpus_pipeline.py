"""A corpus pipeline over `documents`: quality, near-duplicates, benchmark passages, source mix, token files.

Each stage gets what its predecessor kept and gives the columns of documents; the last gives what the
token files hold. Scratch tables of a stage are deleted when the next one begins.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellcluster.llm import chosen_path, dac, gam, mixing, pigeonhole
from shellcluster.llm.common import fold, word_count
from shellcluster.runtime import materialize, scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _scoped(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scope(spark, "pipeline"):
            return stage(spark, docs, sf_dir)

    return run


@_scoped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("__id", 3) != 1)
    return gam.score(docs, model, name="__quality").where("__quality >= 0.5").drop("__quality")


@_scoped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group."""
    return chosen_path.keep_one(docs)


@_scoped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return pigeonhole.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_scoped
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed, _ = mixing.mix(docs, F.array("source"), word_count(F.col("text")), mixing.weights_by_rank())
    return mixing.take(mixed)


@_scoped
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dac.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", source_mix),
    ("token ids", token_files),
]

#: The classifier and the joins can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
