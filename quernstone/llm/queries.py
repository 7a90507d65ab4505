"""Queries p6 to p8: tokens, containers and sentences of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import bpe, packing, sentences
from quernstone.session import spread
from quernstone.sources.tables import table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(_documents(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of each part of one that is larger than a container."""
    return packing.pack_documents(_documents(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their tokens and the share of space that stays unused."""
    return packing.fill(p7_containers(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every document as offsets."""
    return sentences.sentences(_documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (p6_ids, p7_containers, p7_fill, p8_found)}
