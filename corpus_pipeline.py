"""A cleaning pipeline over the documents, from the operators of ``pointmill.llm``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.llm import langid, neardup, packing, repeats
from pointmill.plans.scratch import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go.

    These are null and empty texts and those without a letter.  Every row is
    judged for itself, with a null or repeated id too.  A table without
    labelled texts keeps every text with a letter; an empty one stays empty.
    All columns pass through, whatever their names.
    """
    return langid.kept(docs, langid.fitted(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays.

    Rows without an id stay, as do texts without words, which are classes of
    their own; rows that share an id stay or go together.  All columns pass
    through, whatever their names.
    """
    others = neardup.classes(docs).where("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a document with a smaller id has too go; a document with none left goes.

    An untouched text stays as it is, null, empty and short ones included.  Rows
    without an id lose nothing and take nothing from others; rows that share an
    id are one document where windows are compared.  ``n_chars`` follows the
    text; all other columns pass through, whatever their names.
    """
    return repeats.trimmed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left; a null or empty text is its end id alone, every row is a document."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", pack),
]
#: Language models and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
