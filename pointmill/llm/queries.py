"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, licences, neardup, packing, pieces, repeats, urls, versions, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.searched(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    found = langid.identified(docs, langid.fitted(docs.where(~held_out)))
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op3_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.fingerprinted(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licences(licences.scanned(table(spark, sf_dir, "documents")))


def _licences(found: DataFrame) -> DataFrame:
    base = F.array_distinct(F.transform("base", lambda x: x.label))
    both = F.array_union(base, F.transform("found", lambda x: x.label))
    places = F.transform("base", lambda x: x.word)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(both).alias("labels"),
        "score",
        F.to_json("found").alias("notices"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), digests=True).withColumnRenamed("kept", "kept_sha256")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.archived(table(spark, sf_dir, "pages")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


# Parts of the operators that SQL can express


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licences(licences.scanned(table(spark, sf_dir, "documents"), notices=())).drop("labels", "score", "notices")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.placed(table(spark, sf_dir, "pages"), urls.RULES, "page_id", "url").select("page_id", "host", "path", "rule", F.col("fixed").alias("verdict"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.with_edited(table(spark, sf_dir, "documents"))[0].where("late = 0").select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_multi_index,
        op2_language_id,
        op3_lookup_sketch,
        op4_packing,
        op5_license_scan,
        op6_substring_dedup,
        op7_order_minhash,
        op8_sentencepiece,
        op9_warc,
        op10_url_filter,
        license_phrases,
        url_rules,
        edited_texts,
    )
}
