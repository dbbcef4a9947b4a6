"""The queries of this subpackage and their SQL; each query applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common, decontaminate, golay_simhash, language_id, oracles, pfor_tokens, rlz_dedup, shards, suffix_dedup, tiff, toxicity


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def packed_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = common.new_folder(docs.sparkSession, "tokens")
    common.stored_at(docs.sparkSession, folder)
    files = pfor_tokens.write_tokens(docs, tokenizer, folder)
    return pfor_tokens.read_tokens(docs.sparkSession, files).mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_tokens(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language_id.train(docs.filter(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_char", "rejected")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = byte_bpe.encode_texts(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.rlz_dedup(common.documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(common.documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.golay_simhash(common.documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.propagate(common.documents(spark, sf_dir))


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packed_tokens": op1_packed_tokens,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_rlz_dedup": op4_rlz_dedup,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_golay_simhash": op8_golay_simhash,
    "op9_shards": op9_shards,
    "op10_tiff": op10_tiff,
}

ORACLES: dict[str, str] = {"op4_rlz_dedup": oracles.RLZ, "op5_suffix_dedup": oracles.SUFFIX, "op7_decontaminate": oracles.DECONTAMINATE}
