"""A training-data pipeline over `documents`: five operators of kumiko.llm, each over all that the one before has kept.

toxicity      documents that the classifier chain calls toxic go
near_dedup    of each group of near duplicates (five-word shingles 0.8 alike, or SimHash within three bits) the document of the
              smallest doc_id stays
suffix_dedup  text that repeats over 200 bytes goes, wherever it stands; documents stay, shorter
decontaminate documents that share a window of ten words with a benchmark item go
encode        each text becomes byte-level BPE ids

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of `docs`. Nulls, empty texts,
repeated rows and empty tables are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kumiko.llm import byte_bpe, common, decontaminate, near_copies, suffix_dedup, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("suffix_dedup", drop_repeats), ("decontaminate", drop_contaminated), ("encode", encode)]

#: SQL can't express the classifier, the components, or the merges; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
