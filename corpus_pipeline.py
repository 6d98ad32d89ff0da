"""A training corpus from documents: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the columns of documents; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.bpe import bpe_encode
from quarrylight.llm.common import saved, work_dir
from quarrylight.llm.decontaminate import find_contamination
from quarrylight.llm.jaccard_join import one_of_each
from quarrylight.llm.quality_qda import classify, held_out, learn
from quarrylight.llm.substring_dedup import cut_passages, find_passages


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn(docs, labels, usable=~held_out())
    names = docs.columns
    scored = classify(docs.select(*[F.col(c).alias(f"d_{c}") for c in names], "text"), model, [f"d_{c}" for c in names])
    return scored.filter("predicted = 1").select(*[F.col(f"d_{c}").alias(c) for c in names])


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates, the least doc_id (nulls last); rows without words stay."""
    return one_of_each(docs)


def _sized_again(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document keeps."""
    return _sized_again(cut_passages(docs, find_passages(docs)))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of the benchmark; a document of nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    names = docs.columns
    found = find_contamination(docs.select(*[F.col(c).alias(f"d_{c}") for c in names], "text"), benchmark, [f"d_{c}" for c in names], clean=True)
    left = found.filter("n_hit = 0 OR n_hit < n_words")
    text = F.when(F.col("n_hit") > 0, F.col("cleaned")).otherwise(F.col("d_text"))
    return _sized_again(left.select(*[(text if c == "text" else F.col(f"d_{c}")).alias(c) for c in names]))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) of every text, and the digest of the text decoded from them."""
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    coded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=keep, decoded="decoded")
    return coded.select(*keep, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_class),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the classifier and the chaining; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; each result is written and read again."""
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{work}/{k}")
    return docs
