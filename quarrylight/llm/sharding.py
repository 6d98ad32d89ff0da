"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

DataFrame functions only. Every input partition sorts its rows by a random key
(the local permutation) and writes them, without their texts, as a work table:
the place p of a row and its rank r within p are then fixed, whatever is lost
or run again. The driver draws how many rows each partition sends to each
shard: the places of the shards are split between halves of the partitions by the
multivariate hypergeometric law, down to single partitions, so the sums of rows and columns are exact and the law is that of a
uniform permutation cut into shards. Rows of p go to shards by rank; that is
the exchange. Within a shard a second random key orders the rows; slots come
from counts of key ranges plus a rank within a range, so no task holds a shard.

What reaches the driver is one count per input partition (a split, so about
one per 128 MB of input); the matrix has that many rows of n_shards counts.

Defined cases: a null text has no bytes (size 8, checksum 0); null or repeated
doc_ids and repeated rows are rows like any other, each with its own slot; a very
long text counts with all its bytes and is not moved; ties of the random keys are
broken by place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, work_dir


#: numpy draws from populations below this size.
LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Good ones in a sample drawn without replacement from a population of any size.

    The law is inverted numerically: probabilities relative to the mode are
    products of the exact ratios of neighbours, taken to both sides until they
    fall below 1e-20.
    """
    lo, hi = max(0, sample - bad), min(sample, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (good + bad + 2)))
    total = good + bad
    deviation = (sample * (good / total) * (bad / total) * ((total - sample) / max(1, total - 1))) ** 0.5
    reach = int(12 * deviation) + 64

    def side(n: int, up: bool) -> np.ndarray:
        k = np.arange(n, dtype=np.float64)
        if up:  # from x to x + 1
            ratio = (good - mode - k) / (mode + 1 + k) * ((sample - mode - k) / (bad - sample + mode + 1 + k))
        else:
            ratio = (mode - k) / (good - mode + 1 + k) * ((bad - sample + mode - k) / (sample - mode + 1 + k))
        p = np.cumprod(ratio)
        return p[: int(np.searchsorted(-p, -1e-20))]

    above, below = side(min(reach, hi - mode), True), side(min(reach, mode - lo), False)
    p = np.concatenate([below[::-1], [1.0], above])
    c = np.cumsum(p)
    return mode - len(below) + min(int(np.searchsorted(c, rng.random() * c[-1], side="right")), len(p) - 1)


def split(rng: np.random.Generator, left: np.ndarray, sample: int) -> np.ndarray:
    """How many of a sample of rows belong to each shard, if the shards have so many places left."""
    if int(left.sum()) < LARGE:
        return rng.multivariate_hypergeometric(left, sample, method="marginals")
    out, rest = np.zeros_like(left), int(left.sum())
    for j, n in enumerate(left.tolist()):
        rest -= n
        out[j] = hypergeometric(rng, n, rest, sample)
        sample -= int(out[j])
    return out


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Exact partition-to-shard counts: row sums are counts, column sums differ by one at most.

    The places of the shards are split between halves of the partitions, again
    and again; a table of 10**11 rows has few splits beyond what numpy draws.
    """
    rng, before = np.random.default_rng(seed), np.concatenate([[0], np.cumsum(np.array(counts, dtype=np.int64))])
    total = int(before[-1])
    left = np.full(n_shards, total // n_shards, dtype=np.int64)
    left[: total % n_shards] += 1
    out = np.zeros((len(counts), n_shards), dtype=np.int64)
    todo = [(0, len(counts), left)] if counts else []
    while todo:
        lo, hi, left = todo.pop()
        if hi - lo == 1:
            out[lo] = left
            continue
        mid = (lo + hi) // 2
        first = split(rng, left, int(before[mid] - before[lo]))
        todo += [(mid, hi, left - first), (lo, mid, first)]
    return out


def hypergeometric_shards(docs: DataFrame, n_shards: int = 24, seed: int = 7, range_rows: int = 20_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, shard, slot; counts of shards differ by one at most.

    range_rows: rows that one ordering task of a shard gets on average.
    """
    spark = docs.sparkSession
    base = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("key", F.rand(seed))
    placed = base.sortWithinPartitions("key").withColumn("place", F.monotonically_increasing_id()).drop("key")
    placed = saved(placed, work_dir(spark, "shards"))
    rows = placed.select("doc_id", "size", "text_crc32", F.shiftright("place", 33).alias("p"), F.col("place").bitwiseAND((1 << 33) - 1).alias("r"))

    counts = sorted((x["p"], x["n"]) for x in rows.groupBy("p").agg(F.count("*").alias("n")).collect())
    matrix = communication_matrix([n for _, n in counts], n_shards, seed)
    total = sum(n for _, n in counts)
    ends = [(p, [int(v) for v in np.cumsum(m)]) for (p, _), m in zip(counts, matrix, strict=True)]
    sends = spark.createDataFrame(ends, "p long, ends array<long>")
    dealt = rows.join(sends, "p").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("r"))))

    ranges = max(1, total // max(1, n_shards * range_rows))
    key = F.xxhash64(F.lit(seed), "p", "r")
    dealt = dealt.select("doc_id", "size", "text_crc32", "shard", key.alias("key"), "p", "r").withColumn("cut", F.pmod(F.shiftright("key", 20), F.lit(ranges)))
    before = Window.partitionBy("shard").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "cut").agg(F.count("*").alias("n")).select("shard", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "cut").orderBy("key", "p", "r")
    ranked = dealt.withColumn("rank", F.row_number().over(own) - 1)
    return ranked.join(starts, ["shard", "cut"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank")).cast("long").alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return hypergeometric_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
