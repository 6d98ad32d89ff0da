"""Work folders and byte-level word hashing shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
#: Odd multipliers.
BASE = 0x9E3779B97F4A7C15
SIZE = 0xD6E8FEB86659FD93


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share.

    Where the session names none and the master is this machine (tests) one is
    set; elsewhere that is an error, since executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write df as a table under path and read it again: lineage ends here."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


BATCH_ROWS = 1_000


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) for rows with whole texts.

    Batches of BATCH_ROWS rows at most bound what executors hold beside their
    heap (a session setting; a smaller one stays). A worker that has done its
    task gives freed memory back, since Spark keeps it for later tasks.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def bounded(batches):
        yield from run(batches)
        trim()

    return df.mapInArrow(bounded, schema)


def with_text(docs: DataFrame, keep: list[str], text: str, kinds: str):
    """(kept columns and the text as last column, names kept, schema of the kept ones and of kinds).

    Kept columns that have the name of a new column give way to it.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    new = T.StructType.fromDDL(kinds)
    taken = {c.lower() for c in new.fieldNames()}
    keep = [c for c in keep if c.lower() not in taken]
    name = "text_"
    while name in {c.lower() for c in keep}:
        name += "_"
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(name))
    return source, keep, T.StructType([*source.schema.fields[:-1], *new.fields])


def trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (multiply and xor-shift rounds)."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_ascii()
#: Words of [^\x20\x09-\x0D]+.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing): digits, a-z and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def words_of(text: str | None, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte starts, byte ends) of the words of a whole text with A-Z lower-cased.

    Delimiters are ASCII, so working on UTF-8 bytes equals working on code
    points. See span_hashes() for the hash of a word.
    """
    b = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = kind[b]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, U), start, end
    return span_hashes(b, start, end), start, end


#: The lowest 0, 1, ..., 8 bytes of a block.
LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U)


def eights(b: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each byte, as one number; past the end zeros."""
    part = np.concatenate([b, np.zeros(8, dtype=np.uint8)])
    return np.lib.stride_tricks.as_strided(part[:8].view(U), shape=(len(b) + 1,), strides=(1,))


def span_blocks(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks of 8 bytes of all spans, filled up with bytes 255, which are in no UTF-8 text; blocks of each; hashes)."""
    size = end - start
    n = (size + 7) >> 3
    first = np.cumsum(n) - n
    i = np.arange(int(n.sum())) - np.repeat(first, n)
    low = LOWEST[np.minimum(np.repeat(size, n) - 8 * i, 8)]
    flat = eights(b)[np.repeat(start, n) + 8 * i] & low | ~low
    with np.errstate(over="ignore"):
        return flat, n, mix(np.add.reduceat(mix(mix(flat) + i.astype(U) * U(BASE)), first) + n.astype(U) * U(SIZE)) if len(n) else flat


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of the bytes b, none of which is empty.

    Every block of 8 bytes goes through mix(), then through it once more with
    its number in the span; the sum of these and the length are mixed again.
    No sum of plain bytes or powers is taken, so that regular patterns of the
    bytes don't cancel out.
    """
    out = np.empty(len(start), dtype=U)
    at, step = 0, 1 << 18
    with np.errstate(over="ignore"):
        while at < len(start):  # blocks bound the memory for very long texts
            to = max(at + 1, int(np.searchsorted(end, start[at] + step)))
            lo, hi = int(start[at]), int(end[to - 1])
            block = eights(b[lo:hi])
            s, size = start[at:to] - lo, end[at:to] - start[at:to]
            h = mix(block[s] & LOWEST[np.minimum(size, 8)])
            long = np.flatnonzero(size > 8)
            if len(long):
                n = (size[long] - 1) // 8
                first = np.cumsum(n) - n
                i = np.arange(int(n.sum())) - np.repeat(first, n) + 1
                left = np.repeat(size[long], n) - 8 * i
                more = mix(block[np.repeat(s[long], n) + 8 * i] & LOWEST[np.minimum(left, 8)])
                h[long] += np.add.reduceat(mix(more + i.astype(U) * U(BASE)), first)
            out[at:to] = mix(h + size.astype(U) * U(SIZE))
            at = to
    return out


def sequence_hash(words: np.ndarray) -> int:
    """64-bit hash, as a signed number, of a sequence of hashes; order and length count."""
    with np.errstate(over="ignore"):
        v = mix(words + np.arange(1, len(words) + 1, dtype=U) * U(BASE)).sum(dtype=U) + U(len(words)) * U(SIZE)
        return int(mix(np.array([v], dtype=U))[0].view(np.int64))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, each from those of the two runs of half or more of its words that cover it."""
    if len(words) < n:
        return np.empty(0, dtype=U)
    h, size = words, 1
    with np.errstate(over="ignore"):
        while size < n:
            k = min(size, n - size)
            h = mix(mix(h[:-k]) * U(BASE) + h[k:])
            size += k
    return h


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence if it has fewer; empty without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, k, dtype=U)
        for i in range(k):
            h = h * U(BASE) + words[i : n - k + 1 + i]
            h ^= h >> U(29)
        return mix(h)


def sized(table: DataFrame, rows: int = 200_000) -> DataFrame:
    """A stored narrow table, to be broadcast if counting finds no more than so many rows; else a shuffle joins it."""
    from pyspark.sql import functions as F

    return F.broadcast(table) if table.count() <= rows else table


def join_unique(left: DataFrame, right: DataFrame, key: str, count: str = "c", how: str = "inner", rows: int = 200_000) -> DataFrame:
    """left joined (inner, left) with right, a stored table that has each key once and in count how many rows of left have it.

    A right side of few rows is broadcast. Else keys with more rows than 2,000
    and than 1/500 of all are hot: there are 500 at most, whatever the input, so
    these are broadcast, and the rows of left that have them are not exchanged.
    """
    from pyspark.sql import functions as F

    n, total, most = right.agg(F.count("*"), F.sum(count), F.max(count)).first()
    small, limit = right.drop(count), max(2_000, (total or 0) // 500)
    if n <= rows:
        return left.join(F.broadcast(small), key, how)
    if most <= limit:
        return left.join(small, key, how)
    hot = F.broadcast(right.filter(F.col(count) > limit).drop(count))
    rest = left.join(F.broadcast(right.filter(F.col(count) > limit).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.filter(F.col(count) <= limit).drop(count), key, how))


def row_key():
    """A key of the rows of (doc_id, text): equal for equal rows, whatever else repeats or is null."""
    from pyspark.sql import functions as F

    return F.xxhash64("doc_id", "text")


BITS = 1 << 22


def slot(col):
    """The bit of a value in bitmap()."""
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(col), F.lit(BITS))


def _bitmap(slots: DataFrame, bits: int):
    """Broadcast of so many bits with those of slots(s) set; executors join the bits of each word."""
    from pyspark.sql import functions as F

    at = slots.select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s % 64 AS int))").alias("b"))
    got = at.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, dtype=U)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(U)
    return slots.sparkSession.sparkContext.broadcast(out)


def bitmap(df: DataFrame, col: str):
    """Broadcast of BITS bits (512 KB whatever the input) with those of df's values set.

    A sieve before an exact join: values that it lets through without need are
    dropped by that join.
    """
    return _bitmap(df.select(slot(col).alias("s")), BITS)


def hash_bitmap(hashes: DataFrame, col: str, most: int = 1 << 26):
    """The same for a stored table of mixed 64-bit hashes, whose low bits are the place: 16 bits a hash, 8 MB at most."""
    from pyspark.sql import functions as F

    bits = min(most, max(1 << 12, 1 << (16 * max(1, hashes.count()) - 1).bit_length()))
    return _bitmap(hashes.select(F.col(col).bitwiseAND(bits - 1).alias("s")), bits)


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63).astype(U)) & U(1) != 0


def hash_in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return in_bitmap(bits, hashes & (64 * len(bits) - 1))


def components(edges: DataFrame, work: str) -> DataFrame | None:
    """(node, root) of every node of edges(a, b): the connected components; None without edges.

    Nodes must be hashes. Each round maps a node to the least of itself and its
    neighbours and rewrites the edges; since the order of hashes is random, a
    constant share of the nodes goes in each round. Rounds are stored; nothing
    but counts comes to the driver.
    """
    from pyspark.sql import functions as F

    maps, cur, k = [], edges.filter("a <> b").distinct(), 0
    cur = saved(cur, f"{work}/edges-0")
    if cur.isEmpty():
        return None
    while not cur.isEmpty():
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = saved(both.groupBy("a").agg(F.min("b").alias("to"), F.count("*").alias("c")).select("a", F.least("a", "to").alias("to"), "c"), f"{work}/near-{k}")
        maps.append(near.select("a", "to"))
        k += 1
        step = join_unique(cur, near, "a").select(F.col("to").alias("a"), "b")
        step = join_unique(step, near.select(F.col("a").alias("b"), F.col("to").alias("tb"), "c"), "b").select("a", F.col("tb").alias("b"))
        cur = saved(step.filter("a <> b").distinct(), f"{work}/edges-{k}")
    root = maps[-1].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for near in reversed(maps[:-1]):
        up = root.select(F.col("node").alias("to"), "root")
        root = near.join(up, "to", "left").select(F.col("a").alias("node"), F.coalesce("root", "to").alias("root"))
    root = saved(root, f"{work}/root")
    for i in range(k):
        remove(edges.sparkSession, f"{work}/near-{i}")
        remove(edges.sparkSession, f"{work}/edges-{i}")
    return root
