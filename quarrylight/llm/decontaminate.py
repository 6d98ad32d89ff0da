r"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one input partition, about SHARD_BYTES of
text. Its words become symbols: benchmark words have one each, every other word
is a separator, and runs that are too short for any window are left out, since
no window can lie in them. Over the symbols stand a suffix array (prefix
doubling, each round on unresolved suffixes only), the transform, a wavelet
matrix for ranks and suffix positions sampled every SAMPLE symbols. All windows
are searched backwards side by side; occurrences are located by walking to the
next sampled position, and their word ranges are merged into removal spans.
No shuffle: shards are searched where they are read.

Windows (10 words; a whole item of fewer words) are made from the benchmark on
the driver in blocks of block_bytes at most, each of which is broadcast; workers
hold one block at a time. A block takes some 40 times its text's bytes while it is
made (tens of bytes for every word of an item). Words are compared by 64-bit hash.

Defined cases: null text has no words; an item without words has no window; a
null item_id marks words but is not listed; repeated items count once, repeated
documents each; a very long text is a shard of its own (some 100 bytes of index
for every word that the benchmark knows); an empty benchmark hits nothing; an empty table gives no rows;
other columns are passed through or ignored as named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ragged
from .common import ALNUM, map_arrow, with_text, words_of

WINDOW = 10
SAMPLE = 16
SHARD_BYTES = 4 << 20


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ranks are the number of smaller suffixes, exact where unique."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    head = np.concatenate([[True], seq[order][1:] != seq[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.append(head[1:], True)
    u, k = order[~alone], 1
    while len(u):
        after = np.where(u + k < n, rank[np.minimum(u + k, n - 1)] + 1, 0)
        key = rank[u] * (n + 1) + after
        o = np.argsort(key, kind="stable")
        u, key = u[o], key[o]
        r, at = rank[u], np.arange(len(u))
        group = np.concatenate([[True], r[1:] != r[:-1]])
        head = np.concatenate([[True], key[1:] != key[:-1]])
        rank[u] = r + np.maximum.accumulate(np.where(head, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        u = u[~(head & np.append(head[1:], True))]
        k *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


class Bits:
    """Rank over a bit vector: words of 64 bits and the ones before each."""

    def __init__(self, bit: np.ndarray) -> None:
        packed = np.packbits(bit, bitorder="little")
        padded = np.zeros((len(bit) // 64 + 1) * 8, dtype=np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FmIndex:
    """Over symbols >= 1; a sentinel 0 is appended."""

    def __init__(self, seq: np.ndarray, n_symbols: int) -> None:
        seq = np.append(seq, 0).astype(np.int64)
        sa = suffix_array(seq)
        last = seq[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=n_symbols))])
        self.levels: list[tuple[int, Bits, int]] = []
        first = np.zeros(n_symbols, dtype=np.int64)
        symbols = np.arange(n_symbols)
        for level in reversed(range(max(1, int(n_symbols - 1).bit_length()))):
            bit = (last >> level) & 1 != 0
            bits, zeros = Bits(bit), int((~bit).sum())
            self.levels.append((level, bits, zeros))
            ones = bits.rank(first)
            first = np.where((symbols >> level) & 1, zeros + ones, first - ones)
            last = np.concatenate([last[~bit], last[bit]])
        self.first = first
        mark = sa % SAMPLE == 0
        self.mark, self.sampled = Bits(mark), sa[mark]

    def step(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """First row of c's range plus the number of c in the transform before row i."""
        at = i
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((c >> level) & 1, zeros + ones, at - ones)
        return self.before[c] + at - self.first[c]

    def back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one symbol longer."""
        at, c = row, np.zeros(len(row), dtype=np.int64)
        for level, bits, zeros in self.levels:
            bit, ones = bits.get(at), bits.rank(at)
            at = np.where(bit, zeros + ones, at - ones)
            c |= bit.astype(np.int64) << level
        return self.before[c] + at - self.first[c]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, from row, to row) of those that occur. patterns: right-aligned symbols."""
        which = np.arange(len(patterns))
        c = patterns[:, -1]
        lo, hi = self.before[c], self.before[c + 1]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in range(1, patterns.shape[1] + 1):
            live = lo < hi
            which, lo, hi = which[live], lo[live], hi[live]
            full = sizes[which] == j
            found.append((which[full], lo[full], hi[full]))
            which, lo, hi = which[~full], lo[~full], hi[~full]
            if not len(which):
                break
            c = patterns[which, -1 - j]
            lo, hi = self.step(c, lo), self.step(c, hi)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def locate(self, row: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), dtype=np.int64)
        at, steps = np.arange(len(row)), 0
        while len(at):
            hit = self.mark.get(row)
            out[at[hit]] = self.sampled[self.mark.rank(row[hit])] + steps
            at, row = at[~hit], self.back(row[~hit])
            steps += 1
        return out


class Windows:
    """The distinct windows of some items: symbols, sizes and the items of each."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        hashed = [(i, h) for i, t in items if len(h := words_of(t, ALNUM)[0])]
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.empty(0, dtype=np.uint64)
        count = np.array([max(1, len(h) - WINDOW + 1) for _, h in hashed], dtype=np.int64)
        every = np.zeros((int(count.sum()), WINDOW), dtype=np.int32)  # right-aligned; symbols begin at 2
        at = 0
        for n, (_, h) in zip(count, hashed, strict=True):
            s = (np.searchsorted(self.vocabulary, h) + 2).astype(np.int32)
            if len(s) < WINDOW:
                every[at, WINDOW - len(s) :] = s
            else:
                every[at : at + n] = np.lib.stride_tricks.sliding_window_view(s, WINDOW)
            at += n
        row = np.dtype((np.void, every.dtype.itemsize * WINDOW))
        first, back = np.unique(every.view(row).ravel(), return_index=True, return_inverse=True)[1:] if at else (count, count)
        self.patterns = every[first].astype(np.int64)
        del every
        self.sizes = (self.patterns > 0).sum(axis=1)
        item = np.repeat(np.array([np.iinfo(np.int64).min if i is None else i for i, _ in hashed], dtype=np.int64), count)
        pairs = np.unique(np.stack([back, item], axis=1), axis=0) if at else np.empty((0, 2), dtype=np.int64)
        pairs = pairs[pairs[:, 1] != np.iinfo(np.int64).min]
        self.items, self.n_items = pairs[:, 1], np.bincount(pairs[:, 0], minlength=len(first))
        self.item_at = np.cumsum(self.n_items) - self.n_items
        self.least = int(self.sizes.min()) if len(self.sizes) else 0

    def hits(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hit word flags, document and item of each distinct pair) in a shard's words; doc: the document of each word."""
        hit, none = np.zeros(len(words), dtype=bool), np.empty(0, dtype=np.int64)
        if not len(self.sizes) or not len(words):
            return hit, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words
        edge = np.concatenate([[True], (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])])
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, len(words)))
        keep = (size >= self.least) & known[start]
        if not keep.any():
            return hit, none, none
        begin, size = start[keep], size[keep]
        place = ragged(begin, size)  # word of each symbol
        gap = np.cumsum(size)
        seq = np.insert(at[place] + 2, gap, 1)
        place = np.insert(place, gap, -1)
        index = FmIndex(seq, len(self.vocabulary) + 2)
        which, lo, hi = index.search(self.patterns, self.sizes)
        n = hi - lo
        found = place[index.locate(ragged(lo, n))]
        which = np.repeat(which, n)
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, found, 1)
        np.add.at(cover, found + self.sizes[which], -1)
        hit = np.cumsum(cover)[:-1] > 0
        once = np.unique(doc[found] * len(self.sizes) + which)  # a window counts once for a document, however often it occurs
        of, which = once // len(self.sizes), once % len(self.sizes)
        pairs = np.unique(np.stack([np.repeat(of, self.n_items[which]), self.items[ragged(self.item_at[which], self.n_items[which])]], axis=1), axis=0)
        return hit, pairs[:, 0], pairs[:, 1]


def window_blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcasts of Windows, each from block_bytes of item text at most on average."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-size // block_bytes) or 1
    out = []
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        out.append(spark.sparkContext.broadcast(Windows([(x["item_id"], x["text"]) for x in part.collect()])))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", clean: bool = False, block_bytes: int = 4 << 20) -> DataFrame:
    """Kept columns plus n_words, n_hit, items array<long>, spans array<struct<first, last>> (word ranges, merged).

    With clean, also cleaned: the text without its spans (from the first byte
    of a span's first word to the last of its last).
    """
    blocks = window_blocks(benchmark, block_bytes)
    kinds = "n_words long, n_hit long, items array<long>, spans array<struct<first:long,last:long>>" + (", cleaned string" if clean else "")
    source, keep, schema = with_text(docs, keep, text, kinds)
    names = schema.fieldNames()
    span_type = pa.struct([("first", pa.int64()), ("last", pa.int64())])

    def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        cut = [words_of(t, ALNUM) for t in texts]
        sizes = np.array([len(h) for h, _, _ in cut], dtype=np.int64)
        off = np.concatenate([[0], np.cumsum(sizes)])
        words = np.concatenate([h for h, _, _ in cut]) if cut else np.empty(0, dtype=np.uint64)
        doc = np.repeat(np.arange(len(cut)), sizes)
        hit, of, item = np.zeros(len(words), dtype=bool), [], []
        for b in blocks:
            got = b.value.hits(words, doc)
            hit |= got[0]
            of.append(got[1])
            item.append(got[2])
            if len(blocks) > 1:
                del b._value  # reread from its file when needed
        pairs = np.unique(np.stack([np.concatenate(of), np.concatenate(item)], axis=1), axis=0)
        per_doc = np.searchsorted(pairs[:, 0], np.arange(len(cut) + 1))
        total = np.concatenate([[0], np.cumsum(hit)])
        n_hit = total[off[1:]] - total[off[:-1]]
        edge = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, dtype=bool)
        begin = np.flatnonzero(hit & (edge | np.concatenate([[True], ~hit[:-1]]))) if len(hit) else np.empty(0, dtype=np.int64)
        end = np.flatnonzero(hit & np.append(edge[1:] | ~hit[1:], True)) if len(hit) else begin
        span_at = np.searchsorted(doc[begin], np.arange(len(cut) + 1)) if len(begin) else np.zeros(len(cut) + 1, dtype=np.int64)
        base = off[doc[begin]] if len(begin) else begin
        spans = pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], fields=list(span_type)))
        out = [*batch.columns[:-1], pa.array(sizes), pa.array(n_hit), pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), pa.array(pairs[:, 1])), spans]
        if clean:
            cleaned = list(texts)
            for i in np.flatnonzero(n_hit):
                raw, (_, s, e), at = texts[i].encode("utf-8", "surrogatepass"), cut[i], 0
                parts = []
                for a, b in zip(begin[span_at[i] : span_at[i + 1]] - off[i], end[span_at[i] : span_at[i + 1]] - off[i], strict=True):
                    parts.append(raw[at : s[a]])
                    at = e[b]
                cleaned[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
            out.append(pa.array(cleaned, pa.string()))
        return pa.RecordBatch.from_arrays(out, names)

    def run(batches):
        held, size = [], 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                held.append(b)
                size += b.column(b.num_columns - 1).nbytes if b.num_rows == whole.num_rows else int(b.column(b.num_columns - 1).get_total_buffer_size() * b.num_rows / whole.num_rows)
                if size >= SHARD_BYTES:
                    yield shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held, size = [], 0
        if held and sum(b.num_rows for b in held):
            yield shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return map_arrow(source, run, schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = find_contamination(docs, benchmark, ["doc_id"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(ws, i, i + 9) AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 8)) AS i FROM b WHERE len(ws) >= 10)
        UNION SELECT DISTINCT item_id, ws AS g FROM b WHERE len(ws) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT len(g) AS n FROM win),
dw AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN win ON dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
