"""Token-ID files: canonical length-limited Huffman code from global counts, block by block.

A written token file is a folder of Parquet containers:
  codebook  id, length            the canonical code follows from the lengths
  blocks    range, block, first (ids before it in its range), doc_ids, doc_sizes,
            seg_sizes, seg_bits, payload
Ranges hold ascending doc_ids; blocks of a range follow each other. A block
decodes by itself: its documents begin at byte boundaries, and seg_bits are
bit-offset checkpoints, one for every SEGMENT ids, from which a table of
2**max_len entries decodes all segments of many blocks side by side.

Steps: (1) encode the texts once and store ids as a work table; (2) sum the
counts of ids over all documents, partial sums in each task; the driver gets
one count per vocabulary id and computes code lengths by package-merge;
(3) code documents, exchange the coded bytes once, by range, and write blocks;
(4) read the files back; the ids before a range come from one sum per range.
Ranges are cut by (doc_id, checksum of the ids) at fine quantiles, which are put
together until a range has about range_bytes of ids, so a doc_id that very many
rows share is spread as well.

Defined cases: null text has the end id alone; null doc_ids come first; rows
with equal doc_id stand together in order of their ids' checksum (equal rows are
the same in any order); a very long text is a block of its own; an empty table
makes a file with no block; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordEncoder, binary, chunks, cutter, library, library_fill, once, ragged, read_spec, slices
from .common import map_arrow, remove, saved, work_dir

SEGMENT = 512
BLOCK_IDS = 65_536


def code_lengths(counts: np.ndarray, max_len: int) -> np.ndarray:
    """Lengths of an optimal prefix code with no code above max_len (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_len:
        raise ValueError("more symbols than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    n = len(used)
    levels: list[np.ndarray] = []
    level, is_leaf = weight, np.ones(n, dtype=bool)
    for _ in range(max_len - 1):
        levels.append(is_leaf)
        m = len(level) // 2
        pack = level[: 2 * m : 2] + level[1 : 2 * m : 2]
        both = np.concatenate([weight, pack])
        order = np.argsort(both, kind="stable")
        level, is_leaf = both[order], order < n
    levels.append(is_leaf)
    take, length = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for is_leaf in reversed(levels):  # of the items taken, leaves gain a bit each and packages open into two
        leaves = int(is_leaf[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes: ascending by (length, id)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    size = lengths[order].astype(np.int64)
    if not len(size):
        return codes
    top = int(size.max())
    # in units of the longest code, starts are prefix sums of 2**(top - length)
    starts = np.concatenate([[0], np.cumsum(1 << (top - size))])[:-1]
    codes[order] = starts >> (top - size)
    return codes


def pack(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bytes per document, bit offset of the ids at marks within their documents); documents begin at bytes."""
    size = lengths.astype(np.int64)[ids]
    ends = np.cumsum(size)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    bits = np.concatenate([[0], ends])[bounds]
    per_doc = (np.diff(bits) + 7) // 8
    doc_byte = np.concatenate([[0], np.cumsum(per_doc)])
    out = np.zeros(int(doc_byte[-1]) // 4 + 3, dtype=np.uint64)
    if not len(ids):
        return out.view(np.uint8)[:0], per_doc, marks
    ends += np.repeat(doc_byte[:-1] * 8 - bits[:-1], counts)
    at = ends - size
    cell = at >> 5
    # the last bit of a code stands (cell + 2) * 32 - end bits above the lowest of its two words
    value = codes.astype(np.uint64)[ids] << (((cell + 2) << 5) - ends).view(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    total = np.add.reduceat(value, first)  # bits are disjoint
    cell = cell[first]
    out[cell] += total >> np.uint64(32)
    out[cell + 1] += total & np.uint64(0xFFFFFFFF)
    doc = np.searchsorted(bounds, marks, side="right") - 1
    return out.astype(">u4").view(np.uint8)[: doc_byte[-1]], per_doc, at[marks] - doc_byte[doc] * 8


def decode_table(lengths: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every window of max_len bits."""
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (max_len - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << max_len, dtype=np.int32), np.ones(1 << max_len, dtype=np.uint8)
    total = int(span.sum())
    symbol[:total], size[:total] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbol, size


def unpack(payload: np.ndarray, bit: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray], max_len: int) -> np.ndarray:
    """Decode segments side by side: one table look-up gives the next id of each."""
    symbol, length = table
    b = np.concatenate([payload, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    window = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    order = np.argsort(-sizes, kind="stable")
    at, left = bit[order].astype(np.int64), sizes[order]
    start = (np.cumsum(sizes) - sizes)[order]
    out = np.empty(int(sizes.sum()), dtype=np.int32)
    alive = np.searchsorted(-left, -np.arange(int(left.max(initial=0))), side="left")  # segments with more than j ids
    for j, n in enumerate(alive):
        p = at[:n]
        w = (window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - max_len)
        out[start[:n] + j] = symbol[w]
        p += length[w]
    return out


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n, ids (little-endian, 2 bytes where the vocabulary allows), end_id last."""
    data = read_spec(tokenizer_path)
    spec, key = docs.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()

    def run(batches):
        def make():
            tok = library(spec.value)
            special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
            return WordEncoder(special, library_fill(tok), cutter(tok)), np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")

        enc, kind = once(f"library-{key}", make)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            for lo, hi in chunks(texts):
                ids, counts = enc.encode_pieces(texts[lo:hi])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(counts), binary(ids.astype(kind), counts)], ["doc_id", "n", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, ids binary")


def _ids(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    col = batch.column("ids")
    return np.frombuffer(b"".join(col.to_pylist()), dtype=kind).astype(np.int64)


def count_ids(stored: DataFrame, kind: str) -> DataFrame:
    """id, n over all documents: one array of sums in each task, then an aggregation by id."""

    def run(batches):
        total = np.zeros(1, dtype=np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                got = np.bincount(_ids(b.slice(lo, 512), kind), minlength=len(total))
                got[: len(total)] += total
                total = got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return map_arrow(stored.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _keys(ids: pa.Array) -> np.ndarray:
    """doc_ids with nulls before all others."""
    return ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)


def range_of(key: np.ndarray, tie: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of cuts (doc_id, tie) that are not above each (key, tie)."""
    lo, hi = np.searchsorted(cuts[0], key, side="left"), np.searchsorted(cuts[0], key, side="right")
    out = lo.copy()
    for i in np.flatnonzero(lo < hi):
        out[i] = lo[i] + np.searchsorted(cuts[1][lo[i] : hi[i]], tie[i], side="right")
    return out


#: Quantiles that the driver asks for at most; for more ranges than 1/8 of them, ranges grow instead.
QUANTILES = 1 << 16


def range_cuts(stored: DataFrame, n: int, fine: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """About n - 1 cuts (doc_id, tie), ascending, that part the ids of stored(doc_id, n) into ranges of like size.

    Quantiles of doc_id give `fine` buckets a range; their sums of ids (one number each) say
    where to cut. A bucket of several ranges' size is cut by tie, a checksum, in equal steps.
    """
    none, n = np.empty(0, dtype=np.int64), min(n, QUANTILES // fine)
    if n <= 1:
        return none, none
    at = np.array(sorted({int(x) for x in stored.approxQuantile("doc_id", [i / (n * fine) for i in range(1, n * fine)], 0.5 / (n * fine))}), dtype=np.int64)

    def run(batches):
        total = np.zeros(2 * len(at) + 1, dtype=np.int64)
        for b in batches:
            key = _keys(b.column("doc_id"))
            # bucket 2 i + 1 is the doc_id of a cut alone, 2 i what lies before it
            np.add.at(total, np.searchsorted(at, key, side="left") + np.searchsorted(at, key, side="right"), b.column("n").to_numpy())
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    sums = np.zeros(2 * len(at) + 1)
    for x in map_arrow(stored.select("doc_id", "n"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[x["bucket"]] = x["n"]
    step, held, ids, ties = max(1.0, sums.sum() / n), 0.0, [], []
    low = np.iinfo(np.int64).min
    for bucket, size in enumerate(sums):
        alone = bucket % 2 == 1
        # the first bucket may be all nulls, so it can be cut by tie of the nulls
        key = int(at[bucket // 2]) if alone else low if bucket == 0 else None
        if held and held + size > step and alone:
            ids.append(key)
            ties.append(0)
            held = 0.0
        if key is not None and size > 1.5 * step:
            k = int(size // step)
            ids += [key] * k
            ties += [(i + 1) * (1 << 32) // (k + 1) for i in range(k)]
            held, size = 0.0, size / (k + 1)
        held += size
    return np.array(ids, dtype=np.int64), np.array(ties, dtype=np.int64)


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, max_len: int = 16, range_bytes: int = 32 << 20) -> str:
    """Write the ids of docs(doc_id, text) as a token file under path; see the module for its layout."""
    spark = docs.sparkSession
    kind = "<u2" if library(read_spec(tokenizer_path)).get_vocab_size() <= 1 << 16 else "<u4"
    store = work_dir(spark, "ids")
    stored = saved(encode_ids(docs, tokenizer_path, end_id), store)
    counted = count_ids(stored, kind).collect()  # one row per vocabulary id at most
    counts = np.zeros(1 + max([x["id"] for x in counted], default=0), dtype=np.int64)
    for x in counted:
        counts[x["id"]] = x["n"]
    max_len = max(max_len, int(np.ceil(np.log2(max(2, np.count_nonzero(counts))))))
    if max_len > 24:
        raise ValueError("codes of more than 24 bits")
    lengths = code_lengths(counts, max_len)
    book = spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, length int").coalesce(1)
    book.write.parquet(f"{path}/codebook")

    size = int((counts * lengths).sum()) // 8
    n_ranges = max(1, size // range_bytes, min(spark.sparkContext.defaultParallelism, size >> 18))
    cuts = range_cuts(stored, n_ranges)
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), cuts))

    def coded(batches):
        size_of, codes, at = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                raw = b.column("ids").to_pylist()
                n = b.column("n").to_numpy()
                segs = (n + SEGMENT - 1) // SEGMENT
                first = ragged(np.zeros(len(n), dtype=np.int64), segs) * SEGMENT + np.repeat(np.cumsum(n) - n, segs)
                data, per_doc, bit = pack(_ids(b, kind), n, size_of, codes, first)
                seg_off = np.concatenate([[0], np.cumsum(segs)])
                ids = b.column("doc_id")
                tie = np.array([zlib.crc32(x) for x in raw], dtype=np.int64)
                to = range_of(_keys(ids), tie, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int32)), ids, pa.array(tie), pa.array(n), binary(data, per_doc), pa.ListArray.from_arrays(pa.array(seg_off.astype(np.int32)), pa.array(bit))],
                    ["range", "doc_id", "tie", "n", "payload", "seg_bits"],
                )

    def blocks(batches):
        at, held, first, block, size = None, [], 0, 0, 0

        def flush():
            sizes = [len(x["payload"]) for x in held]
            base = np.concatenate([[0], np.cumsum(sizes)])[:-1] * 8
            bits = np.concatenate([np.array(x["seg_bits"], dtype=np.int64) + o for x, o in zip(held, base, strict=True)])
            n = np.array([x["n"] for x in held])
            segs = (n + SEGMENT - 1) // SEGMENT
            seg = np.full(int(segs.sum()), SEGMENT)
            seg[np.cumsum(segs) - 1] = n - (segs - 1) * SEGMENT
            return pa.RecordBatch.from_pylist(
                [{"range": at, "block": block, "first": first, "n": int(n.sum()), "doc_ids": [x["doc_id"] for x in held], "doc_sizes": n.tolist(), "seg_sizes": seg.tolist(), "seg_bits": bits.tolist(), "payload": b"".join(x["payload"] for x in held)}],
                schema=layout,
            )

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                for x in whole.slice(lo, 256).to_pylist():
                    if held and (x["range"] != at or size >= BLOCK_IDS):
                        yield flush()
                        first, block, held, size = first + size, block + 1, [], 0
                    if x["range"] != at:
                        at, first, block = x["range"], 0, 0
                    held.append(x)
                    size += x["n"]
        if held:
            yield flush()

    layout = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("seg_sizes", pa.list_(pa.int32())), ("seg_bits", pa.list_(pa.int64())), ("payload", pa.binary())])
    kinds = "range int, block long, first long, n long, doc_ids array<long>, doc_sizes array<long>, seg_sizes array<int>, seg_bits array<long>, payload binary"
    parts = map_arrow(stored, coded, "range int, doc_id long, tie long, n long, payload binary, seg_bits array<long>")
    ordered = parts.repartitionById(len(cuts[0]) + 1, "range").sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "tie")
    map_arrow(ordered, blocks, kinds).write.parquet(f"{path}/blocks")
    remove(spark, store)
    return path


def read_token_file(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids BINARY (little-endian unsigned 32-bit)."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # one row per vocabulary id at most
    lengths = np.zeros(1 + max([x["id"] for x in book], default=0), dtype=np.uint8)
    for x in book:
        lengths[x["id"]] = x["length"]
    max_len = max(1, int(lengths.max(initial=1)))
    shared = spark.sparkContext.broadcast(lengths)

    def run(batches):
        table, before = decode_table(shared.value, max_len), bases.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 8):
                b = whole.slice(lo, 8)
                blocks = b.to_pylist()
                base = np.concatenate([[0], np.cumsum([len(x["payload"]) for x in blocks])]) * 8
                bit = np.concatenate([np.array(x["seg_bits"], dtype=np.int64) + o for x, o in zip(blocks, base[:-1], strict=True)])
                seg = np.concatenate([np.array(x["seg_sizes"], dtype=np.int64) for x in blocks])
                ids = unpack(np.frombuffer(b"".join(x["payload"] for x in blocks), dtype=np.uint8), bit, seg, table, max_len)
                n = np.concatenate([np.array(x["doc_sizes"], dtype=np.int64) for x in blocks])
                start = np.concatenate([before[x["range"]] + x["first"] + np.cumsum(x["doc_sizes"]) - x["doc_sizes"] for x in blocks])
                docs = [i for x in blocks for i in x["doc_ids"]]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start), pa.array(n), binary(ids.astype("<u4"), n)], ["doc_id", "start", "n_tokens", "ids"])

    stored = spark.read.parquet(f"{path}/blocks")
    totals = {x["range"]: x["n"] for x in stored.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # one row per range
    sums = np.zeros(2 + max(totals, default=0), dtype=np.int64)
    for r, n in totals.items():
        sums[r + 1] = n
    bases = spark.sparkContext.broadcast(np.cumsum(sums))  # one number per range
    return map_arrow(stored.select("range", "first", "doc_ids", "doc_sizes", "seg_sizes", "seg_bits", "payload"), run, "doc_id long, start long, n_tokens long, ids binary")


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_token_file(docs, work_dir(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))
