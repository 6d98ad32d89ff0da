r"""Substring dedup: fuzzy passages by collinear chaining of shared k-mer seeds.

Words are [^\x20\x09-\x0D]+ with A-Z lower-cased. Documents with the same
word sequence are one node. From every node come winnowed seeds: of W
consecutive k-mers of K words the least hash, so an exact common run of
K + W - 1 words has a common seed. A seed held by several nodes is owned by the
least of them, and the other holders match the owner (links follow the number
of holders, never its square). Matches of a pair of nodes are chained: a chain
ascends in both texts, weighs K for each match less GAP_COST for every word
between matches, and is found with a Fenwick tree over the owner's positions
for prefix maxima. Chains are aligned word by word, gaps by longest common
subsequence, ends by extension; parts of at least IDENTITY equal words are
passages. Passages of one node that touch are taken together, since different
owners may hold parts of one; together they must have min_words words.

The seeds of one passage may have several owners, or one owner elsewhere, and
then make no chain. So where a stretch of shared seeds is not inside the passages
along chains, exact runs are searched by themselves: every run of min_words
words of such a text is matched, at all its places, with the least node that
holds the whole run, and runs that go on in both texts are one passage. Of an
exact run of min_words words that a lesser node holds, its seeds and all words
between them are in some passage; W - 1 words at either end may stay where the
seeds' owner doesn't hold them. A passage without such a run (a fuzzy one) is
found by its chains alone.

Per document at most its own seeds, chains and words meet in one task. Owners
come from partial aggregates; seeds and runs that very many rows hold are joined
where the rows are (join_unique).

Rows are told apart by a hash of doc_id and text, so doc_ids may repeat or be
null. Defined cases: null or empty texts, and texts below K words, have no
seeds; copies of a word sequence repeat their first row's (the least doc_id,
then key; null ids last) as a whole if they have min_words words; rows that
repeat in doc_id and text are one row and not reported; a passage that recurs
only inside one document is none; very long texts are worked on whole, windows
of seeds in blocks; an empty table gives no rows; other columns are passed
through by cut_passages().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, bitmap, hash_bitmap, hash_in_bitmap, in_bitmap, join_unique, map_arrow, remove, row_key, run_hashes, saved, sequence_hash, shingles, sized, slot, words_of, work_dir

K, W = 6, 12
GAP_COST = 0.1
IDENTITY = 0.8
FLANK = 2 * (K + W)
MIN_WORDS = 45


def picks(h: np.ndarray, w: int) -> list[np.ndarray]:
    """For every w consecutive hashes the position of the least, in blocks."""
    out = []
    for lo in range(0, max(1, len(h) - w + 1), 1 << 16):  # blocks bound the memory for very long texts
        part = h[lo : lo + (1 << 16) + w - 1]
        seen = np.lib.stride_tricks.sliding_window_view(part, min(w, len(part)))
        out.append(seen.argmin(axis=1) + np.arange(lo, lo + len(seen)))
    return out


def winnow(words: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the seeds of a word sequence."""
    if len(words) < k:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    h = shingles(words, k)
    at = np.unique(np.concatenate([np.unique(x) for x in picks(h, w)]))
    return h[at], at


def shared_runs(words: np.ndarray, bits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the runs of n words all of whose seeds are in the bitmap."""
    if len(words) < n:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    at = np.arange(len(words) - n + 1)
    inner = n - (K + W - 1) + 1  # seeds that a run has whatever its neighbours
    if inner > 0:
        h = shingles(words, K)
        hit = np.concatenate([hash_in_bitmap(bits, h[x].view(np.int64)) for x in picks(h, W)])
        count = np.concatenate([[0], np.cumsum(hit)])
        at = np.flatnonzero(count[inner:] - count[:-inner] == inner)
    return run_hashes(words, n)[at], at


def node_of(words: np.ndarray) -> int | None:
    """Hash of a word sequence; the order of nodes decides who owns a passage."""
    return sequence_hash(words) if len(words) else None


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, dtype=kind)))


def seed_table(docs: DataFrame) -> DataFrame:
    """doc_id, key, node, n_words, h array<long>, pos array<int>, from docs(doc_id, key, text): one row per document.

    pos is -1 - position where the seed has occurred before in its text.
    """

    def first_or_again(h, at):
        again = np.ones(len(h), dtype=bool)
        again[np.unique(h, return_index=True)[1]] = False
        return np.where(again, -1 - at, at)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                words = [words_of(t)[0] for t in b.column("text").to_pylist()]
                got = [winnow(x) for x in words]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("key"), pa.array([node_of(x) for x in words], pa.int64()), pa.array([len(x) for x in words], pa.int64()), _lists([h.view(np.int64) for h, _ in got], np.int64), _lists([first_or_again(h, p) for h, p in got], np.int32)],
                    ["doc_id", "key", "node", "n_words", "h", "pos"],
                )

    return map_arrow(docs, run, "doc_id long, key long, node long, n_words long, h array<long>, pos array<int>")


def positions(pos: np.ndarray) -> np.ndarray:
    return np.where(pos < 0, -1 - pos, pos)


def owners(held: DataFrame, path: str) -> DataFrame:
    """h, owner (the least node that holds it), owner_pos (its first position there), c (rows), of what several nodes hold.

    held(node, h, pos): pos below 0 marks a further occurrence in the same node. Partial sums of each task are exchanged.
    """
    first = F.min_by("pos", F.when(F.col("pos") >= 0, F.col("node")))
    found = held.groupBy("h").agg(F.min("node").alias("owner"), first.alias("owner_pos"), F.max("node").alias("top"), F.count("*").alias("c"))
    return saved(found.filter("owner <> top").select("h", "owner", "owner_pos", "c"), path)


def shared_seeds(lists: DataFrame, bits) -> DataFrame:
    """node, h, pos of the seeds in a bitmap; an exact join drops those let through without need."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                h, pos = b.column("h"), b.column("pos")
                sizes = np.diff(h.offsets.to_numpy())
                flat = h.flatten().to_numpy()
                hit = hash_in_bitmap(bits.value, flat)
                node = np.repeat(b.column("node").to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(flat[hit]), pa.array(pos.flatten().to_numpy()[hit])], ["node", "h", "pos"])

    return map_arrow(lists, run, "node long, h long, pos int")


def in_stretches(aligned: DataFrame, min_words: int) -> DataFrame:
    """aligned passages with new, stretch and words: those of a node that overlap or touch make one stretch, which must have min_words words."""
    before = Window.partitionBy("node").orderBy("first", "last", "owner", "owner_first")
    reach = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    marked = aligned.withColumn("new", F.coalesce((F.col("first") > reach + 2).cast("int"), F.lit(1)))
    marked = marked.withColumn("stretch", F.sum("new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("node", "stretch")
    return marked.withColumn("words", F.max("last").over(whole) - F.min("first").over(whole)).filter(F.col("words") >= min_words)


def exact_runs(docs: DataFrame, table: DataFrame, nodes: DataFrame, aligned: DataFrame, bits, n: int, work: str) -> DataFrame | None:
    """node, owner, first, last, owner_first, owner_last of the runs of n words at least that a lesser node holds; None without any.

    bits: bitmap of the shared seeds. Runs ask that have a word in a stretch of
    shared seeds and outside the aligned passages. Their hashes are gathered, then
    the places of these runs in all texts with such stretches.
    """
    gap = n - (K + W - 1) - (W - 1)  # between the first and the last seed of a run, at least

    def stretches(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                h, pos = b.column("h"), positions(b.column("pos").flatten().to_numpy())
                sizes, hit = np.diff(h.offsets.to_numpy()), hash_in_bitmap(bits.value, h.flatten().to_numpy())
                row = np.repeat(np.arange(b.num_rows), sizes)
                at, row = np.flatnonzero(hit), row[hit]
                cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row) > 0)])) if len(at) else at
                end = np.append(cut[1:], len(at)) - 1 if len(at) else at
                first, last = pos[at[cut]].astype(np.int64), pos[at[end]].astype(np.int64)
                keep = last - first >= gap
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(row[cut[keep]])), pa.array(first[keep]), pa.array(last[keep] + K)], ["node", "lo", "hi"])

    asks = saved(map_arrow(table.select("node", "h", "pos"), stretches, "node long, lo long, hi long").distinct(), f"{work}/stretches")
    if n < K + W - 1:  # such runs need no seed: all texts ask
        asks = table.select("node", F.lit(0).alias("lo"), F.col("n_words").alias("hi")).distinct()
    whole = in_stretches(aligned, n).groupBy("node", "stretch").agg(F.min("first").alias("from"), F.max("last").alias("to"))
    opened = asks.join(whole, (asks["node"] == whole["node"]) & (whole["from"] <= asks["lo"]) & (whole["to"] >= asks["hi"]), "left_anti")
    opened = opened.groupBy("node").agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
    closed = whole.groupBy("node").agg(F.collect_list(F.struct("from", "to")).alias("closed"))
    opened = saved(opened.join(closed, "node", "left").join(nodes.select("node", "first.key"), "node"), f"{work}/opened")
    if opened.isEmpty():
        return None

    def asked_in(batches):
        """The runs with a word that lies in a stretch of shared seeds and in no passage."""
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                out = [np.empty(0, dtype=np.int64)]
                for x in whole.slice(lo, 128).to_pylist():
                    words = words_of(x["text"])[0]
                    bare = np.zeros(len(words) + 1, dtype=np.int64)
                    for z in x["open"]:
                        bare[z["lo"] + 1 : z["hi"] + 1] = 1
                    for z in x["closed"] or ():
                        bare[z["from"] + 1 : z["to"] + 1] = 0
                    bare = np.cumsum(bare)
                    h, p = shared_runs(words, bits.value, n)
                    out.append(h.view(np.int64)[bare[p + n] > bare[p]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["h"])

    asking = docs.select("key", "text").join(sized(opened.drop("node"), 100_000), "key").select("text", "open", "closed")
    asked = saved(map_arrow(asking, asked_in, "h long").distinct(), f"{work}/asked")
    also, wanted = hash_bitmap(asked, "h"), bitmap(asks.select("node").distinct().join(nodes.select("node", "first.key"), "node"), "key")  # copies have their node's runs

    def run(batches):
        for whole in batches:
            take = np.flatnonzero(in_bitmap(wanted.value, whole.column("slot").to_numpy()))
            for lo in range(0, len(take), 256):
                parts = []
                for t in whole.column("text").take(pa.array(take[lo : lo + 256])).to_pylist():
                    words = words_of(t)[0]
                    h, p = shared_runs(words, bits.value, n)
                    hit = hash_in_bitmap(also.value, h.view(np.int64))
                    if hit.any():
                        h, p = h.view(np.int64)[hit], p[hit]
                        again = np.ones(len(h), dtype=bool)
                        again[np.unique(h, return_index=True)[1]] = False
                        parts.append((np.full(len(h), node_of(words)), h, np.where(again, -1 - p, p).astype(np.int32)))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], ["node", "h", "pos"])

    places = saved(map_arrow(docs.select(slot("key").alias("slot"), "text"), run, "node long, h long, pos int"), f"{work}/places")
    owned = join_unique(places, owners(places, f"{work}/run-owners"), "h").filter("node <> owner")
    owned = owned.withColumn("pos", F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")))
    owned = owned.select("node", "owner", (F.col("pos") - F.col("owner_pos")).alias("shift"), "pos")
    along = Window.partitionBy("node", "owner", "shift").orderBy("pos")
    parts = owned.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(along) > n).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(along))
    runs = parts.groupBy("node", "owner", "shift", "part").agg(F.min("pos").cast("long").alias("first"), (F.max("pos") + n).cast("long").alias("last"))
    runs = runs.select("node", "owner", "first", "last", (F.col("first") - F.col("shift")).alias("owner_first"), (F.col("last") - F.col("shift")).alias("owner_last"))
    return saved(runs, f"{work}/runs")


def least_cover(first: list[int], last: list[int], covered: list[tuple[int, int]]) -> list[int]:
    """Numbers of the fewest runs (first ascending) that hold, with what is covered (ascending), every word of all runs."""
    keep, at, i, j, best, reach = [], -1, 0, 0, -1, -1
    while True:
        while j < len(covered) and covered[j][0] <= at:
            at, j = max(at, covered[j][1]), j + 1
        while i < len(first) and first[i] <= at:
            if last[i] > reach:
                best, reach = i, last[i]
            i += 1
        if reach > at:
            keep.append(best)
            at = reach
        elif i < len(first):
            at = first[i]
        else:
            return keep


def with_rest(aligned: DataFrame, runs: DataFrame) -> DataFrame:
    """Passages along chains and, of the runs, those needed for the words that no chain's passage covers.

    A word repeated over and over matches at every shift; the same words are not
    told again for each.
    """
    names = aligned.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("first", "ascending"), ("last", "descending")])
        is_run = table.column("is_run").to_numpy()
        at = np.flatnonzero(is_run)
        if len(at):
            first, last = table.column("first").to_numpy(), table.column("last").to_numpy()
            kept = least_cover(first[at].tolist(), last[at].tolist(), list(zip(first[~is_run].tolist(), last[~is_run].tolist(), strict=True)))
            table = table.take(pa.array(np.sort(np.concatenate([np.flatnonzero(~is_run), at[np.array(kept, dtype=np.int64)]]))))
        return table.select(names)

    both = aligned.withColumn("is_run", F.lit(False)).unionByName(runs.withColumn("identity", F.lit(1.0)).withColumn("is_run", F.lit(True)))
    return both.groupBy("node").applyInArrow(run, aligned.schema)


def chain(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Best chains of matches (x ascending; y), each an array of match numbers; every match is in one at most."""
    n = len(x)
    dx, dy = np.diff(x), np.diff(y)
    if n == 1 or ((dx > 0) & (dy > 0) & (GAP_COST * (dx + dy) < K)).all():
        return [np.arange(n)]
    ranks = np.searchsorted(np.unique(y), y) + 1
    size = int(ranks.max())
    best, who = [-1e18] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    waiting: list[int] = []
    for i in range(n):
        while waiting and x[waiting[0]] < x[i]:  # matches at the same word of x don't follow each other
            j = waiting.pop(0)
            v, r = score[j] + GAP_COST * float(x[j] + y[j]), int(ranks[j])
            while r <= size:
                if v > best[r]:
                    best[r], who[r] = v, j
                r += r & -r
        v, j, r = -1e18, -1, int(ranks[i]) - 1
        while r:
            if best[r] > v:
                v, j = best[r], who[r]
            r -= r & -r
        gain = v - GAP_COST * float(x[i] + y[i])
        score[i], back[i] = (K + gain, j) if j >= 0 and gain > 0 else (float(K), -1)
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(np.array(path[::-1]))
    return out


def chain_matches(matches: DataFrame) -> DataFrame:
    """node, owner, xs, ys of every chain of two matches at least that span K words, from matches(node, owner, pos, owner_pos).

    A line that recurs inside a document matches its owner's first occurrence
    again and again; such matches alone make no chain.
    """
    kinds = pa.schema([("node", pa.int64()), ("owner", pa.int64()), ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32()))])

    def run(batches):
        key, xs, ys = None, [], []

        def done():
            p = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)], axis=1), axis=0)
            found = (p[c] for c in chain(p[:, 0], p[:, 1]) if len(c) > 1)
            return [{"node": key[0], "owner": key[1], "xs": c[:, 0].tolist(), "ys": c[:, 1].tolist()} for c in found if c[-1, 0] - c[0, 0] >= K]

        for b in batches:
            node, owner, x, y = (b.column(c).to_numpy() for c in ("node", "owner", "pos", "owner_pos"))
            if not len(node):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (owner[1:] != owner[:-1])]))
            rows = []
            for lo, hi in zip(cut, np.append(cut[1:], len(node)), strict=True):
                if key != (k := (int(node[lo]), int(owner[lo]))):
                    if xs:
                        rows += done()
                    key, xs, ys = k, [], []
                xs.append(x[lo:hi])
                ys.append(y[lo:hi])
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if xs:
            yield pa.RecordBatch.from_pylist(done(), schema=kinds)

    ordered = matches.repartition("node", "owner").sortWithinPartitions("node", "owner", "pos", "owner_pos")
    return map_arrow(ordered, run, "node long, owner long, xs array<int>, ys array<int>")


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for v in a:
        new = np.maximum(row[1:], row[:-1] + (b == v))
        row = np.concatenate([[0], np.maximum.accumulate(new)])
    return int(row[-1])


def extend(equal: np.ndarray) -> int:
    """Words by which a run goes on: the best prefix at +1 for an equal word and -4 for another."""
    if not len(equal):
        return 0
    score = np.cumsum(np.where(equal, 1, -4))
    top = int(score.argmax())
    return top + 1 if score[top] > 0 else 0


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Passages (a from, to, b from, to, identity) along a chain; xs, ys: starts of its matches in a and b."""
    out, i, n = [], 0, len(xs)
    while i < n:
        x0, y0, x1, y1 = int(xs[i]), int(ys[i]), int(xs[i]) + K, int(ys[i]) + K
        equal = length = K
        score = float(K)
        i += 1
        while i < n:
            x, y = int(xs[i]), int(ys[i])
            if x < x1 or y < y1:  # overlapping matches, or a small shift inside a repetition
                step = min(x + K - x1, y + K - y1)
                if x - x1 == y - y1:
                    same = wide = max(0, step)
                    x1, y1 = max(x1, x + K), max(y1, y + K)
                else:
                    same = wide = 0
                gain = same
            else:
                ga, gb = a[x1:x], b[y1:y]
                wide = max(len(ga), len(gb)) + K
                same = (int((ga == gb).sum()) if len(ga) == len(gb) else common_subsequence(ga, gb)) + K
                gain = same - 4 * (wide - same)
                if score + gain - K < 0:
                    break
                x1, y1 = x + K, y + K
            score = max(score + gain, 0.0)
            equal, length = equal + same, length + wide
            i += 1
        m = min(len(a) - x1, len(b) - y1)
        right = extend(a[x1 : x1 + m] == b[y1 : y1 + m])
        m = min(x0, y0)
        left = extend((a[x0 - m : x0] == b[y0 - m : y0])[::-1])
        equal += int((a[x1 : x1 + right] == b[y1 : y1 + right]).sum()) + int((a[x0 - left : x0] == b[y0 - left : y0]).sum())
        length += left + right
        if equal >= IDENTITY * length:
            out.append((x0 - left, x1 + right, y0 - left, y1 + right, equal / length))
    return out


#: Chains that meet one copy of their owner's words, about; owners' words are cut on a grid, so that few cuts differ.
MEETING, GRID = 1_000, 64


def align_chains(docs: DataFrame, chains: DataFrame, nodes: DataFrame, work: str) -> DataFrame:
    """node, owner, first, last, owner_first, owner_last (ends exclusive), identity of the passages along chains.

    Of the texts only the words of chains and their flanks are exchanged: first
    by node, where they are cut, then by the stretch of the owner. An owner's
    stretch is sent once for every MEETING chains that need it, not once for
    each chain.
    """
    from_to = lambda p: (F.greatest(F.lit(0), F.element_at(p, 1) - FLANK), F.element_at(p, -1) + K + FLANK)
    (lo_a, hi_a), (lo_b, hi_b) = from_to("xs"), from_to("ys")
    lo_b, hi_b = (F.floor(lo_b / GRID) * GRID).cast("int"), (F.ceil(hi_b / GRID) * GRID).cast("int")
    cut = chains.select("node", "owner", "xs", "ys", lo_a.alias("lo"), hi_a.alias("hi"), lo_b.alias("lo_b"), hi_b.alias("hi_b"), F.xxhash64("owner", lo_b, hi_b).alias("span"))
    sizes = cut.groupBy("span").agg(F.first("owner").alias("owner"), F.first("lo_b").alias("lo_b"), F.first("hi_b").alias("hi_b"), F.count("*").alias("c"))
    sizes = saved(sizes.withColumn("parts", F.ceil(F.col("c") / MEETING).cast("int")), f"{work}/spans")
    none = lambda kind: F.lit(None).cast(kind)
    ask = join_unique(cut.drop("hi_b"), sizes.select("span", "parts", "c"), "span")
    salt = F.pmod(F.xxhash64("node", "xs"), F.col("parts")).cast("int").alias("salt")
    names = ["node", "kind", "span", "salt", "lo", "hi", "owner", "xs", "ys", "lo_b", "words"]
    ask = ask.select("node", F.lit(2).alias("kind"), "span", salt, "lo", "hi", "owner", "xs", "ys", "lo_b", none("array<int>").alias("words"))
    lead = sizes.select(
        F.col("owner").alias("node"), F.lit(1).alias("kind"), "span", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("lo_b").alias("lo"), F.col("hi_b").alias("hi"),
        "owner", none("array<int>").alias("xs"), none("array<int>").alias("ys"), "lo_b", none("array<int>").alias("words"),
    )
    both = saved(ask.unionByName(lead), f"{work}/asks")
    wanted = both.select("node").distinct().join(nodes.select("node", "first.key"), "node").select("key")
    bits = bitmap(wanted, "key")

    def fetch(batches):
        for whole in batches:
            at = np.flatnonzero(in_bitmap(bits.value, whole.column("slot").to_numpy()))
            for lo in range(0, len(at), 256):
                words = [words_of(t)[0] for t in whole.column("text").take(pa.array(at[lo : lo + 256])).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in words], pa.int64()), _lists([x.astype(np.uint32).view(np.int32) for x in words], np.int32)], ["node", "words"])

    texts = map_arrow(docs.select(slot("key").alias("slot"), "text"), fetch, "node long, words array<int>")
    blank = {"kind": "int", "span": "long", "salt": "int", "lo": "int", "hi": "int", "owner": "long", "xs": "array<int>", "ys": "array<int>", "lo_b": "int"}
    texts = texts.filter("node IS NOT NULL").select("node", F.lit(0).alias("kind"), *[none(t).alias(c) for c, t in blank.items() if c != "kind"], "words")

    def slices(batches):
        now, words = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                kind, node = b.column("kind").to_numpy(), b.column("node").to_numpy()
                first, last = (b.column(c).fill_null(0).to_numpy() for c in ("lo", "hi"))
                take, cuts = [], []
                for i in range(b.num_rows):
                    if kind[i] == 0:  # rows of a text that repeats follow each other
                        now, words = node[i], b.column("words")[i].values.to_numpy()
                    elif node[i] == now:
                        take.append(i)
                        cuts.append(words[first[i] : last[i]])
                got = b.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(got.column(c) for c in names[:-1]), _lists(cuts, np.int32)], names)

    kinds = "node long, kind int, span long, salt int, lo int, hi int, owner long, xs array<int>, ys array<int>, lo_b int, words array<int>"
    met = both.unionByName(texts).select(*names).repartition("node").sortWithinPartitions("node", "kind")
    met = map_arrow(met, slices, kinds).repartition("span", "salt").sortWithinPartitions("span", "salt", "kind")
    out = ["node", "owner", "first", "last", "owner_first", "owner_last", "identity"]

    def run(batches):
        now, b = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                rows, part = [], whole.slice(lo, 128)
                for i, r in enumerate(part.select([c for c in names if c != "words"]).to_pylist()):
                    words = part.column("words")[i].values.to_numpy()
                    if r["kind"] == 1:
                        now, b = (r["span"], r["salt"]), words
                    elif now == (r["span"], r["salt"]):
                        got = align(words, b, np.array(r["xs"]) - r["lo"], np.array(r["ys"]) - r["lo_b"])
                        rows += [(r["node"], r["owner"], x0 + r["lo"], x1 + r["lo"], y0 + r["lo_b"], y1 + r["lo_b"], same) for x0, x1, y0, y1, same in got]
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.float64())], out)

    return map_arrow(met, run, "node long, owner long, first long, last long, owner_first long, owner_last long, identity double")


def find_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, other_id, first, last, other_first, other_last (word numbers, ends exclusive), identity, key.

    doc_id repeats a passage that other_id keeps: other_id's node is the less. key tells rows with one doc_id apart.
    """
    spark, work = docs.sparkSession, work_dir(docs.sparkSession, "passages")
    docs = docs.select("doc_id", row_key().alias("key"), "text")
    table = saved(seed_table(docs), f"{work}/seeds").filter("node IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = saved(table.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("c")), f"{work}/nodes")
    lists = table.select("node", "h", "pos")
    nodes_of = lists.select("node", F.explode("h").alias("h")).groupBy("h").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    bits = hash_bitmap(saved(nodes_of.filter("least <> most").select("h"), f"{work}/shared"), "h")
    held = saved(shared_seeds(lists, bits), f"{work}/held")
    matches = join_unique(held, owners(held, f"{work}/owned"), "h").filter("node <> owner")
    at = F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos")
    matches = matches.select("node", "owner", at, "owner_pos").distinct()
    chains = saved(chain_matches(matches), f"{work}/chains")
    aligned = saved(align_chains(docs, chains, nodes, work), f"{work}/aligned")
    runs = exact_runs(docs, table, nodes, aligned, bits, min_words, work)
    if runs is not None:
        aligned = saved(with_rest(aligned, runs), f"{work}/rest")

    marked = in_stretches(aligned, min_words)
    own = nodes.select("node", "first.doc_id", "first.key")
    found = marked.select("node", "owner", *[F.col(c).alias(f"p_{c}") for c in ("first", "last", "owner_first", "owner_last")], "identity").join(own, "node")
    found = saved(found, f"{work}/found")
    others = found.groupBy("owner").agg(F.count("*").alias("c")).join(nodes.select(F.col("node").alias("owner"), F.col("first.doc_id").alias("other_id")), "owner")
    found = join_unique(found, saved(others, f"{work}/others"), "owner")
    columns = ["doc_id", "other_id", "first", "last", "other_first", "other_last", "identity", "key"]
    found = found.select("doc_id", "other_id", F.col("p_first").alias("first"), F.col("p_last").alias("last"), F.col("p_owner_first").alias("other_first"), F.col("p_owner_last").alias("other_last"), "identity", "key")
    zero = F.lit(0).cast("long")
    many = saved(nodes.filter("c > 1").select("node", F.col("first.doc_id").alias("other_id"), F.col("first.key").alias("kept"), "c"), f"{work}/many")
    copies = join_unique(table.filter(F.col("n_words") >= min_words).select("node", "doc_id", "key", "n_words"), many, "node").filter("key <> kept")
    copies = copies.select("doc_id", "other_id", zero.alias("first"), F.col("n_words").alias("last"), zero.alias("other_first"), F.col("n_words").alias("other_last"), F.lit(1.0).alias("identity"), "key")
    for name in ("shared", "owned", "held", "chains", "aligned", "spans", "asks", "stretches", "opened", "asked", "places", "run-owners", "runs", "rest"):
        remove(spark, f"{work}/{name}")
    return found.unionByName(copies).select(*columns)


def cut_passages(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """docs(doc_id, text, ...) with the words of their passages cut out of text; a document left without words goes.

    Passages belong to rows by the key of doc_id and text, so rows that share a
    doc_id keep their own. Copies of a document that was cut would lose the
    passage as well; they are passages of their own, as a whole.
    """
    work = work_dir(docs.sparkSession, "spans")
    spans = passages.groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("__spans"))
    spans = sized(saved(spans, work), 100_000)
    marked = docs.withColumn("__key", F.xxhash64("doc_id", text)).join(spans, "__key", "left").select(*docs.columns, "__spans")
    names = docs.columns

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts, keep = b.column(text).to_pylist(), []
                for i, (t, s) in enumerate(zip(texts, b.column("__spans").to_pylist(), strict=True)):
                    if s:
                        raw = t.encode("utf-8", "surrogatepass")
                        _, start, end = words_of(t)
                        parts, at, gone = [], 0, 0
                        for x in s:
                            a, z = max(x["first"], gone), x["last"]
                            if z > a:
                                parts.append(raw[at : start[a]])
                                at, gone = int(end[z - 1]), z
                        texts[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass").strip()
                    keep.append(not s or bool(texts[i]))
                cols = [pa.array(texts, pa.string()) if c == text else b.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep))

    return map_arrow(marked, run, docs.schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_passages(docs)
