r"""N-gram Jaccard join: classes of documents linked by T-occurrence search on word shingles.

A document's set: hashes of its distinct 5-word shingles (words
[^\x20\x09-\x0D]+ with A-Z lower-cased; fewer words make one shingle). Two
documents link when den * intersection >= num * union. The result is exact;
no list, group or partner count has a cap. Copies meet once, as one set.

1. Executors hash every whole text. Per document they give the size, a
   fingerprint of the set and a prefix in hash order: linked sets share at
   least `least` of their first prefix_size hashes.
2. Search: sets that share one of their few lowest hashes with others go to
   the group of that hash's least fingerprint (large groups in salted parts,
   each with that set). Inside a group every set is a T-occurrence query over
   the inverted lists of the leaders so far (DivideSkip: heap-merge the short
   lists, binary-probe the longest); a set that reaches no leader becomes one.
   Verified links give components; most links are inside one after this.
3. The rest, exactly: a link between different components needs `least` common
   prefix hashes, so hashes held by one component alone are out, then sets with
   fewer other hashes than that, then, by the same rule on half of each set,
   what merely shares passages. Sets left over are searched once more, in
   clusters of sets that share one of their rarest hashes (DivideSkip: all but
   the T - 1 longest lists are merged, what they give is probed in the long ones
   while it can still reach T).
4. Components of all links; component_id is the least doc_id.

Rows are told apart by a hash of doc_id and text, so doc_ids may repeat or be
null. Defined cases: null or empty texts and texts without words have the empty
set and link with nothing; rows with a null doc_id link like any other (a class
of nothing else has the component_id null); repeated rows and doc_ids stay, all
rows of one doc_id in the classes of their own texts; a very long text is one
set, hashed in blocks; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, bitmap, components, hash_bitmap, hash_in_bitmap, in_bitmap, join_unique, map_arrow, mix, remove, row_key, saved, shingles, sized, slot, words_of, work_dir

LOW = 4
#: Sets in one part of a group at most, and sets that ask one copy of a part, about.
GROUP_SETS, CHUNK_ASKS = 2_000, 1_000


def document_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingles(words_of(text)[0], k))


def fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        v = np.array([s.sum(dtype=U) + U(len(s)) * U(0x9E3779B97F4A7C15), np.bitwise_xor.reduce(s)], dtype=U)
        return int(mix(mix(v[:1]) + v[1:])[0].view(np.int64))


class Threshold:
    """Bounds that follow from den * intersection >= num * union, in integers."""

    def __init__(self, num: int = 80, den: int = 100) -> None:
        self.num, self.den = num, den

    def links(self, inter: int, a: int, b: int) -> bool:
        return self.den * inter >= self.num * (a + b - inter)

    def least_overlap(self, n: int) -> int:
        """The least intersection of a set of n with any partner."""
        return -(-self.num * n // self.den)

    def equal_overlap(self, n: int) -> int:
        """The least intersection of a set of n with a partner of n or more."""
        return -(-2 * self.num * n // (self.den + self.num))

    def least(self, n: int) -> int:
        """Common hashes that prefix_size guarantees."""
        return max(1, -(-n // 20))

    def prefix_size(self, n: int) -> int:
        return min(n, n - self.least_overlap(n) + self.least(n))

    def half_least(self, n: int) -> int:
        return max(1, -(-n // 2) - (n - self.least_overlap(n)))


class Leaders:
    """Inverted lists over the sets that lead, as sorted tuples of leader numbers."""

    def __init__(self, rule: Threshold, most: int = 400_000) -> None:
        self.rule, self.most = rule, most
        self.clear()

    def clear(self) -> None:
        self.lists: dict[int, tuple[int, ...]] = {}
        self.sets: list[tuple[int, int]] = []
        self.size = 0

    def add(self, node: int, hashes: list[int]) -> None:
        if self.size > self.most:  # bounds memory; step 3 of the module finds what this may leave
            self.clear()
        k = len(self.sets)
        self.sets.append((node, len(hashes)))
        self.size += len(hashes)
        for h in hashes:
            self.lists[h] = (*self.lists.get(h, ()), k)

    def search(self, hashes: list[int]) -> list[int]:
        """Leaders that link with the set: T-occurrence by DivideSkip."""
        n = len(hashes)
        t = self.rule.least_overlap(n)
        get = self.lists.get
        found = [x for h in hashes if (x := get(h)) is not None]
        if len(found) < t:
            return []
        weight = Counter(found)  # equal lists are merged once, with their number
        lists = sorted(weight, key=len)
        longest = len(lists[-1])
        aside = min(t - 1, int(t / (0.01 * np.log2(longest + 1) + 1)) if longest > 8 else 0)
        long: list[tuple[int, ...]] = []
        held = 0
        while len(lists) > 1 and held + weight[lists[-1]] <= aside:
            held += weight[lists[-1]]
            long.append(lists.pop())
        heap = [(x[0], i, 0) for i, x in enumerate(lists)]
        heapq.heapify(heap)
        out = []
        while heap:
            k, count = heap[0][0], 0
            while heap and heap[0][0] == k:
                _, i, at = heap[0]
                count += weight[lists[i]]
                if at + 1 < len(lists[i]):
                    heapq.heapreplace(heap, (lists[i][at + 1], i, at + 1))
                else:
                    heapq.heappop(heap)
            rest = held
            for x in long:
                if count + rest < t:
                    break
                rest -= weight[x]
                p = bisect_left(x, k)
                count += weight[x] if p < len(x) and x[p] == k else 0
            if count >= t and self.rule.links(count, n, self.sets[k][1]):
                out.append(self.sets[k][0])
        return out


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, dtype=U)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, rule: Threshold, k: int) -> DataFrame:
    """doc_id, key, n, node (the set's fingerprint), low (lowest hashes), prefix, from docs(doc_id, key, text)."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                sets = [document_set(t, k) for t in b.column("text").to_pylist()]
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()), _list_column([s[:LOW] for s in sets]), _list_column([s[: rule.prefix_size(len(s))] for s in sets])],
                    ["doc_id", "key", "n", "node", "low", "prefix"],
                )

    return map_arrow(docs, run, "doc_id long, key long, n long, node long, low array<long>, prefix array<long>")


def fetch_sets(docs: DataFrame, wanted: DataFrame, k: int, half: bool = False) -> DataFrame:
    """wanted(node, rep, ...) with the set of each: whole, or its lower half, hashed again from the text of the row with key rep.

    docs(doc_id, key, text, repeated): repeated says that rows may repeat. wanted must be stored; it is broadcast if small.
    """
    bits = bitmap(wanted, "rep")

    def run(batches):
        for whole in batches:
            at = np.flatnonzero(in_bitmap(bits.value, whole.column("slot").to_numpy()))
            for lo in range(0, len(at), 256):
                b = whole.take(pa.array(at[lo : lo + 256]))
                sets = [document_set(t, k) for t in b.column("text").to_pylist()]
                nodes = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("rep"), nodes, _list_column([s[: -(-len(s) // 2)] if half else s for s in sets])], ["rep", "node", "set"])

    sets = map_arrow(docs.select(F.col("key").alias("rep"), slot("key").alias("slot"), "text"), run, "rep long, node long, set array<long>")
    if "repeated" in docs.columns:
        sets = sets.join(wanted.select("rep", "node").distinct(), ["rep", "node"], "left_semi").dropDuplicates(["rep", "node"])
    return sets.join(sized(wanted), ["rep", "node"])


def search_groups(members: DataFrame, rule: Threshold) -> DataFrame:
    """Verified links (a, b) from members(group, salt, head, node, set): leaders and queries, group after group."""

    def run(batches):
        now, lead = None, Leaders(rule)
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                a, b = [], []
                for x in whole.slice(lo, 64).to_pylist():
                    if (x["group"], x["salt"]) != now:
                        now = (x["group"], x["salt"])
                        lead.clear()
                    hit = lead.search(x["set"])
                    if not hit:
                        lead.add(x["node"], x["set"])
                    a += [x["node"]] * len(hit)
                    b += hit
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = members.repartition("group", "salt").sortWithinPartitions("group", "salt", F.desc("head"), "node")
    return map_arrow(ordered, run, "a long, b long")


class Inverted:
    """Posting lists of some sets, in two arrays; searched by DivideSkip with whole lists at a time."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray) -> None:
        flat = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.lexsort((doc, flat))
        self.hashes, first = np.unique(flat[order], return_index=True)
        self.docs, self.first = doc[order], np.append(first, len(flat))
        self.sizes = sizes

    def search(self, s: np.ndarray, n: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, intersections) of those in t or more lists of s.

        A document in t lists is in one at least of all but t - 1: the longest
        ones are put aside, the others merged, and what they give is probed in
        the long ones while it can still reach t.
        """
        at = np.minimum(np.searchsorted(self.hashes, s), len(self.hashes) - 1)
        at = at[self.hashes[at] == s]
        lo, hi = self.first[at], self.first[at + 1]
        if len(at) < t:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        order = np.argsort(hi - lo, kind="stable")
        short, long = order[: len(order) - t + 1], order[len(order) - t + 1 :]
        docs, count = np.unique(np.concatenate([self.docs[lo[i] : hi[i]] for i in short]), return_counts=True)
        for done, i in enumerate(long):
            may = count + (len(long) - done) >= t
            if not may.all():
                docs, count = docs[may], count[may]
            if not len(docs):
                break
            held = self.docs[lo[i] : hi[i]]
            p = np.minimum(np.searchsorted(held, docs), len(held) - 1)
            count = count + (held[p] == docs)
        enough = count >= t
        return docs[enough], count[enough]


def search_clusters(members: DataFrame, rule: Threshold) -> DataFrame:
    """Links (a, b) between components from members(part, chunk, kind 0 indexed or 1 asking, node, n, comp, set).

    A query takes partners of its own size or larger, so its overlap must reach
    what two sets of its size need. Of the links that a part finds, those that
    join nothing new are left out.
    """

    def run(batches):
        now, held, index, up = None, [], None, {}

        def top(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                a, b = [], []
                for x in whole.slice(lo, 64).to_pylist():
                    if (x["part"], x["chunk"]) != now:
                        now, held, index, up = (x["part"], x["chunk"]), [], None, {}
                    if x["kind"] == 0:
                        held.append((x["node"], x["n"], x["comp"], np.array(x["set"], dtype=np.int64)))
                        continue
                    if index is None:
                        index = Inverted([h[3] for h in held], np.array([h[1] for h in held])) if held else False
                    if not index:
                        continue
                    n = x["n"]
                    docs, count = index.search(np.array(x["set"], dtype=np.int64), n, rule.equal_overlap(n))
                    for k, c in zip(docs.tolist(), count.tolist(), strict=True):
                        node, m, comp, _ = held[k]
                        if m >= n and comp != x["comp"] and rule.links(c, n, m) and top(comp) != top(x["comp"]):
                            up[top(comp)] = top(x["comp"])
                            a.append(x["node"])
                            b.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = members.repartition("part", "chunk").sortWithinPartitions("part", "chunk", "kind", "node")
    return map_arrow(ordered, run, "a long, b long")


def across(sets: DataFrame, col: str, path: str):
    """Bitmap of the hashes that several components hold, one of them with a set that asks, from sets(col, comp, asks)."""
    rows = sets.select("comp", "asks", F.explode(col).alias("h"))
    ends = rows.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("asks").alias("z"))
    return hash_bitmap(saved(ends.filter("x <> y AND z").select("h"), path), "h")


def sieve(sets: DataFrame, col: str, bits, keep_set: bool = False) -> DataFrame:
    """sets(node, n, comp, col) with held, the number of hashes that the bitmap has; with keep_set cut down to these.

    The bitmap may have some more hashes than it should. They are kept or
    dropped in all sets alike, so counts are bounds from above and common
    hashes are complete.
    """

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                lists = b.column(col)
                flat = lists.flatten().to_numpy()
                hit = hash_in_bitmap(bits.value, flat)
                total = np.concatenate([[0], np.cumsum(hit)])
                off = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                held = np.diff(total[off])
                cols = [b.column(c) for c in ("node", "n", "comp")] + [pa.array(held, pa.int64())]
                if keep_set:
                    cols.append(pa.ListArray.from_arrays(pa.array(total[off].astype(np.int32)), pa.array(flat[hit])))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["node", "n", "comp", "held"] + ["set"] * keep_set
    return map_arrow(sets.select("node", "n", "comp", col), run, "node long, n long, comp long, held long" + ", set array<long>" * keep_set)


def rare_first(sets: DataFrame, least, path: str) -> DataFrame:
    """sets(node, n, held, set) -> node, rare: the held - least + 1 hashes of the set that fewest sets hold, rarest first.

    Two sets with `least` common hashes each have one of those in common.
    """
    rows = sets.select("node", F.explode("set").alias("h"))
    counts = saved(rows.groupBy("h").agg(F.count("*").alias("c")), path).withColumn("holders", F.col("c"))
    ranked = join_unique(rows, counts, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "h"))).alias("all"))
    ranked = ranked.join(sets.select("node", (F.col("held") - least + 1).cast("int").alias("p")), "node")
    return ranked.select("node", F.slice("all.h", 1, F.greatest("p", F.lit(1))).alias("rare"))


def last_search(docs: DataFrame, few: DataFrame, rule: Threshold, k: int, work: str, part: int) -> DataFrame:
    """Links between the components of few(node, n, comp, rep), which hold what the filters left.

    Of two linked sets the smaller one asks. Whole sets are cut down to hashes
    that several components hold, one of them with a set large enough to ask;
    sets without enough of these go, three times over. Sets that share one of
    their rarest hashes form clusters (the most frequent hashes join nothing).
    A cluster is indexed in parts of about `part` hashes; a set asks the parts
    that hold one of its own rarest hashes, and those that ask one part are dealt
    over copies of it, so no task grows with its cluster.
    """
    least, ask = F.expr(f"-floor(-{rule.num} * n / {rule.den})"), F.expr(f"-floor(-2 * {rule.num} * n / {rule.den + rule.num})")
    sets = fetch_sets(docs, few, k)
    sets = saved(sets.select("node", "n", "comp", "set", F.lit(True).alias("asks")), f"{work}/whole")
    for i in range(3):
        cut = sieve(sets, "set", across(sets, "set", f"{work}/across-{i}"), keep_set=True).filter(F.col("held") >= least)
        sets = saved(cut.select("node", "n", "comp", "set", "held", (F.col("held") >= ask).alias("asks")), f"{work}/cut-{i}")
    rare = saved(rare_first(sets, least, f"{work}/holders"), f"{work}/rare")
    rows = rare.select("node", F.explode("rare").alias("h"))
    owner = rows.groupBy("h").agg(F.min("node").alias("b"), F.max("node").alias("z"), F.count("*").alias("c")).filter("b <> z").select("h", "b", "c")
    cluster = components(join_unique(rows, saved(owner, f"{work}/owners"), "h").select(F.col("node").alias("a"), "b"), f"{work}/clusters")
    if cluster is None:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    sets = saved(sets.join(cluster, "node").withColumnRenamed("root", "cluster"), f"{work}/clustered")
    sizes = saved(sets.groupBy("cluster").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts"), F.count("*").alias("c")), f"{work}/sizes")
    dealt = join_unique(sets.select("node", "cluster", "n", "held", "asks"), sizes, "cluster")
    # a part's number is a hash of its cluster and its place there
    dealt = saved(dealt.select("node", F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("part"), (F.col("held") - ask + 1).cast("int").alias("p"), "asks"), f"{work}/dealt")
    places = rows.join(dealt.select("node", "part"), "node").select("h", "part").distinct()
    wants = rare.join(dealt.filter("asks").select("node", "p"), "node").select("node", F.explode(F.slice("rare", 1, F.greatest("p", F.lit(1)))).alias("h"))
    routes = saved(wants.join(places, "h").select("node", "part").distinct(), f"{work}/routes")
    chunks = saved(routes.groupBy("part").agg(F.ceil(F.count("*") / CHUNK_ASKS).cast("int").alias("chunks"), F.count("*").alias("c")), f"{work}/chunks")
    names = ["part", "chunk", "kind", "node", "n", "comp", "set"]
    held = dealt.select("node", "part").join(chunks.drop("c"), "part").select("node", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"))
    asking = join_unique(routes, chunks, "part").select("node", "part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("kind"))
    return search_clusters(held.unionByName(asking).join(sets.select("node", "n", "comp", "set"), "node").select(*names), rule)


def _classes(docs: DataFrame, num: int, den: int, k: int, part: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, key, n_shingles, component_id, n_links, first (no row of the class goes before this one)."""
    spark, rule, work = docs.sparkSession, Threshold(num, den), work_dir(docs.sparkSession, "jaccard")
    docs = docs.select("doc_id", row_key().alias("key"), "text")
    signed = saved(signatures(docs, rule, k), f"{work}/signed")
    again = signed.filter("n > 0").groupBy("key").count().filter("count > 1")
    texts = docs if again.isEmpty() else docs.withColumn("repeated", F.lit(True))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    nodes = saved(
        signed.filter("n > 0").groupBy("node").agg(F.min("key").alias("rep"), F.first("n").alias("n"), F.first("low").alias("low"), F.min(order).alias("first"), F.count("*").alias("c")),
        f"{work}/nodes",
    )
    # 2. groups of sets that share a low hash, in parts of about so many hashes, each with the group's center
    low = nodes.select(F.struct("node", "rep", "n").alias("x"), F.explode("low").alias("h"))
    shared = low.groupBy("h").agg(F.min("x").alias("center"), F.max("x.node").alias("top"), F.count("*").alias("c")).filter("center.node <> top").select("h", "center", "c")
    pairs = join_unique(low, saved(shared, f"{work}/shared"), "h").filter("x.node <> center.node").select("center", "x").distinct()
    pairs = saved(pairs, f"{work}/pairs")
    sizes = pairs.groupBy("center").agg(F.ceil(F.greatest(F.sum("x.n") / part, F.count("*") / GROUP_SETS)).cast("int").alias("parts"), F.count("*").alias("c"))
    sizes = saved(sizes.select(F.col("center.node").alias("group"), "center", "parts", "c"), f"{work}/groups")
    heads = sizes.select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(1).alias("head"), "center.node", "center.rep")
    rest = join_unique(pairs.select(F.col("center.node").alias("group"), "x"), sizes.drop("center"), "group")
    rest = rest.select("group", F.pmod(F.xxhash64("x.node"), F.col("parts")).cast("int").alias("salt"), F.lit(0).alias("head"), "x.node", "x.rep")
    members = saved(heads.unionByName(rest), f"{work}/members")
    links = saved(search_groups(fetch_sets(texts, members, k), rule), f"{work}/links")

    # 3. links between the components of these
    root = components(links, f"{work}/first")
    comp = sized(root) if root is not None else spark.createDataFrame([], "node long, root long")
    held = signed.filter("n > 0").select("node", "n", "prefix").join(comp, "node", "left")
    held = held.select("node", "n", "prefix", F.coalesce("root", "node").alias("comp"), F.lit(True).alias("asks"))
    n = F.col("n")
    open_ = sieve(held, "prefix", across(held, "prefix", f"{work}/across")).filter(F.col("held") >= F.greatest(F.lit(1), F.ceil(n / 20)))
    open_ = saved(open_.select("node", "n", "comp").distinct().join(nodes.select("node", "rep"), "node"), f"{work}/open")
    more = []
    if open_.count():
        half = saved(fetch_sets(texts, open_, k, half=True).withColumn("asks", F.lit(True)), f"{work}/half")
        need = F.greatest(F.lit(1), F.ceil(n / 2) - n + F.expr(f"-floor(-{num} * n / {den})")).cast("long")
        left = sieve(half, "set", across(half, "set", f"{work}/across-half")).filter(F.col("held") >= need)
        few = saved(left.join(open_.select("node", "rep"), "node").select("node", "n", "comp", "rep"), f"{work}/left")
        if few.count():
            more.append(saved(last_search(texts, few, rule, k, work, part), f"{work}/more"))
    for x in more:
        links = links.unionByName(x)

    # 4. classes: of the sets that have links or copies, then of their rows
    root = components(links, f"{work}/all") if more else root
    if root is None:
        root = spark.createDataFrame([], "node long, root long")
    degree = links.filter("a <> b").distinct().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    many = nodes.select("node", "first", "c").join(root, "node", "left").filter("root IS NOT NULL OR c > 1").join(degree, "node", "left")
    many = saved(many.select("node", "c", "first", F.coalesce("root", "node").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")), f"{work}/many")
    firsts = saved(many.groupBy("class").agg(F.min("first").alias("least"), F.count("*").alias("c")), f"{work}/firsts")
    many = saved(join_unique(many.withColumnRenamed("c", "copies").drop("first"), firsts, "class").withColumnRenamed("copies", "c").drop("class"), f"{work}/classes")
    for name in ("shared", "pairs", "groups", "sizes", "members", "first", "across", "open", "half", "across-half", "left", "whole", *(f"{x}-{i}" for x in ("across", "cut") for i in range(3)), "holders", "rare", "owners", "clusters", "clustered", "dealt", "routes", "chunks", "many", "firsts", "links", "more", "all", "nodes"):
        remove(spark, f"{work}/{name}")
    rows = join_unique(signed.select("doc_id", "key", F.col("n").alias("n_shingles"), "node"), many, "node", how="left")
    return rows.select(
        "doc_id", "key", "n_shingles", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("least").isNull() | (F.col("least.key") == F.col("key"))).alias("first"),
    )


def jaccard_classes(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, part: int = 150_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, n_links (links verified on the set's way to its class).

    part: hashes in one part of a large group or cluster, about.
    """
    return _classes(docs, num, den, k, part).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """docs with one row of each class: the one with the least doc_id, then the least key of (doc_id, text).

    Rows without words are in no class and stay; rows that repeat in doc_id and text stay once.
    """
    work, names = work_dir(docs.sparkSession, "kept"), docs.columns
    classes = saved(_classes(docs, num, den, k, 150_000).select("key", "n_shingles", "first"), f"{work}/classes")
    gone = saved(classes.filter("NOT first").select(F.col("key").alias("__key")).distinct(), f"{work}/gone")
    kept = docs.withColumn("__key", row_key()).join(sized(gone), "__key", "left_anti")
    twice = saved(classes.filter("first AND n_shingles > 0").groupBy(F.col("key").alias("__key")).count().filter("count > 1").select("__key"), f"{work}/twice")
    if not twice.isEmpty():
        kept = kept.join(sized(twice), "__key", "left_anti").unionByName(kept.join(sized(twice), "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.select(*names)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
      UNION ALL SELECT doc_id, ws AS g FROM d WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM two UNION SELECT r.a, two.b FROM r JOIN two ON r.b = two.a),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
