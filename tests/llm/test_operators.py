"""Edge cases that every operator of the list must stand: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.llm import bpe, chat_format, decontaminate, jaccard_join, language_id, quality_qda, quality_rules, sharding, substring_dedup, token_file
from quarrylight.llm.common import ALNUM, components, work_dir, words_of
from quarrylight.llm.queries import ORACLE, QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "x", "   \n\t ", "é" * 3, "a b c d", "word " * 3000, "<|endoftext|>", "<|im_end|> \\ <\\| <|", "😀 漢字 it's\x1c\x85​", "a" * 5000, "x\r\ny\rz\x0b", "\x00\x7f"]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "null id", "en", "s", 1), (3, ODD[3], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, same_as_duckdb):
    same_as_duckdb(QUERIES[name], ORACLE[name])


def test_bpe_equals_the_library(spark, odd, path):
    tok = bpe.library(bpe.read_spec(path))
    got = bpe.bpe_encode(odd, path).withColumn("back", bpe.bpe_decode(path, spark)("ids")).withColumn("list", bpe.unpack_ids(F.col("ids")))
    for r in got.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.list == ids and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.back == tok.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_encode(odd.limit(0), path).count() == 0


def test_bpe_on_random_texts(path):
    import random

    v, tok = bpe.Vocabulary(bpe.read_spec(path)), bpe.library(bpe.read_spec(path))
    pools = ["abc  \n", "aaaa", "éèüß 'sdl", "0123 a", "😀漢字かな 　\xa0\x85\x1c", "ʼ՘ࢮౝೝ𑄀𖫐 ", "!?#$'", "ⅧⅨ²½"]
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(rnd.choice(pools)) if rnd.random() < 0.9 else rnd.choice(["<|endoftext|>", "'s", "'ll", "   ", "\n\n"]) for _ in range(rnd.choice([3, 10, 50, 400]))) for _ in range(800)]
    for fill in (v.merge, bpe.library_fill(tok)):
        ids, n = bpe.WordEncoder(v.special, fill, bpe.cutter(tok)).encode(texts)
        at = np.concatenate([[0], np.cumsum(n)])
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_unknown_ids_are_left_out(spark, path):
    df = spark.createDataFrame([(bytearray(np.array([40, 999_999], "<u4").tobytes()),), (None,), (bytearray(),)], "ids binary")
    assert [r.x for r in df.select(bpe.bpe_decode(path, spark)("ids").alias("x")).collect()] == ["I", "", ""]


@pytest.mark.parametrize("n", [1, 2, 3, 40, 300])
def test_huffman_code_is_optimal_and_limited(n):
    import heapq

    counts = np.random.default_rng(n).zipf(1.3, n).clip(1, 10**9)
    free = token_file.code_lengths(counts, 60 if n < 40 else 40)
    heap = list(map(int, counts))
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        best += a
        heapq.heappush(heap, a)
    assert (free * counts).sum() == (best if n > 1 else counts[0])
    tight = token_file.code_lengths(counts, max(1, int(np.ceil(np.log2(n)))))
    assert tight.max() <= max(1, int(np.ceil(np.log2(n)))) and sum(2.0 ** -int(x) for x in tight) <= 1


def test_token_file_round_trip(spark, odd, path):
    tok = bpe.library(bpe.read_spec(path))
    got = token_file.read_token_file(spark, token_file.write_token_file(odd, work_dir(spark, "t"), path)).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(got) == odd.count()
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    want = sorted(zlib.crc32(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for r in odd.collect())
    assert sorted(zlib.crc32(r.ids) for r in got) == want
    empty = token_file.write_token_file(odd.limit(0), work_dir(spark, "t"), path)
    assert token_file.read_token_file(spark, empty).count() == 0


def test_sharding_is_exact(spark, odd):
    big = odd.unionByName(spark.range(500).select("id", F.lit("same").alias("text")).withColumnRenamed("id", "doc_id"), allowMissingColumns=True)
    got = sharding.hypergeometric_shards(big, 7, range_rows=20).collect()
    n = big.count()
    sizes = {s: sorted(r.slot for r in got if r.shard == s) for s in range(7)}
    assert len(got) == n and all(v == list(range(len(v))) for v in sizes.values())
    assert {len(v) for v in sizes.values()} <= {n // 7, n // 7 + 1}
    by = {r.doc_id: r for r in got}
    assert by[0].size == 8 and by[0].text_crc32 == 0 and by[4].size == 14 and by[4].text_crc32 == zlib.crc32(("é" * 3).encode())
    assert sharding.hypergeometric_shards(odd.limit(0), 24).count() == 0


def test_matrix_margins():
    m = sharding.communication_matrix([5, 0, 17, 3], 4, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and sorted(m.sum(axis=0).tolist()) == [6, 6, 6, 7]
    every = np.mean([sharding.communication_matrix([10, 30], 4, s)[0] for s in range(400)], axis=0)
    assert np.abs(every - 2.5).max() < 0.35


def test_chat_machine(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "<|im_end|>"), (2, 0, "assistant", "a"), (3, 0, "user", None), (3, 1, None, "x"), (4, 1, "user", "b"), (4, 1, "user", "a"), (None, 0, "tool\n", "<\\| <| \\<|")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(conv)).collect()}
    assert {k: (r.valid, r.bad_turn) for k, r in out.items()} == {1: (True, -1), 2: (False, 0), 3: (False, 1), 4: (False, 1), None: (False, 0)}
    assert out[1].loss_text == "<|im_end|>" and out[1].formatted.count("<|im_end|>") == 3
    assert [(t.role, t.text) for t in out[None].turns] == [("tool\n", "<\\| <| \\<|")] and [t.text for t in out[4].turns] == ["a", "b"]
    assert chat_format.format_conversations(conv.limit(0)).count() == 0


def test_language(spark, odd):
    texts = {"en": "the cat and the dog with them", "de": "der hund und die katze mit ihnen", "fr": "le chien et la chatte avec eux"}
    rows = [(i, f"{t} {i}", k, None, None) for i in range(60) for k, t in texts.items()]
    docs = spark.createDataFrame(rows, DOC)
    model = language_id.learn(docs, F.col("doc_id") % 2 == 0, max_rows=20)
    got = language_id.identify(docs.withColumn("score_", F.lit(1)), model, ["doc_id", "lang"]).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(odd.filter("text IS NULL OR text IN ('', '<')"), model, ["doc_id"]).collect()} == {"und"}
    none = language_id.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, none, ["doc_id"]).collect()} == {"und"}
    one = language_id.learn(docs.filter("lang = 'de'"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, one, ["doc_id"]).collect()} == {"de"}


@pytest.mark.parametrize("k", [2, 3, 4, 5, 9])
def test_codewords_are_apart(k):
    c = language_id.codewords(k)
    assert min((a != b).sum() for i, a in enumerate(c) for b in c[:i]) >= (1 if k < 3 else 2)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op3_language"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count()
    got = QUERIES["op9_quality"](spark, d).filter("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert got.filter("predicted = quality").count() >= 0.97 * got.count() > 0


@pytest.mark.parametrize("rule", quality_rules.RULES, ids=lambda r: r.name)
def test_each_rule_decides_alone(spark, rule):
    plain = " ".join(f"word{i} lower" for i in range(30))
    bad = {
        "symbols": plain + " # $ % & | < > #" * 2, "long_words": " ".join(f"{i}abcdefghijklmno" for i in range(30)), "short_words": " ".join(chr(97 + i % 26) for i in range(26)),
        "repeated_lines": plain + "\nsame\nsame\nsame\nsame", "shouting": plain.upper(), "digits": " ".join(f"{10 ** 6 + i}" for i in range(30)),
        "bullets": "\n".join(f"- point number {i}" for i in range(30)), "ellipses": "\n".join(f"and so on {i}..." for i in range(20)),
    }[rule.name]
    docs = spark.createDataFrame([(1, plain), (2, bad)], "doc_id long, text string")
    for have in ((), ("n_words", "word_chars")):
        assert {r.doc_id: r.rejected_by for r in quality_rules.cascade(docs, statistics=have, ordered=[rule]).collect()} == {1: None, 2: rule.name}


def test_quality_without_labels(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 7)], "doc_id long, quality int")
    model = quality_qda.learn(odd, labels)
    got = quality_qda.classify(odd.withColumn("label", F.lit(0)), model, ["doc_id"]).collect()
    assert len(got) == odd.count() and {r.score for r in got} == {1.0}
    assert quality_qda.classify(odd.limit(0), model, ["doc_id"]).count() == 0
    assert all(np.isfinite(quality_qda.statistics(t)).all() for t in ODD)


def test_quality_rules_do_not_depend_on_their_order(spark, odd):
    docs = odd.withColumns({"n_words": F.lit("clash"), "n_lines": F.lit("stays"), "kept": F.lit("clash")})
    got = {(r.doc_id, r.text): r for r in quality_rules.cascade(docs, statistics=("n_words", "n_repeat_words")).collect()}
    assert {r.n_lines for r in got.values()} == {"stays"}
    bare = {(r.doc_id, r.text): r.rejected_by for r in quality_rules.cascade(odd, ordered=list(reversed(quality_rules.RULES))).collect()}
    assert {k: v is None for k, v in bare.items()} == {k: r.kept for k, r in got.items()}
    assert all(not r.kept and r.base_failed for k, r in got.items() if not k[1] or len(k[1].split()) < 20)
    assert got[(6, ODD[6])].n_repeat_words == 3000 and got[(6, ODD[6])].rejected_by == "repeated_windows"
    ordered = quality_rules.order_rules(odd.select("text"))
    assert {r.name for r, _, _ in ordered} == {r.name for r in quality_rules.RULES}
    assert [s / c for _, s, c in ordered] == sorted((s / c for _, s, c in ordered), reverse=True)
    assert quality_rules.cascade(odd.limit(0)).count() == 0


def brute_hits(text, items):
    words = lambda t: [bytes(w) for w in __import__("re").findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower() if t and t.isascii() else b"".join(c.lower().encode() if c.isascii() else c.encode() for c in t or ""))]
    d, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1) if n else ():
            for p in range(len(d) - n + 1):
                if d[p : p + n] == w[j : j + n]:
                    hit |= set(range(p, p + n))
                    found.add(i)
    return len(d), sorted(hit), sorted(x for x in found if x is not None)


def test_decontamination_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    word = lambda: rnd.choice("ab c d é Ab".split())
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 14])))) for i in range(12)] + [(None, "zz yy"), (5, None), (12, "q " * 12)]
    texts = [" ".join(word() for _ in range(rnd.choice([0, 5, 12, 60]))) for _ in range(60)] + ["q " * 30, None, "", "ZZ-yy.", "q " * 9 + "r " + "q " * 11]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (16 << 20, 40):  # one block of windows, and many
        got = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, ["doc_id"], clean=True, block_bytes=block).collect()}
        for i, t in enumerate(texts):
            n, hit, found = brute_hits(t, items)
            r = got[i]
            spans = [p for s in r.spans for p in range(s.first, s.last + 1)]
            assert (r.n_words, r.n_hit, r.items, spans) == (n, len(hit), found, hit)
            assert len(words_of(r.cleaned, ALNUM)[0]) == n - len(hit)
    assert decontaminate.find_contamination(docs, bench.limit(0), ["doc_id"]).filter("n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench, ["doc_id"]).count() == 0


def test_suffix_array():
    for seq in ([1], [1, 1, 1, 1], [2, 1, 3, 1, 2, 1, 3, 1], list(np.random.default_rng(1).integers(1, 4, 300))):
        s = np.append(np.array(seq), 0)
        assert decontaminate.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def jaccard_brute(texts, num=80, den=100):
    sets = [set(jaccard_join.document_set(t).tolist()) for t in texts]
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [len(s) for s in sets], [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes_equal_brute_force(spark, seed):
    """Families of texts at all distances from their base, so that many pairs lie near the threshold."""
    import random

    rnd = random.Random(seed)
    texts = []
    for f in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([6, 30, 120]))]
        for _ in range(rnd.choice([2, 12, 40])):
            t, edits = list(base), rnd.choice([0, 0.01, 0.02, 0.03, 0.05, 0.1])
            t = [f"e{rnd.randrange(10 ** 6)}" if rnd.random() < edits else w for w in t]
            texts.append(" ".join(t[: rnd.choice([len(t), len(t), len(t) - len(t) // 12])]))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [" ".join(f"u{rnd.randrange(10 ** 6)}" for _ in range(rnd.choice([5, 15, 40]))) + " " + passage for _ in range(40)] + ["", None, "a b", "A  b", "a b c d e"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, node int").repartition(4)
    n, roots = jaccard_brute(texts)
    got = {r.doc_id: r for r in jaccard_join.jaccard_classes(docs, part=300).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n and [got[i].component_id for i in range(len(texts))] == roots


def test_jaccard_odd_rows(spark, odd):
    got = jaccard_join.jaccard_classes(odd).collect()
    assert len(got) == odd.count()
    assert all(r.component_id == r.doc_id for r in got)
    assert jaccard_join.jaccard_classes(odd.limit(0)).count() == 0


def test_leaders_search_equals_counting():
    rnd = np.random.default_rng(5)
    rule = jaccard_join.Threshold()
    sets = [np.unique(rnd.integers(0, 60, rnd.integers(1, 50))) for _ in range(150)]
    lead = jaccard_join.Leaders(rule)
    for i, s in enumerate(sets):
        want = [j for j in range(i) if rule.links(len(np.intersect1d(s, sets[j])), len(s), len(sets[j]))]
        assert sorted(lead.search(s.tolist())) == want
        lead.add(i, s.tolist())
    index = jaccard_join.Inverted(sets, np.array([len(s) for s in sets]))
    for s in sets:
        for t in (1, len(s) // 2 + 1, len(s)):
            docs, count = index.search(s, len(s), t)
            both = [len(np.intersect1d(s, x)) for x in sets]
            assert dict(zip(docs.tolist(), count.tolist(), strict=True)) == {i: c for i, c in enumerate(both) if c >= t}


def test_components(spark):
    ids = [int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(60)]
    edges = [(ids[i], ids[i + 1]) for i in range(39)] + [(ids[50], ids[51]), (ids[51], ids[51])]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark, "cc")).collect()}
    assert {got[i] for i in ids[:40]} == {min(ids[:40])} and got[ids[50]] == got[ids[51]] == min(ids[50:52]) and len(got) == 42
    assert components(spark.createDataFrame([], "a long, b long"), work_dir(spark, "cc")) is None


def test_passages(spark):
    import random

    rnd = random.Random(7)
    prose = lambda n: " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))
    passage = prose(70).split()
    fuzzy = [f"x{i}" if i in (20, 21, 45) else w for i, w in enumerate(passage)]
    fuzzy.insert(33, "more")
    copy, short = prose(80), prose(20)
    texts = [prose(30) + " " + " ".join(passage) + "\n" + prose(50), prose(9) + "  " + " ".join(fuzzy).upper() + " " + prose(40), copy, copy, short + " " + prose(60), prose(60) + " " + short, prose(300), "", None, "a b", passage[0]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, first int").repartition(3)
    got = substring_dedup.find_passages(docs).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} == {frozenset((0, 1)), frozenset((2, 3))}
    r = next(r for r in got if {r.doc_id, r.other_id} == {0, 1})
    at = {r.doc_id: (r.first, r.last), r.other_id: (r.other_first, r.other_last)}
    assert at == {0: (30, 100), 1: (9, 80)} and 0.9 < r.identity < 1
    left = {x.doc_id: x.text for x in substring_dedup.cut_passages(docs.drop("first"), substring_dedup.find_passages(docs)).collect()}
    assert 3 not in left and left[2] == copy and left[6] == texts[6] and left[8] is None and left[7] == ""
    cut = left[r.doc_id]
    assert len(cut.split()) == len(texts[r.doc_id].split()) - (r.last - r.first)
    assert substring_dedup.find_passages(docs.limit(0)).count() == 0


def test_chains_are_the_best(spark):
    """The chain's score against all chains, on small sets of matches."""
    import itertools

    rnd = np.random.default_rng(2)

    def score(x, y, c):
        return substring_dedup.K * len(c) - substring_dedup.GAP_COST * sum(x[b] - x[a] + y[b] - y[a] for a, b in itertools.pairwise(c))

    for _ in range(60):
        p = np.unique(rnd.integers(0, 60, (8, 2)), axis=0)
        x, y = p[:, 0], p[:, 1]
        every = (c for k in range(1, len(x) + 1) for c in itertools.combinations(range(len(x)), k) if all(x[a] < x[b] and y[a] < y[b] for a, b in itertools.pairwise(c)))
        best = max(score(x, y, c) for c in every)
        chains = substring_dedup.chain(x, y)
        assert sorted(i for c in chains for i in c) == list(range(len(x)))
        assert max(score(x, y, list(c)) for c in chains) == pytest.approx(best)


def test_passages_odd_rows(spark, odd):
    found = substring_dedup.find_passages(odd)
    assert found.count() == 0
    assert substring_dedup.cut_passages(odd, found).count() == odd.count()


def test_runs_whose_lines_other_documents_hold(spark):
    """Every run of min_words words that a lesser node holds is covered, though its lines have owners of their own."""
    import random

    rnd = random.Random(11)
    prose = lambda n: [f"w{rnd.randrange(10 ** 6)}" for _ in range(n)]
    texts = []
    for k in range(12):
        lines = [prose(20) for _ in range(3)]
        run = sum(lines, [])
        pair = [prose(15) + run + prose(30), prose(40) + lines[1] + prose(8) + lines[0] + prose(7) + run + prose(5)]
        low = min(substring_dedup.node_of(substring_dedup.words_of(" ".join(t))[0]) for t in pair)
        for line in lines:
            while substring_dedup.node_of(substring_dedup.words_of(" ".join(t := prose(30) + line + prose(30)))[0]) >= low:
                pass
            texts.append(t)
        texts += pair
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = substring_dedup.find_passages(docs).collect()
    nodes = [substring_dedup.node_of(substring_dedup.words_of(" ".join(t))[0]) for t in texts]
    n, least = substring_dedup.MIN_WORDS, {}
    for t, node in zip(texts, nodes, strict=True):
        for i in range(len(t) - n + 1):
            key = tuple(t[i : i + n])
            least[key] = min(node, least.get(key, node))
    repeats = 0
    for d, (t, node) in enumerate(zip(texts, nodes, strict=True)):
        covered = {i for r in got if r.doc_id == d for i in range(r.first, r.last)}
        for i in range(len(t) - n + 1):
            if least[tuple(t[i : i + n])] < node:
                repeats += 1
                assert covered >= set(range(i, i + n))
    assert repeats == 12 * 16
    for r in got:
        assert nodes[r.other_id] < nodes[r.doc_id]
        if r.identity == 1:
            assert texts[r.doc_id][r.first : r.last] == texts[r.other_id][r.other_first : r.other_last]


def test_least_cover():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        runs = sorted((int(a), int(a + n)) for a, n in rnd.integers(1, 30, (12, 2)))
        over = sorted((int(a), int(a + n)) for a, n in rnd.integers(1, 20, (3, 2)))
        keep = substring_dedup.least_cover([a for a, _ in runs], [z for _, z in runs], over)
        words = lambda s: set().union(*[range(a, z) for a, z in s])
        assert words(over) | words([runs[i] for i in keep]) == words(over) | words(runs)
        assert len(set(keep)) == len(keep)


def test_repeated_words_are_told_once(spark):
    docs = spark.createDataFrame([(0, "a " * 900 + "b"), (1, "c " + "a " * 700 + "d")], "doc_id long, text string")
    assert 1 <= substring_dedup.find_passages(docs).count() <= 30


def test_all_languages_are_learned(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} {'abcdefghij'[i % 10] * (1 + i // 26)}", f"l{i:03}", None, None) for i in range(530)], DOC)
    assert len(language_id.learn(docs, F.lit(True)).langs) == 530
