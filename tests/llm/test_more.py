"""Colliding patterns, repeated and null ids, very long texts, and the registered queries against plain methods."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylight.llm import bpe, chat_format, common, decontaminate, jaccard_join, language_id, quality_qda, quality_rules, sharding, substring_dedup, token_file
from quarrylight.llm.queries import QUERIES

from .test_operators import jaccard_brute

D = "/root/testdata/sf0.001"


def thue(n, a, b):
    return "".join((a, b)[i.bit_count() & 1] for i in range(n))


PAIRS = [thue(n, *x) for n in (1024, 2048, 4096) for x in ("ab", "ba")]


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()


def prose(rnd, n):
    return " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))


# ---- hashes


def test_regular_patterns_do_not_collide():
    words = PAIRS + ["", "a", "a\0", "a\0\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "ihgfedcba"] + [f"{a}{b}" for a, b in itertools.product("ab" * 4, repeat=2)]
    words = sorted({w for w in words if w})
    b = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    end = np.cumsum([len(w) for w in words])
    assert len(np.unique(common.span_hashes(b, end - [len(w) for w in words], end))) == len(words)
    flat, n, h = common.span_blocks(b, end - [len(w) for w in words], end)
    assert len(np.unique(h)) == len(words) == len({flat[z - k : z].tobytes() for z, k in zip(np.cumsum(n), n, strict=True)})


def test_word_order_counts():
    h = common.mix(np.arange(2, dtype=np.uint64) + np.uint64(5))
    for n in (4, 8, 64, 1024):
        a = np.array([i.bit_count() & 1 for i in range(n)])
        assert common.sequence_hash(h[a]) != common.sequence_hash(h[1 - a])
    words = common.mix(np.arange(70, dtype=np.uint64))
    words = np.concatenate([words, words])
    for n in (1, 2, 3, 45, 64):
        got = common.run_hashes(words, n)
        assert len(got) == len(words) - n + 1 and len(np.unique(got)) == 70 and got[0] == got[70]


def test_equal_hashes_of_different_words_do_no_harm(path, monkeypatch):
    v, tok = bpe.Vocabulary(bpe.read_spec(path)), bpe.library(bpe.read_spec(path))
    texts = [*PAIRS, "hello world it's a x<|endoftext|> y", "the quick brown fox  jumps\n\n over", "é漢字 😀"] * 2
    whole = bpe.span_blocks
    for buckets in (2**63, 5):  # with 5 hashes nearly all words collide
        monkeypatch.setattr(bpe, "span_blocks", lambda *a, k=buckets: (lambda f, n, h: (f, n, h % np.uint64(k)))(*whole(*a)))
        for fill in (v.merge, bpe.library_fill(tok)):
            ids, n = bpe.WordEncoder(v.special, fill, bpe.cutter(tok)).encode(texts)
            at = np.concatenate([[0], np.cumsum(n)])
            assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_of_regular_words(spark, path):
    docs = spark.createDataFrame(list(enumerate(PAIRS)), "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.jaccard_classes(docs).collect()} == set(range(len(PAIRS)))
    bench = spark.createDataFrame([(7, PAIRS[0])], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.find_contamination(docs, bench, ["doc_id"]).collect()} == {i: int(i == 0) for i in range(len(PAIRS))}
    back = bpe.bpe_encode(docs, path, decoded="back")
    assert back.filter("text <> back").count() == 0
    file = token_file.read_token_file(spark, token_file.write_token_file(docs, common.work_dir(spark, "t"), path))
    assert file.join(back.select("doc_id", F.octet_length("ids").alias("n")), "doc_id").filter("4 * n_tokens = n + 4").count() == len(PAIRS)


# ---- ids that repeat or are null


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(9)
    a, b, c, passage = (prose(rnd, n) for n in (80, 90, 70, 60))
    rows = [(1, a), (2, a + " x"), (2, b), (2, b), (3, c), (3, passage + " " + prose(rnd, 20)), (4, prose(rnd, 20) + " " + passage), (None, b + " y"), (None, prose(rnd, 40)), (None, a + " z"), (5, None), (5, ""), (None, None)]
    return rows, spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, node string").repartition(3)


def test_classes_with_repeated_and_null_ids(mixed):
    rows, docs = mixed
    sizes, roots = jaccard_brute([t for _, t in rows])
    first = {}
    for (i, _), r in zip(rows, roots, strict=True):
        first[r] = min((x for x in (first.get(r), i) if x is not None), default=None)
    want = Counter((i, n, first[r] if n else i) for (i, _), n, r in zip(rows, sizes, roots, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(docs).collect()) == want


def test_one_of_each_class_stays(mixed):
    rows, docs = mixed
    sizes, roots = jaccard_brute([t for _, t in rows])
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()]
    classes = {r for n, r in zip(sizes, roots, strict=True) if n}
    assert len(kept) == len(classes) + sizes.count(0) and set(kept) <= set(rows)
    assert jaccard_join.one_of_each(docs).columns == docs.columns


def test_passages_with_repeated_and_null_ids(mixed):
    rows, docs = mixed
    got = substring_dedup.find_passages(docs)
    texts = [" ".join(t.split()) if t else "" for _, t in rows]
    runs = lambda t: {tuple(t.split()[i : i + 45]) for i in range(len(t.split()) - 44)}
    left = [r.text for r in substring_dedup.cut_passages(docs, got).collect()]
    seen = Counter(x for t in set(left) if t for x in runs(t))
    assert max(seen.values()) == 1 and {x for i in (0, 2, 4) for x in runs(texts[i])} | runs(" ".join(texts[5].split()[:60])) <= set(seen) <= {x for t in texts for x in runs(t)}
    assert {"key", "node"} <= set(docs.columns) and substring_dedup.cut_passages(docs, got).columns == docs.columns


def test_all_stages_with_repeated_ids(spark, mixed, tmp_path, monkeypatch):
    rows, _ = mixed
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1), (2, 1), (3, 0), (6, 1)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet(f"{D}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert stage(spark, docs.limit(0), folder).count() == 0
        docs = common.saved(stage(spark, docs, folder), f"{folder}/{k}")
    assert docs.count() <= len(rows)


# ---- sharding


def test_hypergeometric_law():
    rng = np.random.default_rng(2)
    for good, bad, sample in ((3, 4, 2), (5, 5, 5), (40, 7, 30), (0, 3, 2), (3, 0, 2), (6, 6, 0)):
        got = Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(4000))
        every = Counter(sum(i < good for i in c) for c in itertools.combinations(range(good + bad), sample)) if good + bad < 12 else None
        if every:
            total = sum(every.values())
            assert all(abs(got[k] / 4000 - n / total) < 0.04 for k, n in every.items()) and set(got) <= set(every)
        else:
            assert abs(sum(k * n for k, n in got.items()) / 4000 - sample * good / (good + bad)) < 0.2
    big = [sharding.hypergeometric(rng, 4 * 10**11, 6 * 10**11, 10**10) for _ in range(300)]
    deviation = (10**10 * 0.4 * 0.6 * 0.99) ** 0.5
    assert abs(np.mean(big) - 4 * 10**9) < 4 * deviation / 300**0.5 and 0.85 < np.std(big) / deviation < 1.15


def test_matrix_is_that_of_a_uniform_shuffle():
    """Against all 720 orders of 6 rows in partitions of 1, 3 and 2, cut into three shards."""
    where = [0, 1, 1, 1, 2, 2]
    every = Counter()
    for p in itertools.permutations(range(6)):
        m = np.zeros((3, 3), dtype=int)
        for place, row in enumerate(p):
            m[where[row], place // 2] += 1
        every[m.tobytes()] += 1
    n = 4000
    got = Counter(sharding.communication_matrix([1, 3, 2], 3, s).astype(int).tobytes() for s in range(n))
    assert set(got) <= set(every) and all(abs(got[k] / n - c / 720) < 0.03 for k, c in every.items())


def test_matrix_beyond_what_numpy_draws():
    counts = [10**10 + i for i in range(37)] + [0, 5]
    m = sharding.communication_matrix(counts, 24, 3)
    assert m.sum(axis=1).tolist() == counts and (m >= 0).all() and set(m.sum(axis=0).tolist()) <= {sum(counts) // 24, sum(counts) // 24 + 1}
    assert abs(m[0] / 10**10 - 1 / 24).max() < 1e-4


# ---- language, quality, chat


def test_texts_without_a_letter(spark):
    texts = ["½ ²", "Ⅷ ①", "123 !", "", None, "½ a", "ª"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = language_id.Model({"en": 1, "de": 1}, [(language_id.features(["the cat", "der hund"]), ["en", "de"])])
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model, ["doc_id"]).collect()}
    assert [got[i] == "und" for i in range(7)] == [True] * 5 + [False] * 2


def test_weights_equal_the_dual_solution():
    rnd = np.random.default_rng(4)
    texts = ["".join(rnd.choice(list("abcdefgh "), 60)) for _ in range(90)]
    langs = [f"l{i % 3}" for i in range(90)]
    x = language_id.features(texts)
    model = language_id.Model(Counter(langs), [(x[:50], langs[:50]), (x[50:], langs[50:])])
    y = model.code[[int(v[1]) for v in langs]]
    c = (x - x.mean(axis=0)).astype(np.float64)
    dual = c.T @ np.linalg.solve(c @ c.T + 0.02 * np.eye(90), y - y.mean(axis=0))
    assert np.abs(model.weights - dual).max() < 1e-2 * np.abs(dual).max()
    loss = np.logaddexp(0, -model.sharpness * ((x - model.mean) @ model.weights + model.bias)[:, None, :] * model.code[None]).sum(axis=2)
    best, score, _ = model.predict(texts)
    assert best.tolist() == loss.argmin(axis=1).tolist()
    assert np.allclose(score, 1 / np.exp(loss.min(axis=1, keepdims=True) - loss).sum(axis=1))


def test_discriminant_equals_plain_densities():
    rnd = np.random.default_rng(8)
    x = np.concatenate([rnd.normal(0, 1, (300, 5)), rnd.normal(1, 2, (200, 5))])
    y = np.repeat([0, 1], [300, 200])
    model = quality_qda.Discriminant(x, y, shrink=0.15, ridge=0.1)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6)
    covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    pooled = (300 * covs[0] + 200 * covs[1]) / 500
    density = []
    for c, n in ((0, 300), (1, 200)):
        s = 0.85 * covs[c] + 0.15 * pooled
        s = 0.9 * s + 0.1 * np.trace(s) / 5 * np.eye(5)
        d = z - z[y == c].mean(axis=0)
        density.append(np.log(n / 500) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d))
    assert np.allclose(np.sinh(model.difference(x)), density[1] - density[0])
    assert (np.diff(model.score(x)[np.argsort(density[1] - density[0])]) >= -1e-12).all()


def test_the_machine_is_in_the_plan(spark):
    plan = QUERIES["op7_chat_format"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "system\nuser" in plan and "array_position" in plan and "Python" not in plan
    plan = QUERIES["op10_quality_rules"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "CASE WHEN" in plan and "Python" not in plan and "Arrow" not in plan


def test_chat_against_a_plain_machine(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["system", "user", "assistant", "tool", "", None]) if rnd.random() < 0.3 else ["user", "assistant"][t % 2], rnd.choice(["a", "<|x|>", "", None, "<\\|"])) for c in range(60) for t in range(rnd.choice([1, 2, 4, 7]))]
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    legal = {"^": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    for c in range(60):
        turns = [(r or "", t or "") for i, _, r, t in rows if i == c]
        states = ["^"] + [r for r, _ in turns]
        bad = next((i for i, (r, _) in enumerate(turns) if r not in legal.get(states[i], ())), -1)
        assert (got[c].valid, got[c].bad_turn) == (bad < 0, bad) and [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")


# ---- token file


def test_ranges_of_a_hot_id(spark, path):
    rnd = random.Random(3)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i - 500, prose(rnd, 60)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    file = token_file.write_token_file(docs, common.work_dir(spark, "t"), path, range_bytes=10_000)
    sizes = [r["sum(n)"] for r in spark.read.parquet(f"{file}/blocks").groupBy("range").sum("n").collect()]
    assert len(sizes) > 8 and max(sizes) < 4 * sum(sizes) / len(sizes)
    got = token_file.read_token_file(spark, file).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert len(got) == 900 and ids == sorted(ids, key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()


# ---- the registered queries


def test_op1_equals_the_library(spark, documents, path):
    tok = bpe.library(bpe.read_spec(path))
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, D).collect()}
    assert len(got) == len(documents)
    for d in documents:
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_against_the_texts(spark, documents):
    got = QUERIES["op2_sharding"](spark, D).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d.doc_id, len((d.text or "").encode()) + 8, zlib.crc32((d.text or "").encode())) for d in documents)
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_op4_leaves_no_exact_run(spark, documents):
    """Every run of 45 words that a lesser node holds is covered, but for a few words at its ends; exact passages are equal in both texts."""
    got = QUERIES["op4_substring_dedup"](spark, D).collect()
    words = {d.doc_id: "".join(c.lower() if c.isascii() else c for c in d.text or "").split() for d in documents}
    words = {k: w for k, w in words.items() if w == __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in next(d.text for d in documents if d.doc_id == k) or ""))}
    nodes = {d.doc_id: substring_dedup.node_of(common.words_of(d.text)[0]) for d in documents}
    n, least = substring_dedup.MIN_WORDS, {}
    for k, w in words.items():
        for i in range(len(w) - n + 1):
            key = hash(tuple(w[i : i + n]))
            least[key] = min((nodes[k], k), least.get(key, (nodes[k], k)))
    covered = {}
    for r in got:
        covered.setdefault(r.doc_id, set()).update(range(r.first, r.last))
        if r.identity == 1 and r.doc_id in words and r.other_id in words:
            assert words[r.doc_id][r.first : r.last] == words[r.other_id][r.other_first : r.other_last]
    repeats = whole = 0
    for k, w in words.items():
        for i in range(len(w) - n + 1):
            if least[hash(tuple(w[i : i + n]))][1] != k and least[hash(tuple(w[i : i + n]))][0] <= nodes[k]:
                repeats += 1
                assert covered[k] >= set(range(i + substring_dedup.W - 1, i + n - substring_dedup.W + 1))
                whole += covered[k] >= set(range(i, i + n))
    assert repeats > 100 and whole > 0.99 * repeats


def test_op5_equals_the_library(spark, documents, path):
    tok = bpe.library(bpe.read_spec(path))
    got = {r.doc_id: r for r in QUERIES["op5_token_file"](spark, D).collect()}
    start = 0
    for d in sorted(documents, key=lambda d: d.doc_id):
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(documents)


# ---- one text of some MB for each operator, which crosses all block borders


@pytest.fixture(scope="module")
def long(spark):
    rnd = random.Random(12)
    passage = prose(rnd, 200)
    text = " ".join(["Ab é漢,"] + [f"w{rnd.randrange(10 ** 5)}" for _ in range(330_000)]) + "\n" + passage + "\n" + "x" * 600_000 + " it's the end"
    return text, passage, spark.createDataFrame([(0, text), (1, passage + " more"), (2, "short")], "doc_id long, text string").coalesce(1)


def test_long_text_bpe_and_file(spark, long, path):
    text, _, docs = long
    assert len(text) > 2_500_000
    ids = bpe.library(bpe.read_spec(path)).encode(text, add_special_tokens=False).ids
    got = bpe.bpe_encode(docs, path, decoded="back").filter("doc_id = 0").first()
    assert np.frombuffer(got.ids, "<u4").tolist() == ids and got.back == text
    file = token_file.write_token_file(docs, common.work_dir(spark, "t"), path)
    assert zlib.crc32(token_file.read_token_file(spark, file).filter("doc_id = 0").first().ids) == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


def test_long_text_pairs(spark, long):
    text, passage, docs = long
    got = substring_dedup.find_passages(docs).collect()
    w = text.lower().split()
    assert len(got) == 1
    r = got[0]
    at = {r.doc_id: (r.first, r.last), r.other_id: (r.other_first, r.other_last)}
    assert at[1] == (0, 200) and w[at[0][0] : at[0][1]] == passage.split()
    more = docs.unionByName(spark.createDataFrame([(3, text + " tail")], "doc_id long, text string"))
    classes = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.jaccard_classes(more).collect()}
    assert classes[3][0] == 0 and classes[0] == (0, len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    hits = {r.doc_id: r.n_hit for r in decontaminate.find_contamination(docs, bench, ["doc_id"]).collect()}
    assert hits == {0: 200, 1: 200, 2: 0}


def test_long_text_statistics(spark, long):
    text, _, docs = long
    words = text.split()
    r = quality_rules.cascade(docs, statistics=tuple(quality_rules.STATISTICS)).filter("doc_id = 0").first()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    assert (r.n_words, r.word_chars, r.n_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), 3, 0) and max(windows.values()) == 1
    x = quality_qda.statistics(text)
    assert np.isfinite(x).all() and x[0] == pytest.approx(np.log1p(len(words)))
    half = language_id.features([text])[0] ** 2
    assert half.sum() == pytest.approx(1, abs=1e-3)
    s = sharding.hypergeometric_shards(docs, 2).filter("doc_id = 0").first()
    assert (s.size, s.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
    conv = docs.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("user").alias("role"), "text")
    back = chat_format.read_back(chat_format.format_conversations(conv)).first()
    assert back.turns[0].text == text and back.bad_turn == 1
