import re

import pytest

import corpus_pipeline as p
from quarrylight.llm.jaccard_join import document_set

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage keeps."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs.collect()]
    from quarrylight.llm.common import saved, work_dir

    work = work_dir(spark, "test")
    for k, (_, stage) in enumerate(p.STAGES):
        docs = saved(stage(spark, docs, D), f"{work}/{k}")
        out.append(docs.collect())
    return out


def test_columns_stay_until_the_last_stage(spark, kept):
    names = spark.read.parquet(f"{D}/documents.parquet").columns
    assert all(list(r.asDict()) == names for rows in kept[:-1] for r in rows[:1])
    assert {"doc_id", "ids", "n_tokens"} <= set(kept[-1][0].asDict())


def test_no_near_duplicates_are_left(kept):
    sets = [set(document_set(r.text).tolist()) for r in kept[2]]
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[:i] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    assert pairs == [] and len(kept[2]) < len(kept[1])


def test_no_long_passage_is_left_twice(kept):
    seen, twice = {}, 0
    for r in kept[3]:
        w = r.text.lower().split()
        for i in range(len(w) - 59):
            key = tuple(w[i : i + 60])
            twice += seen.setdefault(key, r.doc_id) != r.doc_id
    assert twice == 0
    assert all(r.n_chars == len(r.text) for r in kept[3])


def test_no_benchmark_window_is_left(spark, kept):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(len(w) - 9)}
    hits = lambda rows: sum(tuple(w[i : i + 10]) in windows for r in rows for w in [words(r.text)] for i in range(len(w) - 9))
    assert hits(kept[3]) > 0
    # a cut may join words into a new window; none that stood in the text before is left
    tens = lambda t: {tuple(w[i : i + 10]) for w in [words(t)] for i in range(len(w) - 9)}
    before = {r.doc_id: tens(r.text) for r in kept[3]}
    assert [r.doc_id for r in kept[4] if tens(r.text) & windows & before[r.doc_id]] == []


def test_clean_documents_stay(spark, kept):
    """Documents that are labelled good and are no copies come out at the end."""
    good = {r.doc_id for r in spark.read.parquet(f"{D}/labels.parquet").filter("quality = 1").collect()}
    scored = {r.doc_id for r in kept[1]}
    assert len(good - scored) <= 0.02 * len(good)
    assert {r.doc_id for r in kept[-1]} == {r.doc_id for r in kept[4]}


def test_run(spark, kept):
    got = {r.doc_id: bytes(r.ids) for r in p.run(spark, D).collect()}
    assert got == {r.doc_id: bytes(r.ids) for r in kept[-1]}


def test_odd_rows_pass_all_stages(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, None, "s", None), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES[1:]:
        out = stage(spark, docs, D)
        assert out.count() == (4 if name == "n-gram Jaccard join" else 5)
        assert stage(spark, docs.limit(0), D).count() == 0


def test_documents_that_share_an_id_stay(spark):
    import random

    rnd = random.Random(4)
    prose = lambda n: " ".join(f"w{rnd.randrange(10 ** 6)}" for _ in range(n))
    a, b, c, run = prose(80), prose(90), prose(70), prose(60)
    rows = [(1, a), (2, a + " x"), (2, b), (2, b), (3, c), (3, run + " " + prose(20)), (4, prose(20) + " " + run), (None, prose(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in p.one_of_each_class(spark, docs, D).collect())
    assert got == sorted((d or 0, t) for d, t in set(rows) - {rows[1]})
    cut = p.cut_repeats(spark, docs.filter("doc_id >= 3"), D).collect()
    assert sorted(r.doc_id for r in cut) == [3, 3, 4] and c in [r.text for r in cut]
    assert sum(run in r.text for r in cut) == 1


def test_encoding_is_decoded(kept):
    import hashlib

    texts = {r.doc_id: r.text for r in kept[4]}
    assert p.STAGES[-1][0] == "BPE encoding and decoding"
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in kept[5])
