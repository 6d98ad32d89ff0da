r"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword; one linear classifier per code bit is learned
from hashed byte 2- and 3-grams of lower-cased letters. A text's bits have real
margins; decoding sums a logistic loss over the bits of every codeword and
takes the least (loss-weighted decoding). The score is the chosen codeword's
share of exp(-loss). ambiguous flags texts whose second codeword is as near
within a margin or whose bits are further from the codeword than the code
corrects.

Learning takes max_rows texts of each language at most (parameter): those with
the least hashes of doc_id. Executors make their features; the driver adds up
products of features (DIM x DIM numbers, whatever the number of texts and
languages) and solves for the weights. Whole texts are read for prediction.

Defined cases: text null or without a letter (\p{L}): und, score 0; lang or
doc_id null: not learned from; no language to learn: und; one language: always
that one; two codewords with equal loss: the language that sorts first, flagged
ambiguous; very long texts are counted in pieces; repeated rows stay; an empty
table gives no rows; other columns are ignored, and kept ones with the name of a
result give way to it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, saved, with_text, work_dir

DIM = 4096
LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 32, dtype=np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k rows of +1/-1: the exhaustive code for few classes, else the best of random codes by least distance."""
    if k <= 1:
        return np.ones((k, 0), dtype=np.float32)
    if k <= 6:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, dtype=np.float32).T
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.choice((-1.0, 1.0), size=(k, 10 * int(np.ceil(np.log2(k))))).astype(np.float32)
        gap = ((code.shape[1] - code @ code.T) / 2 + 2 * code.shape[1] * np.eye(k)).min()
        if gap > far:
            best, far = code, gap
    return best


def features(texts: list[str]) -> np.ndarray:
    """Hashed 2- and 3-gram shares, square-rooted, one row of length DIM for each text."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for i, t in enumerate(texts):
        total = np.zeros(DIM, dtype=np.int64)
        for lo in range(0, len(t), 1 << 20):  # pieces overlap by two characters, so no gram is lost
            b = _KEEP[np.frombuffer(t[max(0, lo - 2) : lo + (1 << 20)].lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)]
            b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])].astype(np.uint32)
            two = b[:-1] * np.uint32(257) + b[1:]
            three = two[:-1] * np.uint32(263) + b[2:]
            for g in (two, three):
                total += np.bincount(((g * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64), minlength=DIM)
        out[i] = np.sqrt(total / max(1, total.sum()))
    return out


class Model:
    """Linear bit classifiers with a ridge penalty, and the codewords.

    parts: (features, language of each row) piece by piece; counts: rows of each language.
    """

    def __init__(self, counts: dict[str, int], parts=(), ridge: float = 0.02, sharpness: float = 4.0) -> None:
        self.langs = sorted(counts)
        self.code, self.sharpness = codewords(len(self.langs)), sharpness
        number = {v: i for i, v in enumerate(self.langs)}
        bits = self.code.shape[1]
        gram, cross = np.zeros((DIM, DIM), dtype=np.float32), np.zeros((DIM, bits))
        total, labels, n = np.zeros(DIM), np.zeros(bits), 0
        for x, langs in parts:
            y = self.code[[number[v] for v in langs]]
            gram += x.T @ x
            cross += x.T @ y
            total, labels, n = total + x.sum(axis=0), labels + y.sum(axis=0), n + len(x)
        self.mean, self.bias = (total / max(1, n)).astype(np.float32), (labels / max(1, n)).astype(np.float32)
        self.weights = np.zeros((DIM, bits), dtype=np.float32)
        if bits and n:
            gram -= np.outer(self.mean, self.mean) * n
            gram[np.diag_indices(DIM)] += ridge
            self.weights = np.linalg.solve(gram, (cross - np.outer(self.mean, self.bias) * n).astype(np.float32))
        agree = self.code @ self.code.T
        self.corrects = (int((bits - (agree - 3 * bits * np.eye(len(agree))).max()) // 2) - 1) // 2 if len(agree) > 1 else 0

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        margin = (features(texts) - self.mean) @ self.weights + self.bias
        pull = self.sharpness * margin
        loss = np.logaddexp(0, -pull) @ (self.code > 0).T + np.logaddexp(0, pull) @ (self.code < 0).T
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        wrong = (np.sign(margin) != self.code[best]).sum(axis=1)
        near = np.take_along_axis(loss, order, 1)
        close = near[:, 1] - near[:, 0] < 1.0 if len(self.langs) > 1 else np.zeros(len(texts), dtype=bool)
        return best, 1 / share.sum(axis=1), close | (wrong > self.corrects)


def learn(docs: DataFrame, usable: Column, max_rows: int = 400) -> Model:
    """Model from docs(doc_id, text, lang) where usable; max_rows texts of each language at most."""
    own = docs.filter(usable & F.col("lang").isNotNull())
    counts = {x["lang"]: x["n"] for x in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not counts:
        return Model({})
    wide = 1 << 53
    share = docs.sparkSession.createDataFrame([(k, int(min(1.0, 2.0 * max_rows / n) * wide)) for k, n in counts.items()], "lang string, below long")
    h = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(wide))
    near = own.select("text", "lang", h.alias("h")).join(F.broadcast(share), "lang").filter(F.col("h") < F.col("below")).filter(F.col("text").rlike(r"\p{L}"))
    least = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("place") <= max_rows)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                x = features(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    least = saved(least.select("lang", "text"), work_dir(docs.sparkSession, "languages"))
    learned = {x["lang"]: x["n"] for x in least.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    made = map_arrow(least, run, "lang string, x binary")

    def parts():
        rows = iter(made.toLocalIterator())
        while some := list(itertools.islice(rows, 512)):
            yield np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in some]), [r["lang"] for r in some]

    return Model(learned, parts())


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns plus lang_pred string, score double, ambiguous boolean."""
    source, keep, schema = with_text(docs, keep, text, "lang_pred string, score double, ambiguous boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts = b.column(b.num_columns - 1).to_pylist()
                has = np.array([bool(t) and bool(LETTER.search(t)) and bool(m.langs) for t in texts], dtype=bool)
                lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
                at = np.flatnonzero(has)
                if len(at):
                    best, score[at], unsure[at] = m.predict([texts[i] for i in at])
                    for i, k in zip(at, best, strict=True):
                        lang[i] = m.langs[k]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang), pa.array(score), pa.array(unsure)], [*keep, "lang_pred", "score", "ambiguous"])

    return map_arrow(source, run, schema)


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs, ~held & F.col("doc_id").isNotNull())
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
