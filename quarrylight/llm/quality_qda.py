"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text are transformed towards normal shape (logs and
log-odds) and standardised. Each class has a mean and a covariance shrunk
towards the pooled covariance and towards a multiple of the identity; its
Cholesky factor and its inverse are computed once. The score is a logistic function
of the difference of the classes' log densities (Mahalanobis distances, log
determinants from the factors) and log priors; its slope and offset are fitted
on the same rows with equal weight of the classes, since a class of mixed junk
has a broad density that wins over rare clean texts such as very short ones.

Learning takes max_rows labelled rows at most (parameter), those with the least
hashes of doc_id; their statistics are computed by executors, and the driver
gets one short vector for each.

Defined cases: null text is scored as the empty text; without labelled rows of
both classes every score is the share of label 1, or 0.5; labels other than 0
and 1, and null doc_ids, are not learned from; of texts that share a labelled
doc_id the least vector is; a very long text is counted whole, word by word (some
60 bytes for each); equal scores are equal verdicts; repeated rows stay; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, map_arrow, mix, with_text, words_of

NAMES = (
    "log_words", "mean_word", "spread_word", "distinct_words", "top_word", "short_words", "upper", "digits",
    "marks", "stops", "commas", "symbols", "line_length", "repeated_lines", "repeated_pairs", "plain_words",
)
_UPPER, _DIGIT, _MARK, _SYMBOL, _LOWER = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _LOWER[97:123] = _LOWER[128:] = True
_MARK[[33, 63, 34, 39, 40, 41, 45, 47, 58, 59, 91, 93, 95]] = True
_SYMBOL[[35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 96, 123, 124, 125, 126]] = True


def _odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5 + 1e-9))) if whole >= part else 0.0


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text, in the order of NAMES."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    h, start, end = words_of(text)
    n, size = len(h), len(raw)
    if not n:
        return np.zeros(len(NAMES))
    length = end - start
    chars = float(length.sum())
    order = np.sort(h)
    edges = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1], [True]]))
    runs = np.diff(edges)
    pairs = np.sort(h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])
    count = np.bincount(raw, minlength=256)
    breaks = np.flatnonzero(raw == 10)
    line = np.searchsorted(breaks, start)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    with np.errstate(over="ignore"):
        place = np.arange(n, dtype=np.uint64) - np.repeat(first, np.diff(np.append(first, n))).astype(np.uint64)
        lines = np.add.reduceat(mix(h + (place + np.uint64(1)) * np.uint64(BASE)), first)
    plain = np.concatenate([[0], np.cumsum(_LOWER[raw] | _UPPER[raw])])
    n_plain = int((plain[end] - plain[start] == length).sum())
    twice = int((pairs[1:] == pairs[:-1]).sum())
    return np.array([
        np.log1p(n), np.log(chars / n), np.log1p(length.std()), _odds(len(runs), n) / np.log(n + 2.0), _odds(runs.max(), n),
        _odds(int((length <= 3).sum()), n), _odds(count[_UPPER].sum(), chars), _odds(count[_DIGIT].sum(), chars), _odds(min(n, count[_MARK].sum()), n),
        _odds(min(n, count[46]), n), _odds(min(n, count[44]), n), _odds(count[_SYMBOL].sum(), chars), np.log(size / len(first)),
        _odds(len(lines) - len(np.unique(lines)), len(lines)), _odds(twice, max(n, 1)), _odds(n_plain, n),
    ])


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = 0.15, ridge: float = 0.1) -> None:
        self.prior = float(y.mean()) if len(y) else 0.5
        self.parts = None
        sizes = [(y == c).sum() for c in (0, 1)]
        if min(sizes) < 2:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        means = [z[y == c].mean(axis=0) for c in (0, 1)]
        covs = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
        pooled = sum(n * s for n, s in zip(sizes, covs, strict=True)) / sum(sizes)
        self.parts = []
        for n, m, s in zip(sizes, means, covs, strict=True):
            s = (1 - shrink) * s + shrink * pooled
            s = (1 - ridge) * s + ridge * np.trace(s) / len(s) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.parts.append((m, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()), float(np.log(n / sum(sizes)))))
        self.scaling = self.calibrate(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        a, b = self.scaling
        return 1 / (1 + np.exp(-np.clip(a * self.difference(x) + b, -500, 500)))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """asinh of the difference of log densities, label 1 less label 0."""
        z = (x - self.mean) / self.scale
        density = [p - d - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) for m, inv, d, p in self.parts]
        return np.arcsinh(density[1] - density[0])

    def calibrate(self, x: np.ndarray, y: np.ndarray, penalty: float = 0.01, rounds: int = 60) -> tuple[float, float]:
        """Slope and offset of the logistic function of difference() by Newton's method; the classes weigh the same."""
        d = np.stack([self.difference(x), np.ones(len(x))], axis=1)
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        at = np.zeros(2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(d @ at, -60, 60)))
            slope = d.T @ (weight * (p - y)) + penalty * at
            curve = (d * (weight * p * (1 - p))[:, None]).T @ d + penalty * np.eye(2)
            move = np.linalg.solve(curve, slope)
            at = at - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        return max(float(at[0]), 1e-6), float(at[1])


def with_statistics(docs: DataFrame, keep: list[str], finish, kinds: str, text: str = "text") -> DataFrame:
    """Kept columns plus the columns that finish(matrix of statistics) gives."""
    source, keep, schema = with_text(docs, keep, text, kinds)
    names = schema.fieldNames()

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                x = np.stack([statistics(t) for t in b.column(b.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *finish(x)], names)

    return map_arrow(source, run, schema)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None, max_rows: int = 8_000) -> Discriminant:
    """Discriminant from labels(doc_id, label in 0, 1) and the texts of docs(doc_id, text); max_rows rows at most."""
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.filter(usable) if usable is not None else own
    n, wide = own.count(), 1 << 53
    h = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(wide))
    chosen = own.select("doc_id", F.col(label).alias("_label"), h.alias("h")).filter(F.col("h") < int(min(1.0, 1.5 * max_rows / max(1, n)) * wide))
    chosen = chosen.orderBy("h", "_label").limit(max_rows).select("doc_id", "_label").distinct()
    # max_rows rows of two numbers: a bound that the parameter sets
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of texts that share a doc_id one counts, so that no more than max_rows rows reach the driver
    made = with_statistics(texts, ["doc_id", "_label"], lambda x: [pa.array(list(x))], "x array<double>")
    rows = made.groupBy("doc_id", "_label").agg(F.min("x").alias("x")).orderBy("doc_id", "_label").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES))
    return Discriminant(x, np.array([r["_label"] for r in rows], dtype=np.int64))


def classify(docs: DataFrame, model: Discriminant, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """Kept columns plus score double and predicted int (1 where score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def finish(x):
        s = shared.value.score(x)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return with_statistics(docs, keep, finish, "score double, predicted int")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn(docs, labels, usable=~held_out())
    return classify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
