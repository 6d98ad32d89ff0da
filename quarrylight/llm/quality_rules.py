r"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Statistics of a whole text are expressions of one row: no shuffle, no Python.
Rules are predicates over them. order_rules() estimates on a random sample what
share each rule rejects and what its evaluation costs, and sorts by rejection
per cost; the cascade is one CASE whose branches are tried in that order, each
with the statistics that it alone needs inside, so a document is decided, and
paid for, up to the first rule that rejects it. The verdict does not depend on
the order. The two base rules stand first, since base_failed is a result.

Words are [^\x20\x09-\x0D]+. Defined cases: null and empty texts have no
words, all counts are 0 and the base rules reject them; a very long text is
worked on as one row (some 50 bytes for each word); equal rejections per cost
are ordered by cost, then name; repeated rows are decided one by one; an empty
table gives no rows; columns with the name of a result give way to it, others
are passed through.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, work_dir

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(t: Column) -> Column:
    return F.filter(F.split(t, SPACE), lambda w: w != "")


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _left(t: Column, gone: str) -> Column:
    """Characters of t without the matches of a pattern."""
    return F.length(F.regexp_replace(t, gone, ""))


@dataclass(frozen=True)
class Parts:
    """A text that is not null, its words and its lines with a word."""

    text: Column
    words: Column
    lines: Column


def parts(t: Column) -> Parts:
    return Parts(t, _words(t), _lines(t))


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more, first ones included."""
    n = WINDOW
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n)))
    beside = lambda s, k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
    begins = lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(beside(s, k), x["i"])), lambda i: i.isNotNull()))
    covered = lambda p: F.aggregate(
        p, F.struct(F.lit(-1).alias("end"), F.lit(0).alias("sum")),
        lambda acc, i: F.struct((i + n).alias("end"), (acc["sum"] + F.lit(n) - F.greatest(F.lit(0), acc["end"] - i)).alias("sum")),
    )["sum"]
    pairs = lambda w: F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # only texts in which some window repeats pay for the sort
    count = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(pairs(w), lambda s: covered(begins(s)))).otherwise(F.lit(0))
    return let(hashes, lambda h: F.when(F.size(h) < n, F.lit(0)).otherwise(let(windows(h), count)))


#: Statistics of a text, each one expression.
STATISTICS: dict[str, Callable[[Parts], Column]] = {
    "n_words": lambda p: F.size(p.words),
    "word_chars": lambda p: _left(p.text, SPACE),
    "n_symbols": lambda p: _left(p.text, r"[^#*$%&|<>]+"),
    "n_dup_lines": lambda p: let(p.lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "n_repeat_words": lambda p: _repeat_words(p.words),
    "n_lines": lambda p: F.size(p.lines),
    "n_upper": lambda p: _left(p.text, r"[^A-Z]+"),
    "n_digits": lambda p: _left(p.text, r"[^0-9]+"),
    "n_bullets": lambda p: F.size(F.filter(F.split(p.text, "\n"), lambda x: x.rlike(r"^[\x20\x09]*[-*+] "))),
    "n_ellipses": lambda p: F.size(F.filter(F.split(p.text, "\n"), lambda x: x.rlike(r"\.\.\.[\x20\x09\x0D]*\z"))),
}


@dataclass(frozen=True)
class Rule:
    """A document is rejected where fails(the statistics named in needs) is true."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[..., Column]

    def column(self, have: tuple[str, ...], p: Parts) -> Column:
        """The rule over the columns of the statistics in have; others that it needs are computed from p where it is tried."""

        def bind(left: tuple[str, ...], got: list[Column]) -> Column:
            if not left:
                return self.fails(*got)
            if left[0] in have:
                return bind(left[1:], [*got, F.col(left[0])])
            return let(STATISTICS[left[0]](p).cast("long"), lambda v: bind(left[1:], [*got, v]))

        return bind(self.needs, [])


BASE = (
    Rule("too_few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
)
RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("long_words", ("word_chars", "n_words"), lambda c, n: c > 12 * n),
    Rule("short_words", ("word_chars", "n_words"), lambda c, n: c < 2 * n),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    Rule("shouting", ("n_upper", "word_chars"), lambda u, c: 2 * u > c),
    Rule("digits", ("n_digits", "word_chars"), lambda d, c: 2 * d > c),
    Rule("bullets", ("n_bullets", "n_lines"), lambda b, n: 10 * b > 9 * n),
    Rule("ellipses", ("n_ellipses", "n_lines"), lambda e, n: 10 * e > 3 * n),
)


def order_rules(sample: DataFrame, rules: tuple[Rule, ...] = RULES, have: tuple[str, ...] = (), runs: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds) on a stored sample of texts, most rejections per second first.

    have: statistics that are at hand when the cascade runs; they are computed
    beforehand here too. A rule's cost is the least time of so many warm runs of
    it over the sample, less that of a run without a rule.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    made = saved(sample.select("text", *[STATISTICS[s](parts(t)).cast("long").alias(s) for s in have]), work_dir(sample.sparkSession, "sample")).coalesce(1)
    verdicts = {r: r.column(have, parts(t)) for r in rules}
    got = made.agg(F.count("*").alias("_all"), *[F.sum(v.cast("int")).alias(r.name) for r, v in verdicts.items()]).first()

    def seconds(condition: Column) -> float:
        query, best = made.filter(condition).agg(F.count("*")), float("inf")
        for _ in range(runs + 1):  # the first one compiles
            start = time.perf_counter()
            query.first()
            best = min(best, time.perf_counter() - start)
        return best

    alone = seconds(F.octet_length(t) >= 0)
    cost = {r: max(seconds(v) - alone, 1e-4) for r, v in verdicts.items()}
    out = [(r, (got[r.name] or 0) / max(1, got["_all"]), cost[r]) for r in rules]
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2_000, statistics: tuple[str, ...] = (), seed: int = 9, ordered: list[Rule] | None = None) -> DataFrame:
    """docs(text, ...) plus statistics, base_failed, kept and rejected_by (the first rule, in cascade order, that fails).

    statistics: those wanted as columns, which are computed for every row.
    All others are computed only where a rule that needs them is tried: a
    document that an earlier rule rejects costs nothing more. The order is
    estimated on a random sample of sample_rows rows, about; it takes one scan of
    the texts (none if the order is given). The verdict covers all rows.
    """
    new = [*statistics, "base_failed", "rejected_by", "kept"]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*new, "__qr_text", "__qr_words", "__qr_lines"}]
    t = F.coalesce(F.col("text"), F.lit(""))
    if ordered is None:
        share = min(1.0, sample_rows / max(1, docs.count()))
        sample = saved(docs.select("text").sample(share, seed) if share < 1 else docs.select("text"), work_dir(docs.sparkSession, "rules"))
        ordered = [r for r, _, _ in order_rules(sample, rules, statistics)]
    # words and lines are split once if columns need them, else where a rule is tried
    split = docs.select(*own, t.alias("__qr_text"))
    p = parts(F.col("__qr_text"))
    if {"n_words", "n_repeat_words"} & set(statistics):
        split, p = split.withColumn("__qr_words", p.words), Parts(p.text, F.col("__qr_words"), p.lines)
    if {"n_lines", "n_dup_lines"} & set(statistics):
        split, p = split.withColumn("__qr_lines", p.lines), Parts(p.text, p.words, F.col("__qr_lines"))
    stats = split.select("*", *[STATISTICS[s](p).cast("long").alias(s) for s in statistics])
    verdict = F.when(F.lit(False), F.lit(""))
    for r in (*BASE, *ordered):
        verdict = verdict.when(r.column(statistics, p), F.lit(r.name))
    out = stats.select(*own, *statistics, verdict.alias("rejected_by"))
    return out.select("*", F.coalesce(F.col("rejected_by").isin(*[r.name for r in BASE]), F.lit(False)).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = cascade(docs, statistics=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]+', '', 'g')) AS n_digits,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09]*[-*+] '))) AS n_bullets,
        len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\.\.\.[\x20\x09\x0D]*$'))) AS n_ellipses
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars > 12 * n_words
       OR word_chars < 2 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_upper > word_chars
       OR 2 * n_digits > word_chars OR 10 * n_bullets > 9 * n_lines OR 10 * n_ellipses > 3 * n_lines) AS kept
FROM s
"""
