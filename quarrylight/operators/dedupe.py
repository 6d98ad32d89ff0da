"""First-wins de-duplication and its relatives. One shuffle by (analysis_id, category)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of discovery within an analysis.
ORDER = ("file_ord", "stage_ord", "rule_ord", "match_ord")


def first_wins(findings: DataFrame, *keys: str) -> DataFrame:
    """The earliest finding of each key. An aggregation (partial on the map side), so a frequent value is no hot window."""
    rest = [c for c in findings.columns if c not in keys]
    row = F.struct(*ORDER, *[c for c in rest if c not in ORDER])
    kept = findings.groupBy(*keys).agg(F.min_by(row, F.struct(*ORDER)).alias("_r"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in findings.columns])


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding for each (analysis_id, category, dedup_key): the earliest by file, stage, rule and match."""
    return first_wins(findings, "analysis_id", "category", "dedup_key")


def drop_known_routes(found: DataFrame) -> DataFrame:
    """Deduped findings without routes (stage 4) whose value was an endpoint by then, other than one from the syntax tree."""
    ends = found.filter("category = 'endpoints' AND stage_ord <> 3").groupBy("analysis_id", F.col("value").alias("_v")).agg(F.min("file_ord").alias("_f"))
    route = F.col("category") == "routes"
    known = found.filter(route).alias("r").join(ends.withColumnRenamed("analysis_id", "_a"), (F.col("r.analysis_id") == F.col("_a")) & (F.col("r.value") == F.col("_v")) & (F.col("_f") <= F.col("r.file_ord")), "left_anti")
    return found.filter(~route).unionByName(known.select(*found.columns))


def known_secrets(found: DataFrame) -> DataFrame:
    """analysis_id, dedup_key of syntax-tree secrets whose quoted text starts inside the value of a secret that stays and comes before.

    A secret that starts like one before goes, whether that one stays or not: what
    hides that one hides this one. The first of each beginning is compared with
    the secrets that share its first 8 characters. What then hangs on whether
    another such first one stays is decided in order; these are few.
    """
    order = F.struct(*ORDER)
    secret = found.filter("category = 'secrets'").select("analysis_id", "dedup_key", "value", "stage_ord", order.alias("at"))
    quoted = F.substring(F.regexp_extract("value", r"""["']([^"']{8,})["']""", 1), 1, 20)
    ast = secret.filter("stage_ord = 3").withColumn("begins", quoted)
    secret = secret.join(ast.select("analysis_id").distinct(), "analysis_id", "left_semi")
    firsts = ast.filter("begins <> ''").groupBy("analysis_id", "begins").agg(F.min(F.struct("at", "dedup_key")).alias("f")).select("analysis_id", "begins", "f.*")
    again = ast.filter("begins <> ''").join(firsts.select("analysis_id", "dedup_key"), ["analysis_id", "dedup_key"], "left_anti").select("analysis_id", "dedup_key")

    stay = firsts.select("analysis_id", "dedup_key", F.lit(True).alias("open"))
    held = secret.filter("stage_ord <> 3").select("analysis_id", "dedup_key", "value", "at", F.lit(False).alias("open"))
    held = held.unionByName(ast.filter("begins = ''").select("analysis_id", "dedup_key", "value", "at", F.lit(False).alias("open")))
    held = held.unionByName(ast.join(stay, ["analysis_id", "dedup_key"]).select("analysis_id", "dedup_key", "value", "at", "open"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("value") - 7), lambda i: F.substr("value", i, F.lit(8))))
    held = held.filter(F.length("value") >= 8).select("analysis_id", F.col("dedup_key").alias("by"), "value", F.col("at").alias("by_at"), "open", F.explode(grams).alias("gram"))
    asks = firsts.select("analysis_id", "dedup_key", "begins", "at", F.substring("begins", 1, 8).alias("gram"))
    hits = asks.join(held, ["analysis_id", "gram"]).filter((F.col("by_at") < F.col("at")) & F.contains("value", F.col("begins")))
    hits = hits.groupBy("analysis_id", "dedup_key", "at").agg(F.bool_or(~F.col("open")).alias("sure"), F.collect_set(F.when(F.col("open"), F.col("by"))).alias("by"))

    def step(gone: Column, r: Column) -> Column:
        hidden = r["sure"] | F.exists(r["by"], lambda v: ~F.array_contains(gone, v))
        return F.when(hidden, F.array_append(gone, r["dedup_key"])).otherwise(gone)

    rows = hits.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("at", "dedup_key", "sure", "by"))).alias("rows"))
    gone = rows.select("analysis_id", F.explode(F.aggregate("rows", F.array().cast("array<string>"), step)).alias("dedup_key"))
    return again.unionByName(gone)


def drop_known_secrets(found: DataFrame) -> DataFrame:
    """Deduped findings without known_secrets()."""
    ast = (F.col("category") == "secrets") & (F.col("stage_ord") == 3)
    return found.filter(~ast).unionByName(found.filter(ast).join(known_secrets(found), ["analysis_id", "dedup_key"], "left_anti").select(*found.columns))


def across_files(findings: DataFrame) -> DataFrame:
    """analysis_id, category, value with the first finding's attributes, its sources in order and their number."""
    files = F.array_sort(F.collect_set(F.struct("file_ord", "source_file")))
    first = lambda c: F.min_by(c, F.struct(*ORDER)).alias(c)
    g = findings.groupBy("analysis_id", "category", "value").agg(first("type"), first("severity"), first("confidence"), first("rule_id"), F.transform(files, lambda f: f["source_file"]).alias("sources"))
    return g.withColumn("n_sources", F.size(F.array_distinct("sources"))).withColumn("sources", F.array_distinct("sources"))
