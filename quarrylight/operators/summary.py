"""Counts, filters and search over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import CATEGORIES, SEVERITIES


def categories(spark) -> DataFrame:
    return spark.createDataFrame([(k, i, label) for k, (i, label) in enumerate(CATEGORIES)], "ord int, category string, label string")


def severity_rank(severity: Column) -> Column:
    """0 for critical to 4 for info; 5 for what is unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(k))]), severity), F.lit(len(SEVERITIES)))


def category_counts(findings: DataFrame) -> DataFrame:
    """Every category with its count, zeros too."""
    counts = findings.groupBy("category").agg(F.count("*").alias("n"))
    return F.broadcast(categories(findings.sparkSession)).join(counts, "category", "left").select("ord", "category", "label", F.coalesce("n", F.lit(0)).alias("n"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """The five severities with their counts, zeros too; unknown ones are left out."""
    dim = findings.sparkSession.createDataFrame([(k, s) for k, s in enumerate(SEVERITIES)], "rank int, severity string")
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "severity", "left").select("rank", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def severity_by_category(findings: DataFrame) -> DataFrame:
    """An extension: counts for each category and severity, with totals (cube)."""
    return findings.cube("category", "severity").agg(F.count("*").alias("n"))


def analysis_summary(findings: DataFrame) -> DataFrame:
    """analysis_id, map of category to count, total. Aggregated by category first, so the map is built from few rows."""
    counts = findings.groupBy("analysis_id", "category").agg(F.count("*").alias("n"))
    return counts.groupBy("analysis_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("summary"), F.sum("n").alias("total"))


def with_severity(findings: DataFrame, severity: str) -> DataFrame:
    return findings if severity == "all" else findings.filter(F.col("severity") == severity)


def in_category(findings: DataFrame, category: str) -> DataFrame:
    return findings.filter(F.col("category") == category)


def search(findings: DataFrame, text: str) -> DataFrame:
    """Findings whose value or file has the text, whatever its case."""
    q = F.lit(text.lower())
    return findings.filter(F.contains(F.lower("value"), q) | F.contains(F.lower("source_file"), q))


def next_occurrence(content: Column, value: Column, after: Column) -> Column:
    """1-based place of value in content after a place, from the start again if there is none; 0 if nowhere."""
    return F.coalesce(F.nullif(F.call_function("locate", value, content, after), F.lit(0)), F.call_function("locate", value, content, F.lit(1)))
