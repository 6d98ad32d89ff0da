"""Recorded runs of scripts as findings. Nothing is executed from here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import conform


def trace_findings(traces: DataFrame) -> DataFrame:
    """traces(path, urls array<struct<type,url,method>>, calls array<struct<type,value>>, errors array<string>) -> findings."""
    part = lambda value, type_, severity, k, i: F.struct(value.alias("value"), type_.alias("type"), F.lit(severity).alias("severity"), F.lit(k).alias("rule_ord"), i.alias("match_ord"))
    method = lambda u: F.when(F.coalesce(u["method"], F.lit("")) != "", F.concat(F.lit(" ("), u["method"], F.lit(")"))).otherwise("")
    every = F.concat(
        F.transform(F.coalesce("urls", F.array().cast("array<struct<type:string,url:string,method:string>>")), lambda u, i: part(u["url"], F.concat(F.lit("Runtime "), u["type"], method(u)), "medium", 0, i)),
        F.transform(F.coalesce("calls", F.array().cast("array<struct<type:string,value:string>>")), lambda c, i: part(F.concat(c["type"], F.lit(": "), F.substring(F.coalesce(c["value"], F.lit("")), 1, 150)), F.lit("Runtime Dangerous Call"), "high", 1, i)),
        F.transform(F.coalesce("errors", F.array().cast("array<string>")), lambda e, i: part(e, F.lit("Runtime Error"), "info", 2, i)),
    )
    rows = traces.select(F.col("path").alias("analysis_id"), F.col("path").alias("source_file"), F.explode(every).alias("f")).select("analysis_id", "source_file", "f.*")
    return conform(rows.select("*", F.lit("dynamic").alias("category"), F.lit("high").alias("confidence"), F.lit("dynamic").alias("rule_id"), F.lit(0).alias("file_ord"), F.lit(8).alias("stage_ord")))
