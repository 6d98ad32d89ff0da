"""Candidates for further script files, and those of them that were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import directory_of, spark_pattern
from .scan import conform

# A chunk map, a name in it, and a dynamic import. The map's entries repeat possessively, so a large map is matched in a loop.
MAP = r"""\{((?:\d+:["'][a-zA-Z0-9\-_]+["']\s*+,?\s*+)++)\}"""
NAME = r"""["']([a-zA-Z0-9\-_]+)["']"""
IMPORT = r"""import\s*\(\s*["']([^"']+\.js)["']\s*\)"""


def resolve(base: Column, path: Column) -> Column:
    """An absolute URL from a directory URL and a relative path, with ./ and ../ and a leading slash."""
    origin = F.regexp_extract(base, r"^([a-zA-Z]+://[^/]*)", 1)
    whole = F.when(path.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), path)).when(path.startswith("/"), F.concat(origin, path)).otherwise(F.concat(base, path))
    head = F.regexp_extract(whole, r"^([a-zA-Z]+://[^/]*)", 1)
    parts = F.split(F.substr(whole, F.length(head) + 2), "/")
    walk = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    return F.concat(head, F.lit("/"), F.array_join(walk, "/"))


def chunk_candidates(sources: DataFrame) -> DataFrame:
    """analysis_id, file_ord, url: distinct script URLs that a content names, where its base URL is known."""
    base = directory_of(F.col("base_url"))
    maps = F.regexp_extract_all("content", F.lit(spark_pattern(MAP)), F.lit(1))
    named = F.flatten(F.transform(maps, lambda m: F.regexp_extract_all(m, F.lit(NAME), F.lit(1))))
    named = F.filter(named, lambda n: n != "undefined")
    imports = F.regexp_extract_all("content", F.lit(spark_pattern(IMPORT)), F.lit(1))
    urls = F.concat(F.transform(named, lambda n: F.concat(base, n, F.lit(".js"))), F.transform(imports, lambda p: F.when(p.startswith("http"), p).otherwise(resolve(base, p))))
    rows = sources.filter(F.col("base_url").isNotNull() & (F.col("base_url") != ""))
    return rows.select("analysis_id", "file_ord", F.explode(F.array_distinct(urls)).alias("url"))


def fetched_chunks(candidates: DataFrame, fetched: DataFrame) -> DataFrame:
    """Findings for candidates among landed pages fetched(url, content); nothing is requested from here."""
    got = fetched.filter("content IS NOT NULL").select("url", F.length("content").alias("content_length")).dropDuplicates(["url"])
    rows = candidates.join(got, "url")
    return conform(
        rows.select(
            "analysis_id", "file_ord", F.col("url").alias("value"), F.lit("JS Chunk").alias("type"), F.lit("files").alias("category"), F.lit("info").alias("severity"), F.lit("high").alias("confidence"),
            F.lit("chunk-crawler").alias("source_file"), F.lit("chunk").alias("rule_id"), F.lit(7).alias("stage_ord"), F.lit(0).alias("rule_ord"), F.lit(0).alias("match_ord"),
        )
    )
