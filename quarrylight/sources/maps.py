"""Source maps, external and inline, as sources and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_base64
from ..operators.scan import conform

SHAPE = "struct<sources:array<string>,sourcesContent:array<string>>"
INLINE = r"//[#@]\s*sourceMappingURL=data:application/json;(?:charset=[^;]+;)?base64,([A-Za-z0-9+/=]+)"


def parse_maps(maps: DataFrame) -> DataFrame:
    """maps(analysis_id, file_ord, path, json) -> analysis_id, file_ord, path, idx, source, content of each entry."""
    m = maps.select("analysis_id", "file_ord", "path", F.from_json("json", SHAPE).alias("m"))
    zipped = F.arrays_zip(F.col("m.sources").alias("source"), F.col("m.sourcesContent").alias("content"))
    return m.filter("m IS NOT NULL").select("analysis_id", "file_ord", "path", F.posexplode(zipped).alias("idx", "e")).select("*", "e.*").drop("e")


def map_files(maps: DataFrame) -> DataFrame:
    """Embedded original files: no empty content, no vendor folders; a nameless one is source_<idx>.js."""
    name = F.coalesce(F.nullif("source", F.lit("")), F.concat(F.lit("source_"), F.col("idx").cast("string"), F.lit(".js")))
    rows = parse_maps(maps).withColumn("file", name).filter(F.col("content").rlike(r"\S"))
    return rows.filter(~F.col("file").contains("node_modules/") & ~F.col("file").contains("webpack/")).select("analysis_id", "file_ord", "path", "idx", "file", "content")


def map_paths(maps: DataFrame) -> DataFrame:
    """The paths that an external map lists, as endpoint findings."""
    rows = parse_maps(maps).filter("source IS NOT NULL AND source <> ''")
    return conform(
        rows.select(
            "analysis_id", "file_ord", F.col("source").alias("value"), F.lit("Source Map Path").alias("type"), F.lit("endpoints").alias("category"), F.lit("info").alias("severity"), F.lit("high").alias("confidence"),
            F.col("path").alias("source_file"), F.lit("sourcemap").alias("rule_id"), F.lit(0).alias("stage_ord"), F.lit(0).alias("rule_ord"), F.col("idx").alias("match_ord"),
        )
    )


def inline_maps(sources: DataFrame) -> DataFrame:
    """analysis_id, file_ord, path, json of the first inline map of each content; malformed ones are left out."""
    rows = sources.select("analysis_id", "file_ord", "path", F.regexp_extract("content", INLINE, 1).alias("data")).filter("data <> ''")
    raw = decode_base64(F.col("data"))
    return rows.withColumn("raw", raw).filter(F.is_valid_utf8("raw")).select("analysis_id", "file_ord", "path", F.decode("raw", "UTF-8").alias("json"))
