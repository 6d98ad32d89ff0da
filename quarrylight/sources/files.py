"""Files, pasted text and landed web pages as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import remote_name
from ..operators.scan import sources_of

CODE = "*.{js,ts,map}"


def read_files(spark: SparkSession, path: str, analysis_id: str | None = None, glob: str = CODE, recursive: bool = True) -> DataFrame:
    """Code files below path, one row each. With analysis_id they are one analysis in order of their names."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    if analysis_id is None:
        return sources_of(rows, F.col("path"), F.col("content"))
    # numbers by name among the files of one analysis: the names alone are ordered
    order = F.row_number().over(Window.partitionBy(F.lit(analysis_id)).orderBy("path")) - 1
    numbered = rows.join(rows.select("path").withColumn("_o", order), "path")
    return sources_of(numbered, F.col("path"), F.col("content"), F.lit(analysis_id), F.col("_o"))


def is_code(path: Column, mime: Column | None = None) -> Column:
    """Files that an analysis takes: .js, .ts, .map, or a JavaScript type."""
    by_name = path.endswith(".js") | path.endswith(".ts") | path.endswith(".map")
    return by_name | F.coalesce(mime.contains("javascript"), F.lit(False)) if mime is not None else by_name


def pasted(spark: SparkSession, text: str, name: str = "pasted-code", base_url: str | None = None) -> DataFrame:
    return spark.createDataFrame([(name, 0, name, base_url, text.strip())], "analysis_id string, file_ord long, path string, base_url string, content string")


def landed(pages: DataFrame, url: str = "url", content: str = "content") -> DataFrame:
    """Pages that something else has fetched: the path is the URL's file name, the base URL the URL."""
    u = F.col(url)
    return sources_of(pages, remote_name(u), F.col(content), analysis=u, base_url=u)


def joined_text(sources: DataFrame) -> DataFrame:
    """analysis_id and all its files in one text, each under a line with its path."""
    piece = F.struct("file_ord", "path", F.concat(F.lit("// === "), "path", F.lit(" ===\n"), "content").alias("t"))
    return sources.groupBy("analysis_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), "\n\n").alias("content"))


def input_size(sources: DataFrame) -> DataFrame:
    return sources.select("analysis_id", "path", F.size(F.split("content", "\n", -1)).alias("n_lines"), F.length("content").alias("n_chars"))
