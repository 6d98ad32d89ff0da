"""An extension: scan code files as they land in a folder.

The scan is the batch plan, since it keeps no state; de-duplication is bounded
by a watermark on the arrival time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import RULES, Rule
from ..operators.scan import scan_rules, sources_of

LANDED = "path string, content string, landed_at timestamp"


def landing_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Rows (path, content, landed_at) of Parquet files that arrive in a folder."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files).parquet(folder)


def scan_stream(stream: DataFrame, rules: tuple[Rule, ...] = RULES, delay: str = "1 hour") -> DataFrame:
    """Findings of a stream, each (path, category, value) once within the watermark."""
    key = F.concat_ws("\n", "path", F.col("landed_at").cast("string"))
    rows = sources_of(stream, F.col("path"), F.col("content"), analysis=key)
    landed = F.to_timestamp(F.substring_index("analysis_id", "\n", -1))
    found = scan_rules(rows, rules).withColumn("landed_at", landed).withColumn("analysis_id", F.col("source_file"))
    return found.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["analysis_id", "category", "dedup_key"])


def append_findings(batch: DataFrame, batch_id: int, path: str) -> None:
    """A foreachBatch sink: each batch has its own folder, so one that is tried again replaces itself."""
    batch.write.mode("overwrite").partitionBy("category").parquet(f"{path}/batch={batch_id}")
