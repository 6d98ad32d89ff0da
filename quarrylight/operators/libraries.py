"""Library detection by content, file name and hash, and matching against advisories by version range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import packed, version_number
from .library_data import ADVISORIES, HASHES, LIBRARIES
from .scan import TYPES, conform


def advisories(spark) -> DataFrame:
    """advisories(lib, advisory_ord, id, severity, lo, hi, fixed): a constant of a few dozen rows."""
    rows = [(lib, k, i, sev, packed(lo), packed(hi), fixed) for k, (lib, i, sev, lo, hi, fixed) in enumerate(ADVISORIES)]
    return spark.createDataFrame(rows, "lib string, advisory_ord int, id string, severity string, lo long, hi long, fixed string")


def _first(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")) for p in patterns])


def _detect(sources: DataFrame, text: Column, kinds, how: str, confidence: str, suffix: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("lib_ord"), F.lit(x.name).alias("lib"), _first(text, kinds(x)).alias("version")) for k, x in enumerate(LIBRARIES) if kinds(x)])
    found = sources.select("analysis_id", "file_ord", "path", F.explode(F.filter(rows, lambda r: r["version"].isNotNull())).alias("d"))
    return found.select("analysis_id", "file_ord", "path", "d.lib_ord", "d.lib", "d.version", F.lit(how).alias("how"), F.lit(confidence).alias("confidence"), F.lit(suffix).alias("suffix"))


def by_content(sources: DataFrame) -> DataFrame:
    """The first signature, in declared order, whose first match has a version."""
    return _detect(sources, F.col("content"), lambda x: x.content, "content", "high", "")


def by_filename(sources: DataFrame) -> DataFrame:
    return _detect(sources, F.col("path"), lambda x: (*x.files, *x.cdn), "filename", "medium", " (detected via filename)")


def by_hash(sources: DataFrame, hashes: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Content whose SHA-256 (hex, or sha256- and base64) is registered: hash -> (library, version)."""
    known = HASHES if hashes is None else hashes
    table = F.create_map(*[x for h, (lib, v) in known.items() for x in (F.lit(h), F.struct(F.lit(lib).alias("lib"), F.lit(v).alias("version")))])
    hexed = F.sha2("content", 256)
    hit = F.coalesce(F.try_element_at(table, F.concat(F.lit("sha256-"), F.base64(F.unhex(hexed)))), F.try_element_at(table, hexed))
    found = sources.select("analysis_id", "file_ord", "path", hit.alias("d")).filter("d IS NOT NULL")
    return found.select("analysis_id", "file_ord", "path", F.lit(0).alias("lib_ord"), "d.lib", "d.version", F.lit("hash").alias("how"), F.lit("high").alias("confidence"), F.lit(" (detected via hash)").alias("suffix"))


def detect(sources: DataFrame, hashes: bool = False) -> DataFrame:
    """Libraries of each file once for each version; content comes before file name, that before hash."""
    rank = F.when(F.col("how") == "content", 0).when(F.col("how") == "filename", 1).otherwise(2)
    every = by_content(sources).unionByName(by_filename(sources))
    every = (every.unionByName(by_hash(sources)) if hashes else every).withColumn("rank", rank)
    rest = ["lib_ord", "how", "confidence", "suffix"]
    g = every.groupBy("analysis_id", "file_ord", "path", "lib", "version").agg(F.min_by(F.struct(*rest), "rank").alias("r"), F.min("rank").alias("rank"))
    return g.select("analysis_id", "file_ord", "path", "lib", "version", *[F.col(f"r.{c}").alias(c) for c in rest], "rank")


def match_advisories(detected: DataFrame) -> DataFrame:
    """detected with id, severity, fixed of every advisory whose range holds the version: an equi-join with a range residual."""
    adv = F.broadcast(advisories(detected.sparkSession).withColumnRenamed("lib", "a_lib"))
    v = version_number(F.col("version"))
    return detected.withColumn("v", v).join(adv, (F.col("lib") == F.col("a_lib")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).drop("a_lib")


def without_advisory(detected: DataFrame) -> DataFrame:
    """Anti-join: libraries that no advisory concerns."""
    adv = F.broadcast(advisories(detected.sparkSession).withColumnRenamed("lib", "a_lib"))
    return detected.withColumn("v", version_number(F.col("version"))).join(adv, (F.col("lib") == F.col("a_lib")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")), "left_anti")


def scan_libraries(sources: DataFrame) -> DataFrame:
    """Findings of stage 5: advisories under libraries and vulnerabilities, other libraries as safe."""
    found = detect(sources)
    name = F.concat("lib", F.lit(" v"), "version")
    url = F.when(F.col("id").startswith("CVE-"), F.array(F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "id"))).otherwise(F.array().cast("array<string>"))
    hit = match_advisories(found).withColumns({
        "value": F.concat(name, F.lit(" — "), "id", "suffix"), "type": F.lit("Vulnerable Library"), "_ord": F.col("advisory_ord"), "category": F.explode(F.array(F.lit("libraries"), F.lit("vulnerabilities"))),
        "library": F.struct(F.col("lib").alias("name"), "version", F.col("id").alias("advisory_id"), "fixed", F.col("fixed").isNull().alias("is_eol"), url.alias("refs")).cast(TYPES["library"]),
    })
    none = F.lit(None).cast("string")
    safe = without_advisory(found).withColumns({
        "value": F.concat(name, F.lit(" — No known vulnerabilities"), "suffix"), "type": F.lit("Library (Safe)"), "severity": F.lit("info"), "_ord": F.lit(0), "category": F.lit("libraries"),
        "library": F.struct(F.col("lib").alias("name"), "version", none.alias("advisory_id"), none.alias("fixed"), F.lit(False).alias("is_eol"), F.array().cast("array<string>").alias("refs")).cast(TYPES["library"]),
    })
    out = hit.unionByName(safe, allowMissingColumns=True)
    return conform(out.select("*", F.col("path").alias("source_file"), F.lit("vuln-scanner").alias("rule_id"), F.lit(5).alias("stage_ord"), (F.col("rank") * 100 + F.col("lib_ord")).alias("rule_ord"), F.col("_ord").alias("match_ord")))
