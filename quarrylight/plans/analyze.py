"""A whole analysis: sources to raw findings to findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import chunk_candidates, fetched_chunks
from ..operators.dedupe import dedupe, drop_known_routes, drop_known_secrets
from ..operators.fingerprint import fingerprint
from ..operators.hosts import harvest_hosts
from ..operators.libraries import scan_libraries
from ..operators.routes import scan_routes
from ..operators.rules import RULES, Rule
from ..operators.scan import conform, scan_entropy, scan_rules, sources_of
from ..operators.syntax import scan_syntax
from ..sources.maps import inline_maps, map_files, map_paths
from ..sources.traces import trace_findings
from .work import stored


#: Places for the originals of one file, which come before it.
PLACES = 1 << 24


def expand_maps(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, maps): files that end in .map are maps(analysis_id, file_ord, path, json), all others code.

    The originals embedded in a map, or in the inline map of a file, are code as
    well; in the order of files they stand before the file that holds them.
    """
    is_map = F.col("path").endswith(".map")
    maps = sources.filter(is_map).select("analysis_id", "file_ord", "path", F.col("content").alias("json"))
    code = sources.filter(~is_map)
    inner = map_files(inline_maps(code).unionByName(maps))
    place = F.col("file_ord") * PLACES
    originals = sources_of(inner, F.col("file"), F.col("content"), F.col("analysis_id"), place + F.least(F.col("idx"), F.lit(PLACES - 2)))
    last = place + (PLACES - 1)
    return code.withColumn("file_ord", last).unionByName(originals), maps.withColumn("file_ord", last)


def findings_raw(
    sources: DataFrame, rules: tuple[Rule, ...] = RULES, entropy_threshold: float = 4.5, syntax: bool = True, maps: DataFrame | None = None, fetched: DataFrame | None = None, traces: DataFrame | None = None,
) -> DataFrame:
    """All findings of all stages with their places in the order of discovery: a union of independent scans."""
    parts = [scan_rules(sources, rules), scan_entropy(sources, entropy_threshold), scan_routes(sources), scan_libraries(sources)]
    if syntax:
        parts.append(scan_syntax(sources))
    if maps is not None:
        parts.append(map_paths(maps))
    if fetched is not None:
        parts.append(fetched_chunks(chunk_candidates(sources), fetched))
    if traces is not None:
        parts.append(trace_findings(traces))
    return reduce(DataFrame.unionByName, parts)


def findings(raw: DataFrame) -> DataFrame:
    """First-wins de-duplication with the rules for routes and secrets.

    raw is worked out once: what its de-duplication leaves is written, and the
    rules join that table with itself. The rules only look at first findings, so
    they give the same after de-duplication as before.
    """
    return drop_known_secrets(drop_known_routes(stored(dedupe(raw))))


def analyze(sources: DataFrame, target: str | None = None, **options) -> DataFrame:
    """A whole analysis: maps opened, all findings, and the hosts behind them (category subdomains).

    target: the domain whose hosts are subdomains. options as those of findings_raw() but maps.
    """
    code, maps = expand_maps(sources)
    found = findings(findings_raw(code, maps=maps, **options))
    hosts = harvest_hosts(found, target).withColumns({"file_ord": F.lit(0).cast("long"), "stage_ord": F.lit(8), "rule_ord": F.lit(0), "match_ord": F.lit(0)})
    return found.unionByName(conform(hosts))


def fingerprints(sources: DataFrame) -> DataFrame:
    """What an analysis says of its framework and bundler, for every file of code and every original in a map."""
    return fingerprint(expand_maps(sources)[0])
