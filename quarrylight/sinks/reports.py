"""Findings as JSON, CSV, an HTML report, a request collection and an API description."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import ORDER
from ..operators.rules import CATEGORIES, SEVERITIES
from ..operators.summary import category_counts, severity_counts

URL_CATEGORIES = ("full-urls", "endpoints", "routes")


def write_json(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").json(path)


def csv_rows(findings: DataFrame) -> DataFrame:
    """The columns of the CSV export."""
    flag = F.when(F.col("is_base64"), "Yes").otherwise("No")
    return findings.select(F.col("category").alias("Category"), F.col("type").alias("Type"), F.col("severity").alias("Severity"), F.col("value").alias("Value"), F.col("source_file").alias("Source File"), flag.alias("Base64"))


def write_csv(findings: DataFrame, path: str) -> None:
    """Every field quoted, quotes inside doubled."""
    csv_rows(findings).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def report_html(findings: DataFrame, title: str = "Scan report") -> str:
    """A page with totals, severities and a table for each category that has findings.

    Every finding is a row; they come to the driver one partition at a time.
    """
    counts = {r["category"]: r["n"] for r in category_counts(findings).collect()}
    severities = {r["severity"]: r["n"] for r in severity_counts(findings).collect()}
    safe = lambda v: html.escape(str(v if v is not None else ""), quote=True)
    parts = [f"<!doctype html><meta charset=utf-8><title>{safe(title)}</title><h1>{safe(title)}</h1><p>{sum(counts.values())} findings</p><ul>"]
    parts += [f"<li class={s}>{s}: {severities.get(s, 0)}</li>" for s in SEVERITIES]
    parts.append("</ul>")
    for category, label in CATEGORIES:
        if not counts.get(category):
            continue
        rows = findings.filter(F.col("category") == category).orderBy("analysis_id", *ORDER, "value")
        parts.append(f"<h2>{safe(label)} ({counts[category]})</h2><table><tr><th>Severity<th>Type<th>Value<th>File")
        parts += [f"<tr><td>{safe(r['severity'])}<td>{safe(r['type'])}<td>{safe(r['value'])}<td>{safe(r['source_file'])}" for r in rows.select("severity", "type", "value", "source_file").toLocalIterator()]
        parts.append("</table>")
    return "\n".join(parts)


def distinct_urls(findings: DataFrame, categories: tuple[str, ...] = URL_CATEGORIES) -> DataFrame:
    """analysis_id and each URL value once, in order of category and discovery."""
    rank = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    g = findings.filter(F.col("category").isin(*categories)).groupBy("analysis_id", F.col("value").alias("url"))
    return g.agg(F.min(F.struct(rank.alias("rank"), *ORDER)).alias("place"))


def postman_items(findings: DataFrame) -> DataFrame:
    """analysis_id, place, name, raw, path array: one request for each distinct URL."""
    full = F.col("url").startswith("http")
    return distinct_urls(findings).select(
        "analysis_id", "place", "url", F.concat(F.lit("GET "), "url").alias("name"), F.when(full, F.col("url")).otherwise(F.concat(F.lit("{{baseUrl}}"), "url")).alias("raw"),
        F.when(~full, F.filter(F.split("url", "/"), lambda p: p != "")).alias("path"),
    )


def postman(findings: DataFrame, base_url: str | None = None, name: str = "Scan") -> DataFrame:
    """analysis_id, collection: a v2.1 request collection as JSON."""
    url = F.struct("raw", F.when(F.col("path").isNotNull(), F.array(F.lit("{{baseUrl}}"))).alias("host"), "path")
    item = F.struct(F.col("name"), F.struct(F.lit("GET").alias("method"), url.alias("url"), F.array().cast("array<string>").alias("header")).alias("request"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("place", "url", item.alias("item")))), lambda x: x["item"])
    variable = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    info = F.struct(F.lit(name).alias("name"), F.lit("https://schema.getpostman.com/json/collection/v2.1.0/collection.json").alias("schema"))
    whole = F.struct(info.alias("info"), F.array(variable("baseUrl", base_url or "https://example.com"), variable("token", "")).alias("variable"), F.col("items").alias("item"))
    return postman_items(findings).groupBy("analysis_id").agg(items.alias("items")).select("analysis_id", F.to_json(whole).alias("collection"))


def openapi_paths(findings: DataFrame) -> DataFrame:
    """analysis_id, path, method, parameters: endpoints and routes that begin with a slash, :name as {name}."""
    path = F.regexp_replace("url", r":([a-zA-Z_][a-zA-Z0-9_]*)", r"{$1}")
    rows = distinct_urls(findings.filter(F.col("value").startswith("/")), ("endpoints", "routes")).select("analysis_id", path.alias("path")).distinct()
    return rows.select("analysis_id", "path", F.lit("get").alias("method"), F.regexp_extract_all("path", F.lit(r"\{([^}]+)\}"), F.lit(1)).alias("parameters"))


def openapi(findings: DataFrame, base_url: str = "https://example.com", title: str = "Discovered API") -> DataFrame:
    """analysis_id, document: an OpenAPI 3.0.3 description as JSON."""
    one = lambda p: F.struct(p.alias("name"), F.lit("path").alias("in"), F.lit(True).alias("required"), F.struct(F.lit("string").alias("type")).alias("schema"))
    parameters = F.when(F.size("parameters") > 0, F.transform("parameters", one))
    ok = F.create_map(F.lit("200"), F.struct(F.lit("OK").alias("description")))
    operation = F.struct(F.lit("Found by scanning").alias("summary"), parameters.alias("parameters"), ok.alias("responses"))
    origin: Column = F.coalesce(F.nullif(F.regexp_extract(F.lit(base_url), r"^([a-zA-Z]+://[^/?#]+)", 1), F.lit("")), F.lit(base_url))
    paths = openapi_paths(findings).groupBy("analysis_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("path"), F.create_map("method", F.to_json(operation)).alias("operations"))), lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))).alias("paths"))
    typed = F.transform_values("paths", lambda _, v: F.transform_values(v, lambda _k, o: F.from_json(o, "struct<summary:string,parameters:array<struct<name:string,`in`:string,required:boolean,schema:struct<type:string>>>,responses:map<string,struct<description:string>>>")))
    whole = F.struct(
        F.lit("3.0.3").alias("openapi"), F.struct(F.lit(title).alias("title"), F.lit("1.0.0").alias("version")).alias("info"), F.array(F.struct(origin.alias("url"))).alias("servers"), typed.alias("paths"),
    )
    return paths.select("analysis_id", F.to_json(whole).alias("document"))
