"""Hosts behind the URLs that were found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import host_of

# Hosts of content networks, placeholders and specifications.
NOISE_HOSTS = (
    "cdn.jsdelivr.net", "cdnjs.cloudflare.com", "unpkg.com", "fonts.googleapis.com", "fonts.gstatic.com", "ajax.googleapis.com",
    "www.googleapis.com", "www.google-analytics.com", "www.googletagmanager.com", "connect.facebook.net", "platform.twitter.com",
    "cdn.segment.com", "js.stripe.com", "cdn.shopify.com", "static.cloudflareinsights.com", "polyfill.io", "browser.sentry-cdn.com",
    "js.sentry-cdn.com", "code.jquery.com", "stackpath.bootstrapcdn.com", "maxcdn.bootstrapcdn.com", "use.fontawesome.com",
    "kit.fontawesome.com", "cdn.tailwindcss.com", "localhost", "127.0.0.1", "0.0.0.0", "example.com", "www.example.com", "schema.org",
    "www.w3.org", "w3.org", "json-schema.org",
)


def hosts_of_findings(findings: DataFrame) -> DataFrame:
    """analysis_id, host, source_file of absolute URLs, without noise."""
    urls = findings.filter(F.col("category").isin("full-urls", "endpoints", "dynamic") & F.col("value").startswith("http"))
    rows = urls.select("analysis_id", host_of(F.col("value")).alias("host"), "source_file")
    return rows.filter((F.col("host") != "") & ~F.col("host").isin(*NOISE_HOSTS) & ~F.col("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}\z"))


def normal_domain(target: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(target, r"^(?:https?://)?(?:www\.)?", ""), "/.*", ""))


def harvest_hosts(findings: DataFrame, target: Column | str | None = None) -> DataFrame:
    """One row for each host: type, severity, tags, its files; the target's subdomains first."""
    domain = normal_domain(F.lit(target) if isinstance(target, str) else target) if target is not None else F.lit(None).cast("string")
    host = F.col("host")
    grouped = hosts_of_findings(findings).groupBy("analysis_id", "host").agg(F.array_join(F.array_sort(F.collect_set("source_file")), ", ").alias("source_file"))
    sub = F.coalesce((host == domain) | host.endswith(F.concat(F.lit("."), domain)), F.lit(False))
    tags = F.array_compact(F.array(
        F.when(sub, "subdomain").otherwise("third-party"), F.when(host.rlike("api|admin|internal"), "interesting"), F.when(host.rlike("staging|dev|test"), "non-prod"),
    ))
    out = grouped.select(
        "analysis_id", F.lit("subdomains").alias("category"), host.alias("value"), F.when(sub, "Subdomain").otherwise("Third-Party Host").alias("type"), "source_file",
        F.when(sub, "medium").otherwise("info").alias("severity"), F.lit("high").alias("confidence"), F.lit("subdomain").alias("rule_id"), tags.alias("tags"), sub.alias("is_subdomain"),
    )
    return out


def sorted_hosts(hosts: DataFrame) -> DataFrame:
    return hosts.orderBy(F.desc("is_subdomain"), "value")


def resolve_hosts(hosts: DataFrame, dns: DataFrame) -> DataFrame:
    """hosts with ips and resolved, from landed answers dns(host, type, data); address records have type 1."""
    a = dns.filter("type = 1").groupBy("host").agg(F.array_sort(F.collect_set("data")).alias("ips"))
    joined = hosts.join(a, hosts["value"] == a["host"], "left").drop("host")
    return joined.withColumn("ips", F.coalesce("ips", F.array().cast("array<string>"))).withColumn("resolved", F.size("ips") > 0)
