"""The multi-rule scan: one pass over the contents, one explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_value, is_base64, spark_pattern
from .rules import EXPLOITS, RULES, URL_NOISE, Rule

#: Columns of findings, in order.
NAMES = ["analysis_id", "category", "value", "type", "source_file", "severity", "confidence", "rule_id", "is_base64", "line", "exploit_key", "exploit", "library", "tags", "file_ord", "stage_ord", "rule_ord", "match_ord", "dedup_key"]
TYPES = {"line": "int", "exploit_key": "string", "exploit": "struct<risk:string,description:string,exploit:string,mitigation:string>", "library": "struct<name:string,version:string,advisory_id:string,fixed:string,is_eol:boolean,refs:array<string>>", "tags": "array<string>"}


def conform(df: DataFrame) -> DataFrame:
    """All finding columns in order; those that a stage doesn't set are null."""
    have = set(df.columns)
    value = lambda c: F.col(c) if c in have else F.lit(False) if c == "is_base64" else F.col("value") if c == "dedup_key" else F.lit(None).cast(TYPES[c])
    return df.select(*[value(c).alias(c) for c in NAMES])


def sources_of(df: DataFrame, path: Column, content: Column, analysis: Column | None = None, order: Column | None = None, base_url: Column | None = None) -> DataFrame:
    """sources(analysis_id, file_ord, path, base_url, content); by default each row is an analysis of its own."""
    return df.select(
        (analysis if analysis is not None else path).cast("string").alias("analysis_id"), (order if order is not None else F.lit(0)).cast("long").alias("file_ord"),
        path.cast("string").alias("path"), (base_url if base_url is not None else F.lit(None)).cast("string").alias("base_url"), content.alias("content"),
    )


#: Signs of a pattern whose match depends on what stands around it.
LOOKS_AROUND = ("<b>", "<z>", "(?=", "(?!", "(?<", "(^", ":^", "|^")


def matches(content: Column, lower: Column, rule: Rule, order: int) -> Column:
    """array<struct<rule_ord, match_ord, value>> of a rule; a text that lacks every needed part isn't searched."""
    pattern = ("(?i)" if rule.ignore_case else "") + spark_pattern(rule.pattern)
    every = [F.regexp_extract_all(content, F.lit(pattern), F.lit(0))]
    if not any(x in rule.pattern for x in LOOKS_AROUND):  # a match by itself matches as it did in its text
        group = lambda v, i, g: F.regexp_extract(v, pattern, g)
    else:
        inner = {g: F.regexp_extract_all(content, F.lit(pattern), F.lit(g)) for g in rule.groups}
        group = lambda v, i, g: F.get(inner[g], i)
    value = lambda v, i: F.coalesce(*[F.nullif(group(v, i, g), F.lit("")) for g in rule.groups], v)
    found = F.transform(every[0], lambda v, i: F.struct(F.lit(order).alias("rule_ord"), i.alias("match_ord"), (value(v, i) if rule.groups else v).alias("value")))
    if not rule.need:
        return found
    text = lower if rule.ignore_case else content
    there = F.contains(text, F.lit(rule.need[0]))
    for n in rule.need[1:]:
        there = there | F.contains(text, F.lit(n))
    return F.when(there, found).otherwise(F.array().cast("array<struct<rule_ord:int,match_ord:int,value:string>>"))


def is_noise(v: Column) -> Column:
    """True for URL and endpoint values that are build artefacts, assets or inline data."""
    out = F.lit(False)
    for p, ignore_case in URL_NOISE:
        out = out | v.rlike(("(?i)" if ignore_case else "") + spark_pattern(p))
    return out


def exploit_of(key: Column) -> Column:
    """The note on a risky call, by key without dots; null if there is none. A constant map, no join."""
    pairs = [x for k, v in EXPLOITS.items() for x in (F.lit(k.replace(".", "")), F.struct(*[F.lit(t).alias(n) for n, t in zip(("risk", "description", "exploit", "mitigation"), v, strict=True)]))]
    return F.try_element_at(F.create_map(*pairs), F.replace(key, F.lit("."), F.lit("")))


def scan_rules(sources: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of stage 1, before de-duplication."""
    on = [(k, r) for k, r in enumerate(rules) if r.enabled]
    lowered = sources.select("analysis_id", "file_ord", "path", "content", F.lower("content").alias("_lower"))
    found = F.concat(*[matches(F.col("content"), F.col("_lower"), r, k) for k, r in on])
    rows = lowered.select("analysis_id", "file_ord", F.col("path").alias("source_file"), F.explode(found).alias("m"))
    rows = rows.select("analysis_id", "file_ord", "source_file", "m.rule_ord", "m.match_ord", clean_value(F.col("m.value")).alias("value")).filter(F.length("value") >= 4)
    const = lambda f: F.element_at(F.create_map(*[x for k, r in on for x in (F.lit(k), F.lit(f(r)))]), F.col("rule_ord"))
    rows = rows.withColumns({
        "rule_id": const(lambda r: r.id), "_label": const(lambda r: r.label), "_category": const(lambda r: r.category), "severity": const(lambda r: r.severity),
        "confidence": const(lambda r: r.confidence), "_exploit": const(lambda r: r.exploit), "_key": const(lambda r: r.exploit_key or ""),
    })
    url = F.col("_category") == "urls"
    rows = rows.filter(~url | ~is_noise(F.col("value")))
    full = F.col("value").rlike("(?i)^https?://")
    own_key = F.lower(F.regexp_replace("value", r"\s*\(\z", ""))
    secret = F.col("rule_id").contains("secret") | (F.col("_category") == "secrets")
    return conform(
        rows.withColumns({
            "category": F.when(url, F.when(full, "full-urls").otherwise("endpoints")).otherwise(F.col("_category")),
            "type": F.when(url, F.when(full, "Full URL").otherwise("Endpoint")).otherwise(F.col("_label")),
            "is_base64": secret & is_base64(F.col("value")),
            "exploit_key": F.when(F.col("_exploit"), F.coalesce(F.nullif("_key", F.lit("")), own_key)),
            "stage_ord": F.lit(1),
        }).withColumn("exploit", exploit_of(F.col("exploit_key")))
    )


def scan_entropy(sources: DataFrame, threshold: float = 4.5) -> DataFrame:
    """Findings of stage 2: quoted strings of 16 to 64 characters with more bits per character than threshold."""
    from ..functions.text import entropy

    every = F.regexp_extract_all("content", F.lit(r"""["']([a-zA-Z0-9\-_=]{16,64})["']"""), F.lit(1))
    rows = sources.select("analysis_id", "file_ord", F.col("path").alias("source_file"), F.posexplode(every).alias("match_ord", "value"))
    # n characters have log2(n) bits at most, so shorter ones need no count
    rows = rows.filter(F.log2(F.length("value")) > threshold).withColumn("bits", entropy(F.col("value"))).filter(F.col("bits") > threshold)
    return conform(
        rows.select(
            "*", F.lit("secrets").alias("category"), F.lit("High Entropy String").alias("type"), F.lit("medium").alias("severity"), F.lit("low").alias("confidence"),
            F.lit("entropy").alias("rule_id"), is_base64(F.col("value")).alias("is_base64"), F.lit(2).alias("stage_ord"), F.lit(0).alias("rule_ord"),
        )
    )
