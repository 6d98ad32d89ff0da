"""Client-side and server-side routes, with line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_value, spark_pattern
from .dedupe import first_wins
from .scan import conform

# Route patterns (the value is the first non-empty group) and what is no route.
KINDS: tuple[tuple[str, str, int], ...] = (
    ("React/Vue Route", r"""(?:<Route\s[^>]*path\s*=\s*\{?\s*["']([^"']+)["']|path\s*:\s*["'](/[a-zA-Z0-9\-_/:.*]+)["'])""", 2),
    ("Angular Route", r"""\{\s*path\s*:\s*["']([^"']+)["']\s*,\s*(?:component|loadChildren|redirectTo|canActivate)""", 1),
    ("Express Route", r"""(?:app|router|server)\s*\.\s*(?:get|post|put|delete|patch|all|use|route)\s*\(\s*["']([^"']+)["']""", 1),
    ("Next.js Route", r"""["'](/(?:api|pages)/[a-zA-Z0-9\-_/\[\].*]+)["']""", 1),
)
NOISE: tuple[tuple[str, bool], ...] = (
    (r"^(?:\.{1,2}/|data:|#|javascript:|mailto:|tel:)", False),
    (r"\.(?:ts|tsx|jsx|scss|sass|css|html|json|map|svg|less|pug|styl|png|jpe?g|gif|ico|webp|woff2?|ttf|eot|otf|mp[34]|wav|pdf)(?:[?#]|<z>)", True),
    (r"^/?<b>(?:src|dist|build|lib|node_modules|webpack|__webpack__|assets|img|images|fonts|styles|css|vendor)<b>", True),
    (r"^(?:true|false|null|undefined|\d+|function|return|const|var|let|if|else|none|auto|inherit|block|flex|inline|center|left|right|top|bottom)<z>", False),
    (r"^\d+px|^\d+%|^#[0-9a-f]+<z>", True),
)


def is_route_noise(v: Column) -> Column:
    out = F.length(v) < 2
    for p, ignore_case in NOISE:
        out = out | v.rlike(("(?i)" if ignore_case else "") + spark_pattern(p))
    return out


def running_sums(counts: Column, block: int = 64) -> Column:
    """Prefix sums of an array of ints: those of whole blocks, and inside a block the sum of its beginning."""
    add = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)
    n = F.size(counts)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: add(F.slice(counts, b * block + 1, block)))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))
    at = lambda i: F.floor(i / block).cast("int")
    sums = lambda base: F.transform(counts, lambda x, i: F.get(base, at(i)) + add(F.slice(counts, at(i) * block + 1, i % block + 1)))
    return F.get(F.transform(F.array(before), sums), F.lit(0))


def line_numbers(content: Column, pattern: str) -> Column:
    """array<int>: 1 + the line breaks before each match of pattern, without leaving the JVM.

    Splitting by the pattern gives the gaps, extracting gives the matches; line
    breaks are summed along both.
    """
    breaks = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    gaps = F.transform(F.split(content, pattern, -1), breaks)
    inner = F.transform(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), breaks)
    counts = F.zip_with(F.slice(gaps, F.lit(1), F.size(inner)), F.concat(F.array(F.lit(1)), F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0)))), lambda a, b: a + b)
    lines = F.get(F.transform(F.array(counts), lambda c: running_sums(c)), F.lit(0))
    return F.when(F.regexp_like(content, F.lit(pattern)), lines).otherwise(F.array().cast("array<int>"))


def scan_routes(sources: DataFrame) -> DataFrame:
    """Findings of stage 4: one for each (file, value), the earliest kind first; before routes known as endpoints go."""
    rows_of = "array<struct<rule_ord:int,match_ord:int,type:string,value:string,line:int>>"

    def found(k: int, label: str, pattern: str, groups: int) -> Column:
        p = "(?i)" + spark_pattern(pattern)
        every = [F.regexp_extract_all("content", F.lit(p), F.lit(g)) for g in range(1, groups + 1)]

        def row(line: Column, i: Column) -> Column:
            value = F.coalesce(*[F.nullif(F.get(g, i), F.lit("")) for g in every])
            return F.struct(F.lit(k).alias("rule_ord"), i.alias("match_ord"), F.lit(label).alias("type"), value.alias("value"), line.alias("line"))

        return F.when(F.col("content").rlike(p), F.transform(line_numbers(F.col("content"), p), row)).otherwise(F.array().cast(rows_of))

    parts = [found(k, *kind) for k, kind in enumerate(KINDS)]
    rows = sources.select("analysis_id", "file_ord", F.col("path").alias("source_file"), F.explode(F.concat(*parts)).alias("m")).select("*", "m.*").drop("m")
    rows = rows.withColumn("value", clean_value(F.col("value"))).filter("value IS NOT NULL").filter(~is_route_noise(F.col("value")))
    rows = rows.select("*", F.lit("routes").alias("category"), F.lit("info").alias("severity"), F.lit("medium").alias("confidence"), F.lit("route").alias("rule_id"), F.lit(4).alias("stage_ord"))
    return first_wins(conform(rows), "analysis_id", "file_ord", "source_file", "value")
