"""Ranking findings, asking a callback about the foremost, and joining its answers back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import ORDER
from .summary import severity_rank

ITEM = "id string, type string, severity string, confidence string, value string, source_file string, batch int"
ANSWER = "id string, severity string, reasoning string, suggested_test string, seq long"


def foremost(findings: DataFrame, k: int = 15, batch: int = 2, chars: int = 120) -> DataFrame:
    """The k gravest findings, numbered finding-1 .. finding-k, in batches; values are shortened."""
    keys = (severity_rank(F.col("severity")), "analysis_id", *ORDER, "category", "value")
    top = findings.orderBy(*keys).limit(k)  # plans as TakeOrderedAndProject
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))  # over k rows
    return top.withColumn("n", n).select(
        F.concat(F.lit("finding-"), F.col("n").cast("string")).alias("id"), "type", "severity", "confidence", F.substring("value", 1, chars).alias("value"), "source_file",
        F.floor((F.col("n") - 1) / batch).cast("int").alias("batch"),
    )


def prompts(items: DataFrame) -> DataFrame:
    """batch, prompt: one line for each finding under the instructions."""
    line = F.format_string("- [%s] %s | severity: %s | confidence: %s | value: \"%s\" | file: %s", "id", "type", "severity", "confidence", "value", "source_file")
    head = (
        "Assess the security findings listed below. Answer with a JSON array only; each object has id, severity "
        "(critical, high, medium, low or info), reasoning (one or two sentences) and suggestedTest.\n\nFindings:\n"
    )
    lines = F.array_sort(F.collect_list(F.struct(F.length("id").alias("l"), "id", line.alias("line"))))
    return items.groupBy("batch").agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"))


def parse_answers(answers: DataFrame) -> DataFrame:
    """answers(batch, response) -> answer rows.

    Takes {"enrichments": [...]}, an array, an object with one array, a single
    object, each with or without a code fence, or else the first [...] in the text.
    """
    rows = "array<struct<id:string,severity:string,reasoning:string,suggestedTest:string>>"
    clean = F.regexp_replace(F.regexp_replace(F.trim("response"), r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", "")
    arr = lambda t: F.when(t.startswith("["), F.from_json(t, rows))
    inner = F.regexp_extract("clean", r"(?s)(\[.*\])", 1)
    single = F.from_json("clean", rows[6:-1])
    one = F.when(single["id"].isNotNull(), F.array(single))
    named = F.from_json("clean", f"struct<enrichments:{rows}>")["enrichments"]
    parsed = F.coalesce(named, arr(F.col("clean")), one, arr(inner))
    out = answers.withColumn("clean", clean).select("batch", F.posexplode(parsed).alias("i", "e"))
    return out.select(F.col("e.id").alias("id"), F.col("e.severity").alias("severity"), F.col("e.reasoning").alias("reasoning"), F.col("e.suggestedTest").alias("suggested_test"), (F.col("batch").cast("long") * 1_000_000 + F.col("i")).alias("seq"))


def ask(prompt_rows: DataFrame, callback: Callable[[str], str], retries: int = 3, wait: float = 2.0) -> DataFrame:
    """batch, response (null where the callback failed to the end). Waits double after connection errors."""

    def run(parts: Iterator):
        import time

        for pdf in parts:
            out = []
            for p in pdf["prompt"]:
                answer = None
                for k in range(retries + 1):
                    try:
                        answer = callback(p)
                        break
                    except (ConnectionError, TimeoutError):
                        if k < retries:
                            time.sleep(wait * 2**k)
                    except Exception:  # a failed batch is left out
                        break
                out.append(answer)
            yield pdf.assign(response=out)[["batch", "response"]]

    return prompt_rows.mapInPandas(run, "batch int, response string")


def join_answers(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items with ai_severity, ai_reasoning, ai_suggested_test; of several answers to an id the last holds."""
    last = answers.filter("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("severity", "reasoning", "suggested_test"), "seq").alias("a"))
    return items.join(last, "id", "left").select(*items.columns, F.col("a.severity").alias("ai_severity"), F.col("a.reasoning").alias("ai_reasoning"), F.col("a.suggested_test").alias("ai_suggested_test"))


def enrichment_counts(joined: DataFrame) -> DataFrame:
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("ai_severity").isNotNull()).alias("applied"))

