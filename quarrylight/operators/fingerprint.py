"""Framework and bundler of each content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks of frameworks and bundlers, in order of declaration.
FRAMEWORKS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("React", (r"React\.createElement", r"ReactDOM\.render", r"jsx\(", r"_jsx\(", "react-dom", "__REACT_DEVTOOLS")),
    ("Vue", (r"Vue\.component", r"new Vue\(", r"createApp\(", "__vue__", "v-bind:|v-model")),
    ("Angular", ("@angular/core", "ng-version", "NgModule", "platformBrowserDynamic")),
    ("Svelte", ("svelte/internal", "SvelteComponent", "create_fragment")),
    ("Next", ("__NEXT_DATA__", "next/router", "next/link", "_next/static")),
    ("Nuxt", ("__NUXT__", r"nuxt\.config", "NuxtChild")),
    ("Ember", (r"Ember\.Application", r"Ember\.Route", "ember-cli")),
    ("jQuery", (r"jQuery\s+v|\.fn\.jquery",)),
)
BUNDLERS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Webpack", ("__webpack_require__", "webpackJsonp", "webpackChunk", "__webpack_modules__")),
    ("Vite", ("@vite/client", r"import\.meta\.hot", "/@fs/")),
    ("Parcel", ("parcelRequire", "__parcel__")),
    ("Rollup", (r"\(function\s*\(\)\s*\{\s*'use strict'",)),
    ("esbuild", (r"__esm\(", r"__toESM\(", r"__commonJS\(")),
)


def fingerprint(sources: DataFrame) -> DataFrame:
    """analysis_id, path, framework (most marks, then first declared; null without any), marks, bundler, badge."""
    content = F.col("content")
    hits = lambda marks: sum((content.rlike(m).cast("int") for m in marks), F.lit(0))
    scored = F.array(*[F.struct(hits(m).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, m) in enumerate(FRAMEWORKS)])
    best = sources.select("analysis_id", "path", F.array_max(scored).alias("b"), F.coalesce(*[F.when(content.rlike("|".join(m)), name) for name, m in BUNDLERS]).alias("bundler"))
    found = F.col("b.n") > 0
    out = best.select("analysis_id", "path", F.when(found, F.col("b.name")).alias("framework"), F.when(found, F.col("b.n")).otherwise(0).alias("marks"), "bundler")
    return out.withColumn("badge", F.concat_ws(" / ", "framework", "bundler"))
