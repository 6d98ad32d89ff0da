"""Signatures of libraries, known hashes and advisories."""

from __future__ import annotations

from dataclasses import dataclass

V = r"([\d]+\.[\d]+\.[\d]+)"


@dataclass(frozen=True)
class Library:
    name: str
    content: tuple[str, ...]
    files: tuple[str, ...] = ()
    cdn: tuple[str, ...] = ()


def _file(name: str, end: str = r"(?:\.min)?", version: str = V) -> tuple[str, ...]:
    return (rf"{name}[.-]?{version}{end}\.js",)


def _banner(name: str) -> str:
    return rf"\*!\s*{name}\s+v?{V}"


# Names and signatures. Each content signature's first group is the version; case is ignored.
LIBRARIES: tuple[Library, ...] = (
    Library("jQuery", (rf"jQuery\s+(?:JavaScript\s+Library\s+)?v?{V}", rf"jquery[.\-]?{V}", _banner("jQuery"), rf"jquery(?:\.min)?\.js\s*[|/]\s*v?{V}"), _file("jquery", r"(?:\.min|\.slim)?"), (rf"/jquery(?:/|@){V}/",)),
    Library("Lodash", (rf"lodash\s+v?{V}", _banner("lodash"), rf"lodash[.\-]?{V}"), _file("lodash"), (rf"/lodash(?:\.js)?(?:/|@){V}/",)),
    Library("AngularJS", (r"AngularJS\s+v?(1\.[\d]+\.[\d]+)", r"angular[.\-]?(1\.[\d]+\.[\d]+)", r"\*!\s*angular\s+v?(1\.[\d]+\.[\d]+)"), _file("angular", version=r"(1\.[\d]+\.[\d]+)"), (r"/angular(?:\.js)?(?:/|@)(1\.[\d]+\.[\d]+)/",)),
    Library("React", (rf"react(?:\.production|\.development)?(?:\.min)?\.js[\s\S]*?v?{V}", rf"React\s+v?{V}", _banner("react"), rf"\"version\":\s*\"{V}\"[^}}]*?\"name\":\s*\"react\"", rf"\"name\":\s*\"react\"[^}}]*?\"version\":\s*\"{V}\""), _file("react", r"(?:\.production|\.development)?(?:\.min)?")),
    Library("Vue.js", (rf"Vue\.js\s+v?{V}", _banner("vue"), rf"vue(?:\.runtime)?(?:\.global|\.esm)?(?:\.prod)?(?:\.min)?\.js[\s\S]*?v?{V}"), _file("vue")),
    Library("Moment.js", (rf"moment(?:\.min)?\.js[\s\S]*?v?{V}", rf"\*!\s*moment\.js\s*[|\-]?\s*v?{V}", rf"moment\s+version\s+:?\s*{V}"), _file("moment")),
    Library("Handlebars", (rf"handlebars\s+v?{V}", _banner("handlebars")), _file("handlebars")),
    Library("Underscore.js", (rf"Underscore\.js\s+v?{V}", _banner("underscore")), _file("underscore")),
    Library("Bootstrap", (rf"Bootstrap\s+v?{V}", _banner("Bootstrap"), rf"bootstrap(?:\.min)?\.js\s*[|/]\s*v?{V}"), _file("bootstrap")),
    Library("DOMPurify", (rf"DOMPurify\s+v?{V}", _banner("DOMPurify"), rf"purify(?:\.min)?\.js[\s\S]*?v?{V}"), _file("(?:dompurify|purify)")),
    Library("Axios", (rf"axios\s+v?{V}", _banner("axios"), rf"\"name\":\s*\"axios\"[^}}]*?\"version\":\s*\"{V}\""), _file("axios")),
    Library("Socket.IO Client", (rf"socket\.io[- ]client\s+v?{V}", _banner(r"socket\.io-client"))),
    Library("Knockout", (rf"Knockout\s+JavaScript\s+library\s+v?{V}", rf"knockout[.\-]?{V}"), _file("knockout")),
    Library("Ember.js", (rf"Ember\s+v?{V}", _banner(r"ember\.js")), _file("ember")),
    Library("D3.js", (rf"d3\s+v?{V}", _banner("d3"), rf"d3\.js\s*[,-]\s*v?{V}"), _file("d3"), (rf"/d3(?:\.js)?(?:/|@){V}/",)),
    Library("Marked", (rf"marked\s+v?{V}", rf"\*!\s*marked\s*[-–]\s*v?{V}", rf"marked(?:\.min)?\.js[\s\S]*?v?{V}"), _file("marked")),
    Library("Highlight.js", (rf"highlight\.js\s+v?{V}", _banner(r"highlight\.js"), rf"hljs[\s\S]*?v?{V}"), _file("highlight")),
    Library("TinyMCE", (rf"tinymce\s+v?{V}", _banner("tinymce")), _file("tinymce")),
    Library("CKEditor", (rf"CKEditor\s+v?{V}", _banner("CKEditor"), rf"CKEDITOR\.version\s*=\s*['\"]{V}['\"]"), _file("ckeditor")),
    Library("Prototype.js", (rf"Prototype\s+JavaScript\s+framework,\s+version\s+{V}", rf"Prototype\s+v?{V}"), _file("prototype")),
    Library("Backbone.js", (rf"Backbone\.js\s+v?{V}", _banner(r"Backbone\.js")), _file("backbone")),
    Library("EJS", (rf"EJS\s+v?{V}", _banner("ejs"), rf"ejs(?:\.min)?\.js[\s\S]*?v?{V}"), _file("ejs")),
    Library("Dojo", (r"dojo\.version\s*=\s*\{[^}]*major:\s*(\d+),\s*minor:\s*(\d+),\s*patch:\s*(\d+)", rf"Dojo\s+v?{V}"), _file("dojo")),
    Library("Chart.js", (rf"Chart\.js\s+v?{V}", _banner(r"Chart\.js"), rf"chart(?:\.min)?\.js[\s\S]*?v?{V}"), _file("chart")),
    Library("YUI", (rf"YUI\s+v?{V}", rf"YUI\.version\s*=\s*['\"]{V}['\"]"), _file("yui")),
)

# SHA-256 of published files.
HASHES = {
    "sha256-FgpCb/KJQlLNfOu91ta32o/NMZxltwRo8QtmkMRdAu8=": ("jQuery", "3.3.1"),
    "sha256-/xUj+3OJU5yExlq6GSYGSHk7tPXikynS7ogEvDej/m4=": ("jQuery", "3.6.0"),
}

# Library, advisory, severity, first and last affected version, fixed version (None: none).
ADVISORIES: tuple[tuple[str, str, str, str, str, str | None], ...] = (
    ("jQuery", "CVE-2020-11022", "medium", "1.2.0", "3.4.9", "3.5.0"),
    ("jQuery", "CVE-2020-11023", "medium", "1.0.3", "3.4.9", "3.5.0"),
    ("jQuery", "CVE-2019-11358", "medium", "1.0.0", "3.3.9", "3.4.0"),
    ("jQuery", "CVE-2015-9251", "medium", "1.0.0", "2.9.9", "3.0.0"),
    ("Lodash", "CVE-2021-23337", "high", "0.0.1", "4.17.20", "4.17.21"),
    ("Lodash", "CVE-2020-28500", "medium", "0.0.1", "4.17.20", "4.17.21"),
    ("Lodash", "CVE-2020-8203", "high", "0.0.1", "4.17.18", "4.17.19"),
    ("Lodash", "CVE-2019-10744", "critical", "0.0.1", "4.17.11", "4.17.12"),
    ("AngularJS", "CVE-2022-25869", "medium", "1.0.0", "1.8.3", None),
    ("AngularJS", "CVE-2020-7676", "medium", "1.0.0", "1.7.9", "1.8.0"),
    ("React", "CVE-2018-6341", "medium", "16.0.0", "16.4.1", "16.4.2"),
    ("Vue.js", "CVE-2024-6783", "medium", "3.0.0", "3.4.37", "3.4.38"),
    ("Vue.js", "CVE-2024-6783-v2", "medium", "2.0.0", "2.7.16", None),
    ("Moment.js", "CVE-2022-31129", "high", "2.0.0", "2.29.3", "2.29.4"),
    ("Moment.js", "CVE-2022-24785", "high", "2.0.0", "2.29.1", "2.29.2"),
    ("Handlebars", "CVE-2021-23369", "critical", "0.0.1", "4.7.6", "4.7.7"),
    ("Handlebars", "CVE-2019-19919", "critical", "0.0.1", "4.3.0", "4.3.1"),
    ("Underscore.js", "CVE-2021-23358", "high", "0.0.1", "1.13.0", "1.13.1"),
    ("Bootstrap", "CVE-2019-8331", "medium", "3.0.0", "4.3.0", "4.3.1"),
    ("Bootstrap", "CVE-2018-14040", "medium", "3.0.0", "4.1.1", "4.1.2"),
    ("DOMPurify", "CVE-2024-47875", "critical", "0.0.1", "3.1.2", "3.1.3"),
    ("Axios", "CVE-2023-45857", "high", "0.8.1", "1.6.1", "1.6.2"),
    ("Socket.IO Client", "CVE-2024-38355", "high", "0.0.1", "4.7.4", "4.7.5"),
    ("Knockout", "CVE-2019-14862", "medium", "0.0.1", "3.5.0", "3.5.1"),
    ("Ember.js", "CVE-2021-4142", "medium", "3.0.0", "3.28.11", "3.28.12"),
    ("D3.js", "CVE-2020-36401", "medium", "3.0.0", "5.16.0", "6.0.0"),
    ("Marked", "CVE-2022-21680", "high", "0.0.1", "4.0.9", "4.0.10"),
    ("Marked", "CVE-2022-21681", "high", "0.0.1", "4.0.9", "4.0.10"),
    ("Highlight.js", "CVE-2021-32760", "medium", "9.0.0", "10.4.0", "10.4.1"),
    ("TinyMCE", "CVE-2024-29203", "medium", "6.0.0", "6.8.0", "6.8.1"),
    ("TinyMCE", "CVE-2022-23494", "medium", "5.0.0", "5.10.8", "5.10.9"),
    ("CKEditor", "CVE-2024-24816", "medium", "4.0.0", "4.24.0", "4.25.0"),
    ("CKEditor", "CVE-2021-33829", "medium", "4.0.0", "4.16.1", "4.16.2"),
    ("Prototype.js", "CVE-2020-27511", "high", "1.0.0", "1.7.3", None),
    ("Backbone.js", "CVE-2016-9917", "medium", "0.0.1", "1.2.3", "1.3.0"),
    ("EJS", "CVE-2022-29078", "critical", "0.0.1", "3.1.6", "3.1.7"),
    ("Dojo", "CVE-2020-5258", "high", "1.0.0", "1.16.3", "1.16.4"),
    ("Chart.js", "CVE-2020-36049", "medium", "2.0.0", "2.9.3", "2.9.4"),
    ("YUI", "CVE-2013-4942", "medium", "3.0.0", "3.17.2", None),
)
