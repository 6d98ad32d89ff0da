import pytest

from quarrylight.functions.jsparse import Unparseable, parse, text_of, walk
from quarrylight.operators.syntax import Taint, parsed, scan_syntax, syntax_rows

GOLDEN = [
    ("var q = location.hash; el.innerHTML = q;", [".innerHTML = ..."], ["location.hash → innerHTML"]),
    ("eval(location.search);", ["eval()"], ["location.search → eval()"]),
    ("document.writeln(document.cookie);", ["document.writeln()"], ["document.cookie → document.write()"]),
    ("x = eval(location.hash);", ["eval()"], []),
    ("var p = new URLSearchParams(location.search); el.innerHTML = p;", [".innerHTML = ..."], []),
    ("var h = location.hash.substring(1); el.innerHTML = h;", [".innerHTML = ..."], ["location.hash → innerHTML"]),
    ("var h = location.hash; var t = h.trim(); el.innerHTML = t;", [".innerHTML = ..."], []),
    ("el.outerHTML = `<b>${document.referrer}</b>`;", [".outerHTML = ..."], ["document.referrer → outerHTML"]),
    ('var u = "a" + window.name; fetch(u);', [], ["window.name → fetch()"]),
    ('el["innerHTML"] = location.hash;', [".innerHTML = ..."], []),
    ('q = location.hash; q = "safe"; eval(q);', ["eval()"], ["location.hash → eval()"]),
    ('const api_token = "abcd" + "efgh";', ['api_token = "abcdefgh"'], []),
    ("fetch(`/api/${id}/x`);", ["/api/*/x"], []),
    ('map.get("abcd");', ["abcd"], []),
    ('new Function("return 1");', [], []),
]


@pytest.mark.parametrize("code,syntax,flows", GOLDEN)
def test_golden(code, syntax, flows):
    root, module = parsed(code)
    assert module and [f["value"] for f in syntax_rows(root)] == syntax and [f["value"] for f in Taint().run(root)] == flows


@pytest.mark.parametrize("code", [
    "a = b / c / d; x = /re[/]x/g.test(y); if (a) /x/.exec(b)", "class A extends B { #p = 1; static async *m(a, {b = 2, ...c} = {}, ...d) { yield* x } get z() { return this.#p } static {} }",
    "for (const [a, b] of Object.entries(x)) { continue } label: for (;;) { break label }", "const f = async (a, b) => { await a; return ({c: 1}).c }; (x => x * 2)(3); a?.b?.(c)?.[d]; x ??= 1; y = a ? b : c;",
    'import a, {b as c} from "m"; export default function () {} export const z = 1; import("x"); export * from "y"', "switch (a) { case 1: b(); break; default: c() } try {} catch {} finally {} do x++; while (x < 3)",
    "var {a, b: {c}, ...r} = o; [x, y] = [y, x]; ({a} = b)", "a\n++b\nreturn", "`a${`b${c}`}d`", "x = {get a() { return 1 }, async b() {}, *c() {}, [d]: 1, get: 2, 'e': 3, 4: 5, f}",
    "let async_ = 3; of = 2; async = 3; get = 4; async(x)", "a => {}\n/x/.test(b)", "x = a ** -b", "#!/bin/x\nvar a", "if (a) b; else c", "x = y\n(z)", "a = b ? (c, d) : e => f", "new a.b.C(1).d()", "/* c */ // d\n",
])
def test_programs_parse(code):
    parse(code)


@pytest.mark.parametrize("code", ["var f = function ( {", "Le la de eux", "var a = 1 var b", "<html>", "a + = b", "f(", "1 = 2", "'open", "`open", "const x;", "if a b", "x = {a b}", "}"])
def test_what_is_no_program(code):
    with pytest.raises(Unparseable):
        parse(code)


def test_with_statements_have_no_flows():
    root, module = parsed("with (a) { eval(location.hash) }")
    assert root is not None and not module


def test_lines_and_long_sums():
    root, _ = parse("\n\nfoo(\n`a\nb`)\nbar()")
    assert [n.line for n, _, _ in walk(root) if n.type == "CallExpression"] == [3, 6]
    root, _ = parse("x = " + " + ".join(['"ab"'] * 3000))
    assert len(text_of(root.kids[0][1].kid("expression").kid("right"))) == 6000


def test_deep_nesting_does_not_break_a_batch(spark):
    rows = [("a", 0, "x", None, "(" * 20_000), ("b", 0, "y", None, "eval(z)"), ("c", 0, "z", None, None), ("d", 0, "w", None, "")]
    df = spark.createDataFrame(rows, "analysis_id string, file_ord int, path string, base_url string, content string")
    assert [r.analysis_id for r in scan_syntax(df).collect()] == ["b"]


def test_secrets_seen_before_are_not_repeated(spark):
    from quarrylight.plans.analyze import findings, findings_raw

    rows = [("a", 0, "x", None, 'const my_token = "abcdefghijkl";'), ("b", 0, "x", None, 'const my_auth = "abc" + "defghijkl"; let his_auth = `abcdefghijkl`;')]
    df = spark.createDataFrame(rows, "analysis_id string, file_ord int, path string, base_url string, content string")
    got = sorted((r.analysis_id, r.rule_id) for r in findings(findings_raw(df)).filter("category = 'secrets'").collect())
    assert got == [("a", "generic-secret"), ("b", "ast")]


def test_sums_alone_are_parsed(spark):
    rows = [("a", 0, "x", None, '"a/" + "b.chunk.js";'), ("b", 0, "x", None, "'a.bun' + 'dle.js'"), ("c", 0, "x", None, '"a.chunk.js"')]
    df = spark.createDataFrame(rows, "analysis_id string, file_ord int, path string, base_url string, content string")
    assert sorted((r.analysis_id, r.value) for r in scan_syntax(df).collect()) == [("a", "a/b.chunk.js"), ("b", "a.bundle.js")]
