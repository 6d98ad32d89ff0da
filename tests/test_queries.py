"""Every base query against its SQL, and what has no SQL against hand-made expectations."""

import pytest

from quarrylight import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_sql(name, same_as_duckdb):
    same_as_duckdb(q.QUERIES[name], q.ORACLE[name])


def test_full_analysis_keeps_each_key_once(spark, sf_dir):
    rows = q.QUERIES["full_analysis"](spark, sf_dir).collect()
    ast = lambda r: r.rule_id == "ast"
    keys = [(r.analysis_id, r.category, r.value, ast(r)) for r in rows]
    assert rows and len(set(keys)) == len(keys)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_base_does_not_import_training_operators():
    import pathlib
    import re

    root = pathlib.Path(q.__file__).parent
    used = [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
    assert used == []


NODE_LISTS = {
    0: "Program>-1 ExpressionStatement>0 CallExpression>1 MemberExpression>2 Identifier>3 Identifier>3 Literal>2",
    1: "Program>-1 ExpressionStatement>0 CallExpression>1 Identifier>2 TemplateLiteral>2 Identifier>4",
    2: "Program>-1 ExpressionStatement>0 AssignmentExpression>1 MemberExpression>2 Identifier>3 Identifier>3 Identifier>2 ExpressionStatement>0 CallExpression>7 Identifier>8 Identifier>8",
    3: "Program>-1 VariableDeclaration>0 VariableDeclarator>1 Identifier>2 Literal>2",
    4: "Program>-1 ExpressionStatement>0 CallExpression>1 Identifier>2 BinaryExpression>2 BinaryExpression>4 Literal>5 Identifier>5 Literal>4 ExpressionStatement>0 CallExpression>9 Identifier>10 Literal>10",
}


def test_nodes_of_all_code_forms(spark, sf_dir):
    """Every row of orders that is a program has the node list of its form; the sixth form is no program."""
    got = {}
    for r in q.QUERIES["ast_nodes"](spark, sf_dir).collect():
        got.setdefault(int(r.path), []).append((r.node_id, f"{r.type}>{r.parent_id}"))
    keys = [r.o_orderkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").collect()]
    assert {k % 6 for k in keys} == set(range(6))
    assert {k: " ".join(n for _, n in sorted(v)) for k, v in got.items()} == {k: NODE_LISTS[k % 6] for k in keys if k % 6 < 5}
