"""Every registered query of the core against its SQL, and the contract of the entry module."""

import ast
from pathlib import Path

import pytest

import __spark_entry__
from sql_compare import DATA, database, same
from tidemark.plans import connectors, general, general_sql, live, reference

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def con():
    return database()


QUERIES = {**reference.QUERIES, **connectors.REGISTRY.queries, **live.REGISTRY.queries, **general.QUERIES}
SQL = {**reference.SQL, **connectors.REGISTRY.sql, **live.REGISTRY.sql, **general_sql.SQL}


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, con, name):
    same(spark, con, QUERIES[name], SQL[name])


def test_entry_and_names(spark):
    if Path("/root/testdata/sf0.001").is_dir():
        assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert DATA


def test_only_the_entry_module_knows_the_llm_subpackage():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_hot_paths_stay_in_the_jvm(spark):
    if not Path(DATA).is_dir():
        pytest.skip("no test tables")
    for name in ("hop_sum_max_min_count", "hop_shared_panes", "pct_p50_p90_p99", "p4_found", "p6_found", "p2_windows"):
        plan = {**reference.QUERIES, **general.QUERIES}[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name
