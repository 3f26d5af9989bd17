"""The registered queries against their check SQL, and the shape of their plans."""

import os
import re

import pytest

import __spark_entry__ as entry
from tools.check import rows_of
from tradebook.plans import catalog
from tradebook.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_every_query_is_well_named():
    for name in catalog.QUERIES:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name) and "pipeline" not in name and not re.match(r"op\d*_", name)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_query_matches_check(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).columns == ["state", "count"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_plans_keep_keys_apart(spark):
    """No window over a bare key, no nested loop, no single-partition exchange on big inputs."""
    for name in ["node_uptime", "consecutive_errors", "cache_lookup", "match_pattern", "limit_rate", "name_mentions", "top_results"]:
        text = plan(entry.queries()[name](spark, SF))
        assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text, name
        assert "Exchange SinglePartition" not in text, name


@needs_data
def test_pruning_and_early_limits(spark):
    text = plan(entry.queries()["is_valid_url"](spark, SF))
    assert "html" not in text
    assert "WindowGroupLimit" in plan(entry.queries()["dedup_businesses"](spark, SF))
    assert "TakeOrderedAndProject" in plan(entry.queries()["search_businesses"](spark, SF))
    scans = re.findall(r"ReadSchema: (\S+)", plan(entry.queries()["events_by_type"](spark, SF)))
    assert scans == ["struct<event_type:string>"]
