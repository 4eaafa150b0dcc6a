import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NAMES = ["topic_study_summary", "crosswalk_status", "review_gate", "coverage_sets", "source_mapping_topk", "normal_forms", "resolve_topic_unique", "p1_found", "p4_found", "progress_state", "manifest_one_to_one", "p1_places", "p4_composite", "claim_gate", "release_gate", "question_items", "topic_pages", "excerpt_windows", "extractive_answers", "topics_in_order"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_is_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(cell, r)) for r in df.select(*columns).collect())
    theirs = duck.sql(entry.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    order = [theirs.columns.index(c) for c in columns]
    assert mine == sorted(tuple(cell(r[i]) for i in order) for r in theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_uses_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/kavak/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "kavak.llm" not in open(path, encoding="utf-8").read(), path
