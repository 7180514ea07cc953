"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans import path_queries, table_queries

SQL = path_queries.ORACLES | table_queries.ORACLES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    expected = duck.sql(SQL[name])
    assert sorted(expected.columns) == columns
    key = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=repr)
    assert key(df.select([f"`{c}`" for c in columns]).collect()) == key(expected.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(3).count() == 3


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_items_are_parsed_once(spark):
    """The branches of a validation read one table of items; none parses the replies again."""
    from factloom.operators import qa as Q

    items = Q.parse_items(spark.createDataFrame([(1, '{"question": "Who is it?"}')], "attempt long, reply_json string"))
    attempts = spark.createDataFrame([(1, "cot", True, ["e"], ["n"])], "attempt long, question_type string, truth boolean, sub_edges array<string>, sub_nodes array<string>")
    nodes = spark.createDataFrame([], "id string, name string, type string, aliases array<string>, attributes map<string,struct<value:string>>")
    got = Q.validate(items, attempts, nodes, spark.createDataFrame([], "id string, source string, target string, type string"))
    assert "parsed(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["reason"] for r in got.collect()] == ["missing explanation"]


def test_nodes_are_looked_up_once_and_shuffles_end_with_their_stage(spark, monkeypatch):
    """All rules on nodes read one lookup of ids, which carries no text, and what a stage has shuffled goes when it is stored."""
    from factloom.operators import qa as Q
    from factloom.sources import stages

    kind = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen, plain = {}, stages.stored
    before = spark.conf.get(kind, None)
    monkeypatch.setattr(Q, "stored", lambda df, name: (seen.__setitem__(name, (df.columns, df._jdf.queryExecution().optimizedPlan().toString())), plain(df, name))[1])
    nodes = spark.createDataFrame([("n1", "Alpha", "T", ["Aleph"], {}), ("n2", None, "T", None, {}), ("n3", "Gamma", "U", None, {"k": ("7 km", 1.0, "c")})], "id string, name string, type string, aliases array<string>, attributes map<string,struct<value:string,confidence:double,chunk_id:string>>")
    edges = spark.createDataFrame([("e1", "n1", "n3", "K")], "id string, source string, target string, type string")
    attempts = spark.createDataFrame([(k, "fill_blank", True, ["e1"], ["n1", "n2", "n3"]) for k in range(5)], "attempt long, question_type string, truth boolean, sub_edges array<string>, sub_nodes array<string>")
    reply = lambda answer, refs, ids: '{"question": "What is the aleph of ____ made?", "answer": "%s", "explanation": "So.", "supporting_facts": ["e1"], "referenced_entities": %s, "answer_entities": %s}' % (answer, refs, ids)  # noqa: E731, UP031
    replies = [(0, reply("7 km", '["n1"]', '["n3"]')), (1, reply("gamma", '["n1", "n2"]', '["n3"]')), (2, reply("delta", '["n1"]', '["n2", "n3"]')), (3, reply("gamma", '["n1", "gone"]', '["n3"]')), (4, reply("alpha", '["n2"]', '["n1"]'))]
    got = Q.validate(Q.parse_items(spark.createDataFrame(replies, "attempt long, reply_json string")), attempts, nodes, edges)
    assert {r["attempt"]: r["reason"] for r in got.collect()} == {0: "ok", 1: "ok", 2: "fill answer absent from graph", 3: "unknown referenced entity", 4: "referenced entity not present in text"}
    columns, plan = seen["posed-nodes"]
    assert columns == ["attempt", "found"] and "question#" not in plan.split("Relation")[0] and spark.conf.get(kind, None) == before
