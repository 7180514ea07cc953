"""Graphs as tables: JSON, deltas, catalogue and versions, migration, and export of training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from factloom.functions.ontology import ENTITY_TYPES, RELATIONS
from factloom.functions.text import leaks

#: The relation type of graphs that were written before relations had types of their own.
LEGACY_TYPE = "LEGACY_RELATION"
NODE_COLUMNS = "id string, name string, type string, aliases array<string>, attributes map<string,struct<value:string,confidence:double,chunk_id:string>>, confidence double, chunks array<string>"
EDGE_COLUMNS = "id string, source string, target string, type string, confidence double, evidence array<struct<text:string,chunk_id:string>>, derived_from_attribute boolean"


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON file {nodes, edges}."""
    raw = spark.read.schema(f"nodes array<struct<{NODE_COLUMNS}>>, edges array<struct<{EDGE_COLUMNS}>>").json(path, multiLine=True)
    return raw.select(F.inline("nodes")), raw.select(F.inline("edges"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as JSON Lines in the folders nodes and edges below path: no task sees the whole graph."""
    for name, rows in (("nodes", nodes), ("edges", edges)):
        rows.write.option("ignoreNullFields", "false").json(f"{path.rstrip('/')}/{name}")


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that write_graph_json() wrote."""
    return tuple(spark.read.schema(schema).json(f"{path.rstrip('/')}/{name}") for name, schema in (("nodes", NODE_COLUMNS), ("edges", EDGE_COLUMNS)))


def read_extractions(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, entities, relations of a JSON array of validated extractions."""
    entity = "struct<name:string,type:string,aliases:array<string>,attributes:map<string,string>,confidence:double,chunk_id:string>"
    relation = "struct<source:string,target:string,type:string,confidence:double,evidence:string,chunk_id:string>"
    return spark.read.schema(f"chunk_id string, entities array<{entity}>, relations array<{relation}>").json(path, multiLine=True)


def changed(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    """Rows of current that previous lacks or has otherwise."""
    maps = {f.name for f in current.schema if isinstance(f.dataType, MapType)}
    own = [c for c in current.columns if c != key]
    # each row is shuffled once, as it is; maps have no equality: their sorted entries have
    same = lambda c: F.array_sort(F.map_entries(c)) if c in maps or c.removeprefix("__old_") in maps else F.col(c)
    old = previous.select(key, F.lit(True).alias("__there"), *[F.col(c).alias(f"__old_{c}") for c in own])
    unchanged = F.col("__there").isNotNull()
    for c in own:
        unchanged = unchanged & same(c).eqNullSafe(same(f"__old_{c}"))
    return current.join(old, key, "left").where(~unchanged).select(current.columns)


def upsert(stored_rows: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """stored_rows with rows in the place of those of equal keys."""
    return stored_rows.join(rows.select(key), key, "left_anti").unionByName(rows)


def save_counts(nodes: DataFrame, edges: DataFrame, old_nodes: DataFrame, old_edges: DataFrame) -> DataFrame:
    """One row: changed_nodes, changed_edges, node_count, edge_count."""
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("__k", F.lit(1))
    out = one(changed(nodes, old_nodes), "changed_nodes")
    for df, name in ((changed(edges, old_edges), "changed_edges"), (nodes, "node_count"), (edges, "edge_count")):
        out = out.join(one(df, name), "__k")
    return out.drop("__k")


def load(nodes: DataFrame, edges: DataFrame, graph_id: str, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of one graph; edges of the ontology's kinds (and of the legacy type) only."""
    kinds = [*(kinds or RELATIONS), LEGACY_TYPE]
    mine = F.col("graph_id") == graph_id
    return nodes.where(mine), edges.where(mine & F.col("rel_type").isin(kinds))


def catalogue(graphs: DataFrame) -> DataFrame:
    """Graphs, the last updated first."""
    return graphs.orderBy(F.desc("updated_at"), "id")


def create(graphs: DataFrame, graph_id: str, name: str, now: str) -> DataFrame:
    """graphs (id, name, version, node_count, edge_count, created_at, updated_at) with a new, empty one at version 0; raises if the id is taken."""
    if not graphs.where(F.col("id") == graph_id).isEmpty():
        raise ValueError(f"there is a graph {graph_id} already")
    new = {"id": graph_id, "name": name, "version": 0, "node_count": 0, "edge_count": 0, "created_at": now, "updated_at": now}
    row = graphs.sparkSession.range(1).select(*[F.lit(new.get(f.name)).cast(f.dataType).alias(f.name) for f in graphs.schema])
    return graphs.unionByName(row)


def get(graphs: DataFrame, graph_id: str) -> dict:
    """A graph's row; raises if there is none."""
    row = graphs.where(F.col("id") == graph_id).first()
    if row is None:
        raise KeyError(f"no graph {graph_id}")
    return row.asDict()


def commit_version(graphs: DataFrame, graph_id: str, expected: int, node_count: int, edge_count: int, now: str) -> DataFrame:
    """graphs with the new version of one of them; raises if it is not at the expected version.

    On plain files the check and the write are two steps: a table format with transactions makes them one.
    """
    row = graphs.where(F.col("id") == graph_id).select("version").first()
    if row is None or row[0] != expected:
        raise RuntimeError("the graph was changed by another writer; load it again")
    mine = F.col("id") == graph_id
    new = {"version": F.lit(expected + 1), "node_count": F.lit(node_count), "edge_count": F.lit(edge_count), "updated_at": F.lit(now)}
    return graphs.withColumns({c: F.when(mine, v).otherwise(F.col(c)).cast(graphs.schema[c].dataType) for c, v in new.items()})


def migrate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes labelled with their type, edges of the legacy type as their own, and (tagged_nodes, converted_relations); doing it again changes nothing."""
    lacks = F.col("type").isin(ENTITY_TYPES) & ~F.array_contains("labels", F.col("type"))
    legacy = (F.col("rel_type") == LEGACY_TYPE) & F.col("type").isin(list(RELATIONS))
    counts = nodes.agg(F.count_if(lacks).alias("tagged_nodes")).withColumn("k", F.lit(1)).join(edges.agg(F.count_if(legacy).alias("converted_relations")).withColumn("k", F.lit(1)), "k").drop("k")
    tagged = nodes.withColumn("labels", F.when(lacks, F.array_union("labels", F.array("type"))).otherwise(F.col("labels")))
    return tagged, edges.withColumn("rel_type", F.when(legacy, F.col("type")).otherwise(F.col("rel_type"))), counts


def training_records(items: DataFrame, fmt: str = "alpaca") -> DataFrame:
    """Records of items (question, options, answer_text, answer_labels, explanation) in one of three formats."""
    listed = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit(". "), o["text"])), "\n")
    asked = F.when(F.size(F.coalesce("options", F.array())) > 0, F.concat("question", F.lit("\n"), listed)).otherwise(F.col("question"))
    answer = F.coalesce(F.array_join(F.array_sort("answer_labels"), ","), F.col("answer_text"), F.lit(""))
    reply = F.trim(F.concat(answer, F.lit("\n"), F.coalesce("explanation", F.lit(""))), F.lit(" \n\t\r"))
    turn = lambda a, b, who, what: F.struct(F.lit(who).alias(a), what.alias(b))
    if fmt == "alpaca":
        return items.select(asked.alias("instruction"), F.lit("").alias("input"), reply.alias("output"))
    if fmt == "sharegpt":
        return items.select(F.array(turn("from", "value", "human", asked), turn("from", "value", "gpt", reply)).alias("conversations"))
    if fmt == "chatml":
        return items.select(F.array(turn("role", "content", "user", asked), turn("role", "content", "assistant", reply)).alias("messages"))
    raise ValueError(f"no records of the form {fmt}; there are alpaca, sharegpt and chatml")


def leaking(items: DataFrame) -> DataFrame:
    """Items whose visible texts name internal ids or the material they came from."""
    texts = F.array_compact(F.concat(F.array("question", "explanation", "answer_text"), F.coalesce("answer_labels", F.array().cast("array<string>")), F.coalesce(F.transform("options", lambda o: o["text"]), F.array().cast("array<string>"))))
    return items.where(F.exists(texts, leaks))


def export(items: DataFrame, path: str, fmt: str = "alpaca") -> None:
    """Write JSON Lines, or nothing at all if one item leaks."""
    records = training_records(items, fmt)
    if not leaking(items).isEmpty():
        raise ValueError("an item names the graph it came from; nothing is exported")
    records.write.json(path)
