"""The graph of modules, staff, departments, colleges and topics, as an upsert over all records.

Each record says something of several nodes and edges. What is said is laid out as facts with the place where it was
said, (source, record, place in the record, place there): of a node's attribute the first value that isn't blank
stays, of an edge's the last one. Both are one aggregate over the facts, combined where they are read, so a
topic or department that a third of all records name is no bottleneck.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import collapse
from matchloom.operators.topics import node_id
from matchloom.session import materialise

MODULE = "module_id string, module_code string, module_title string, departments array<string>, colleges array<string>, topics array<struct<topic:string,score:int>>"
STAFF = "staff_id string, full_name string, position string, department_name string, college_name string, profile_url string, topics array<struct<topic:string,score:int>>"
#: Records in a file at most.
DEALT = 5_000
ATTRIBUTES = ("label", "college_name", "department_name", "topic_name", "module_id", "module_code", "module_title", "staff_id", "full_name", "position", "profile_url")


def _at(source: int, record: str, place: Column | int = 0, inner: Column | int = 0) -> Column:
    return F.struct(F.lit(source).alias("source"), F.col(record).cast("long").alias("record"), (place if isinstance(place, Column) else F.lit(place)).cast("long").alias("place"), (inner if isinstance(inner, Column) else F.lit(inner)).cast("long").alias("inner"))


def _facts(df: DataFrame, kind: str, value: Column, at: Column, **attributes: Column) -> DataFrame:
    """Facts on a node of each row whose value isn't blank."""
    text = collapse(value.cast("string"))
    cells = [attributes.get(a, F.lit(None)).cast("string").alias(a) for a in ATTRIBUTES]
    return df.where(text != "").select(node_id(kind, text).alias("id"), F.lit(kind).alias("node_type"), at.alias("at"), *cells)


def _links(df: DataFrame, kind: str, ends: tuple[tuple[str, Column], tuple[str, Column]], at: Column, score: Column | None = None) -> DataFrame:
    (st, s), (tt, t) = ends
    s, t = collapse(s.cast("string")), collapse(t.cast("string"))
    return df.where((s != "") & (t != "")).select(node_id(st, s).alias("source"), node_id(tt, t).alias("target"), F.lit(kind).alias("edge_type"), at.alias("at"), (F.lit(None) if score is None else F.coalesce(score, F.lit(0))).cast("int").alias("topic_score"))


def facts(modules: DataFrame, staff: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(facts on nodes, facts on edges). modules, staff: as MODULE and STAFF say, with the place of a record in its source in `order`. Modules come first."""
    c = F.col
    told = modules.where(collapse(c("module_id").cast("string")) != "")
    units = told.select(order, "module_id", "colleges", F.posexplode("departments").alias("p", "department"))
    halls = units.where(collapse(c("department")) != "").select(order, "department", "p", F.posexplode("colleges").alias("q", "college"))
    said = told.select(order, "module_id", F.posexplode("topics").alias("p", "t"))
    people = staff.where(collapse(c("staff_id").cast("string")) != "")
    homes = people.where(collapse(c("department_name")) != "")
    known = people.select(order, "staff_id", F.posexplode("topics").alias("p", "t"))
    later = c("p") + 1_000_000  # a record's topics come after its departments
    named = lambda v: {"label": collapse(v)}
    nodes = [
        _facts(told, "module", c("module_id"), _at(0, order), module_id=collapse(c("module_id").cast("string")), module_code=c("module_code"), module_title=c("module_title"), label=F.coalesce("module_title", collapse(c("module_id").cast("string")))),
        _facts(units, "department", c("department"), _at(0, order, c("p") + 1), department_name=collapse(c("department")), **named(c("department"))),
        _facts(halls, "college", c("college"), _at(0, order, c("p") + 1, c("q") + 1), college_name=collapse(c("college")), **named(c("college"))),
        _facts(said, "topic", c("t.topic"), _at(0, order, later), topic_name=collapse(c("t.topic")), **named(c("t.topic"))),
        _facts(people, "staff", c("staff_id"), _at(1, order), label=F.coalesce("full_name", collapse(c("staff_id").cast("string"))), staff_id=collapse(c("staff_id").cast("string")), **{a: c(a) for a in ("full_name", "position", "department_name", "college_name", "profile_url")}),
        _facts(homes, "department", c("department_name"), _at(1, order, 1), department_name=collapse(c("department_name")), **named(c("department_name"))),
        _facts(homes, "college", c("college_name"), _at(1, order, 1, 1), college_name=collapse(c("college_name")), **named(c("college_name"))),
        _facts(known, "topic", c("t.topic"), _at(1, order, later), topic_name=collapse(c("t.topic")), **named(c("t.topic"))),
    ]
    edges = [
        _links(units, "module_in_department", (("module", c("module_id")), ("department", c("department"))), _at(0, order, c("p") + 1)),
        _links(halls, "department_in_college", (("department", c("department")), ("college", c("college"))), _at(0, order, c("p") + 1, c("q") + 1)),
        _links(said, "module_has_topic", (("module", c("module_id")), ("topic", c("t.topic"))), _at(0, order, later), c("t.score")),
        _links(homes, "staff_in_department", (("staff", c("staff_id")), ("department", c("department_name"))), _at(1, order, 1)),
        _links(homes, "department_in_college", (("department", c("department_name")), ("college", c("college_name"))), _at(1, order, 1, 1)),
        _links(known, "staff_has_topic", (("staff", c("staff_id")), ("topic", c("t.topic"))), _at(1, order, later), c("t.score")),
    ]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def upsert_nodes(told: DataFrame) -> DataFrame:
    """A row a node: of each attribute the first value that is neither null nor empty, or null."""
    first = [F.min_by(a, F.when(F.coalesce(F.col(a), F.lit("")) != "", F.col("at"))).alias(a) for a in ATTRIBUTES]
    return told.groupBy("id", "node_type").agg(*first)


def upsert_edges(told: DataFrame) -> DataFrame:
    """A row for each source, target and edge type, with the score said last."""
    return told.groupBy("source", "target", "edge_type").agg(F.max_by("topic_score", "at").alias("topic_score"))


def build(modules: DataFrame, staff: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(nodes: id, node_type and ATTRIBUTES; edges: source, target, edge_type, topic_score).

    Records are laid out as facts several times and sorted there by node, so they are written once, in files so
    small that a task's facts don't grow with the tables.
    """
    modules, staff = (materialise(df.sparkSession, df, name, DEALT)[0] for df, name in ((modules, "modules"), (staff, "staff")))
    nodes, edges = facts(modules, staff, order)
    return upsert_nodes(nodes), upsert_edges(edges)
