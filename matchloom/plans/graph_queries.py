"""Queries: the graph of all records of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import knowledge as K
from matchloom.plans.catalog import query
from matchloom.plans.roles import MODULE_SQL, STAFF_SQL, modules, staff
from matchloom.tables import table

#: Modules with departments in two spellings and topics that come again; people with a second record, which fills what the first lacks.
RECORDS_SQL = f"""{STAFF_SQL}, {MODULE_SQL},
mod AS (SELECT module_id AS ord, CAST(module_id AS VARCHAR) AS module_id, CASE WHEN module_id % 5 > 0 THEN module_code END AS module_code, CASE WHEN module_id % 7 > 0 THEN title END AS module_title,
 CASE WHEN module_id % 3 = 0 THEN [upper(department) || ' & co', department] ELSE [department, ''] END AS departments, [college, lower(college)] AS colleges,
 [(split_part(title, ' ', 1), CAST(size AS INT)), (split_part(title, ' ', 2), 3), (upper(split_part(title, ' ', 1)), CAST(size + 1 AS INT))] AS topics FROM module),
st AS (SELECT l_suppkey AS staff_id, split_part(p_name, ' ', 1) AS topic, CAST(count(*) AS INT) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
per AS (SELECT 2 * staff_id AS ord, CAST(staff_id AS VARCHAR) AS staff_id, full_name, position, department AS department_name, college AS college_name, CAST(NULL AS VARCHAR) AS profile_url, 0 AS turn FROM staff
 UNION ALL SELECT 2 * staff_id + 1, CAST(staff_id AS VARCHAR), NULL, 'Reader', CASE WHEN staff_id % 2 = 0 THEN '' ELSE department END, 'Institute', 'http://people/' || CAST(staff_id AS VARCHAR), 1 FROM staff),
pt AS (SELECT per.ord, per.staff_id, topic, score + turn * 100 AS score FROM per JOIN st ON CAST(st.staff_id AS VARCHAR) = per.staff_id WHERE turn = 0 OR score % 2 = 0),
md AS (SELECT ord, module_id, colleges, unnest(departments) AS department, unnest(range(len(departments))) AS p FROM mod), mc AS (SELECT ord, department, p, unnest(colleges) AS college, unnest(range(len(colleges))) AS q FROM md WHERE department <> ''),
mt AS (SELECT ord, module_id, unnest(topics) AS t, unnest(range(len(topics))) AS p FROM mod)"""
_ID = "'{}:' || replace(translate(lower({}), ' /', '__'), '&', 'and')"


def records(spark, sf):
    word = lambda i: F.get(F.split("title", " "), i)
    topic = lambda name, score: F.struct(name.alias("topic"), score.cast("int").alias("score"))
    m = F.col("module_id")
    mods = modules(spark, sf).select(
        m.alias("ord"), m.cast("string").alias("module_id"), F.when(m % 5 > 0, F.col("module_code")).alias("module_code"), F.when(m % 7 > 0, F.col("title")).alias("module_title"),
        F.when(m % 3 == 0, F.array(F.concat(F.upper("department"), F.lit(" & co")), F.col("department"))).otherwise(F.array(F.col("department"), F.lit(""))).alias("departments"), F.array(F.col("college"), F.lower("college")).alias("colleges"),
        F.array(topic(word(0), F.col("size")), topic(word(1), F.lit(3)), topic(F.upper(word(0)), F.col("size") + 1)).alias("topics"),
    )
    told = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_suppkey").alias("staff_id"), F.get(F.split("p_name", " "), 0).alias("topic")).agg(F.count("*").cast("int").alias("score"))
    people = staff(spark, sf).join(told.groupBy("staff_id").agg(F.array_sort(F.collect_list(F.struct("topic", "score"))).alias("topics")), "staff_id", "left")
    s, none = F.col("staff_id"), F.lit(None).cast("string")
    first = people.select((2 * s).alias("ord"), s.cast("string").alias("staff_id"), "full_name", "position", F.col("department").alias("department_name"), F.col("college").alias("college_name"), none.alias("profile_url"), "topics")
    again = F.transform(F.filter("topics", lambda x: x["score"] % 2 == 0), lambda x: topic(x["topic"], x["score"] + 100))
    second = people.select((2 * s + 1).alias("ord"), s.cast("string").alias("staff_id"), none.alias("full_name"), F.lit("Reader").alias("position"), F.when(s % 2 == 0, "").otherwise(F.col("department")).alias("department_name"), F.lit("Institute").alias("college_name"), F.concat(F.lit("http://people/"), s.cast("string")).alias("profile_url"), again.alias("topics"))
    return mods, first.unionByName(second)


def _said(kind: str, value: str, source: str, at: str, **attributes: str) -> str:
    cells = ", ".join(f"CAST({attributes.get(a, 'NULL')} AS VARCHAR) AS {a}" for a in K.ATTRIBUTES)
    return f"SELECT {_ID.format(kind, value)} AS id, '{kind}' AS node_type, {at} AS o, {cells} FROM {source} WHERE {value} <> ''"


_NODE_FACTS = " UNION ALL ".join((
    _said("module", "module_id", "mod", "ord * 1000", module_id="module_id", module_code="module_code", module_title="module_title", label="coalesce(module_title, module_id)"),
    _said("department", "department", "md", "ord * 1000 + 10 * (p + 1)", department_name="department", label="department"), _said("college", "college", "mc", "ord * 1000 + 10 * (p + 1) + q + 1", college_name="college", label="college"),
    _said("topic", "t[1]", "mt", "ord * 1000 + 500 + p", topic_name="t[1]", label="t[1]"),
    _said("staff", "staff_id", "per", "1000000000000 + ord * 1000", staff_id="staff_id", full_name="full_name", position="position", department_name="department_name", college_name="college_name", profile_url="profile_url", label="coalesce(full_name, staff_id)"),
    _said("department", "department_name", "per", "1000000000000 + ord * 1000 + 10", department_name="department_name", label="department_name"),
    _said("college", "college_name", "(SELECT * FROM per WHERE department_name <> '') AS h", "1000000000000 + ord * 1000 + 11", college_name="college_name", label="college_name"), _said("topic", "topic", "pt", "1000000000000 + ord * 1000 + 500", topic_name="topic", label="topic"),
))


def _edge(kind: str, st: str, s: str, tt: str, t: str, source: str, at: str, score: str = "NULL") -> str:
    return f"SELECT {_ID.format(st, s)} AS source, {_ID.format(tt, t)} AS target, '{kind}' AS edge_type, {at} AS o, CAST({score} AS INT) AS topic_score FROM {source} WHERE {s} <> '' AND {t} <> ''"


EDGE_FACTS = " UNION ALL ".join((
    _edge("module_in_department", "module", "module_id", "department", "department", "md", "ord"), _edge("department_in_college", "department", "department", "college", "college", "mc", "ord"),
    _edge("module_has_topic", "module", "module_id", "topic", "t[1]", "mt", "p", "t[2]"), _edge("staff_in_department", "staff", "staff_id", "department", "department_name", "per", "ord"),
    _edge("department_in_college", "department", "department_name", "college", "college_name", "per", "ord"), _edge("staff_has_topic", "staff", "staff_id", "topic", "topic", "pt", "ord", "score"),
))


@query("g9_graph_nodes", f"WITH {RECORDS_SQL}, f AS ({_NODE_FACTS}) SELECT id, node_type, {', '.join(f'arg_min({a}, o) FILTER (WHERE {a} <> {chr(39) * 2}) AS {a}' for a in K.ATTRIBUTES)} FROM f GROUP BY id, node_type")
def _(spark, sf):
    """Five types of nodes; of each attribute the first value that isn't blank."""
    return K.build(*records(spark, sf))[0]


@query("g9_graph_edges", f"WITH {RECORDS_SQL}, f AS ({EDGE_FACTS}) SELECT source, target, edge_type, arg_max(topic_score, o) AS topic_score FROM f GROUP BY source, target, edge_type")
def _(spark, sf):
    """Five types of edges; of each score the last."""
    return K.build(*records(spark, sf))[1]
