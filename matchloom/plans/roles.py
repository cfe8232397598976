"""What the driver's tables stand for: staff, modules, links and scored candidates, in DataFrames and in SQL.

Titles, positions and scores are derived from keys and quantities by rule, so that every branch of
the policies has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.tables import table

POSITIONS = (
    "Professor of Robotics", "Senior Lecturer", "Lecturer in Law", "Reader", "Emeritus Professor", "Research Fellow",
    "Head of Department", "Visiting Lecturer", "Teaching Fellow", "Technician", "", "Consultant",
)
TITLES = (
    "", " Dissertation", " Work Placement", " Performance", " Major Group Project", " Capstone Project", " Theory", " Study Abroad", " Practice", " Systems",
)

_D_POSITION = "list_extract([{}], CAST(s_suppkey % {} AS INT) + 1)".format(", ".join(f"'{p}'" for p in POSITIONS), len(POSITIONS))
_D_TITLE = "p_name || list_extract([{}], CAST(p_partkey % {} AS INT) + 1)".format(", ".join(f"'{t}'" for t in TITLES), len(TITLES))

STAFF_SQL = f"""staff AS (SELECT s_suppkey AS staff_id, s_name AS full_name, {_D_POSITION} AS position, n_name AS department, r_name AS college,
 lower(r_name) || '/' || lower(n_name) AS path, s_acctbal AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
MODULE_SQL = f"""module AS (SELECT p_partkey AS module_id, upper(substr(p_name, 1, 2)) || CAST(1000 + p_partkey AS VARCHAR) AS module_code, {_D_TITLE} AS title,
 n_name AS department, r_name AS college, CASE WHEN p_partkey % 4 = 0 THEN lower(r_name) ELSE lower(r_name) || '/' || lower(n_name) END AS path, p_size AS size
 FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON n_regionkey = r_regionkey)"""
SCORE_SQL = """score AS (SELECT l_partkey AS module_id, l_suppkey AS staff_id, count(*) AS n,
 least(1.0, sum(CAST(l_quantity AS BIGINT)) / 100.0) AS score, sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 20.0) AS core,
 sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 16.0) AS pub FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def _catalogue(spark: SparkSession, values: tuple[str, ...], key: str, name: str) -> DataFrame:
    """A table of texts by number: joined and not computed from a key, or rules on the text would be inferred for every table with that key."""
    rows = ", ".join(f"({i}, '{v}')" for i, v in enumerate(values))
    return F.broadcast(spark.sql(f"SELECT cast({key} as bigint) AS {key}, {name} FROM VALUES {rows} AS t({key}, {name})"))  # a dozen rows


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    n, r = t("nation"), t("region")
    people = t("supplier").withColumn("__p", F.col("s_suppkey") % len(POSITIONS)).join(_catalogue(spark, POSITIONS, "__p", "position"), "__p")
    return (
        people.join(n, _eq("s_nationkey", "n_nationkey")).join(r, _eq("n_regionkey", "r_regionkey"))
        .selectExpr("s_suppkey as staff_id", "s_name as full_name", "position", "n_name as department", "r_name as college", "concat(lower(r_name), '/', lower(n_name)) as path", "s_acctbal as balance")
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    parts = t("part").withColumns({"__n": F.col("p_partkey") % 25, "__t": F.col("p_partkey") % len(TITLES)}).join(_catalogue(spark, TITLES, "__t", "suffix"), "__t")
    return (
        parts.join(t("nation"), _eq("__n", "n_nationkey")).join(t("region"), _eq("n_regionkey", "r_regionkey"))
        .selectExpr("p_partkey as module_id", "concat(upper(substr(p_name, 1, 2)), cast(1000 + p_partkey as string)) as module_code", "concat(p_name, suffix) as title", "n_name as department", "r_name as college", "case when p_partkey % 4 = 0 then lower(r_name) else concat(lower(r_name), '/', lower(n_name)) end as path", "p_size as size")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """module_id, staff_id, n, score, core, pub of each pair that a line item links."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        _e("count(*) as n"), _e("least(1.0D, sum(cast(l_quantity as bigint)) / 100.0D) as score"),
        _e("sum(cast(round(l_discount * 100) as bigint)) / (count(*) * 20.0D) as core"), _e("sum(cast(round(l_tax * 100) as bigint)) / (count(*) * 16.0D) as pub"),
    ).withColumnsRenamed({"l_partkey": "module_id", "l_suppkey": "staff_id"})


def _e(sql: str):
    return F.expr(sql)


def _eq(a: str, b: str):
    return F.col(a) == F.col(b)
