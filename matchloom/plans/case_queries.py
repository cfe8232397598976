"""Queries: case studies of recommendations made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import cases
from matchloom.plans.catalog import query
from matchloom.tables import table

#: A recommendation for each order, in SQL that Spark and DuckDB read alike.
_ROWS = {
    "record_id": "o_orderkey", "module_id": "CASE WHEN o_custkey % 20 > 0 THEN CAST(o_custkey AS STRING) ELSE ' ' END", "module_title": "concat('Module ', CAST(o_custkey % 7 AS STRING))", "staff_a_name": "concat('A', CAST(o_orderkey % 5 AS STRING))",
    "staff_b_name": "CASE WHEN o_orderkey % 9 > 0 THEN concat('b', CAST(o_orderkey % 3 AS STRING)) END", "rank": "CASE WHEN o_orderkey % 8 > 0 THEN CAST(o_orderkey % 8 AS INT) END",
    "recommendation_level": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'High' WHEN '2' THEN ' moderate' WHEN '3' THEN 'exploratory' ELSE 'other' END", "collaboration_score": "(o_orderkey % 11) / 10e0", "combined_module_coverage": "CASE WHEN o_orderkey % 6 > 0 THEN (o_orderkey % 6) / 10e0 END",
    "complementarity_gain": "(o_custkey % 4) / 10e0", "explanation": "CASE WHEN o_orderkey % 2 = 0 THEN ' said ' END", "shared": "o_custkey % 3 = 0",
}
_KEY = "coalesce(collaboration_score, 0) DESC, coalesce(combined_module_coverage, 0) DESC, coalesce(complementarity_gain, 0) DESC, coalesce(rank, 999999), lower(module_title), lower(staff_a_name), lower(coalesce(staff_b_name, '')), record_id"


@query("x5_case_studies", f"""WITH r AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _ROWS.items())} FROM orders), l AS (SELECT *, lower(trim(recommendation_level)) AS g FROM r WHERE trim(module_id) <> ''),
b AS (SELECT * FROM l WHERE g IN ('high', 'moderate', 'exploratory') QUALIFY row_number() OVER (PARTITION BY g, module_id ORDER BY {_KEY}) = 1), t AS (SELECT *, row_number() OVER (PARTITION BY g, shared ORDER BY {_KEY}) AS turn FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn, shared DESC) AS n FROM t QUALIFY n <= CASE g WHEN 'exploratory' THEN 5 ELSE 10 END)
SELECT printf('M4-%03d', row_number() OVER (ORDER BY CASE g WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 ELSE 2 END, n)) AS case_id, g AS selection_group, trim(module_id) AS module_id, module_title, staff_a_name, coalesce(staff_b_name, '') AS staff_b_name, coalesce(rank, 0) AS rank, round(collaboration_score, 6) AS collaboration_score,
round(coalesce(combined_module_coverage, 0), 6) AS combined_module_coverage, shared AS has_shared_foundation, CASE WHEN shared THEN 'common' ELSE '' END AS topics, 'ours,more' AS a_topics, '' AS b_topics, trim(coalesce(explanation, '')) AS explanation FROM n""")
def _(spark, sf):
    """25 cases of every order's recommendation: the numbers are the report's."""
    rows = table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _ROWS.items()])
    topic = lambda t, who: F.struct(F.lit(t).cast("string").alias("topic"), F.lit(who).alias("provided_by"))
    common = F.when(F.col("shared"), F.array(topic("common", "both"), topic(" ", "both")))
    told = rows.withColumns({"shared_module_topics": common, "shared_staff_topics": F.array().cast("array<string>"), "complementary_module_topics": F.array(topic("ours", "staff_a"), topic(None, "staff_b"), topic("more", "staff_a"))})
    told = told.withColumns({c: F.lit(None).cast("double") for c in ("best_individual_coverage", "staff_topic_overlap_ratio")})
    said = cases.sheet(cases.select(told))
    joined = lambda c: F.array_join(c, ",")
    return said.select("case_id", "selection_group", "module_id", "module_title", "staff_a_name", "staff_b_name", "rank", "collaboration_score", "combined_module_coverage", "has_shared_foundation", joined("shared_module_topics").alias("topics"), joined("staff_a_complementary_topics").alias("a_topics"), joined("staff_b_complementary_topics").alias("b_topics"), "explanation")
