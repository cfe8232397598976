"""The five stages over the driver's tables: data, graph, matching, explanation and evaluation, each made from what the ones before have put in the context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import allocation, collaboration, explain, knowledge, policy, ranking
from matchloom.plans.catalog import query
from matchloom.plans.graph_queries import EDGE_FACTS, RECORDS_SQL, records
from matchloom.plans.roles import SCORE_SQL, modules, scores, staff
from matchloom.plans.stages import Context, TableStage, run_all


def _data(context: Context) -> DataFrame:
    people, catalogue = staff(context.spark, context.root), modules(context.spark, context.root)
    context.put("staff", people)
    context.put("modules", catalogue)
    context.put("scores", scores(context.spark, context.root))
    return people.select(F.lit("staff").alias("kind"), F.col("staff_id").alias("id")).unionByName(catalogue.select(F.lit("module").alias("kind"), F.col("module_id").alias("id")))


def _graph(context: Context) -> DataFrame:
    """Five types of nodes and edges of all records."""
    told = records(context.spark, context.root)
    nodes, edges = knowledge.build(*told)
    context.put("nodes", nodes)
    context.put("records", told)
    return edges


def _matching(context: Context) -> DataFrame:
    return ranking.top_k(context.get("scores"), ["module_id"], [F.desc("score"), F.col("staff_id")], 5)


def _explanation(context: Context) -> DataFrame:
    """Why each match was made, with the topics that module and person share (the strongest five)."""
    mods, people = context.get("records")
    topic = lambda df, key: df.select(F.col(key).cast("long").alias(key), F.explode("topics").alias("t")).groupBy(key, F.lower("t.topic").alias("topic")).agg(F.max("t.score").alias("score")).where("topic <> ''")
    pairs = context.get("matching").select("module_id", "staff_id")
    common = collaboration.shared_topics(topic(mods, "module_id"), topic(people, "staff_id"), pairs).select("module_id", "staff_id", F.split("names", ", ").alias("topics"))
    found = context.get("matching").join(common, ["module_id", "staff_id"], "left")
    return found.select("module_id", "staff_id", explain.match_text(F.col("rank"), policy.band(F.col("score")), F.coalesce("topics", F.array().cast("array<string>"))).alias("said"))


def _evaluation(context: Context) -> DataFrame:
    first = context.get("matching").where("rank = 1")
    return allocation.fairness(allocation.workloads(first, context.get("staff")))


def standard() -> list[TableStage]:
    return [TableStage(name, make) for name, make in (("data", _data), ("graph", _graph), ("matching", _matching), ("explanation", _explanation), ("evaluation", _evaluation))]


def run(spark: SparkSession, root: str) -> DataFrame:
    """stage, status, rows of a run."""
    results = run_all(standard(), Context(spark, root))
    return spark.createDataFrame([(r.stage, r.status, int(r.metrics.get("rows", -1))) for r in results], "stage string, status string, rows long")


@query("x6_x7_stages", f"""WITH {RECORDS_SQL}, {SCORE_SQL}, t AS (SELECT module_id, row_number() OVER (PARTITION BY module_id ORDER BY score DESC, staff_id) AS k FROM score)
SELECT 'data' AS stage, 'success' AS status, (SELECT count(*) FROM staff) + (SELECT count(*) FROM module) AS rows UNION ALL SELECT 'graph', 'success', (SELECT count(*) FROM (SELECT DISTINCT source, target, edge_type FROM ({EDGE_FACTS})))
UNION ALL SELECT 'matching', 'success', (SELECT count(*) FROM t WHERE k <= 5) UNION ALL SELECT 'explanation', 'success', (SELECT count(*) FROM t WHERE k <= 5) UNION ALL SELECT 'evaluation', 'success', 1""")
def _(spark, sf):
    return run(spark, sf)
