"""Queries: the named checks over records of the driver's tables in which every check is broken somewhere."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import rules
from matchloom.plans.catalog import query
from matchloom.tables import table

#: A pair for each order, in SQL that Spark and DuckDB read alike. k breaks one check, j (of its module) one across rows.
_PAIR = {
    "record_id": "o_orderkey", "module_id": "CASE WHEN k = 0 THEN '' ELSE CAST(o_custkey AS STRING) END", "staff_a_id": "CASE WHEN k = 1 THEN '' WHEN j = 5 THEN CASE WHEN r % 2 = 0 THEN 's' ELSE 't' END ELSE concat('s', CAST(o_orderkey AS STRING)) END",
    "staff_b_id": "CASE WHEN k = 2 THEN ' ' WHEN k = 3 AND j <> 5 THEN concat('s', CAST(o_orderkey AS STRING)) WHEN j = 5 THEN CASE WHEN r % 2 = 0 THEN 't' ELSE 's' END ELSE concat('t', CAST(o_orderkey AS STRING)) END",
    "module_title": "CASE WHEN k <> 4 THEN concat('Module ', CAST(o_custkey AS STRING)) END", "staff_a_name": "CASE WHEN k = 5 THEN '' ELSE concat('Person ', CAST(o_orderkey AS STRING)) END", "staff_b_name": "CASE WHEN k <> 6 THEN concat('Teacher ', CAST(o_orderkey AS STRING)) END",
    "recommendation_level": "CASE WHEN k = 7 THEN 'top' WHEN r % 2 = 0 THEN 'Moderate' ELSE 'high' END", "rank": "CASE WHEN k = 8 THEN NULL WHEN j = 3 THEN r + 1 ELSE r END", "collaboration_score": "CASE WHEN k = 9 THEN -0.1e0 WHEN j = 4 THEN r * 1e0 ELSE 1e0 / r END",
    "combined_module_coverage": "CASE WHEN k = 10 THEN 1.2e0 WHEN k = 14 THEN 0.4e0 WHEN k = 12 THEN 0.5e0 ELSE 0.8e0 END", "best_individual_coverage": "CASE WHEN k = 11 THEN -0.1e0 ELSE 0.5e0 END",
    "complementarity_gain": "CASE WHEN k = 10 THEN 0.7e0 WHEN k = 11 THEN 0.9e0 WHEN k = 12 THEN 0e0 WHEN k = 13 THEN 0.4e0 WHEN k = 14 THEN -0.1e0 ELSE 0.3e0 END",
    "explanation": "CASE WHEN k = 16 THEN '' WHEN k = 17 THEN 'nothing' ELSE concat('module ', CAST(o_custkey AS STRING), ': Person ', CAST(o_orderkey AS STRING), ' and Teacher ', CAST(o_orderkey AS STRING)) END",
    "topics": "CASE WHEN k <> 15 THEN 'topic' END",
}
_PAIR_SQL = f"""o AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS r, o_orderkey % 25 AS k, o_custkey % 10 AS j FROM orders),
p AS (SELECT {", ".join(f"{e} AS {c}" for c, e in _PAIR.items())} FROM o),
t AS (SELECT *, coalesce(module_id, '') <> '' AS named, trim(staff_a_id) AS a, trim(staff_b_id) AS b, lower(explanation) AS said, coalesce(rank, 0) AS n, combined_module_coverage AS cc, best_individual_coverage AS bc, complementarity_gain AS g FROM p),
w AS (SELECT *, row_number() OVER m AS place, lag(collaboration_score) OVER m AS earlier, row_number() OVER (PARTITION BY module_id, least(a, b), greatest(a, b) ORDER BY coalesce(rank, 999999), record_id) AS copy FROM t WINDOW m AS (PARTITION BY module_id ORDER BY coalesce(rank, 999999), record_id)),
v AS (SELECT *, bool_or(n <> place) OVER (PARTITION BY module_id) AS gaps, bool_or(coalesce(earlier + 1e-12 < collaboration_score, false)) OVER (PARTITION BY module_id) AS rises FROM w)"""
_BROKEN = {
    "missing_module_id": "NOT named", "missing_staff_a_id": "a = ''", "missing_staff_b_id": "b = ''", "self_pair": "a <> '' AND a = b", "missing_module_title": "module_title IS NULL", "missing_staff_a_name": "staff_a_name = ''", "missing_staff_b_name": "staff_b_name IS NULL",
    "invalid_recommendation_level": "lower(recommendation_level) NOT IN ('high', 'moderate', 'exploratory')", "invalid_rank": "n < 1", "negative_collaboration_score": "collaboration_score < 0", "invalid_combined_coverage_range": "cc < 0 OR cc > 1.00001", "invalid_individual_coverage_range": "bc < 0 OR bc > 1.00001",
    "non_positive_complementarity_gain": "g <= 0", "inconsistent_complementarity_gain": "abs(g - (cc - bc)) > 0.00001", "pair_coverage_less_than_best_individual": "cc + 0.00001 < bc", "missing_topic_evidence": "topics IS NULL", "missing_explanation": "said = ''",
    "module_title_missing_from_explanation": "said <> '' AND NOT contains(said, lower(coalesce(module_title, '')))", "staff_a_name_missing_from_explanation": "said <> '' AND NOT contains(said, lower(coalesce(staff_a_name, '')))", "staff_b_name_missing_from_explanation": "said <> '' AND NOT contains(said, lower(coalesce(staff_b_name, '')))",
    "non_contiguous_or_duplicate_ranks": "named AND gaps", "rank_score_order_inconsistent": "named AND NOT gaps AND rises", "duplicate_pair": "named AND a <> '' AND b <> '' AND copy > 1",
}


@query("p26_pair_checks", f"WITH {_PAIR_SQL}, f AS (SELECT record_id, unnest([{', '.join(f'CASE WHEN {x} THEN {chr(39)}{n}{chr(39)} END' for n, x in _BROKEN.items())}]) AS failure FROM v) SELECT * FROM f WHERE failure IS NOT NULL")
def _(spark, sf):
    """Twenty checks of a pair and three across a module's pairs."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf, "orders").withColumns({"r": F.row_number().over(w), "k": F.col("o_orderkey") % 25, "j": F.col("o_custkey") % 10})
    pairs = o.select(*[F.expr(e).alias(c) for c, e in _PAIR.items()])
    odd = F.col("record_id") % 2 == 0
    told = pairs.withColumns({"shared_module_topics": F.when(odd, F.array("topics")), "complementary_module_topics": F.when(~odd, F.array("topics"))})
    empty = F.array().cast("array<string>")
    told = told.withColumns({c: F.when(F.col("topics").isNotNull(), F.col(c)).otherwise(empty) for c in ("shared_module_topics", "complementary_module_topics")})
    return rules.pair_failures(told)


_FINDINGS_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS module_id, CASE p_partkey % 18 WHEN 2 THEN 'recommendation_count_exceeds_top_k:6 | hierarchy_internal_ranked_without_top_k' WHEN 3 THEN 'invalid_rank_sequence:[1, 2, 3, 4, 6]' WHEN 4 THEN 'duplicate_staff_in_recommendations' WHEN 5 THEN 'missing_matched_internal_paths:rank=2:staff_id=s2'
 WHEN 7 THEN 'returned_recommendation_failed_gate:rank=4:staff_id=s4' WHEN 8 THEN 'rejected_candidate_marked_passed' WHEN 9 THEN 'gate_summary_passed_mismatch:reported=4:actual=5' WHEN 10 THEN 'gate_summary_failed_mismatch:reported=3:actual=2' WHEN 11 THEN 'gate_reason_counts_mismatch' WHEN 12 THEN 'hierarchy_internal_ranked_without_top_k'
 WHEN 13 THEN 'hierarchy_internal_ranked_marked_review_required' WHEN 14 THEN 'limited_pool_has_top_k_or_more' WHEN 15 THEN 'gate_failed_module_returned_recommendations | gate_failed_module_not_marked_review_required' WHEN 16 THEN 'no_hierarchy_internal_staff_has_recommendations | no_hierarchy_internal_staff_not_marked_review_required' ELSE '' END AS issues,
 CASE p_partkey % 18 WHEN 1 THEN 'module_hierarchy_paths_missing' WHEN 6 THEN 'missing_staff_hierarchy_paths:rank=3:staff_id=s3' ELSE '' END AS warnings FROM part"""


@query("p27_result_checks", _FINDINGS_SQL)
def _(spark, sf):
    """A ranked result for each part, of which 17 in 18 break a check or are an exception from one; the SQL says which."""
    k = F.col("k")
    path, no_path, none = F.array(F.lit("p")), F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    gate = lambda ok, why: F.struct(ok.alias("passed"), why.alias("reason"))
    n = F.when(k == 2, 6).when(k == 12, 4).otherwise(5)
    rec = lambda i: F.struct(
        F.when((k == 3) & (i == 5), 6).otherwise(i).cast("int").alias("rank"), F.concat(F.lit("s"), F.when((k == 4) & (i == 2), 1).otherwise(i).cast("string")).alias("staff_id"),
        F.when((k == 5) & (i == 2), no_path).otherwise(path).alias("matched_internal_paths"), F.when((k == 6) & (i == 3), none).otherwise(path).alias("staff_hierarchy_paths"), gate(~((k == 7) & (i == 4)), F.lit("passed")).alias("gate"),
    )
    out = lambda i: F.struct(F.concat(F.lit("r"), i.cast("string")).alias("staff_id"), gate((k == 8) & (i == 1), F.lit("low_total_score")).alias("gate"))
    counts = F.when(k == 11, F.create_map(F.lit("passed"), F.lit(5))).otherwise(F.create_map(F.lit("passed"), n, F.lit("low_total_score"), F.lit(2)))
    summary = F.struct(F.when(k == 9, 4).otherwise(n).alias("passed_count"), F.when(k == 10, 3).otherwise(2).alias("failed_count"), counts.alias("gate_reason_counts"))
    status = F.when(k == 14, "limited_hierarchy_internal_pool").when(k == 15, "all_internal_candidates_failed_gate").when(k == 16, "no_hierarchy_internal_staff").when(k == 17, "module_hierarchy_unresolved").otherwise("hierarchy_internal_ranked")
    made = table(spark, sf, "part").withColumn("k", F.col("p_partkey") % 18).select(
        F.col("p_partkey").cast("string").alias("module_id"), status.alias("decision_status"), (k == 13).alias("review_required"), F.when(k == 1, no_path).when(k == 17, none).otherwise(path).alias("module_hierarchy_paths"),
        F.transform(F.sequence(F.lit(1), n), rec).alias("recommendations"), F.transform(F.sequence(F.lit(1), F.lit(2)), out).alias("rejected_candidates"), summary.alias("gate_summary"),
    )
    return rules.result_findings(made).select("module_id", F.array_join("issues", " | ").alias("issues"), F.array_join("warnings", " | ").alias("warnings"))


_TABLES_SQL = """staff AS (SELECT CAST(s_suppkey AS VARCHAR) AS staff_id, CASE WHEN s_suppkey % 9 > 0 THEN s_name END AS full_name, CASE WHEN s_acctbal < 0 THEN ' ' ELSE 'd' END AS department_name, 'c' AS college_name, CASE WHEN s_suppkey % 4 > 0 THEN 'text' ELSE '' END AS matching_text_without_teaching, CAST(NULL AS VARCHAR) AS profile_url FROM supplier),
courses AS (SELECT CAST(o_orderkey AS VARCHAR) AS course_id FROM orders WHERE o_orderstatus <> 'P'),
modules AS (SELECT CAST(p_partkey % 150000 AS VARCHAR) AS module_id, CASE WHEN p_size > 5 THEN p_name END AS module_title, CASE WHEN p_size < 40 THEN p_type ELSE '' END AS description, p_name AS matching_text, p_size % 6 > 0 AS some_, CASE WHEN p_size % 8 > 0 THEN 'ab' || CAST(p_partkey % 500 AS VARCHAR) ELSE '' END AS module_code FROM part),
links AS (SELECT CAST(l_orderkey AS VARCHAR) AS course_id, CAST(l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END AS VARCHAR) AS module_id FROM lineitem),
pubs AS (SELECT CAST(c_custkey // 2 AS VARCHAR) AS publication_id FROM customer), plinks AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS staff_id, CAST(o_custkey AS VARCHAR) AS publication_id FROM orders),
teaching AS (SELECT CAST(user_id AS VARCHAR) AS staff_id, [' ab' || CAST(user_id AS VARCHAR), CASE WHEN event_type = 'error' THEN 'ZZ1' ELSE '' END] AS module_codes FROM events),
rep AS (SELECT 'staff_ids' AS name, (SELECT count(*) FROM (SELECT staff_id FROM staff GROUP BY 1 HAVING count(*) > 1)) AS value UNION ALL SELECT 'course_ids', (SELECT count(*) FROM (SELECT course_id FROM courses GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'module_ids', (SELECT count(*) FROM (SELECT module_id FROM modules GROUP BY 1 HAVING count(*) > 1)) UNION ALL SELECT 'publication_ids', (SELECT count(*) FROM (SELECT publication_id FROM pubs GROUP BY 1 HAVING count(*) > 1))),
err AS (SELECT 'invalid_course_ids' AS name, (SELECT count(DISTINCT course_id) FROM links WHERE course_id NOT IN (SELECT course_id FROM courses)) AS value UNION ALL SELECT 'invalid_module_ids', (SELECT count(DISTINCT module_id) FROM links WHERE module_id NOT IN (SELECT module_id FROM modules))
 UNION ALL SELECT 'invalid_publication_staff_ids', (SELECT count(DISTINCT staff_id) FROM plinks WHERE staff_id NOT IN (SELECT staff_id FROM staff)) UNION ALL SELECT 'invalid_publication_ids', (SELECT count(DISTINCT publication_id) FROM plinks WHERE publication_id NOT IN (SELECT publication_id FROM pubs))
 UNION ALL SELECT 'invalid_teaching_staff_ids', (SELECT count(DISTINCT staff_id) FROM teaching WHERE staff_id NOT IN (SELECT staff_id FROM staff)) UNION ALL SELECT 'modules_without_course_links', (SELECT count(DISTINCT module_id) FROM modules WHERE module_id NOT IN (SELECT module_id FROM links)) UNION ALL SELECT 'courses_without_module_links', (SELECT count(DISTINCT course_id) FROM courses WHERE course_id NOT IN (SELECT course_id FROM links))),
tc AS (SELECT DISTINCT upper(trim(c)) AS code FROM (SELECT unnest(module_codes) AS c FROM teaching) WHERE trim(c) <> ''), mc AS (SELECT DISTINCT upper(trim(module_code)) AS code FROM modules WHERE trim(module_code) <> ''),
z AS (SELECT name, value FROM rep UNION ALL SELECT name, value FROM err), ck AS (SELECT unnest(['staff_ids_unique', 'course_ids_unique', 'module_ids_unique', 'publication_ids_unique', 'course_module_references_valid', 'staff_publication_references_valid', 'teaching_staff_references_valid', 'all_modules_linked_to_courses']) AS name,
 unnest([['staff_ids'], ['course_ids'], ['module_ids'], ['publication_ids'], ['invalid_course_ids', 'invalid_module_ids'], ['invalid_publication_staff_ids', 'invalid_publication_ids'], ['invalid_teaching_staff_ids'], ['modules_without_course_links']]) AS needs),
cv AS (SELECT ck.name, CAST((SELECT sum(value) FROM z WHERE list_contains(needs, z.name)) = 0 AS BIGINT) AS value FROM ck)"""
_COUNTS = {"staff": "staff", "courses": "courses", "modules": "modules", "course_module_links": "links", "publications": "pubs", "staff_publication_links": "plinks", "teaching_evidence": "teaching"}
_QUALITY = {("staff_quality", n, "staff", f"trim(coalesce({c}, '')) = ''") for n, c in rules.STAFF_QUALITY.items()} | {("module_quality", n, "modules", "NOT some_" if c == "departments" else f"trim(coalesce({c}, '')) = ''") for n, c in rules.MODULE_QUALITY.items()}


@query("a7_processed_report", f"WITH {_TABLES_SQL} " + " UNION ALL ".join([
    *[f"SELECT 'counts' AS section, '{n}' AS name, (SELECT count(*) FROM {t}) AS value" for n, t in _COUNTS.items()], *[f"SELECT '{s}', '{n}', (SELECT count_if({x}) FROM {t})" for s, n, t, x in sorted(_QUALITY)],
    "SELECT 'repeated', name, value FROM rep", "SELECT 'relationship_errors', name, value FROM err", "SELECT 'checks', name, value FROM cv", "SELECT 'checks', 'validation_passed', (SELECT min(value) FROM cv)",
    "SELECT 'teaching_codes', 'unique_teaching_codes', (SELECT count(*) FROM tc)", "SELECT 'teaching_codes', 'unique_current_module_codes', (SELECT count(*) FROM mc)",
    "SELECT 'teaching_codes', 'matched_teaching_codes', (SELECT count(*) FROM tc WHERE code IN (SELECT code FROM mc))", "SELECT 'teaching_codes', 'unmatched_teaching_codes', (SELECT count(*) FROM tc WHERE code NOT IN (SELECT code FROM mc))",
]))
def _(spark, sf):
    """Counts, blanks, references and the eight checks over seven tables."""
    t = lambda n: table(spark, sf, n)
    s = lambda e: f"cast({e} as string)"
    staff = t("supplier").selectExpr(f"{s('s_suppkey')} staff_id", "case when s_suppkey % 9 > 0 then s_name end full_name", "case when s_acctbal < 0 then ' ' else 'd' end department_name", "'c' college_name", "case when s_suppkey % 4 > 0 then 'text' else '' end matching_text_without_teaching", "cast(null as string) profile_url")
    courses = t("orders").where("o_orderstatus <> 'P'").selectExpr(f"{s('o_orderkey')} course_id")
    modules = t("part").selectExpr(f"{s('p_partkey % 150000')} module_id", "case when p_size > 5 then p_name end module_title", "case when p_size < 40 then p_type else '' end description", "p_name matching_text", "case when p_size % 6 > 0 then array('d') else cast(array() as array<string>) end departments", f"case when p_size % 8 > 0 then concat('ab', {s('p_partkey % 500')}) else '' end module_code")
    links = t("lineitem").selectExpr(f"{s('l_orderkey')} course_id", f"{s('l_partkey + case when l_linenumber = 7 then 1000000 else 0 end')} module_id")
    pubs, plinks = t("customer").selectExpr(f"{s('c_custkey div 2')} publication_id"), t("orders").selectExpr(f"{s('o_custkey % 40')} staff_id", f"{s('o_custkey')} publication_id")
    teaching = t("events").selectExpr(f"{s('user_id')} staff_id", f"array(concat(' ab', {s('user_id')}), case when event_type = 'error' then 'ZZ1' else '' end) module_codes")
    return rules.processed_report(staff, courses, modules, links, pubs, plinks, teaching)
