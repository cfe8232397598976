"""Queries: reports over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators import reports as R
from matchloom.operators import rules
from matchloom.plans.catalog import query
from matchloom.tables import table

_MODULE = {
    "cms": "CASE p_partkey % 6 WHEN 0 THEN concat('C', CAST(p_size AS STRING)) WHEN 1 THEN 'N/A' END", "id": "CASE p_partkey % 6 WHEN 1 THEN concat(' M', CAST(p_size AS STRING), ' ') WHEN 2 THEN 'tbc' END",
    "code": "CASE p_partkey % 6 WHEN 2 THEN p_brand WHEN 3 THEN '' END", "slug": "CASE p_partkey % 6 WHEN 3 THEN p_type END", "title": "CASE WHEN p_partkey % 6 = 4 THEN p_name END", "description": "concat(p_type, ' ', p_name, ' ', p_type)",
}
_NO = "('', 'none', 'null', 'n/a', 'na', 'tbc')"


@query("a2_module_identity", f"""WITH m AS (SELECT {", ".join(f"lower(trim(coalesce({e}, ''))) AS {n}" for n, e in _MODULE.items())} FROM part), i AS (SELECT CASE WHEN cms NOT IN {_NO} THEN 'cms:' || cms WHEN id NOT IN {_NO} THEN 'id:' || id WHEN code NOT IN {_NO} THEN 'code:' || code WHEN slug NOT IN {_NO} THEN 'slug:' || slug ELSE 'title:' || title || '|description:' || description[1:150] END AS i FROM m),
g AS (SELECT i, count(*) AS n FROM i GROUP BY i) SELECT 'levels' AS section, split_part(i, ':', 1) AS name, count(*) AS value FROM g GROUP BY 2 UNION ALL SELECT 'counts', unnest(['records', 'identities', 'repeats']), unnest([CAST(sum(n) AS BIGINT), count(*), CAST(sum(n - 1) AS BIGINT)]) FROM g""")
def _(spark, sf):
    """Five levels of identity, each of which some parts need."""
    m = table(spark, sf, "part").select(*[F.expr(e).alias(n) for n, e in _MODULE.items()])
    return R.identity_audit(m, R.identity(*[F.col(c) for c in _MODULE]))


_PUB = {
    "title": "CASE WHEN o_orderkey % 9 > 0 THEN concat('Title ', CAST(o_custkey AS STRING)) ELSE ' ' END", "year": "CASE WHEN o_orderkey % 8 > 0 THEN CAST(year(o_orderdate) AS STRING) ELSE '' END", "publication_type": "CASE WHEN o_orderkey % 10 > 0 THEN o_orderpriority END",
    "doi": "CASE WHEN o_orderkey % 3 > 0 THEN concat('https://doi.org/10.1000/', CAST(o_custkey % 100 AS STRING), '.') END", "citation": "CASE WHEN o_orderkey % 4 = 0 THEN concat('see http://www.site', CAST(o_custkey % 50 AS STRING), '.org/x and text') ELSE 'none' END",
}
_PEOPLE = {"staff_id": "CAST(c_custkey AS STRING)", "profile_url": "CASE WHEN c_custkey % 3 > 0 THEN concat('https://uni', CAST(c_nationkey AS STRING), '.ac/', c_name) ELSE '' END", "note": "CASE WHEN c_custkey % 5 = 0 THEN 'http://www.other.com' END"}


@query("a8_enrichment_readiness", rf"""WITH p AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _PUB.items())} FROM orders), u AS (SELECT *, regexp_extract_all(coalesce(doi, '') || ' ' || citation, 'https?://[^\s"''<>]+') AS urls, regexp_replace(regexp_extract(coalesce(doi, ''), '(10\.[0-9]+/\S+)', 1), '[.,;)]+$', '') AS d FROM p),
s AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _PEOPLE.items())} FROM customer), v AS (SELECT *, regexp_extract_all(coalesce(profile_url, '') || ' ' || coalesce(note, ''), 'https?://[^\s"''<>]+') AS urls FROM s),
dom AS (SELECT 'publication_url_domains' AS section, regexp_replace(regexp_extract(lower(x), 'https?://([^/]+)', 1), '^www\.', '') AS name FROM (SELECT unnest(urls) AS x FROM u) UNION ALL SELECT 'staff_url_domains', regexp_replace(regexp_extract(lower(x), 'https?://([^/]+)', 1), '^www\.', '') FROM (SELECT unnest(urls) AS x FROM v)),
dk AS (SELECT section, name, count(*) AS value, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, name) AS k FROM dom GROUP BY section, name), dc AS (SELECT d, count(*) AS n FROM u WHERE d <> '' GROUP BY d)
SELECT section, name, value FROM dk WHERE k <= 30 UNION ALL SELECT 'publication_year_counts', year, count(*) FROM u WHERE year <> '' GROUP BY year UNION ALL SELECT 'publication_type_counts', publication_type, count(*) FROM u WHERE publication_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'sample_dois', d, row_number() OVER (ORDER BY d) FROM dc QUALIFY row_number() OVER (ORDER BY d) <= 20
UNION ALL SELECT 'publication_key_frequency', unnest([{", ".join(f"'{n}'" for n in _PUB)}]), unnest([{", ".join(f"count({n})" for n in _PUB)}]) FROM u
UNION ALL SELECT 'counts', unnest(['publication_records', 'publications_with_titles', 'publications_with_doi', 'publications_without_doi', 'publications_with_any_url']), unnest([count(*), count_if(trim(title) <> ''), count_if(d <> ''), count_if(d = ''), count_if(len(urls) > 0)]) FROM u
UNION ALL SELECT 'counts', unnest(['staff_records', 'staff_with_profile_url', 'staff_with_any_external_url']), unnest([count(*), count_if(profile_url <> ''), count_if(len(urls) > 0)]) FROM v UNION ALL SELECT 'counts', 'staff_publication_links', count(*) FROM lineitem
UNION ALL SELECT 'counts', unnest(['unique_dois', 'duplicate_doi_occurrences']), unnest([count(*), CAST(sum(n - 1) AS BIGINT)]) FROM dc""")
def _(spark, sf):
    pubs = table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _PUB.items()])
    people = table(spark, sf, "customer").select(*[F.expr(e).alias(n) for n, e in _PEOPLE.items()])
    return R.readiness(pubs, table(spark, sf, "lineitem"), people)


_REC = {
    "record_id": "o_orderkey", "module_id": "o_custkey", "recommendation_level": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'High' WHEN '2' THEN ' moderate ' ELSE 'exploratory' END", "rank": "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 END",
    "foundation_type": "CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'semantic' ELSE 'none' END", "selection_group": "CASE WHEN o_orderkey % 2 = 0 THEN 'high' ELSE ' mixed' END", "has_shared_foundation": "o_orderkey % 3 = 0", "o_orderstatus": "o_orderstatus",
}
_ENRICHED = {
    "pipeline_status": "CASE p_partkey % 4 WHEN 0 THEN 'no_doi' WHEN 1 THEN 'metadata_not_found' WHEN 2 THEN 'enriched' END", "c": "CASE p_partkey % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'not_found' END", "o": "CASE p_partkey % 5 WHEN 0 THEN 'http_error' ELSE 'success' END",
    "c_hit": "p_partkey % 6 = 0", "o_hit": "p_partkey % 10 = 1", "abstract": "CASE WHEN p_partkey % 4 = 2 THEN p_name WHEN p_partkey % 4 = 1 THEN '' END", "n": "p_partkey % 3",
}
_REPORTS_SQL = f"""r AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _REC.items())} FROM orders), rl AS (SELECT *, lower(trim(recommendation_level)) AS lvl FROM r), d AS (SELECT * FROM rl WHERE o_orderstatus = 'F' AND lvl = 'high'), cs AS (SELECT * FROM rl WHERE o_orderstatus = 'F' AND record_id % 5 = 0),
f1 AS (SELECT module_id, arg_min(foundation_type, coalesce(rank, 999999) * 1000000000 + record_id) AS first FROM r GROUP BY module_id), e AS (SELECT {", ".join(f"{x} AS {n}" for n, x in _ENRICHED.items())} FROM part WHERE p_partkey % 11 > 0),
case_studies AS (SELECT 'counts' AS section, unnest(['recommendations_read', 'display_recommendations_written', 'case_studies_written']) AS name, unnest([(SELECT count(*) FROM r), (SELECT count(*) FROM d), (SELECT count(*) FROM cs)]) AS value UNION ALL SELECT 'recommendations_by_level', lvl, count(*) FROM rl GROUP BY lvl UNION ALL SELECT 'display_recommendations_by_level', lvl, count(*) FROM d GROUP BY lvl
 UNION ALL SELECT 'case_studies_by_level', lvl, count(*) FROM cs GROUP BY lvl UNION ALL SELECT 'case_studies_by_selection_group', trim(selection_group), count(*) FROM cs GROUP BY 2 UNION ALL SELECT 'case_studies_by_foundation_type', CASE WHEN has_shared_foundation THEN 'with_shared_foundation' ELSE 'without_shared_foundation' END, count(*) FROM cs GROUP BY 2),
foundation AS (SELECT 'recommendation_foundation_counts' AS section, unnest(['recommendations_processed', 'exact_foundation_recommendations', 'semantic_only_foundation_recommendations', 'no_foundation_recommendations']) AS name, CAST(unnest([count(*), count_if(foundation_type = 'exact'), count_if(foundation_type = 'semantic'), count_if(foundation_type = 'none')]) AS DOUBLE) AS value FROM r
 UNION ALL SELECT 'top_ranked_module_comparison', unnest(['modules_with_top_ranked_recommendation', 'exact_only_foundation_modules', 'exact_only_foundation_rate', 'exact_plus_semantic_foundation_modules', 'exact_plus_semantic_foundation_rate', 'modules_without_foundation', 'modules_without_foundation_rate', 'additional_modules_supported_by_semantic_evidence']),
 unnest([CAST(count(*) AS DOUBLE), count_if(first = 'exact'), round(count_if(first = 'exact') / count(*), 6), count_if(first <> 'none'), round(count_if(first <> 'none') / count(*), 6), count_if(first = 'none'), round(count_if(first = 'none') / count(*), 6), count_if(first = 'semantic')]) FROM f1),
enrichment AS (SELECT 'counts' AS section, unnest(['total_publication_records', 'records_in_output', 'remaining_records', 'processed_this_run', 'records_with_abstract', 'records_with_topics', 'records_with_keywords', 'records_with_expertise_text', 'crossref_cache_hits', 'openalex_cache_hits']) AS name,
 unnest([(SELECT count(*) FROM part), count(*), (SELECT count(*) FROM part) - count(*), 25, count_if(coalesce(abstract, '') <> ''), count_if(n > 0), count_if(n > 1), 0, count_if(c_hit), count_if(o_hit)]) AS value FROM e UNION ALL SELECT 'pipeline_status_counts', coalesce(pipeline_status, 'unknown'), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'crossref_status_counts', coalesce(c, 'unknown'), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'openalex_status_counts', o, count(*) FROM e GROUP BY 2),
review AS (SELECT 'counts' AS section, 'case_studies_exported' AS name, count(*) AS value FROM cs UNION ALL SELECT 'selection_groups', selection_group, count(*) FROM cs GROUP BY 2 UNION ALL SELECT 'recommendation_levels', recommendation_level, count(*) FROM cs GROUP BY 2 UNION ALL SELECT 'shared_foundation', CAST(has_shared_foundation AS VARCHAR), count(*) FROM cs GROUP BY 2)"""


def _recommendations(spark, sf):
    rows = table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in _REC.items()])
    final = F.col("o_orderstatus") == "F"
    return rows, rows.where(final & (R.level(F.col("recommendation_level")) == "high")), rows.where(final & (F.col("record_id") % 5 == 0))


@query("a23_reports", f"WITH {_REPORTS_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS report, section, name, CAST(value AS DOUBLE) AS value FROM {n}" for n in ("case_studies", "foundation", "enrichment", "review")))
def _(spark, sf):
    """The four reports: case studies, foundations, enrichment, review sheet."""
    rows, display, cases = _recommendations(spark, sf)
    p = table(spark, sf, "part")
    e = p.where("p_partkey % 11 > 0").select(*[F.expr(x).alias(n) for n, x in _ENRICHED.items()])
    names = lambda k: F.when(F.col("n") > k, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    records = e.select("pipeline_status", "abstract", names(0).alias("topic_names"), names(1).alias("keyword_names"), F.lit("").alias("expertise_text"), F.struct(F.col("c").alias("status"), F.col("c_hit").alias("from_cache")).alias("crossref"), F.struct(F.col("o").alias("status"), F.col("o_hit").alias("from_cache")).alias("openalex"))
    made = {"case_studies": R.case_study_report(rows, display, cases), "foundation": R.foundation_report(rows), "enrichment": R.enrichment_report(p, records, 25), "review": R.review_report(cases.withColumn("has_shared_foundation", F.col("has_shared_foundation").cast("string")))}
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("report"), "section", "name", F.col("value").cast("double").alias("value")) for k, df in made.items()])


_PAIRS = {
    "record_id": "o_orderkey", "module_id": "CAST(o_custkey AS STRING)", "collaboration_score": "o_totalprice / 500000e0", "combined_module_coverage": "(o_orderkey % 100) / 100e0", "best_individual_coverage": "(o_orderkey % 50) / 100e0",
    "complementarity_gain": "(o_orderkey % 100 - o_orderkey % 50) / 100e0", "staff_topic_overlap_ratio": "(o_custkey % 7) / 7e0", "explanation": "CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END", "some_": "o_orderkey % 4 > 0", "common": "o_custkey % 3 = 0",
}
_WANTED = ", ".join(f"('{s}', '{n}', '{at[0]}', '{at[1]}', '{at[2]}')" for s, names in R.CONSOLIDATED.items() for n, at in names.items())


@query("a25_consolidated_report", f"""WITH {_REPORTS_SQL}, p AS (SELECT {", ".join(f"{e} AS {n}" for n, e in _PAIRS.items())} FROM orders), t AS (SELECT l_suppkey AS s, l_partkey AS m, l_linenumber AS k FROM lineitem),
inputs AS (SELECT 'case_studies' AS input, section, name, CAST(value AS DOUBLE) AS value FROM case_studies UNION ALL SELECT 'semantic_foundation', section, name, value FROM foundation UNION ALL SELECT 'recommendations', 'recommendation_levels', lvl, count(*) FROM rl GROUP BY lvl UNION ALL SELECT 'recommendations', 'counts', 'recommendations_written', count(*) FROM r
 UNION ALL SELECT 'topic_profiles', 'counts', unnest(['assignment_records_read', 'staff_profiles', 'module_profiles', 'average_topics_per_staff', 'average_topics_per_module']), unnest([CAST(count(*) AS DOUBLE), count(DISTINCT s), count(DISTINCT m), round(count(DISTINCT s * 10 + k) / count(DISTINCT s), 4), round(count(DISTINCT m * 10 + k) / count(DISTINCT m), 4)]) FROM t
 UNION ALL SELECT 'quality_filter', w, unnest(['accepted_topics', 'rejected_topics']), unnest([count_if(k > 1), count_if(k = 1)]) FROM (SELECT DISTINCT 'staff' AS w, s AS i, k FROM t UNION ALL SELECT DISTINCT 'modules', m, k FROM t) GROUP BY w
 UNION ALL SELECT 'metadata', 'staff', 'coverage_rate', round((SELECT count(DISTINCT s) FROM t WHERE s IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)) / (SELECT count(DISTINCT s) FROM t), 6) UNION ALL SELECT 'metadata', 'modules', 'coverage_rate', round((SELECT count(DISTINCT m) FROM t WHERE m IN (SELECT p_partkey FROM part WHERE p_size > 10)) / (SELECT count(DISTINCT m) FROM t), 6)
 UNION ALL SELECT 'candidates', 'counts', unnest(['staff_profiles_loaded', 'module_profiles_loaded', 'modules_with_collaboration_candidates', 'modules_without_collaboration_candidates', 'pair_candidates_written']), unnest([(SELECT count(*) FROM supplier), (SELECT count(*) FROM part), count(DISTINCT m), (SELECT count(*) FROM part) - count(DISTINCT m), count(DISTINCT m * 1000000 + s)]) FROM t
 UNION ALL SELECT 'structural_validation', 'counts', unnest(['recommendations_checked', 'modules_with_recommendations', 'record_level_failure_count']), unnest([count(*), count(DISTINCT module_id), count_if(complementarity_gain <= 0) + count_if(NOT some_) + count_if(explanation IS NULL)]) FROM p
 UNION ALL SELECT 'structural_validation', 'rates', unnest(['positive_complementarity_rate', 'topic_evidence_rate', 'complete_explanation_rate', 'modules_with_shared_foundation_rate']), unnest([round(avg(CAST(complementarity_gain > 0 AS INT)), 6), round(avg(CAST(some_ AS INT)), 6), round(count(explanation) / count(*), 6), round(count(DISTINCT CASE WHEN common THEN module_id END) / count(DISTINCT module_id), 6)]) FROM p
 {" ".join(f"UNION ALL SELECT 'structural_validation', 'distribution:{m}', unnest(['min', 'max', 'mean', 'median']), unnest([min({m}), max({m}), avg({m}), median({m})]) FROM p" for m in R.MEASURES)}),
w AS (SELECT * FROM (VALUES {_WANTED}) AS x(ts, tn, input, section, name))
SELECT ts AS section, tn AS name, round(coalesce(value, 0), 6) AS value FROM w LEFT JOIN inputs USING (input, section, name) UNION ALL SELECT 'recommendation_levels', name, value FROM inputs WHERE section = 'recommendation_levels'
UNION ALL SELECT 'numeric_results:' || section[14:], name, round(value, 6) FROM inputs WHERE starts_with(section, 'distribution:')""")
def _(spark, sf):
    """Eight summaries gathered into one report; what none of them has is 0."""
    rows, display, cases = _recommendations(spark, sf)
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("m"), F.col("l_linenumber").alias("k"))
    people, parts = table(spark, sf, "supplier"), table(spark, sf, "part")

    def one_row(df: DataFrame, section: str, **values) -> DataFrame:
        told = df.agg(*[v.cast("double").alias(n) for n, v in values.items()])
        return told.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), F.col(n).alias("value")) for n in values])).alias("x")).select("x.*")

    n = F.count_distinct
    profiles = one_row(t, "counts", assignment_records_read=F.count("*"), staff_profiles=n("s"), module_profiles=n("m"), average_topics_per_staff=F.round(n("s", "k") / n("s"), 4), average_topics_per_module=F.round(n("m", "k") / n("m"), 4))
    topics = t.select(F.explode(F.array(F.struct(F.lit("staff").alias("section"), F.col("s").alias("i")), F.struct(F.lit("modules").alias("section"), F.col("m").alias("i")))).alias("x"), "k").select("x.*", "k").distinct()
    quality = topics.groupBy("section", F.when(F.col("k") > 1, "accepted_topics").otherwise("rejected_topics").alias("name")).agg(F.count("*").alias("value"))
    rate = lambda key, known, section: one_row(t.select(key).distinct().join(known, key, "left"), section, coverage_rate=F.round(F.count("ok") / F.count("*"), 6))
    metadata = rate("s", people.where("s_acctbal > 0").select(F.col("s_suppkey").alias("s"), F.lit(1).alias("ok")), "staff").unionByName(rate("m", parts.where("p_size > 10").select(F.col("p_partkey").alias("m"), F.lit(1).alias("ok")), "modules"))
    with_pairs = t.groupBy("m").agg(n("s").alias("pairs"))
    met = parts.select(F.col("p_partkey").alias("m")).join(with_pairs, "m", "left")
    candidates = one_row(met, "counts", module_profiles_loaded=F.count("*"), modules_with_collaboration_candidates=F.count("pairs"), modules_without_collaboration_candidates=F.count_if(F.col("pairs").isNull()), pair_candidates_written=F.sum("pairs")).unionByName(one_row(people, "counts", staff_profiles_loaded=F.count("*")))
    recommendations = R.counted(rows, R.fact("recommendation_levels", R.level(F.col("recommendation_level")))).unionByName(R.counted(rows, R.fact("counts", "recommendations_written")))
    empty = F.array().cast("array<string>")
    listed = lambda ok: F.when(ok, F.array(F.lit("x"))).otherwise(empty)
    pairs = table(spark, sf, "orders").select(*[F.expr(e).alias(c) for c, e in _PAIRS.items()]).withColumns({"shared_module_topics": listed(F.col("some_")), "complementary_module_topics": empty, "shared_foundation": listed(F.col("common"))})
    w = Window.partitionBy("module_id").orderBy("record_id")
    a_pair = pairs.withColumns({"staff_a_id": F.lit("a"), "staff_b_id": F.concat(F.lit("b"), F.col("record_id").cast("string")), "module_title": F.lit("-"), "staff_a_name": F.lit("-"), "staff_b_name": F.lit("-"), "recommendation_level": F.lit("high"), "rank": F.row_number().over(w)})
    kinds = ("non_positive_complementarity_gain", "missing_topic_evidence", "missing_explanation")
    structure = R.structural_report(pairs, rules.pair_failures(a_pair).where(F.col("failure").isin(*kinds)))
    found = R.consolidated({"topic_profiles": profiles, "quality_filter": quality, "candidates": candidates, "recommendations": recommendations, "metadata": metadata, "case_studies": R.case_study_report(rows, display, cases), "structural_validation": structure, "semantic_foundation": R.foundation_report(rows)})
    return found.select("section", "name", F.round("value", 6).alias("value"))
