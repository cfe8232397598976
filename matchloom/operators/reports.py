"""Reports: section, name, value rows. What a report counts is said as facts where a record is read, so a table is scanned once
and one aggregate, combined before it is exchanged, counts all sections of it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions import text as T

#: What stands in an identity's field without being one.
NO_IDENTITY = ("", "none", "null", "n/a", "na", "tbc")


def fact(section: str, name: Column | str) -> Column:
    """An array of one fact, none where the name is null."""
    value = F.lit(name) if isinstance(name, str) else name.cast("string")
    return F.when(value.isNotNull(), F.array(F.struct(F.lit(section).alias("section"), value.alias("name")))).otherwise(F.array().cast("array<struct<section:string,name:string>>"))


def facts(section: str, names: Column) -> Column:
    """Facts of an array of names."""
    return F.transform(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.struct(F.lit(section).alias("section"), x.alias("name")))


def counted(df: DataFrame, *told: Column) -> DataFrame:
    """section, name, value: how often each fact was told."""
    return df.select(F.explode(F.concat(*told)).alias("f")).groupBy("f.section", "f.name").agg(F.count("*").alias("value"))


def said(blank_is_null: Column) -> Column:
    return F.nullif(T.collapse(blank_is_null.cast("string")), F.lit(""))


def with_zeros(found: DataFrame, section: str, names: Sequence[str]) -> DataFrame:
    """found, with a row of 0 for each of these names that was never told."""
    zeros = found.sparkSession.createDataFrame([(section, n, 0) for n in names], "section string, name string, value long")
    return found.unionByName(zeros).groupBy("section", "name").agg(F.max("value").alias("value"))


# ---- identities ----------------------------------------------------------------------------------


def identity(cms: Column, module_id: Column, code: Column, slug: Column, title: Column, description: Column) -> Column:
    """A module's identity: the first of content id, id, code and slug that says something, else title and the description's first 150 characters."""

    def known(prefix: str, c: Column) -> Column:
        folded = F.lower(T.collapse(c.cast("string")))
        return F.when(~folded.isin(*NO_IDENTITY), F.concat(F.lit(f"{prefix}:"), folded))

    last = F.concat(F.lit("title:"), F.lower(T.collapse(title)), F.lit("|description:"), F.substring(F.lower(T.collapse(description)), 1, 150))
    return F.coalesce(known("cms", cms), known("id", module_id), known("code", code), known("slug", slug), last)


def identity_audit(modules: DataFrame, identity_of: Column) -> DataFrame:
    """How many records, identities and repeats there are, and how many identities come from each level."""
    per = modules.groupBy(identity_of.alias("i")).agg(F.count("*").alias("n")).withColumn("level", F.split("i", ":")[0])
    total = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("identities"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"))
    rows = total.select(F.explode(F.array(*[F.struct(F.lit("counts").alias("section"), F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in ("records", "identities", "repeats")])).alias("x")).select("x.*")
    return rows.unionByName(per.groupBy("level").agg(F.count("*").alias("value")).select(F.lit("levels").alias("section"), F.col("level").alias("name"), "value"))


# ---- readiness for enrichment --------------------------------------------------------------------


def _domains(urls: Column) -> Column:
    return F.filter(F.transform(urls, lambda u: T.domain(u)), lambda d: d != "")


def readiness(publications: DataFrame, links: DataFrame, staff: DataFrame, most: int = 30, samples: int = 20) -> DataFrame:
    """DOIs, addresses, domains, years, types and filled columns of publications, and addresses of staff.

    publications: title, year, publication_type, doi and the texts that may hold addresses; staff: profile_url and others. The commonest `most` domains and the
    first `samples` DOIs are what the report shows (of equal counts by name); everything else is counted in full.
    """
    names = publications.columns
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in names])
    urls, doi = T.urls(text), F.nullif(T.doi(F.concat_ws(" ", *[F.col(c) for c in ("doi", "doi_url", "citation") if c in names])), F.lit(""))
    when = lambda ok, name: fact("counts", F.when(ok, name))
    pub = counted(
        publications, fact("counts", "publication_records"), when(said(F.col("title")).isNotNull(), "publications_with_titles"), when(doi.isNotNull(), "publications_with_doi"), when(doi.isNull(), "publications_without_doi"), when(F.size(urls) > 0, "publications_with_any_url"),
        fact("publication_year_counts", said(F.col("year"))), fact("publication_type_counts", said(F.col("publication_type"))), facts("publication_url_domains", _domains(urls)), fact("dois", doi), facts("publication_key_frequency", F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])),
    )
    own = T.urls(F.concat_ws(" ", *[F.col(c).cast("string") for c in staff.columns]))
    people = counted(staff, fact("counts", "staff_records"), when(said(F.col("profile_url")).isNotNull(), "staff_with_profile_url"), when(F.size(own) > 0, "staff_with_any_external_url"), facts("staff_url_domains", _domains(own)))
    both = pub.unionByName(people).unionByName(links.agg(F.count("*").alias("value")).select(F.lit("counts").alias("section"), F.lit("staff_publication_links").alias("name"), "value"))
    doi_rows = F.col("section") == "dois"
    unique = both.where(doi_rows).agg(F.count("*").alias("unique_dois"), F.coalesce(F.sum(F.col("value") - 1), F.lit(0)).alias("duplicate_doi_occurrences"))
    unique = unique.select(F.explode(F.array(*[F.struct(F.lit("counts").alias("section"), F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("unique_dois", "duplicate_doi_occurrences")])).alias("x")).select("x.*")
    first = both.where(doi_rows).orderBy("name").limit(samples).select(F.lit("sample_dois").alias("section"), "name", F.row_number().over(Window.orderBy("name")).cast("long").alias("value"))
    ranked = both.where(F.col("section").endswith("_domains")).withColumn("__k", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("value"), "name")))
    rest = both.where(~doi_rows & ~F.col("section").endswith("_domains"))
    return rest.unionByName(ranked.where(F.col("__k") <= most).drop("__k")).unionByName(unique).unionByName(first)


# ---- summaries of recommendations ----------------------------------------------------------------


def level(c: Column) -> Column:
    return F.lower(T.collapse(c))


def case_study_report(recommendations: DataFrame, display: DataFrame, cases: DataFrame) -> DataFrame:
    """How many recommendations were read, shown and chosen as cases, by level; cases also by group and by whether they share a foundation."""
    of = lambda c: level(F.col(c))
    parts = [
        counted(recommendations, fact("counts", "recommendations_read"), fact("recommendations_by_level", of("recommendation_level"))),
        counted(display, fact("counts", "display_recommendations_written"), fact("display_recommendations_by_level", of("recommendation_level"))),
        counted(cases, fact("counts", "case_studies_written"), fact("case_studies_by_level", of("recommendation_level")), fact("case_studies_by_selection_group", F.trim(F.coalesce("selection_group", F.lit("")))),
                fact("case_studies_by_foundation_type", F.when(F.coalesce("has_shared_foundation", F.lit(False)), "with_shared_foundation").otherwise("without_shared_foundation"))),
    ]
    return with_zeros(reduce(DataFrame.unionByName, parts), "counts", ["recommendations_read", "display_recommendations_written", "case_studies_written"])


def foundation_report(records: DataFrame) -> DataFrame:
    """By foundation type, of all recommendations and of each module's first (by rank and record_id), with rates of the latter.

    records: module_id, rank, record_id, foundation_type (exact, semantic or none). One aggregate a module, one over these.
    """
    types = ("exact", "semantic", "none")
    per = records.groupBy("module_id").agg(F.count("*").alias("n"), F.min_by("foundation_type", F.struct(F.coalesce("rank", F.lit(999_999)), "record_id")).alias("first"), *[F.count_if(F.col("foundation_type") == t).alias(t) for t in types])
    top = lambda *ts: F.count_if(F.col("first").isin(*ts) & F.col("module_id").isNotNull())
    n = F.count("module_id")
    rate = lambda x: F.round(F.when(n == 0, 0.0).otherwise(x / n), 6)
    values = {
        ("recommendation_foundation_counts", "recommendations_processed"): F.coalesce(F.sum("n"), F.lit(0)), **{("recommendation_foundation_counts", name): F.coalesce(F.sum(t), F.lit(0)) for t, name in zip(types, ("exact_foundation_recommendations", "semantic_only_foundation_recommendations", "no_foundation_recommendations"))},
        **{("top_ranked_module_comparison", name): v for name, v in (
            ("modules_with_top_ranked_recommendation", n), ("exact_only_foundation_modules", top("exact")), ("exact_only_foundation_rate", rate(top("exact"))), ("exact_plus_semantic_foundation_modules", top("exact", "semantic")),
            ("exact_plus_semantic_foundation_rate", rate(top("exact", "semantic"))), ("modules_without_foundation", top("none")), ("modules_without_foundation_rate", rate(top("none"))), ("additional_modules_supported_by_semantic_evidence", top("semantic")),
        )},
    }
    told = per.agg(*[v.cast("double").alias(f"__{i}") for i, v in enumerate(values.values())])
    return told.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("name"), F.col(f"__{i}").alias("value")) for i, (s, m) in enumerate(values)])).alias("x")).select("x.*")


def enrichment_report(publications: DataFrame, records: DataFrame, processed: int) -> DataFrame:
    """What a run left: totals, statuses of the pipeline and of both providers, filled fields, cache hits.

    records: pipeline_status, crossref and openalex (status and from_cache), abstract, topic_names, keyword_names, expertise_text.
    """
    c = F.col
    filled = lambda name, ok: fact("counts", F.when(F.coalesce(ok, F.lit(False)), f"records_with_{name}"))
    found = counted(
        records, fact("counts", "records_in_output"), fact("pipeline_status_counts", F.coalesce(c("pipeline_status"), F.lit("unknown"))), *[fact(f"{p}_status_counts", F.coalesce(c(p)["status"], F.lit("unknown"))) for p in ("crossref", "openalex")],
        *[fact("counts", F.when(F.coalesce(c(p)["from_cache"], F.lit(False)), f"{p}_cache_hits")) for p in ("crossref", "openalex")],
        filled("abstract", c("abstract") != ""), filled("topics", F.size("topic_names") > 0), filled("keywords", F.size("keyword_names") > 0), filled("expertise_text", c("expertise_text") != ""),
    )
    found = found.unionByName(counted(publications, fact("counts", "total_publication_records")))
    found = with_zeros(found, "counts", ["total_publication_records", "records_in_output", *[f"records_with_{n}" for n in ("abstract", "topics", "keywords", "expertise_text")], "crossref_cache_hits", "openalex_cache_hits"])
    of = lambda name: F.sum(F.when((c("section") == "counts") & (c("name") == name), c("value")).otherwise(0))
    left = found.agg((of("total_publication_records") - of("records_in_output")).alias("value")).select(F.lit("counts").alias("section"), F.lit("remaining_records").alias("name"), "value")
    return found.unionByName(left).unionByName(found.limit(1).select(F.lit("counts").alias("section"), F.lit("processed_this_run").alias("name"), F.lit(processed).cast("long").alias("value")))


def review_report(rows: DataFrame) -> DataFrame:
    """Exported cases by group, level and foundation."""
    found = counted(rows, fact("counts", "case_studies_exported"), fact("selection_groups", F.coalesce("selection_group", F.lit(""))), fact("recommendation_levels", F.coalesce("recommendation_level", F.lit(""))), fact("shared_foundation", F.coalesce("has_shared_foundation", F.lit(""))))
    return with_zeros(found, "counts", ["case_studies_exported"])


#: The consolidated report's sections, and where each of their numbers stands: (input, section, name).
CONSOLIDATED = {
    "data_and_profile_coverage": {
        "topic_assignments_processed": ("topic_profiles", "counts", "assignment_records_read"), "staff_topic_profiles": ("topic_profiles", "counts", "staff_profiles"), "module_topic_profiles": ("topic_profiles", "counts", "module_profiles"),
        "average_topics_per_staff": ("topic_profiles", "counts", "average_topics_per_staff"), "average_topics_per_module": ("topic_profiles", "counts", "average_topics_per_module"),
        "staff_topics_retained_after_filtering": ("quality_filter", "staff", "accepted_topics"), "staff_topics_rejected_by_filtering": ("quality_filter", "staff", "rejected_topics"), "module_topics_retained_after_filtering": ("quality_filter", "modules", "accepted_topics"), "module_topics_rejected_by_filtering": ("quality_filter", "modules", "rejected_topics"),
        "staff_metadata_coverage_rate": ("metadata", "staff", "coverage_rate"), "module_metadata_coverage_rate": ("metadata", "modules", "coverage_rate"),
    },
    "candidate_generation": {n: ("candidates", "counts", n) for n in ("staff_profiles_loaded", "module_profiles_loaded", "modules_with_collaboration_candidates", "modules_without_collaboration_candidates")} | {"pair_candidates_before_limit": ("candidates", "counts", "pair_candidates_before_per_module_limit"), "collaboration_candidates_written": ("candidates", "counts", "pair_candidates_written")},
    "recommendation_output": {"recommendations_written": ("recommendations", "counts", "recommendations_written"), "strict_display_recommendations": ("case_studies", "counts", "display_recommendations_written"), "selected_case_studies": ("case_studies", "counts", "case_studies_written")},
    "structural_validation": {n: ("structural_validation", "counts", n) for n in ("recommendations_checked", "modules_with_recommendations", "record_level_failure_count")} | {n: ("structural_validation", "rates", n) for n in ("positive_complementarity_rate", "topic_evidence_rate", "complete_explanation_rate", "modules_with_shared_foundation_rate")},
    "semantic_shared_foundation_analysis": {n: ("semantic_foundation", "recommendation_foundation_counts", n) for n in ("recommendations_processed", "exact_foundation_recommendations", "semantic_only_foundation_recommendations", "no_foundation_recommendations")} | {"top_ranked_modules": ("semantic_foundation", "top_ranked_module_comparison", "modules_with_top_ranked_recommendation")} | {n: ("semantic_foundation", "top_ranked_module_comparison", n) for n in ("exact_only_foundation_rate", "exact_plus_semantic_foundation_rate", "additional_modules_supported_by_semantic_evidence")},
}
INPUTS = ("topic_profiles", "quality_filter", "candidates", "recommendations", "metadata", "case_studies", "structural_validation", "semantic_foundation")


def consolidated(inputs: dict[str, DataFrame]) -> DataFrame:
    """section, name, value of the consolidated report, from the eight summaries (section, name, value) by name; a number that an input lacks is 0.

    Levels of recommendations and the measures' distributions are taken over as they are.
    """
    if missing := sorted(set(INPUTS) - set(inputs)):
        raise ValueError(f"no summary named {missing}")
    told = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("input"), "section", "name", F.col("value").cast("double").alias("value")) for k, df in inputs.items()])
    wanted = told.sparkSession.createDataFrame([(s, n, *at) for s, names in CONSOLIDATED.items() for n, at in names.items()], "to_section string, to_name string, input string, section string, name string")
    named = F.broadcast(wanted).join(told, ["input", "section", "name"], "left").groupBy(F.col("to_section").alias("section"), F.col("to_name").alias("name")).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))
    levels = told.where("input = 'recommendations' and section = 'recommendation_levels'").select(F.lit("recommendation_levels").alias("section"), "name", "value")
    numbers = told.where("input = 'structural_validation' and startswith(section, 'distribution:')").select(F.concat(F.lit("numeric_results:"), F.substring("section", 14, 1_000)).alias("section"), "name", "value")
    return named.unionByName(levels).unionByName(numbers)


MEASURES = ("collaboration_score", "combined_module_coverage", "best_individual_coverage", "complementarity_gain", "staff_topic_overlap_ratio")


def structural_report(pairs: DataFrame, failures: DataFrame, key: str = "record_id") -> DataFrame:
    """Counts, rates and distributions of pair recommendations, and the failures that `rules.pair_failures` found of them."""
    c, share = F.col, lambda ok: F.round(F.coalesce(F.avg(F.coalesce(ok, F.lit(False)).cast("double")), F.lit(0.0)), 6)
    size = lambda x: F.coalesce(F.size(c(x)), F.lit(0))
    modules = F.nullif(T.collapse(c("module_id").cast("string")), F.lit(""))
    shared = F.count_distinct(F.when(size("shared_foundation") > 0, modules))
    values = {
        ("counts", "recommendations_checked"): F.count("*"), ("counts", "modules_with_recommendations"): F.count_distinct(modules), ("rates", "positive_complementarity_rate"): share(c("complementarity_gain") > 0),
        ("rates", "topic_evidence_rate"): share((size("shared_module_topics") > 0) | (size("complementary_module_topics") > 0)), ("rates", "complete_explanation_rate"): share(T.collapse(c("explanation")) != ""),
        ("rates", "modules_with_shared_foundation_rate"): F.round(F.when(F.count_distinct(modules) == 0, 0.0).otherwise(shared / F.count_distinct(modules)), 6),
        **{(f"distribution:{m}", n): f(c(m)) for m in MEASURES for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("median", F.median))},
    }
    told = pairs.agg(*[v.cast("double").alias(f"__{i}") for i, v in enumerate(values.values())])
    rows = told.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(f"__{i}").alias("value")) for i, (s, n) in enumerate(values)])).alias("x")).select("x.*")
    total = failures.agg(F.count("*").cast("double").alias("value")).select(F.lit("counts").alias("section"), F.lit("record_level_failure_count").alias("name"), "value")
    each = failures.groupBy("failure").agg(F.count("*").cast("double").alias("value")).select(F.lit("failure_counts").alias("section"), F.col("failure").alias("name"), "value")
    return rows.unionByName(total).unionByName(each)
