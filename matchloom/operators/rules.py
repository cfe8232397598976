"""Named checks of outputs: of pair recommendations, of ranked results with their gates, of the processed tables.

Rules on one record are columns. Rules across the rows of a module (ranks, order of scores, repeated pairs) come from
one window over all of them. Every check has a name, and a row (or record) gets a row for each check it breaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import is_blank

#: Levels of a recommendation, the length of a full list, statuses that need no paths.
LEVELS = ("high", "moderate", "exploratory")
TOP_K = 5
NO_PATHS = ("module_hierarchy_unresolved", "module_missing_semantic_embedding")


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def pair_rules(tolerance: float = 1e-5) -> dict[str, Column]:
    """Name -> whether a pair's row breaks it. Missing numbers count as 0 and missing texts as empty."""
    a, b, title, said = _text("staff_a_id"), _text("staff_b_id"), _text("module_title"), _text("explanation")
    both, best, gain = (_number(c) for c in ("combined_module_coverage", "best_individual_coverage", "complementarity_gain"))
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    unsaid = lambda c: (said != "") & ~F.contains(F.lower(said), F.lower(_text(c)))
    return {
        "missing_module_id": _text("module_id") == "", "missing_staff_a_id": a == "", "missing_staff_b_id": b == "", "self_pair": (a != "") & (a == b),
        "missing_module_title": title == "", "missing_staff_a_name": _text("staff_a_name") == "", "missing_staff_b_name": _text("staff_b_name") == "",
        "invalid_recommendation_level": ~F.lower(_text("recommendation_level")).isin(*LEVELS), "invalid_rank": F.coalesce(F.col("rank").cast("int"), F.lit(0)) < 1,
        "negative_collaboration_score": _number("collaboration_score") < 0, "invalid_combined_coverage_range": (both < 0) | (both > 1 + tolerance),
        "invalid_individual_coverage_range": (best < 0) | (best > 1 + tolerance), "non_positive_complementarity_gain": gain <= 0,
        "inconsistent_complementarity_gain": F.abs(gain - (both - best)) > tolerance, "pair_coverage_less_than_best_individual": both + tolerance < best,
        "missing_topic_evidence": (size("shared_module_topics") <= 0) & (size("complementary_module_topics") <= 0), "missing_explanation": said == "",
        "module_title_missing_from_explanation": unsaid("module_title"), "staff_a_name_missing_from_explanation": unsaid("staff_a_name"), "staff_b_name_missing_from_explanation": unsaid("staff_b_name"),
    }


def pair_failures(pairs: DataFrame, key: str = "record_id", tolerance: float = 1e-5) -> DataFrame:
    """key, failure: a row for each check that a pair breaks, alone or among its module's.

    Ranks of a module must be 1, 2, 3 and so on; then scores must not rise with the rank. Of equal pairs in a
    module, in either order, the second and later ones (by rank and key) are repeated. One window on the module, one on the pair.
    """
    c, blank = F.col, _text("module_id") == ""
    w = Window.partitionBy("__module")
    rank = F.coalesce(c("rank").cast("int"), F.lit(999_999))
    ordered = w.orderBy("__rank", key)
    x, y = _text("staff_a_id"), _text("staff_b_id")
    seen = pairs.withColumns({"__module": F.when(~blank, _text("module_id")), "__rank": rank, "__one": F.least(x, y), "__two": F.greatest(x, y)})
    seen = seen.withColumns({"__place": F.row_number().over(ordered), "__last": F.lag(_number("collaboration_score")).over(ordered)})
    gap = F.coalesce(c("rank").cast("int"), F.lit(0)) != c("__place")
    seen = seen.withColumns({"__gaps": F.bool_or(gap).over(w), "__rises": F.bool_or(F.coalesce(c("__last") + 1e-12 < _number("collaboration_score"), F.lit(False))).over(w)})
    seen = seen.withColumn("__again", F.row_number().over(Window.partitionBy("__module", "__one", "__two").orderBy("__rank", key)) > 1)
    across = {"non_contiguous_or_duplicate_ranks": ~blank & c("__gaps"), "rank_score_order_inconsistent": ~blank & ~c("__gaps") & c("__rises"), "duplicate_pair": ~blank & (x != "") & (y != "") & c("__again")}
    named = [F.when(broken, F.lit(name)) for name, broken in {**pair_rules(tolerance), **across}.items()]
    return seen.select(key, F.explode(F.filter(F.array(*named), lambda v: v.isNotNull())).alias("failure"))


#: What a ranked result looks like.
RESULT = (
    "module_id string, decision_status string, review_required boolean, module_hierarchy_paths array<string>, "
    "recommendations array<struct<rank:int,staff_id:string,matched_internal_paths:array<string>,staff_hierarchy_paths:array<string>,gate:struct<passed:boolean,reason:string>>>, "
    "rejected_candidates array<struct<staff_id:string,gate:struct<passed:boolean,reason:string>>>, gate_summary struct<passed_count:int,failed_count:int,gate_reason_counts:map<string,int>>"
)


def _issue(name: str, *details: tuple[str, Column]) -> Column:
    """The name, and what is given with it: name:key=value."""
    return F.concat(F.lit(name), *[F.concat(F.lit(f":{k}=" if k else ":"), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in details])


def result_findings(results: DataFrame, k: int = TOP_K) -> DataFrame:
    """The columns of results with issues and warnings, arrays of texts: all that is wrong within a record. No row leaves its task."""
    c = F.col
    recs, rejected = (F.coalesce(x, F.array()) for x in (c("recommendations"), c("rejected_candidates")))
    n, m, status = F.size(recs), F.size(rejected), F.coalesce("decision_status", F.lit(""))
    flagged = F.coalesce("review_required", F.lit(False))
    none = lambda x: x.isNull() | (F.size(x) <= 0)
    passed = lambda r: F.coalesce(r["gate"]["passed"], F.lit(False))
    each = lambda name, broken: F.transform(F.filter(recs, broken), lambda r: _issue(name, ("rank", r["rank"]), ("staff_id", r["staff_id"])))
    ranks = F.transform(recs, lambda r: r["rank"])
    staff_ids = F.transform(recs, lambda r: F.coalesce(r["staff_id"], F.lit("")))
    reasons = F.filter(F.concat(F.transform(recs, lambda r: r["gate"]["reason"]), F.transform(rejected, lambda r: r["gate"]["reason"])), lambda x: F.coalesce(x, F.lit("")) != "")
    counted = F.array_sort(F.transform(F.array_distinct(reasons), lambda x: F.struct(x.alias("key"), F.size(F.filter(reasons, lambda y: y == x)).alias("value"))))
    told = F.array_sort(F.transform(F.map_entries(F.coalesce(c("gate_summary.gate_reason_counts"), F.create_map().cast("map<string,int>"))), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))
    good, bad = (F.coalesce(c(f"gate_summary.{x}"), F.lit(0)) for x in ("passed_count", "failed_count"))
    is_ = lambda s: status == s
    one = lambda broken, issue: F.when(broken, F.array(issue if isinstance(issue, Column) else F.lit(issue))).otherwise(F.array().cast("array<string>"))
    issues = F.concat(
        one(n > k, _issue("recommendation_count_exceeds_top_k", ("", n))),
        one((n > 0) & ~ranks.eqNullSafe(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))), _issue("invalid_rank_sequence", ("", F.concat(F.lit("["), F.array_join(ranks, ", ", "None"), F.lit("]"))))),
        one(F.size(F.array_distinct(staff_ids)) < n, "duplicate_staff_in_recommendations"),
        each("missing_matched_internal_paths", lambda r: none(r["matched_internal_paths"])), each("returned_recommendation_failed_gate", lambda r: ~passed(r)),
        F.transform(F.filter(rejected, passed), lambda r: F.lit("rejected_candidate_marked_passed")),
        one(good != n, _issue("gate_summary_passed_mismatch", ("reported", good), ("actual", n))), one(bad != m, _issue("gate_summary_failed_mismatch", ("reported", bad), ("actual", m))),
        one(~told.eqNullSafe(counted), "gate_reason_counts_mismatch"),
        one(is_("hierarchy_internal_ranked") & (n != k), "hierarchy_internal_ranked_without_top_k"), one(is_("hierarchy_internal_ranked") & flagged, "hierarchy_internal_ranked_marked_review_required"),
        one(is_("limited_hierarchy_internal_pool") & (n >= k), "limited_pool_has_top_k_or_more"),
        one(is_("all_internal_candidates_failed_gate") & (n != 0), "gate_failed_module_returned_recommendations"), one(is_("all_internal_candidates_failed_gate") & ~flagged, "gate_failed_module_not_marked_review_required"),
        one(is_("no_hierarchy_internal_staff") & (n != 0), "no_hierarchy_internal_staff_has_recommendations"), one(is_("no_hierarchy_internal_staff") & ~flagged, "no_hierarchy_internal_staff_not_marked_review_required"),
    )
    warnings = F.concat(one(none(c("module_hierarchy_paths")) & ~status.isin(*NO_PATHS), "module_hierarchy_paths_missing"), each("missing_staff_hierarchy_paths", lambda r: none(r["staff_hierarchy_paths"])))
    return results.withColumns({"issues": issues, "warnings": warnings})


# ---- the processed tables ------------------------------------------------------------------------


def _lacking(child: DataFrame, key: str, parent: DataFrame, other: str) -> DataFrame:
    """Distinct values of child[key] that parent[other] lacks; a blank is lacking too."""
    known = parent.where(~is_blank(F.col(other).cast("string"))).select(F.col(other).alias("__k")).distinct()
    return child.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("value")).distinct().join(known, F.col("value") == F.col("__k").cast("string"), "left_anti")


#: Columns whose blanks are counted.
STAFF_QUALITY = {"missing_full_name": "full_name", "missing_department": "department_name", "missing_college": "college_name", "missing_matching_text": "matching_text_without_teaching", "missing_profile_url": "profile_url"}
MODULE_QUALITY = {"missing_title": "module_title", "missing_description": "description", "missing_matching_text": "matching_text", "missing_department": "departments", "missing_module_code": "module_code"}


def processed_report(staff: DataFrame, courses: DataFrame, modules: DataFrame, course_links: DataFrame, publications: DataFrame, publication_links: DataFrame, teaching: DataFrame) -> DataFrame:
    """section, name, value: counts of rows, blanks and lacking references of all tables, and the eight checks (1: passed) and whether all passed.

    Every table is read by a few aggregates; references are anti-joins on distinct keys.
    """
    tables = {"staff": staff, "courses": courses, "modules": modules, "course_module_links": course_links, "publications": publications, "staff_publication_links": publication_links, "teaching_evidence": teaching}

    def rows(df: DataFrame, values: dict[tuple[str, str], Column]) -> DataFrame:
        """A row for each (section, name) of one aggregate over df."""
        told = df.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(f"__{i}") for i, v in enumerate(values.values())])
        return told.select(F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(f"__{i}").alias("value")) for i, (s, n) in enumerate(values)])).alias("x")).select("x.*")

    def blanks(df: DataFrame, section: str, columns: dict[str, str]) -> dict[tuple[str, str], Column]:
        kinds = dict(df.dtypes)
        empty = {n: (F.col(c).isNull() | (F.size(c) == 0)) if kinds[c].startswith("array") else is_blank(F.col(c).cast("string")) for n, c in columns.items()}
        return {(section, n): F.count_if(x) for n, x in empty.items()}

    def repeated(df: DataFrame, key: str, name: str) -> DataFrame:
        many = df.where(~is_blank(F.col(key).cast("string"))).groupBy(key).count().where("count > 1")
        return rows(many, {("repeated", name): F.count("*")})

    anti = {
        "invalid_course_ids": _lacking(course_links, "course_id", courses, "course_id"), "invalid_module_ids": _lacking(course_links, "module_id", modules, "module_id"),
        "invalid_publication_staff_ids": _lacking(publication_links, "staff_id", staff, "staff_id"), "invalid_publication_ids": _lacking(publication_links, "publication_id", publications, "publication_id"),
        "invalid_teaching_staff_ids": _lacking(teaching, "staff_id", staff, "staff_id"), "modules_without_course_links": _lacking(modules.where(~is_blank(F.col("module_id").cast("string"))), "module_id", course_links, "module_id"),
        "courses_without_module_links": _lacking(courses.where(~is_blank(F.col("course_id").cast("string"))), "course_id", course_links, "course_id"),
    }
    code = lambda c: F.upper(F.trim(c))
    taught = teaching.select(F.explode("module_codes").alias("c")).select(code(F.col("c")).alias("code")).where("code <> ''").distinct().withColumn("t", F.lit(1))
    known = modules.where(~is_blank(F.col("module_code"))).select(code(F.col("module_code")).alias("code")).distinct().withColumn("m", F.lit(1))
    codes = taught.join(known, "code", "full")
    quality = {"staff": blanks(staff, "staff_quality", STAFF_QUALITY), "modules": blanks(modules, "module_quality", MODULE_QUALITY)}
    parts = [
        *[rows(df, {("counts", n): F.count("*"), **quality.get(n, {})}) for n, df in tables.items()],
        *[repeated(tables[t], k, n) for t, k, n in (("staff", "staff_id", "staff_ids"), ("courses", "course_id", "course_ids"), ("modules", "module_id", "module_ids"), ("publications", "publication_id", "publication_ids"))],
        *[rows(df, {("relationship_errors", n): F.count("*")}) for n, df in anti.items()],
        rows(codes, {("teaching_codes", n): v for n, v in (("unique_teaching_codes", F.count("t")), ("unique_current_module_codes", F.count("m")), ("matched_teaching_codes", F.count_if(F.col("t").isNotNull() & F.col("m").isNotNull())), ("unmatched_teaching_codes", F.count_if(F.col("m").isNull())))}),
    ]
    told = reduce(DataFrame.unionByName, parts).agg(F.collect_list(F.struct("section", "name", "value")).alias("r"))  # some thirty counts in one row
    none_of = lambda *names: ~F.exists("r", lambda x: x["section"].isin("repeated", "relationship_errors") & x["name"].isin(*names) & (x["value"] > 0))
    checks = {
        "staff_ids_unique": none_of("staff_ids"), "course_ids_unique": none_of("course_ids"), "module_ids_unique": none_of("module_ids"), "publication_ids_unique": none_of("publication_ids"),
        "course_module_references_valid": none_of("invalid_course_ids", "invalid_module_ids"), "staff_publication_references_valid": none_of("invalid_publication_staff_ids", "invalid_publication_ids"),
        "teaching_staff_references_valid": none_of("invalid_teaching_staff_ids"), "all_modules_linked_to_courses": none_of("modules_without_course_links"),
    }
    checks["validation_passed"] = reduce(Column.__and__, checks.values())
    judged = F.array(*[F.struct(F.lit("checks").alias("section"), F.lit(n).alias("name"), ok.cast("long").alias("value")) for n, ok in checks.items()])
    return told.select(F.explode(F.concat("r", judged)).alias("x")).select("x.*")
