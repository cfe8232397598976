"""Every named check is broken somewhere; records with nulls everywhere get a defined answer."""

from matchloom.operators import rules
from matchloom.plans import catalog
from tests.oracle import SF


def test_every_pair_check_has_a_row(spark):
    found = {r["failure"] for r in catalog.queries()["p26_pair_checks"](spark, SF).select("failure").distinct().collect()}
    assert found == set(rules.pair_rules()) | {"non_contiguous_or_duplicate_ranks", "rank_score_order_inconsistent", "duplicate_pair"} and len(rules.pair_rules()) == 20


def test_every_result_check_has_a_row(spark):
    rows = catalog.queries()["p27_result_checks"](spark, SF).collect()
    issues = {i.split(":")[0] for r in rows for i in r["issues"].split(" | ") if i}
    assert len(issues) == 16 and {w.split(":")[0] for r in rows for w in r["warnings"].split(" | ") if w} == {"module_hierarchy_paths_missing", "missing_staff_hierarchy_paths"}


def test_every_table_check_passes_and_fails(spark):
    checks = {r["name"]: r["value"] for r in catalog.queries()["a7_processed_report"](spark, SF).where("section = 'checks'").collect()}
    assert len(checks) == 9 and checks["validation_passed"] == 0 and checks["staff_ids_unique"] == 1 and checks["publication_ids_unique"] == 0
    t = lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
    staff = "staff_id string, full_name string, department_name string, college_name string, matching_text_without_teaching string, profile_url string"
    module = "module_id string, module_title string, description string, matching_text string, departments array<string>, module_code string"
    good = dict(
        staff=t(staff, ("s", "n", "d", "c", "m", "u"), ("", None, None, None, None, None)), courses=t("course_id string", ("c",)), modules=t(module, ("m", "t", "d", "x", ["d"], "ab1 ")), course_links=t("course_id string, module_id string", ("c", "m")),
        publications=t("publication_id string", ("p",)), publication_links=t("staff_id string, publication_id string", ("s", "p")), teaching=t("staff_id string, module_codes array<string>", ("s", ["AB1", " "]), ("s", None)),
    )
    value = lambda **more: {(r["section"], r["name"]): r["value"] for r in rules.processed_report(**{**good, **more}).collect()}
    fine = value()
    assert all(v == 1 for (s, _), v in fine.items() if s == "checks") and fine["teaching_codes", "matched_teaching_codes"] == 1 and fine["staff_quality", "missing_full_name"] == 1
    for name, more in {
        "staff_ids_unique": {"staff": good["staff"].unionByName(good["staff"])}, "course_ids_unique": {"courses": good["courses"].unionByName(good["courses"])}, "module_ids_unique": {"modules": good["modules"].unionByName(good["modules"])},
        "publication_ids_unique": {"publications": good["publications"].unionByName(good["publications"])}, "course_module_references_valid": {"course_links": t("course_id string, module_id string", ("c", "m"), (None, "m"))},
        "staff_publication_references_valid": {"publication_links": t("staff_id string, publication_id string", ("s", "q"))}, "teaching_staff_references_valid": {"teaching": t("staff_id string, module_codes array<string>", ("z", []))},
        "all_modules_linked_to_courses": {"course_links": good["course_links"].limit(0)},
    }.items():
        told = value(**more)
        assert [n for (s, n), v in sorted(told.items()) if s == "checks" and v == 0] == sorted([name, "validation_passed"])


def test_records_of_nulls(spark):
    pair = spark.createDataFrame([(1,) + (None,) * 14], "record_id long, module_id string, staff_a_id string, staff_b_id string, module_title string, staff_a_name string, staff_b_name string, recommendation_level string, rank int, collaboration_score double, combined_module_coverage double, best_individual_coverage double, complementarity_gain double, explanation string, shared_module_topics array<string>").selectExpr("*", "shared_module_topics as complementary_module_topics")
    assert {r["failure"] for r in rules.pair_failures(pair).collect()} == {
        "missing_module_id", "missing_staff_a_id", "missing_staff_b_id", "missing_module_title", "missing_staff_a_name", "missing_staff_b_name", "invalid_recommendation_level", "invalid_rank", "non_positive_complementarity_gain", "missing_topic_evidence", "missing_explanation",
    }
    result = spark.createDataFrame([("m", None, None, None, None, None, None), ("n", "hierarchy_internal_ranked", False, ["p"], [(None, None, None, None, None)], [(None, None)], None)], rules.RESULT)
    got = {r["module_id"]: (r["issues"], r["warnings"]) for r in rules.result_findings(result).collect()}
    assert got["m"] == ([], ["module_hierarchy_paths_missing"])
    assert got["n"][0][0] == "invalid_rank_sequence:[None]" and "returned_recommendation_failed_gate:rank=None:staff_id=None" in got["n"][0] and len(got["n"][0]) == 6
