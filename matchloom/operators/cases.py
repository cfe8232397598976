"""Case studies: a few diverse recommendations of each level, laid out for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels in the order of the sheet with the cases asked of each, and what a reviewer fills in.
REQUESTED = {"high": 10, "moderate": 10, "exploratory": 5}
REVIEW = ("staff_a_relevance", "staff_b_relevance", "complementary_expertise", "explanation_clarity", "practical_plausibility", "overall_recommendation_quality", "reviewer_comments")
_TEXTS = ("module_id", "module_title", "module_code", "module_level", "module_department", "staff_a_id", "staff_a_name", "staff_a_job_title", "staff_a_department", "staff_b_id", "staff_b_name", "staff_b_job_title", "staff_b_department")
_NUMBERS = ("collaboration_score", "combined_module_coverage", "best_individual_coverage", "complementarity_gain", "staff_topic_overlap_ratio")


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def order() -> list[Column]:
    """Best first: score, coverage, gain, rank, then title and names."""
    return [F.desc(_number(c)) for c in ("collaboration_score", "combined_module_coverage", "complementarity_gain")] + [F.coalesce(F.col("rank").cast("int"), F.lit(999_999)).asc(), F.lower(_text("module_title")).asc(), F.lower(_text("staff_a_name")).asc(), F.lower(_text("staff_b_name")).asc()]


def shares() -> Column:
    """Whether the two have something in common, in the module or beyond."""
    return (F.coalesce(F.size("shared_module_topics"), F.lit(0)) > 0) | (F.coalesce(F.size("shared_staff_topics"), F.lit(0)) > 0)


def select(recommendations: DataFrame, requested: dict[str, int] | None = None, tie: str = "record_id") -> DataFrame:
    """The chosen recommendations with selection_group and case_id.

    Of each level, each module's best is a candidate; those that share a foundation and those that don't take turns, the former first,
    until one kind runs out and the other fills up. Numbers asked for are the feature: no more than these leave a task.
    """
    wanted = REQUESTED if requested is None else requested
    place = {level: i for i, level in enumerate(wanted)}
    level = F.lower(_text("recommendation_level"))
    asked = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])[F.col("selection_group")]
    rows = recommendations.withColumns({"selection_group": level, "__shared": shares()}).where(level.isin(*wanted) & (_text("module_id") != ""))
    best = rows.withColumn("__k", F.row_number().over(Window.partitionBy("selection_group", "module_id").orderBy(*order(), tie))).where(F.col("__k") == 1)
    turn = best.withColumn("__turn", F.row_number().over(Window.partitionBy("selection_group", "__shared").orderBy(*order(), tie))).where(F.col("__turn") <= asked)
    chosen = turn.withColumn("__n", F.row_number().over(Window.partitionBy("selection_group").orderBy("__turn", F.desc("__shared")))).where(F.col("__n") <= asked)
    number = F.row_number().over(Window.orderBy(F.create_map(*[F.lit(x) for pair in place.items() for x in pair])[F.col("selection_group")], "__n"))  # as many rows as were asked for
    return chosen.withColumn("case_id", F.format_string("M4-%03d", number)).drop("__k", "__turn", "__n", "__shared")


def sheet(chosen: DataFrame, most: int = 5) -> DataFrame:
    """A row a case: texts (never null), numbers to six digits, the labels of up to `most` topics of each kind, and empty review fields."""
    have = set(chosen.columns)
    texts = [(_text(c) if c in have else F.lit("")).alias(c) for c in _TEXTS]
    none = F.array().cast("array<string>")

    def labels(topics: Column) -> Column:
        return F.coalesce(F.filter(F.transform(F.slice(topics, 1, most), lambda t: F.trim(F.coalesce(t["topic"], F.lit("")))), lambda x: x != ""), none)

    theirs = lambda who: labels(F.filter("complementary_module_topics", lambda t: F.coalesce(t["provided_by"], F.lit("")) == who))
    return chosen.select(
        "case_id", "selection_group", *texts, F.coalesce(F.col("rank").cast("int"), F.lit(0)).alias("rank"), F.lower(_text("recommendation_level")).alias("recommendation_level"), *[F.round(_number(c), 6).alias(c) for c in _NUMBERS],
        shares().alias("has_shared_foundation"), labels(F.col("shared_module_topics")).alias("shared_module_topics"), theirs("staff_a").alias("staff_a_complementary_topics"), theirs("staff_b").alias("staff_b_complementary_topics"),
        _text("explanation").alias("explanation"), F.struct(*[F.lit("").alias(c) for c in REVIEW]).alias("review"),
    )
