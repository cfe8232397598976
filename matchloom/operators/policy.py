"""Eligibility, gates, capacity and other ordered rules as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.text import folded

#: Terms of positions that may deliver, and that may not, in order of precedence.
ALLOWED_ROLES = ("lecturer", "professor", "reader", "teaching fellow", "academic")
EXCLUDED_ROLES = (
    "emeritus", "honorary", "visiting", "research fellow", "research assistant", "postdoctoral", "post-doctoral", "doctoral researcher",
    "phd student", "student", "administrator", "administrative", "technician", "technical officer",
)
#: Modules a position may lead; the first term found counts.
ROLE_CAPACITY = (("professor", 2), ("head of department", 1), ("reader", 3), ("senior lecturer", 3), ("lecturer", 4))
DEFAULT_CAPACITY = 3
#: Titles of modules that aren't taught, and of administrative ones.
UNTAUGHT_TITLES = (
    "placement", "practice placement", "clinical placement", "work placement", "internship", "year in industry", "work experience", "dissertation",
    "final year project", "individual project", "major project", "capstone project", "independent study", "student selected component", "study abroad", "student exchange",
)
ADMINISTRATIVE_TITLES = (
    "major group project", "design and branding research project", "capstone project", "practice placement", "dissertation", "dissertation project",
    "student selected component", "performance",
)
#: Thresholds of the evidence gate, and terms that are no specific evidence.
LEAST_TOTAL, LEAST_FIELD, LEAST_SIGNAL = 0.12, 0.10, 0.06
GENERIC_TERMS = ("research", "education", "technology", "innovation", "science", "engineering", "business", "health", "social sciences", "academic", "university", "teaching")


def first_match(text: Column, terms) -> Column:
    """The first of the terms, in their order, that the text contains; null without one."""
    out = None
    for t in reversed(tuple(terms)):
        out = F.when(F.contains(text, F.lit(t)), t) if out is None else F.when(F.contains(text, F.lit(t)), t).otherwise(out)
    return out


def eligibility(position: Column) -> Column:
    """Reason: missing_position, excluded_role:x, eligible_role:x or unclassified_position."""
    p = folded(position)
    bad, good = first_match(p, EXCLUDED_ROLES), first_match(p, ALLOWED_ROLES)
    return F.when(p == "", "missing_position").when(bad.isNotNull(), F.concat(F.lit("excluded_role:"), bad)).when(good.isNotNull(), F.concat(F.lit("eligible_role:"), good)).otherwise("unclassified_position")


def is_eligible(position: Column) -> Column:
    return F.startswith(eligibility(position), F.lit("eligible_role:"))


def is_taught(title: Column) -> Column:
    return first_match(folded(title), UNTAUGHT_TITLES).isNull()


def classification(title: Column) -> Column:
    return F.when(is_taught(title), "taught_academic").otherwise("independent_project_placement")


def exclusion_reason(title: Column) -> Column:
    return first_match(folded(title), ADMINISTRATIVE_TITLES)


def capacity(position: Column, override: Column | None = None) -> Column:
    p = F.lower(F.coalesce(position, F.lit("")))
    by_role = F.lit(DEFAULT_CAPACITY)
    for term, n in reversed(ROLE_CAPACITY):
        by_role = F.when(F.contains(p, F.lit(term)), n).otherwise(by_role)
    return F.coalesce(override, by_role) if override is not None else by_role


def is_specific(terms: Column) -> Column:
    """Some term has four characters or more and isn't generic."""
    return F.exists(terms, lambda t: (F.length(t) >= 4) & ~t.isin(*GENERIC_TERMS))


def gate(total: Column, fields: dict[str, Column], core: str, has_profile: Column, has_publications: Column, specific: Column) -> Column:
    """Why a recommendation is stopped, or `passed`."""
    strongest = F.greatest(*fields.values(), F.lit(0.0))
    others = [c for k, c in fields.items() if k != core]
    signal = F.greatest(*others, F.lit(0.0)) if others else F.lit(0.0)
    return (
        F.when(total < LEAST_TOTAL, "low_total_score").when(strongest < LEAST_FIELD, "no_strong_field_signal")
        .when((signal < LEAST_SIGNAL) & (fields[core] < LEAST_SIGNAL), "insufficient_evidence_signal").when(~has_profile & ~has_publications, "profile_evidence_missing")
        .when(~specific & (signal > 0), "generic_evidence_only").otherwise("passed")
    )


def band(score: Column) -> Column:
    return F.when(score >= 0.35, "high").when(score >= 0.20, "moderate").otherwise("exploratory")


def displayed(level: Column, rank: Column, coverage: Column, gain: Column) -> Column:
    return (F.lower(level) == "high") & (rank == 1) & (coverage >= 0.40) & (gain >= 0.10)


def kappa_band(k: Column) -> Column:
    return (
        F.when(k < 0, "Poor").when(k <= 0.20, "Slight").when(k <= 0.40, "Fair").when(k <= 0.60, "Moderate").when(k <= 0.80, "Substantial").otherwise("Almost Perfect")
    )


def rating(c: Column) -> Column:
    """0, 1 or 2 of a text; anything else is null."""
    n = F.trim(c).try_cast("int")
    return F.when(n.isin(0, 1, 2), n)


def checks(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each rule that a row breaks; a rule is true, or null, where it is broken."""
    failed = F.array(*[F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()])
    return df.select(*keep, F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("failure"))
