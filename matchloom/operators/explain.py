"""Readable reasons: texts and causes as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import listed, percentage


def match_text(rank: Column, level: Column, topics: Column) -> Column:
    shared = F.when(F.size(topics) > 0, F.concat(F.lit("shares topics: "), F.array_join(topics, ", ")))
    return F.concat_ws("; ", F.concat(F.lit("Ranked "), rank.cast("string"), F.lit(" with a "), level, F.lit(" match")), shared)


def pair_text(a: Column, b: Column, module: Column, coverage: Column, gain: Column, topics: Column) -> Column:
    """Why two people complete each other for a module."""
    return F.concat(a, F.lit(" and "), b, F.lit(" together cover "), percentage(coverage), F.lit(" of "), module, F.lit(", "), percentage(gain), F.lit(" more than either alone"), F.when(F.size(topics) > 0, F.concat(F.lit(", with "), listed(topics))).otherwise(""), F.lit("."))


def gap_text(person: Column, aspect: Column, score: Column) -> Column:
    return F.concat(person, F.lit(" can bring "), aspect, F.lit(" ("), percentage(score), F.lit(" fit)"))


def allocation_kind(shift: Column, assigned: Column) -> Column:
    """The first choice kept, moved for capacity, or nobody from the candidates."""
    return F.when(shift == 0, "UnconstrainedOptimal").when(assigned, "CapacityQuotaEnforced").otherwise("ExemptOrUnassigned")


def allocation_text(kind: Column, person: Column, original: Column, shift: Column) -> Column:
    return (
        F.when(kind == "UnconstrainedOptimal", F.concat(person, F.lit(" is the best match and has room")))
        .when(kind == "CapacityQuotaEnforced", F.concat(person, F.lit(" takes over from "), original, F.lit(", who is full ("), shift.cast("string"), F.lit(" places down)")))
        .otherwise(F.concat(original, F.lit(" keeps the module outside the capacity rules")))
    )


def uncovered_reason(covered: Column, least: int = 1) -> Column:
    """covered: whether the lead covers each gap."""
    return (
        F.when(F.size(covered) < least, "no_active_gaps").when(F.forall(covered, lambda x: x), "all_gaps_covered_by_lead")
        .when(F.forall(covered, lambda x: ~x), "no_external_candidate").otherwise("below_score_threshold")
    )


def fallback_cause(staff: Column, placed: Column, fit: Column) -> Column:
    return F.when(staff == 0, "no_staff_in_department").when(placed == 0, "positions_missing").when(fit == 0, "no_eligible_role").otherwise("covered")
