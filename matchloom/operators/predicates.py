"""The match rules of one student row and one pool row, as boolean columns.

They define the semantics once. Table-sized matching never evaluates them over a cross
product: ``matching.py`` turns the same rules into equi-join keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.config import Policy
from matchloom.functions.keys import finance_cluster

Side = Callable[[str], Column]


def stage_predicates(s: Side, m: Side, policy: Policy | None = None, constrained: bool = True) -> dict[str, Column]:
    """Seven stage predicates; ``s`` and ``m`` give a student / pool column by name."""
    eq = lambda k: F.coalesce(s(k) == m(k), F.lit(False))
    center = (
        F.when(s("center_code").isNull(), F.lit(True))
        .when(s("center_code") == 0, m("center_code") == 0)
        .otherwise((m("center_code") == 0) | (m("center_code") == s("center_code")))
    )
    school_m = F.coalesce(m("school_code"), F.lit(0))
    restricted = F.coalesce(m("has_school_constraint"), F.lit(False)) if constrained else F.lit(False)
    school = (
        F.when(s("school_code").isNull(), F.lit(True))
        .when(s("school_code") == 0, ~restricted)
        .when(restricted, school_m == s("school_code"))
        .otherwise(school_m.isin(0) | (school_m == s("school_code")))
    )
    finance = finance_cluster(s("finance_code"), policy) == finance_cluster(m("finance_code"), policy)
    return {
        "type": eq("group_code"),
        "group": eq("group_code"),
        "gender": eq("gender_code"),
        "graduation_status": eq("grad_status_code"),
        "center": F.coalesce(center, F.lit(False)),
        "finance": F.coalesce(finance, F.lit(False)),
        "school": school,
    }


def audit_center(student: Column, mentor: Column, wildcard: int | None = 0) -> Column:
    """Center rule of the audits: a wildcard student center accepts every mentor center."""
    any_student = (student == wildcard) if wildcard is not None else F.lit(False)
    return F.coalesce(any_student | (mentor == 0) | (mentor == student), F.lit(False))


def audit_school(student: Column, mentor: Column, empty_as_zero: bool = True) -> Column:
    zero = ((student == 0) | (mentor == 0)) if empty_as_zero else F.lit(False)
    return F.coalesce(zero | (student == mentor), F.lit(False))


def audit_finance(student: Column, mentor: Column, policy: Policy | None = None) -> Column:
    return F.coalesce(finance_cluster(student, policy) == finance_cluster(mentor, policy), F.lit(False))
