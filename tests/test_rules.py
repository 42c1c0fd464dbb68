"""User stage and pair rules against nested loops over small tables."""

import pytest
from pyspark.sql import functions as F
from test_matching import eligible, small

from matchloom.operators import matching as M
from matchloom.operators import rules as R
from matchloom.plans.queries_rules import swapped_center, too_far

KEYS = ("group_code", "gender_code", "grad_status_code", "center_code", "finance_code", "school_code")


def stages(s, m, swapped=False):
    """Pass flags of the seven stages for a student and a pool tuple."""
    base = lambda **x: eligible(tuple({**dict(zip(("i", *KEYS), s)), **x}.values()), m)
    sc, mc = s[4], m[5]
    center = (sc == 0 or (sc is not None and mc == sc)) if swapped else (True if sc is None else mc is not None and (mc == 0 if sc == 0 else mc in (0, sc)))
    cluster = lambda f: 0 if f in (0, 1, 3) else f
    same = base(group_code=m[2], gender_code=m[3], grad_status_code=m[4], center_code=None, finance_code=m[6])
    return [s[1] == m[2], s[1] == m[2], s[2] == m[3], s[3] == m[4], center, cluster(s[5]) == cluster(m[6]), same]


def counts(students, pool, swapped=False, far=False):
    out = {}
    for s in students:
        n = [0] * 8
        for m in pool:
            ok = stages(s, m, swapped)
            if far:
                ok[4] = ok[4] and s[6] is not None and m[10] is not None and s[6] % 3 != m[10]
            for i in range(7):
                n[i] += all(ok[: i + 1])
            n[7] += all(ok) and m[9] > 0
        out[s[0]] = n
    return out


def got(rows, rules):
    return {r["student_id"]: [*[r[f"n_{s}"] for s in rules.stages], r["n_capacity_gate"]] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_default_rules_are_the_funnel(spark, seed):
    students, pool, sdf, pdf = small(spark, seed)
    rules = R.RuleSet(R.default_rules())
    want = counts(students, pool)
    assert got(rules.funnel(sdf, pdf).collect(), rules) == want
    assert got(M.stage_funnel(sdf, pdf).collect(), rules) == want


@pytest.mark.parametrize("far", [False, True])
def test_swapped_and_composed_center(spark, far):
    students, pool, sdf, pdf = small(spark, 3)
    rules = R.RuleSet(R.default_rules()).swapped(*R.composed("center", swapped_center(), *([too_far()] if far else [])))
    out = rules.funnel(sdf, pdf).collect()
    want = counts(students, pool, True, far)
    assert got(out, rules) == want and any(w[7] for w in want.values())
    for frame in (rules.class_funnel(sdf, pdf), rules.pair_reasons(sdf, pdf, [])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_reason_is_that_of_the_first_failing_part(spark):
    students, pool, sdf, pdf = small(spark, 5)
    rules = R.RuleSet(R.default_rules()).swapped(*R.composed("center", swapped_center(), too_far()))
    near, far = counts(students, pool, True), counts(students, pool, True, True)
    reasons = ["TYPE_MISMATCH", "GROUP_MISMATCH", "GENDER_MISMATCH", "GRADUATION_STATUS_MISMATCH", "CENTER_MISMATCH", "FINANCE_MISMATCH", "SCHOOL_STATUS_MISMATCH", "CAPACITY_FULL"]
    for r in rules.funnel(sdf, pdf).collect():
        n, own = far[r["student_id"]], near[r["student_id"]]
        first = next((i for i, v in enumerate(n) if v == 0), None)
        want = "OK" if first is None else "CENTER_TOO_FAR" if first == 4 and own[4] else reasons[first]
        assert r["reason"] == want


@pytest.mark.parametrize("late", [False, True])
def test_pair_rules_against_pairs(spark, late):
    students, pool, sdf, pdf = small(spark, 6)
    rules = R.RuleSet(R.default_rules())
    rules = rules.swapped(*R.composed("center", R.default_rules()[4], too_far())) if late else rules
    pairs = [R.PairRule("BUSY", F.col("m_allocations_new") >= 1, (), ("allocations_new",)), R.PairRule("ODD", F.col("school_code") > F.col("m_school_code"), ("school_code",), ("school_code",))]
    want = {}
    for s in students:
        for m in pool:
            ok = stages(s, m)
            if all(ok) and (not late or s[6] is not None and s[6] % 3 != m[10]):
                reason = "BUSY" if m[10] >= 1 else "ODD" if s[6] is not None and m[8 - 1] is not None and s[6] > m[7] else "OK"
                x = want.setdefault((s[0], reason), [0, 0])
                x[0] += 1
                x[1] += m[9] > 0
    assert {(r[0], r[1]): [r[2], r[3]] for r in rules.pair_reasons(sdf, pdf, pairs).collect()} == want and want


def test_rules_are_checked(spark):
    keys = F.array(F.lit("x"))
    for wrong in (lambda: R.StageRule("a", "A", (), ()), lambda: R.StageRule("a", "A", (), (), keys), lambda: R.RuleSet([too_far()]), lambda: R.composed("a"),
                  lambda: R.RuleSet(R.default_rules()).swapped(R.equal_rule("nowhere", "group_code", "X")),
                  lambda: R.RuleSet([R.equal_rule("a", "x", "A"), R.equal_rule("b", "x", "B"), R.equal_rule("a", "x", "A")])):
        with pytest.raises(ValueError):
            wrong()


def test_null_key_alternatives_and_empty_sides(spark):
    _, _, sdf, pdf = small(spark, 7)
    rules = R.RuleSet(R.default_rules())
    assert all(r["reason"] == "TYPE_MISMATCH" and r["pool_rows"] == 0 for r in rules.funnel(sdf, pdf.where("false")).collect())
    assert rules.funnel(sdf.where("false"), pdf).count() == 0
    assert rules.pair_reasons(sdf, pdf.where("false"), []).count() == 0
