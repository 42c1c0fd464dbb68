"""Join-key values, codes and labels as ``Column`` expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.config import DUAL_STATUS, VALID_CODES, Policy
from matchloom.functions.text import (
    as_col,
    fold_digits,
    int_part,
    norm_text,
    numlike,
    strip_school_separators,
)

# Tokens of the two normalised domains.
MALE_RAW = ("1", "male", "m", "boy", "♂")
FEMALE_RAW = ("0", "female", "f", "girl", "♀")
MALE_FA = ("پسر", "مذکر")
FEMALE_FA = ("دختر", "مونث")
STRICT_MALE = ("پسر", "مرد")
STRICT_FEMALE = ("دختر", "زن", "خانم")
GRAD_RAW = ("0", "graduate", "grad")
STUDENT_RAW = ("1", "student", "pupil")
ZERO_WIDTH = "\u200c\u200d\ufeff"


def _long(v) -> Column:
    return F.lit(v).cast("bigint")


def gender(c, strict: bool = False) -> Column:
    """1 male, 0 female. Unknown is male, or null when ``strict``."""
    raw = F.lower(F.trim(F.coalesce(as_col(c).cast("string"), F.lit(""))))
    padded = F.concat(F.lit(" "), norm_text(c), F.lit(" "))
    numeric = F.regexp_extract(fold_digits(raw), r"^([0-9]+)([.٫]0+)?$", 1).try_cast("bigint")
    has = lambda words: padded.rlike(f" ({'|'.join(words)}) ")
    return (
        F.when(raw.isin(*MALE_RAW), _long(1))
        .when(raw.isin(*FEMALE_RAW), _long(0))
        .when(has(MALE_FA), _long(1))
        .when(has(FEMALE_FA), _long(0))
        .when(numeric.isin(0, 1), numeric)
        .otherwise(F.lit(None).cast("bigint") if strict else _long(1))
    )


def status(c) -> Column:
    """1 student, 0 graduate; unknown is student."""
    raw = F.lower(F.trim(F.coalesce(as_col(c).cast("string"), F.lit(""))))
    folded = norm_text(c)
    return (
        F.when(raw.isin(*GRAD_RAW), _long(0))
        .when(raw.isin(*STUDENT_RAW), _long(1))
        .when(folded.contains("فارغ"), _long(0))
        .otherwise(_long(1))
    )


def school_code(c) -> Column:
    """Whole part of the numeric text, never negative, empty is 0."""
    return F.greatest(int_part(c), _long(0))


def school_code_first(*cols) -> Column:
    """First candidate that holds a numeric school code, else null."""
    out = []
    for c in cols:
        n = numlike(strip_school_separators(as_col(c).cast("string")))
        out.append(F.regexp_extract(n, "^(-?[0-9]+)", 1).try_cast("bigint"))
    return F.coalesce(*out)


def join_int(c) -> tuple[Column, Column]:
    """(missing?, value) of a key cell: digits folded, hidden characters and blanks dropped."""
    s = F.translate(fold_digits(F.coalesce(as_col(c).cast("string"), F.lit(""))), ZERO_WIDTH, "")
    s = F.regexp_replace(s, r"\s+", "")
    return s == "", F.regexp_extract(s, "^([+-]?[0-9]+)$", 1).try_cast("bigint")


def canonical_key(c, key: str, policy: Policy | None = None) -> tuple[Column, Column]:
    """Strict (value, error_code) of one join key; exactly one of the two is null."""
    policy = policy or Policy()
    missing, value = join_int(c)
    none = F.lit(None).cast("bigint")
    missing_code, invalid_code = F.lit("DATA_MISSING"), F.lit("DATA_INVALID")
    if key == "gender_code":
        folded = norm_text(c)
        # A number never folds to nothing or to a word, so the fold is left to other cells.
        out = (
            F.when(value.isNotNull(), F.when(value.isin(0, 1), value))
            .when(folded == "", none)
            .when(folded.isin(*STRICT_MALE), _long(1))
            .when(folded.isin(*STRICT_FEMALE), _long(0))
        )
        return out, F.when(out.isNull(), missing_code)
    if key == "school_code":
        ok = F.when(missing & F.lit(policy.school_code_empty_as_zero), _long(0)).when(value >= 0, value)
        code = F.when(missing | (value < 0), missing_code).otherwise(invalid_code)
        return ok, F.when(ok.isNull(), code)
    if key == "center_code":
        folded = norm_text(c)
        mapped = none
        for name, center in policy.center_map.items():
            if name != "*":
                mapped = F.when(folded == norm_text(F.lit(name)), _long(center)).otherwise(mapped)
        star = policy.center_map.get("*")
        if star is not None:  # noise text that folds to nothing reads as the wildcard
            mapped = F.coalesce(
                mapped, F.when((folded == "") & ~missing & value.isNull(), _long(star))
            )
        ok = F.coalesce(mapped, F.when(value >= 0, value))
        if not any(ch.isdigit() for name in policy.center_map for ch in name):
            ok = F.when(value.isNotNull(), F.when(value >= 0, value)).otherwise(mapped)
        code = F.when(missing | (value < 0), missing_code).otherwise(invalid_code)
        return ok, F.when(ok.isNull(), code)
    if key == "group_code":
        ok = F.when(value.isin(*VALID_CODES), value)
    else:
        ok = F.when(value >= 0, value)
    code = F.when(missing | (value < 0), missing_code).otherwise(invalid_code)
    return ok, F.when(ok.isNull(), code)


def _bounds(c) -> Column:
    """(lo, hi) of every code and range named by '1,3 24-27' style text; a code is a range of one."""
    text = F.translate(fold_digits(F.coalesce(as_col(c).cast("string"), F.lit(""))), "-", ":")
    tokens = F.filter(F.split(F.trim(text), r"[,،\s]+"), lambda t: t != "")
    digits = lambda t: F.regexp_replace(t, "[^0-9]", "").try_cast("bigint")

    def ends(t: Column) -> Column:
        hi = F.when(t.contains(":"), F.regexp_extract(t, ":(.*)$", 1)).otherwise(t)
        return F.struct(digits(F.substring_index(t, ":", 1)).alias("a"), digits(hi).alias("b"))

    # Two steps, so that the texts of a token are read once.
    read = F.filter(F.transform(tokens, ends), lambda e: e["a"].isNotNull() & e["b"].isNotNull())
    return F.transform(read, lambda e: F.struct(F.least(e["a"], e["b"]).alias("lo"), F.greatest(e["a"], e["b"]).alias("hi")))


def _code_array(codes) -> Column:
    return F.expr("array(" + ",".join(f"{int(c)}L" for c in sorted(codes)) + ")")


def _named(bounds: Column, valid) -> Column:
    # The cell is cut into bounds once, outside of the lambda over the codes.
    inside = F.transform(bounds, lambda b: F.filter(_code_array(valid), lambda v: v.between(b["lo"], b["hi"])))
    return F.array_sort(F.array_distinct(F.flatten(inside)))


def parse_group_codes(c, valid=VALID_CODES) -> Column:
    """Sorted unique valid codes; ranges are compared, never spelled out."""
    return _named(_bounds(c), valid)


def invalid_group_codes(c, valid=VALID_CODES) -> Column:
    """Named codes and ranges outside the valid set, sorted, as text.

    A range is cut at its valid codes; each rest is 'lo-hi', or the code alone when it is one.
    """
    codes = sorted(int(v) for v in valid)
    # Stretches between neighbouring valid codes, in order.
    edges = [(-(1 << 63), codes[0] - 1), *((a + 1, b - 1) for a, b in zip(codes, codes[1:], strict=False) if b - a > 1), (codes[-1] + 1, (1 << 63) - 1)]
    gaps = F.expr("array(" + ",".join(f"named_struct('lo', cast('{a}' as bigint), 'hi', cast('{b}' as bigint))" for a, b in edges) + ")")
    rest = lambda b: F.filter(F.transform(gaps, lambda g: F.struct(F.greatest(g["lo"], b["lo"]).alias("lo"), F.least(g["hi"], b["hi"]).alias("hi"))), lambda r: r["lo"] <= r["hi"])
    parts = F.array_sort(F.array_distinct(F.flatten(F.transform(_bounds(c), rest))))
    return F.transform(parts, lambda r: F.when(r["lo"] == r["hi"], r["lo"].cast("string")).otherwise(F.concat_ws("-", r["lo"].cast("string"), r["hi"].cast("string"))))


def parse_group_codes_strict(c, valid=VALID_CODES) -> tuple[Column, Column]:
    """(valid codes, invalid tokens): a token that is not a positive code or range is invalid."""
    text = F.translate(fold_digits(F.coalesce(as_col(c).cast("string"), F.lit(""))), "-", ":")
    tokens = F.filter(F.split(F.trim(text), r"[,،\s]+"), lambda t: t != "")
    good = lambda t: t.rlike("^[0-9]+(:[0-9]+)?$") & ~t.rlike("^0+(:|$)")
    accepted = F.filter(tokens, good)
    return (
        _named(_bounds(F.array_join(accepted, ",")), valid),
        F.filter(tokens, lambda t: ~good(t)),
    )


def allowed_statuses(group, school_branch) -> Column:
    """Status domain of a group: school branch and single-status groups are student only."""
    dual = as_col(group).isin(*DUAL_STATUS) & ~as_col(school_branch)
    return F.when(dual, F.array(_long(1), _long(0))).otherwise(F.array(_long(1)))


def student_binding(school, grad_status, school_codes) -> Column:
    """SCHOOL for active students of a configured school, else NORMAL."""
    inside = as_col(school).isin(*school_codes) if school_codes else F.lit(False)
    hit = (F.coalesce(as_col(grad_status), _long(1)) == 1) & (as_col(school) > 0) & inside
    return F.when(hit, F.lit("SCHOOL")).otherwise(F.lit("NORMAL"))


def allocation_channel(school, grad_status, center, registration=None, active=None, policy=None) -> Column:
    """First match of SCHOOL (active only), center column, registration column, else GENERIC."""
    policy = policy or Policy()
    is_school = student_binding(school, grad_status, policy.school_codes) == "SCHOOL"
    if active is not None and policy.active_status_values:
        a = as_col(active)
        is_school = is_school & (a.isNull() | a.isin(*policy.active_status_values))
    out = F.when(is_school, F.lit("SCHOOL"))
    for source in (center, registration):
        if source is None:
            continue
        for channel in ("GOLESTAN", "SADRA"):
            ids = policy.center_channels.get(channel, ())
            if ids:
                out = out.when(as_col(source).isin(*ids), F.lit(channel))
    return out.otherwise(F.lit("GENERIC"))


def mentor_type(school_count) -> Column:
    return F.when(F.coalesce(as_col(school_count), _long(0)) > 0, F.lit("SCHOOL")).otherwise(F.lit("NORMAL"))


def binding_mode(has_reference) -> Column:
    return F.when(as_col(has_reference), F.lit("restricted")).otherwise(F.lit("global"))


# Spellings of "no school".
NO_SCHOOL = ("", "0", "-", "—", "_", "na", "n/a", "n a", "nan", "<na>", "<nan>")


def no_school(c) -> Column:
    """True when the cell says there is no school."""
    s = F.lower(F.trim(F.coalesce(as_col(c).cast("string"), F.lit(""))))
    return s.isin(*NO_SCHOOL)


def school_token(c) -> Column:
    """Cell with every spelling of 'no school' blanked; whole-number floats lose '.0'."""
    s = F.trim(F.coalesce(as_col(c).cast("string"), F.lit("")))
    s = F.regexp_replace(s, r"^([0-9]+)\.0+$", "$1")
    return F.when(no_school(s), F.lit("")).otherwise(s)


# Display labels.
GENDER_LABEL = {0: "دختر", 1: "پسر"}
STATUS_LABEL = {1: "دانش‌آموز", 0: "فارغ‌التحصیل"}
CENTER_LABEL = {0: "مرکز", 1: "گلستان", 2: "صدرا"}
TYPE_LABEL = {"NORMAL": "عادی", "SCHOOL": "مدرسه‌ای"}


def label(c, names: dict, default: str = "") -> Column:
    out = None
    for code, text in names.items():
        cond = as_col(c) == code
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out.otherwise(F.lit(default))


def roster_gender(c, mode: str = "auto", hint: str | None = None) -> Column:
    """Forced mode, else the source hint, else the column, else male."""
    if mode in ("male", "female"):
        return _long(1 if mode == "male" else 0)
    for mark, code in (("3570", 1), ("3730", 0)):
        if mark in (hint or ""):
            return _long(code)
    return _long(1) if c is None else gender(c)


def finance_cluster(c, policy: Policy | None = None) -> Column:
    """Cluster label of a finance code; a code outside every cluster stands for itself."""
    clusters = (policy or Policy()).finance_clusters()
    col = as_col(c).cast("bigint")
    out = F.lit(None).cast("bigint")
    for rep in sorted(set(clusters.values())):
        members = [k for k, v in clusters.items() if v == rep]
        out = F.coalesce(out, F.when(col.isin(*members), _long(rep)))
    return F.coalesce(out, col)

