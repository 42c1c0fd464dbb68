"""Phone, registration and birth-date rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.ids import digits_text, first_match
from matchloom.functions.text import FOREIGN_DIGITS, ASCII_DIGITS, as_col

# Fixed values of the contact rules.
SPECIAL_STATUS = 3
SPECIAL_LANDLINE = "00000000000"
SPECIAL_TRACKING = "1111111111111111"
REGISTRATION_LABELS = {0: "عادی", 1: "بنیاد", 3: "حکمت"}


def mobile(c) -> Column:
    """Eleven digits starting 09; ten digits starting 9 get the zero; else null."""
    d = F.regexp_replace(digits_text(c), "^(9[0-9]{9})$", "0$1")
    return first_match(d, "^09[0-9]{9}$")


def landline(c, allow_special: bool = False) -> Column:
    """Digits that start with 3 or 5; the special all-zero number when allowed."""
    shape = f"^([35][0-9]*|{SPECIAL_LANDLINE})$" if allow_special else "^[35][0-9]*$"
    return first_match(digits_text(c), shape)


def guardian_phones(first, second) -> tuple[Column, Column]:
    """Second moves to an empty first; a repeated second is blanked."""
    a, b = mobile(first), mobile(second)
    return F.coalesce(a, b), F.when(a.isNotNull() & (a != b), b)


def contact_policy(status, phone, tracking) -> tuple[Column, Column]:
    """Status 3 fills an empty landline and fixes the tracking code; others blank it."""
    special = F.coalesce(as_col(status) == SPECIAL_STATUS, F.lit(False))
    text = as_col(phone).cast("string")
    empty = text.isNull() | (F.trim(text) == "")
    return (
        F.when(special & empty, F.lit(SPECIAL_LANDLINE)).otherwise(text),
        F.when(special, F.lit(SPECIAL_TRACKING)).otherwise(F.lit("")),
    )


def registration_status(*cols) -> Column:
    """First present column wins as a whole; digits folded; non-numeric is null."""
    s = F.trim(F.translate(as_col(cols[0]).cast("string"), FOREIGN_DIGITS, ASCII_DIGITS))
    return F.regexp_extract(s, r"^([+-]?[0-9]+)(\.0*)?$", 1).try_cast("bigint")


def registration_label(code) -> Column:
    out = F.when(as_col(code) == 1, F.lit(REGISTRATION_LABELS[1])).when(
        as_col(code) == 3, F.lit(REGISTRATION_LABELS[3])
    )
    return out.otherwise(F.lit(REGISTRATION_LABELS[0]))


def jalali_leap(year) -> Column:
    """2820-year cycle rule."""
    cycle = F.pmod(as_col(year) - F.lit(474), F.lit(2820)) + F.lit(474)
    return F.pmod((cycle + F.lit(38)) * F.lit(682), F.lit(2816)) < 682


def valid_birth_date(c) -> Column:
    """True for blank cells and real Jalali dates."""
    s = F.trim(F.translate(F.coalesce(as_col(c).cast("string"), F.lit("")), FOREIGN_DIGITS, ASCII_DIGITS))
    pattern = "^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$"
    y, m, d = (F.regexp_extract(s, pattern, i).try_cast("bigint") for i in (1, 2, 3))
    last = F.when(m <= 6, 31).when(m <= 11, 30).when(jalali_leap(y), 30).otherwise(29)
    return F.when(s == "", F.lit(True)).otherwise(
        s.rlike(pattern) & F.coalesce(m.between(1, 12) & (d >= 1) & (d <= last), F.lit(False))
    )


def clean_birth_date(c) -> Column:
    return F.when(valid_birth_date(c), as_col(c))
