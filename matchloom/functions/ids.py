"""Identifiers: natural order, aliases, counters, stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.text import ASCII_DIGITS, FOREIGN_DIGITS, as_col, fold_digits, numlike, text_or_blank


def natural_key(c) -> Column:
    """Sortable text in which 'EMP-2' precedes 'EMP-10'.

    Letters are lower-cased; a digit run becomes a low separator, its length (led by the
    number of digits of that length) and the digits without leading zeros, so byte order is
    numeric order for runs of any length.
    """
    s = fold_digits(F.trim(F.coalesce(as_col(c).cast("string"), F.lit(""))))
    parts = F.regexp_extract_all(s, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        size = F.length(digits).cast("string")
        number = F.concat(F.lit("\u0001"), F.length(size).cast("string"), size, digits)
        return F.when(p.rlike("^[0-9]"), number).otherwise(F.lower(p))

    return F.array_join(F.transform(parts, encode), "")


def identifier_text(c) -> Column:
    """Numeric-looking ids lose leading zeros and '.0'; others are trimmed; blank is null."""
    s = F.trim(as_col(c).cast("string"))
    bare = F.regexp_replace(s, " ", "")
    folded = fold_digits(bare)
    whole = folded.rlike(r"^[0-9]+\.0$")
    numeric = folded.rlike(r"^[+-]*([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(s == "", F.lit(None)).when(whole | numeric, numlike(s)).otherwise(s)


def first_match(c, pattern: str) -> Column:
    """First match of a pattern, null when there is none; reads its input once."""
    return F.get(F.regexp_extract_all(as_col(c), F.lit(pattern), F.lit(0)), F.lit(0))


def alias_digits(c) -> Column:
    """Last ten digits without leading zeros (all zeros stay); null when there are none."""
    d = F.regexp_replace(fold_digits(F.trim(as_col(c).cast("string"))), "[^0-9]", "")
    return F.regexp_replace(first_match(d, "[0-9]{1,10}$"), "^0+(?=0*[1-9])", "")


def first_alias(*cols) -> Column:
    """First alias column that holds digits, else ''."""
    return F.coalesce(*[alias_digits(c) for c in cols], F.lit(""))


def school_alias(mentor_id) -> Column:
    """Mentor id as text without an artificial '.0'."""
    s = F.trim(F.coalesce(as_col(mentor_id).cast("string"), F.lit("")))
    return F.regexp_replace(s, r"^([0-9]+)\.0$", "$1")


def normal_alias(postal, valid_range=(1000, 9999)) -> Column:
    """Whole part of the postal text when inside the range, else ''."""
    n = F.regexp_extract(numlike(postal), "^(-?[0-9]+)", 1).try_cast("bigint")
    return F.when(n.between(*valid_range), n.cast("string")).otherwise(F.lit(""))


def mentor_alias(kind, postal, mentor_id, valid_range=(1000, 9999)) -> Column:
    return F.when(as_col(kind) == "SCHOOL", school_alias(mentor_id)).otherwise(
        normal_alias(postal, valid_range)
    )


def national_code(c) -> Column:
    """Last ten digits, left padded with zeros; null without digits."""
    return F.lpad(first_match(digits_text(c), "[0-9]{1,10}$"), 10, "0")


def digits_text(c) -> Column:
    """Digits only, '' without digits; a spreadsheet '0123.0' reads as '123'."""
    s = F.trim(F.translate(text_or_blank(c), FOREIGN_DIGITS + "\u066b", ASCII_DIGITS + "."))
    s = F.regexp_replace(s, r"^0*([0-9]+)\.0+$", "$1")
    return F.regexp_replace(s, "[^0-9]", "")


def digits_of(c) -> Column:
    """As ``digits_text`` with null for no digits."""
    return first_match(digits_text(c), "[0-9]+")


def counter_id(yy, gender, seq, mid3=None) -> Column:
    """Nine digits: two for the year, three for gender, four for the sequence."""
    mid3 = mid3 or {1: "357", 0: "373"}
    mid = F.when(as_col(gender) == 1, F.lit(mid3[1])).when(as_col(gender) == 0, F.lit(mid3[0]))
    ok = as_col(seq).between(0, 9999) & as_col(yy).between(0, 99)
    return F.when(
        ok,
        F.concat(
            F.lpad(as_col(yy).cast("string"), 2, "0"), mid, F.lpad(as_col(seq).cast("string"), 4, "0")
        ),
    )


def valid_counter(c) -> Column:
    """Cleaned nine-digit counter, else null."""
    s = F.regexp_replace(F.translate(fold_digits(c), "\u200c\u200d\ufeff", ""), r"\s+", "")
    return F.when(s.rlike("^[0-9]{9}$"), s)


def counter_year(c) -> Column:
    return F.substring(valid_counter(c), 1, 2).cast("bigint") + F.lit(1350).cast("bigint")


def counter_sequence(c) -> Column:
    return F.substring(valid_counter(c), 6, 4).cast("bigint")


def stable_hash(c) -> Column:
    """Input-order-free tie key: the hex text of SHA-256."""
    return F.sha2(as_col(c).cast("string"), 256)


def counter_hash(c) -> Column:
    """Stable hash of a counter: of the cleaned nine digits, else of the digits in the text, else of the text; blank is '0'."""
    text = F.trim(F.coalesce(as_col(c).cast("string"), F.lit("")))
    digits = F.regexp_replace(fold_digits(text), "[^0-9]", "")
    blank = lambda x: F.when(x == "", F.lit(None)).otherwise(x)
    return F.sha2(F.coalesce(valid_counter(text), blank(digits), blank(text), F.lit("0")), 256)
