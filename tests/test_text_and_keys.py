"""Hand-written cases of the column rules."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from matchloom.config import VALID_CODES, Policy
from matchloom.functions import contact, ids, keys, text


def values(spark, cells, make):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.select(make("c").alias("v"), "i").orderBy("i").select("v").collect()]


def test_norm_text(spark):
    cells = ["كريم ياسر ١٢۳", "س‌لام", "الله ﷲ", "ﻻ ﺑﺎ", "nan", None, "Abc-12é", "آزادى", "áب", "N/A"]
    assert values(spark, cells, text.norm_text) == [
        "کریم یاسر 123", "س لام", "ل", "لا با", "", "", "12", "ازادی", "ب", "",
    ]


def test_ligatures_and_fractions_keep_their_letters(spark):
    cells = ["\ufc9e", "\ufcfe", "\ufdfa", "½", "⑩", "a ½\ufdf2", "𝟗x", None]
    assert values(spark, cells, text.norm_text) == ["بخ", "شی", "صلی ل علیه وسلم", "1 2", "10", "1 2ل", "9", ""]


def test_no_length_limits(spark):
    assert values(spark, ["1." + "2" * 450 + ".5.6"], text.numlike) == ["1." + "2" * 450 + "56"]
    assert values(spark, ["9" * 450, "-.5.3", "1..2"], text.numlike) == ["9" * 450, "-0.53", "1.2"]
    short, long_ = values(spark, ["9" * 99, "1" * 100], ids.natural_key)
    assert short < long_
    assert values(spark, ["1-2999999999 5"], keys.parse_group_codes) == [sorted(VALID_CODES)]


def test_fold_table_is_the_unicode_rule():
    for src, dst in zip(text.FOLD_FROM, text.FOLD_TO):
        base = "".join(c for c in unicodedata.normalize("NFKD", src) if not unicodedata.category(c).startswith("M"))
        assert len(base) == 1 and (dst.isdigit() or "؀" <= dst <= "ۿ")


@pytest.mark.parametrize(
    "cell,want",
    [("١٬٢٣٤٫٥٠", "1234.5"), ("-000", "0"), ("-000.00", "0"), ("", ""), ("1.2.3", "1.23"), (".5", "0.5"), ("12.", "12"),
     ("5-", "-5"), ("abc", ""), (None, ""), (".", "0"), ("-", ""), ("007", "7"), ("10.010", "10.01"), ("-0.5", "-0.5")],
)
def test_numlike(spark, cell, want):
    assert values(spark, [cell], text.numlike) == [want]


def test_tokens_and_bools(spark):
    assert values(spark, [" الف،ب |الف|ج|۰|0.0"], text.split_tokens) == [["الف", "ب", "ج"]]
    assert values(spark, ["Yes", "مدرسه‌ای", "0", None, "۱", "x"], text.bool_like) == [1, 1, 0, 0, 1, 0]


def test_gender_defaults(spark):
    cells = ["پسر", "دختر", "?", None, "1.0", "۰", "Female"]
    assert values(spark, cells, keys.gender) == [1, 0, 1, 1, 1, 0, 0]
    assert values(spark, cells, lambda c: keys.gender(c, strict=True)) == [1, 0, None, None, 1, 0, 0]


def test_status(spark):
    assert values(spark, ["فارغ التحصيل", "دانش آموز", "?", "0", None], keys.status) == [0, 1, 1, 0, 1]


def test_group_codes(spark):
    assert values(spark, ["1,3 24-27", "27:24", "2 99", "۵،۷", "", None], keys.parse_group_codes) == [
        [1, 3, 24, 25, 26, 27], [24, 25, 26, 27], [], [5, 7], [], [],
    ]
    assert values(spark, ["1 2,99"], keys.invalid_group_codes) == [["2", "99"]]
    top = max(VALID_CODES)
    assert values(spark, [f"{top - 1}-2999999999"], keys.invalid_group_codes)[0][-1] == f"{top + 1}-2999999999"
    assert values(spark, ["1 x 0 3-5"], lambda c: keys.parse_group_codes_strict(c)[1]) == [["x", "0"]]


def test_national_code_pads_short_input(spark):
    assert values(spark, ["123", "00112345678901", "-", None, "۱۲", "1234567890.0"], ids.national_code) == [
        "0000000123", "2345678901", None, None, "0000000012", "1234567890",
    ]


def test_phones(spark):
    assert values(spark, ["۰۹۱۲-۳۴۵ ۶۷۸۹", "+989123456789", "9123456789", "021", None], contact.mobile) == [
        "09123456789", None, "09123456789", None, None,
    ]
    assert values(spark, ["31234", "21234", "00000000000"], contact.landline) == ["31234", None, None]
    assert values(spark, ["00000000000"], lambda c: contact.landline(c, True)) == ["00000000000"]


def test_birth_date_leap_rule(spark):
    # The cycle rule as given makes 1399 and 1404 leap years and 1403 not.
    cells = ["1399/12/30", "1403/12/30", "1404-12-30", "1400/7/31", "1400/6/31", "", None, "99/1/1"]
    assert values(spark, cells, contact.valid_birth_date) == [True, False, True, False, True, True, True, False]


def test_natural_key_order(spark):
    cells = ["EMP-10", "EMP-2", "emp-010", "7", "12", "", "EMP"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.orderBy(ids.natural_key("c"), "c").collect()]
    assert got == ["", "7", "12", "EMP", "EMP-2", "EMP-10", "emp-010"]


def test_identifier_text(spark):
    assert values(spark, ["007", "12.0", " EMP-2 ", "", "1 000"], ids.identifier_text) == ["7", "12", "EMP-2", None, "1000"]


def test_canonical_key_codes(spark):
    p = Policy()
    assert values(spark, ["", "-1", "x", "27", "2"], lambda c: keys.canonical_key(c, "group_code", p)[1]) == [
        "DATA_MISSING", "DATA_MISSING", "DATA_INVALID", None, "DATA_INVALID",
    ]
    assert values(spark, ["", "12"], lambda c: keys.canonical_key(c, "school_code", p)[0]) == [0, 12]
    assert values(spark, ["?", None], lambda c: keys.canonical_key(c, "gender_code", p)[1]) == ["DATA_MISSING"] * 2


def test_finance_clusters(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 3, 2, 7)], "c bigint")
    flat = [r[0] for r in df.select(keys.finance_cluster("c")).collect()]
    assert flat == [0, 0, 0, 2, 7]
    nested = Policy(finance_variants=((0, 1), (3, 7)))
    assert [r[0] for r in df.select(keys.finance_cluster("c", nested)).collect()] == [0, 0, 3, 2, 3]


def test_truncate_and_display(spark):
    assert values(spark, ["abc12", "abcdef"], lambda c: text.safe_truncate(c, 5)) == ["abc۱۲", "abcd…"]


def test_counter(spark):
    df = spark.createDataFrame([(1, 12), (0, 9999), (1, 10000)], "g int, n int")
    assert [r[0] for r in df.select(ids.counter_id(F.lit(54), "g", "n")).collect()] == ["543570012", "543739999", None]


def test_manager_name_of_any_length(spark):
    from matchloom.operators.references import center_from_manager

    mapping = spark.createDataFrame([("رضا", 1), ("علی رضا", 2)], "manager_key string, center_code int")
    names = spark.createDataFrame([("ب" * 20_000 + " علی رضا",), ("رضا",), ("کس",)], "m string")
    got = center_from_manager(names, "m", mapping).select("m", "manager_center", "manager_match").collect()
    assert {(len(r.m) > 100, r.manager_center, r.manager_match) for r in got} == {
        (True, 2, "manager_substring"), (False, 1, "manager_exact"), (False, 0, "manager_wildcard"),
    }
