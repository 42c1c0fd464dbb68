"""Cells that no table holds, put beside every supplier; the check SQL states each expected value itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from matchloom.functions import ids, keys, text
from matchloom.plans.registry import query


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hard_query(name: str, cases: Sequence[tuple[str, str]], rule) -> None:
    """Case s_suppkey modulo their number for each supplier: what ``rule`` makes of the cell against the stated value."""
    expected = "[" + ", ".join(_sql(want) for _, want in cases) + "]"

    @query(name, f"SELECT s_suppkey, list_extract({expected}, CAST(s_suppkey % {len(cases)} AS INTEGER) + 1) AS made FROM supplier")
    def run(t):
        suppliers = t.supplier.select("s_suppkey")
        cells = F.array(*[F.lit(cell) for cell, _ in cases])
        return suppliers.withColumn("cell", F.get(cells, F.col("s_suppkey") % len(cases))).select("s_suppkey", rule("cell").alias("made"))


_hard_query(
    "N1_norm_text_ligatures",
    [("\ufc9e", "بخ"), ("\ufcfe", "شی"), ("\ufdfa", "صلی ل علیه وسلم"), ("½", "1 2"), ("⑩", "10"), ("𝟗 x", "9"), ("ﻻ ﷲ", "لا ل")],
    text.norm_text,
)
_hard_query(
    "N2_numlike_long",
    [("1." + "7" * 450 + ".5", "1." + "7" * 450 + "5"), ("-" + "9" * 450, "-" + "9" * 450), ("1.2.3.4", "1.234"), (".5.3", "0.53"), ("0" * 500 + "1", "1")],
    text.numlike,
)
# One digit for how long the length is, the length, the digits.
_hard_query(
    "N16_natural_key_long",
    [("A" + "9" * 99, "a\x01299" + "9" * 99), ("A" + "1" * 100, "a\x013100" + "1" * 100), ("a007-12", "a\x01117-\x011212")],
    ids.natural_key,
)
_hard_query(
    "N9_wide_ranges",
    [("1-2999999999", "2999999999"), ("2999999999", "2999999999"), ("7 9223372036854775807-9223372036854775800", "9223372036854775807")],
    lambda c: F.regexp_extract(F.array_join(keys.invalid_group_codes(c), ","), "([0-9]+)$", 1),
)
