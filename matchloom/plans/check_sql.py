"""Building blocks of the check SQL (DuckDB dialect)."""

from __future__ import annotations

from matchloom.config import VALID_CODES
from matchloom.functions import text as t



def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def blankable(x: str) -> str:
    tokens = ", ".join(q(v) for v in t.NAN_TOKENS)
    s = f"CAST({x} AS VARCHAR)"
    return f"(CASE WHEN {s} IS NULL OR lower(trim({s})) IN ({tokens}) THEN '' ELSE {s} END)"


def digits(x: str) -> str:
    return f"translate(CAST({x} AS VARCHAR), {q(t.FOREIGN_DIGITS)}, {q(t.ASCII_DIGITS)})"


def norm(x: str) -> str:
    s = f"translate({blankable(x)}, {q(t.FOLD_FROM)}, {q(t.FOLD_TO)})"
    s = f"regexp_replace({s}, '\\p{{M}}+', '', 'g')"
    s = f"regexp_replace({s}, '[ﻵ-ﻼ]', 'لا', 'g')"
    s = f"regexp_replace({s}, '(ﷲ|الله)', 'ل', 'g')"
    s = f"trim(regexp_replace({s}, '[^0-9؀-ۿ]+', ' ', 'g'))"
    return f"regexp_replace({s}, '^(ل )+ل$', 'ل')"


def numlike(x: str) -> str:
    src = t.FOREIGN_DIGITS + "−٫" + t.NUM_DROP
    v = f"translate({blankable(x)}, {q(src)}, {q(t.ASCII_DIGITS + '-.')})"
    kept = f"regexp_replace({v}, '[^0-9.]', '', 'g')"
    whole = f"coalesce(nullif(ltrim(split_part({kept}, '.', 1), '0'), ''), '0')"
    frac = f"rtrim(replace(regexp_extract({kept}, '\\.(.*)$', 1), '.', ''), '0')"
    body = f"({whole} || CASE WHEN {frac} = '' THEN '' ELSE '.' || {frac} END)"
    return (
        f"(CASE WHEN {kept} = '' THEN '' WHEN contains({v}, '-') AND {body} <> '0' "
        f"THEN '-' || {body} ELSE {body} END)"
    )


def int_part(x: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({numlike(x)}, '^(-?[0-9]+)', 1) AS BIGINT), 0)"


def clean(x: str) -> str:
    src = t.FOREIGN_DIGITS + t.BIDI_DROP + " "
    return f"trim(translate(coalesce(CAST({x} AS VARCHAR), ''), {q(src)}, {q(t.ASCII_DIGITS)}))"


def to_long(x: str) -> str:
    c = clean(x)
    return (
        f"(CASE WHEN regexp_matches({c}, '^[+-]?[0-9]+(\\.0*)?$') "
        f"THEN TRY_CAST(regexp_extract({c}, '^([+-]?[0-9]+)', 1) AS BIGINT) END)"
    )


def natural(x: str) -> str:
    s = digits(f"trim(coalesce(CAST({x} AS VARCHAR), ''))")
    d = "coalesce(nullif(ltrim(p, '0'), ''), '0')"
    return (
        f"array_to_string(list_transform(regexp_extract_all({s}, '[0-9]+|[^0-9]+'), lambda p: "
        f"CASE WHEN regexp_matches(p, '^[0-9]') THEN chr(1) || length(CAST(length({d}) AS VARCHAR)) || length({d}) || {d} "
        f"ELSE lower(p) END), '')"
    )


def phone_digits(x: str) -> str:
    s = f"trim({digits(f'replace({blankable(x)}, chr(1643), chr(46))')})"
    return (
        f"nullif(CASE WHEN regexp_matches({s}, '^[0-9]+\\.0+$') "
        f"THEN coalesce(nullif(ltrim(split_part({s}, '.', 1), '0'), ''), '0') "
        f"ELSE regexp_replace({s}, '[^0-9]', '', 'g') END, '')"
    )


def mobile(x: str) -> str:
    d = phone_digits(x)
    return (
        f"(CASE WHEN regexp_matches({d}, '^9[0-9]{{9}}$') THEN '0' || {d} "
        f"WHEN regexp_matches({d}, '^09[0-9]{{9}}$') THEN {d} END)"
    )


def national(x: str) -> str:
    d = phone_digits(x)
    return f"lpad(right({d}, 10), 10, '0')"


def gender(x: str, default: str = "1") -> str:
    raw = f"lower(trim(coalesce(CAST({x} AS VARCHAR), '')))"
    pad = f"(' ' || {norm(x)} || ' ')"
    num = f"regexp_extract({digits(raw)}, '^([0-9]+)([.٫]0+)?$', 1)"
    return f"""CAST(CASE WHEN {raw} IN ('1','male','m','boy','♂') THEN 1
  WHEN {raw} IN ('0','female','f','girl','♀') THEN 0
  WHEN contains({pad}, ' پسر ') OR contains({pad}, ' مذکر ') THEN 1
  WHEN contains({pad}, ' دختر ') OR contains({pad}, ' مونث ') THEN 0
  WHEN TRY_CAST({num} AS BIGINT) IN (0, 1) THEN TRY_CAST({num} AS BIGINT)
  ELSE {default} END AS BIGINT)"""


VALID = "[" + ",".join(str(c) for c in VALID_CODES) + "]"


def code_bounds(x: str) -> str:
    """Bounds of all codes and ranges of a group cell, as a list of (lo, hi)."""
    text = f"replace({digits(f'coalesce(CAST({x} AS VARCHAR), chr(32))')}, '-', ':')"
    tokens = f"list_filter(regexp_split_to_array(trim({text}), '[,،\\s]+'), lambda k: k <> '')"
    d = lambda e: f"TRY_CAST(regexp_replace({e}, '[^0-9]', '', 'g') AS BIGINT)"
    lo, hi = d("split_part(k, ':', 1)"), d("CASE WHEN contains(k, ':') THEN regexp_extract(k, ':(.*)$', 1) ELSE k END")
    pair = f"CASE WHEN {lo} IS NULL OR {hi} IS NULL THEN NULL ELSE {{'lo': least({lo}, {hi}), 'hi': greatest({lo}, {hi})}} END"
    return f"list_filter(list_transform({tokens}, lambda k: {pair}), lambda b: b IS NOT NULL)"


def valid_codes(x: str) -> str:
    """Sorted valid codes of a group cell."""
    return f"list_sort(list_filter({VALID}, lambda v: len(list_filter({code_bounds(x)}, lambda b: v BETWEEN b.lo AND b.hi)) > 0))"


def invalid_codes(x: str) -> str:
    """Sorted texts of what the cell names outside the valid codes: single codes and 'lo-hi' stretches."""
    codes = sorted(VALID_CODES)
    low, high = [0, *(c + 1 for c in codes)], [*(c - 1 for c in codes), (1 << 63) - 1]
    gaps = "[" + ", ".join(f"{{'lo': {a}::BIGINT, 'hi': {b}::BIGINT}}" for a, b in zip(low, high, strict=True) if a <= b) + "]"
    rest = f"flatten(list_transform({code_bounds(x)}, lambda b: list_filter(list_transform({gaps}, lambda g: {{'lo': greatest(g.lo, b.lo), 'hi': least(g.hi, b.hi)}}), lambda r: r.lo <= r.hi)))"
    shown = "lambda r: CASE WHEN r.lo = r.hi THEN CAST(r.lo AS VARCHAR) ELSE r.lo || '-' || r.hi END"
    return f"list_transform(list_sort(list_distinct({rest})), {shown})"
