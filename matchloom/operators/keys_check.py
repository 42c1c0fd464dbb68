"""Key validation: canonical rows, issue rows, id integrity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import KEYS, VALID_CODES, Policy
from matchloom.functions import keys
from matchloom.operators.numbering import lookup


def _stack(df: DataFrame, keep: Sequence[str], entries) -> DataFrame:
    """Long rows (column, raw_value, error_code) from per-column expressions, non-null codes only."""
    items = [
        F.struct(F.lit(c).alias("column"), raw.cast("string").alias("raw_value"), code.alias("error_code"))
        for c, raw, code in entries
    ]
    return df.select(*keep, F.explode(F.array(*items)).alias("x")).select(*keep, "x.*").where(
        F.col("error_code").isNotNull()
    )


def split_valid_keys(
    df: DataFrame, entity: str, row: str, columns: dict[str, str] | None = None, policy: Policy | None = None
) -> tuple[DataFrame, DataFrame]:
    """Canonical rows (all six keys usable) and issue rows.

    ``columns`` maps key -> raw column; a raw column that does not exist makes every row
    an issue with ``MISSING_COLUMN``.
    """
    columns = columns or {k: k for k in KEYS}
    values, entries = {}, []
    for key in KEYS:
        raw = columns[key]
        if raw not in df.columns:
            value, code = F.lit(None).cast("bigint"), F.lit("MISSING_COLUMN")
            entries.append((key, F.lit(None), code))
        else:
            value, code = keys.canonical_key(raw, key, policy)
            entries.append((key, F.col(raw), code))
        values[f"__v_{key}"] = value.alias(f"__v_{key}")
    issues = _stack(df, [row], entries).select(
        F.lit(entity).alias("entity_type"), F.col(row).alias("row_index"), "column", "raw_value", "error_code"
    )
    # A generator keeps the filters on the values, here and downstream, from stating them over again.
    valid = df.select("*", F.inline(F.array(F.struct(*values.values())))).dropna(subset=list(values))
    keep = [c for c in df.columns if c not in KEYS]
    return valid.select(*keep, *[F.col(f"__v_{k}").alias(k) for k in KEYS]), issues


def student_domain_split(df: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """Missing group, missing status, or a status the group does not allow."""
    allowed = keys.allowed_statuses("group_code", F.lit(False))
    code = (
        F.when(F.col("group_code").isNull(), F.lit("MISSING_GROUP_CODE"))
        .when(F.col("grad_status_code").isNull(), F.lit("MISSING_GRADUATION_STATUS"))
        .when(~F.array_contains(allowed, F.col("grad_status_code")), F.lit("INVALID_GRADUATION_FOR_GROUP"))
    )
    tagged = df.withColumn("error_code", code).withColumn("allowed", F.array_join(allowed.cast("array<string>"), ","))
    issues = tagged.where(F.col("error_code").isNotNull()).select(
        F.col(row).alias("row_index"), "group_code", "grad_status_code", "allowed", "error_code"
    )
    return tagged.where(F.col("error_code").isNull()).drop("error_code", "allowed"), issues


def numeric_key_issues(df: DataFrame, entity: str, row: str) -> DataFrame:
    """Missing column, missing value or non-integer text per key."""
    entries = []
    for key in KEYS:
        if key not in df.columns:
            entries.append((key, F.lit(None), F.lit("MISSING_JOIN_KEY_COLUMN")))
            continue
        text = F.trim(F.col(key).cast("string"))
        entries.append(
            (
                key,
                F.col(key),
                F.when(text.isNull() | (text == ""), F.lit("MISSING_JOIN_KEY_VALUE")).when(
                    ~text.rlike("^[+-]?[0-9]+$"), F.lit("UNKNOWN_JOIN_KEY_VALUE")
                ),
            )
        )
    return _stack(df, [row], entries).select(F.lit(entity).alias("entity_type"), F.col(row).alias("row_index"), "column", "raw_value", "error_code")


def id_integrity(df: DataFrame, spine: DataFrame, column: str, row: str) -> DataFrame:
    """Missing, duplicate or unknown ids, one row each."""
    sizes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    tagged = lookup(df.select(row, column), sizes, [column], ["__n"], "left")
    known = spine.select(column).distinct().withColumn("__known", F.lit(True))
    tagged = lookup(tagged, known, [column], ["__known"], "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col(column).isNull(), F.lit("missing")),
            F.when(F.col("__n") > 1, F.lit("duplicate")),
            F.when(F.col(column).isNotNull() & F.col("__known").isNull(), F.lit("unknown")),
        )
    )
    return tagged.select(row, column, F.explode(codes).alias("violation"))


def valid_group_rows(df: DataFrame, level_ok: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Reference rows with a valid code and level; the rest is rejected."""
    ok = F.col("group_code").isin(*VALID_CODES) & F.col("level").isin(*level_ok)
    return df.where(F.coalesce(ok, F.lit(False))), df.where(~F.coalesce(ok, F.lit(False)))
