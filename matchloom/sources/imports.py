"""Import of one raw report: headers, typing, keys, duplicate check, cache."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import KEYS, Policy
from matchloom.operators import keys_check, standardise
from matchloom.operators.numbering import last_row
from matchloom.sources import tables


@dataclass
class Imported:
    """Canonical rows with the issues found on the way."""

    rows: DataFrame
    header_issues: DataFrame
    key_issues: DataFrame
    domain_issues: DataFrame | None


def import_kind(df: DataFrame, kind: str, aliases: Mapping[str, str], row: str, policy: Policy | None = None, path: str | None = None) -> Imported:
    """``kind`` is 'students', 'mentors' or 'forms'; with ``path`` the rows are cached."""
    resolved, header_issues = standardise.resolve_headers(df, aliases)
    if kind == "forms":
        rows = last_row(resolved.where(F.col("entry_id").isNotNull()), ["entry_id"], ["received_at", row])
        empty = header_issues.where(F.lit(False))
        if path:
            rows.write.mode("overwrite").parquet(path)
        return Imported(rows, header_issues, empty, None)
    # The keys are judged on their raw cells, the other columns are typed.
    raw = [F.col(k).alias(f"__raw_{k}") if k in KEYS else F.col(k) for k in resolved.columns]
    typed = standardise.coerce_semantics(resolved.select(*raw), "report" if kind == "students" else "inspactor")
    cells = [k for k in KEYS if k in resolved.columns]
    rest = [c for c in resolved.columns if c not in KEYS and c != row]
    rows, issues = keys_check.split_valid_keys(typed.select(row, *rest, *[F.col(f"__raw_{k}").alias(k) for k in cells]), kind, row, None, policy)
    domain = None
    if kind == "students":
        rows, domain = keys_check.student_domain_split(rows, row)
    if path:
        policy = policy or Policy()
        if kind == "students":
            tables.write_students_cache(rows, path)
        else:
            tables.write_pool_cache(rows, path, policy.version, tables.columns_fingerprint(rows.columns))
    return Imported(rows, header_issues, issues, domain)
