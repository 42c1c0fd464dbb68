"""Reading, checking and writing the tables of a run.

Reports arrive as landed CSV or Parquet. Writes go to a staging folder that is renamed
once every table is complete, so a reader never sees half a run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import KEYS, group_dim
from matchloom.functions import text
from matchloom.operators.numbering import number_rows


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """Load a report; CSV stays text so that codes keep their zeros."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.option("header", True).option("inferSchema", False).csv(path)
    return reader.format(fmt).load(path)


def contract_issues(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Missing columns from the schema and null counts from one pass, as rows."""
    spark = df.sparkSession
    present = [c for c in required if c in df.columns]
    absent = [c for c in required if c not in df.columns]
    parts = []
    if present:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).cast("bigint").alias(c) for c in present])
        items = [F.struct(F.lit(c).alias("field"), F.lit("NULL_VALUES").alias("issue"), F.col(c).alias("rows")) for c in present]
        parts.append(counts.select(F.explode(F.array(*items)).alias("x")).select("x.*").where(F.col("rows") > 0))
    if absent:
        parts.append(spark.createDataFrame([(c, "MISSING_COLUMN", None) for c in absent], "field string, issue string, rows bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def add_lineage(df: DataFrame, order: Sequence[Column], levels, name: str = "src_ordinal") -> DataFrame:
    """Stable dense ordinal in a declared order (see ``number_rows``), zero based."""
    return number_rows(df, order, levels, name=name).withColumn(name, F.col(name) - 1)


def load_schools(df: DataFrame, defaults: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Canonical school reference, repeated codes, and notes on defaulted columns."""
    out, notes = df, []
    for column, default in (defaults or {}).items():
        if column not in df.columns:
            out = out.withColumn(column, F.lit(default))
            notes.append(f"{column} defaulted to {default!r}")
    out = out.withColumn("school_code", text.numlike_long("school_code"))
    repeated = out.groupBy("school_code").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return out, repeated, notes


def load_group_codes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid (code, level) rows with a display name from grade and track; rejected rows."""
    dim = group_dim(df.sparkSession)
    codes = dim.select(F.col("group_code").alias("__g")).withColumn("__code_ok", F.lit(True))
    levels = dim.select(F.col("level").alias("__l")).distinct().withColumn("__level_ok", F.lit(True))
    out = df.join(F.broadcast(codes), F.col("group_code") == F.col("__g"), "left")
    out = out.join(F.broadcast(levels), F.col("level") == F.col("__l"), "left")
    reason = F.when(F.col("__code_ok").isNull(), F.lit("INVALID_CODE")).when(F.col("__level_ok").isNull(), F.lit("UNKNOWN_LEVEL"))
    out = out.withColumn("reason", reason).drop("__g", "__l", "__code_ok", "__level_ok")
    name = F.concat_ws(" ", F.nullif(F.trim("grade"), F.lit("")), F.nullif(F.trim("track"), F.lit("")))
    good = out.where(F.col("reason").isNull()).drop("reason").withColumn("display_name", name)
    return good, out.where(F.col("reason").isNotNull())


def load_managers(df: DataFrame, pii: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Managers without personal columns, trimmed and typed; repeated (manager, center) keys."""
    out = df.drop(*pii).select(
        F.nullif(F.trim("manager"), F.lit("")).alias("manager"), text.numlike_long("center_code").alias("center_code"),
        *[c for c in df.columns if c not in (*pii, "manager", "center_code")],
    ).dropna(subset=["manager", "center_code"])
    repeated = out.groupBy("manager", "center_code").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    return out, repeated


def _fail_if_any(df: DataFrame, message: str) -> None:
    sample = df.limit(5).collect()
    if sample:
        raise ValueError(f"{message}; sample {[r.asDict() for r in sample]}")


def write_cache(df: DataFrame, path: str, keys: Sequence[str], stamp: Mapping[str, str] | None = None) -> None:
    """Keyed overwrite with a uniqueness check and optional version columns."""
    _fail_if_any(df.groupBy(*keys).count().where(F.col("count") > 1), f"keys {list(keys)} repeat")
    for name, value in (stamp or {}).items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("overwrite").parquet(path)


def load_cache(spark: SparkSession, path: str, stamp: Mapping[str, str] | None = None) -> DataFrame:
    """Typed read back; a mixed or stale version is refused."""
    df = spark.read.parquet(path)
    if stamp:
        found = df.select(*stamp).distinct().limit(2).collect()
        if found and (len(found) > 1 or any(found[0][k] != v for k, v in stamp.items())):
            raise ValueError(f"cache version is mixed or stale: {[r.asDict() for r in found]}, expected {dict(stamp)}")
    return df


def write_students_cache(df: DataFrame, path: str) -> None:
    write_cache(df, path, ["student_id"])


def write_pool_cache(df: DataFrame, path: str, version: str, digest: str) -> None:
    write_cache(df, path, ["mentor_id", *KEYS], {"policy_version": version, "policy_hash": digest})


def version_state(df: DataFrame, version: str, digest: str) -> DataFrame:
    """Rows, distinct stamps and whether the pool may be used."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("policy_version", "policy_hash").alias("versions"),
        F.coalesce(F.bool_and((F.col("policy_version") == version) & (F.col("policy_hash") == digest)), F.lit(True)).alias("usable"),
    )


def metric_rows(kpis: DataFrame, key: Sequence[str], run_id: str) -> DataFrame:
    """Wide KPI table -> one row per (run, key, metric)."""
    values = [c for c in kpis.columns if c not in key]
    wide = kpis.select(*key, *[F.col(c).cast("double").alias(c) for c in values])
    return wide.unpivot(list(key), values, "metric", "value").withColumn("run_id", F.lit(run_id))


def append_run(path: str, run_id: str, tables: Mapping[str, DataFrame]) -> None:
    """Append a run; every table is partitioned by run so one run is a folder."""
    for name, df in tables.items():
        out = df if "run_id" in df.columns else df.withColumn("run_id", F.lit(run_id))
        out.write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def load_run_evidence(spark: SparkSession, path: str, run_id: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """One run's tables; the filter prunes to the run's folder."""
    return {n: spark.read.parquet(f"{path}/{n}").where(F.col("run_id") == run_id) for n in names}


def row_hashes(df: DataFrame, name: str = "row_hash") -> DataFrame:
    """Content hash per row with naturally ordered columns and normalised scalars."""
    cols = sorted(df.columns)
    return df.withColumn(
        name, F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("\u0000")) for c in cols]), 256)
    )


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-independent sum over the whole row hashes (eight words of 32 bits each)."""
    word = lambda k: F.sum(F.conv(F.substring("row_hash", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)"))
    total = F.concat_ws("-", *[F.coalesce(word(k), F.lit(0)).cast("string") for k in range(8)])
    return row_hashes(df).agg(F.count(F.lit(1)).alias("rows"), total.alias("hash_sum"))


def archive_snapshot(df: DataFrame, path: str, meta: Mapping[str, str], limit: int | None = None) -> DataFrame:
    """Store ordered columns with a fingerprint of the whole table.

    A table of more than ``limit`` rows is only described: no row of it is stored, and
    ``truncated`` says so; comparing such an archive is refused by ``stored_snapshot``.
    """
    ordered = df.select(*sorted(df.columns))
    info = content_fingerprint(ordered).withColumn("truncated", F.col("rows") > F.lit(limit) if limit is not None else F.lit(False))
    for k, v in meta.items():
        info = info.withColumn(k, F.lit(v))
    info.write.mode("overwrite").parquet(f"{path}/meta")
    info = df.sparkSession.read.schema(info.schema).parquet(f"{path}/meta")
    if not info.first()["truncated"]:
        ordered.write.mode("overwrite").parquet(f"{path}/rows")
    return info


def stored_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an archive; one that was only described can't be compared."""
    if spark.read.parquet(f"{path}/meta").first()["truncated"]:
        raise ValueError(f"{path} holds a description only, no rows to compare")
    return spark.read.parquet(f"{path}/rows")


def header_mode(df: DataFrame, names: Mapping[str, str], mode: str) -> DataFrame:
    """Headers in one language or both; ``names`` maps English to Persian."""
    label = {"en": lambda c: c, "fa": lambda c: names.get(c, c), "fa_en": lambda c: f"{names[c]} | {c}" if c in names else c}[mode]
    return df.select(*[F.col(f"`{c}`").alias(label(c)) for c in df.columns])


def columns_fingerprint(columns: Sequence[str]) -> str:
    import hashlib

    return hashlib.sha256("|".join(columns).encode("utf-8")).hexdigest()


def write_outputs(frames: Mapping[str, DataFrame], path: str, names: Mapping[str, str], mode: str = "fa_en") -> dict[str, str]:
    """One dataset per logical sheet, all or nothing; returns the column fingerprints."""
    spark = next(iter(frames.values())).sparkSession
    staging = f"{path}.__staging"
    jvm = spark._jvm
    target, stage = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staging)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{path} exists; write each run to a new folder")
    prints = {}
    for name, df in frames.items():
        out = header_mode(df, names, mode)
        out.write.mode("overwrite").parquet(f"{staging}/{name}")
        prints[name] = columns_fingerprint(out.columns)
    if not fs.rename(stage, target):
        raise IOError(f"could not move {staging} to {path}")
    return prints


def table_counts(tables: Mapping[str, DataFrame], refreshed: str | None = None) -> DataFrame:
    """Row count per table, with the refresh time when given."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("refreshed_at", F.lit(refreshed)) if refreshed else out


def reference_readiness(tables: Mapping[str, DataFrame]) -> DataFrame:
    return table_counts(tables).select("table_name", (F.col("rows") > 0).alias("ready"))


def write_crosswalk(groups: DataFrame, synonyms: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").parquet(f"{path}/groups")
    synonyms.write.mode("overwrite").parquet(f"{path}/synonyms")


def load_crosswalk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/groups"), spark.read.parquet(f"{path}/synonyms")
