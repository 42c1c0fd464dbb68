"""Form entries as a stream: flatten, filter, keep the last arrival per entry."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.numbering import last_row


def _first_present(df: DataFrame, names: Sequence[str]):
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def flatten_entries(raw: DataFrame, fields: Sequence[str] = ()) -> DataFrame:
    """Id, form and arrival time from their alternative columns, map fields to columns."""
    picked = [F.try_element_at("fields", F.lit(f)).alias(f) for f in fields] if "fields" in raw.columns else []
    return raw.select(
        F.nullif(F.trim(_first_present(raw, ("id", "entry_id")).cast("string")), F.lit("")).alias("entry_id"),
        _first_present(raw, ("form_id", "formId")).cast("string").alias("form_id"),
        _first_present(raw, ("date_created", "created_at", "submitted_at", "received_at")).cast("timestamp").alias("received_at"),
        *[F.col(c) for c in raw.columns if c == "event_id"],
        *picked,
    )


def stream_entries(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", fields: Sequence[str] = (), files_per_trigger: int | None = None,
    normaliser: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Entry stream from landed files; offsets and replays are the source's own. ``normaliser`` takes the place of ``flatten_entries``."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return normaliser(reader.load(path)) if normaliser else flatten_entries(reader.load(path), fields)


def incremental_since(df: DataFrame, since: str, column: str = "received_at") -> DataFrame:
    """Entries that arrived at or after a time; the predicate reaches the scan."""
    return df.where(F.col(column) >= F.lit(since).cast("timestamp"))


def privacy_hook(df: DataFrame, hook: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """User function applied before anything is stored."""
    return df.transform(hook) if hook else df


def latest_entries(df: DataFrame, key: str = "entry_id", order: Sequence[str] = ("received_at", "event_id")) -> DataFrame:
    """Last arrival per key; rows without a key are dropped."""
    return last_row(df.where(F.col(key).isNotNull()), [key], [c for c in order if c in df.columns])


def normalise_rows(raw: DataFrame, fields: Mapping[str, tuple[str, str]], payload: str = "payload") -> DataFrame:
    """Typed columns from a JSON payload whose shape the forms decide: name -> (path, type), for example ("$.meta.kind", "string").

    Adds ``malformed`` (the payload is no JSON object), ``wrong_types`` (fields that are there in another type) and
    ``unknown_fields`` (top-level names that no path begins with), both sorted. A field that is missing,
    null or of another type is null; a null payload has nothing and is not malformed. Other columns are kept.
    """
    value = F.try_parse_json(payload)
    known = sorted({re.split(r"[.\[]", path.removeprefix("$").lstrip("."))[0] for path, _ in fields.values()})
    keys = F.json_object_keys(payload)
    typed = {name: F.try_variant_get(value, path, kind) for name, (path, kind) in fields.items()}
    there = {n: F.try_variant_get(value, p, "variant") for n, (p, _) in sorted(fields.items())}
    wrong = [F.when(F.col(n).isNull() & v.isNotNull() & ~F.is_variant_null(v), F.lit(n)) for n, v in there.items()]
    text = F.array().cast("array<string>")
    out = raw.select(*[F.col(c) for c in raw.columns if c not in fields], *[c.alias(n) for n, c in typed.items()])
    return out.withColumns({
        "malformed": F.col(payload).isNotNull() & keys.isNull(),
        "wrong_types": F.array_compact(F.array(*wrong)) if wrong else text,
        "unknown_fields": F.coalesce(F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in known]) if known else text)), text),
    })


def run_once(entries: DataFrame, target: str, checkpoint: str, run: str) -> DataFrame:
    """The entries that have landed since the last run on ``checkpoint``, stored as ``target``/run=``run``.

    A run ends when it has read what is there; the next one, on the same checkpoint, goes on after it. A
    batch that is replayed overwrites its own folder.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/run={run}/batch={batch_id}")

    entries.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = _present(entries.sparkSession, f"{target}/run={run}")
    return entries.sparkSession.createDataFrame([], entries.schema) if found is None else found.drop("batch")


def _present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _state(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The state after the newest batch, or after the newest one below a number."""
    marks = _present(spark, f"{target}/marks")
    if marks is None:
        return None
    marks = marks if below is None else marks.where(F.col("number") < below)
    newest = marks.agg(F.max_by("slot", "number").alias("slot")).first()["slot"]
    return None if newest is None else spark.read.parquet(f"{target}/state/{newest}")


def upsert_latest(
    entries: DataFrame, target: str, checkpoint: str, key: str = "entry_id",
    order: Sequence[str] = ("received_at", "event_id"), hook: Callable[[DataFrame], DataFrame] | None = None, slots: int = 4,
):
    """Keep the last arrival per key; returns the started query.

    Each batch is reduced, joined with the state before it, and written as a new version of the state; then its
    number is marked. Versions take turns in ``slots`` folders, so a reader has that many batches' time, and
    a replayed batch starts from the version before its own and changes nothing. Of arrivals that tie in
    ``order`` the later batch wins.
    """
    spark = entries.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = privacy_hook(latest_entries(batch, key, order), hook).withColumn("__new", F.lit(1))
        before = _state(spark, target, batch_id)
        if before is not None:
            rows = before.withColumn("__new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
        state = last_row(rows, [key], [*[c for c in order if c in rows.columns], "__new"]).drop("__new")
        slot = f"slot-{batch_id % slots}"
        state.write.mode("overwrite").parquet(f"{target}/state/{slot}")
        mark = spark.createDataFrame([(batch_id, slot)], "number long, slot string").coalesce(1)
        mark.write.mode("overwrite").parquet(f"{target}/marks/batch={batch_id}")

    return entries.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str) -> DataFrame:
    """Current state of an upsert target."""
    state = _state(spark, target)
    if state is None:
        raise FileNotFoundError(f"no batch in {target}")
    return state
