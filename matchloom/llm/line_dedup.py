"""Repeated multi-line chunks: content-defined chunks of lines, removed after their first occurrence.

Every line that isn't blank gets 32 boundary bits, a hash of its own text. A chunk begins at each line and
ends at the nearest of the next ``REACH`` lines with a boundary bit in common with it: nearly always the next
one, else one after. A chunk therefore depends on its own lines alone, wherever it stands: an insertion moves
no boundary, and a repeated passage is covered from its first line to its last by chunks that repeat with it. A
chunk's hash is the rolling polynomial over its line hashes; equal hashes are compared by all bytes before
anything goes. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.shared import stored, work_folder

MODULUS, FACTOR = 2147483647, 131
#: Lines after the first among which a chunk may end. Two lines share no bit with probability 1e-4.
REACH = 4


def line_bits(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def with_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the columns that tell documents apart and order them: null ids first, then by id and hash of the text."""
    made = {"__null": F.col("doc_id").isNotNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__th": F.xxhash64("text")}
    return docs.withColumns(made), list(made)


def later_copies(bare: DataFrame, key: list[str], cut: Callable, hashed: Column, bytes_of: Callable) -> DataFrame:
    """key and __gone: the numbers of the parts whose bytes occur in an earlier part, by (key, number).

    ``cut`` adds the columns from which ``hashed`` makes an array of (no, h) and ``bytes_of`` the bytes of a part.
    """
    folder = work_folder(bare.sparkSession, "line-dedup")
    # Light rows first: only hashes are counted.
    chunks = stored(cut(bare).select(*key, F.explode(hashed).alias("c")).select(*key, "c.no", "c.h"), folder, "chunks")
    place = F.struct(*key, "no")
    repeated = chunks.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    marked = stored(chunks.join(repeated, "h").select(*key, "no", "h", (place == F.col("first")).alias("is_first")).distinct(), folder, "marked")
    # Then the bytes of those chunks alone. Texts meet their few marked chunks by a merge join at
    # any size: nothing is known about the size of either side that would bound a broadcast.
    wanted = marked.groupBy(*key).agg(F.collect_list(F.struct("no", "h", "is_first")).alias("__wanted"))
    texts = cut(bare.join(wanted.hint("merge"), key)).select(*key, F.explode(F.transform("__wanted", lambda w: F.struct(w["no"].alias("no"), w["h"].alias("h"), w["is_first"].alias("is_first"), bytes_of(w["no"]).alias("bytes")))).alias("w"))
    texts = stored(texts.select(*key, "w.*").distinct(), folder, "texts")
    first = texts.where("is_first").select("h", F.col("bytes").alias("first_bytes"))
    gone = texts.where("not is_first").join(first, "h").where("bytes = first_bytes").groupBy(*key).agg(F.collect_set("no").alias("__gone"))
    return stored(gone, folder, "gone")


def with_results(joined: DataFrame, docs: DataFrame, key: list[str], counts: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` with __text of ``joined`` as the text, and the counts."""
    names = [c for c in docs.columns if c not in key]
    # The results come out of a generator of one row: a filter on them stays above it, instead of
    # pulling the array functions, which would then be computed for every element, into itself.
    made = F.struct(F.col("__text").alias("__text"), *[v.alias(k) for k, v in counts.items()])
    rest = [F.col(f"`{c}`") for c in names if c != "text"]
    out = joined.select(*rest, F.explode(F.array(made)).alias("__r"))
    return out.select(*[F.col("__r.__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], *[F.col(f"__r.{k}").alias(k) for k in counts])


def with_units(docs: DataFrame) -> DataFrame:
    """Adds __lines, and __units: index, text and boundary bits of the lines that aren't blank."""
    docs = docs.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    filled = F.filter(F.transform("__lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda u: u["x"].rlike(r"\S"))
    return docs.withColumn("__units", F.transform(filled, lambda u: F.struct(u["i"].alias("i"), u["x"].alias("x"), line_bits(u["x"]).alias("b"))))


def unit(no: Column) -> Column:
    return F.get("__units", no)


def chunk_ends() -> Column:
    """For each unit the number of the unit that ends its chunk, null where none of the next ``REACH`` does."""

    def end(u: Column, i: Column) -> Column:
        out = F.lit(None).cast("int")
        for step in reversed(range(1, REACH + 1)):
            out = F.when(unit(i + step)["b"].bitwiseAND(u["b"]) != 0, i + step).otherwise(out)
        return out

    return F.transform("__units", end)


def with_chunks(docs: DataFrame) -> DataFrame:
    """``with_units`` and __ends, the last unit of each unit's chunk."""
    return with_units(docs).withColumn("__ends", chunk_ends())


def chunk_units(no: Column) -> Column:
    """Units of the chunk that begins at unit ``no``."""
    return F.slice("__units", no + 1, F.get("__ends", no) - no + 1)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the new ``text``, and n_lines, n_chunks, removed_chunks, removed_lines.

    A chunk goes, with the blank lines inside it, if equal bytes are a chunk in an earlier place, by (doc_id,
    hash of the text, number in the document); null ids are first. So the first occurrence of
    a line always stays, a single repeated line stays, and a repeated passage of two lines or more goes
    whole, but for the rare line that shares no bit with those after it. Documents are never dropped; one
    of which all is repeated keeps an empty text. A null text stays null and has no lines.
    Rows that share doc_id and text are the same document and fare alike. Columns named like the
    four counts are replaced.
    """
    docs, key = with_key(docs.drop("n_lines", "n_chunks", "removed_chunks", "removed_lines"))

    def rolled(units: Column) -> Column:
        return F.aggregate(units, F.lit(7).cast("bigint"), lambda h, u: (h * FACTOR + u["b"]) % MODULUS)

    begun = F.filter(F.sequence(F.lit(0), F.size("__units") - 1), lambda i: F.get("__ends", i).isNotNull())
    begun = F.when(F.size("__units") > 0, begun).otherwise(F.array().cast("array<int>"))
    # The polynomial and a hash of the texts side by side: chunks that agree in both are nearly always equal.
    hashed = F.transform(begun, lambda i: F.struct(i.alias("no"), F.xxhash64(rolled(chunk_units(i)), F.transform(chunk_units(i), lambda u: u["x"])).alias("h")))
    bytes_of = lambda no: F.array_join(F.transform(chunk_units(no), lambda u: u["x"]), "\n")
    gone = later_copies(docs.select(*key, "text"), key, with_chunks, hashed, bytes_of)
    joined = with_chunks(docs.join(gone.hint("merge"), key, "left"))
    has = F.col("__gone").isNotNull() & F.col("text").isNotNull()
    out = F.flatten(F.transform("__gone", lambda no: F.sequence(unit(no)["i"], unit(F.get("__ends", no))["i"])))
    joined = joined.withColumn("__kept", F.when(has, F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), out)))
    joined = joined.withColumn("__text", F.when(has, F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")).otherwise(F.col("text")))
    some = F.col("text").isNotNull()
    counts = {
        "n_lines": F.when(some, F.size("__lines")).otherwise(0).cast("bigint"),
        "n_chunks": F.when(some, F.size(F.filter("__ends", lambda e: e.isNotNull()))).otherwise(0).cast("bigint"),
        "removed_chunks": F.when(has, F.size("__gone")).otherwise(0).cast("bigint"),
        "removed_lines": F.when(has, F.size("__lines") - F.size("__kept")).otherwise(0).cast("bigint"),
    }
    return with_results(joined, docs, key, counts)


def dedup_summary(docs: DataFrame) -> DataFrame:
    """doc_id, the four counts, n_chars and text_md5 of every document's remaining text (null: empty)."""
    done = dedup_lines(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    text = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.length(text).cast("bigint").alias("n_chars"), F.md5(text).alias("text_md5"))


SQL = """
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM cut),
units AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS u, ('0x' || substr(md5(line), 1, 8))::BIGINT AS bits
  FROM lines WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
ends AS (SELECT a.doc_id, a.u, min(b.u) AS e FROM units a JOIN units b ON a.doc_id = b.doc_id AND b.u BETWEEN a.u + 1 AND a.u + 4 AND a.bits & b.bits <> 0 GROUP BY a.doc_id, a.u),
chunks AS (
  SELECT e.doc_id, e.u, min(x.i) AS first_i, max(x.i) AS last_i, string_agg(x.line, chr(10) ORDER BY x.u) AS chunk
  FROM ends e JOIN units x ON x.doc_id = e.doc_id AND x.u BETWEEN e.u AND e.e GROUP BY e.doc_id, e.u),
judged AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, u) > 1 AS gone FROM chunks),
away AS (SELECT DISTINCT doc_id, unnest(generate_series(first_i, last_i)) AS i FROM judged WHERE gone),
counted AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS removed_chunks FROM judged GROUP BY doc_id),
texts AS (
  SELECT l.doc_id, count(*) AS n_lines, count(a.i) AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE a.i IS NULL), '') AS kept
  FROM lines l LEFT JOIN away a ON a.doc_id = l.doc_id AND a.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(removed_chunks, 0)::BIGINT AS removed_chunks,
       removed_lines::BIGINT AS removed_lines, length(kept)::BIGINT AS n_chars, md5(kept) AS text_md5
FROM texts LEFT JOIN counted USING (doc_id)
"""
