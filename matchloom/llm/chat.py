"""Chat formatting: each participant's view of a dialogue, rendered with masks.

For every participant the dialogue is rendered with that speaker as assistant and the others as
named users; narrators (system turns) stay what they are and have no view of their own. The
mask marks the characters a model learns from: the speaker's own turns with their end marks.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.numbering import number_rows

BEGIN, END = "<|im_start|>", "<|im_end|>"
NARRATORS = ("system",)
#: Turns that are rendered into one row; a longer conversation gives several rows a view.
PART_TURNS = 4096
UNNAMED = "unknown"


def _plain(column: str) -> Column:
    """Text that can't hold a mark of the format: a space goes into each of them."""
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("<|im_"), F.lit("< |im_"))


def render_views(turns: DataFrame, narrators: tuple[str, ...] = NARRATORS, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, rendered, mask (array of (start, end) in characters of ``rendered``).

    Turns (conv_id, turn, role, text) go in the order of turn, then role, then text; nulls come
    first. A null role is the participant ``unknown``, a null text is empty, rows without
    conv_id are one conversation. Repeated turns stay. A conversation of narrators only has no
    view. A conversation of more than ``part_turns`` turns is rendered in parts of so many, so
    that no task has to hold all of it. Other columns are not read.
    """
    turns = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.replace(F.coalesce(F.col("role").cast("string"), F.lit(UNNAMED)), F.lit("<|im_"), F.lit("< |im_")).alias("role"), _plain("text").alias("text"),
    )
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    long_ = sizes.where(F.col("n") > part_turns).select(F.col("conv_id").alias("long_id"))
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = turns.join(long_, same, "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    numbered = number_rows(
        turns.join(long_, same, "left_semi"), [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")],
        [("__block", F.coalesce(F.floor(F.col("turn") / 1024), F.lit(-(1 << 62)))), ("__turn", F.coalesce("turn", F.lit(-(1 << 62))))], by=["conv_id"],
    )
    parted = numbered.withColumn("part", F.floor((F.col("row_no") - 1) / part_turns)).select("conv_id", "turn", "role", "text", "part")
    turn = F.struct("turn", "role", "text")
    said = short.select("conv_id", "turn", "role", "text", "part").unionByName(parted)
    groups = said.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # The views of a part are those of the whole conversation.
    everybody = said.where(~F.col("role").isin(*narrators)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    views = groups.join(everybody, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.concat(F.lit(BEGIN), F.when(own(t), "assistant").when(t["role"].isin(*narrators), t["role"]).otherwise(F.concat(F.lit("user name="), t["role"])), F.lit("\n"))
    pieces = views.withColumn("__p", F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), own(t).alias("own"))))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(s: Column, p: Column) -> Column:
        first = s["at"] + F.length(p["head"])
        last = first + F.length(p["body"])
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct((last + 1).alias("at"), F.when(p["own"], F.concat(s["mask"], span)).otherwise(s["mask"]).alias("mask"))

    text = F.array_join(F.transform("__p", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "")
    return pieces.select("conv_id", "speaker", "part", F.size("turns").cast("bigint").alias("n_turns"), text.alias("rendered"), F.aggregate("__p", state, step, lambda s: s["mask"]).alias("mask"))


def view_digests(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, n_turns, n_chars, rendered_md5, mask_spans (``start-end`` by commas) and masked_chars."""
    views = render_views(turns, part_turns=part_turns)
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    masked = F.aggregate("mask", F.lit(0), lambda a, m: a + m["end"] - m["start"]).cast("bigint")
    return views.select("conv_id", "speaker", "part", "n_turns", F.length("rendered").cast("bigint").alias("n_chars"), F.md5("rendered").alias("rendered_md5"), spans.alias("mask_spans"), masked.alias("masked_chars"))


def check_sql(part_turns: int = PART_TURNS) -> str:
    """DuckDB SQL for the rows of ``view_digests``, parts included."""
    return f"""
WITH t AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|im_', '< |im_') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
seg AS (
  SELECT t.conv_id, speaker, i, (i - 1) // {part_turns} AS part, role = speaker AS own,
         '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
         text || '<|im_end|>' AS body
  FROM t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + length(head) AS s FROM seg)
SELECT conv_id, speaker, part::BIGINT AS part, count(*) AS n_turns, sum(length(head) + length(body) + 1)::BIGINT AS n_chars,
       md5(string_agg(head || body || chr(10), '' ORDER BY i)) AS rendered_md5,
       coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(s + length(body) AS BIGINT), ',' ORDER BY i) FILTER (WHERE own), '') AS mask_spans,
       coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS masked_chars
FROM placed GROUP BY conv_id, speaker, part
"""


SQL = check_sql()
