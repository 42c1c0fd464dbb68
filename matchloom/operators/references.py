"""Reference joins: schools, managers, ids and aliases, history, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.config import Policy
from matchloom.functions import ids, keys, text
from matchloom.operators.numbering import first_row, last_row, lookup, number_rows


def school_names(schools: DataFrame, order: str = "school_code") -> DataFrame:
    """Folded school name -> code, first occurrence wins."""
    named = schools.select(text.norm_text("school_name").alias("name_key"), F.col("school_code").cast("bigint").alias("code"), F.col(order).alias("__o"))
    return first_row(named.where(F.col("name_key") != ""), ["name_key"], ["__o"]).drop("__o")


def school_codes(schools: DataFrame, order: str = "school_code") -> DataFrame:
    """School code -> name, first occurrence wins."""
    coded = schools.select(F.col("school_code").cast("bigint").alias("code"), "school_name", F.col(order).alias("__o"))
    return first_row(coded, ["code"], ["__o"]).drop("__o")


def fill_school_code(df: DataFrame, code: str, name: str, schools: DataFrame) -> DataFrame:
    """Replace a code that is not in the reference by the code of the name, if known."""
    value = keys.school_code(code)
    keyed = df.withColumn("__v", value).withColumn("__k", text.norm_text(name))
    known = school_codes(schools).select("code").withColumn("__known", F.lit(True))
    out = keyed.join(known, F.col("__v") == known["code"], "left").drop(known["code"])
    named = school_names(schools).select(F.col("name_key").alias("__nk"), F.col("code").alias("__nc"))
    out = out.join(named, F.col("__k") == F.col("__nk"), "left")
    valid = (F.col("__v") > 0) & F.coalesce("__known", F.lit(False))
    filled = F.when(valid, F.col("__v")).otherwise(F.coalesce("__nc", text.numlike_long(code)))
    return out.withColumn("resolved_school", filled).drop("__v", "__k", "__known", "__nk", "__nc")


def center_from_manager(
    df: DataFrame, manager: str, mapping: DataFrame, policy: Policy | None = None, wildcard: int | None = 0
) -> DataFrame:
    """Center of a manager name: exact, else longest contained key, else the wildcard.

    Distinct folded names are split into pieces of the lengths that keys have, which are joined
    on equality with the keys: a name of any length gives at most its length times the number
    of key lengths, and a large map costs no nested loop. Adds ``manager_center`` and ``manager_match``.
    """
    policy = policy or Policy()
    table = mapping.select(text.norm_text("manager_key").alias("key"), F.col("center_code").cast("bigint").alias("center"))
    table = table.where(F.col("key") != "").groupBy("key").agg(F.max("center").alias("center"))
    # One row: the distinct lengths of the keys.
    sizes = table.agg(F.array_sort(F.collect_set(F.length("key"))).alias("sizes"))
    names = df.select(text.norm_text(manager).alias("m")).distinct().where(F.col("m") != "")
    sized = names.join(F.broadcast(sizes)).withColumn("size", F.explode("sizes")).where(F.col("size") <= F.length("m"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("m") - F.col("size") + 1), lambda i: F.substring(F.col("m"), i, F.col("size")))
    parts = sized.select("m", F.explode(F.array_distinct(pieces)).alias("key"))
    best = parts.join(table, "key").groupBy("m").agg(
        F.min(F.struct((-F.length("key")).alias("neg"), F.col("key"), F.col("center"))).alias("b")
    )
    best = best.select(
        "m",
        F.col("b.center").alias("manager_center"),
        F.when(F.col("b.key") == F.col("m"), F.lit("manager_exact")).otherwise(F.lit("manager_substring")).alias("manager_match"),
    )
    out = lookup(df.withColumn("__mgr", text.norm_text(manager)), best.withColumnRenamed("m", "__mgr"), ["__mgr"], ["manager_center", "manager_match"], "left")
    if wildcard is not None and policy.unknown_manager_mode == "wildcard":
        hit = F.col("manager_match").isNull()
        out = out.withColumn("manager_center", F.coalesce("manager_center", F.lit(wildcard).cast("bigint")))
        out = out.withColumn("manager_match", F.when(hit, F.lit("manager_wildcard")).otherwise(F.col("manager_match")))
    return out.drop("__mgr")


def effective_center(students: DataFrame, manager: str, mapping: DataFrame, policy: Policy | None = None) -> DataFrame:
    """Student center 0 is rewritten from the manager name; adds ``center_source``."""
    out = center_from_manager(students, manager, mapping, policy)
    named = text.norm_text(manager) != ""
    rewrite = (F.col("center_code") == 0) & named & F.col("manager_center").isNotNull()
    source = (
        F.when(F.col("center_code").isNull(), F.lit("missing"))
        .when(rewrite, F.col("manager_match"))
        .otherwise(F.lit("raw"))
    )
    return (
        out.withColumn("center_source", source)
        .withColumn("center_code", F.when(rewrite, F.col("manager_center")).otherwise(F.col("center_code")))
        .drop("manager_center", "manager_match")
    )


def inject_mentor_id(pool: DataFrame, matrix: DataFrame, order: str) -> DataFrame:
    """Fill an empty mentor id from the mentor name; first occurrence in ``matrix`` wins."""
    named = matrix.select(text.norm_text("mentor_name").alias("__k"), F.trim("mentor_id").alias("__id"), F.col(order).alias("__o"))
    named = first_row(named.where((F.col("__k") != "") & (F.col("__id") != "")), ["__k"], ["__o"]).drop("__o")
    keyed = pool.withColumn("__k", text.norm_text("mentor_name"))
    out = lookup(keyed, named, ["__k"], ["__id"], "left")
    current = F.trim(F.coalesce(F.col("mentor_id").cast("string"), F.lit("")))
    return out.withColumn(
        "mentor_id", F.when(current != "", F.col("mentor_id")).otherwise(F.coalesce("__id", F.lit("")))
    ).drop("__k", "__id")


def alias_to_mentor(pool: DataFrame, alias: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Fill an empty mentor id from the alias map; second table has matched / unmatched counts."""
    keyed = pool.withColumn("__a", ids.alias_digits(alias)).withColumn(
        "__m", F.trim(F.coalesce(F.col("mentor_id").cast("string"), F.lit("")))
    )
    amap = keyed.where(F.col("__a").isNotNull() & (F.col("__m") != "")).select("__a", F.col("__m").alias("__id"), F.col(order).alias("__o"))
    amap = first_row(amap, ["__a"], ["__o"]).drop("__o")
    out = lookup(keyed, amap, ["__a"], ["__id"], "left")
    empty = F.col("__m") == ""
    stats = out.agg(
        F.count_if(empty & F.col("__id").isNotNull()).cast("bigint").alias("alias_autofill"),
        F.count_if(empty & F.col("__a").isNotNull() & F.col("__id").isNull()).cast("bigint").alias("alias_unmatched"),
    )
    filled = out.withColumn("mentor_id", F.when(empty, F.coalesce("__id", F.lit(""))).otherwise(F.col("mentor_id")))
    return filled.drop("__a", "__m", "__id"), stats


def history_snapshot(history: DataFrame, order: Sequence[str]) -> DataFrame:
    """Last record per national code."""
    h = history.select(
        ids.national_code("national_code").alias("code"),
        F.col("mentor_id").alias("history_mentor_id"),
        F.col("center_code").alias("history_center_code"),
        *order,
    )
    return last_row(h.where(F.col("code").isNotNull()), ["code"], order).drop(*order)


def dedupe_by_history(students: DataFrame, history: DataFrame, order: Sequence[str]) -> DataFrame:
    """Tag students as allocated before, new, or without a usable national code."""
    snap = history_snapshot(history, order).withColumn("__hit", F.lit(True))
    keyed = students.withColumn("__code", ids.national_code("national_code"))
    out = keyed.join(snap, F.col("__code") == F.col("code"), "left")
    status = (
        F.when(F.col("__code").isNull(), F.lit("missing_or_invalid_national_code"))
        .when(F.col("__hit"), F.lit("already_allocated"))
        .otherwise(F.lit("no_history_match"))
    )
    reason = F.when(status == "already_allocated", F.lit("history_match")).otherwise(status)
    return out.withColumn("history_status", status).withColumn("dedupe_reason", reason).drop("code", "__code", "__hit")


def split_by_history(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    hit = F.col("history_status") == "already_allocated"
    return tagged.where(hit), tagged.where(~hit)


def attach_history(summary: DataFrame, info: DataFrame, order: Sequence[str]) -> DataFrame:
    """Flags, snapshot and same-mentor marker from the last info row per student."""
    cols = ["history_status", "dedupe_reason", "history_mentor_id", "history_center_code"]
    last = last_row(info.select("student_id", *cols, *order), ["student_id"], order).drop(*order)
    out = lookup(summary, last, ["student_id"], cols, "left")
    return (
        out.withColumn("same_history_mentor", F.coalesce(F.col("mentor_id") == F.col("history_mentor_id"), F.lit(False)))
        .withColumn("history_status", F.coalesce("history_status", F.lit("")))
        .withColumn("dedupe_reason", F.coalesce("dedupe_reason", F.lit("")))
    )


def safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", check: bool = True
) -> DataFrame:
    """Many-to-one join that fails with a sample of the repeated right keys."""
    if check:
        repeated = right.groupBy(*on).count().where(F.col("count") > 1).limit(5).collect()
        if repeated:
            raise ValueError(f"right side is not unique on {list(on)}; sample {[r.asDict() for r in repeated]}")
    return left.join(right, list(on), how)


def unique_violations(right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that would break a many-to-one join, with their row counts."""
    return right.groupBy(*on).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def preferred_managers(pool: DataFrame, centers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Priority flag for rows whose (center, manager) is configured; centers without any row."""
    conf = centers.select(F.col("center_code").cast("bigint").alias("__c"), F.trim("manager").alias("__m"))
    conf = conf.where(F.col("__m") != "").distinct()
    keyed = pool.withColumn("__pc", F.coalesce("center_code", F.lit(-1)))
    hit = conf.withColumn("__hit", F.lit(True))
    out = keyed.join(hit, (F.col("__pc") == F.col("__c")) & (F.trim("manager") == F.col("__m")), "left")
    flagged = out.withColumn("preferred", F.coalesce("__hit", F.lit(False))).drop("__pc", "__c", "__m", "__hit")
    present = flagged.where("preferred").select(F.col("center_code").alias("__p")).distinct()
    missing = conf.select(F.col("__c").alias("center_code")).distinct().join(
        present, F.col("center_code") == F.col("__p"), "left_anti"
    )
    return flagged, missing


def global_prefilter(pool: DataFrame, students: DataFrame, column: str = "group_code") -> tuple[DataFrame, DataFrame]:
    """Keep pool rows whose value occurs among students; rows before / after."""
    seen = students.select(column).where(F.col(column).isNotNull()).distinct()
    kept = pool.join(seen, column, "left_semi")
    counts = pool.join(seen.withColumn("__hit", F.lit(True)), column, "left").agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(F.col("__hit")).alias("rows_after")
    )
    return kept, counts


# Counters ---------------------------------------------------------------------------


def nat_id(c) -> Column:
    """Digits padded to ten; '' when there are none."""
    d = F.regexp_replace(text.fold_digits(F.trim(F.coalesce(text.as_col(c).cast("string"), F.lit("")))), "[^0-9]", "")
    return F.when(d == "", d).otherwise(F.when(F.length(d) < 10, F.lpad(d, 10, "0")).otherwise(d))


def prior_counter_map(roster: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(national id -> counter, conflicts): the first id owns a counter, later owners conflict."""
    rows = roster.select(
        nat_id("national_id").alias("nat"), ids.valid_counter("student_id").alias("counter"), F.col(order).alias("o")
    ).where((F.col("nat") != "") & F.col("counter").isNotNull())
    owners = rows.groupBy("counter").agg(F.min_by("nat", "o").alias("owner"))
    tagged = lookup(rows, owners, ["counter"], ["owner"])
    own = tagged.where(F.col("nat") == F.col("owner"))
    mapping = own.groupBy("nat").agg(F.max_by("counter", "o").alias("counter"))
    conflicts = tagged.where(F.col("nat") != F.col("owner")).select("counter", "owner", "nat").distinct()
    return mapping, conflicts


def assign_counters(
    students: DataFrame, order: str, prior: DataFrame | None, current: DataFrame | None, year: int,
    policy: Policy | None = None, on_overflow: str = "raise",
) -> DataFrame:
    """Nine-digit ids: reuse the prior one, share per national id, number new ones per gender.

    New ids continue after the largest sequence of the current roster, in natural order of
    the national id; the gender of a shared id is that of its first row. A sequence above
    9999 fails the job; with ``on_overflow="null"`` such rows have no id (see
    ``counter_overflow``).
    """
    if on_overflow not in ("raise", "null"):
        raise ValueError("on_overflow is 'raise' or 'null'")
    policy = policy or Policy()
    yy = year - 1350
    rows = students.withColumn("nat", nat_id("national_id")).withColumn("__o", F.col(order))
    people = rows.groupBy("nat").agg(F.min_by("gender", "__o").cast("bigint").alias("g"))
    if prior is not None:
        mapping, _ = prior_counter_map(prior, "row_id")
        people = lookup(people, mapping, ["nat"], ["counter"], "left")
    else:
        people = people.withColumn("counter", F.lit(None).cast("string"))
    fresh = people.where(F.col("counter").isNull()).select("nat", "g", ids.natural_key("nat").alias("k"))
    numbered = number_rows(fresh, [F.col("k")], [("__p", F.substring("k", 1, 6)), ("__q", F.substring("k", 1, 9)), ("__r", F.substring("k", 1, 12))], by=["g"], name="n")
    start = None
    if current is not None:
        c = ids.valid_counter("student_id")
        start = current.select(
            F.substring(c, 3, 3).alias("mid"), F.substring(c, 1, 2).alias("y"), ids.counter_sequence("student_id").alias("seq")
        ).where(F.col("y") == f"{yy:02d}")
        gender_of = {v: k for k, v in policy.gender_mid3.items()}
        g = F.when(F.col("mid") == policy.gender_mid3[1], F.lit(1)).when(F.col("mid") == policy.gender_mid3[0], F.lit(0))
        start = start.select(g.cast("bigint").alias("g"), "seq").where(F.col("g").isin(*gender_of.values()))
        start = start.groupBy("g").agg(F.max("seq").alias("top"))
        numbered = lookup(numbered, start, ["g"], ["top"], "left")
    else:
        numbered = numbered.withColumn("top", F.lit(0).cast("bigint"))
    made = numbered.select(
        "nat",
        (F.coalesce("top", F.lit(0)) + F.col("n")).alias("sequence"),
        "g",
    ).withColumn("made", ids.counter_id(F.lit(yy), "g", "sequence", policy.gender_mid3))
    if on_overflow == "raise":
        full = F.concat(F.lit("counter sequence above 9999 for gender "), F.col("g").cast("string"), F.lit(": "), F.col("sequence").cast("string"))
        made = made.withColumn("made", F.when(F.col("sequence") > 9999, F.raise_error(full)).otherwise(F.col("made")))
    people = lookup(people, made, ["nat"], ["made", "sequence"], "left")
    people = people.select(
        "nat", F.coalesce("counter", "made").alias("student_id"), F.col("counter").isNotNull().alias("from_prior"),
        "sequence", F.col("g").alias("owner_gender"),
    )
    firsts = rows.groupBy("nat").agg(F.min("__o").alias("__first"))
    out = lookup(rows.drop("student_id"), people, ["nat"], ["student_id", "from_prior", "sequence", "owner_gender"])
    out = lookup(out, firsts, ["nat"], ["__first"])
    return out.withColumn("reused", F.col("from_prior") | (F.col("__o") != F.col("__first"))).drop("__o", "__first")


def counter_overflow(assigned: DataFrame) -> DataFrame:
    """Rows whose sequence passed 9999."""
    return assigned.where(F.col("sequence") > 9999)


def counter_summary(
    assigned: DataFrame, current: DataFrame | None, year: int, policy: Policy | None = None, prior: DataFrame | None = None, order: str = "row_id"
) -> DataFrame:
    """Reused, new per gender, the next free sequence per gender, and the conflicts of the prior roster (one row).

    A conflict is a further person with a counter that its first one owns; the samples are the first three such counters.
    """
    policy = policy or Policy()
    yy = year - 1350
    new = ~F.col("reused")
    one = assigned.agg(
        F.count_if(F.col("reused")).cast("bigint").alias("reused_count"),
        F.count_if(new & (F.col("owner_gender") == 1)).cast("bigint").alias("new_male_count"),
        F.count_if(new & (F.col("owner_gender") == 0)).cast("bigint").alias("new_female_count"),
    )
    zero = F.lit(0).cast("bigint")
    if current is None:
        tops = one.select(zero.alias("m"), zero.alias("f"))
    else:
        c = ids.valid_counter("student_id")
        s = ids.counter_sequence("student_id")
        top = lambda g: F.coalesce(F.max(F.when(F.substring(c, 1, 5) == f"{yy:02d}{policy.gender_mid3[g]}", s)), zero)
        tops = current.agg(top(1).alias("m"), top(0).alias("f"))
    if prior is None:
        clash = one.select(zero.alias("n"), F.lit("").alias("s"))
    else:
        found = prior_counter_map(prior, order)[1].groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
        first = found.orderBy("counter").limit(3).agg(F.array_join(F.array_sort(F.collect_list("counter")), ",").alias("s"))
        clash = found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).join(F.broadcast(first))
    return one.join(F.broadcast(tops)).join(F.broadcast(clash)).select(
        "reused_count", "new_male_count", "new_female_count",
        (F.col("m") + F.col("new_male_count") + 1).alias("next_male_start"),
        (F.col("f") + F.col("new_female_count") + 1).alias("next_female_start"),
        F.col("n").alias("prior_conflict_counter_count"), F.col("s").alias("prior_conflict_counter_samples"),
    )


def academic_year(roster: DataFrame, order: str) -> DataFrame:
    """First valid year, and the year only when all valid ids share it."""
    y = ids.counter_year("student_id")
    rows = roster.select(y.alias("y"), F.col(order).alias("o")).where(F.col("y").isNotNull())
    return rows.agg(
        F.min_by("y", "o").alias("first_year"),
        F.when(F.min("y") == F.max("y"), F.min("y")).alias("strict_year"),
    )


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    """Ids that occur more than once, with counts."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def resolve_duplicates(df: DataFrame, column: str, order: str, mode: str = "drop", start: int = 0) -> DataFrame:
    """``drop`` keeps the first row of an id; ``assign-new`` numbers later rows after ``start``."""
    firsts = df.groupBy(column).agg(F.min(order).alias("__first"))
    tagged = lookup(df, firsts, [column], ["__first"])
    first = F.col(order) == F.col("__first")
    if mode == "drop":
        return tagged.where(first).drop("__first")
    if mode == "abort":
        return tagged.where(~first).drop("__first")
    later = number_rows(
        tagged.where(~first).select(F.col(order).alias("__k")), [F.col("__k")],
        [(f"__p{b}", F.floor(F.col("__k") / (1 << b))) for b in (48, 36, 24, 12)], name="__n",
    )
    out = lookup(tagged.withColumn("__k", F.col(order)), later, ["__k"], ["__n"], "left")
    fresh = (F.lit(start) + F.col("__n")).cast("bigint")
    return out.withColumn("new_id", F.coalesce(fresh, F.col(column).cast("bigint"))).drop("__k", "__n", "__first")
