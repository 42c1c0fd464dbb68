"""Table-level standardisation: headers, defaults, group names, crosswalks, provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import KEYS, VALID_CODES, group_dim
from matchloom.functions import contact, ids, keys, text
from matchloom.operators.numbering import lookup

# Names that stand for a whole level or for another spelling.
SYNONYMS = {
    "دهم علوم انسانی": "دهم انسانی",
    "یازدهم شبکه و نرم‌افزار رایانه": "یازدهم شبکه و نرم افزار رایانه",
}
BUCKET_SYNONYMS = {
    "کل متوسطه 1": "متوسطه اول",
    "کل متوسطه 2": "متوسطه دوم",
    "کل دبستان": "دبستان",
    "کل هنرستان": "هنرستان",
    "کل کنکوری": "کنکوری",
    "کنکوریها": "کنکوری",
}
LEVEL_WORDS = (
    ("متوسطه1", "متوسطه اول"),
    ("متوسطه اول", "متوسطه اول"),
    ("متوسطه2", "متوسطه دوم"),
    ("متوسطه دوم", "متوسطه دوم"),
    ("دبستان", "دبستان"),
    ("هنرستان", "هنرستان"),
    ("کنکوری", "کنکوری"),
)
GRADES = (("10", "دهم"), ("11", "یازدهم"), ("12", "دوازدهم"))
MAJORS = ("تجربی", "ریاضی", "انسانی", "علوم و معارف اسلامی")


def _broadcast_dim(df: DataFrame) -> DataFrame:
    """Only the fixed group dimension (33 rows) is ever hinted."""
    return F.broadcast(df)


def academic_info(df: DataFrame, group: str = "group_code", status: str = "grad_status_code") -> DataFrame:
    """Level, name, dual flag, the code its name resolves to and whether the status fits."""
    dim = group_dim(df.sparkSession)
    unique = dim.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.min("group_code").alias("code_of_name")
    )
    named = dim.join(unique, "name").select(
        "group_code", "level", "name", "is_dual",
        F.when(F.col("n") == 1, F.col("code_of_name")).alias("code_of_name"),
    )
    out = df.join(_broadcast_dim(named), df[group] == named["group_code"], "left").drop(named["group_code"])
    return out.withColumn(
        "status_ok", F.when(F.col("level").isNotNull(), (F.col(status) == 1) | F.col("is_dual"))
    ).withColumn("is_dual", F.coalesce("is_dual", F.lit(False)))


def eligible_codes(df: DataFrame, status: str = "grad_status_code") -> DataFrame:
    """Codes a status may use: all for students, the dual ones for graduates."""
    dim = group_dim(df.sparkSession).select(F.col("group_code").alias("eligible_code"), "is_dual")
    hits = df.select(status).distinct()
    return hits.join(_broadcast_dim(dim), (F.col(status) == 1) | F.col("is_dual")).drop("is_dual")


def ranking_columns(pool: DataFrame) -> DataFrame:
    """Guarantee the columns ranking reads."""
    out = pool
    for name in ("remaining_capacity", "allocations_new"):
        base = F.col(name) if name in pool.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(base.cast("bigint"), F.lit(0).cast("bigint")))
    return out.withColumn("mentor_id_text", text.numlike("mentor_id")).withColumn(
        "mentor_sort_key", ids.natural_key("mentor_id")
    )


def promote_final_group(df: DataFrame, final: str) -> DataFrame:
    """Use the final exam group as group code when there is no group column."""
    if "group_code" in df.columns or final not in df.columns:
        return df
    return df.withColumn("group_code", F.col(final))


def student_defaults(df: DataFrame) -> DataFrame:
    """Add missing key columns: a fallback column first, else the default."""
    fallback = {"group_code": "major_code", "gender_code": "gender", "grad_status_code": "education_status"}
    default = {"gender_code": 1}
    out = df
    for key in KEYS:
        if key in df.columns:
            continue
        other = fallback.get(key)
        value = F.col(other) if other in df.columns else F.lit(default.get(key, 0))
        out = out.withColumn(key, value.cast("bigint"))
    return out


def type_group_fill(df: DataFrame) -> DataFrame:
    """Copy one of type / group into the other when only one exists."""
    if "type_code" not in df.columns and "group_code" in df.columns:
        return df.withColumn("type_code", F.col("group_code"))
    if "group_code" not in df.columns and "type_code" in df.columns:
        return df.withColumn("group_code", F.col("type_code"))
    return df


def code_columns_as_text(
    df: DataFrame, text: Sequence[str] = (), mobiles: Sequence[str] = (), landlines: Sequence[str] = ()
) -> DataFrame:
    """Identifier and phone columns leave as strings, phones normalised."""
    out = []
    for c in df.columns:
        if c in mobiles:
            out.append(contact.mobile(c).alias(c))
        elif c in landlines:
            out.append(contact.landline(c).alias(c))
        elif c in text:
            out.append(F.col(c).cast("string").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# Columns typed by the source they come from.
ID_COLUMNS = ("alias", "mentor_id", "postal_code")
CODE_COLUMNS = ("group_code", "school_code", "school_code_1", "school_code_2", "school_code_3", "school_code_4")
POOL_CODE_COLUMNS = CODE_COLUMNS + (
    "grad_status_code", "center_code", "finance_code", "schools_covered", "covered_students",
    "capacity_special", "capacity_current",
)


def _code_cell(c: str):
    folded = text.strip_school_separators(text.norm_text(c))
    return F.regexp_extract(text.numlike(folded), "^(-?[0-9]+)", 1).try_cast("bigint")


def coerce_semantics(df: DataFrame, source: str) -> DataFrame:
    """Per-source typing of known columns; the rest passes through."""
    codes = CODE_COLUMNS if source in ("report", "school") else POOL_CODE_COLUMNS
    out = []
    for c in df.columns:
        if c in ID_COLUMNS:
            out.append(ids.identifier_text(c).alias(c))
        elif c == "graduation_flag" and source == "report":
            folded = text.norm_text(c)
            number = text.numlike(folded)
            out.append(
                F.when(folded == "", F.lit(None))
                .when(number.rlike("^[0-9]+$"), number.try_cast("bigint"))
                .when(folded.contains("فارغ"), F.lit(1))
                .otherwise(F.lit(0)).cast("bigint").alias(c)
            )
        elif c in codes or (source == "report" and c == "center_code"):
            out.append(_code_cell(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def resolve_headers(df: DataFrame, aliases: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Map alias headers to canonical names.

    Several headers of one field coalesce left to right. Returns the table and an issue
    table (header, canonical field, message, conflict count); unknown headers are kept.
    """
    known = {text.norm_header(k): v for k, v in aliases.items()}
    groups: dict[str, list[str]] = {}
    order: list[tuple[str, str | None]] = []
    for c in df.columns:
        canonical = known.get(text.norm_header(c))
        if canonical is None:
            order.append((c, None))
        else:
            if canonical not in groups:
                order.append((c, canonical))
            groups.setdefault(canonical, []).append(c)
    out = [
        F.col(f"`{c}`") if canonical is None
        else F.coalesce(*[F.col(f"`{x}`") for x in groups[canonical]]).alias(canonical)
        for c, canonical in order
    ]
    spark = df.sparkSession
    rows = [(c, None, "UNKNOWN_HEADER") for c, canonical in order if canonical is None]
    many = {k: v for k, v in groups.items() if len(v) > 1}
    rows += [(",".join(v), k, "AMBIGUOUS_HEADER") for k, v in many.items()]
    issues = spark.createDataFrame(rows, "header string, canonical_field string, message string")
    if not many:
        return df.select(*out), issues.withColumn("conflict_count", F.lit(0).cast("bigint"))
    # One pass counts the conflicts of every ambiguous field.
    sums = []
    for k, v in many.items():
        clash = F.lit(0)
        seen = F.col(f"`{v[0]}`")
        for x in v[1:]:
            nxt = F.col(f"`{x}`")
            clash = clash + F.when(seen.isNotNull() & nxt.isNotNull() & (seen != nxt), 1).otherwise(0)
            seen = F.coalesce(seen, nxt)
        sums.append(F.coalesce(F.sum(clash), F.lit(0)).cast("bigint").alias(k))
    counts = df.agg(*sums).selectExpr(
        f"stack({len(many)}, " + ", ".join(f"'{k}', `{k}`" for k in many) + ") AS (canonical_field, n)"
    )
    issues = issues.join(F.broadcast(counts), "canonical_field", "left").select(
        "header", "canonical_field", "message", F.coalesce("n", F.lit(0)).cast("bigint").alias("conflict_count")
    )
    return df.select(*out), issues


def expand_group_names(
    df: DataFrame, token: str, row_id: str, crosswalk: DataFrame, synonyms: DataFrame | None = None
) -> DataFrame:
    """Group name tokens to (row, name, code): code, synonym, level, grade x major, direct name.

    ``crosswalk`` is (group_name, group_code, level). Tokens are resolved once per
    distinct folded value; the smallest priority wins per code, and the direct name only
    counts when nothing else matched.
    """
    spark = df.sparkSession
    folded = df.select(F.col(row_id), F.col(token).alias("token"), text.norm_text(token).alias("t"))
    folded = folded.where(F.col("t") != "")
    distinct = folded.select("t").distinct()
    xw = crosswalk.select(
        F.col("group_name"), F.col("group_code").cast("bigint").alias("group_code"), F.col("level"),
        text.norm_text("group_name").alias("k"),
    )
    by_name = xw.groupBy("k").agg(F.max_by("group_code", "group_code").alias("group_code"))
    syn = spark.createDataFrame(list(SYNONYMS.items()), "src string, dst string")
    if synonyms is not None:
        syn = syn.unionByName(synonyms.select("src", "dst"))
    syn = syn.select(text.norm_text("src").alias("t"), F.col("dst"), text.norm_text("dst").alias("k"))
    levels = spark.createDataFrame(
        [(k, v) for k, v in BUCKET_SYNONYMS.items()], "src string, level string"
    ).select(text.norm_text("src").alias("t"), "level")
    hits = []
    number = text.to_long("t")
    hits.append(
        distinct.withColumn("n", number).join(xw, F.col("n") == xw["group_code"]).select(
            "t", F.lit(0).alias("p"), "group_code", "group_name"
        )
    )
    hits.append(
        distinct.join(syn, "t").join(by_name, "k").select("t", F.lit(1).alias("p"), "group_code", F.col("dst").alias("group_name"))
    )
    hits.append(distinct.join(levels, "t").join(xw, "level").select("t", F.lit(1).alias("p"), "group_code", "group_name"))
    words = F.array_distinct(
        F.filter(
            F.array(*[F.when(F.col("t").contains(w), F.lit(lv)) for w, lv in LEVEL_WORDS]), lambda x: x.isNotNull()
        )
    )
    hits.append(
        distinct.select("t", F.explode(words).alias("level")).join(xw, "level").select(
            "t", F.lit(2).alias("p"), "group_code", "group_name"
        )
    )
    titles = [
        F.when(
            (F.col("t").contains(name) | F.col("t").contains(num)) & F.col("t").contains(major),
            F.lit(f"{name} {major}"),
        )
        for num, name in GRADES
        for major in MAJORS
    ]
    graded = distinct.select("t", F.explode(F.filter(F.array(*titles), lambda x: x.isNotNull())).alias("title"))
    hits.append(
        graded.withColumn("k", text.norm_text("title")).join(by_name, "k").select(
            "t", F.lit(3).alias("p"), "group_code", F.col("title").alias("group_name")
        )
    )
    found = hits[0]
    for h in hits[1:]:
        found = found.unionByName(h)
    direct = distinct.join(found.select("t").distinct(), "t", "left_anti").join(
        by_name.withColumnRenamed("k", "t"), "t"
    ).select("t", F.lit(4).alias("p"), "group_code", F.lit(None).cast("string").alias("group_name"))
    best = found.unionByName(direct).groupBy("t", "group_code").agg(
        F.min(F.struct("p", "group_name")).alias("b")
    )
    return folded.join(best, "t").select(
        row_id, "group_code", F.coalesce("b.group_name", "token").alias("group_name"), F.col("b.p").cast("bigint").alias("priority")
    )


def resolve_group_code(
    df: DataFrame, major: str, name: str, crosswalk: DataFrame, prefer_major: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Group code from the major code, else from the group name; counters as a second table."""
    valid = [int(c) for c in VALID_CODES]
    by_name = crosswalk.select(text.norm_text("group_name").alias("k"), F.col("group_code").cast("bigint").alias("named"))
    by_name = by_name.where(F.col("k") != "").groupBy("k").agg(F.max("named").alias("named"))
    keyed = df.withColumn("k", text.norm_text(name)).withColumn("m", text.numlike_long(major))
    keyed = lookup(keyed, by_name, ["k"], ["named"], "left")
    m = F.when(F.col("m").isin(valid), F.col("m"))
    n = F.when(F.col("named").isin(valid), F.col("named"))
    first = F.coalesce(m, n) if prefer_major else n
    out = keyed.withColumn("resolved_group", first).withColumn(
        "resolved_by",
        F.when(m.isNotNull() & F.lit(prefer_major), F.lit("major_code"))
        .when(n.isNotNull(), F.lit("crosswalk"))
        .otherwise(F.lit("unresolved")),
    )
    count = lambda c: F.count_if(c).cast("bigint")
    stats = out.agg(
        count(F.col("resolved_by") == "major_code").alias("resolved_by_major_code"),
        count(F.col("resolved_by") == "crosswalk").alias("resolved_by_crosswalk"),
        count(F.col("resolved_by") == "unresolved").alias("unresolved_group_code"),
        count(m.isNotNull() & n.isNotNull() & (m != n) & F.lit(prefer_major)).alias("mismatch_major_vs_group"),
        count(F.col("m").isNotNull() & ~F.col("m").isin(valid)).alias("invalid_major_code"),
    )
    return out.drop("k", "m", "named"), stats


def apply_crosswalk(df: DataFrame, column: str, crosswalk: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Numeric keys first, then folded text keys; unmapped rows are the second table.

    ``crosswalk`` is (source STRING, target). Of entries with the same key the last one by the
    column ``order`` counts; without an order the greatest target.
    """
    last = lambda name: F.max_by("target", "entry_order").alias(name)
    src = crosswalk.select(
        text.numlike_long("source").alias("num_key"),
        text.norm_text("source").alias("text_key"),
        F.col("target").cast("bigint").alias("target"),
        (F.col(order) if order else F.col("target").cast("bigint")).alias("entry_order"),
    )
    numeric = src.where(F.col("num_key").isNotNull()).groupBy("num_key").agg(last("by_number"))
    textual = src.where(F.col("num_key").isNull() & (F.col("text_key") != "")).groupBy("text_key").agg(last("by_text"))
    keyed = df.withColumn("num_key", text.numlike_long(column)).withColumn("text_key", text.norm_text(column))
    keyed = keyed.join(numeric, "num_key", "left").join(textual, "text_key", "left")
    out = keyed.withColumn("mapped", F.coalesce("by_number", "by_text")).drop(
        "num_key", "text_key", "by_number", "by_text"
    )
    return out.where(F.col("mapped").isNotNull()), out.where(F.col("mapped").isNull()).drop("mapped")


def join_key_sources(df: DataFrame, manager: str, exact, substring, wildcard: bool = True) -> DataFrame:
    """Where each key value comes from; inputs are canonical value columns (null = unusable).

    ``exact`` / ``substring`` are boolean columns telling how the manager matched.
    """
    basic = lambda k: F.when(F.col(k).isNull(), F.lit("missing")).otherwise(F.lit("raw"))
    folded = text.norm_text(manager)
    center = (
        F.when(F.col("center_code").isNull(), F.lit("missing"))
        .when((F.col("center_code") != 0) | (folded == ""), F.lit("raw"))
        .when(exact, F.lit("manager_exact"))
        .when(substring, F.lit("manager_substring"))
        .when(F.lit(wildcard), F.lit("manager_wildcard"))
        .otherwise(F.lit("raw"))
    )
    return df.select(
        "*",
        basic("group_code").alias("group_source"),
        basic("gender_code").alias("gender_source"),
        basic("grad_status_code").alias("graduation_status_source"),
        center.alias("center_source"),
        basic("finance_code").alias("finance_source"),
        basic("school_code").alias("school_source"),
    )


def standard_columns(df: DataFrame, rules: Mapping[str, tuple[str, str, bool]]) -> tuple[DataFrame, dict]:
    """Known headers get their standard name and an English twin.

    ``rules``: header -> (standard name, twin name, numeric?). Numeric columns are cleaned
    to long, the others folded. The report (renamed, added, unmatched) comes from names only.
    """
    known = {text.norm_header(k): v for k, v in rules.items()}
    out, renamed, added, unmatched = [], {}, [], []
    for c in df.columns:
        rule = known.get(text.norm_header(c))
        if rule is None:
            out.append(F.col(f"`{c}`"))
            unmatched.append(c)
            continue
        standard, twin, numeric = rule
        src = F.col(f"`{c}`")
        value = text.numlike_long(src) if numeric else text.norm_text(src)
        out.append(value.alias(standard))
        if c not in (standard, twin):
            renamed[c] = standard
        if twin not in df.columns:
            out.append((F.coalesce(value.cast("string"), F.lit("")) if numeric else value).alias(twin))
            added.append(twin)
    return df.select(*out), {"renamed": renamed, "added": sorted(added), "unmatched": sorted(unmatched)}


def mentor_report_defaults(df: DataFrame, required: Sequence[str], code_columns: Sequence[str]) -> DataFrame:
    """Derive missing report columns, then require the rest."""
    out = df
    if "school_count" not in df.columns:
        filled = [F.when(~keys.no_school(c), 1).otherwise(0) for c in code_columns if c in df.columns]
        total = F.lit(0)
        for f in filled:
            total = total + f
        out = out.withColumn("school_count", total.cast("bigint"))
    if "postal_code" not in df.columns:
        out = out.withColumn("postal_code", F.lit(None).cast("string"))
    for c in ("covered_now", "special_limit"):
        if c not in df.columns:
            out = out.withColumn(c, F.lit(0).cast("bigint"))
    missing = [c for c in required if c not in out.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return out
