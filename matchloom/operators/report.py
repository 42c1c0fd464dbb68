"""Reports, exports and table comparison."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchloom.functions import contact, ids, text
from matchloom.operators.numbering import lookup


def history_metrics(summary: DataFrame) -> DataFrame:
    """Totals, history statuses and same-mentor share per channel."""
    n = lambda c: F.count_if(c).cast("bigint")
    st = F.col("history_status")
    same = F.coalesce("same_history_mentor", F.lit(False))
    return summary.groupBy("allocation_channel").agg(
        F.count(F.lit(1)).alias("students_total"),
        n(st == "already_allocated").alias("history_already_allocated"),
        n(st == "no_history_match").alias("history_no_history_match"),
        n(st == "missing_or_invalid_national_code").alias("history_missing_or_invalid"),
        n(same).alias("same_history_mentor_true"),
        F.round(F.avg(same.cast("double")), 6).alias("same_history_mentor_ratio"),
    )


def unallocated_summary(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unallocated students with the chosen columns."""
    return summary.where(F.col("final_status") != "ALLOCATED").select(*[c for c in columns if c in summary.columns])


def key_provenance(sources: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inferred and defaulted counts per key from the source columns, in one pass."""
    n = lambda c: F.count_if(c).cast("bigint")
    wide = sources.agg(
        *[n(F.col(c).startswith("manager_")).alias(f"i_{c}") for c in columns],
        *[n(F.col(c).isin("missing", "invalid")).alias(f"d_{c}") for c in columns],
    )
    items = F.array(*[F.struct(F.lit(c).alias("key_source"), F.col(f"i_{c}").alias("inferred"), F.col(f"d_{c}").alias("defaulted")) for c in columns])
    return wide.select(F.explode(items).alias("x")).select("x.*")


def profile_metrics(profiles: DataFrame) -> DataFrame:
    """Rows, mentors, multi-profile count and share."""
    per = profiles.groupBy("mentor_id").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("profile_rows"), F.count(F.lit(1)).alias("unique_mentor_ids"), F.count_if(F.col("n") > 1).alias("multi_profile_mentors"))
    ratio = F.coalesce(F.try_divide(F.col("multi_profile_mentors").cast("double"), F.col("unique_mentor_ids").cast("double")), F.lit(0.0))
    return out.withColumn("multi_profile_ratio", F.round(ratio, 6))


def condense(profiles: DataFrame) -> DataFrame:
    """Min, lower median, lower p90 and max of profiles per mentor.

    Quantiles are read from the histogram of counts, so no mentor list is sorted.
    """
    hist = profiles.groupBy("mentor_id").agg(F.count(F.lit(1)).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(F.lit(0)).orderBy("v").rowsBetween(W.unboundedPreceding, 0)  # one row per distinct count
    cum = hist.withColumn("cum", F.sum("c").over(w)).withColumn("total", F.sum("c").over(W.partitionBy(F.lit(0))))
    at = lambda q: F.min(F.when(F.col("cum") >= F.floor((F.col("total") - 1) * F.lit(q)) + 1, F.col("v")))
    return cum.agg(F.min("v").alias("min"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("v").alias("max"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Counts per entity type and code with a sample row each (smallest by row index)."""
    return issues.groupBy("entity_type", "error_code").agg(
        F.count(F.lit(1)).alias("issues"), F.min(F.struct("row_index", "column", "raw_value")).alias("s")
    ).select("entity_type", "error_code", "issues", F.col("s.row_index").alias("sample_row"), F.col("s.column").alias("sample_column"))


def exit_severity(issues: DataFrame, strict: bool = False) -> DataFrame:
    """0 clean, 2 issues, 3 when a column is missing or the mode is strict."""
    out = issues.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error_code").isin("MISSING_COLUMN", "MISSING_JOIN_KEY_COLUMN")).alias("b"))
    code = F.when(F.col("n") == 0, 0).when((F.col("b") > 0) | F.lit(strict), 3).otherwise(2)
    return out.select(F.col("n").alias("issues"), code.cast("bigint").alias("exit_code"))


def registration_distribution(df: DataFrame, column: str) -> DataFrame:
    v = text.to_long(column)
    return df.agg(
        F.count(v).alias("non_null"), F.count_if(v == 0).cast("bigint").alias("zeros"), F.count_if(v == 3).cast("bigint").alias("threes")
    )


def export_summary(logs: DataFrame, students: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("allocation_status"), F.lit("")) == "success"
    a = logs.agg(F.count_if(ok).cast("bigint").alias("allocated"), F.count_if(~ok).cast("bigint").alias("failed"))
    return students.agg(F.count(F.lit(1)).alias("total_students")).join(F.broadcast(a))


def export_errors(logs: DataFrame) -> DataFrame:
    bad = logs.where(F.coalesce("allocation_status", F.lit("")) != "success")
    return bad.select("student_id", F.coalesce(F.nullif("error_type", F.lit("")), "allocation_status").alias("error"))


def debug_report(violations: DataFrame, samples: int = 5) -> DataFrame:
    """Issue count per rule with up to ``samples`` rows each; a top-k report by design."""
    counts = violations.groupBy("rule_id").agg(F.count(F.lit(1)).alias("issues"))
    w = W.partitionBy("rule_id").orderBy("subject", "detail")
    top = violations.withColumn("sample_no", F.row_number().over(w)).where(F.col("sample_no") <= samples)
    return lookup(top, counts, ["rule_id"], ["issues"]).select("rule_id", "issues", "sample_no", "subject", "detail")


# Exports ---------------------------------------------------------------------------


# Columns that a form field may arrive under, first present one wins.
FORM_FIELDS = {
    "1": ("student_full_name", "نام و نام‌خانوادگی"),
    "2": ("student_birth_date", "تاریخ تولد"),
    "3": ("student_father_name", "نام پدر"),
    "4": ("student_art_school_status", "وضعیت هنرستان"),
    "5": ("student_average", "معدل"),
    "7": ("student_class_number", "شماره کلاس"),
    "8": ("student_seat_number", "شماره صندلی"),
    "20": ("student_mobile", "موبایل دانش‌آموز", "تلفن همراه"),
    "21": ("contact1_mobile", "موبایل رابط 1", "تلفن رابط 1"),
    "22": ("student_landline", "تلفن ثابت", "تلفن"),
    "23": ("contact2_mobile", "موبایل رابط 2", "تلفن رابط 2"),
    "24": ("contact1_relationship", "نسبت رابط 1"),
    "25": ("contact1_name", "نام رابط 1"),
    "26": ("contact2_relationship", "نسبت رابط 2"),
    "27": ("contact2_name", "نام رابط 2"),
    "29": ("student_school_name", "نام مدرسه"),
    "30": ("student_school_code", "کد مدرسه 1"),
    "31": ("student_major_code", "کد گروه/رشته"),
    "39": ("suggested_mentor_id", "پشتیبان پیشنهادی"),
    "60": ("student_postal_code", "کدپستی", "کد پستی"),
    "61": ("student_postal_code_alias", "کدپستی جایگزین", "کد پستی جایگزین"),
    "62": ("student_notes", "توضیحات"),
    "73": ("student_exam_group", "گروه آزمایشی"),
    "75": ("student_registration_status", "وضعیت ثبت نام"),
    "76": ("student_hekmat_tracking_code", "کد رهگیری حکمت"),
    "92": ("student_gender", "جنسیت"),
    "93": ("student_educational_status", "وضعیت تحصیلی"),
    "94": ("student_center", "مرکز ثبت‌نام"),
    "96": ("student_konkur_quota", "سهمیه کنکور"),
    "97": ("student_hekmat_package_type", "نوع بسته حکمت"),
    "98": ("student_foreign_national", "اتباع خارجی"),
    "101": ("student_first_name", "student_name", "نام"),
    "102": ("student_last_name", "student_family_name", "نام خانوادگی"),
    "143": ("student_national_code", "student_national_id", "کد ملی"),
    "150": ("submission_source", "منبع ارسال"),
    "151": ("form_version", "sa_form_version"),
}
NATIONAL_FIELD = "GF_NationalCode"
NATIONAL_COLUMNS = ("student_national_code", "student_national_id", "national_id")
CREATED_COLUMNS = ("student_created_at", "created_at")
# Date words of the export settings and of Spark's patterns.
DATE_WORDS = {"yyyy": "yyyy", "yy": "yy", "mm": "MM", "dd": "dd", "HH": "HH", "MM": "mm", "ss": "ss"}


class _Projection:
    """One handler a source kind; each makes the raw column of a spec."""

    def __init__(self, df: DataFrame, specs: Mapping, lookups: Mapping, today: str):
        self.df, self.specs, self.lookups, self.today = df, specs, lookups, today
        self.kinds = {
            "df": self.plain, "empty": lambda _: F.lit(""), "literal": lambda spec: F.lit(spec.get("value", "")),
            "system": self.system, "gf": self.form_field, "derived": self.derived, "lookup": self.looked_up,
        }

    def column(self, spec: Mapping) -> Column:
        return self.kinds.get(spec.get("source", "df"), self.plain)(spec)

    def named(self, name: str | None) -> Column | None:
        """A column of the frame, else the raw column of another spec."""
        if name in self.df.columns:
            return F.col(f"`{name}`")
        return self.column(self.specs[name]) if name in self.specs else None

    def system(self, spec: Mapping) -> Column:
        if spec.get("field") == "today":
            return F.lit(self.today)
        if spec.get("field") != "date_created":
            return F.lit(spec.get("value", ""))
        found = [c for c in CREATED_COLUMNS if c in self.df.columns]
        if not found:
            return F.lit(self.today)
        words = "|".join(DATE_WORDS)
        pattern = "".join(DATE_WORDS.get(w, f"'{w}'" if w.isalpha() else w) for w in re.findall(f"{words}|.", spec.get("format") or "yyyy-mm-dd"))
        return F.coalesce(F.date_format(F.col(f"`{found[0]}`").try_cast("timestamp"), pattern), F.lit(""))

    def form_field(self, spec: Mapping) -> Column:
        field = str(spec.get("field"))
        names = [*FORM_FIELDS.get(field, ()), field if field.startswith("student_") else f"student_{field}", f"student_gf_{field}", field]
        if field == NATIONAL_FIELD:
            names += NATIONAL_COLUMNS
        there = list(dict.fromkeys(n for name in names for n in (name, f"student_{name}") if n in self.df.columns))
        if not there:
            return F.lit("")
        columns = [F.col(f"`{n}`").cast("string") for n in there]
        if field != NATIONAL_FIELD:
            return self.replaced(columns[0], spec)
        # The first column with a code in it, row by row; nothing but zeros is no code.
        coded = [F.when(F.regexp_replace(_NORMALIZERS["digits_10"](c), "0", "") != "", c) for c in columns]
        return self.replaced(F.coalesce(*coded, F.lit("")), spec)

    def plain(self, spec: Mapping) -> Column:
        names = [c for c in (spec.get("field"), *spec.get("alternates", ())) if c in self.df.columns]
        return self.replaced(F.col(f"`{names[0]}`"), spec) if names else F.lit("")

    def replaced(self, base: Column, spec: Mapping) -> Column:
        other = self.named(spec.get("on_value_9000_use"))
        if other is None:
            return base
        return F.when(base.cast("string") == "9000", F.coalesce(other.cast("string"), F.lit(""))).otherwise(base.cast("string"))

    def derived(self, spec: Mapping) -> Column:
        base, table = self.named(spec.get("from")), self.lookups.get(spec.get("crosswalk"))
        if base is None:
            return F.lit("")
        return F.coalesce(_mapped(base, table), F.lit("")) if table else base

    def looked_up(self, spec: Mapping) -> Column:
        table, field = self.lookups.get(spec.get("lookup")), spec["field"]
        return F.coalesce(_mapped(F.col(f"`{field}`"), table), F.lit("")) if table and field in self.df.columns else F.lit("")


def _mapped(c: Column, table: Mapping) -> Column:
    """Value of a settings table, null where it has none; one literal whatever the number of entries."""
    text_table = "\x1e".join(f"{k}\x1f{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(text_table), F.lit("\x1e"), F.lit("\x1f")), c.cast("string"))


_NORMALIZERS = {
    "digits": text.ascii_digits,
    "digits_10": lambda c: F.coalesce(F.lpad(ids.first_match(text.ascii_digits(c), "[0-9]{1,10}$"), 10, "0"), F.lit("")),
    "mobile": lambda c: F.coalesce(contact.mobile(c), F.lit("")),
    "text": text.soft_text,
    "numlike": text.numlike,
}


def sabt_projection(df: DataFrame, specs: Mapping[str, Mapping], lookups: Mapping[str, Mapping] | None = None, today: str = "") -> DataFrame:
    """Config-driven output columns.

    Per column: source (df / literal / system / gf / lookup / derived / empty), normalise, map,
    type, and ``when: other=value`` that blanks the cell unless the other output column
    has the value (or its mapped label).
    """
    lookups = lookups or {}
    done: dict[str, Column] = {}
    source = _Projection(df, specs, lookups, today)
    for name, spec in specs.items():
        col = source.column(spec)
        for step in spec.get("normalize", ()):
            col = _NORMALIZERS[step](col)
        if spec.get("map"):
            col = F.coalesce(_mapped(col, spec["map"]), col.cast("string"))
        if spec.get("type") == "number":
            col = col.try_cast("double")
            if spec.get("precision") is not None:
                col = F.round(col, spec["precision"])
            col = col.cast("string")
        else:
            col = F.coalesce(col.cast("string"), F.lit(""))
        if spec.get("when"):
            other, value = (p.strip() for p in spec["when"].split("="))
            if other in done:
                wanted = {value, (specs[other].get("map") or {}).get(value, value)}
                col = F.when(done[other].isin(*wanted), col).otherwise(F.lit(""))
        done[name] = col
    return df.select(*[c.alias(n) for n, c in done.items()])


def export_frame(alloc: DataFrame, students: DataFrame, profile: Sequence[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Profile-ordered columns from allocations and students; unmappable entries as issues.

    ``profile`` lists (output name, table 'alloc' | 'student', column).
    """
    spark = alloc.sparkSession
    s = students.select("student_id", *[F.col(c).alias(f"__s_{c}") for c in students.columns if c != "student_id"])
    joined = alloc.join(s, "student_id", "left")
    out, issues = [], []
    for name, table, column in profile:
        have = alloc.columns if table == "alloc" else students.columns
        if column not in have:
            issues.append((name, f"{table}.{column}", "COLUMN_NOT_FOUND"))
            out.append(F.lit("").alias(name))
            continue
        src = column if table == "alloc" or column == "student_id" else f"__s_{column}"
        out.append(F.coalesce(F.col(src).cast("string"), F.lit("")).alias(name))
    return joined.select(*out), spark.createDataFrame(issues, "output string, source string, issue string")


# What a profile row calls its source, and the allocation field behind each header.
PROFILE_ALLOCATION, PROFILE_STUDENT, PROFILE_REMOVED = "خروجی برنامه بعد از تخصیص", "کپی کردن از اکسل ورودی", "حذف از اکسل خروجی"
PROFILE_FIELDS = {"پیدا کردن ردیف پشتیبان از فیلد 141": "mentor_id", "کد ثبت نام0": "student_id", "کپی کد جایگزین 39": "mentor_alias_code"}
PROFILE_CONDITION, PROFILE_EMPTY = "اگر", "خالی"


@dataclass(frozen=True)
class ExportColumn:
    """One output column: ``source`` is alloc, student or literal."""

    header: str
    source: str
    value: str
    order: int


def compile_profile(profile: DataFrame, student_fields: Mapping[str, str] | None = None) -> list[ExportColumn]:
    """The output columns of a profile table (header, value_map, order, source), one row a column, in their order.

    Rows without header or numeric order, and those marked as removed, are left out. A profile is refused if an
    entry is annotated (parentheses or a condition), an allocation header is unknown, orders repeat, a row
    with an order gives no column, or a student field is not among ``student_fields`` (header -> column).
    """
    cells = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("header", "value_map", "source")]
    number = F.col("order").cast("string").try_cast("double")
    rows = profile.select(*cells, F.when(F.isnan(number), F.lit(None)).otherwise(number).cast("long").alias("order"))
    names = profile.sparkSession.createDataFrame(list(PROFILE_FIELDS.items()), "name string, field string").select(text.norm_text("name").alias("__key"), "field")
    found = rows.withColumn("__key", text.norm_text("header")).join(F.broadcast(names), "__key", "left").collect()
    out = []
    for r in found:
        if not r["header"] or r["source"] == PROFILE_REMOVED:
            continue
        if any(mark in r["value_map"] for mark in ("(", ")", PROFILE_CONDITION)):
            raise ValueError(f"annotated entry {r['value_map']!r} of header {r['header']!r}")
        if r["order"] is None:
            continue
        value = r["value_map"] or r["header"]
        if r["source"] == PROFILE_ALLOCATION:
            if r["field"] is None:
                raise ValueError(f"no allocation field for header {r['header']!r}")
            out.append(ExportColumn(r["header"], "alloc", r["field"], r["order"]))
        elif r["source"] == PROFILE_STUDENT and value == PROFILE_EMPTY:
            out.append(ExportColumn(r["header"], "literal", "", r["order"]))
        elif r["source"] == PROFILE_STUDENT:
            if student_fields is not None and value not in student_fields:
                raise ValueError(f"student field {value!r} of header {r['header']!r} is not known")
            out.append(ExportColumn(r["header"], "student", (student_fields or {}).get(value, value), r["order"]))
        else:
            out.append(ExportColumn(r["header"], "literal", value, r["order"]))
    if len({c.order for c in out}) < len(out):
        raise ValueError("orders repeat in the profile")
    if len(out) != sum(r["order"] is not None for r in found):
        raise ValueError("rows with an order and exported columns differ in number")
    return sorted(out, key=lambda c: c.order)


def export_by_profile(alloc: DataFrame, students: DataFrame, columns: Sequence[ExportColumn]) -> tuple[DataFrame, DataFrame]:
    """The export of a compiled profile; columns that a table lacks are empty and reported, as by ``export_frame``."""
    named = [(c.header, c.source, c.value) for c in columns if c.source != "literal"]
    frame, issues = export_frame(alloc, students, named)
    literals = {c.header: F.lit(c.value) for c in columns if c.source == "literal"}
    return frame.withColumns(literals).select(*[F.col(f"`{c.header}`") for c in columns]), issues


def alias_rule(df: DataFrame, alias: str, postal: str) -> DataFrame:
    """Alias replaces the postal code when present; both as ten digits."""
    ten = _NORMALIZERS["digits_10"]
    return df.withColumn("postal_out", F.coalesce(F.nullif(ten(F.col(alias)), F.lit("")), ten(F.col(postal))))


# Set operations --------------------------------------------------------------------


def union_branches(normal: DataFrame, school: DataFrame) -> DataFrame:
    return normal.unionByName(school, allowMissingColumns=True)


def _side_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each distinct row with the times it occurs on either side; one scan of each and one shuffle."""
    both = a.select("*", F.lit(1).alias("__a"), F.lit(0).alias("__b")).union(b.select("*", F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    return both.groupBy(*[F.col(f"`{c}`") for c in a.columns]).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame | None:
    """Added, removed, row delta and equality of two snapshots; None when columns differ."""
    if a.columns != b.columns:
        return None
    one = _side_counts(a, b).agg(
        F.count_if((F.col("__a") == 0)).alias("added"), F.count_if((F.col("__b") == 0)).alias("removed"),
        F.coalesce(F.sum(F.col("__b") - F.col("__a")), F.lit(0)).cast("bigint").alias("row_delta"),
    )
    return one.select("*", ((F.col("added") == 0) & (F.col("removed") == 0) & (F.col("row_delta") == 0)).alias("equal"))


def id_differences(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Ids present on one side only."""
    x, y = a.select(column).where(F.col(column).isNotNull()).distinct(), b.select(column).where(F.col(column).isNotNull()).distinct()
    return x.join(y, column, "left_anti").withColumn("side", F.lit("left")).unionByName(
        y.join(x, column, "left_anti").withColumn("side", F.lit("right"))
    )


def shared_ids(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Ids on both sides; must be empty for disjoint sets."""
    return a.select(column).where(F.col(column).isNotNull()).intersect(b.select(column).where(F.col(column).isNotNull()))


def frame_differences(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row multiset differences on the given columns, ignoring row and column order."""
    counted = _side_counts(expected.select(*columns), actual.select(*columns)).where("__a <> __b")
    side = F.when(F.col("__a") > F.col("__b"), "expected").otherwise("actual")
    # One row for each surplus copy, in two steps so that no array grows with the count.
    surplus, step = F.abs(F.col("__a") - F.col("__b")), 10_000
    blocks = counted.select(*columns, side.alias("side"), surplus.alias("__n"), F.explode(F.sequence(F.lit(0), F.floor((surplus - 1) / step))).alias("__k"))
    size = F.least(F.lit(step), F.col("__n") - F.col("__k") * step).cast("int")
    return blocks.select(*columns, "side", F.explode(F.sequence(F.lit(1), size))).select(*columns, "side")
