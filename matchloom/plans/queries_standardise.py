"""Column standardisation (text, numbers, keys, ids, contacts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.config import DUAL_STATUS, GROUPS, Policy
from matchloom.functions import contact, ids, keys, text
from matchloom.plans import check_sql as ck
from matchloom.plans.registry import query

_DUAL = ",".join(str(c) for c in DUAL_STATUS)


def _b(e):
    return e.cast("bigint")


@query(
    "N1_norm_text",
    f"SELECT doc_id, sha256({ck.norm('text')}) AS folded_hash, CAST(length({ck.norm('text')}) AS BIGINT) AS folded_chars FROM documents",
)
def norm_text(t):
    s = text.norm_text("text")
    return t.documents.select(
        "doc_id", F.sha2(s, 256).alias("folded_hash"), _b(F.length(s)).alias("folded_chars")
    )


@query(
    "N1_norm_text_cells",
    f"SELECT row_id, {ck.norm('gender_cell')} AS gender_text, {ck.norm('status_cell')} AS status_text, "
    f"{ck.norm('list_cell')} AS list_text FROM messy",
    ("messy",),
)
def norm_text_cells(t):
    return t.messy.select(
        "row_id",
        text.norm_text("gender_cell").alias("gender_text"),
        text.norm_text("status_cell").alias("status_text"),
        text.norm_text("list_cell").alias("list_text"),
    )


@query("N2_numlike", f"SELECT row_id, {ck.numlike('cell')} AS num_text FROM messy", ("messy",))
def numlike(t):
    return t.messy.select("row_id", text.numlike("cell").alias("num_text"))


@query("N3_to_long", f"SELECT row_id, {ck.to_long('cell')} AS value FROM messy", ("messy",))
def to_long(t):
    return t.messy.select("row_id", text.to_long("cell").alias("value"))


@query(
    "N4_bool_like",
    f"""SELECT row_id, CAST(CASE WHEN lower({ck.clean('flag_cell')}) IN ({','.join(ck.q(v) for v in text.TRUTHY)})
      OR TRY_CAST({ck.clean('flag_cell')} AS DOUBLE) = 1 THEN 1 ELSE 0 END AS BIGINT) AS flag FROM messy""",
    ("messy",),
)
def bool_like(t):
    return t.messy.select("row_id", text.bool_like("flag_cell").alias("flag"))


@query(
    "N5_split_tokens",
    f"""WITH parts AS (SELECT row_id, unnest(regexp_split_to_array({ck.blankable('list_cell')}, '[,|،؛]+')) AS p,
      generate_subscripts(regexp_split_to_array({ck.blankable('list_cell')}, '[,|،؛]+'), 1) AS i FROM messy),
    folded AS (SELECT row_id, min(i) AS i, {ck.norm('p')} AS tok FROM parts GROUP BY row_id, {ck.norm('p')}),
    kept AS (SELECT * FROM folded WHERE tok <> '' AND {ck.numlike('tok')} <> '0')
    SELECT m.row_id, coalesce(string_agg(k.tok, '|' ORDER BY k.i), '') AS tokens
    FROM messy m LEFT JOIN kept k ON m.row_id = k.row_id GROUP BY m.row_id""",
    ("messy",),
)
def split_tokens(t):
    return t.messy.select("row_id", F.array_join(text.split_tokens("list_cell"), "|").alias("tokens"))


@query(
    "N6_gender_status",
    f"""SELECT row_id, {ck.gender('gender_cell')} AS gender, {ck.gender('gender_cell', 'NULL')} AS gender_strict,
    CAST(CASE WHEN lower(trim(coalesce(status_cell,''))) IN ('0','graduate','grad') THEN 0
      WHEN lower(trim(coalesce(status_cell,''))) IN ('1','student','pupil') THEN 1
      WHEN contains({ck.norm('status_cell')}, 'فارغ') THEN 0 ELSE 1 END AS BIGINT) AS status FROM messy""",
    ("messy",),
)
def gender_status(t):
    return t.messy.select(
        "row_id",
        keys.gender("gender_cell").alias("gender"),
        keys.gender("gender_cell", strict=True).alias("gender_strict"),
        keys.status("status_cell").alias("status"),
    )


_SEP = ck.q(text.SCHOOL_SEPARATORS + text.KASHIDA)
_SPACES = ck.q(" " * len(text.SCHOOL_SEPARATORS))


def _school_first(x):
    n = ck.numlike(f"translate({x}, {_SEP}, {_SPACES})")
    return f"TRY_CAST(regexp_extract({n}, '^(-?[0-9]+)', 1) AS BIGINT)"


@query(
    "N7_school_code",
    f"""SELECT row_id, greatest({ck.int_part('school_cell')}, 0) AS school_code,
    coalesce({_school_first('school_cell')}, {_school_first('cell')}) AS first_code FROM messy""",
    ("messy",),
)
def school_code(t):
    return t.messy.select(
        "row_id",
        keys.school_code("school_cell").alias("school_code"),
        keys.school_code_first("school_cell", "cell").alias("first_code"),
    )


def _key_int(x):
    s = f"regexp_replace(translate({ck.digits(f'coalesce({x}, chr(32))')}, chr(8204) || chr(8205), ''), '\\s+', '', 'g')"
    return s, f"(CASE WHEN regexp_matches({s}, '^[+-]?[0-9]+$') THEN TRY_CAST({s} AS BIGINT) END)"


_gs, _gv = _key_int("gender_cell")
_cs, _cv = _key_int("center_cell")
_ss, _sv = _key_int("school_cell")
_rs, _rv = _key_int("group_cell")
_fs, _fv = _key_int("finance_cell")


@query(
    "N8_canonical_key",
    f"""WITH v AS (SELECT row_id,
      CASE WHEN {ck.norm('gender_cell')} = '' THEN NULL WHEN {ck.norm('gender_cell')} IN ('پسر','مرد') THEN 1
        WHEN {ck.norm('gender_cell')} IN ('دختر','زن','خانم') THEN 0
        WHEN {_gv} IN (0, 1) THEN {_gv} END AS gender_code,
      coalesce(CASE {ck.norm('center_cell')} WHEN 'شهدخت کشاورز' THEN 1 WHEN 'اینаз' THEN 2 END,
        CASE WHEN {ck.norm('center_cell')} = '' AND {_cs} <> '' AND {_cv} IS NULL THEN 0 END,
        CASE WHEN {_cv} >= 0 THEN {_cv} END) AS center_code,
      CASE WHEN {_cs} = '' OR {_cv} < 0 THEN 'DATA_MISSING' ELSE 'DATA_INVALID' END AS center_err,
      CASE WHEN {_ss} = '' THEN 0 WHEN {_sv} >= 0 THEN {_sv} END AS school_code,
      CASE WHEN {_ss} = '' OR {_sv} < 0 THEN 'DATA_MISSING' ELSE 'DATA_INVALID' END AS school_err,
      CASE WHEN list_contains({ck.VALID}, {_rv}) THEN {_rv} END AS group_code,
      CASE WHEN {_rs} = '' OR {_rv} < 0 THEN 'DATA_MISSING' ELSE 'DATA_INVALID' END AS group_err,
      CASE WHEN {_fv} >= 0 THEN {_fv} END AS finance_code,
      CASE WHEN {_fs} = '' OR {_fv} < 0 THEN 'DATA_MISSING' ELSE 'DATA_INVALID' END AS finance_err
    FROM messy)
    SELECT row_id, CAST(gender_code AS BIGINT) AS gender_code, CASE WHEN gender_code IS NULL THEN 'DATA_MISSING' END AS gender_error,
      CAST(center_code AS BIGINT) AS center_code, CASE WHEN center_code IS NULL THEN center_err END AS center_error,
      CAST(school_code AS BIGINT) AS school_code, CASE WHEN school_code IS NULL THEN school_err END AS school_error,
      CAST(group_code AS BIGINT) AS group_code, CASE WHEN group_code IS NULL THEN group_err END AS group_error,
      CAST(finance_code AS BIGINT) AS finance_code, CASE WHEN finance_code IS NULL THEN finance_err END AS finance_error
    FROM v""".replace("اینаз", "ایناز هوشمند"),
    ("messy",),
)
def canonical_key(t):
    cols = ["row_id"]
    for key in ("gender", "center", "school", "group", "finance"):
        value, error = keys.canonical_key(f"{key}_cell", f"{key}_code")
        cols += [value.alias(f"{key}_code"), error.alias(f"{key}_error")]
    return t.messy.select(*cols)


@query(
    "N9_parse_group_codes",
    f"""SELECT row_id, array_to_string({ck.valid_codes('group_cell')}, ',') AS codes,
    array_to_string({ck.invalid_codes('group_cell')}, ',') AS invalid_codes,
    array_to_string(list_filter(regexp_split_to_array(trim(replace({ck.digits("coalesce(group_cell,'')")}, '-', ':')), '[,،\\s]+'),
       lambda k: k <> '' AND NOT (regexp_matches(k, '^[0-9]+(:[0-9]+)?$') AND NOT regexp_matches(k, '^0+(:|$)'))), ',') AS invalid_tokens
    FROM messy""",
    ("messy",),
)
def parse_group_codes(t):
    _, bad_tokens = keys.parse_group_codes_strict("group_cell")
    return t.messy.select(
        "row_id",
        F.array_join(keys.parse_group_codes("group_cell"), ",").alias("codes"),
        F.array_join(keys.invalid_group_codes("group_cell"), ",").alias("invalid_codes"),
        F.array_join(bad_tokens, ",").alias("invalid_tokens"),
    )


@query(
    "N11_national_code",
    f"SELECT row_id, {ck.national('cell')} AS national_code FROM messy",
    ("messy",),
)
def national_code(t):
    return t.messy.select("row_id", ids.national_code("cell").alias("national_code"))


@query(
    "N12_phones",
    f"""SELECT row_id, {ck.mobile('phone_1')} AS mobile,
    CASE WHEN regexp_matches({ck.phone_digits('phone_2')}, '^[35]') THEN {ck.phone_digits('phone_2')} END AS landline,
    CASE WHEN regexp_matches({ck.phone_digits('phone_2')}, '^[35]') OR {ck.phone_digits('phone_2')} = '00000000000'
      THEN {ck.phone_digits('phone_2')} END AS landline_special FROM messy""",
    ("messy",),
)
def phones(t):
    return t.messy.select(
        "row_id",
        contact.mobile("phone_1").alias("mobile"),
        contact.landline("phone_2").alias("landline"),
        contact.landline("phone_2", allow_special=True).alias("landline_special"),
    )


@query(
    "N13_guardian_phones",
    f"""WITH m AS (SELECT row_id, {ck.mobile('phone_1')} AS a, {ck.mobile('phone_2')} AS b FROM messy)
    SELECT row_id, coalesce(a, b) AS contact1, CASE WHEN a IS NOT NULL AND a <> b THEN b END AS contact2 FROM m""",
    ("messy",),
)
def guardian_phones(t):
    a, b = contact.guardian_phones("phone_1", "phone_2")
    return t.messy.select("row_id", a.alias("contact1"), b.alias("contact2"))


_REG = f"trim({ck.digits('registration_cell')})"
_REGN = f"(CASE WHEN regexp_matches({_REG}, '^[+-]?[0-9]+(\\.0*)?$') THEN TRY_CAST(regexp_extract({_REG}, '^([+-]?[0-9]+)', 1) AS BIGINT) END)"


@query(
    "N14_contact_policy",
    f"""SELECT row_id, CASE WHEN coalesce({_REGN} = 3, false) AND (phone_2 IS NULL OR trim(phone_2) = '') THEN '00000000000' ELSE phone_2 END AS landline,
    CASE WHEN {_REGN} = 3 THEN '1111111111111111' ELSE '' END AS tracking FROM messy""",
    ("messy",),
)
def contact_policy(t):
    df = t.messy.withColumn("status", contact.registration_status("registration_cell"))
    phone, tracking = contact.contact_policy("status", "phone_2", F.lit(""))
    return df.select("row_id", phone.alias("landline"), tracking.alias("tracking"))


@query(
    "N15_registration_status",
    f"""SELECT row_id, {_REGN} AS status_code,
    CASE coalesce({_REGN}, 0) WHEN 1 THEN 'بنیاد' WHEN 3 THEN 'حکمت' ELSE 'عادی' END AS label FROM messy""",
    ("messy",),
)
def registration_status(t):
    code = contact.registration_status("registration_cell", "finance_cell")
    return t.messy.select(
        "row_id", code.alias("status_code"), contact.registration_label(F.coalesce(code, F.lit(0))).alias("label")
    )


@query(
    "N16_natural_key",
    f"SELECT row_id, {ck.natural('cell')} AS sort_key, dense_rank() OVER (ORDER BY {ck.natural('cell')}) AS position FROM messy QUALIFY row_id % 1 = 0".replace(
        " QUALIFY row_id % 1 = 0", ""
    ),
    ("messy",),
)
def natural_key(t):
    from matchloom.operators.numbering import lookup, number_rows

    df = t.messy.select("row_id", ids.natural_key("cell").alias("sort_key"))
    # Distinct keys are numbered in radix cells of their first characters.
    distinct = df.select("sort_key").distinct()
    ranked = number_rows(
        distinct, [F.col("sort_key")], [(f"__p{n}", F.substring("sort_key", 1, n)) for n in (2, 4, 6, 8, 12)], name="position"
    )
    return lookup(df, ranked, ["sort_key"], ["position"])


def _jal(x):
    s = f"trim({ck.digits(f'coalesce({x}, chr(32))')})"
    g = lambda i: f"TRY_CAST(regexp_extract({s}, '^([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}})$', {i}) AS BIGINT)"
    leap = f"((({g(1)} - 474) % 2820 + 2820) % 2820 + 474 + 38) * 682 % 2816 < 682"
    return f"""({s} = '' OR coalesce({g(2)} BETWEEN 1 AND 12 AND {g(3)} >= 1 AND {g(3)} <=
      CASE WHEN {g(2)} <= 6 THEN 31 WHEN {g(2)} <= 11 THEN 30 WHEN {leap} THEN 30 ELSE 29 END, false))"""


@query(
    "N17_clean_birth_date",
    f"SELECT row_id, CASE WHEN {_jal('birth_cell')} THEN birth_cell END AS birth_date, NOT {_jal('birth_cell')} AS cleaned FROM messy",
    ("messy",),
)
def clean_birth_date(t):
    return t.messy.select(
        "row_id",
        contact.clean_birth_date("birth_cell").alias("birth_date"),
        (~contact.valid_birth_date("birth_cell")).alias("cleaned"),
    )


@query(
    "N20_mentor_alias",
    f"""WITH p AS (SELECT row_index, mentor_id, school_count, TRY_CAST(regexp_extract({ck.numlike('postal_code')}, '^(-?[0-9]+)', 1) AS BIGINT) AS n FROM report)
    SELECT row_index, CASE WHEN CAST(school_count AS BIGINT) > 0 THEN regexp_replace(trim(mentor_id), '^([0-9]+)\\.0$', '\\1')
      WHEN n BETWEEN 1000 AND 9999 THEN CAST(n AS VARCHAR) ELSE '' END AS alias FROM p""",
    ("report",),
)
def mentor_alias(t):
    kind = keys.mentor_type(text.numlike_long("school_count"))
    return t.report.select("row_index", ids.mentor_alias(kind, "postal_code", "mentor_id").alias("alias"))


def _alias_digits(x):
    d = f"right(regexp_replace({ck.digits(f'coalesce({x}, chr(32))')}, '[^0-9]', '', 'g'), 10)"
    return f"CASE WHEN {d} = '' THEN NULL WHEN ltrim({d}, '0') = '' THEN {d} ELSE ltrim({d}, '0') END"


@query(
    "N21_first_alias",
    f"SELECT row_id, coalesce({_alias_digits('school_cell')}, {_alias_digits('cell')}, '') AS alias FROM messy",
    ("messy",),
)
def first_alias(t):
    return t.messy.select("row_id", ids.first_alias("school_cell", "cell").alias("alias"))


@query(
    "N22_allowed_statuses",
    f"""SELECT mentor_id, group_code, grad_status_code, has_school_constraint,
      CASE WHEN group_code IN ({_DUAL}) AND NOT has_school_constraint THEN '1,0' ELSE '1' END AS allowed FROM mentors""",
    ("mentors",),
)
def allowed_statuses(t):
    dom = keys.allowed_statuses("group_code", "has_school_constraint")
    return t.mentors.select(
        "mentor_id", "group_code", "grad_status_code", "has_school_constraint",
        F.array_join(dom, ",").alias("allowed"),
    )


@query(
    "N23_academic_info",
    """WITH by_name AS (SELECT name, count(*) AS n, min(group_code) AS code FROM group_dim GROUP BY name)
    SELECT s.student_id, s.group_code, g.level, g.name, coalesce(g.is_dual, false) AS is_dual,
      CASE WHEN b.n = 1 THEN b.code END AS code_of_name,
      CASE WHEN g.group_code IS NULL THEN NULL ELSE (s.grad_status_code = 1 OR g.is_dual) END AS status_ok
    FROM students_gap s LEFT JOIN group_dim g ON s.group_code = g.group_code LEFT JOIN by_name b ON g.name = b.name""",
    ("students_gap", "group_dim"),
)
def academic_info(t):
    from matchloom.operators.standardise import academic_info as op

    return op(t.students_gap).select(
        "student_id", "group_code", "level", "name", "is_dual", "code_of_name", "status_ok"
    )


_SCHOOLS = (1, 4, 7, 10, 13)


@query(
    "N24_student_binding",
    "SELECT student_id, CASE WHEN grad_status_code = 1 AND school_code IN (1,4,7,10,13) THEN 'SCHOOL' ELSE 'NORMAL' END AS binding FROM students",
    ("students",),
)
def student_binding(t):
    return t.students.select(
        "student_id", keys.student_binding("school_code", "grad_status_code", _SCHOOLS).alias("binding")
    )


@query(
    "N25_allocation_channel",
    """SELECT student_id, CASE WHEN grad_status_code = 1 AND school_code IN (1,4,7,10,13) AND gender_code IN (0) THEN 'SCHOOL'
      WHEN center_code = 1 THEN 'GOLESTAN' WHEN center_code = 2 THEN 'SADRA'
      WHEN finance_code = 1 THEN 'GOLESTAN' WHEN finance_code = 2 THEN 'SADRA' ELSE 'GENERIC' END AS channel FROM students""",
    ("students",),
)
def allocation_channel(t):
    policy = Policy(school_codes=_SCHOOLS, active_status_values=(0,))
    channel = keys.allocation_channel(
        "school_code", "grad_status_code", "center_code", "finance_code", "gender_code", policy
    )
    return t.students.select("student_id", channel.alias("channel"))


@query(
    "N26_mentor_type",
    "SELECT row_index, CASE WHEN CAST(school_count AS BIGINT) > 0 THEN 'SCHOOL' ELSE 'NORMAL' END AS mentor_type FROM report",
    ("report",),
)
def mentor_type(t):
    return t.report.select("row_index", keys.mentor_type(text.numlike_long("school_count")).alias("mentor_type"))


@query(
    "N28_capacity_fields",
    """WITH r AS (SELECT row_index, greatest(coalesce(TRY_CAST(covered_now AS BIGINT), 0), 0) AS cur,
      greatest(coalesce(TRY_CAST(special_limit AS BIGINT), 0), 0) AS lim, row_index % 4 AS fresh FROM report)
    SELECT row_index, lim AS capacity_limit, cur AS assigned_baseline, fresh AS allocations_new, cur + fresh AS total_allocations,
      greatest(lim - cur - fresh, 0) AS remaining_capacity, 5 + fresh AS legacy_limit FROM r""",
    ("report",),
)
def capacity_fields(t):
    from matchloom.operators.governance import capacity_fields as op

    df = t.report.select(
        "row_index",
        text.numlike_long("special_limit").alias("capacity_limit"),
        text.numlike_long("covered_now").alias("assigned_baseline"),
        (F.col("row_index") % 4).alias("allocations_new"),
    )
    full = op(df)
    legacy = op(
        df.select(
            "row_index", F.lit(0).cast("bigint").alias("capacity_limit"), "allocations_new",
            F.lit(0).cast("bigint").alias("assigned_baseline"),
            F.lit(5).cast("bigint").alias("remaining_capacity"),
        )
    ).select("row_index", F.col("capacity_limit").alias("legacy_limit"))
    return full.join(legacy, "row_index")


@query(
    "N29_capacity_outcome",
    """WITH r AS (SELECT row_index, coalesce(TRY_CAST(special_limit AS BIGINT), 0) AS lim, coalesce(TRY_CAST(covered_now AS BIGINT), 0) AS cur,
       row_index % 7 - 3 AS special, row_index % 6 = 0 AS frozen FROM report),
    o AS (SELECT *, lim + greatest(special, 0) - cur - 2 AS remaining FROM r)
    SELECT row_index, remaining AS remaining_capacity, cur + 2 AS total_allocations,
      concat_ws(',', CASE WHEN lim <= 0 THEN 'capacity_limit_missing' END, CASE WHEN frozen THEN 'capacity_frozen' END,
        CASE WHEN remaining <= 0 THEN 'capacity_exhausted' END) AS blocking_codes,
      NOT (lim <= 0 OR frozen OR remaining <= 0) AS capacity_ok FROM o""",
    ("report",),
)
def capacity_outcome(t):
    from matchloom.operators.matrix_core import capacity_outcome as op

    df = t.report.select(
        "row_index",
        F.coalesce(text.numlike_long("special_limit"), F.lit(0)).alias("capacity_limit"),
        F.coalesce(text.numlike_long("covered_now"), F.lit(0)).alias("assigned_baseline"),
        F.lit(2).cast("bigint").alias("allocations_new"),
        (F.col("row_index") % 7 - 3).alias("capacity_special"),
        (F.col("row_index") % 6 == 0).alias("capacity_frozen"),
    )
    return op(df).select(
        "row_index", "remaining_capacity", "total_allocations",
        F.array_join("blocking_codes", ",").alias("blocking_codes"), "capacity_ok",
    )


@query(
    "N33_display_text",
    f"""SELECT row_id, translate(coalesce(cell, ''), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS shown,
     CASE WHEN length(coalesce(cell,'')) <= 5 THEN translate(coalesce(cell, ''), '0123456789', '۰۱۲۳۴۵۶۷۸۹')
       ELSE left(translate(coalesce(cell, ''), '0123456789', '۰۱۲۳۴۵۶۷۸۹'), 4) || '…' END AS short,
     coalesce(cell, '') AS "cell | نمایش" FROM messy""",
    ("messy",),
)
def display_text(t):
    return t.messy.select(
        "row_id",
        text.fa_digits("cell").alias("shown"),
        text.safe_truncate("cell", 5).alias("short"),
        F.coalesce("cell", F.lit("")).alias("cell | نمایش"),
    )


@query(
    "N34_ranking_columns",
    f"""SELECT DISTINCT mentor_id, coalesce(remaining_capacity, 0) AS remaining_capacity, CAST(0 AS BIGINT) AS allocations_new,
      {ck.numlike('mentor_id')} AS mentor_id_text, {ck.natural('mentor_id')} AS mentor_sort_key FROM mentors""",
    ("mentors",),
)
def ranking_columns(t):
    from matchloom.operators.standardise import ranking_columns as op

    return op(t.mentors.select("mentor_id", "remaining_capacity")).distinct()


@query(
    "N35_student_defaults",
    """SELECT student_id, group_code, CAST(1 AS BIGINT) AS gender_code, grad_status_code, CAST(0 AS BIGINT) AS center_code,
      finance_code, CAST(0 AS BIGINT) AS school_code, group_code AS type_code FROM students""",
    ("students",),
)
def student_defaults(t):
    from matchloom.operators.standardise import promote_final_group, student_defaults as op, type_group_fill

    raw = t.students.select(
        "student_id", F.col("group_code").alias("final_exam_group"), "grad_status_code", "finance_code"
    )
    out = type_group_fill(op(promote_final_group(raw, "final_exam_group")))
    return out.select(
        "student_id", "group_code", "gender_code", "grad_status_code", "center_code", "finance_code",
        "school_code", "type_code",
    )


@query(
    "N36_counter_id",
    """WITH c AS (SELECT c_custkey, '54' || CASE WHEN c_custkey % 2 = 1 THEN '357' ELSE '373' END || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS id FROM customer)
    SELECT c_custkey, id AS counter, CAST(54 + 1350 AS BIGINT) AS academic_year, CAST(right(id, 4) AS BIGINT) AS sequence FROM c""",
)
def counter_id(t):
    cid = ids.counter_id(F.lit(54), F.col("c_custkey") % 2, F.col("c_custkey") % 10000)
    return t.customer.select(
        "c_custkey", cid.alias("counter"), ids.counter_year(cid).alias("academic_year"),
        ids.counter_sequence(cid).alias("sequence"),
    )


@query("N37_stable_hash", "SELECT s_suppkey, sha256(CAST(s_suppkey AS VARCHAR)) AS tie_key FROM supplier")
def stable_hash(t):
    return t.supplier.select("s_suppkey", ids.stable_hash("s_suppkey").alias("tie_key"))


@query(
    "N41_school_tokens",
    """SELECT row_index, CASE WHEN lower(trim(coalesce(school_code_1, ''))) IN ('', '0', '-') THEN '' ELSE trim(school_code_1) END AS school_code_1,
      CASE WHEN lower(trim(coalesce(school_name_2, ''))) IN ('', '0', '-') THEN '' ELSE trim(school_name_2) END AS school_name_2 FROM report""",
    ("report",),
)
def school_tokens(t):
    return t.report.select(
        "row_index",
        keys.school_token("school_code_1").alias("school_code_1"),
        keys.school_token("school_name_2").alias("school_name_2"),
    )


_SOFT = ck.q(text.ARABIC_LETTERS + text.FOREIGN_DIGITS + "−٫ ")
_SOFT_TO = ck.q(text.PERSIAN_LETTERS + text.ASCII_DIGITS + "-. ")


def _soft(x):
    s = f"regexp_replace(translate(coalesce({x}, ''), {ck.q(text.SOFT_DROP)}, ''), '\\p{{M}}+', '', 'g')"
    s = f"replace(translate({s}, {_SOFT}, {_SOFT_TO}), 'الله', 'ل')"
    return f"trim(regexp_replace({s}, '[\\s‌]+', ' ', 'g'))"


@query(
    "N42_soft_text",
    f"""SELECT row_id, {_soft('status_cell')} AS soft_status, {_soft('gender_cell')} AS soft_gender,
      trim(regexp_replace({ck.digits("coalesce(cell, '')")}, '\\s+', ' ', 'g')) AS ascii_cell FROM messy""",
    ("messy",),
)
def soft_text(t):
    return t.messy.select(
        "row_id",
        text.soft_text("status_cell").alias("soft_status"),
        text.soft_text("gender_cell").alias("soft_gender"),
        text.ascii_digit_text("cell").alias("ascii_cell"),
    )


@query(
    "N43_code_labels",
    """SELECT student_id, CASE gender_code WHEN 0 THEN 'دختر' WHEN 1 THEN 'پسر' ELSE '' END AS gender_label,
      CASE grad_status_code WHEN 1 THEN 'دانش‌آموز' WHEN 0 THEN 'فارغ‌التحصیل' ELSE '' END AS status_label,
      CASE center_code WHEN 0 THEN 'مرکز' WHEN 1 THEN 'گلستان' WHEN 2 THEN 'صدرا' ELSE '' END AS center_label,
      CASE WHEN school_code > 0 THEN 'مدرسه‌ای' ELSE 'عادی' END AS type_label FROM students""",
    ("students",),
)
def code_labels(t):
    return t.students.select(
        "student_id",
        keys.label("gender_code", keys.GENDER_LABEL).alias("gender_label"),
        keys.label("grad_status_code", keys.STATUS_LABEL).alias("status_label"),
        keys.label("center_code", keys.CENTER_LABEL).alias("center_label"),
        keys.label(keys.mentor_type("school_code"), keys.TYPE_LABEL, "عادی").alias("type_label"),
    )


@query(
    "N44_roster_gender",
    f"SELECT row_id, {ck.gender('gender_cell')} AS from_column, CAST(0 AS BIGINT) AS from_hint, CAST(1 AS BIGINT) AS forced FROM messy",
    ("messy",),
)
def roster_gender(t):
    return t.messy.select(
        "row_id",
        keys.roster_gender("gender_cell").alias("from_column"),
        keys.roster_gender("gender_cell", hint="report-3730.csv").alias("from_hint"),
        keys.roster_gender("gender_cell", mode="male").alias("forced"),
    )


@query(
    "N45_code_columns_as_text",
    f"SELECT CAST(row_id AS VARCHAR) AS row_id, {ck.mobile('phone_1')} AS phone_1, CASE WHEN regexp_matches({ck.phone_digits('phone_2')}, '^[35]') THEN {ck.phone_digits('phone_2')} END AS phone_2, registration_cell FROM messy",
    ("messy",),
)
def code_columns_as_text(t):
    from matchloom.operators.standardise import code_columns_as_text as op

    df = t.messy.select("row_id", "phone_1", "phone_2", "registration_cell")
    return op(df, text=("row_id",), mobiles=("phone_1",), landlines=("phone_2",))


_ID = "trim(cell)"
_BARE = ck.digits("replace(trim(cell), ' ', '')")


@query(
    "N46_coerce_semantics",
    f"""SELECT row_id, CASE WHEN {_ID} = '' OR cell IS NULL THEN NULL
      WHEN regexp_matches({_BARE}, '^[0-9]+\\.0$') OR regexp_matches({_BARE}, '^[+-]*([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN {ck.numlike('cell')} ELSE {_ID} END AS mentor_id,
      {_school_first(ck.norm('school_cell'))} AS school_code,
      CAST(CASE WHEN {ck.norm('status_cell')} = '' THEN NULL WHEN regexp_matches({ck.numlike(ck.norm('status_cell'))}, '^[0-9]+$') THEN CAST({ck.numlike(ck.norm('status_cell'))} AS BIGINT)
        WHEN contains({ck.norm('status_cell')}, 'فارغ') THEN 1 ELSE 0 END AS BIGINT) AS graduation_flag FROM messy""",
    ("messy",),
)
def coerce_semantics(t):
    from matchloom.operators.standardise import coerce_semantics as op

    df = t.messy.select(
        "row_id",
        F.col("cell").alias("mentor_id"),
        F.col("school_cell").alias("school_code"),
        F.col("status_cell").alias("graduation_flag"),
    )
    return op(df, "report")
