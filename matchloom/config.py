"""Policy values and fixed reference data.

Everything here is small and fixed by policy; it enters plans as literals or as
the 33-row ``group_dim`` relation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

KEYS = (
    "group_code",
    "gender_code",
    "grad_status_code",
    "center_code",
    "finance_code",
    "school_code",
)

STAGES = (
    "type",
    "group",
    "gender",
    "graduation_status",
    "center",
    "finance",
    "school",
    "capacity_gate",
)

# Level, group name, code of every valid group.
GROUPS = (
    ("کنکوری", "دوازدهم ریاضی", 1),
    ("کنکوری", "دوازدهم تجربی", 3),
    ("کنکوری", "دوازدهم انسانی", 5),
    ("کنکوری", "هنر", 7),
    ("کنکوری", "دوازدهم علوم و معارف اسلامی", 8),
    ("کنکوری", "منحصرا زبان", 9),
    ("متوسطه دوم", "دهم ریاضی", 24),
    ("متوسطه دوم", "دهم تجربی", 25),
    ("متوسطه دوم", "دهم انسانی", 26),
    ("متوسطه دوم", "دهم علوم و معارف اسلامی", 30),
    ("متوسطه دوم", "یازدهم ریاضی", 21),
    ("متوسطه دوم", "یازدهم تجربی", 22),
    ("متوسطه دوم", "یازدهم علوم انسانی", 23),
    ("متوسطه دوم", "یازدهم علوم و معارف اسلامی", 29),
    ("متوسطه اول", "نهم", 27),
    ("متوسطه اول", "هشتم", 31),
    ("متوسطه اول", "هفتم", 33),
    ("دبستان", "دوم دبستان", 46),
    ("دبستان", "سوم دبستان", 45),
    ("دبستان", "چهارم دبستان", 43),
    ("دبستان", "پنجم دبستان", 41),
    ("دبستان", "ششم دبستان", 35),
    ("هنرستان", "دوازدهم الکتروتکنیک", 11),
    ("هنرستان", "دوازدهم شبکه و نرم‌افزار رایانه", 12),
    ("هنرستان", "دوازدهم تربیت بدنی", 14),
    ("هنرستان", "دوازدهم حسابداری", 17),
    ("هنرستان", "دوازدهم مکانیک خودرو", 18),
    ("هنرستان", "یازدهم الکتروتکنیک", 53),
    ("هنرستان", "یازدهم شبکه و نرم افزار", 55),
    ("هنرستان", "یازدهم تربیت بدنی", 66),
    ("هنرستان", "یازدهم حسابداری", 69),
    ("هنرستان", "دهم شبکه و نرم‌افزار رایانه", 83),
    ("هنرستان", "دهم حسابداری", 89),
)

# Groups that exist for students and for graduates.
DUAL_STATUS = (1, 3, 5, 7, 8, 9, 11, 12, 14, 17, 18)

VALID_CODES = tuple(sorted(code for _, _, code in GROUPS))


@dataclass(frozen=True)
class Policy:
    """Driver-side policy; never grows with the data. The defaults are fixed values."""

    version: str = "1.0.4"
    finance_variants: tuple = (0, 1, 3)
    normal_statuses: tuple = (1, 0)
    school_statuses: tuple = (1,)
    postal_range: tuple = (1000, 9999)
    center_map: dict = field(
        default_factory=lambda: {"شهدخت کشاورز": 1, "آیناز هوشمند": 2, "*": 0}
    )
    center_managers: dict = field(
        default_factory=lambda: {1: ("شهدخت کشاورز",), 2: ("آیناز هوشمند",), 0: ()}
    )
    center_priority: tuple = (1, 2, 0)
    default_center: int = 0
    unknown_manager_mode: str = "wildcard"
    school_code_empty_as_zero: bool = True
    prefer_major_code: bool = True
    default_status: str = "ACTIVE"
    allowed_statuses: tuple = ("ACTIVE", "FROZEN", "INACTIVE")
    mentor_status: dict = field(default_factory=dict)
    virtual_alias_range: tuple = (7000, 7999)
    virtual_name_patterns: tuple = (r"در\s+انتظار\s+تخصیص", "فراگیر")
    gender_mid3: dict = field(default_factory=lambda: {1: "357", 0: "373"})
    school_codes: tuple = ()
    center_channels: dict = field(default_factory=lambda: {"GOLESTAN": (1,), "SADRA": (2,)})
    active_status_values: tuple = ()
    dedup_removed_ratio: float = 0.05
    school_mismatch_ratio: float = 0.0
    #: Gates of the matrix build that fail the run when it is asked to enforce them; others only report.
    failing_gates: tuple = ("dedupe", "coverage")
    coverage_threshold: float = 0.95
    coverage_mode: str = "mentors"
    include_blocked: bool = False
    require_student_presence: bool = False
    can_allocate_tokens: tuple = ("بلی", "بله", "Yes", "yes", "1", "true", "True")

    def finance_clusters(self) -> dict[int, int]:
        """Map every listed finance code to the smallest code of its cluster.

        A flat list is one cluster, a mapping or a list of lists is several.
        """
        raw = self.finance_variants
        if isinstance(raw, dict):
            groups = [
                {int(k), *(int(x) for x in (v if isinstance(v, (list, tuple, set)) else (v,)))}
                for k, v in raw.items()
            ]
        elif any(isinstance(x, (list, tuple, set)) for x in raw):
            groups = [{int(v) for v in x} for x in raw if isinstance(x, (list, tuple, set))]
        else:
            groups = [{int(v) for v in raw}]
        out: dict[int, int] = {}
        for members in groups:
            for code in members:
                out.setdefault(code, min(members))
        return out


def group_dim_sql() -> str:
    """The group dimension as a ``SELECT`` accepted by Spark SQL and ANSI engines."""
    rows = ", ".join(
        f"({code}, '{level}', '{name}', {str(code in DUAL_STATUS).lower()})"
        for level, name, code in GROUPS
    )
    return (
        "SELECT CAST(group_code AS BIGINT) AS group_code, level, name, is_dual "
        f"FROM (VALUES {rows}) AS g(group_code, level, name, is_dual)"
    )


def group_dim(spark: SparkSession) -> DataFrame:
    """33 rows, fixed; a local relation the optimizer broadcasts by size."""
    return spark.sql(group_dim_sql())
