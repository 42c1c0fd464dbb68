"""Text standardisation as ``Column`` expressions (no Python in the hot path)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit alphabets and letter folds.
FOREIGN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"
ARABIC_LETTERS = "يىكة"
PERSIAN_LETTERS = "ییکه"
NAN_TOKENS = ("", "nan", "none", "null", "nil", "na", "n/a")
NAN_PATTERN = r"(?i)^\s*(" + "|".join(NAN_TOKENS[1:]) + r")?\s*$"
SCHOOL_SEPARATORS = "-\u2212\u2011\u2013\u2014\u2015\ufe58\ufe63\uff0f/\\\u2044"
KASHIDA = "\u0640"
NUM_DROP = "\u066c,\u060c_\u00a0 "
BIDI_DROP = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
SOFT_DROP = "\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
CONTROL = (
    "[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f\u00ad\u0600-\u0605\u061c\u06dd\u070f"
    "\u180e\u200b\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]"
)
PERSIAN_DISPLAY_DIGITS = "۰۱۲۳۴۵۶۷۸۹"


def _kept(ch: str) -> bool:
    return "0" <= ch <= "9" or "\u0600" <= ch <= "\u06ff"


def _fold(ch: str) -> str:
    """Compatibility decomposition without marks, then letter and digit folds."""
    base = "".join(
        c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.category(c).startswith("M")
    )
    table = str.maketrans(FOREIGN_DIGITS + ARABIC_LETTERS, ASCII_DIGITS + PERSIAN_LETTERS)
    return base.translate(table)


#: Blocks that hold characters with a compatibility form: the BMP and the mathematical and enclosed alphabets.
FOLD_RANGES = ((0x80, 0xD800), (0xE000, 0x10000), (0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x1F100, 0x1F200))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Folds to one kept character, as two aligned texts, and folds to several characters, by character."""
    src, dst, several = [], [], {}
    for first, last in FOLD_RANGES:
        for point in range(first, last):
            ch = chr(point)
            if unicodedata.category(ch).startswith("M"):
                continue
            out = _fold(ch)
            if len(out) > 1 and any(map(_kept, out)):
                several[ch] = out
            elif len(out) == 1 and out != ch and _kept(out):
                src.append(ch)
                dst.append(out)
    return "".join(src), "".join(dst), several


FOLD_FROM, FOLD_TO, FOLD_SEVERAL = _fold_tables()
ALLAH = "الله"


def _ranges(chars) -> str:
    """Character class of the given characters, runs written as ranges."""
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


SEVERAL_CLASS = _ranges(FOLD_SEVERAL)


def fold_several(s: Column) -> Column:
    """Ligatures, fractions and the like as the letters and digits they stand for.

    Only texts that hold one are split into characters; the fold map is a literal.
    """
    table = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in FOLD_SEVERAL.items())), F.lit("\x1e"), F.lit("\x1f"))
    letters = F.transform(F.split(s, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch))
    return F.when(s.rlike(SEVERAL_CLASS), F.array_join(letters, "")).otherwise(s)


#: Texts with any other character may hold one of the rarer folds: those of ASCII and of the Arabic block but for its ligatures are few.
_PLAIN = [chr(p) for p in (*range(0x80), *range(0x600, 0x700), *range(0x200C, 0x2010)) if chr(p) not in FOLD_SEVERAL]
RARE_CLASS = "[^" + _ranges(_PLAIN)[1:]
PLAIN_FROM, PLAIN_TO = ("".join(x) for x in zip(*[(a, b) for a, b in zip(FOLD_FROM, FOLD_TO, strict=True) if a in _PLAIN], strict=True))


# Ordered rewrites of number-like text; '~' marks a negative number on the way.
NUMLIKE_STEPS = (
    ("[^0-9.\\-]", ""),
    ("^(?=[^-]*-)", "~"),
    ("-", ""),
    # Digits up to each further dot, from the end of the match before; the text up to the first dot stays.
    ("\\G((?:^[^.]*\\.)?[0-9]*)\\.?", "$1"),
    ("^~$", ""),
    ("^(~?)\\.", "$10."),
    ("(\\.[0-9]*?)0*$", "$1"),
    ("\\.$", ""),
    ("^(~?)0+(?=[0-9])", "$1"),
    ("^~0$", "0"),
    ("^~", "-"),
)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c) -> Column:
    """String form; null and the usual nan tokens become ''.

    Each step reads its input once, which keeps generated code small when these
    expressions nest.
    """
    s = F.coalesce(as_col(c).cast("string"), F.lit(""))
    return F.regexp_replace(s, NAN_PATTERN, "")


def text_or_blank(c) -> Column:
    """String form with null as ''; enough where the nan tokens vanish anyway."""
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def fold_digits(c) -> Column:
    return F.translate(as_col(c).cast("string"), FOREIGN_DIGITS, ASCII_DIGITS)


def norm_text(c) -> Column:
    """Stable Persian comparison text: letters folded, digits ASCII, marks and noise dropped."""
    raw = text_or_blank(c)
    # ASCII other than digits never survives; dropping it first spares Latin text the fold.
    s = F.regexp_replace(raw, r"[\x00-/:-\x7f]+", " ")
    # One look at the raw text decides whether the few folds of plain text will do.
    s = F.when(raw.rlike(RARE_CLASS), F.translate(fold_several(s), FOLD_FROM, FOLD_TO)).otherwise(F.translate(s, PLAIN_FROM, PLAIN_TO))
    s = F.regexp_replace(s, r"\p{M}+", "")
    s = F.regexp_replace(s, ALLAH, "ل")
    s = F.regexp_replace(s, "[^0-9\u0600-\u06ff]+", " ")
    return F.regexp_replace(F.trim(s), "^(ل )+ل$", "ل")


def numlike(c) -> Column:
    """Canonical numeric text: '١٬٢٣٤٫٥٠' -> '1234.5', '-000' -> '0', no digits -> ''."""
    s = F.translate(
        text_or_blank(c),
        FOREIGN_DIGITS + "\u2212\u066b" + NUM_DROP,
        ASCII_DIGITS + "-.",
    )
    for pattern, replacement in NUMLIKE_STEPS:
        s = F.regexp_replace(s, pattern, replacement)
    return s


def numlike_long(c) -> Column:
    """Long when the numeric text is a whole number, else null."""
    return F.regexp_extract(numlike(c), "^(-?[0-9]+)$", 1).try_cast("bigint")


def int_part(c) -> Column:
    """Integer part of the numeric text, 0 when there is none."""
    return F.coalesce(F.regexp_extract(numlike(c), "^(-?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def clean_digits(c) -> Column:
    """Drop direction controls and blanks, fold digits; null becomes ''."""
    s = F.coalesce(as_col(c).cast("string"), F.lit(""))
    return F.trim(F.translate(s, FOREIGN_DIGITS + BIDI_DROP + " ", ASCII_DIGITS))


def to_long(c) -> Column:
    """Long from messy text; null when it is not a whole number."""
    return F.regexp_extract(clean_digits(c), r"^([+-]?[0-9]+)(\.0*)?$", 1).try_cast("bigint")


# Boolean-like tokens.
TRUTHY = ("1", "true", "yes", "y", "t", "مدرسه‌ای", "مدرسهاي", "مدرسه", "school", "school-based")


def bool_like(c) -> Column:
    """1 for truthy tokens and numeric one, else 0."""
    s = F.lower(clean_digits(c))
    return F.when(s.isin(*TRUTHY) | (s.try_cast("double") == 1), 1).otherwise(0).cast("bigint")


def split_tokens(c) -> Column:
    """Delimited cell -> unique normalised tokens in order, zero tokens dropped."""
    parts = F.split(text_or_empty(c), "[,|،؛]+")
    folded = F.transform(parts, norm_text)
    return F.array_distinct(F.filter(folded, lambda t: (t != "") & (numlike(t) != "0")))


def ascii_digits(c) -> Column:
    """Only the digits, as ASCII."""
    return F.regexp_replace(fold_digits(text_or_blank(c)), "[^0-9]", "")


def sanitize_bidi(c) -> Column:
    """Drop direction and control characters, keep one ZWNJ of a run."""
    s = F.translate(F.coalesce(as_col(c).cast("string"), F.lit("")), SOFT_DROP, "")
    s = F.regexp_replace(s, "\u200c+", "\u200c")
    return F.regexp_replace(s, CONTROL, "")


def fa_digits(c) -> Column:
    """Display form with Persian digits."""
    return F.translate(sanitize_bidi(c), "0123456789", PERSIAN_DISPLAY_DIGITS)


def safe_truncate(c, limit: int) -> Column:
    """Display text cut to ``limit`` characters, the last one an ellipsis when cut."""
    if limit <= 0:
        return F.lit("")
    s = fa_digits(c)
    cut = F.regexp_replace(F.substring(s, 1, limit - 1), r"\p{M}+$", "")
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(cut, F.lit("…")))


def soft_text(c) -> Column:
    """Mild folding that keeps punctuation: letters, digits, marks, blanks."""
    s = F.regexp_replace(sanitize_bidi(c), r"\p{M}+", "")
    s = F.translate(
        s,
        ARABIC_LETTERS + FOREIGN_DIGITS + "\u2212\u066b\u00a0",
        PERSIAN_LETTERS + ASCII_DIGITS + "-. ",
    )
    s = F.regexp_replace(s, ALLAH, "ل")
    return F.trim(F.regexp_replace(s, "[\\s\u200c]+", " "))


def ascii_digit_text(c) -> Column:
    """Text with ASCII digits and collapsed blanks."""
    s = F.translate(sanitize_bidi(c), FOREIGN_DIGITS, ASCII_DIGITS)
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def strip_school_separators(c) -> Column:
    return F.translate(as_col(c), SCHOOL_SEPARATORS + KASHIDA, " " * len(SCHOOL_SEPARATORS))


def norm_header(name: str) -> str:
    """Header text on the driver (names only, never data)."""
    text = str(name or "").strip().replace("\u200c", "")
    text = text.translate(str.maketrans(FOREIGN_DIGITS + "يك", ASCII_DIGITS + "یک"))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(text.replace("_", " ").split())
