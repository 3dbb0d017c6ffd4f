"""Scalar text functions (Column -> Column), all JVM-side expressions.

Python's ``str.strip()`` / ``str.split()`` treat 29 code points as
whitespace; Spark's ``trim`` removes only U+0020, so the Python set is
spelled out as a regex character class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Python whitespace set (str.isspace) as a Java/RE2 class.
PY_WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
PY_STRIP_RE = rf"^{PY_WS}+|{PY_WS}+\z"
PY_RSTRIP_RE = rf"{PY_WS}+\z"

# The default missing-value words of a pandas CSV read.
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Trailing punctuation removed by normalisation.
TRAIL_PUNCT_RE = r"[.,;!?]+\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` (Unicode whitespace, both ends)."""
    return F.regexp_replace(_c(c), PY_STRIP_RE, "")


def py_rstrip(c) -> Column:
    return F.regexp_replace(_c(c), PY_RSTRIP_RE, "")


def lower(c) -> Column:
    """C2."""
    return F.lower(_c(c))


def rstrip_punct(c) -> Column:
    """``rstrip('.,;!?')`` -- one pass, whitespace left in place."""
    return F.regexp_replace(_c(c), TRAIL_PUNCT_RE, "")


def na_to_null(c) -> Column:
    """A string cell that pandas would read as missing becomes null."""
    c = _c(c)
    return F.when(c.isin(NA_WORDS), F.lit(None).cast("string")).otherwise(c)


def cast_text(c, missing: str = "null") -> Column:
    """``astype(str)``; under ``missing='pandas'`` a null becomes 'nan'."""
    s = _c(c).cast("string")
    return F.coalesce(s, F.lit("nan")) if missing == "pandas" else s


def normalize_text(c, missing: str = "null") -> Column:
    """C4: str -> strip -> lower -> rstrip('.,;!?')."""
    return rstrip_punct(F.lower(py_strip(cast_text(c, missing))))


def char_length(c) -> Column:
    """Length in code points (Spark ``length`` counts code points)."""
    return F.length(_c(c))


def numeric_coerce(c) -> Column:
    """``to_numeric(errors='coerce')``: unparsable and NaN -> null; no type suffixes or hex floats."""
    v = _c(c).cast("string")
    plain = v.rlike(r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*$")
    d = F.when(plain, v.try_cast("double"))
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def null_to_zero(c) -> Column:
    """``fillna(0).astype(float)``."""
    return F.coalesce(_c(c).cast("double"), F.lit(0.0))


def unquote(c) -> Column:
    """Drop NUL and BOM, strip, remove one pair of enclosing quotes."""
    s = py_strip(F.regexp_replace(_c(c), "[\\x00\\x{FEFF}]", ""))
    quoted = s.startswith('"') & s.endswith('"') & (F.length(s) >= 2)
    return F.when(quoted, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)


def ws_tokens(c) -> Column:
    """Python ``str.split()`` -> array<string>."""
    return F.filter(F.split(_c(c), PY_WS + "+"), lambda x: x != "")


def basename(c) -> Column:
    """Last path component."""
    return F.regexp_extract(_c(c), r"[^/]+$", 0)


def stem_ext(c) -> Column:
    """``os.path.splitext`` -> struct(stem, ext); leading dots are no ext."""
    c = _c(c)
    ext = F.regexp_extract(c, r"(?:^|/)\.*[^/.][^/]*(\.[^./]*)$", 1)
    return F.struct(F.substring(c, F.lit(1), F.length(c) - F.length(ext)).alias("stem"),
                    ext.alias("ext"))


def clean_suffix_name(c, suffix: str = "_clean") -> Column:
    """K3: ``{base}{suffix}{ext}`` for a path or file name."""
    parts = stem_ext(c)
    return F.concat(parts["stem"], F.lit(suffix), parts["ext"])


def int_floor(c) -> Column:
    """Python ``int()`` of a non-negative double (floor)."""
    return F.floor(_c(c)).cast("long")


# --- 13a tokeniser (BLEU) -------------------------------------------------

# The 13a tokenizer's substitution rules, in order.
TOK13A_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]
# The 13a un-escape table, applied in this order.
TOK13A_UNESCAPE = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def _lit_replace(c: Column, a: str, b: str) -> Column:
    return F.replace(c, F.lit(a), F.lit(b))


def tokenize_13a(c) -> Column:
    """Hypothesis/reference tokens under BLEU's 13a rules (case kept)."""
    s = py_rstrip(_c(c))
    s = _lit_replace(s, "<skipped>", "")
    s = _lit_replace(s, "-\n", "")
    s = _lit_replace(s, "\n", " ")
    for a, b in TOK13A_UNESCAPE:
        s = _lit_replace(s, a, b)
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in TOK13A_RULES:
        s = F.regexp_replace(s, pat, rep)
    return ws_tokens(s)


def tokenize_ter(c) -> Column:
    """TER default tokens: lowercased, whitespace split."""
    return ws_tokens(F.lower(_c(c)))
