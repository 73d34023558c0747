"""Column expressions (scalar functions) used across the engine.

All of them are built-in Spark SQL expressions, so they run inside
whole-stage code generation; none needs a Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label tables of the listing data model.
FURNISHING_LABELS = {0: "unfurnished", 1: "semi-furnished", 2: "furnished"}
FURNISHING_CODES = {"unfurnished": 0, "semi-furnished": 1, "furnished": 2}
AGE_CODES = {"Under Construction": 0, "New Property": 1, "Relatively New": 2,
             "Moderately Old": 3, "Old Property": 4}
BALCONY_ORDER = ["0", "1", "2", "3", "3+"]
BALCONY_CODES = {"0": 0, "1": 1, "2": 2, "3": 3, "3+": 4}
MISSING_CODE = -1.0
# Tokens pandas reads as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null")
# Markers of the similarly named city in Maharashtra.
CONTAMINATION_MARKERS = ("amravati", "maharashtra", "vidarbha")
STALENESS_DAYS = 183

_NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
# Patterns of ranges and of leading numbers.
_RANGE_RE = r"^\s*(\d+\.?\d*|\.\d+)\s*-\s*(\d+\.?\d*|\.\d+)\s*$"
_LEADING_RE = r"^\s*(\d+(?:\.\d+)?)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def na_to_null(x) -> Column:
    """Map pandas' default missing-value tokens (after trimming) to NULL."""
    col = _c(x)
    return F.when(F.trim(col).isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(col)


def parse_numeric(x) -> Column:
    """Text -> DOUBLE, unreadable -> NULL (FN-1). Strict decimal syntax."""
    text = F.trim(_c(x).cast("string"))
    return F.when(text.rlike(_NUMBER_RE), text.try_cast("double"))


def parse_numeric_or_range(x) -> Column:
    """A number, or ``"lo - hi"`` -> the midpoint; anything else NULL (FN-2)."""
    text = _c(x).cast("string")
    # the pattern's groups are numbers already; without a match they are empty, which is no number
    lo, hi = (F.regexp_extract(text, _RANGE_RE, i).try_cast("double") for i in (1, 2))
    return F.coalesce(parse_numeric(text), (lo + hi) / 2.0)


def parse_leading_number(x) -> Column:
    """Leading count of a size label: ``"3 BHK"`` -> 3, junk -> NULL (FN-3)."""
    return F.nullif(F.regexp_extract(_c(x).cast("string"), _LEADING_RE, 1), F.lit("")).try_cast("double")


def balcony_label(x) -> Column:
    """Number n -> ``"3+"`` when n >= 3 else its integer text; a valid label
    passes through; anything else NULL (FN-4)."""
    n = parse_numeric(x)
    text = F.trim(_c(x).cast("string"))
    return F.coalesce(F.when(n >= 3, F.lit("3+")).otherwise(n.cast("int").cast("string")),
                      F.when(text.isin(*BALCONY_ORDER), text))


def normalise_locality(x) -> Column:
    """Trim (any whitespace), collapse inner whitespace, lower-case (FN-6)."""
    col = _c(x).cast("string")
    return F.lower(F.regexp_replace(F.regexp_replace(col, r"^\s+|\s+$", ""), r"\s+", " "))


def label_furnishing(x) -> Column:
    """Raw code 0/1/2 -> label; anything else NULL (FN-7)."""
    col = _c(x)
    out = F.lit(None).cast("string")
    for code, label in FURNISHING_LABELS.items():
        out = F.when(col == code, F.lit(label)).otherwise(out)
    return out


def age_undefined_to_null(x) -> Column:
    """``'Undefined'`` is a placeholder, not a possession status (FN-8)."""
    return F.nullif(_c(x), F.lit("Undefined"))


def balcony_ordered(x) -> Column:
    """Keep only the ordered balcony categories (FN-9)."""
    col = _c(x).cast("string")
    return F.when(col.isin(*BALCONY_ORDER), col)


def _code(x, codes: Mapping[str, int]) -> Column:
    col = _c(x).cast("string")
    out = F.lit(None).cast("double")
    for label, code in codes.items():
        out = F.when(col == label, F.lit(float(code))).otherwise(out)
    return out


def furnishing_code(x) -> Column:
    """Label -> 0/1/2; NULL stays NULL (FN-10)."""
    return _code(x, FURNISHING_CODES)


def age_code(x) -> Column:
    """Possession label -> 0..4, else -1 (FN-11)."""
    return F.coalesce(_code(x, AGE_CODES), F.lit(MISSING_CODE))


def balcony_code(x) -> Column:
    """Balcony label -> 0..4, else -1 (FN-12)."""
    return F.coalesce(_code(x, BALCONY_CODES), F.lit(MISSING_CODE))


def is_house(x) -> Column:
    """1.0 for a house, 0.0 otherwise (NULL type counts as not a house) (FN-13)."""
    return F.coalesce(_c(x) == F.lit("house"), F.lit(False)).cast("double")


def numeric_or_missing(x) -> Column:
    """Coerce to a number, blank or unreadable -> -1 (FN-14)."""
    col = _c(x)
    return F.coalesce(parse_numeric(col), F.lit(MISSING_CODE))


def log_target(x) -> Column:
    """Model target: natural log of the price in crore (FN-15)."""
    return F.log(_c(x))


def residual_log(pred, actual) -> Column:
    """``ln(pred) - ln(actual)`` (FN-16)."""
    return F.log(_c(pred)) - F.log(_c(actual))


def band_low(price, q90) -> Column:
    """Low end of the band: price x exp(-q90) (FN-17; sign flip on purpose)."""
    return _c(price) * F.exp(-_c(q90))


def band_high(price, q10) -> Column:
    """High end of the band: price x exp(-q10) (FN-17)."""
    return _c(price) * F.exp(-_c(q10))


def contamination_flag(x, markers: Iterable[str] = CONTAMINATION_MARKERS) -> Column:
    """True when the lower-cased text contains one of ``markers`` (FN-19)."""
    low = F.lower(_c(x))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return F.when(_c(x).isNull(), F.lit(False)).otherwise(out)


def is_stale(last_updated, as_of, days: int = STALENESS_DAYS) -> Column:
    """Age in days strictly above ``days`` (FN-20)."""
    return F.datediff(_c(as_of), _c(last_updated)) > days


def ppsf(price_cr, area_sqft) -> Column:
    """Rupees per sq.ft. from a crore price; NULL for zero area (MAP-5)."""
    return F.try_divide(_c(price_cr) * 1e7, _c(area_sqft))
