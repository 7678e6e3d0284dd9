"""Column expressions: string cleaning, parsing, dates, missing-value rules.

Everything here returns a ``Column`` (JVM-side, codegen friendly); nothing
runs per row in Python. Missing-value conventions follow the reference's
language: NaN counts as missing, a failed parse becomes missing, a missing
condition yields a missing result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str

# Fixed value: label used for a missing category level.
UNKNOWN_LEVEL = "Unknown"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- type selection

def columns_of_type(df: DataFrame, kind: str, exclude: Iterable[str] = ()) -> list[str]:
    """Names of columns of one type family: numeric, string, boolean, date, fractional."""
    families = {
        "numeric": NUMERIC_TYPES,
        "fractional": FRACTIONAL_TYPES,
        "string": (T.StringType,),
        "boolean": (T.BooleanType,),
        "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    }
    wanted = families[kind]
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, wanted) and f.name not in skip]


def is_fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FRACTIONAL_TYPES)


# ---------------------------------------------------------------- missing values

def is_missing(c: ColumnOrName, fractional: bool = True) -> Column:
    """Null, or NaN for floating columns; never null itself."""
    col = _c(c)
    return (col.isNull() | F.isnan(col)) if fractional else col.isNull()


def nan_to_null(c: ColumnOrName) -> Column:
    col = _c(c)
    return F.when(~F.isnan(col), col)


def zero_as_missing(c: ColumnOrName) -> Column:
    """0 means 'unknown' in the survey data (amounts, construction year)."""
    return F.nullif(_c(c), F.lit(0))


def standardize_missing(c: ColumnOrName) -> Column:
    """Trim all surrounding whitespace; an empty string becomes missing."""
    return F.nullif(r_trim(c), F.lit(""))


def unknown_level(c: ColumnOrName, level: str = UNKNOWN_LEVEL) -> Column:
    return F.coalesce(_c(c), F.lit(level))


def guarded_when(cond: Column, then: Column, otherwise: Column) -> Column:
    """if_else with the reference's rule: a missing condition gives a missing value."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, then).otherwise(otherwise)


# ---------------------------------------------------------------- strings

def r_trim(c: ColumnOrName) -> Column:
    """Trim every kind of leading/trailing whitespace (not only blanks)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def clean_string(c: ColumnOrName) -> Column:
    """lower-case and trim."""
    return F.lower(r_trim(c))


def squish(c: ColumnOrName) -> Column:
    """Trim and collapse inner runs of whitespace to one blank."""
    return r_trim(F.regexp_replace(_c(c), r"\s+", " "))


def concat_with_na(sep: str, *cols: ColumnOrName) -> Column:
    """paste(): a missing part is written as NA."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("NA")) for c in cols])


def slug(c: ColumnOrName) -> Column:
    """File-name form of a region name: lower case, blanks to underscores."""
    return F.regexp_replace(F.lower(_c(c)), " ", "_")


# ---------------------------------------------------------------- parsing and dates

def safe_numeric(c: ColumnOrName) -> Column:
    """as.numeric: text that is not a number becomes missing (no exception under ANSI)."""
    return _c(c).try_cast("double")


def safe_boolean(c: ColumnOrName) -> Column:
    return _c(c).try_cast("boolean")


def parse_date(c: ColumnOrName, fmt: str = "yyyy-MM-dd") -> Column:
    """ymd(): impossible dates (2013-02-31) and blanks become missing."""
    return F.try_to_date(_c(c).cast("string"), fmt)


def as_date(df: DataFrame, name: str) -> Column:
    """Date value of a column that may be text, timestamp or date."""
    dt = df.schema[name].dataType
    if isinstance(dt, T.DateType):
        return F.col(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(F.col(name))
    return parse_date(name)


def age_years(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """Difference of two dates in days divided by 365.25."""
    return F.datediff(_c(later), _c(earlier)).cast("double") / F.lit(365.25)


def year_at_least(d: ColumnOrName, year: int) -> Column:
    """year(d) >= y written as a range so the scan can push it down."""
    return _c(d) >= F.make_date(F.lit(year), F.lit(1), F.lit(1))


def date_label(c: ColumnOrName, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(_c(c), fmt)


# ---------------------------------------------------------------- names

def snake_case(name: str) -> str:
    """clean_names() rule: ASCII snake case, camelCase split, symbols to '_'."""
    s = name.strip()
    s = s.replace("%", "_percent_").replace("#", "_number_")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake case; repeated names get _2, _3 ... suffixes."""
    seen: dict[str, int] = {}
    out = []
    for name in df.columns:
        base = snake_case(name)
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return df.toDF(*out)
