"""Column functions: NULL-safe arithmetic, tolerant parsing, cleaning. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(n: str | Column, d: str | Column) -> Column:
    """n / d as double; NULL where d is 0 or either is NULL, also in ANSI mode."""
    return F.try_divide(_c(n).cast("double"), _c(d).cast("double"))


def round_to(x: str | Column, digits: int) -> Column:
    """Half-up rounding of a double.

    It goes by way of a decimal of 12 places, so that a tie counts as one whatever the order in which its sums were made;
    numbers too large for that have no places to round.
    """
    c = _c(x).cast("double")
    return F.coalesce(F.round(c.try_cast("decimal(38,12)"), digits).cast("double"), F.round(c, digits))


def finite(x: str | Column) -> Column:
    """NaN and infinities as NULL."""
    c = _c(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def sanitize(df: DataFrame) -> DataFrame:
    """finite() on every floating column, in one projection."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[finite(f.name).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name) for f in df.schema])


def lenient_double(x: str | Column) -> Column:
    """Number of a text with blanks around it; NULL for anything else."""
    return F.trim(_c(x)).try_cast("double")


def decimal_comma(x: str | Column) -> Column:
    """"9,43" as 9.43."""
    return F.replace(_c(x), F.lit(","), F.lit(".")).try_cast("double")


def compass(x: str | Column) -> Column:
    """"5.63S" as -5.63: south and west are negative."""
    c = _c(x)
    number = F.regexp_replace(c, "[NSEW]", "").try_cast("double")
    return F.when(c.endswith("S") | c.endswith("W"), -number).otherwise(number)


def decade(year: str | Column) -> Column:
    return (F.floor(_c(year) / 10) * 10).cast("int")


def year_of(text: str | Column) -> Column:
    return F.substring(_c(text), 1, 4).try_cast("int")


def looked_up(x: str | Column, table: dict[str, str]) -> Column:
    """Value of a literal map; NULL for a missing key."""
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[_c(x)]


def category(x: str | Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that the text matches, else NULL: rules are (pattern, name)."""
    c, out = _c(x), F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def unquoted(x: str | Column) -> Column:
    return F.trim(F.replace(_c(x), F.lit('"'), F.lit("")))


def clean_name(x: str | Column) -> Column:
    """Blanks and quotes off, damage marks out, empty text as NULL."""
    return F.nullif(F.trim(F.translate(_c(x), '"?', "")), F.lit(""))
