"""Column expressions for dissected text fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """Empty text is an absent value."""
    return F.when(c != "", c)


def first_of(c: Column) -> Column:
    """The first of a comma list."""
    return F.split(c, ",")[0]


def number(c: Column, kind: str = "double") -> Column:
    """The first value of a comma list as a number; null where it isn't one."""
    as_double = first_of(c).try_cast("double")
    finite = F.when(~F.isnan(as_double) & (F.abs(as_double) < F.lit(9e18)), as_double)
    return finite if kind == "double" else finite.cast("bigint").try_cast(kind)


def whole(c: Column, kind: str = "bigint") -> Column:
    """An integer text; exact beyond 2^53."""
    v = first_of(c)
    return F.coalesce(v.try_cast("bigint"), number(v, "bigint")).try_cast(kind)


def truthy(c: Column) -> Column:
    """Whether a comma list holds a true flag; null counts as false."""
    return F.coalesce(F.exists(F.split(c, ","), lambda t: t.isin("1", "true", "True", "TRUE")), F.lit(False))


def hex_number(c: Column) -> Column:
    return F.conv(F.regexp_replace(first_of(c), "^0[xX]", ""), 16, 10).try_cast("bigint")


def sum_of(c: Column) -> Column:
    """The sum of a comma list, what isn't a number counting as 0; null stays null."""
    return F.aggregate(F.split(c, ","), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(number(x, "bigint"), F.lit(0).cast("bigint")))


def ms(seconds: Column) -> Column:
    """Seconds to milliseconds with three decimals."""
    return F.round(seconds * 1000, 3)
