"""Python value semantics as Spark columns.

Raw rows come from files, whose missing cells are NaN, or from JSON, whose missing values are None; any column may be absent
and may have any type. Raw gives every column the value that Python code would see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space of str.strip().
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: How a missing cell reads as text, by the origin of the rows.
MISSING = {"file": "nan", "json": "None"}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """float(text), or null. Java alone takes a letter after the digits (1d, 1f) as a number."""
    return F.when(~c.cast("string").rlike(r"[\d.][dfDF]\s*$"), c.try_cast("double"))


def whole(c: Column) -> Column:
    """int(text), or null."""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.btrim(c, F.lit(SPACES)).try_cast("bigint"))


def either(a: Column, b: Column) -> Column:
    """Python's `a or b` for texts."""
    return F.when(a.isNull() | (a == ""), b).otherwise(a)


def float_text(c: Column) -> Column:
    """repr of a float: plain from 1e-4 up to 1e16, else with an exponent of two digits at least."""
    java = c.cast("string")
    plain = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d+?)0*$", "$1")
    mantissa = F.regexp_replace(F.regexp_extract(java, r"^(-?[\d.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.abs(power).cast("string")
    exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.lpad(digits, F.greatest(F.lit(2), F.length(digits)), F.lit("0")))
    size = F.abs(c)
    return (
        F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(~java.contains("E"), java)
        .when((size >= 1e16) | (size < 1e-4), F.concat(mantissa, F.lit("e"), exponent)).otherwise(plain)
    )


class Raw:
    """Raw columns as Python would read them: row.get(name), whatever the column's type, or its absence."""

    def __init__(self, df: DataFrame, origin: str = "file") -> None:
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.origin, self.missing = origin, MISSING[origin]

    def __contains__(self, name: str) -> bool:
        return name in self.types

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def is_text(self, name: str) -> bool:
        return isinstance(self.types[name], T.StringType)

    def is_number(self, name: str) -> bool:
        return isinstance(self.types[name], T.NumericType)

    def shown(self, name: str, absent: str = "") -> Column:
        """str(value)."""
        if name not in self:
            return F.lit(absent)
        c, kind = self.column(name), self.types[name]
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            c = float_text(c.cast("double"))
        elif isinstance(kind, T.BooleanType):
            c = F.when(c, "True").when(~c, "False")
        elif not self.is_text(name):
            c = c.cast("string")
        return F.coalesce(c, F.lit(self.missing))

    def text(self, name: str, absent: str = "") -> Column:
        """str(value).strip()."""
        return strip(self.shown(name, absent))

    def number(self, name: str) -> Column:
        """float(value); null where that fails or the value is None."""
        if name not in self:
            return F.lit(None).cast("double")
        c = self.column(name)
        value = number(c) if self.is_text(name) else c.try_cast("double")
        return F.when(c.isNull(), F.lit(float("nan"))).otherwise(value) if self.origin == "file" else value

    def truthy(self, name: str) -> Column:
        """bool(value): a missing cell of a file is NaN, which is true."""
        if name not in self:
            return F.lit(False)
        c = self.column(name)
        filled = (c != "") if self.is_text(name) else (c != 0) if self.is_number(name) else c.isNotNull()
        return F.coalesce(filled, F.lit(self.origin == "file"))

    def either(self, first: str, second: str, absent: str) -> Column:
        """str(row.get(first) or row.get(second, absent))."""
        return F.when(self.truthy(first), self.shown(first)).otherwise(self.shown(second, absent))

    def whole(self, name: str) -> Column:
        """int(value); null where that fails or the value is None."""
        if name not in self:
            return F.lit(None).cast("bigint")
        c = self.column(name)
        return whole(c) if self.is_text(name) else c.try_cast("bigint")

    def count(self, name: str) -> Column:
        """int(value or 0); null where that fails."""
        if name not in self:
            return F.lit(0).cast("bigint")
        return F.when(~self.truthy(name), F.lit(0).cast("bigint")).otherwise(self.whole(name))
