"""Column expressions that read a value as a number, a moment, a truth value or a label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for no value in delimited files.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Words that make a column of at most two values boolean, and those of them that are true.
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "y", "n", "evet", "hayır", "hayir", "0", "1")
TRUE_TOKENS = ("true", "yes", "y", "1", "evet")
#: Forms of dates, tried in this order; month before day where both fit.
MOMENT_FORMS = (
    "M/d/yyyy", "d/M/yyyy", "M/d/yyyy H:mm", "d/M/yyyy H:mm", "M/d/yyyy H:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM", "yyyyMMdd", "yyyy/MM/dd",
    "yyyy/MM/dd HH:mm:ss", "M-d-yyyy", "d-M-yyyy", "d.M.yyyy",
)
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_QUARTER = r"^(\d{4})-?Q([1-4])$"
#: Years of more digits are none (Spark reads "12345" as one), and bare numbers only if they lie within these.
_LONG_YEAR, _BARE, YEARS = r"^[+-]?\d{5,}", r"^\d{4}$", ("1677", "2262")
_TIME_ONLY = r"^\s*\d{1,2}:\d{2}(:\d{2})?\s*$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of exactly that name, dots and back ticks included."""
    return F.col(quoted(name))


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def parsed_number(c: Column, kind: T.DataType) -> Column:
    """The value as a double, infinities included; null where it can't be read as a number."""
    if is_number(kind):
        x = c.cast("double")
        return F.when(F.isnan(x), F.lit(None)).otherwise(x)
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(None).cast("double")
    text = c.cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double")).when(
        text.rlike(_INFINITE), F.when(F.trim(text).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    )


def num(c: Column, kind: T.DataType) -> Column:
    """The value as a finite double, or null."""
    x = parsed_number(c, kind)
    return F.when(F.abs(x) != float("inf"), x)


def moment(c: Column, kind: T.DataType) -> Column:
    """The value as a moment without zone. Whole numbers are nanoseconds since 1970; a time of day alone is none."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if is_number(kind):
        return F.timestamp_micros(F.floor(c / 1000)).cast("timestamp_ntz")
    text = F.trim(c.cast("string"))
    is_read = ~text.rlike(_LONG_YEAR) & (~text.rlike(_BARE) | text.between(*YEARS))
    tries = [F.when(is_read, text.try_cast("timestamp_ntz")), *(F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz") for form in MOMENT_FORMS)]
    quarter = F.make_timestamp_ntz(
        F.regexp_extract(text, _QUARTER, 1).try_cast("int"), (F.regexp_extract(text, _QUARTER, 2).try_cast("int") - 1) * 3 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0)
    )
    return F.when(text.rlike(_TIME_ONLY), F.lit(None)).when(text.rlike(_QUARTER), quarter).otherwise(F.coalesce(*tries))


def label(c: Column, kind: T.DataType) -> Column:
    """The value as text, numbers in their shortest form: 1e7 is 10000000.0, 1e16 is 1e+16."""
    text = c.cast("string")
    if isinstance(kind, T.BooleanType):
        return F.initcap(text)
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return text
    plain = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"(\.\d*?[1-9])0+$|(\.0)0+$", "$1$2")
    parts = F.split(text, "E")
    power = parts[1].try_cast("int")
    short = F.concat(F.regexp_replace(parts[0], r"\.0$", ""), F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    size = F.abs(c)
    return F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)


def truth(c: Column, kind: T.DataType) -> Column:
    return F.lower(F.trim(label(c, kind))).isin(*TRUE_TOKENS)


def none_missing(c: Column, kind: T.DataType) -> Column:
    """One kind of missing: NaN is null too."""
    return F.when(~F.isnan(c), c) if isinstance(kind, (T.DoubleType, T.FloatType)) else c


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
