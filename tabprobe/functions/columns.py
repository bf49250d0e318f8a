"""Column helpers: quoting, type classes, NULL/NaN normalisation, safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> str:
    """Backtick-quote a column name so names with dots or spaces work."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_bool(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric (and boolean, as 0/1) columns, the reference's ``select_dtypes(number)``."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def as_double(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into NULL (pandas skips NaN, Spark does not)."""
    dt = dtype_of(df, name)
    col = c(name)
    if is_bool(dt):
        return col.cast("double")
    col = col.cast("double")
    if is_float(dt) or isinstance(dt, T.DecimalType):
        return F.nanvl(col, F.lit(None).cast("double"))
    return col


def as_label(df: DataFrame, name: str) -> Column:
    """The column as a string label the way pandas prints it (True/False for booleans)."""
    dt = dtype_of(df, name)
    col = c(name)
    if is_bool(dt):
        return F.when(col, F.lit("True")).when(~col, F.lit("False"))
    if is_float(dt):
        return F.when(~F.isnan(col), col.cast("string"))
    return col.cast("string")


def normalise_nulls(df: DataFrame) -> DataFrame:
    """NaN → NULL in every floating column, once, at ingest."""
    exprs = {}
    for f in df.schema.fields:
        if is_float(f.dataType):
            exprs[f.name] = F.nanvl(c(f.name), F.lit(None).cast(f.dataType))
    return df.withColumns(exprs) if exprs else df


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (never raises under ANSI)."""
    return F.try_divide(a, b)


def rnd(col: Column, digits: int) -> Column:
    """Round a double as ``round(x·10^d)/10^d`` (the same steps DuckDB takes, so ties agree)."""
    m = float(10 ** digits)
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("double") * m) / m


def r4(col: Column, digits: int = 4) -> Column:
    return rnd(col, digits)
