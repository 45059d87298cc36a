"""Type classes, missing values, ratios and text forms of values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def type_class(data_type: T.DataType) -> str:
    """boolean, integer, float, numeric, datetime, string or object."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, INTEGRAL):
        return "integer"
    if isinstance(data_type, FLOATING):
        return "float"
    if isinstance(data_type, T.DecimalType):
        return "numeric"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "object"


def quoted(name: str) -> Column:
    """The column of that literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_name(taken: Iterable[str], base: str) -> str:
    """A column name for internal use that none of `taken` has, letter case aside."""
    low = {t.lower() for t in taken}
    name, n = f"__{base}", 0
    while name.lower() in low:
        n += 1
        name = f"__{base}_{n}"
    return name


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN counted as missing."""
    column = quoted(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(column), column)
    return column


def comparable(df: DataFrame, name: str) -> Column:
    """A form of the column that can be grouped and hashed: nested values become JSON."""
    data_type = df.schema[name].dataType
    column = present(df, name)
    if isinstance(data_type, T.BinaryType):
        return F.base64(column)
    if type_class(data_type) == "object":
        if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            return F.to_json(column)
        return column.cast("string")
    return column


def iso_text(column: Column) -> Column:
    """ISO text of a date or timestamp; fractions only when there are any."""
    stamp = column.cast("timestamp_ntz")
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")
    exact = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(stamp == F.date_trunc("second", stamp.cast("timestamp")).cast("timestamp_ntz"), whole).otherwise(exact)


def value_text(column: Column, data_type: T.DataType) -> Column:
    """How a value appears in a report."""
    if isinstance(data_type, TEMPORAL):
        return iso_text(column)
    return column.cast("string")


def number(column: Column, data_type: T.DataType) -> Column:
    """The column as double for summaries; booleans count as 0 and 1."""
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("double")
    return column.cast("double")


def finite(column: Column) -> Column:
    """Infinities become null, as a JSON report cannot hold them."""
    return F.when(F.abs(column) != float("inf"), column)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to six digits, half to even; 0.0 over nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        F.bround(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"), 6)
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        field.name
        for field in df.schema.fields
        if type_class(field.dataType) in ("integer", "float", "numeric")
    ]
