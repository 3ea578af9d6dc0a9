"""Values as text: for flat files, for result cells and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_JSON_OPTIONS = {"ignoreNullFields": "false"}


def _json(value: Column) -> Column:
    return F.to_json(value, _JSON_OPTIONS)


def quoted_name(name: str) -> str:
    """A column name in back quotes, for use in ``F.col``."""
    return "`" + name.replace("`", "``") + "`"


def field_column(field: T.StructField) -> Column:
    return F.col(quoted_name(field.name))


# ---------------------------------------------------------------- numbers


def _mantissa(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")


def _exponent(text: Column) -> Column:
    return F.substring_index(text, "E", -1).try_cast("int")


def _usual_or(value: Column, below: float, rare) -> Column:
    """A float's text, where it is plain in Spark too; ``rare`` writes all others.

    Most floats take one of the first two cases, which are cheap. The rare cases
    need long expressions; inside a lambda they stay out of the generated code,
    which a few columns of them would make too large to compile.
    """
    size = F.abs(value)
    whole = value.cast("double").try_cast("bigint")
    return (
        F.when((size < below) & (value == whole) & (size > 0), whole.cast("string"))
        .when((size >= 1e-3) & (size < below), value.cast("string"))
        .when(value.isNotNull(), F.get(F.transform(F.array(value), rare), F.lit(0)))
    )


def _flat_rare(value: Column) -> Column:
    text, size = value.cast("string"), F.abs(value)
    exponent = _exponent(text)
    written = F.concat(
        _mantissa(text),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exponent).cast("string"),
    )
    # Spark writes 1e-4 <= x < 1e-3 with an exponent and 1e6 <= x < 1e7 without one.
    small = F.concat(
        F.when(value < 0, F.lit("-")).otherwise(F.lit("")),
        F.lit("0.000"),
        F.regexp_replace(_mantissa(text), r"[-.]", ""),
    )
    digits = F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), r"^(-?\d)(\d*?)0*$", "$1.$2")
    million = F.concat(F.regexp_replace(digits, r"\.$", ""), F.lit("e+06"))
    return (
        F.when(size == 0, F.regexp_replace(text, r"\.0$", ""))
        .when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("+Inf"))
        .when(value == float("-inf"), F.lit("-Inf"))
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when((size >= 1e6) & (size < 1e7), million)
        .otherwise(written)
    )


def _shown_rare(value: Column) -> Column:
    text, size = value.cast("string"), F.abs(value)
    exponent = _exponent(text)

    def plain(scale: int) -> Column:
        return F.regexp_replace(text.try_cast(T.DecimalType(38, scale)).cast("string"), r"\.?0+$", "")

    written = F.concat(
        _mantissa(text), F.when(exponent < 0, F.lit("e")).otherwise(F.lit("e+")), exponent.cast("string")
    )
    return (
        F.when(size == 0, F.lit("0"))
        .when(F.isnan(value) | (size == float("inf")), text)
        .when((size >= 1e-6) & (size < 1e-3), plain(30))
        .when((size >= 1e7) & (size < 1e21), plain(10))
        .otherwise(written)
    )


def float_text(value: Column) -> Column:
    """A float in its shortest form: plain from 1e-4 to below 1e6, else ``d.ddde+dd``."""
    return _usual_or(value, 1e6, _flat_rare)


def script_number_text(value: Column) -> Column:
    """A float as a browser shows it: plain from 1e-6 to below 1e21, else ``d.ddde+d``."""
    return _usual_or(value, 1e7, _shown_rare)


# ---------------------------------------------------------------- times


def time_text(value: Column, data_type: T.DataType, fraction: bool) -> Column:
    """A date or time as RFC 3339; with ``fraction`` the part below a second is kept.

    Values without a zone are written as UTC, whatever the session's zone is.
    """
    if isinstance(data_type, T.DateType):
        return F.concat(value.cast("string"), F.lit("T00:00:00Z"))
    plain = F.replace(value.cast("string"), F.lit(" "), F.lit("T"))
    text = plain if fraction else F.substring_index(plain, ".", 1)
    if isinstance(data_type, T.TimestampNTZType):
        return F.concat(text, F.lit("Z"))
    return F.concat(text, F.date_format(value, "XXX"))


# ---------------------------------------------------------------- cells


def flat_text(value: Column, data_type: T.DataType) -> Column:
    """A value as the text of a delimited file; null stays null."""
    if isinstance(data_type, T.BinaryType):
        return F.base64(value)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return float_text(value)
    if isinstance(data_type, _TEMPORAL):
        return time_text(value, data_type, fraction=False)
    if isinstance(data_type, _NESTED):
        return _json(value)
    return value.cast("string")


def cell_text(value: Column, data_type: T.DataType) -> Column:
    """A value as a result cell shows it; null is the word ``null``."""
    if isinstance(data_type, T.BinaryType):
        text = F.base64(value)
    elif isinstance(data_type, (T.FloatType, T.DoubleType)):
        text = script_number_text(value)
    elif isinstance(data_type, _TEMPORAL):
        text = time_text(value, data_type, fraction=True)
    elif isinstance(data_type, _NESTED):
        text = _json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def json_ready(value: Column, data_type: T.DataType) -> Column:
    """A value prepared for a JSON writer: times and bytes become texts."""
    if isinstance(data_type, T.BinaryType):
        return F.base64(value)
    if isinstance(data_type, _TEMPORAL):
        return time_text(value, data_type, fraction=True)
    return value


def json_value(value: Column, data_type: T.DataType) -> Column:
    """A value as JSON text, ``null`` included."""
    text = value.cast("string")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        # JSON has no such numbers; as texts they still cast back.
        finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
        text = F.when(finite, text).when(value.isNotNull(), F.concat(F.lit('"'), text, F.lit('"')))
    elif isinstance(data_type, (*_TEMPORAL, T.BinaryType)):
        text = F.concat(F.lit('"'), json_ready(value, data_type), F.lit('"'))
    elif isinstance(data_type, _NESTED):
        text = _json(value)
    elif not isinstance(data_type, (T.NumericType, T.BooleanType)):
        wrapped = _json(F.array(text))
        text = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    return F.coalesce(text, F.lit("null"))


def json_list(df: DataFrame) -> Column:
    """A row of ``df`` as a JSON list, in column order."""
    values = F.concat_ws(",", *[json_value(field_column(f), f.dataType) for f in df.schema])
    return F.concat(F.lit("["), values, F.lit("]"))


def json_object(df: DataFrame) -> Column:
    """A row of ``df`` as a JSON object, in column order, nulls kept."""
    return _json(F.struct(*[json_ready(field_column(f), f.dataType).alias(f.name) for f in df.schema]))


def to_text(df: DataFrame) -> DataFrame:
    """Every column of ``df`` as flat text."""
    return df.select(*[flat_text(field_column(f), f.dataType).alias(f.name) for f in df.schema])


def render_cells(df: DataFrame) -> DataFrame:
    """Every column of ``df`` as its result cells show it."""
    return df.select(*[cell_text(field_column(f), f.dataType).alias(f.name) for f in df.schema])


# Type names whose columns are set flush left, besides those with "char".
LEFT_TYPES = ("string", "name", "text", "unknown")


def aligns_right(type_name: str) -> bool:
    """Whether a result column of that type is set flush right."""
    lowered = type_name.lower()
    return not ("char" in lowered or lowered in LEFT_TYPES)


def shown_length(text: Column) -> Column:
    """Length of a text in UTF-16 units, as a browser counts it."""
    units = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(units)


# ---------------------------------------------------------------- small ones


def base_name(path: Column) -> Column:
    """What follows the last ``/`` or ``\\`` of a path."""
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def duration_ms(nanoseconds: Column) -> Column:
    """Nanoseconds as whole milliseconds, rounded up, in whole numbers throughout."""
    missing = F.pmod(-nanoseconds, F.lit(1_000_000))
    return F.call_function("div", nanoseconds + missing, F.lit(1_000_000))


def duration_text(nanoseconds: Column, resolution_ms: int = 1) -> Column:
    """A duration for display; zero shows as below the clock's resolution."""
    shown = F.when(nanoseconds == 0, F.lit(f"<{resolution_ms}")).otherwise(duration_ms(nanoseconds).cast("string"))
    return F.concat(shown, F.lit(" ms"))
