"""Typed values: Columns with the type and number of what they hold.

A value is one or many: many is an ARRAY without nulls.  SQL NULL is missing.
A value may be a row, with a value for each field, so that a field is a plain
column and the scan reads no other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathframe.errors import EvalError

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DOUBLE, STRING, BOOLEAN = T.DoubleType(), T.StringType(), T.BooleanType()


class Unsupported(Exception):
    """The expression needs another tier."""


@dataclass
class Val:
    """``col`` of ``dtype`` (of each, if many); or a row of ``fields``; or a function at compile time."""

    col: Column | None = None
    dtype: T.DataType | None = None
    many: bool = False
    fields: dict[str, Val] | None = None
    const: Any = None
    is_const: bool = False
    fn: Any = None
    #: A row read in a lambda or a table: what the parent of its items is.
    extra: dict = field(default_factory=dict)

    @property
    def missing(self) -> bool:
        return self.col is None and self.fields is None and self.fn is None and not self.is_const

    @property
    def number(self) -> bool:
        return not self.many and isinstance(self.dtype, NUMERIC)

    @property
    def string(self) -> bool:
        return not self.many and isinstance(self.dtype, T.StringType)

    @property
    def boolean(self) -> bool:
        return not self.many and isinstance(self.dtype, T.BooleanType)

    def as_column(self) -> Column:
        if self.fields is not None:
            return F.struct(*[v.as_column().alias(k) for k, v in self.fields.items()])
        if self.col is None:
            if self.fn is not None:
                raise Unsupported("a function is not a column")
            return F.lit(None)
        return self.col

    def double(self) -> Column:
        return self.col if isinstance(self.dtype, T.DoubleType) else self.col.cast("double")


MISSING = Val()


def constant(v: Any) -> Val:
    if v is None:
        return Val(F.lit(None), T.NullType(), const=None, is_const=True)
    dtype = BOOLEAN if isinstance(v, bool) else DOUBLE if isinstance(v, float) else STRING
    return Val(F.lit(v), dtype, const=v, is_const=True)


def raised(code: str, dtype: T.DataType) -> Column:
    """An expression that fails with the code when a row reaches it."""
    return F.raise_error(F.lit(code)).cast(dtype)


def from_column(col: Column, dtype: T.DataType) -> Val:
    """A column as it comes from a schema: arrays are many, structs have fields."""
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if dtype.containsNull:
            col = F.filter(col, lambda x: x.isNotNull())
        return Val(col, inner, True)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        utc = col if isinstance(dtype, T.TimestampType) else F.call_function("from_utc_timestamp", col.cast("timestamp"), F.lit("UTC"))
        return Val(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), STRING, extra={"timestamp": utc})
    if isinstance(dtype, T.DateType):
        return Val(col.cast("string"), STRING)
    return Val(col, dtype)


def field_of(v: Val, name: str) -> Val:
    """A field step."""
    if v.fields is not None:
        return v.fields.get(name, MISSING)
    if v.col is None:
        return MISSING
    if isinstance(v.dtype, T.StructType):
        if name not in v.dtype.names:
            return MISSING
        inner = v.dtype[name].dataType
        if not v.many:
            return from_column(v.col.getField(name), inner)
        if isinstance(inner, T.ArrayType):
            lists = F.filter(F.transform(v.col, lambda x: x.getField(name)), lambda x: x.isNotNull())
            return Val(F.filter(F.flatten(lists), lambda x: x.isNotNull()), inner.elementType, True, extra={"found": True})
        got = from_column(F.lit(None), inner)
        if got.dtype != inner:
            raise Unsupported("timestamps in arrays")
        return Val(F.filter(F.transform(v.col, lambda x: x.getField(name)), lambda x: x.isNotNull()), inner, True, extra={"found": True})
    if isinstance(v.dtype, T.MapType) and not v.many:
        return from_column(F.try_element_at(v.col, F.lit(name)), v.dtype.valueType)
    return MISSING


def one(v: Val) -> Column:
    """A single value of many, as it collapses: only sound where it can't be seen that more are there."""
    return F.try_element_at(v.col, F.lit(1)) if v.many else v.col


def truthy(v: Val) -> Column:
    """Never null."""
    if v.missing:
        return F.lit(False)
    if v.is_const and v.const is None:
        return F.lit(False)
    if v.fn is not None:
        return F.lit(False)
    if v.fields is not None:
        return F.lit(bool(v.fields))
    if v.many:
        inner = v.dtype
        return F.coalesce(F.exists(v.col, lambda x: truthy(Val(x, inner))), F.lit(False))
    if isinstance(v.dtype, T.BooleanType):
        return F.coalesce(v.col, F.lit(False))
    if isinstance(v.dtype, T.StringType):
        return F.coalesce(v.col != "", F.lit(False))
    if isinstance(v.dtype, NUMERIC):
        return F.coalesce(v.col != 0, F.lit(False))
    if isinstance(v.dtype, T.MapType):
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


def number_text(x: Column) -> Column:
    """A double as text: whole numbers without a point, others with 15 digits."""
    whole = x.cast("decimal(38,0)").cast("string")
    short = F.format_string("%.14e", x).cast("double")
    text = short.cast("string")
    plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    small = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E-", "e-")
    return (
        F.when((x == F.floor(x)) & (F.abs(x) < 1e21), whole)
        .when(F.abs(x) < 1e-6, small)
        .when(F.abs(x) < 1e17, plain)
        .otherwise(F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), "E", "e+"))
    )


def text_of(v: Val) -> Column:
    """``$string`` of a scalar, null where missing."""
    if v.many:
        raise Unsupported("text of an array")
    if v.string:
        return v.col
    if v.boolean:
        return v.col.cast("string")
    if v.number:
        if isinstance(v.dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return v.col.cast("string")
        return number_text(v.double())
    if v.is_const and v.const is None:
        return F.lit("null")
    raise Unsupported("text of an object")


def kind(v: Val) -> str:
    if v.many:
        return "array"
    if v.fields is not None or isinstance(v.dtype, (T.StructType, T.MapType)):
        return "object"
    if v.number:
        return "number"
    if v.string:
        return "string"
    if v.boolean:
        return "boolean"
    if v.is_const and v.const is None:
        return "null"
    if v.fn is not None:
        return "function"
    return "missing"


def need_number(v: Val, code: str) -> Column:
    """The value as a double; a static type error is an error now."""
    if v.missing:
        return F.lit(None).cast("double")
    if v.many:
        raise Unsupported("a number is needed, an array is given")
    if not v.number:
        raise EvalError(code, kind(v))
    return v.double()


Builder = Callable[..., Val]
