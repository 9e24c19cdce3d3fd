"""How the type of a stored column may change: a lattice of types that lose nothing.

Readers of Parquet widen some physical types by themselves (``read_as``); for the others the files
of the old type are kept apart and cast when read (see :mod:`haze.operators.history`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_FLOATS = [T.FloatType(), T.DoubleType()]
_TEXT = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType,
         T.TimestampNTZType)


class TypeChange(ValueError):
    """A batch's column cannot be stored beside what the table holds."""


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds every value of both: the wider integer; double for float and
    double, and for integers of at most 32 bits with either; the wider decimal; else text.  An
    array, map or struct joins only its own type."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _INTS and b in _INTS:
        return max(a, b, key=_INTS.index)
    if {a, b} <= {*_INTS[:3], *_FLOATS}:
        return T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        digits = max(a.precision - a.scale, b.precision - b.scale) + scale
        if digits <= 38:
            return T.DecimalType(digits, scale)
    if isinstance(a, _TEXT) and isinstance(b, _TEXT):
        return T.StringType()
    raise TypeChange(f"{a.simpleString()} and {b.simpleString()} have no common type")


def read_as(stored: T.DataType, wanted: T.DataType) -> bool:
    """Can files of ``stored`` be read as ``wanted`` directly?"""
    if stored == wanted:
        return True
    if stored in _INTS and wanted in _INTS:
        return _INTS.index(stored) <= _INTS.index(wanted)
    return wanted == T.DoubleType() and stored in [*_INTS[:3], T.FloatType()]


def merged_schema(stored: T.StructType, batch: T.StructType) -> T.StructType:
    """The columns of both, each with a type that holds both sides' values; the batch's new columns
    come last.  Column names are compared as they are."""
    new = {f.name: f.dataType for f in batch.fields}
    out = []
    for f in stored.fields:
        try:
            out.append(T.StructField(f.name, wider(f.dataType, new.pop(f.name, f.dataType)), True))
        except TypeChange as e:
            raise TypeChange(f"column {f.name}: {e}") from None
    # a column of nothing but nulls has no type to record yet
    return T.StructType(out + [T.StructField(n, t, True) for n, t in new.items()
                               if not isinstance(t, T.NullType)])


def cast_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with its columns cast to the types of ``schema``; columns without one there go."""
    types = {f.name: f.dataType for f in schema.fields}

    def cell(f: T.StructField) -> Column:
        col = F.col(f"`{f.name}`")
        return col if f.dataType == types[f.name] else col.cast(types[f.name]).alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields if f.name in types])
