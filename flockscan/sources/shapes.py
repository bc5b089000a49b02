"""One type for a field whose type differs between batches of records.

Types are joined where nothing is lost: whole numbers widen, structs are joined field by field,
arrays and maps by what they hold. Where no plain type holds both, as for a number and a
text, the field becomes a VARIANT, in which each value keeps its own type.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Digits that the whole types may have.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
VARIANT = T.VariantType()


def _joined_numbers(a: T.DataType, b: T.DataType) -> T.DataType:
    if isinstance(a, WHOLE) and isinstance(b, WHOLE):
        return max(a, b, key=lambda t: WHOLE.index(type(t)))
    floats = [t for t in (a, b) if isinstance(t, (T.FloatType, T.DoubleType))]
    if len(floats) == 2:
        return T.DoubleType()
    if floats:
        other = b if floats[0] is a else a
        # A double holds whole numbers of 32 bits; ids of 64 bits would lose digits.
        return T.DoubleType() if isinstance(other, WHOLE[:3]) else VARIANT
    own = [t if isinstance(t, T.DecimalType) else T.DecimalType(_DIGITS[type(t)], 0) for t in (a, b)]
    scale = max(t.scale for t in own)
    digits = max(t.precision - t.scale for t in own) + scale
    return T.DecimalType(digits, scale) if digits <= 38 else VARIANT


def joined_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both, a VARIANT if no plain one does."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StringType) and isinstance(b, T.StringType):
        return T.StringType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return _joined_numbers(a, b)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return T.StructType([T.StructField(n, k) for n, k in joined_fields([a, b])])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(joined_type(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, joined_type(a.valueType, b.valueType))
    kinds = {type(a), type(b)}
    for time in (T.TimestampType, T.TimestampNTZType):
        if kinds == {T.DateType, time}:
            return time()
    return VARIANT


def joined_fields(schemas: list[T.StructType]) -> list[tuple[str, T.DataType]]:
    """Names as first spelt, in order of appearance, with their joined types."""
    names, kinds = {}, {}
    for schema in schemas:
        for field in schema.fields:
            key = field.name.lower()
            names.setdefault(key, field.name)
            kinds[key] = joined_type(kinds.get(key, T.NullType()), field.dataType)
    return [(names[key], kinds[key]) for key in names]


def as_type(column: Column, kind: T.DataType, wanted: T.DataType) -> Column:
    """A column of a type as one of the joined type."""
    if kind == wanted:
        return column
    if isinstance(wanted, T.VariantType):
        if isinstance(kind, (T.StructType, T.ArrayType)):
            return F.to_variant_object(column)
        if isinstance(kind, T.MapType):
            text_keys = isinstance(kind.keyType, T.StringType)
            return F.to_variant_object(column) if text_keys else F.parse_json(F.to_json(column))
        return column.cast(wanted)
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*_fields_as(column.getField, kind, wanted)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: as_type(x, kind.elementType, wanted.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda _, x: as_type(x, kind.valueType, wanted.valueType))
    return column.cast(wanted)


def _fields_as(get, schema: T.StructType, wanted: T.StructType) -> list[Column]:
    own = {f.name.lower(): f for f in schema.fields}
    out = []
    for field in wanted.fields:
        found = own.get(field.name.lower())
        column = F.lit(None) if found is None else as_type(get(found.name), found.dataType, field.dataType)
        out.append((column.cast(field.dataType) if found is None else column).alias(field.name))
    return out


def one_shape(*batches: DataFrame) -> DataFrame:
    """All batches in one table; a column that a batch lacks is NULL for its rows.

    A field of several types gets the narrowest type that holds all their values, or is a
    VARIANT. Names are the same in any case and keep their first spelling.
    """
    wanted = T.StructType([T.StructField(n, k) for n, k in joined_fields([b.schema for b in batches])])
    shaped = [b.select(*_fields_as(lambda n: F.col(f"`{n}`"), b.schema, wanted)) for b in batches]
    return reduce(DataFrame.union, shaped)


# Reading VARIANT columns


def variant_kind(value: Column) -> Column:
    """``STRING``, ``BIGINT``, ``OBJECT<...>`` and so on; NULL of a missing value."""
    return F.schema_of_variant(value)


def as_text(value: Column) -> Column:
    """Texts as they are, anything else as JSON."""
    return F.when(variant_kind(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def as_number(value: Column) -> Column:
    """Numbers, and texts that are a number; anything else is NULL."""
    return F.try_variant_get(value, "$", "double")
