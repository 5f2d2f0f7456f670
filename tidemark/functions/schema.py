"""Declared document shapes: a StructType whose fields may carry defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT = "default"


def field(name: str, kind: T.DataType, default: object = None) -> T.StructField:
    """A field that takes ``default`` where a document lacks it or has null there."""
    metadata = {} if default is None else {DEFAULT: default}
    return T.StructField(name, kind, True, metadata)


def record(*fields: T.StructField) -> T.StructType:
    return T.StructType(list(fields))


def default_of(declared: T.StructField) -> Column:
    """The default as a typed column; an object's default is built from its fields'."""
    if isinstance(declared.dataType, T.StructType):
        return F.struct(*[default_of(f).alias(f.name) for f in declared.dataType])
    value = (declared.metadata or {}).get(DEFAULT)
    if isinstance(value, list):
        return F.array(*[F.lit(item) for item in value]).cast(declared.dataType)
    return F.lit(value).cast(declared.dataType)


def with_defaults(value: Column, declared: T.StructType) -> Column:
    """``value`` (a struct of that shape, or NULL) with every gap filled."""
    return F.struct(*[_filled(value.getField(f.name), f).alias(f.name) for f in declared])


def _filled(value: Column, declared: T.StructField) -> Column:
    kind = declared.dataType
    if isinstance(kind, T.StructType):
        return with_defaults(value, kind)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        value = F.transform(
            value, lambda item: F.when(item.isNotNull(), with_defaults(item, kind.elementType))
        )
    if DEFAULT in (declared.metadata or {}):
        return F.coalesce(value, default_of(declared))
    return value


def without_metadata(kind: T.DataType) -> T.DataType:
    """The bare type, as Spark's own functions expect it."""
    if isinstance(kind, T.StructType):
        return T.StructType(
            [T.StructField(f.name, without_metadata(f.dataType), True) for f in kind]
        )
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(without_metadata(kind.elementType), True)
    return kind
