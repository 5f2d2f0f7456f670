"""Typed reading of marked JSON (see ``yaml_text``).

One native parse takes the text apart into a struct of the declared shape whose
scalars are still marked text. The scalars of one type are then converted by
one expression: a copy of it per field would make generated code too long for
the JVM to compile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schema import default_of
from tidemark.functions.yaml_text import SCALAR_MARK

# Texts a boolean field takes, in any case.
TRUE_TEXTS = ("true", "yes", "on")
FALSE_TEXTS = ("false", "no", "off")

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
SCALAR_TYPES = (T.StringType, T.BooleanType, T.FloatType, T.DoubleType, *INTEGER_TYPES)

NOT_OF_SHAPE = "not a document of the declared shape"
_CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Leaf:
    """A field that is no object: where it stands, how it is declared, its raw value."""

    path: str
    declared: T.StructField
    raw: Column


def read_record(
    df: DataFrame, text: Column, shape: T.StructType, into: str, fold_keys: bool
) -> DataFrame:
    """Add struct ``into``(value, errors) of the marked JSON object in ``text``.

    ``fold_keys`` says that the text has lower-case keys. NULL text gives the
    defaults.
    """
    wire = T.StructType([*_raw_type(shape, fold_keys), T.StructField(_CORRUPT, T.StringType())])
    raw = F.col("__raw")
    read = df.withColumn("__raw", F.from_json(text, wire, {"columnNameOfCorruptRecord": _CORRUPT}))

    groups: dict[str, list[Leaf]] = {}
    arrays: list[Leaf] = []
    for leaf in _leaves(shape, raw, fold_keys):
        kind = leaf.declared.dataType
        if isinstance(kind, T.ArrayType):
            arrays.append(leaf)
        else:
            groups.setdefault(kind.simpleString(), []).append(leaf)

    steps, values, errors = {}, {}, [F.array_compact(F.array(
        F.when(raw.getField(_CORRUPT).isNotNull(), F.lit(NOT_OF_SHAPE))
    ))]
    for number, leaves in enumerate(groups.values()):
        kind = leaves[0].declared.dataType
        raws = F.array(*[leaf.raw for leaf in leaves])
        name = f"__group{number}"
        steps[name] = F.transform(raws, _scalar_reader(kind))
        errors.append(_unfit(F.col(name), raws, [leaf.path for leaf in leaves], kind))
        for position, leaf in enumerate(leaves):
            values[leaf.path] = F.coalesce(F.get(name, position), default_of(leaf.declared))
    for number, leaf in enumerate(arrays):
        name = f"__array{number}"
        steps[name] = _read(leaf.raw, leaf.declared, leaf.path, fold_keys)
        errors.append(F.col(name).getField("errors"))
        values[leaf.path] = F.col(name).getField("value")

    result = F.struct(
        _assemble(shape, values).alias("value"), F.concat(*errors).alias("errors")
    )
    return read.withColumns(steps).withColumn(into, result).drop("__raw", *steps)


def declared_keys(shape: T.DataType, fold_keys: bool, prefix: str = "") -> Iterator[str]:
    """The paths of all declared keys, written as ``yaml_text`` lists a document's."""
    if isinstance(shape, T.ArrayType):
        yield from declared_keys(shape.elementType, fold_keys, prefix[:-1] + "[].")
    elif isinstance(shape, T.StructType):
        for declared in shape:
            name = _key(declared.name, fold_keys).replace("\\", "\\\\").replace(".", "\\.")
            yield prefix + name
            yield from declared_keys(declared.dataType, fold_keys, f"{prefix}{name}.")


def undeclared_keys(keys: Column, shape: T.StructType, fold_keys: bool) -> Column:
    """Those of ``keys`` that ``shape`` lacks, without what lies below another of them."""
    known = F.array(*[F.lit(path) for path in declared_keys(shape, fold_keys)])

    def is_top(found: Column) -> Callable[[Column], Column]:
        return lambda key: ~F.exists(
            found,
            lambda other: key.startswith(F.concat(other, F.lit(".")))
            | key.startswith(F.concat(other, F.lit("[]"))),
        )

    found = F.array_except(keys, known)
    return F.when(F.size(found) > 1, F.filter(found, is_top(found))).otherwise(found)


def _key(name: str, fold_keys: bool) -> str:
    return name.lower() if fold_keys else name


def _raw_type(kind: T.DataType, fold_keys: bool) -> T.DataType:
    """The declared type with marked text for every scalar."""
    if isinstance(kind, T.StructType):
        names = [_key(f.name, fold_keys) for f in kind]
        if len(set(names)) < len(names):
            raise ValueError(f"fields of one object differ only in case: {names}")
        return T.StructType([
            T.StructField(name, _raw_type(f.dataType, fold_keys)) for name, f in zip(names, kind)
        ])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_raw_type(kind.elementType, fold_keys))
    if not isinstance(kind, SCALAR_TYPES):
        raise TypeError(f"a YAML field cannot be declared as {kind.simpleString()}")
    return T.StringType()


def _leaves(
    shape: T.StructType, raw: Column, fold_keys: bool, prefix: str = ""
) -> Iterator[Leaf]:
    for declared in shape:
        path = prefix + declared.name
        value = raw.getField(_key(declared.name, fold_keys))
        if isinstance(declared.dataType, T.StructType):
            yield from _leaves(declared.dataType, value, fold_keys, f"{path}.")
        else:
            yield Leaf(path, declared, value)


def _assemble(shape: T.StructType, values: dict[str, Column], prefix: str = "") -> Column:
    return F.struct(*[
        (
            _assemble(f.dataType, values, f"{prefix}{f.name}.")
            if isinstance(f.dataType, T.StructType)
            else values[prefix + f.name]
        ).alias(f.name)
        for f in shape
    ])


def _scalar_reader(kind: T.DataType) -> Callable[[Column], Column]:
    return lambda raw: _scalar(raw, kind)


def _unfit(values: Column, raws: Column, paths: list[str], kind: T.DataType) -> Column:
    """A message for each position with a raw value but no typed one."""
    messages = F.array(*[F.lit(f"{path} is not {kind.simpleString()}") for path in paths])
    return F.array_compact(F.transform(
        values,
        lambda value, i: F.when(value.isNull() & F.get(raws, i).isNotNull(), F.get(messages, i)),
    ))


def _read(raw: Column, declared: T.StructField, path: str, fold_keys: bool) -> Column:
    """struct(value, errors) of an array, or of what lies inside one."""
    kind = declared.dataType
    default = default_of(declared)
    if isinstance(kind, T.StructType):
        parts = F.struct(*[
            _read(raw.getField(_key(f.name, fold_keys)), f, f"{path}.{f.name}", fold_keys)
            .alias(f.name)
            for f in kind
        ])
        return _bind(parts, lambda read: F.struct(
            F.struct(*[read.getField(f.name).getField("value").alias(f.name) for f in kind])
            .alias("value"),
            F.concat(*[read.getField(f.name).getField("errors") for f in kind]).alias("errors"),
        ))
    if not isinstance(kind, T.ArrayType):
        message = F.lit(f"{path} is not {kind.simpleString()}")
        return _bind(_scalar(raw, kind), lambda value: F.struct(
            F.coalesce(value, default).alias("value"),
            F.array_compact(F.array(F.when(value.isNull() & raw.isNotNull(), message)))
            .alias("errors"),
        ))
    item = T.StructField(declared.name, kind.elementType)
    inside = f"{path}[]"
    if isinstance(kind.elementType, SCALAR_TYPES):
        message = F.lit(f"{inside} is not {kind.elementType.simpleString()}")
        return _bind(F.transform(raw, _scalar_reader(kind.elementType)), lambda values: F.struct(
            F.coalesce(values, default).alias("value"),
            F.array_compact(F.array(F.when(
                F.exists(
                    F.arrays_zip(values.alias("value"), raw.alias("raw")),
                    lambda pair: pair["value"].isNull() & pair["raw"].isNotNull(),
                ),
                message,
            ))).alias("errors"),
        ))
    items = F.transform(raw, lambda value: _read(value, item, inside, fold_keys))
    return _bind(items, lambda read: F.struct(
        F.coalesce(F.transform(read, lambda r: r.getField("value")), default).alias("value"),
        F.coalesce(
            F.flatten(F.transform(read, lambda r: r.getField("errors"))),
            F.array().cast("array<string>"),
        ).alias("errors"),
    ))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scalar(raw: Column, kind: T.DataType) -> Column:
    """The marked text as ``kind``; NULL if it is no scalar or does not fit."""
    text = F.when(raw.startswith(SCALAR_MARK), F.substring(raw, 2, 2147483647))
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        word = F.lower(text)
        return F.when(word.isin(*TRUE_TEXTS), True).when(word.isin(*FALSE_TEXTS), False)
    if isinstance(kind, INTEGER_TYPES):
        return _whole_number(F.replace(text, F.lit("_"), F.lit(""))).try_cast(kind)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _decimal_number(F.replace(text, F.lit("_"), F.lit(""))).cast(kind)
    raise TypeError(f"a YAML field cannot be declared as {kind.simpleString()}")


def _whole_number(text: Column) -> Column:
    """Decimal, binary, octal, hexadecimal and base-60 integers; NULL beyond 64 bits."""
    digits = F.regexp_replace(text, "^[-+]", "")
    negative = text.startswith("-")

    def based(start: int, base: int, fits: Callable[[Column], Column]) -> Column:
        # Zeros in front are dropped first, so that ``fits`` sees the number's own length.
        body = F.regexp_replace(F.substring(digits, start, 2147483647), "^0+(?=.)", "")
        size = F.when(fits(body), F.conv(body, base, 10)).cast("decimal(20,0)")
        return F.when(negative, -size).otherwise(size).try_cast("bigint")

    # Added up below zero, where there is one number more than above it.
    sixties = F.aggregate(
        F.split(digits, ":"),
        F.lit(0).cast("bigint"),
        lambda total, part: F.try_subtract(
            F.try_multiply(total, F.lit(60).cast("bigint")), part.try_cast("bigint")),
    )
    return (
        F.when(text.rlike(r"^[-+]?(0|[1-9][0-9]*)$"), text.try_cast("bigint"))
        .when(text.rlike(r"^[-+]?0b[01]+$"), based(3, 2, lambda body: F.length(body) <= 64))
        .when(text.rlike(r"^[-+]?0x[0-9a-fA-F]+$"), based(3, 16, lambda body: F.length(body) <= 16))
        .when(text.rlike(r"^[-+]?0[0-7]+$"), based(2, 8, lambda body: body.rlike("^1?.{1,21}$")))
        .when(text.rlike(r"^[-+]?[1-9][0-9]*(:[0-5]?[0-9])+$"),
              F.when(negative, sixties).otherwise(F.try_subtract(F.lit(0).cast("bigint"), sixties)))
    )


def _decimal_number(text: Column) -> Column:
    word = F.lower(text)
    return (
        F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"),
               text.try_cast("double"))
        .when(word.isin(".inf", "+.inf"), F.lit(float("inf")))
        .when(word == "-.inf", F.lit(float("-inf")))
        .when(word == ".nan", F.lit(float("nan")))
    )
