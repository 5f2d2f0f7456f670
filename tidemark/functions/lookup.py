"""Typed lookups by path in a dynamic document (a VARIANT column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_DEFAULT = object()

# The kind of value each type takes, as schema_of_variant names it.
_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "int": "BIGINT", "bigint": "BIGINT"}


def json_path(*keys: str) -> str:
    """A variant path with every key quoted."""
    return "$" + "".join(f'["{key}"]' for key in keys)


def part(document: Column, *keys: str) -> Column:
    """The variant at the path: NULL if absent, a variant null if null is written there."""
    return F.try_variant_get(document, json_path(*keys), "variant")


def typed(
    found: Column, path: Column | str, kind: str, default: object = _NO_DEFAULT, strict: bool = True
) -> Column:
    """The variant ``found`` at ``path`` as ``kind``.

    An absent value gives ``default``, if there is one. Otherwise, and where null
    is written, a boolean is false and anything else NULL. A value of another
    kind fails the job when ``strict``, and counts as null when not.
    """
    missing = F.lit(False) if kind == "boolean" else F.lit(None).cast(kind)
    absent = missing if default is _NO_DEFAULT else F.lit(default).cast(kind)
    if strict:
        name = F.lit(path) if isinstance(path, str) else path
        value = F.variant_get(found, "$", kind)
        wrong = F.raise_error(F.concat(name, F.lit(f" is not {kind}"))).cast(kind)
    else:
        value = F.coalesce(F.try_variant_get(found, "$", kind), missing)
        wrong = missing
    result = F.when(found.isNull(), absent)
    if kind in _KINDS:
        # The conversion alone would also take "8" for a number.
        result = result.when(F.schema_of_variant(found) == _KINDS[kind], value)
        return result.when(F.is_variant_null(found), missing).otherwise(wrong)
    return result.when(F.is_variant_null(found), missing).otherwise(value)


def lookup(
    document: Column, path: str, kind: str, default: object = _NO_DEFAULT, strict: bool = True
) -> Column:
    """The value at a dotted ``path`` of ``document``; see ``typed``."""
    return typed(part(document, *path.split(".")), path, kind, default, strict)


def named_block(document: Column, name: Column | str | None) -> Column:
    """The block whose key is ``name``; NULL if the name or the block is missing."""
    if name is None:
        return F.lit(None).cast("variant")
    if isinstance(name, str):
        return part(document, name)
    return F.try_variant_get(
        document, F.concat(F.lit('$["'), name, F.lit('"]')), "variant"
    )
