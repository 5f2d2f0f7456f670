"""YAML text to JSON text: the one step Spark has no built-in for.

Two forms. ``yaml_to_json`` resolves scalars (numbers, booleans, null) for
dynamic use. ``yaml_to_marked_json`` leaves every scalar as its raw text behind
a mark, because a declared field type, not the scalar's look, decides how a
typed read takes it: ``1.10`` stays ``1.10`` for a string field.

As each key passes through here anyway, the marked form can also fold its case
and list it. What the policies make of that is left to built-in expressions.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # the functions below say so when they are called
    yaml = None

# Executors need PyYAML and pyarrow only; this module travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALAR_MARK = "="

# How many values a document may have once its aliases are written out. Few lines
# of aliases to aliases can stand for more than any memory holds.
MAX_EXPANDED_VALUES = 10_000_000

# Texts that are held as Python strings at once, and those remembered with their results.
SLICE_BYTES = 1 << 20
KNOWN_BYTES = 4 << 20

STANDARD_TAG = "tag:yaml.org,2002:"
RESOLVED_TAGS = {STANDARD_TAG + kind for kind in ("int", "float", "bool")}
NULL_TAG = STANDARD_TAG + "null"
TEXT_TAG = STANDARD_TAG + "str"

# Plain scalars that are null, and the merge key.
PLAIN_TAGS = {
    **dict.fromkeys(("", "~", "null", "Null", "NULL"), NULL_TAG),
    "<<": STANDARD_TAG + "merge",
}

RESULT_SCHEMA = "json string, keys array<string>, error string"


@dataclass(frozen=True)
class Form:
    """``marked``: raw scalars behind a mark. ``fold_keys``: lower-case keys, of which
    the last to match counts. ``list_keys``: also give the path of every key."""

    marked: bool
    fold_keys: bool = False
    list_keys: bool = False


def _loader_class(form: Form):
    base = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    if form.marked:
        return type("MarkedLoader", (base,), {
            "resolve": _resolve_marked,
            "descend_resolver": lambda self, node, index: None,
            "ascend_resolver": lambda self: None,
        })
    loader = type("DocumentLoader", (base,), {})
    loader.add_implicit_resolver(  # 1e3 is a float
        STANDARD_TAG + "float",
        re.compile(r"^[-+]?[0-9][0-9_]*[eE][-+]?[0-9]+$"),
        list("-+0123456789"),
    )
    return loader


def _resolve_marked(loader, kind, value, implicit) -> str:
    """Tag a node; of plain scalars only null and the merge key matter here."""
    if kind is yaml.ScalarNode:
        return PLAIN_TAGS.get(value, TEXT_TAG) if implicit[0] else TEXT_TAG
    return STANDARD_TAG + ("map" if kind is yaml.MappingNode else "seq")


def _to_json(text: str, loader_class, form: Form) -> tuple[str | None, list[str] | None]:
    """JSON text and key paths of one document, None for an empty document.

    Raises ValueError or YAMLError for a bad one.
    """
    loader = loader_class(text)
    try:
        # Only aliases and merges need the document as a tree of nodes.
        reader = (_NodeReader if "*" in text or "<<" in text else _EventReader)(loader, form)
        value = reader.document()
        if value is None:
            return None, None
        if not isinstance(value, dict):
            raise ValueError("the root is not a mapping")
        result = json.dumps(value, ensure_ascii=False)
        result.encode("utf-8")
        return result, list(reader.paths) if form.list_keys else None
    finally:
        loader.dispose()


class _Reader:
    """What both readers share: scalars, and the paths of keys if the form lists them."""

    def __init__(self, loader, form: Form) -> None:
        self.loader, self.form = loader, form
        self.paths: dict[str, None] = {}

    def scalar(self, tag: str, value: str):
        if not tag.startswith(STANDARD_TAG):
            raise ValueError(f"unknown tag {tag}")
        if tag == NULL_TAG:
            return None
        if self.form.marked:
            return SCALAR_MARK + value
        if tag not in RESOLVED_TAGS:
            return value
        if value.isdecimal() and value[0] != "0":
            return int(value)
        number = self.loader.construct_object(yaml.ScalarNode(tag, value))
        if isinstance(number, float) and number - number != 0:
            return value  # JSON has no infinity
        return number

    def key(self, value: str, prefix: str) -> tuple[str, str]:
        """The key as it counts, and the prefix of the paths below it."""
        key = value.lower() if self.form.fold_keys else value
        if not self.form.list_keys:
            return key, prefix
        path = prefix + key.replace("\\", "\\\\").replace(".", "\\.")
        self.paths[path] = None
        return key, path + "."


class _EventReader(_Reader):
    """Values straight from the parser's events, without a tree in between."""

    def document(self):
        take, loader = self.loader.get_event, self.loader
        take()  # the stream's start
        if loader.check_event(yaml.StreamEndEvent):
            return None
        take()
        value = self.value(take(), "")
        take()
        if not loader.check_event(yaml.StreamEndEvent):
            raise ValueError("more than one document")
        return value

    def value(self, event, prefix):
        kind = type(event)
        if kind is yaml.ScalarEvent:
            tag = event.tag
            if tag is None or tag == "!":
                tag = self.loader.resolve(yaml.ScalarNode, event.value, event.implicit)
            return self.scalar(tag, event.value)
        if event.tag is not None and event.tag != "!" and not event.tag.startswith(STANDARD_TAG):
            raise ValueError(f"unknown tag {event.tag}")
        take, value = self.loader.get_event, self.value
        if kind is yaml.SequenceStartEvent:
            inner = prefix and prefix[:-1] + "[]."
            items = []
            while type(event := take()) is not yaml.SequenceEndEvent:
                items.append(value(event, inner))
            return items
        mapping = {}
        while type(event := take()) is not yaml.MappingEndEvent:
            if type(event) is not yaml.ScalarEvent:
                raise ValueError("a mapping key is not a scalar")
            key, inner = self.key(event.value, prefix)
            mapping.pop(key, None)  # a repeated key moves to its last place
            mapping[key] = value(take(), inner)
        return mapping


class _NodeReader(_Reader):
    """Values of a tree in which nodes may be met again: each is converted once, then reused.

    What aliases stand for is counted, as the JSON text will write it out.
    """

    def __init__(self, loader, form: Form) -> None:
        super().__init__(loader, form)
        self.known: dict[int, tuple[object, int, list[str]]] = {}
        self.open: set[int] = set()
        self.values = 0

    def document(self):
        root = self.loader.get_single_node()
        return None if root is None else self.value(root, "")

    def value(self, node, prefix):
        self.count(1)
        if isinstance(node, yaml.ScalarNode):
            return self.scalar(node.tag, node.value)
        if not node.tag.startswith(STANDARD_TAG):
            raise ValueError(f"unknown tag {node.tag}")
        if id(node) in self.open:
            raise ValueError("an alias stands inside what it names")
        # The paths below a sequence follow its own name, without the dot.
        own = prefix[:-1] if isinstance(node, yaml.SequenceNode) else prefix
        if id(node) in self.known:
            value, size, below = self.known[id(node)]
            self.count(size)
            self.paths.update((own + path, None) for path in below)
            return value
        outside, self.paths = self.paths, {}
        before = self.values
        self.open.add(id(node))
        value = self.collection(node, prefix)
        self.open.discard(id(node))
        below = [path[len(own):] for path in self.paths]
        self.known[id(node)] = (value, self.values - before, below)
        outside.update(self.paths)
        self.paths = outside
        return value

    def collection(self, node, prefix):
        if isinstance(node, yaml.SequenceNode):
            inner = prefix and prefix[:-1] + "[]."
            return [self.value(item, inner) for item in node.value]
        self.loader.flatten_mapping(node)
        mapping = {}
        for key_node, value in node.value:
            if not isinstance(key_node, yaml.ScalarNode):
                raise ValueError("a mapping key is not a scalar")
            key, inner = self.key(key_node.value, prefix)
            mapping.pop(key, None)
            mapping[key] = self.value(value, inner)
        return mapping

    def count(self, values: int) -> None:
        self.values += values
        if self.values > MAX_EXPANDED_VALUES:
            raise ValueError(f"its aliases stand for over {MAX_EXPANDED_VALUES} values")


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``SLICE_BYTES``, or one longer text."""
    start = size = 0
    for at, length in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if at > start and size + length > SLICE_BYTES:
            yield texts.slice(start, at - start)
            start, size = at, 0
        size += length
    yield texts.slice(start)


class _Converter:
    """Converts Arrow arrays; short texts that come again are not parsed again."""

    def __init__(self, form: Form) -> None:
        self.form, self.loader_class = form, _loader_class(form)
        self.known: dict[str, tuple] = {}
        self.size = 0

    def row(self, text: str | None) -> tuple:
        if text is None:
            return None, None, None
        result = self.known.get(text)
        if result is None:
            try:
                result = (*_to_json(text, self.loader_class, self.form), None)
            except (yaml.YAMLError, ValueError, RecursionError) as failure:
                result = (None, None, f"{type(failure).__name__}: {failure}")
            size = len(text) + len(result[0] or "") + sum(map(len, result[1] or ()))
            if size <= KNOWN_BYTES // 64:
                if self.size + size > KNOWN_BYTES:
                    self.known, self.size = {}, 0
                self.known[text] = result
                self.size += size
        return result

    def convert(self, texts: pa.Array) -> pa.StructArray:
        rows = [self.row(text) for text in texts.to_pylist()]
        documents, keys, errors = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays(
            [
                pa.array(documents, pa.string()),
                pa.array(keys, pa.list_(pa.string())),
                pa.array(errors, pa.string()),
            ],
            names=["json", "keys", "error"],
        )


def _convert(text: Column, form: Form) -> Column:
    def convert(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if yaml is None:
            raise ImportError("reading YAML needs PyYAML on the executors")
        converter = _Converter(form)
        for texts in batches:
            for part in _slices(texts):
                yield converter.convert(part)

    return F.arrow_udf(convert, RESULT_SCHEMA)(text)


def yaml_to_json(text: Column) -> Column:
    """struct(json, keys, error) with resolved scalars; all NULL for an empty document."""
    return _convert(text, Form(marked=False))


def yaml_to_marked_json(text: Column, fold_keys: bool = False, list_keys: bool = False) -> Column:
    """struct(json, keys, error) with every scalar as marked raw text."""
    return _convert(text, Form(marked=True, fold_keys=fold_keys, list_keys=list_keys))
