"""Placeholders in document text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# A document is rendered only if it declares itself local; the two placeholders.
LOCAL_DOCUMENT = r"local:\s+true"
ROOT_PLACEHOLDER = "GIT_ROOT"
RANDOM_PLACEHOLDER = "RANDOM_STRING"


# A placeholder, and a brace that opens before the last one has closed.
_TOKEN, _NESTED = r"\{[^{}]*\}", r"\{[^{}]*\{"


def render(text: Column, variables: Mapping[str, Column | str]) -> Column:
    """Replace ``{name}`` by its value in documents that say ``local: true``.

    The replacement is literal, so values may hold ``$`` and backslashes. A
    null value prints "null". Names are replaced one after another, in the
    order given: a value that holds ``{other}`` is filled too if that name comes
    later, and so is a placeholder that a value completes.

    The text is cut once into placeholders and what stands between them, and
    each is looked up by its name, so a further name costs no further pass over
    the text. Only where the order shows, as a value holds a brace or braces
    are nested, do names go over the text in turn.
    """
    values = {name: F.lit(value) if isinstance(value, str) else value for name, value in variables.items()}
    in_turn = text
    for name, value in values.items():
        in_turn = F.replace(in_turn, F.lit("{" + name + "}"), F.coalesce(value, F.lit("null")))
    if not values or any(set(name) & set("{}") for name in values):
        filled = in_turn
    else:
        ordered = text.rlike(_NESTED)
        for value in values.values():
            ordered = ordered | F.coalesce(value.rlike("[{}]"), F.lit(False))
        filled = F.when(ordered, in_turn).otherwise(_in_one_pass(text, values))
    return F.when(text.rlike(LOCAL_DOCUMENT), filled).otherwise(text)


def _in_one_pass(text: Column, values: Mapping[str, Column]) -> Column:
    known = F.create_map(*[
        part for name, value in values.items()
        for part in (F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("null")))])
    between = F.split(text, _TOKEN, -1)
    found = F.transform(
        F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)),
        lambda token: F.coalesce(F.try_element_at(known, token), token))
    # One more piece stands between than there are placeholders.
    return F.array_join(F.zip_with(
        between, found, lambda piece, value: F.concat(piece, F.coalesce(value, F.lit("")))), "")


def without_newlines(value: Column) -> Column:
    """A command's output as a path: line ends removed."""
    return F.regexp_replace(value, r"\r?\n", "")


def stable_id(prefix: Column | None, document_id: Column, run_id: str) -> Column:
    """``prefix`` and an identifier in UUID layout, one per document and run.

    Hashed instead of drawn, so that a retried task prints the same text. A
    missing prefix prints "null".
    """
    digest = F.md5(F.concat_ws(":", document_id.cast("string"), F.lit(run_id)))
    parts = [F.substring(digest, start, length) for start, length in
             ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    head = F.lit("null") if prefix is None else F.coalesce(prefix, F.lit("null"))
    return F.concat(head, F.concat_ws("-", *parts))
