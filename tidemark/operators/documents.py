"""Columns of JSON or YAML text to dynamic or typed values.

Every reader adds the parsed column ``into`` and treats bad documents by
``on_error``:

``fail``        a bad document fails the job, also where its value is not used;
``lazy``        a bad document fails the job once its value is used;
``quarantine``  the value is NULL and ``<into>_error`` says why; see ``split_bad``.

The failure names the row by ``key``, if a column is given, and the document by
its length; ``show_payload`` puts its whole text in the message. ``fail`` also checks
rows that a later filter removes, and keeps such a filter from the files' scan:
filter first, or read ``lazy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.schema import with_defaults, without_metadata
from tidemark.functions.typed_read import read_record, undeclared_keys
from tidemark.functions.yaml_text import yaml_to_json, yaml_to_marked_json
from tidemark.session import fresh_name, session_conf
from tidemark.sources.files import write_parquet

_CORRUPT = "_corrupt_record"
_STRICT_JSON = {
    "columnNameOfCorruptRecord": _CORRUPT,
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}
# A key written twice in one object: the last one counts.
_LAST_KEY_WINS = {"spark.sql.variant.allowDuplicateKeys": "true"}

_TEMPORARY = ("__reason", "__array", "__variant", "__record", "__yaml", "__read", "__foreign")

NO_PAYLOAD = "no document"
NOT_AN_OBJECT = "not a JSON object"
NOT_OF_SHAPE = "not a JSON object of the declared shape"
TEXT_AFTER = "text after the JSON object"


def read_json(
    df: DataFrame,
    column: str,
    into: str = "doc",
    on_error: str = "fail",
    key: str | None = None,
    show_payload: bool = False,
) -> DataFrame:
    """JSON objects as VARIANT, from one parse: that of an array which has the text as its item.

    Text after the object makes that array broken, or longer than one. Only
    texts that are bad, or hold a brace before a bracket, are parsed again.
    """
    text = F.col(column)
    begins = text.rlike(r"^\s*\{")
    broken = F.from_json(text, f"{_CORRUPT} string", _STRICT_JSON).getField(_CORRUPT).isNotNull()
    # The setting holds for parses that are in the plan by the end of this block.
    with session_conf(df.sparkSession, _LAST_KEY_WINS):
        array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
        parsed = df.withColumn("__array", array).withColumn(
            "__variant", F.try_variant_get("__array", "$[0]", "variant"))
        single = F.col("__variant").isNotNull() & F.try_variant_get("__array", "$[1]", "variant").isNull()
        reason = (
            F.when(text.isNull(), NO_PAYLOAD)
            .when(~begins, NOT_AN_OBJECT)
            .when(single & (~text.rlike(_MAY_CLOSE) | _is_member(text)), F.lit(None))
            .when(broken, NOT_AN_OBJECT)
            .otherwise(TEXT_AFTER)
        )
        # A column of its own, so that the plan has it once.
        parsed = parsed.withColumn("__reason", reason)
        return _finish(
            parsed, column, F.col("__variant"), F.col("__reason"), into, on_error, key, show_payload)


def read_json_record(
    df: DataFrame,
    column: str,
    shape: T.StructType,
    into: str = "doc",
    case_insensitive: bool = False,
    allow_foreign: bool = True,
    on_error: str = "fail",
    key: str | None = None,
    show_payload: bool = False,
) -> DataFrame:
    """JSON objects as the declared record, from one native parse.

    A text in which other braces close before the last one is parsed once more,
    for what may stand after the object. Keys match with their case and undeclared keys are skipped; the opposite
    policies are refused for JSON.
    """
    if case_insensitive or not allow_foreign:
        raise ValueError(
            "JSON records match keys with their case and always skip undeclared keys"
        )
    wire = T.StructType([*without_metadata(shape), T.StructField(_CORRUPT, T.StringType())])
    parsed = df.withColumn("__record", F.from_json(F.col(column), wire, _STRICT_JSON))
    record = F.col("__record")
    reason = (
        F.when(F.col(column).isNull(), NO_PAYLOAD)
        .when(record.isNull() | record.getField(_CORRUPT).isNotNull(), NOT_OF_SHAPE)
        .when(~(F.col(column).rlike(_CLOSES_LAST) | _ends_with_object(F.col(column))), TEXT_AFTER)
    )
    return _finish(parsed, column, with_defaults(record, shape), reason, into, on_error, key, show_payload)


def read_yaml(
    df: DataFrame,
    column: str,
    into: str = "doc",
    on_error: str = "fail",
    key: str | None = None,
    show_payload: bool = False,
) -> DataFrame:
    """YAML mappings as VARIANT; an empty document is NULL."""
    parsed = df.withColumn("__yaml", yaml_to_json(F.col(column)))
    parsed = parsed.withColumn("__variant", F.parse_json("__yaml.json"))
    reason = F.when(F.col(column).isNull(), NO_PAYLOAD).otherwise(F.col("__yaml.error"))
    return _finish(parsed, column, F.col("__variant"), reason, into, on_error, key, show_payload)


def read_yaml_record(
    df: DataFrame,
    column: str,
    shape: T.StructType,
    into: str = "doc",
    case_insensitive: bool = True,
    allow_foreign: bool = True,
    on_error: str = "fail",
    key: str | None = None,
    show_payload: bool = False,
) -> DataFrame:
    """YAML mappings as the declared record, under both key policies at every level.

    An empty document is NULL. Of keys that match the same field the last counts.
    """
    document = yaml_to_marked_json(
        F.col(column), fold_keys=case_insensitive, list_keys=not allow_foreign
    )
    parsed = df.withColumn("__yaml", document)
    parsed = read_record(parsed, F.col("__yaml.json"), shape, "__read", case_insensitive)
    value = F.when(F.col("__yaml.json").isNotNull(), F.col("__read.value"))
    reason = (
        F.when(F.col(column).isNull(), NO_PAYLOAD)
        .when(F.col("__yaml.error").isNotNull(), F.col("__yaml.error"))
        .when(F.size("__read.errors") > 0, F.array_join("__read.errors", "; "))
    )
    if not allow_foreign:
        parsed = parsed.withColumn(
            "__foreign", undeclared_keys(F.col("__yaml.keys"), shape, case_insensitive)
        )
        reason = reason.when(
            F.size("__foreign") > 0,
            F.concat(F.lit("undeclared key "), F.array_join("__foreign", ", ")),
        )
    return _finish(parsed, column, value, reason, into, on_error, key, show_payload)


def split_bad(df: DataFrame, payload: str, into: str = "doc") -> tuple[DataFrame, DataFrame]:
    """A quarantined read as (good rows, bad (``payload``, ``reason``)).

    Two filters over one plan, each of which parses. Where both are used,
    ``split_bad_written`` parses once.
    """
    error = f"{into}_error"
    good = df.where(F.col(error).isNull()).drop(error)
    bad = df.where(F.col(error).isNotNull()).select(
        F.col(payload).alias("payload"), F.col(error).alias("reason")
    )
    return good, bad


def split_bad_written(
    df: DataFrame, payload: str, path: str, into: str = "doc"
) -> tuple[DataFrame, DataFrame]:
    """``split_bad`` with one parse: all rows are written once under ``path``, by their outcome.

    Both tables are then read from their own folder. The write needs no shuffle
    and does not run again if an executor is lost later.
    """
    outcome = fresh_name("bad")
    written = df.withColumn(outcome, F.col(f"{into}_error").isNotNull())
    write_parquet(written, path, partition_by=[outcome])
    read = df.sparkSession.read.schema(written.schema).parquet(path)
    good, bad = (read.where(F.col(outcome) == value).drop(outcome) for value in (False, True))
    return split_bad(good, payload, into)[0], split_bad(bad, payload, into)[1]


# A brace that a bracket follows: it may close the array a text is put into.
_MAY_CLOSE = r"\}\s*\]"
# The only closing brace ends the text, so it ends the object too.
_CLOSES_LAST = r"^[^}]*\}\s*$"


def _is_member(text: Column) -> Column:
    """``text`` is all of one member's value in an object."""
    return F.get_json_object(
        F.concat(F.lit('{"first":'), text, F.lit(',"second":0}')), "$.second").isNotNull()


def _ends_with_object(text: Column) -> Column:
    """Nothing but white space stands after the object ``text`` begins with.

    Spark's parsers stop at the end of the object. In brackets, text after it
    makes a broken array or a second item, unless it begins with a bracket of its
    own; then, as a member of an object, it breaks that.
    """
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(alone & (~text.rlike(_MAY_CLOSE) | _is_member(text)), F.lit(False))


def _finish(
    df: DataFrame, column: str, value: Column, reason: Column, into: str, on_error: str,
    key: str | None, show_payload: bool,
) -> DataFrame:
    kept = [F.col(c) for c in df.columns if c not in _TEMPORARY and c != into]
    if on_error == "quarantine":
        return df.select(
            *kept,
            F.when(reason.isNull(), value).alias(into),
            reason.alias(f"{into}_error"),
        )
    if on_error not in ("fail", "lazy"):
        raise ValueError("on_error is 'fail', 'lazy' or 'quarantine'")
    name = [] if key is None else [
        F.lit(f" of {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))]
    text = F.coalesce(F.col(column), F.lit("null")) if show_payload else F.concat(
        F.coalesce(F.length(column), F.lit(0)).cast("string"), F.lit(" characters"))
    message = F.concat(F.lit("Failed to read "), F.lit(column), *name, F.lit(" ("), text,
                       F.lit("): "), reason)
    passed = F.when(reason.isNull(), True).otherwise(F.raise_error(message).isNull())
    if on_error == "lazy":
        return df.select(*kept, F.when(passed, value).alias(into))
    # A filter stays in the plan when its columns are not asked for. It is kept above
    # the parse by a column Spark takes for changing, or each column it uses would be
    # parsed once more for it.
    checked = df.withColumns({"__value": value, "__passed": passed, "__task": F.spark_partition_id()})
    return checked.where(F.col("__passed") & (F.col("__task") >= 0)).select(
        *kept, F.col("__value").alias(into))
