"""Documents built from the given tables, so that the source columns are the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType

from tidemark.functions.lookup import lookup
from tidemark.functions.schema import field, record
from tidemark.operators.documents import (
    read_json,
    read_json_record,
    read_yaml,
    read_yaml_record,
    split_bad_written,
)
from tidemark.plans.tables import load
from tidemark.session import scratch_path

PROPS = record(
    field("k", LongType(), default=-1),
    field("label", StringType(), default="none"),
)

DOCUMENT = record(
    field("lang", StringType()),
    field("nChars", LongType()),
    field("body", record(field("text", StringType(), default=""))),
)

EVENT = record(
    field("event", record(
        field("id", LongType()),
        field("kind", StringType(), default="unknown"),
        field("amount", DoubleType()),
        field("isPaid", BooleanType(), default=False),
        field("owner", record(field("userId", LongType(), default=-1))),
        field("marks", ArrayType(LongType()), default=[]),
    )),
)


def key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per value of ``props.k``: typed read, path lookup, count."""
    events = load(spark, sf_dir, "events").select("props")
    typed = read_json_record(events, "props", PROPS, into="props")
    return typed.groupBy(F.col("props.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def json_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "props")
    return read_json(events, "props").select(
        "event_id", lookup(F.col("doc"), "k", "bigint").alias("k")
    )


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts through JSON objects and back."""
    texts = load(spark, sf_dir, "documents").select(
        "doc_id", F.to_json(F.struct("text", "lang", "n_chars")).alias("payload")
    )
    doc = F.col("doc")
    return read_json(texts, "payload").select(
        "doc_id",
        lookup(doc, "text", "string").alias("text"),
        lookup(doc, "lang", "string").alias("lang"),
        lookup(doc, "n_chars", "bigint").alias("n_chars"),
    )


def json_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed read with defaults; errors carry cut-off text, which is quarantined."""
    events = load(spark, sf_dir, "events")
    kind = F.col("event_type")
    payload = (
        F.when(kind == "error", F.regexp_replace("props", r"\}$", ""))
        .when(kind == "signup", F.lit("{}"))
        .when(kind == "view", F.regexp_replace("props", r"\}$", ', "label": "seen", "x": [1]}'))
        .otherwise(F.col("props"))
    )
    read = read_json_record(
        events.select("event_id", payload.alias("payload")), "payload", PROPS,
        on_error="quarantine",
    )
    return read.select(
        "event_id",
        F.col("doc.k").alias("k"),
        F.col("doc.label").alias("label"),
        F.col("doc_error").isNotNull().alias("is_bad"),
    )


def json_split_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad rows of one read: errors have text after the object, signups are cut."""
    kind = F.col("event_type")
    payload = (
        F.when(kind == "error", F.concat("props", F.lit("] {}")))
        .when(kind == "signup", F.regexp_replace("props", r"\}$", ""))
        .when(kind == "view", F.concat("props", F.lit(" {}")))
        .otherwise(F.concat("props", F.lit(" \n")))
    )
    events = load(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    good, bad = split_bad_written(
        read_json_record(events, "payload", PROPS, on_error="quarantine"), "payload",
        scratch_path(spark, "outcomes"))
    return good.select("payload", F.col("doc.k").alias("k"), F.lit(None).cast("string").alias("reason")).union(
        bad.select("payload", F.lit(None).cast("bigint"), "reason"))


def json_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read in fail mode of which only the keys are used: every document is checked."""
    events = load(spark, sf_dir, "events").select("event_id", "props")
    return read_json(events, "props", key="event_id").select("event_id")


INTEGERS = record(*[
    field(name, LongType()) for name in ("hex", "octal", "binary", "sixties", "padded", "negative")
])


def yaml_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of all notations, most behind more zeros than a number has digits."""
    number = F.col("event_id")
    zeros = F.lit("0" * 70)
    payload = F.concat(
        F.lit("hex: 0x"), zeros, F.hex(number),
        F.lit("\noctal: 0"), zeros, F.conv(number.cast("string"), 10, 8),
        F.lit("\nbinary: 0b"), zeros, F.bin(number),
        F.lit("\nsixties: "), (number + 1).cast("string"), F.lit(":0:"), (number % 60).cast("string"),
        F.lit("\npadded: +0x"), zeros, F.hex(number + (1 << 40)),
        F.lit("\nnegative: -0b"), F.bin(number), F.lit("\n"),
    )
    events = load(spark, sf_dir, "events", spread=True).select("event_id", payload.alias("payload"))
    return read_yaml_record(events, "payload", INTEGERS).select(
        "event_id", *[F.col(f"doc.{one.name}").alias(one.name) for one in INTEGERS])


def _yaml_events(spark: SparkSession, sf_dir: str, shouting: Column, extra: Column) -> DataFrame:
    """Events as YAML blocks; ``shouting`` rows have their keys in capitals."""

    def key(name: str) -> Column:
        return F.when(shouting, name.upper()).otherwise(name)

    def text(name: str) -> Column:
        return F.col(name).cast("string")

    block = F.concat(
        key("event"), F.lit(":\n  "),
        key("id"), F.lit(": "), text("event_id"), F.lit("\n  "),
        key("kind"), F.lit(": "), text("event_type"), F.lit("   # a comment\n  "),
        key("amount"), F.lit(": "), text("value"), F.lit("\n  "),
        key("isPaid"), F.lit(": "),
        F.when(F.col("event_type") == "purchase", "yes").otherwise("no"), F.lit("\n  "),
        key("owner"), F.lit(": {"), key("userId"), F.lit(": "), text("user_id"), F.lit("}\n  "),
        key("marks"), F.lit(":\n    - "), text("event_id"), F.lit("\n    - "), text("user_id"),
        F.lit("\n"), extra,
    )
    return load(spark, sf_dir, "events", spread=True).select(
        "event_id", "event_type", block.alias("payload")
    )


def yaml_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc")
    events = _yaml_events(spark, sf_dir, F.lit(False), F.lit(""))
    return read_yaml(events, "payload").select(
        "event_id",
        lookup(doc, "event.id", "bigint").alias("id"),
        lookup(doc, "event.kind", "string").alias("kind"),
        lookup(doc, "event.amount", "double").alias("amount"),
        lookup(doc, "event.isPaid", "boolean").alias("is_paid"),
        lookup(doc, "event.owner.userId", "bigint").alias("user_id"),
    )


def _event_columns(read: DataFrame, *more: Column) -> DataFrame:
    event = F.col("doc.event")
    return read.select(
        "event_id",
        event.getField("id").alias("id"),
        event.getField("kind").alias("kind"),
        event.getField("amount").alias("amount"),
        event.getField("isPaid").alias("is_paid"),
        event.getField("owner").getField("userId").alias("user_id"),
        F.size(event.getField("marks")).alias("n_marks"),
        F.get(event.getField("marks"), 1).alias("mark"),
        *more,
    )


def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts through YAML records, under keys in any case."""
    texts = load(spark, sf_dir, "documents", spread=True).select(
        "doc_id",
        F.concat(
            F.lit("Lang: "), "lang", F.lit("\nNCHARS: "), F.col("n_chars").cast("string"),
            F.lit("\nbody: "), F.to_json(F.struct("text")), F.lit("\n"),
        ).alias("payload"),
    )
    doc = F.col("doc")
    return read_yaml_record(texts, "payload", DOCUMENT, allow_foreign=False).select(
        "doc_id",
        doc["body"]["text"].alias("text"),
        doc["lang"].alias("lang"),
        doc["nChars"].alias("n_chars"),
    )


_SHOUTED = ("click", "purchase")


def yaml_struct_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in any case fill the declared record."""
    events = _yaml_events(spark, sf_dir, F.col("event_type").isin(*_SHOUTED), F.lit(""))
    return _event_columns(read_yaml_record(events, "payload", EVENT))


def yaml_struct_cs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With case kept, shouted keys are foreign, are skipped, and defaults take over."""
    events = _yaml_events(spark, sf_dir, F.col("event_type").isin(*_SHOUTED), F.lit(""))
    return _event_columns(read_yaml_record(events, "payload", EVENT, case_insensitive=False))


def yaml_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With undeclared keys refused, signups (one nested) and errors (a block) are bad."""
    extra = (
        F.when(F.col("event_type") == "signup", "  foo: bar\n")
        .when(F.col("event_type") == "error", "other:\n  inner:\n    custom: blah\n")
        .otherwise("")
    )
    events = _yaml_events(spark, sf_dir, F.lit(False), extra)
    read = read_yaml_record(
        events, "payload", EVENT, allow_foreign=False, on_error="quarantine"
    )
    return _event_columns(read, F.col("doc_error").alias("reason"))


QUERIES = {
    "key_counts": key_counts,
    "json_variant": json_variant,
    "json_documents": json_documents,
    "json_struct": json_struct,
    "json_split_bad": json_split_bad,
    "json_checked": json_checked,
    "yaml_integers": yaml_integers,
    "yaml_variant": yaml_variant,
    "yaml_documents": yaml_documents,
    "yaml_struct_ci": yaml_struct_ci,
    "yaml_struct_cs": yaml_struct_cs,
    "yaml_foreign": yaml_foreign,
}

ORACLES = {
    "key_counts": """
        SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n
        FROM events GROUP BY 1
    """,
    "json_variant": """
        SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
    """,
    "json_documents": """
        SELECT doc_id, text, lang, n_chars FROM documents
    """,
    "json_struct": """
        SELECT event_id,
               CASE WHEN event_type = 'error' THEN NULL
                    WHEN event_type = 'signup' THEN -1
                    ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
               CASE WHEN event_type = 'error' THEN NULL
                    WHEN event_type = 'view' THEN 'seen' ELSE 'none' END AS label,
               event_type = 'error' AS is_bad
        FROM events
    """,
    "json_split_bad": """
        SELECT payload, CASE WHEN reason IS NULL THEN k END AS k, reason
        FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                     CASE event_type WHEN 'error' THEN props || '] {}' WHEN 'view' THEN props || ' {}'
                          WHEN 'signup' THEN props[:-2] ELSE props || ' ' || chr(10) END AS payload,
                     CASE WHEN event_type IN ('error', 'view') THEN 'text after the JSON object'
                          WHEN event_type = 'signup'
                          THEN 'not a JSON object of the declared shape' END AS reason
              FROM events)
    """,
    "json_checked": """
        SELECT event_id FROM events
    """,
    "yaml_integers": """
        SELECT event_id, event_id AS hex, event_id AS octal, event_id AS binary,
               (event_id + 1) * 3600 + event_id % 60 AS sixties,
               event_id + 1099511627776 AS padded, -event_id AS negative
        FROM events
    """,
    "yaml_variant": """
        SELECT event_id, event_id AS id, event_type AS kind, value AS amount,
               event_type = 'purchase' AS is_paid, user_id
        FROM events
    """,
    "yaml_documents": """
        SELECT doc_id, text, lang, n_chars FROM documents
    """,
    "yaml_struct_ci": """
        SELECT event_id, event_id AS id, event_type AS kind, value AS amount,
               event_type = 'purchase' AS is_paid, user_id,
               2 AS n_marks, user_id AS mark
        FROM events
    """,
    "yaml_struct_cs": """
        SELECT event_id,
               CASE WHEN shouted THEN NULL ELSE event_id END AS id,
               CASE WHEN shouted THEN 'unknown' ELSE event_type END AS kind,
               CASE WHEN shouted THEN NULL ELSE value END AS amount,
               NOT shouted AND event_type = 'purchase' AS is_paid,
               CASE WHEN shouted THEN -1 ELSE user_id END AS user_id,
               CASE WHEN shouted THEN 0 ELSE 2 END AS n_marks,
               CASE WHEN shouted THEN NULL ELSE user_id END AS mark
        FROM (SELECT *, event_type IN ('click', 'purchase') AS shouted FROM events)
    """,
    "yaml_foreign": """
        SELECT event_id,
               CASE WHEN reason IS NULL THEN event_id END AS id,
               CASE WHEN reason IS NULL THEN event_type END AS kind,
               CASE WHEN reason IS NULL THEN value END AS amount,
               CASE WHEN reason IS NULL THEN event_type = 'purchase' END AS is_paid,
               CASE WHEN reason IS NULL THEN user_id END AS user_id,
               CASE WHEN reason IS NULL THEN 2 END AS n_marks,
               CASE WHEN reason IS NULL THEN user_id END AS mark,
               reason
        FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 'undeclared key event.foo'
                             WHEN event_type = 'error' THEN 'undeclared key other' END AS reason
              FROM events)
    """,
}
