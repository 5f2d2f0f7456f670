"""Settings operations on the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.render import RANDOM_PLACEHOLDER, ROOT_PLACEHOLDER, stable_id
from tidemark.functions.runtime import runtime_of
from tidemark.operators.bucketed_settings import merge_bucketed, restrict_bucketed
from tidemark.operators.settings_record import read_settings
from tidemark.operators.documents import read_json
from tidemark.operators.settings import (
    filter_names,
    merge_settings,
    render_from_table,
    restrict_keys,
)
from tidemark.plans.cache_demo import settings_from_files
from tidemark.plans.tables import load
from tidemark.session import fresh_name, scratch_path
from tidemark.sources.files import write_documents
from tidemark.sources.tables import save_bucketed

RUN_ID = "r1"


def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts under a templated head, with one root per source.

    English documents are local, the others stay as they are.
    """
    documents = load(spark, sf_dir, "documents")
    local = F.when(F.col("lang") == "en", "true").otherwise("false")
    texts = documents.select(
        "doc_id", F.col("source").alias("scope"),
        F.concat(
            F.lit("local: "), local,
            F.lit("\nroot: file://{GIT_ROOT}/a\nid: {RANDOM_STRING}\nagain: {RANDOM_STRING}\n"),
            "text",
        ).alias("content"),
    )
    roots = documents.select(F.col("source").alias("scope")).distinct().select(
        "scope",
        F.lit(ROOT_PLACEHOLDER).alias("name"),
        F.concat(F.lit("/repos/$1/"), "scope").alias("value"),
    )
    rendered = render_from_table(
        texts, "content", roots, [ROOT_PLACEHOLDER],
        extra={RANDOM_PLACEHOLDER: stable_id(F.lit("t-"), F.col("doc_id"), RUN_ID)},
    )
    return rendered.select("doc_id", "content")


def _settings_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as settings documents, in which some keys and blocks are absent or null."""
    kind = F.col("event_type")

    def number(name: str) -> Column:
        return F.col(name).cast("string")

    memory = F.when(kind != "view", F.concat(F.lit(', "driverMemory": "'), number("user_id"), F.lit('g"')))
    store = (
        F.when(kind == "error", F.lit(', "metastoreRootPath": null'))
        .when(kind != "click", F.concat(F.lit(', "metastoreRootPath": "m/'), number("event_id"), F.lit('"')))
    )
    telemetry = (
        F.when(kind == "purchase", F.lit(', "telemetry": null'))
        .when(kind == "signup", F.lit(', "telemetry": {"isRelay": true}'))
        .when(kind != "error", F.concat(F.lit(', "telemetry": {"url": "u/'), number("event_id"), F.lit('"}')))
    )
    secret = F.when(kind == "view", F.lit(', "secret": {"place": "here"}'))
    nothing = F.lit("")
    payload = F.concat(
        F.lit('{"spark": {"local": '),
        F.when(F.col("value") > 100, F.lit("true")).otherwise(F.lit("false")),
        F.lit(', "driverCore": '), number("user_id"),
        F.coalesce(memory, nothing), F.coalesce(store, nothing),
        F.lit(', "state": {"storeProviderClass": "P'), number("user_id"), F.lit('"}}'),
        F.coalesce(telemetry, nothing), F.coalesce(secret, nothing),
        F.lit(', "'), kind, F.lit('": {"n": 1}}'),
    )
    return load(spark, sf_dir, "events", spread=True).select(
        "event_id", payload.alias("payload")
    )


def path_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed settings record of every document, with its lookup defaults."""
    read = read_json(_settings_documents(spark, sf_dir), "payload")
    return read_settings(read, "doc", into="s", driver="click").select(
        "event_id",
        F.col("s.local").alias("is_local"),
        F.col("s.debug").alias("is_debug"),
        F.col("s.driverCore").alias("driver_core"),
        F.col("s.driverMemory").alias("driver_memory"),
        F.col("s.executorCore").alias("executor_core"),
        F.col("s.metastoreRootPath").alias("metastore"),
        F.col("s.storeProviderClass").alias("provider"),
        F.col("s.secret").isNotNull().alias("has_secret"),
        F.col("s.driver").isNotNull().alias("has_driver"),
        F.col("s.telemetry.url").alias("url"),
        F.col("s.telemetry.audience").alias("audience"),
        F.col("s.telemetry.isRelay").alias("is_relay"),
    )


def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A settings document per supplier, from the written files to the typed record."""
    balance = F.col("s_acctbal").cast("string")
    documents = load(spark, sf_dir, "supplier").select(
        F.concat(
            F.lit("# settings\nspark:\n  local: "),
            F.when(F.col("s_acctbal") < 5000, "true").otherwise("false"),
            F.lit("\n  driverCore: "), F.col("s_suppkey").cast("string"),
            F.lit('\n  driverMemory: "'), balance, F.lit('g"'),
            F.lit("\n  seedRootPath: file://{GIT_ROOT}/seed/"), F.col("s_nationkey").cast("string"),
            F.lit("\n  state:\n    storeProviderClass: "), "s_name",
            F.lit("\ntelemetry:\n  isRelay: yes"),
        ).alias("value")
    )
    path = scratch_path(spark, "settings-files")
    write_documents(documents, "value", path)
    read = settings_from_files(spark, path, {ROOT_PLACEHOLDER: "/repos/$1"}, several=True)
    return read.select(
        F.col("settings.driverCore").alias("s_suppkey"),
        F.col("settings.local").alias("is_local"),
        F.col("settings.driverMemory").alias("driver_memory"),
        F.col("settings.seedRootPath").alias("seed"),
        F.col("settings.metastoreRootPath").alias("metastore"),
        F.col("settings.storeProviderClass").alias("provider"),
        F.col("settings.telemetry.isRelay").alias("is_relay"),
    )


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per customer: injected from its nation, submitted from its orders, default of its own."""
    customer = load(spark, sf_dir, "customer")
    default = customer.select(
        F.col("c_custkey").alias("scope"),
        F.inline(F.array(
            F.struct(F.lit("segment").alias("key"), F.col("c_mktsegment").alias("value")),
            F.struct(F.lit("tier").alias("key"), F.lit("plain").alias("value")),
        )),
    )
    submitted = (
        load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("scope"))
        .agg(F.max("o_orderpriority").alias("top"), F.min("o_orderstatus").alias("status"))
        .select("scope", F.inline(F.array(
            F.struct(F.lit("tier").alias("key"), F.col("top").alias("value")),
            F.struct(F.lit("status").alias("key"), F.col("status").alias("value")),
        )))
    )
    nation = load(spark, sf_dir, "nation").where(F.col("n_regionkey") == 1)
    injected = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("scope"),
        F.inline(F.array(
            F.struct(F.lit("tier").alias("key"), F.col("n_name").alias("value")),
            F.struct(F.lit("nation").alias("key"), F.col("n_name").alias("value")),
        )),
    )
    return injected, submitted, default


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest value per customer and key; submitted-only keys vanish."""
    return merge_settings(*_layers(spark, sf_dir))


def key_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted settings whose key another layer names."""
    injected, submitted, default = _layers(spark, sf_dir)
    return restrict_keys(submitted, injected, default)


SETTINGS_BUCKETS = 8


def _bucketed_layers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The layers as bucketed tables; the catalog forgets them, their files stay."""
    tables = []
    for layer in _layers(spark, sf_dir):
        name = fresh_name("layer")
        tables.append(save_bucketed(
            layer, name, ["scope", "key"], SETTINGS_BUCKETS, scratch_path(spark, name)))
    return tables


def settings_merge_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``settings_merge`` over bucketed tables: no shuffle after they were written."""
    return merge_bucketed(*_bucketed_layers(spark, sf_dir))


def key_restriction_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key_restriction`` over bucketed tables."""
    injected, submitted, default = _bucketed_layers(spark, sf_dir)
    return restrict_bucketed(submitted, injected, default)


def runtime_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    cluster = (
        F.when(segment == "BUILDING", "synapse").when(segment == "MACHINERY", "trident")
        .when(segment == "FURNITURE", "xsynapse")
    )
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        runtime_of(F.col("c_acctbal") < 0, cluster, on_unknown="null").alias("runtime"),
    )


def name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts kept by name list or by a pattern found in the name."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return filter_names(parts, "p_name", match=["red widget", "blue bolt"], regex="(small (.*))$")


def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept by name list alone: the list reaches the scan."""
    events = load(spark, sf_dir, "events").select("event_id", "event_type")
    return filter_names(events, "event_type", match=["view", "purchase"])


QUERIES = {
    "placeholders": placeholders,
    "path_defaults": path_defaults,
    "settings_files": settings_files,
    "settings_merge": settings_merge,
    "key_restriction": key_restriction,
    "settings_merge_bucketed": settings_merge_bucketed,
    "key_restriction_bucketed": key_restriction_bucketed,
    "runtime_class": runtime_class,
    "name_filter": name_filter,
    "name_match": name_match,
}

_LAYERS_SQL = """
    WITH dflt AS (
        SELECT c_custkey AS scope, 'segment' AS key, c_mktsegment AS value FROM customer
        UNION ALL SELECT c_custkey, 'tier', 'plain' FROM customer
    ), submitted AS (
        SELECT o_custkey AS scope, 'tier' AS key, max(o_orderpriority) AS value
        FROM orders GROUP BY o_custkey
        UNION ALL SELECT o_custkey, 'status', min(o_orderstatus) FROM orders GROUP BY o_custkey
    ), home AS (
        SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE n_regionkey = 1
    ), injected AS (
        SELECT c_custkey AS scope, 'tier' AS key, n_name AS value FROM home
        UNION ALL SELECT c_custkey, 'nation', n_name FROM home
    ), named AS (
        SELECT scope, key FROM injected UNION SELECT scope, key FROM dflt
    )
"""

ORACLES = {
    "placeholders": """
        SELECT doc_id,
               CASE WHEN regexp_matches(content, 'local:\\s+true')
                    THEN replace(replace(content, '{GIT_ROOT}', '/repos/$1/' || source),
                                 '{RANDOM_STRING}',
                                 't-' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-'
                                 || h[17:20] || '-' || h[21:32])
                    ELSE content END AS content
        FROM (SELECT doc_id, source, md5(doc_id || ':r1') AS h,
                     'local: ' || CASE WHEN lang = 'en' THEN 'true' ELSE 'false' END || chr(10)
                     || 'root: file://{GIT_ROOT}/a' || chr(10)
                     || 'id: {RANDOM_STRING}' || chr(10)
                     || 'again: {RANDOM_STRING}' || chr(10) || text AS content
              FROM documents)
    """,
    "path_defaults": """
        SELECT event_id, value > 100 AS is_local, false AS is_debug,
               CAST(user_id AS INTEGER) AS driver_core,
               CASE WHEN event_type <> 'view' THEN user_id || 'g' END AS driver_memory,
               CAST(NULL AS INTEGER) AS executor_core,
               CASE WHEN event_type = 'error' THEN NULL
                    WHEN event_type = 'click' THEN '' ELSE 'm/' || event_id END AS metastore,
               'P' || user_id AS provider,
               event_type = 'view' AS has_secret, event_type = 'click' AS has_driver,
               CASE WHEN event_type IN ('view', 'click') THEN 'u/' || event_id ELSE '' END AS url,
               '' AS audience, event_type = 'signup' AS is_relay
        FROM events
    """,
    "settings_files": """
        SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_acctbal < 5000 AS is_local,
               s_acctbal || 'g' AS driver_memory,
               'file://' || CASE WHEN s_acctbal < 5000 THEN '/repos/$1' ELSE '{GIT_ROOT}' END
               || '/seed/' || s_nationkey AS seed,
               '' AS metastore, s_name AS provider, true AS is_relay
        FROM supplier
    """,
    "settings_merge": _LAYERS_SQL + """
        SELECT scope, key, value FROM (
            SELECT scope, key, value,
                   row_number() OVER (PARTITION BY scope, key ORDER BY priority) AS rn
            FROM (SELECT 1 AS priority, * FROM injected
                  UNION ALL SELECT 2, * FROM submitted
                  UNION ALL SELECT 3, * FROM dflt)
            WHERE (scope, key) IN (SELECT (scope, key) FROM named)
        ) WHERE rn = 1
    """,
    "key_restriction": _LAYERS_SQL + """
        SELECT s.scope, s.key, s.value FROM submitted s
        WHERE EXISTS (SELECT 1 FROM named n WHERE n.scope = s.scope AND n.key = s.key)
    """,
    "runtime_class": """
        SELECT c_custkey,
               CASE WHEN c_acctbal < 0 THEN 'devcontainer'
                    WHEN c_mktsegment = 'BUILDING' THEN 'synapse'
                    WHEN c_mktsegment = 'MACHINERY' THEN 'fabric' END AS runtime
        FROM customer
    """,
    "name_filter": """
        SELECT p_partkey, p_name FROM part
        WHERE p_name IN ('red widget', 'blue bolt') OR regexp_matches(p_name, '(small (.*))$')
    """,
    "name_match": """
        SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'purchase')
    """,
}

# Other layouts of the same tables give the same rows.
ORACLES |= {f"{name}_bucketed": ORACLES[name] for name in ("settings_merge", "key_restriction")}
