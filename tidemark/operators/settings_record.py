"""The typed settings record of a settings document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lookup import named_block, typed

# The fields of a settings document, their types, and the default of
# those that have one.
FIELDS = {
    "spark": {
        "local": ("boolean", None),
        "debug": ("boolean", None),
        "ui": ("boolean", None),
        "offHeapEnabled": ("boolean", None),
        "driverCore": ("int", None),
        "driverMemory": ("string", None),
        "executorCore": ("int", None),
        "executorMemory": ("string", None),
        "offHeapMemory": ("string", None),
        "shufflePartitions": ("int", None),
        "warehouseRootPath": ("string", None),
        "checkpointsRootPath": ("string", None),
        "seedRootPath": ("string", None),
        "metastoreRootPath": ("string", ""),
    },
    "spark.state": {"storeProviderClass": ("string", None)},
    "telemetry": {
        "url": ("string", ""),
        "audience": ("string", ""),
        "isRelay": ("boolean", False),
    },
}
OPTIONAL_BLOCKS = ("secret", "tokenCredential")

# (type, default) → the (block, name) pairs that share them.
GROUPS: dict[tuple[str, object], list[tuple[str, str]]] = {}
for _block, _fields in FIELDS.items():
    for _name, _rule in _fields.items():
        GROUPS.setdefault(_rule, []).append((_block, _name))


def _variants(*names: str) -> list[str]:
    return [f"`{name}` variant" for name in names]


def _frame_type() -> str:
    """The document as a struct with undecided leaves."""
    state = f"`state` struct<{', '.join(_variants(*FIELDS['spark.state']))}>"
    spark = ", ".join([*_variants(*FIELDS["spark"]), state])
    telemetry = ", ".join(_variants(*FIELDS["telemetry"]))
    return (
        f"struct<`spark` struct<{spark}>, `telemetry` struct<{telemetry}>, "
        f"{', '.join(_variants(*OPTIONAL_BLOCKS))}>"
    )


def _missing(path: str) -> Column:
    return F.raise_error(F.lit(f"missing block {path}")).isNull()


def read_settings(
    df: DataFrame,
    column: str,
    into: str = "settings",
    driver: Column | str | None = None,
    strict: bool = True,
) -> DataFrame:
    """Add the settings record of the document (a VARIANT) in ``column``.

    The document is taken apart once; the leaves are then typed one by one. The
    ``spark`` block and its ``state`` are required when ``strict``; the blocks
    that may be missing stay variants.
    """
    frame = F.col("__frame")
    framed = df.withColumn("__frame", F.try_variant_get(column, "$", _frame_type()))
    if strict:
        complete = (
            F.when(F.col(column).isNull(), True)
            .when(frame["spark"].isNull(), _missing("spark"))
            .when(frame["spark"]["state"].isNull(), _missing("spark.state"))
            .otherwise(True)
        )
        framed = framed.withColumn("__frame", F.when(complete, frame))
    blocks = {"spark": frame["spark"], "spark.state": frame["spark"]["state"],
              "telemetry": frame["telemetry"]}
    grouped = framed.withColumns({
        f"__group{i}": _read_group(members, blocks, kind, default, strict)
        for i, ((kind, default), members) in enumerate(GROUPS.items())
    })

    def settings_of(block: str) -> list[Column]:
        return [
            F.get(f"__group{i}", position).alias(name)
            for i, members in enumerate(GROUPS.values())
            for position, (owner, name) in enumerate(members)
            if owner == block
        ]

    record = F.struct(
        *settings_of("spark"),
        *settings_of("spark.state"),
        *[frame[block].alias(block) for block in OPTIONAL_BLOCKS],
        named_block(F.col(column), driver).alias("driver"),
        F.struct(*settings_of("telemetry")).alias("telemetry"),
    )
    return grouped.withColumn(into, F.when(F.col(column).isNotNull(), record)).drop(
        "__frame", *[f"__group{i}" for i in range(len(GROUPS))]
    )


def _read_group(
    members: list[tuple[str, str]], blocks: dict, kind: str, default: object, strict: bool
) -> Column:
    """All leaves of one type and default, read by one expression.

    A copy of the expression per leaf would make generated code too long for
    the JVM to compile.
    """
    options = {} if default is None else {"default": default}
    leaves = F.array(*[blocks[block][name] for block, name in members])
    paths = F.array(*[F.lit(f"{block}.{name}") for block, name in members])
    return F.transform(
        leaves, lambda leaf, i: typed(leaf, F.get(paths, i), kind, strict=strict, **options)
    )
