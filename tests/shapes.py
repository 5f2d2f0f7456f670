"""The driver-settings record the document tests read, and its payloads."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
)

from tidemark.functions.schema import field, record

# The record and its defaults.
LOWEST_INT = -2147313631


def driver_shape(root: str):
    engine = record(
        field("default", StringType()),
        field("versions", ArrayType(DoubleType()), default=[]),
        field("supportedLanguages", ArrayType(StringType()), default=[]),
        field("maxThreads", IntegerType(), default=LOWEST_INT),
        field("isEnabled", BooleanType(), default=False),
    )
    graphics = record(
        field("fontHeight", IntegerType(), default=LOWEST_INT),
        field("resolutions", ArrayType(IntegerType()), default=[]),
        field("colorDepths", ArrayType(IntegerType()), default=[]),
        field("isFullScreen", BooleanType(), default=False),
    )
    return record(field(root, record(field("engine", engine), field("graphics", graphics))))


EXPECTED = {
    "engine": {
        "default": "steam",
        "versions": [0.5, 3.25],
        "supportedLanguages": ["Basic", "Forth"],
        "maxThreads": 6,
        "isEnabled": True,
    },
    "graphics": {
        "fontHeight": 31,
        "resolutions": [640, 480],
        "colorDepths": [8, 16, 30],
        "isFullScreen": False,
    },
}


def yaml_payload(root="someDriver", languages="supportedLanguages", inside="", after=""):
    return f"""{root}:     # a comment
  engine:
    default: steam
    versions: [0.5, 3.25]
    {languages}: ["Basic", "Forth"]
    maxThreads: 6
    isEnabled: true
  graphics:
    fontHeight: 31
    resolutions: [640, 480]
    colorDepths: [8, 16, 30]
    isFullScreen: false
{inside}{after}"""
