"""Typed and dynamic reading of JSON and YAML columns."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
)

from shapes import EXPECTED, LOWEST_INT, driver_shape, yaml_payload
from tidemark.functions.lookup import lookup, named_block
from tidemark.functions.schema import field, record
from tidemark.session import scratch_path
from tidemark.operators.documents import (
    read_json,
    read_json_record,
    read_yaml,
    read_yaml_record,
    split_bad,
    split_bad_written,
)

EXTRA_KEY = "  spare: part\n"
EXTRA_BLOCK = "trailer:\n  axle:\n    count: two\n"

# Which policies accept and refuse which documents.
# payload, case-insensitive allowed, undeclared keys allowed, fails
YAML_CASES = [
    (yaml_payload(), False, False, False),
    (yaml_payload("SomeDriver"), False, False, True),
    (yaml_payload("SomeDriver"), True, False, False),
    (yaml_payload(languages="SupportedLanguages"), False, False, True),
    (yaml_payload(languages="SupportedLanguages"), True, False, False),
    (yaml_payload(inside=EXTRA_KEY), False, False, True),
    (yaml_payload(inside=EXTRA_KEY), False, True, False),
    (yaml_payload("SomeDriver", inside=EXTRA_KEY), False, False, True),
    (yaml_payload("SomeDriver", inside=EXTRA_KEY), True, True, False),
    (yaml_payload(languages="SupportedLanguages", inside=EXTRA_KEY), False, False, True),
    (yaml_payload(languages="SupportedLanguages", inside=EXTRA_KEY), True, True, False),
    (yaml_payload(languages="SupportedLanguages", inside=EXTRA_KEY, after=EXTRA_BLOCK), False, False, True),
    (yaml_payload(languages="SupportedLanguages", inside=EXTRA_KEY, after=EXTRA_BLOCK), True, True, False),
]


def texts(spark, *payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")


def value(df):
    return df.select("doc").first()["doc"].asDict(recursive=True)


@pytest.mark.parametrize("case", range(len(YAML_CASES)))
def test_yaml_record(spark, case):
    payload, fold, foreign, fails = YAML_CASES[case]
    read = read_yaml_record(
        texts(spark, payload), "payload", driver_shape("someDriver"),
        case_insensitive=fold, allow_foreign=foreign,
    )
    if fails:
        with pytest.raises(PySparkException, match="Failed to read"):
            read.collect()
    else:
        assert value(read) == {"someDriver": EXPECTED}


JSON_CASES = [
    ({"driver": EXPECTED}, False, True, False),
    ({"Driver": EXPECTED}, True, True, True),
    ({"driver": {**EXPECTED, "axle": "two"}}, False, True, False),
    ({"driver": {**EXPECTED, "axle": "two"}}, False, False, True),
]


@pytest.mark.parametrize("case", range(len(JSON_CASES)))
def test_json_record(spark, case):
    payload, fold, foreign, refused = JSON_CASES[case]
    df = texts(spark, json.dumps(payload))
    arguments = dict(case_insensitive=fold, allow_foreign=foreign)
    if refused:
        with pytest.raises(ValueError):
            read_json_record(df, "payload", driver_shape("driver"), **arguments)
    else:
        read = read_json_record(df, "payload", driver_shape("driver"), **arguments)
        assert value(read) == {"driver": EXPECTED}


def test_dynamic_forms_hold_the_same_values(spark):
    from_yaml = read_yaml(texts(spark, yaml_payload()), "payload")
    from_json = read_json(texts(spark, json.dumps({"someDriver": EXPECTED})), "payload")
    for read in (from_yaml, from_json):
        text = read.select(F.col("doc").cast("string").alias("t")).first()["t"]
        assert json.loads(text) == {"someDriver": EXPECTED}
        doc = F.col("doc")
        row = read.select(
            lookup(doc, "someDriver.engine.default", "string"),
            lookup(doc, "someDriver.engine.maxThreads", "int"),
            lookup(doc, "someDriver.engine.isEnabled", "boolean"),
            F.variant_get(doc, "$.someDriver.engine.versions", "array<double>"),
            F.variant_get(doc, "$.someDriver.graphics.colorDepths", "array<int>"),
        ).first()
        assert tuple(row) == ("steam", 6, True, [0.5, 3.25], [8, 16, 30])


SMALL = record(
    field("a", IntegerType(), default=7),
    field("b", StringType(), default="none"),
    field("c", record(field("d", ArrayType(LongType()), default=[]))),
)


def quarantined(read):
    return [
        (r["doc"].asDict(recursive=True) if r["doc"] is not None else None, r["doc_error"])
        for r in read.orderBy("id").collect()
    ]


def test_json_gaps_nulls_and_bad_records(spark):
    df = texts(
        spark, "{}", '{"a": null, "b": null, "c": null}', '{"a": "8"}', "{bad", "[1]", "3", "", None,
        '{"A": 1}', '{"a": 1, "a": 2}', "{'a': 1}", '{"c": {"d": [1, "x"]}}', '{"b": 1.50}',
    )
    got = quarantined(read_json_record(df, "payload", SMALL, on_error="quarantine"))
    blank = {"a": 7, "b": "none", "c": {"d": []}}
    assert got[0] == got[1] == got[8] == (blank, None)
    for bad in (2, 3, 4, 5, 6, 7, 10, 11):
        assert got[bad][0] is None and got[bad][1], bad
    assert got[7][1] == "no document"
    assert got[9][0]["a"] == 2
    assert got[12][0]["b"] == "1.5"


def test_json_dynamic_bad_records_and_repeated_keys(spark):
    df = texts(spark, '{"a": {"b": 1, "b": 2}}', "[1]", '"x"', "{", None, "", ' \n {"a": {}}')
    read = read_json(df, "payload", on_error="quarantine")
    rows = read.select(
        "id", F.col("doc").cast("string").alias("t"), "doc_error"
    ).orderBy("id").collect()
    assert [r["t"] for r in rows] == ['{"a":{"b":2}}'] + [None] * 5 + ['{"a":{}}']
    assert [r["doc_error"] is None for r in rows] == [True] + [False] * 5 + [True]
    with pytest.raises(PySparkException, match=r"Failed to read payload of id 1 \(3 characters\)"):
        read_json(df.where("id = 1"), "payload", key="id").collect()
    with pytest.raises(PySparkException, match=r"Failed to read payload \(\[1\]\)"):
        read_json(df.where("id = 1"), "payload", on_error="lazy", show_payload=True).collect()
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


def test_split_bad_loses_no_row(spark):
    df = texts(spark, '{"a": 1}', "{", '{"a": 2}', None)
    good, bad = split_bad(
        read_json_record(df, "payload", SMALL, on_error="quarantine"), "payload"
    )
    assert [r["doc"]["a"] for r in good.orderBy("id").collect()] == [1, 2]
    assert bad.columns == ["payload", "reason"]
    assert {r["payload"] for r in bad.collect()} == {"{", None}


def test_split_bad_written_parses_once(spark, capsys):
    texts = ['{"a": 1}', None, '{"a": 1} x', '{"a": [{}]}', "[]", "", '{"a": 1}', '{"a": 2']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    read = read_json(df, "text", on_error="quarantine")
    shape = record(field("a", StringType()))
    for one in (read, read_json_record(df, "text", shape, on_error="quarantine")):
        good, bad = split_bad_written(one, "text", scratch_path(spark, "split"))
        twice = split_bad(one, "text")
        for got, want in zip((good, bad), twice):
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            got.explain()
            assert "json" not in capsys.readouterr().out.replace('json"', "")
    none, _ = split_bad_written(read.where("false"), "text", scratch_path(spark, "split"))
    assert none.collect() == []



@pytest.mark.parametrize("text, expected", [
    ("a: 0x1F", 31), ("a: 0b11", 3), ("a: 017", 15), ("a: 1_000", 1000), ("a: -5", -5),
    ("a: '8'", 8), ("a: 1:30", 90), ("a: +0", 0), ("a: 2147483647", 2147483647), ("a:", 7),
    ("a: ~", 7), ("a: 2147483648", None), ("a: 1.0", None), ("a: x", None), ("a: [1]", None),
    ("a: {x: 1}", None),
])
def test_yaml_integers(spark, text, expected):
    [(doc, error)] = quarantined(
        read_yaml_record(texts(spark, text), "payload", SMALL, on_error="quarantine")
    )
    assert (doc["a"] if doc else None) == expected
    assert error == (None if expected is not None else "a is not int")


def test_yaml_keys_with_dots_are_no_paths(spark):
    df = texts(spark, "c.d: [1]", "c: {d: [1]}", "c.d: {e: 1}\nx: {y: [{z: 1}]}")
    got = quarantined(
        read_yaml_record(df, "payload", SMALL, allow_foreign=False, on_error="quarantine")
    )
    assert got[0] == (None, "undeclared key c\\.d")
    assert got[1][0]["c"] == {"d": [1]}
    assert got[2] == (None, "undeclared key c\\.d, x")


def test_fields_that_differ_only_in_case(spark):
    shape = record(field("a", StringType()), field("A", StringType()))
    with pytest.raises(ValueError):
        read_yaml_record(texts(spark, "a: 1"), "payload", shape)


def test_yaml_other_scalars(spark):
    shape = record(
        field("s", StringType()), field("t", StringType()), field("f", DoubleType()),
        field("g", DoubleType()), field("y", BooleanType()), field("n", BooleanType()),
    )
    text = "s: 1.10\nt: yes\nf: 1e3\ng: -.inf\ny: On\nn: 'NO'\n"
    assert value(read_yaml_record(texts(spark, text), "payload", shape)) == {
        "s": "1.10", "t": "yes", "f": 1000.0, "g": float("-inf"), "y": True, "n": False,
    }
    for wrong in ("f: 1d", "f: Infinity", "y: t", "y: 1", "s: [1]", "s: {a: 1}"):
        [(doc, error)] = quarantined(
            read_yaml_record(texts(spark, wrong), "payload", shape, on_error="quarantine")
        )
        assert doc is None and error, wrong


def test_yaml_text_that_looks_like_json_stays_text(spark):
    text = "b: '{\"x\": 1}'\nc: '{\"d\": [1]}'\n"
    [(doc, error)] = quarantined(
        read_yaml_record(texts(spark, text), "payload", SMALL, on_error="quarantine")
    )
    assert doc is None and error == "not a document of the declared shape"
    [(doc, _)] = quarantined(
        read_yaml_record(texts(spark, "b: '{\"x\": 1}'"), "payload", SMALL, on_error="quarantine")
    )
    assert doc["b"] == '{"x": 1}'


def test_yaml_last_matching_key_counts(spark):
    read = read_yaml_record(
        texts(spark, "b: one\nB: two\n", "B: two\nb: one\n", "b: one\nB: two\nb: three\n"),
        "payload", SMALL, on_error="quarantine",
    )
    assert [doc["b"] for doc, _ in quarantined(read)] == ["two", "one", "three"]


def test_yaml_documents_that_are_not_mappings(spark):
    df = texts(spark, "", "# nothing\n", "~", "- 1\n", "word", "a: [", "a: !x 1", "a: 1\n---\na: 2\n", None)
    for read in (
        read_yaml_record(df, "payload", SMALL, on_error="quarantine"),
        read_yaml(df, "payload", on_error="quarantine"),
    ):
        rows = read.select("id", F.col("doc").isNull().alias("e"), "doc_error").orderBy("id").collect()
        assert all(r["e"] for r in rows)
        assert [r["doc_error"] is None for r in rows] == [True] * 3 + [False] * 6


def test_yaml_aliases_merges_and_bounds(spark):
    merged = "base: &b {x: 1, y: 2}\nuse:\n  <<: *b\n  y: 3\n"
    nest = "a: &a [x]\n" + "".join(
        f"{chr(98 + i)}: &{chr(98 + i)} [{', '.join(['*' + chr(97 + i)] * 9)}]\n" for i in range(9)
    )
    loop = "a: &a\n  b: *a\n"
    dynamic = "d: 2020-01-02\nn: 012\ni: .inf\nt: {1: one, true: yes}\n"
    df = texts(spark, merged, nest, loop, dynamic)
    rows = read_yaml(df, "payload", on_error="quarantine").select(
        "id", F.col("doc").cast("string").alias("t"), "doc_error"
    ).orderBy("id").collect()
    assert json.loads(rows[0]["t"])["use"] == {"x": 1, "y": 3}
    assert "stand for over" in rows[1]["doc_error"]
    assert "stands inside what it names" in rows[2]["doc_error"]
    assert json.loads(rows[3]["t"]) == {
        "d": "2020-01-02", "n": 10, "i": ".inf", "t": {"1": "one", "true": True},
    }


def test_one_alias_to_many_mappings_and_many_to_one(spark):
    many = "a: &a\n" + "".join(f"  k{i}: {{n: {i}}}\n" for i in range(60)) + "b: *a\n"
    often = "a: &a {n: 1}\n" + "".join(f"b{i}: *a\n" for i in range(60))
    lists = "a: &a [{n: 1}, {m: [{k: 1}]}]\nb: {c: *a}\n"
    rows = read_yaml(texts(spark, many, often, lists), "payload").orderBy("id")
    docs = [json.loads(r["t"]) for r in rows.select(F.col("doc").cast("string").alias("t")).collect()]
    assert docs[0]["a"] == docs[0]["b"] and len(docs[0]["b"]) == 60
    assert docs[1]["b59"] == {"n": 1} and len(docs[1]) == 61
    read = read_yaml_record(texts(spark, lists, often), "payload", record(field("x", StringType())),
                            allow_foreign=False, on_error="quarantine")
    reasons = [reason for _, reason in quarantined(read)]
    assert reasons[0] == "undeclared key a, b"
    inner = record(field("a", ArrayType(record(field("n", IntegerType())))),
                   field("b", record(field("c", ArrayType(record(field("n", IntegerType())))))))
    read = read_yaml_record(texts(spark, lists), "payload", inner, allow_foreign=False, on_error="quarantine")
    assert quarantined(read)[0][1] == "undeclared key a[].m, b.c[].m"


@pytest.mark.parametrize("text, number", [
    ("0x" + "0" * 70 + "1F", 31), ("0b" + "0" * 70 + "101", 5), ("0" * 70 + "17", 15), ("0x0", 0),
    ("1000000:00", 60_000_000), ("1:0:0:0:0:0", 60 ** 5), ("-1:30", -90), ("-0x10", -16), ("+017", 15),
    ("0x7fffffffffffffff", 2 ** 63 - 1), ("-0x8000000000000000", -2 ** 63),
    ("0777777777777777777777", 2 ** 63 - 1), ("-01000000000000000000000", -2 ** 63),
    ("-2562047788015215:30:08", -2 ** 63),
    ("0x8000000000000000", None), ("0x1ffffffffffffffff", None), ("0b1" + "0" * 64, None),
    ("07777777777777777777777", None), ("010000000000000000000000", None), ("-0xffffffffffffffffffff", None),
    ("2562047788015215:30:08", None), ("9" * 40 + ":00", None), ("9223372036854775808", None), ("1:60", None),
])
def test_yaml_integers_are_exact_or_refused(spark, text, number):
    read = read_yaml_record(texts(spark, f"n: {text}"), "payload", record(field("n", LongType())),
                            on_error="quarantine")
    doc, reason = quarantined(read)[0]
    assert (doc, reason) == (({"n": number}, None) if number is not None else (None, "n is not bigint"))


BAD = ['{"k": 1} garbage', '{"k": 1}{"k": 2}', '{"k": 1},{"k": 2}', '{"k": 1}] x [{}', '{"k": 1}}',
       '{"k": 1},"second":0} x', '{"k": 1}]', '{"k": 1} , ']
GOOD = ['{"k": 1}', ' {"k": 1}\n\t ', '{"k": 1, "l": [{"m": 2}]}', '{"k": 1, "s": "} ] x"}', '{"k": 1, "l": [[{}]]}']


def test_text_after_the_object_is_bad(spark):
    df = texts(spark, *BAD, *GOOD)
    shape = record(field("k", LongType()))
    for read in (read_json(df, "payload", on_error="quarantine"),
                 read_json_record(df, "payload", shape, on_error="quarantine")):
        reasons = [r["doc_error"] for r in read.orderBy("id").collect()]
        assert all(reasons[:len(BAD)]) and reasons[len(BAD):] == [None] * len(GOOD)


def test_fail_mode_does_not_depend_on_what_is_used(spark):
    shape = record(field("k", LongType()))
    readers = (
        lambda df, mode: read_json(df, "payload", on_error=mode),
        lambda df, mode: read_json_record(df, "payload", shape, on_error=mode),
        lambda df, mode: read_yaml_record(df, "payload", shape, on_error=mode),
    )
    for reader in readers:
        bad = texts(spark, '{"k": 1}', '{"k": [')
        for use in (lambda df: df.select("id").collect(), lambda df: df.count()):
            with pytest.raises(PySparkException, match="Failed to read"):
                use(reader(bad, "fail"))
            use(reader(bad, "lazy"))
        plan = reader(bad, "fail")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") <= 1 and plan.count("parseJson(") <= 1


def test_yaml_null_and_merge_in_a_record(spark):
    df = texts(
        spark, "a: null\nb: 'null'", "a: ~\nb: ''", "x: &x {d: [1]}\nc: {<<: *x}",
        "x: &x {a: 1, b: y}\n<<: *x\nb: z",
    )
    docs = [doc for doc, _ in quarantined(read_yaml_record(df, "payload", SMALL, on_error="quarantine"))]
    assert (docs[0]["a"], docs[0]["b"]) == (7, "null")
    assert (docs[1]["a"], docs[1]["b"]) == (7, "")
    assert docs[2]["c"] == {"d": [1]}
    assert (docs[3]["a"], docs[3]["b"]) == (1, "z")


def test_yaml_arrays_of_records(spark):
    shape = record(field("items", ArrayType(record(
        field("name", StringType(), default="?"),
        field("sizes", ArrayType(IntegerType()), default=[]),
    )), default=[]))
    text = "items:\n  - {NAME: a, sizes: [1, 2]}\n  - {sizes: [3]}\n  - {}\n"
    df = texts(spark, text, "items: []", "{}", "items: [{name: a, sizes: [x]}]", "items: [{nam: a}]")
    got = quarantined(
        read_yaml_record(df, "payload", shape, allow_foreign=False, on_error="quarantine")
    )
    assert got[0] == ({"items": [
        {"name": "a", "sizes": [1, 2]}, {"name": "?", "sizes": [3]}, {"name": "?", "sizes": []},
    ]}, None)
    assert got[1] == got[2] == ({"items": []}, None)
    assert got[3] == (None, "items[].sizes[] is not int")
    assert got[4] == (None, "undeclared key items[].nam")


def test_yaml_defaults_of_a_missing_tree(spark):
    doc = value(read_yaml_record(texts(spark, "x: 1"), "payload", driver_shape("someDriver")))
    engine = doc["someDriver"]["engine"]
    assert engine == {
        "default": None, "versions": [], "supportedLanguages": [],
        "maxThreads": LOWEST_INT, "isEnabled": False,
    }


def test_yaml_long_text_is_kept_whole(spark):
    body = "word " * 50_000
    doc = value(read_yaml_record(texts(spark, "b: >-\n  " + body.strip()), "payload", SMALL))
    assert doc["b"] == body.strip()


def test_undeclarable_types_are_refused(spark):
    shape = record(field("m", MapType(StringType(), StringType())))
    with pytest.raises(TypeError):
        read_yaml_record(texts(spark, "m: {}"), "payload", shape)
    with pytest.raises(ValueError):
        read_yaml(texts(spark, "m: {}"), "payload", on_error="ignore")


def test_lookup_tells_absent_null_and_wrong_apart(spark):
    df = texts(spark, '{"x": {"s": "v", "b": true, "i": 3}}', '{"x": {"s": null, "b": null, "i": null}}',
               "{}", '{"x": null}', '{"x": {"s": 1, "b": "true", "i": "3"}}')
    doc = F.col("doc")
    read = read_json(df, "payload")
    plain = [lookup(doc, f"x.{n}", k, strict=False).alias(n)
             for n, k in (("s", "string"), ("b", "boolean"), ("i", "int"))]
    assert [tuple(r) for r in read.orderBy("id").select(*plain).collect()] == [
        ("v", True, 3), (None, False, None), (None, False, None), (None, False, None),
        (None, False, None),
    ]
    defaulted = lookup(doc, "x.s", "string", default="d", strict=False)
    assert [r[0] for r in read.orderBy("id").select(defaulted).collect()] == [
        "v", None, "d", "d", None,
    ]
    for name, kind in (("s", "string"), ("b", "boolean"), ("i", "int")):
        with pytest.raises(PySparkException, match=f"x.{name} is not {kind}"):
            read.where("id = 4").select(lookup(doc, f"x.{name}", kind)).collect()
    with pytest.raises(PySparkException, match="INVALID_VARIANT_CAST"):
        read_json(texts(spark, '{"n": 3000000000}'), "payload").select(
            lookup(doc, "n", "int")
        ).collect()


def test_named_block(spark):
    df = read_json(texts(spark, '{"job": {"n": 1}}'), "payload").withColumn("name", F.lit("job"))
    row = df.select(
        named_block(F.col("doc"), "job").cast("string"),
        named_block(F.col("doc"), F.col("name")).cast("string"),
        named_block(F.col("doc"), "other").cast("string"),
        named_block(F.col("doc"), None).cast("string"),
    ).first()
    assert tuple(row) == ('{"n":1}', '{"n":1}', None, None)


def test_json_record_is_one_native_parse(spark, capsys):
    read = read_json_record(texts(spark, "{}"), "payload", SMALL).select("doc.a", "doc.c")
    read.explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("from_json") == 1 and "EvalPython" not in plan


def test_yaml_batches_are_converted_in_slices(monkeypatch):
    import pyarrow as pa

    import tidemark.functions.yaml_text as yaml_text

    monkeypatch.setattr(yaml_text, "SLICE_BYTES", 1000)
    monkeypatch.setattr(yaml_text, "KNOWN_BYTES", 6400)
    texts = [None, "a: 1", "b: " + "x" * 3000, "", "a: 1", "a: ["] + [f"n: {at}" for at in range(900)] * 2
    parts = list(yaml_text._slices(pa.array(texts)))
    assert [one for part in parts for one in part.to_pylist()] == texts
    assert all(sum(len(one or "") for one in part.to_pylist()) <= 1000 or len(part) == 1 for part in parts)
    converter = yaml_text._Converter(yaml_text.Form(marked=False))
    found = [row for part in parts for row in converter.convert(part).to_pylist()]
    assert [row["json"] for row in found[:5]] == [None, '{"a": 1}', json.dumps({"b": "x" * 3000}), None, '{"a": 1}']
    assert found[5]["error"].startswith("ParserError")
    assert [row["json"] for row in found[6:]] == [f'{{"n": {at}}}' for at in range(900)] * 2
    assert converter.size <= 6400 and len(converter.known) < 900
    assert list(map(len, yaml_text._slices(pa.array([], pa.string())))) == [0]


def test_a_batch_of_several_slices_keeps_its_rows(spark):
    body = F.concat(F.lit("n: "), F.col("id").cast("string"), F.lit("\nt: " + "x" * 2000))
    rows = spark.range(0, 2000, numPartitions=1).withColumn("y", body)
    shape = record(field("n", LongType()), field("t", StringType()))
    found = read_yaml_record(rows, "y", shape, allow_foreign=False).select("id", "doc.n", F.length("doc.t").alias("l"))
    assert {(r["id"], r["n"], r["l"]) for r in found.collect()} == {(at, at, 2000) for at in range(2000)}
