"""Personal data against the contract's patterns, and disguises against where they were put."""

import hashlib
import random
import re

import pytest

from tidemark.llm.identifiers import DETECTORS, Edit, Rewritten, find_identifiers, find_spans
from tidemark.llm.query_identifiers import op13_identifiers

SF = "/root/testdata/sf0.01"

# The patterns of the query's contract.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = "".join(c for c in match.group() if c in "0123456789")
            good = {"email": True, "ip": all(int(p) <= 255 for p in match.group().split(".")) if kind == "ip" else 0,
                    "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                found.append((kind, *match.span()))
    return found


def base(text):
    return [one[:3] for one in find_spans(text) if one.plain]


def added(text):
    return [(one.kind, text[one.start:one.stop]) for one in find_spans(text) if not one.plain]


def with_check_digit(rng, size):
    digits = "".join(rng.choice("0123456789") for _ in range(size - 1))
    return next(digits + last for last in "0123456789" if plain_luhn(digits + last))


@pytest.mark.parametrize("seed", range(40))
def test_plain_spans_of_random_texts(seed):
    rng = random.Random(seed)
    pieces = ["a", "b.c", "@", "@", ".", "-", " ", "  ", "+", "+1", "12", "255", "256", "007", "1.2.3.4", "é", "\n", "(", ")",
              "a@b.co", "%", "_", "4111 1111 1111 1111", "4111-1111", "+1 (555) 123-4567", "x" * 30, "٣", "\u200b"]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40)))
        assert base(text) == plain(text), text
        digits = "".join(rng.choice("0123456789 -.") for _ in range(200))
        assert base(digits) == plain(digits), digits
        card = with_check_digit(rng, rng.choice([15, 16, 17, 19, 20]))
        assert base(f"é {card}.") == plain(f"é {card}.")


def test_given_texts(spark):
    for row in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert base(row["text"] or "") == plain(row["text"] or "")


@pytest.mark.parametrize("text, kind", [
    ("jane.doe [at] example.com", "email"), ("jane.doe (AT) example (dot) com", "email"),
    ("jane@example[.]com", "email"), ("jane.doe at example dot com", "email"),
    ("jane at mail dot example dot co dot uk", "email"), ("jane arobase exemple point fr", "email"),
    ("jane_at_example_dot_org", "email"), ("jane @ example.com", "email"), ("jane＠example．com", "email"),
    ("jаne@exаmple.com", "email"), ("ja\u200bne@exam\u00adple.com", "email"), ("jane@example dot com", "email"),
    ("192[.]168[.]0[.]1", "ip"), ("192 dot 168 dot 0 dot 1", "ip"), ("１９２.１６８.０.１", "ip"),
    ("one nine two dot one six eight dot zero dot one", "ip"), ("١٩٢.168.0.1", "ip"),
    ("4111\u00a01111\u00a01111\u00a01111", "card"), ("4111–1111–1111–1111", "card"), ("4l11 1111 1111 1111", "card"),
    ("four one one one, one one one one, one one one one, one one one one", "card"),
    ("vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card"),
    ("4111 1111 1111 \u200b1111", "card"), ("four triple one four times one".replace("four times one", "one") + " one" * 11, "card"),
    ("+１ 555 123 4567", "phone"), ("plus one five five five double two three four five six", "phone"),
    ("+49 30 1234\u2011567", "phone"), ("más uno".replace("más uno", "+1") + " 555–123–4567", "phone"),
])
def test_disguises(text, kind):
    assert added(text) == [(kind, text)]
    # The span is that of the source, wherever it stands.
    around = f"é\u200b𝔘 vor {text} nach ü\u200b"
    at = around.index(text)
    spans = [one for one in find_spans(around) if not one.plain]
    assert [(one.kind, one.start, one.stop) for one in spans] == [(kind, at, at + len(text))]


@pytest.mark.parametrize("text", [
    "Meet me at noon. At home we look at dots.", "look at example.com", "meet at noon dot dot", "one two three four five",
    "point final", "a (at) b", "see jane@", "192.168.0", "on the dot at ten", "write to me at 5 point",
    "fifty-one one-off two-faced three", "one point one", "Un deux trois, nous irons au bois", "x²y³ 1234567890123456²",
])
def test_everyday_language(text):
    assert added(text) == []


def test_plain_spans_stay():
    text = "mail jane@example.com dot We"
    assert base(text) == plain(text) and added(text) == []
    text = "user@mail.exаmple.com"
    assert base(text) == plain(text) == [("email", 0, 12)]
    assert added(text) == [("email", text)]
    text = "a@b.co 1.2.3.4 jane (at) c.de"
    assert base(text) == plain(text) and added(text) == [("email", "jane (at) c.de")]


def test_rewriting_maps_back():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(chr(97 + rng.randrange(26)) for _ in range(30))
        cuts = sorted(rng.sample(range(30), 6))
        edits = [Edit(a, b, rng.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2])]
        made = Rewritten(text, edits)
        origin = []
        done = 0
        for a, b, out in edits:
            origin += [(i, i + 1) for i in range(done, a)] + [(a, b)] * len(out)
            done = b
        origin += [(i, i + 1) for i in range(done, 30)]
        assert len(origin) == len(made.text)
        for start in range(len(origin)):
            for stop in range(start + 1, len(origin) + 1):
                assert made.source(start, stop) == (origin[start][0], origin[stop - 1][1])


def test_rows(spark):
    texts = [None, "", "a@b.co", "x" * 300_000 + " jane [at] example.com " + "1" * 300_000, "𝔘 +1 555 123 4567",
             "1." * 50_000, "@" * 100_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(2, "a@b.co", "t"), (None, "1.2.3.4", "t")],
                               "doc_id long, text string, spans string")
    rows = find_identifiers(df).collect()
    assert len(rows) == len(texts) + 2
    for row in rows:
        text = "1.2.3.4" if row["id"] is None else texts[row["id"]] or ""
        assert [tuple(one) for one in row["spans"]] == [tuple(one) for one in find_spans(text)]
    assert [len(row["spans"]) for row in rows] == [0, 0, 1, 1, 1, 12_500, 0, 1, 1]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_identifiers(none).collect() == []


def test_query(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_identifiers(spark, SF).collect()
    assert len(rows) == len(docs)
    for row in rows:
        spans = plain(docs[row["doc_id"]])
        assert [row[f"n_{kind}"] for kind in DETECTORS] == [sum(s[0] == kind for s in spans) for kind in PATTERNS]
        told = ",".join(f"{kind}:{start}:{stop}" for kind, start, stop in spans)
        assert row["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(row["spans"].split(","))
    assert sum(row["n_email"] > 0 for row in rows) > 5
