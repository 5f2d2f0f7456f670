"""Licence scans against brute force."""

import random
import re

import pytest

from tidemark.llm.licence_scan import Automaton, LEAST_RUN, Template, scan, scan_licences
from tidemark.llm.query_licences import PHRASES, TEMPLATES


def words_of(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_places(words, phrases):
    found = []
    for number, phrase in enumerate(phrases):
        own = words_of(phrase.text)
        found += [(at, number) for at in range(len(words)) if words[at:at + len(own)] == own]
    return sorted(found)


def plain_lengths(words, templates):
    known = {tuple(own[i:j]) for own in templates for i in range(len(own)) for j in range(i + 1, len(own) + 1)}
    return [max([size for size in range(1, at + 2) if tuple(words[at + 1 - size:at + 1]) in known], default=0)
            for at in range(len(words))]


@pytest.mark.parametrize("seed", range(6))
def test_statistics_and_places(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    templates = [Template(str(i), text(rng.randrange(3, 15))) for i in range(5)]
    phrases = [Template("p", "a b"), Template("q", "b c a"), Template("r", "a b")]
    automaton = Automaton(templates, phrases)
    own = text(200).replace("d", "zz")
    words = words_of(own)
    numbers = [automaton.numbers.get(w.encode(), 0) for w in words]
    got = [length for _, _, length in automaton.stream(numbers, 0)]
    assert got == plain_lengths(words, [words_of(t.text) for t in [*templates, *phrases]])
    assert sorted(scan(automaton, own.encode()).places) == plain_places(words, phrases)


@pytest.mark.parametrize("seed", range(6))
def test_chains_cover_most_words(seed):
    rng = random.Random(seed)
    template = [f"w{i}" for i in range(40)]
    automaton = Automaton([Template("t", " ".join(template))], [])
    words = []
    for _ in range(9):
        at = rng.randrange(30)
        words += template[at:at + rng.randrange(2, 10)] + ["other"] * rng.randrange(2)
    runs, lengths = [], plain_lengths(words, [template])
    for at, size in enumerate(lengths):
        if size >= LEAST_RUN and (at + 1 == len(words) or lengths[at + 1] <= size):
            runs.append((at + 1 - size, template.index(words[at + 1 - size]), size))
    best = {}
    for at, (start, of, size) in enumerate(runs):
        best[at] = size + max([best[i] for i in range(at) if runs[i][0] + runs[i][2] <= start
                               and runs[i][1] + runs[i][2] <= of], default=0)
    got = scan(automaton, " ".join(words).encode()).chains
    assert (got[0][1] if got else 0) == max(best.values(), default=0)


def test_rows(spark):
    texts = [None, "", "...", "Released under the MIT License.", "mit LICENSE mit license",
             "x " * 40_000 + "Licensed under the Apache-License, version 2.0. General public license",
             "Licensed under CC BY-NC 4.0.", "É permission is hereby granted free of charge to any person",
             TEMPLATES[6].text, "mit licenses limit license"]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r["id"]: r for r in scan_licences(df, TEMPLATES, PHRASES).collect()}
    for i, text in enumerate(texts):
        words, row = words_of(text), got[i]
        places = plain_places(words, PHRASES)
        assert row["n_words"] == len(words) and row["n_base"] == len(places)
        assert row["first_word"] == (min(places)[0] if places else None)
        assert row["last_word"] == (max(places)[0] if places else None)
        base = sorted({PHRASES[p].label for _, p in places})
        assert row["base_labels"] == ",".join(base)
        assert set(base) <= set(filter(None, row["labels"].split(",")))
        assert 0 <= row["score"] <= 1
    assert [got[i]["labels"] for i in (0, 3, 5, 6, 7, 8, 9)] == ["", "mit", "apache,gpl", "cc-by-nc", "", "bsd", ""]
    assert got[6]["spans"][0].asDict() == {"label": "cc-by-nc", "first": 0, "last": 6}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert scan_licences(none, TEMPLATES, PHRASES).collect() == []


def test_templates_within_templates():
    inner, outer = "alpha beta gamma delta epsilon", "zeta alpha beta gamma delta epsilon eta theta iota kappa"
    automaton = Automaton([Template("in", inner), Template("out", outer), Template("end", "eta theta iota kappa")], [])
    found = scan(automaton, f"x {outer} y".encode())
    assert [chain[:2] for chain in found.chains] == [(0, 5), (1, 10), (2, 4)]
    assert found.chains[0][2:] == (2, 6) and found.chains[2][2:] == (7, 10)


def test_phrases_of_one_word():
    automaton = Automaton([Template("t", "one two three four")], [Template("p", "two"), Template("q", "lone")])
    assert scan(automaton, b"x lone y two, one two lone").places == [(1, 1), (3, 0), (5, 0), (6, 1)]


@pytest.mark.parametrize("seed", range(8))
def test_each_template_as_if_it_were_alone(seed):
    rng = random.Random(seed)
    base = [rng.choice("abcdefg") for _ in range(30)]
    cuts = [sorted(rng.sample(range(31), 2)) for _ in range(5)]
    templates = [Template(str(n), " ".join(base[i:j])) for n, (i, j) in enumerate(cuts)]
    words = [w for _ in range(6) for i, j in [sorted(rng.sample(range(31), 2))] for w in [*base[i:j], rng.choice(["x", "a"])]]
    text = " ".join(words).encode()
    together = {chain[0]: chain[1] for chain in scan(Automaton(templates, []), text).chains}
    for number, template in enumerate(templates):
        alone = scan(Automaton([template], []), text).chains
        assert together.get(number, 0) == (alone[0][1] if alone else 0)
