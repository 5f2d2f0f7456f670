"""Licence scans: matching statistics against a suffix automaton of licence words.

One generalised suffix automaton holds the words of all templates and phrases. A
text is streamed through it once; at each word the state tells the longest run
of words, ending there, that stands in some template. Runs that cannot be made
longer are chained, in the order of text and template, into the spans of the
template that the text covers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import alnum_words, as_bytes, id_and_text, slices

LEAST_RUN = 4
LEAST_COVER = 0.6
TEXT_BYTES = 4 << 20
SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label: string, first: long, last: long>>"
)
_SPAN = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])


class Template(NamedTuple):
    """A licence's label and words that announce it."""

    label: str
    text: str


class Automaton:
    """The suffix automaton of several rows of word numbers.

    ``ends[s]`` has the (template, end) places of state ``s``; ``phrases[s]`` the
    (length, phrase) that are suffixes of its runs.
    """

    def __init__(self, templates: Sequence[Template], phrases: Sequence[Template]) -> None:
        self.templates, self.phrase_labels = list(templates), [one.label for one in phrases]
        self.numbers: dict[bytes, int] = {}
        self.length, self.link, self.next = [0], [-1], [{}]
        self.ends: list[set[tuple[int, int]]] = [set()]
        self.phrases: list[list[tuple[int, int]]] = [[]]
        self.sizes = []
        for number, template in enumerate(templates):
            words = alnum_words(template.text.encode())
            self.sizes.append(len(words))
            last = 0
            for end, word in enumerate(words, 1):
                last = self._extend(last, self.numbers.setdefault(word, len(self.numbers) + 1))
                self.ends[last].add((number, end))
        for number, phrase in enumerate(phrases):
            words = alnum_words(phrase.text.encode())
            last = 0
            for word in words:
                last = self._extend(last, self.numbers.setdefault(word, len(self.numbers) + 1))
            self.phrases[last].append((len(words), number))
        # Runs of fewer known words hold neither a phrase nor a run that counts.
        self.least = min([LEAST_RUN, *(len(alnum_words(one.text.encode())) for one in phrases)])
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for state in reversed(by_length):
            self.ends[self.link[state]] |= self.ends[state]
        for state in by_length:
            self.phrases[state] = self.phrases[state] + self.phrases[self.link[state]]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        self.ends.append(set())
        self.phrases.append([])
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """The part of ``target`` that follows ``state`` by one word, as a state of its own."""
        if self.length[state] + 1 == self.length[target]:
            return target
        clone = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        added = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = added
            state = self.link[state]
        if state >= 0:
            self.link[added] = self._split(state, word, self.next[state][word])
        return added

    def matches(self, state: int, length: int, least: int) -> dict[int, tuple[int, frozenset[int]]]:
        """Of each template its own longest run of ``least`` words or more that ends here, and
        the places in it where that run ends. Shorter runs, down the suffix links, are those of
        templates that do not have the longer ones."""
        found: dict[int, tuple[int, frozenset[int]]] = {}
        while state > 0 and length >= least:
            own: dict[int, set[int]] = {}
            for template, end in self.ends[state]:
                if template not in found:
                    own.setdefault(template, set()).add(end)
            found |= {template: (length, frozenset(ends)) for template, ends in own.items()}
            state = self.link[state]
            length = self.length[state]
        return found

    def stream(self, numbers: list[int], first: int) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest known run ending at each word."""
        state = length = 0
        following, link, lengths = self.next, self.link, self.length
        for place, word in enumerate(numbers, first):
            while state and word not in following[state]:
                state = link[state]
                length = lengths[state]
            if word in following[state]:
                state = following[state][word]
                length += 1
            yield place, state, length


class Found(NamedTuple):
    """What one text holds: base places (start, phrase), and chains (template, words, first, last)."""

    n_words: int
    places: list[tuple[int, int]]
    chains: list[tuple[int, int, int, int]]


def scan(automaton: Automaton, text: bytes) -> Found:
    """Base places and template chains of a text."""
    words = alnum_words(text)
    numbers = np.fromiter(map(automaton.numbers.get, words, repeat(0)), np.int32, len(words))
    known = np.concatenate(([False], numbers > 0, [False])).astype(np.int8)
    steps = np.diff(known)
    starts, stops = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    long = stops - starts >= automaton.least
    places: list[tuple[int, int]] = []
    runs: list[tuple[int, int, int, frozenset[int]]] = []
    phrases = automaton.phrases
    for start, stop in zip(starts[long].tolist(), stops[long].tolist()):
        before: dict[int, tuple[int, frozenset[int]]] = {}
        for place, state, length in automaton.stream(numbers[start:stop].tolist(), start):
            if phrases[state]:
                places += [(place + 1 - size, phrase) for size, phrase in phrases[state] if size <= length]
            now = automaton.matches(state, length, LEAST_RUN) if length >= LEAST_RUN else {}
            if before:
                runs += _closed(before, now, place - 1)
            before = now
        if before:
            runs += _closed(before, {}, stop - 1)
    return Found(len(words), places, _chains(automaton, runs))


def _closed(
    before: dict[int, tuple[int, frozenset[int]]], now: dict[int, tuple[int, frozenset[int]]], place: int
) -> Iterator[tuple[int, int, int, frozenset[int]]]:
    """(template, place, length, ends) of the runs that ended at ``place``: those not made longer."""
    for template, (length, ends) in before.items():
        after = now.get(template)
        if after is None or after[0] != length + 1:
            yield template, place, length, ends
        else:
            # Where the template has the run more often, only some of its places go on.
            over = frozenset(end for end in ends if end + 1 not in after[1])
            if over:
                yield template, place, length, over


def _chains(
    automaton: Automaton, runs: list[tuple[int, int, int, frozenset[int]]]
) -> list[tuple[int, int, int, int]]:
    """For each template the chain of runs, rising in text and template, with most words."""
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for template, place, length, ends in runs:
        by_template.setdefault(template, []).extend(
            (place + 1 - length, end - length, length) for end in ends)
    found = []
    for template, matches in by_template.items():
        matches.sort()
        # Best chains by where they end in the template: ends rise, and so do the words.
        waiting = sorted(range(len(matches)), key=lambda at: matches[at][0] + matches[at][2])
        chain: list[tuple[int, int]] = [(0, 0)] * len(matches)  # words, first place
        ends: list[int] = []
        best: list[tuple[int, int]] = []
        done = 0
        for at, (start, of_template, length) in enumerate(matches):
            while done < len(waiting):
                other = waiting[done]
                if matches[other][0] + matches[other][2] > start:
                    break
                done += 1
                end = matches[other][1] + matches[other][2]
                spot = bisect_left(ends, end + 1)
                if spot and best[spot - 1][0] >= chain[other][0]:
                    continue
                low = bisect_left(ends, end)
                high = low
                while high < len(ends) and best[high][0] <= chain[other][0]:
                    high += 1
                ends[low:high] = [end]
                best[low:high] = [chain[other]]
            spot = bisect_left(ends, of_template + 1)
            words, first = best[spot - 1] if spot else (0, start)
            chain[at] = (words + length, first)
        top = max(range(len(matches)), key=lambda at: (chain[at][0], -at))
        found.append((template, *chain[top], matches[top][0] + matches[top][2] - 1))
    return sorted(found)


def scan_licences(
    docs: DataFrame,
    templates: Sequence[Template],
    phrases: Sequence[Template],
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per input row: base places of ``phrases``, labels, a score, and covered spans.

    ``n_base`` counts all places where a phrase's words stand; ``first_word`` and
    ``last_word`` are their smallest and largest start, else null. A template
    gives its label, and a span, where a chain covers at least ``LEAST_COVER`` of
    its words by runs of ``LEAST_RUN`` or more. The score is the largest share
    covered of any template; a phrase that occurs is covered whole. Labels are
    distinct, sorted and joined by commas, empty if there are none.

    Null, empty and wordless texts have no words. Texts of any length are
    streamed whole; repeated rows each give a row; an empty table gives an empty
    result. Only the two named columns are read. The automaton is built from the
    arguments alone and does not grow with the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast((list(templates), list(phrases)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*shared.value)
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                rows = [_row(automaton, scan(automaton, text)) for text in as_bytes(part.column("text"))]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
                         pa.float64(), pa.list_(_SPAN))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array([row[at] for row in rows], kind)
                                          for at, kind in enumerate(kinds))],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                           "labels", "score", "spans"])

    return id_and_text(docs, id_column, text_column).mapInArrow(scanned, SCHEMA)


def _row(automaton: Automaton, found: Found) -> tuple:
    starts = [start for start, _ in found.places]
    base = {automaton.phrase_labels[phrase] for _, phrase in found.places}
    covers = [(words / automaton.sizes[template], automaton.templates[template].label, first, last)
              for template, words, first, last in found.chains]
    own = [one for one in covers if one[0] >= LEAST_COVER]
    score = max([float(bool(base)), *(min(1.0, one[0]) for one in covers)])
    return (
        found.n_words, len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | {label for _, label, _, _ in own})), score,
        [{"label": label, "first": first, "last": last} for _, label, first, last in own],
    )
