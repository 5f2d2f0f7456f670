"""Byte-level BPE: each piece's merges are found by a segment tree over its byte positions.

A leaf holds the rank of the pair that starts at its position, an inner node the
smaller of its two children, so the root names the leftmost pair of the lowest
rank. A merge changes three leaves (the merged position, its live neighbour to
the left, and the one swallowed) and the paths above them: O(log n), also in a
text of one endless piece. Short pieces of similar length run side by side, one
tree per matrix column, so that a step costs a few numpy calls for all of them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tidemark.llm.common import id_and_text, slices

NEVER = np.int64(1) << 60
SIDE_BY_SIDE_BYTES = 128
COLUMNS = 4096
CACHED_PIECES = 600_000
TEXT_BYTES = 4 << 20
RESULTS = {"ids": "binary", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def exact_pattern(pattern: str) -> str:
    """``pattern`` for the regex module, with letters and numbers as the tokenizer knows them.

    The two engines carry different Unicode versions. Characters that only one
    of them takes for a letter or number are taken out of, or put in, the class.
    """
    single = {bytes([byte]): byte for byte in range(256)}
    everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for name in (r"\p{L}", r"\p{N}"):
        engine = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(engine.encode_ordinary(everything)).decode())
        ours = set(regex.findall(name, everything))
        exact = name
        if gone := "".join(_ranges(ours - theirs)):
            exact = f"[{exact}--[{gone}]]"
        if more := "".join(_ranges(theirs - ours)):
            exact = f"[{exact}||[{more}]]"
        pattern = pattern.replace(name, exact)
    return "(?V1)" + pattern


def _ranges(characters: set[str]) -> Iterator[str]:
    codes = sorted(map(ord, characters))
    start = 0
    for at in range(1, len(codes) + 1):
        if at == len(codes) or codes[at] != codes[at - 1] + 1:
            yield f"\\U{codes[start]:08X}-\\U{codes[at - 1]:08X}"
            start = at


class Merges:
    """Ranks of pairs of tokens, looked up singly or for whole arrays.

    A pair merges where the bytes of its two tokens together are a token, whose
    rank is both the pair's rank and the merged token's id.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if any(bytes([byte]) not in ranks for byte in range(256)):
            raise ValueError("some byte has no token of its own")
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.of_byte = np.array([ranks[bytes([byte])] for byte in range(256)], np.int64)
        pairs = [
            (left << 32 | right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None
            and (right := ranks.get(token[cut:])) is not None
        ]
        self.pair = dict(pairs)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NEVER, np.int64)
        mask = (1 << self.bits) - 1
        for slot, (key, rank) in zip(self._slots(np.array([k for k, _ in pairs], np.int64)), pairs):
            slot = int(slot)
            while self.keys[slot] >= 0:
                slot = (slot + 1) & mask
            self.keys[slot], self.values[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NEVER."""
        keys = left << 32 | right
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.values[slots], NEVER)
        rest = np.flatnonzero((held != keys) & (held >= 0))
        mask = (1 << self.bits) - 1
        while rest.size:
            slots[rest] = (slots[rest] + 1) & mask
            held = self.keys[slots[rest]]
            hit = held == keys[rest]
            found[rest[hit]] = self.values[slots[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return found


def merge_one(piece: bytes, merges: Merges) -> list[int]:
    """Tokens of one piece, by one segment tree."""
    length = len(piece)
    tokens = merges.of_byte[np.frombuffer(piece, np.uint8)].tolist()
    bits = max(1, (length - 1).bit_length())
    leaves, never = 1 << bits, int(NEVER)
    rank_of = merges.pair.get
    tree = [never] * (2 * leaves)
    for at in range(length - 1):
        rank = rank_of(tokens[at] << 32 | tokens[at + 1])
        if rank is not None:
            tree[leaves + at] = rank << bits | at
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    before = list(range(-1, length - 1))
    after = list(range(1, length + 1))

    def put(at: int, other: int) -> None:
        rank = rank_of(tokens[at] << 32 | tokens[other]) if other < length else None
        node = leaves + at
        tree[node] = never if rank is None else rank << bits | at
        while node > 1:
            node >>= 1
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

    while tree[1] < never:
        at = tree[1] & leaves - 1
        gone = after[at]
        tokens[at] = tree[1] >> bits
        after[at] = after[gone]
        if after[gone] < length:
            before[after[gone]] = at
        put(gone, length)
        put(at, after[at])
        if before[at] >= 0:
            put(before[at], at)
    found, at = [], 0
    while at < length:
        found.append(tokens[at])
        at = after[at]
    return found


def merge_side_by_side(pieces: Sequence[bytes], bits: int, merges: Merges) -> list[bytes]:
    """Ids (little-endian, 32 bits) of pieces of 2 to ``2**bits`` bytes, a tree per column."""
    count, leaves = len(pieces), 1 << bits
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    laid = np.frombuffer(b"".join(piece.ljust(leaves, b"\0") for piece in pieces), np.uint8)
    tokens = np.ascontiguousarray(merges.of_byte[laid.reshape(count, leaves).T])
    place = np.arange(leaves, dtype=np.int64)[:, None]
    tree = np.full((2 * leaves, count), NEVER, np.int64)
    ranks = merges.of(tokens[:-1].ravel(), tokens[1:].ravel()).reshape(leaves - 1, count)
    there = (place[1:] < lengths) & (ranks < NEVER)
    tree[leaves:-1][there] = (ranks << bits | place[:-1])[there]
    for level in range(bits - 1, -1, -1):
        low = 1 << level
        np.minimum(tree[2 * low:4 * low:2], tree[2 * low + 1:4 * low:2], out=tree[low:2 * low])
    # A spare row takes what would fall off either end.
    before = np.repeat(np.arange(-1, leaves, dtype=np.int64)[:, None], count, 1)
    after = np.repeat(np.arange(1, leaves + 2, dtype=np.int64)[:, None], count, 1)
    live = place < lengths
    flat, tokens_flat = tree.ravel(), tokens.ravel()
    before_flat, after_flat, live_flat = before.ravel(), after.ravel(), live.ravel()
    column = np.flatnonzero(tree[1] < NEVER)
    while column.size:
        best = flat[count + column]
        at, rank = best & leaves - 1, best >> bits
        gone = after_flat[at * count + column]
        beyond = after_flat[gone * count + column]
        first = before_flat[at * count + column]
        end = lengths[column]
        tokens_flat[at * count + column] = rank
        live_flat[gone * count + column] = False
        after_flat[at * count + column] = beyond
        before_flat[np.minimum(beyond, leaves) * count + column] = at
        right = tokens_flat[np.minimum(beyond, leaves - 1) * count + column]
        left = tokens_flat[np.maximum(first, 0) * count + column]
        to_right = np.where(beyond < end, merges.of(rank, right), NEVER)
        to_left = np.where(first >= 0, merges.of(left, rank), NEVER)
        flat[(leaves + gone) * count + column] = NEVER
        flat[(leaves + at) * count + column] = np.where(
            to_right < NEVER, to_right << bits | at, NEVER)
        flat[(leaves + np.maximum(first, 0)) * count + column] = np.where(
            first < 0, flat[leaves * count + column],
            np.where(to_left < NEVER, to_left << bits | first, NEVER))
        for changed in (gone, at, np.maximum(first, 0)):
            node = leaves + changed
            for _ in range(bits):
                node = node >> 1
                child = 2 * node * count + column
                flat[node * count + column] = np.minimum(flat[child], flat[child + count])
        column = column[flat[count + column] < NEVER]
    ids = tokens.T[live.T].astype("<u4").tobytes()
    ends = (4 * np.cumsum(live.sum(0))).tolist()
    return [ids[start:end] for start, end in zip([0, *ends], ends)]


class Encoder:
    """Ids of texts as bytes; the pieces met last are remembered, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, exact: str) -> None:
        self.merges = Merges(ranks)
        self.split = regex.compile(pattern).findall
        self.split_exactly = regex.compile(exact).findall
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """The pattern's matches; both engines agree on the first 256 characters."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.split_exactly(text)
        return self.split(text)

    def learn(self, pieces: Sequence[str]) -> None:
        """Add the ids of pieces not met before."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        ranks = self.merges.ranks
        for piece in pieces:
            raw = piece.encode()
            whole = ranks.get(raw)
            if whole is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(raw) > SIDE_BY_SIDE_BYTES:
                self.known[piece] = np.array(merge_one(raw, self.merges), "<u4").tobytes()
            else:
                classes.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for bits, group in classes.items():
            for start in range(0, len(group), COLUMNS):
                chunk = group[start:start + COLUMNS]
                found = merge_side_by_side([raw for _, raw in chunk], bits, self.merges)
                self.known.update(zip((piece for piece, _ in chunk), found))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHED_PIECES:
            self.known.clear()
        split = [self.pieces(text) for text in texts]
        self.learn(list(set(chain.from_iterable(split)).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ``ids`` stand for."""
        token = self.merges.token
        return b"".join(map(token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[bytes, Encoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str, exact: str, key: bytes) -> Encoder:
    """One encoder per worker process and vocabulary, as its tables take a moment to build."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern, exact)
    return _ENCODERS[key]


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    results: Sequence[str] = ("ids", "decoded"),
) -> DataFrame:
    """One row per input row: id, n_tokens, and the ``results`` asked for.

    These are the ids (little-endian unsigned 32-bit integers), the bytes they
    decode to, and the SHA-256 sums of both in hexadecimal. A null or empty text has no tokens; texts of any length are encoded
    whole; repeated rows are encoded each for itself; an empty table gives an
    empty result. Only the two named columns are read. The vocabulary file is
    read once on the driver and broadcast, as it does not grow with the data.
    """
    ranks = read_ranks(ranks_path)
    key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).digest()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, exact_pattern(pattern), key))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = encoder(*shared.value)
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                ids = run.encode([text or "" for text in part.column("text").to_pylist()])
                back = [run.decode(one) for one in ids]
                made = {"ids": ids, "decoded": back}
                for name in ("ids", "decoded"):
                    if f"{name}_sha256" in results:
                        made[f"{name}_sha256"] = [hashlib.sha256(one).hexdigest() for one in made[name]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(one) // 4 for one in ids], pa.int64()),
                     *(pa.array(made[name], RESULTS[name]) for name in results)],
                    names=["id", "n_tokens", *results])

    source = id_and_text(docs, id_column, text_column)
    return source.mapInArrow(
        encoded, ", ".join(["id long", "n_tokens long", *(f"{name} {RESULTS[name]}" for name in results)]))
