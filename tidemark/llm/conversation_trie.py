"""The prefix trie of conversations, from adaptive radix trees over their turns' ids.

A turn's id is 16 bytes of a digest of its role and text, so a conversation is a
key of fixed-width parts, and a key's byte depths that are multiples of 16 are
the trie's nodes. Keys are cut in ranges of about equal size; each range is one
radix tree in one task. Equal keys are told apart by their member, so copies of
one conversation may lie in several ranges.

Only the paths to a range's first and last key can go on in its neighbours. A
node on them is owned by the last range that has it. All that a range knows is
counted where it is owned, along the path to the root, so that plain sums of the
ranges' parts give the whole node. Members' numbers are added the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import column, kept
from tidemark.llm.radix_tree import Node, RadixTree

ID_BYTES = 16
# A tree's size: turns and conversations together. Bounds the memory of a task.
TREE_TURNS = 1 << 18
OUT_ROWS = 1 << 15

_FIELDS = [
    ("part", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()),
    ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends", pa.binary()),
]
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
PIECES = ", ".join(f"{name} {_SQL[kind]}" for name, kind in _FIELDS)
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
         "saved_tokens", "ends_sha256")


def sequences(
    conversations: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id``, ``ids`` and ``sizes``: each conversation's turn ids and UTF-8 text lengths.

    Turns come in the order of their number, null first; rows of one number in
    that of their ids. A null role or text is empty. Rows without a
    conversation id belong to none and are left out. Texts are replaced by ids
    before the shuffle.
    """
    role, text = (F.coalesce(column(name).cast("string"), F.lit(""))
                  for name in (role_column, text_column))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(
        column(conv_column).cast("long").alias("conv_id"),
        F.struct(column(turn_column).cast("long").alias("turn"),
                 F.unhex(F.substring(F.sha2(said, 256), 1, 2 * ID_BYTES)).alias("id"),
                 F.octet_length(text).cast("long").alias("size")).alias("one"))
    return (
        turns.where("conv_id IS NOT NULL").groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("one")).alias("turns"))
        .select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))
    )


class _Place(NamedTuple):
    """A tree node on the way down: its turns, depth above them, and what paths it is on."""

    node: Node
    ids: list[bytes]
    above: int
    aligned: bool
    first: bool
    last: bool
    parent: int


class Trie:
    """The trie of one range of keys; ``before`` and ``after`` are the turns its first and last
    key share with the neighbour's, -1 without one."""

    def __init__(self, tree: RadixTree, sizes: dict[bytes, int], before: int, after: int) -> None:
        self.sizes, self.before, self.after = sizes, before, after
        self.places = list(self._down(tree.root))

    @staticmethod
    def _down(root: Node) -> Iterator[_Place]:
        """All tree nodes, each after its parent."""
        stack = [(root, b"", 0, True, True, -1)]
        number = 0
        while stack:
            node, tail, above, first, last, parent = stack.pop()
            path = tail + node.prefix
            whole = len(path) // ID_BYTES
            ids = [path[at:at + ID_BYTES] for at in range(0, whole * ID_BYTES, ID_BYTES)]
            rest = path[whole * ID_BYTES:]
            yield _Place(node, ids, above, not rest, first, last, parent)
            if node.layout:
                items = list(node.layout.items())
                for place, (byte, child) in enumerate(items):
                    stack.append((
                        child, rest + bytes((byte,)), above + whole,
                        first and not place and not node.ends,
                        last and place == len(items) - 1, number))
            number += 1

    def _goes_on(self, place: _Place, depth: int) -> bool:
        return place.last and depth <= self.after

    def _shared(self, place: _Place, depth: int) -> bool:
        return self._goes_on(place, depth) or (place.first and depth <= self.before)

    def rows(self) -> Iterator[tuple]:
        """A row for each trie node: whole, or this range's part of it (then it has a key)."""
        counts = len(self.places)
        n, least, tops = [0] * counts, [None] * counts, [0] * counts
        leaves, saved = [0] * counts, [0] * counts
        own: list[list[tuple[int, int, int, int]]] = [[] for _ in range(counts)]
        for at in range(counts - 1, -1, -1):
            place = self.places[at]
            node = place.node
            n[at] += len(node.ends)
            lows = [*node.ends, *([] if least[at] is None else [least[at]])]
            least[at] = min(lows, default=None)
            depth = place.above + len(place.ids)
            for one in reversed(place.ids if place.parent >= 0 else [b""]):
                owned = not self._goes_on(place, depth)
                if not node.layout and depth == place.above + len(place.ids):
                    leaves[at] += owned
                size = self.sizes[one] if one else 0
                saved[at] += (n[at] - owned) * size
                own[at].append((depth, tops[at], leaves[at], saved[at]))
                tops[at], depth = int(owned), depth - 1
            if place.parent >= 0:
                up = place.parent
                n[up] += n[at]
                tops[up] += tops[at]
                leaves[up] += leaves[at]
                saved[up] += saved[at]
                least[up] = least[at] if least[up] is None else min(least[up], least[at])
        # Of each tree node: the digest of its path, the key and the member of its lowest turn.
        digests: list = [None] * counts
        keys: list[bytes | None] = [None] * counts
        lowest: list[int | None] = [None] * counts
        for at, place in enumerate(self.places):
            up = place.parent
            key, member = (keys[up], lowest[up]) if up >= 0 else (None, None)
            # Paths in the neighbours' reach are digested; what lies below them is not.
            digest = hashlib.blake2b(digest_size=ID_BYTES) if up < 0 else key and digests[up].copy()
            for one, (depth, children, leaf, save) in zip(place.ids or [b""], reversed(own[at])):
                shared = self._shared(place, depth)
                if shared:
                    digest.update(one)
                ends = place.node.ends if depth == place.above + len(place.ids) and place.aligned else []
                told = ",".join(map(str, sorted(ends))).encode()
                mine = digest.digest() if shared else None
                yield (mine, key, depth, least[at], None if key else member, n[at], children, leaf,
                       save, told if shared else hashlib.sha256(told).digest())
                key, member = mine, least[at]
            keys[at], lowest[at] = key, member
            digests[at] = digest


def _trees(shared: dict[int, tuple[int, int]]):
    """A function for ``mapInArrow`` over rows that come range by range."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, known = None, RadixTree(), {}
        for batch in batches:
            ids = batch.column("ids")
            flat, offsets = ids.flatten().to_pylist(), ids.offsets.to_numpy()
            offsets = (offsets - offsets[0]).tolist()
            sizes = batch.column("sizes").flatten().to_pylist()
            members = batch.column("conv_id").to_pylist()
            for at, own in enumerate(batch.column("part").to_pylist()):
                if own != part:
                    if part is not None:
                        yield from _batches(part, Trie(tree, known, *shared[part]).rows())
                    part, tree, known = own, RadixTree(), {}
                low, high = offsets[at], offsets[at + 1]
                known.update(zip(flat[low:high], sizes[low:high]))
                tree.insert(b"".join(flat[low:high]), members[at])
        if part is not None:
            yield from _batches(part, Trie(tree, known, *shared[part]).rows())

    return grown


def _batches(part: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append((part, *row))
        if len(held) == OUT_ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, (_, kind) in zip(columns, _FIELDS)],
        names=[name for name, _ in _FIELDS])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each key, from its parts in the order of their ranges.

    Members' numbers are hashed as they come: only one part of them is held.
    """
    held: list | None = None
    digest, any_ends = hashlib.sha256(), False
    for batch in batches:
        done = []
        for row in zip(*(one.to_pylist() for one in batch.columns)):
            _, key, parent, depth, conv, _, *sums, ends = row
            if held is None or held[1] != key:
                if held is not None:
                    done.append((*held, digest.digest()))
                held = [0, key, parent, depth, conv, None, 0, 0, 0, 0]
                digest, any_ends = hashlib.sha256(), False
            held[4] = min(held[4], conv)
            held[6:] = [one + two for one, two in zip(held[6:], sums)]
            if ends:
                digest.update(b"," + ends if any_ends else ends)
                any_ends = True
        if done:
            yield _batch(done)
    if held is not None:
        yield _batch([(*held, digest.digest())])


def _same_turns(one: Column, other: Column) -> Column:
    """How many first turns two rows of ids share; -1 where one of them is missing."""
    place = F.array_position(F.zip_with(one, other, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.when(one.isNull() | other.isNull(), -1).when(place == 0, F.size(one)).otherwise(place - 1)


def trie_nodes(found: DataFrame, tree_turns: int = TREE_TURNS) -> DataFrame:
    """The nodes of the trie of ``found`` (``conv_id``, ``ids``, ``sizes`` as of ``sequences``).

    One row for each distinct sequence of first turns, the empty one (the root)
    included: ``conv_id`` (smallest member; members start with the sequence),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes in its subtree, itself
    included), ``saved_tokens`` (summed over its subtree, one less than a node's
    members times the bytes of its last text), and ``ends_sha256`` (of the
    numbers of members that end there, rising and joined by commas).

    Conversations without turns are members of the root alone. Conversation ids
    are taken as given: one that comes twice counts twice. No conversations
    give no nodes. A conversation must fit a task, at 24 bytes a turn; a
    sequence that any number of conversations share, or start with, need not.
    """
    spark = found.sparkSession
    found = kept(found.select("conv_id", "ids", "sizes"), "sequences")
    turns = found.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    trees = max(spark.sparkContext.defaultParallelism, -(-turns // tree_turns))
    ranges = kept(
        found.repartitionByRange(trees, "ids", "conv_id").withColumn("part", F.spark_partition_id()),
        "ranges")
    # One row for each range: what its ends share with its neighbours.
    in_order = Window.orderBy("part")
    shared = {
        row["part"]: (row["before"], row["after"])
        for row in ranges.groupBy("part").agg(F.min("ids").alias("low"), F.max("ids").alias("high")).select(
            "part",
            _same_turns(F.lag("high").over(in_order), F.col("low")).alias("before"),
            _same_turns(F.col("high"), F.lead("low").over(in_order)).alias("after")).collect()
    }
    pieces = kept(
        ranges.repartition(trees, "part").sortWithinPartitions("part").mapInArrow(_trees(shared), PIECES),
        "pieces")
    whole, parts = pieces.where("key IS NULL"), pieces.where("key IS NOT NULL")
    merged = kept(
        parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_merged, PIECES), "merged")
    parent = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found_parent"))
    # A range looks up the parents it shares: its own rows share no key with another range's.
    by_range = parts.select("part", F.col("key").alias("parent_key")).join(parent, "parent_key")
    named = whole.where("parent_key IS NOT NULL").join(by_range, ["part", "parent_key"])
    across = merged.join(parent, "parent_key", "left")
    return (
        whole.where("parent_key IS NULL").withColumn("found_parent", F.col("parent_conv_id"))
        .unionByName(named).unionByName(across)
        .withColumn("parent_conv_id", F.col("found_parent"))
        .withColumn("ends_sha256", F.lower(F.hex("ends")))
        .select(*NODES)
    )


def conversation_trie(
    conversations: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``trie_nodes`` of the ``sequences`` of a table of turns; only the named columns are read."""
    return trie_nodes(sequences(conversations, conv_column, turn_column, role_column, text_column))
