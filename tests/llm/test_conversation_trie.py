"""Conversation tries against brute force."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm.conversation_trie import conversation_trie, sequences, trie_nodes
from tidemark.llm.query_conversations import op12_conversation_trie, with_shared_starts
from tidemark.llm.radix_tree import Full, Indexed, RadixTree, Sorted

SF = "/root/testdata/sf0.001"


def plain_nodes(conversations):
    """Rows of the trie of (conv_id, turns) pairs, by its definition."""
    nodes = {}
    for conv, turns in conversations:
        for depth in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:depth]), {"members": [], "ends": []})
            node["members"].append(conv)
        nodes[tuple(turns)]["ends"].append(conv)
    below = {path: [] for path in nodes}
    for path in nodes:
        for depth in range(len(path) + 1):
            below[path[:depth]].append(path)
    children = {path: 0 for path in nodes}
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    rows = set()
    for path, node in nodes.items():
        saved = sum((len(nodes[one]["members"]) - 1) * len((one[-1][1] if one else "").encode()) for one in below[path])
        ends = ",".join(map(str, sorted(node["ends"])))
        rows.add((
            min(node["members"]), len(path), min(nodes[path[:-1]]["members"]) if path else None,
            len(node["members"]), children[path], sum(not children[one] for one in below[path]), saved,
            hashlib.sha256(ends.encode()).hexdigest()))
    assert len(rows) == len(nodes)
    return rows


def ordered(rows):
    """(conv_id, turns) of table rows (conv_id, turn, role, text)."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            found.setdefault(conv, []).append(((turn is not None, turn or 0, said), (role, text)))
    return {conv: [one for _, one in sorted(turns)] for conv, turns in found.items()}


def rebuilt(own):
    found = []
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        found.append((conv, own.get(conv - conv % 5, [])[:h] + turns[h:]))
    return found


def result(df):
    rows = [tuple(row) for row in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("children", [3, 5, 17, 49, 200])
def test_layouts_grow(children):
    tree, rng = RadixTree(), random.Random(children)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 4))) for _ in range(4 * children)}
    keys |= {bytes((byte, 7)) for byte in range(children)}
    for member, key in enumerate(rng.sample(sorted(keys), len(keys))):
        tree.insert(key, member)
    found, stack = [], [(tree.root, b"")]
    while stack:
        node, path = stack.pop()
        path += node.prefix
        found += [path] * len(node.ends)
        if node.layout:
            items = list(node.layout.items())
            assert [byte for byte, _ in items] == sorted(byte for byte, _ in items)
            assert all(node.layout.find(byte) is child for byte, child in items)
            assert node.ends or len(items) > 1 or node is tree.root
            stack += [(child, path + bytes((byte,))) for byte, child in reversed(items)]
    assert found == sorted(keys)
    root = RadixTree()
    for byte in range(children):
        root.insert(bytes((byte, byte)), byte)
    layout = root.root.layout
    kind = Sorted if children <= 16 else Indexed if children <= 48 else Full
    assert type(layout) is kind and getattr(layout, "room", 0) == {3: 4, 5: 16}.get(children, 0)


@pytest.mark.parametrize("seed", range(3))
def test_nodes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(rng.choice([1, 30, 120])):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv * rng.choice([1, 3]), rng.choice([turn, turn, None]), rng.choice(["user", None, "é"]),
                         rng.choice(["", "a", "ü" * 3, None])))
    rows += [(10_000 + i, t, "user", "same") for i in range(60) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    own = ordered(rows)
    found = conversation_trie(df)
    assert result(found) == plain_nodes(own.items())
    # Trees of few turns: nearly every node is shared by several ranges.
    assert result(trie_nodes(sequences(df), 15)) == plain_nodes(own.items())
    assert result(trie_nodes(with_shared_starts(sequences(df)), 40)) == plain_nodes(rebuilt(own))


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, depth int, key string"
    rows = [(None, 0, "user", "x", 1, "k"), (7, None, None, None, 1, "k"), (7, None, None, None, 1, "k"),
            (7, 5, "user", "a" * 100_000, 1, "k"), (-3, 1, "user", "b", None, None), (8, 1, "us", "era", 0, ""),
            (8, 1, "user", "a", 0, "")]
    df = spark.createDataFrame(rows, schema)
    assert result(conversation_trie(df)) == plain_nodes(ordered([row[:4] for row in rows]).items())
    assert conversation_trie(df.where("false")).collect() == []
    assert conversation_trie(df.where("conv_id IS NULL")).collect() == []


def test_long_and_turnless_conversations(spark):
    one = [("user", str(i)) for i in range(3000)]
    found = {5: one, 6: one[:2000], 7: one[:2000] + [("user", "x")] * 3, 8: [("a", "b")]}
    rows = [(conv, turn, *said) for conv, turns in found.items() for turn, said in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for tree_turns in (1 << 18, 100):
        nodes = [tuple(row) for row in trie_nodes(sequences(df), tree_turns).collect()]
        assert len(nodes) == len(set(nodes)) == 1 + 3000 + 3 + 1
        root = next(row for row in nodes if row[1] == 0)
        assert root[:6] == (5, 0, None, 4, 2, 3)
        saved = sum(len(str(i)) * 2 for i in range(2000))
        assert root[6] == saved
    # A donor that is not there leaves nothing of a conversation of h turns or fewer.
    h = {conv: zlib.crc32(str(conv).encode()) % 9 for conv in range(1, 100)}
    conv = next(c for c, size in h.items() if size >= 2 and c % 5)
    short = spark.createDataFrame([(conv, 0, "u", "t")], "conv_id long, turn long, role string, text string")
    only = [tuple(row) for row in trie_nodes(with_shared_starts(sequences(short))).collect()]
    assert only == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    own = ordered([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows])
    assert result(op12_conversation_trie(spark, SF)) == plain_nodes(rebuilt(own))
