"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

The join walks pairs of trie nodes down together, one bit at a time, adds up the
bits in which they differ, and drops a pair once the Hamming budget is exceeded.

To spread the walk over the cluster, the 64 bits are cut into one block more
than the budget. Two fingerprints within the budget agree on some whole block,
so for each block the trie with that block's bits first needs only pairs below
one and the same node at that depth. These subtrees are the tasks; a subtree with
too many fingerprints is cut in pieces, and each two pieces are walked together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, column, id_and_text, kept, slices, spaced_words
from tidemark.llm.components import components, pair_tasks, spanning_edges
from tidemark.session import fresh_name

SHINGLE = 3
BUDGET = 2
SEED = 42
SUBTREE = 1024
HASHES_AT_ONCE = 1 << 15
TEXT_BYTES = 4 << 20
MEMBERS_AT_ONCE = 8192


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """A bit is 1 if over half of the shingles' hashes have it; 0 for no words."""
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(
        b"".join([digest(line[start:stop], SEED) for start, stop in zip(starts, stops)]), np.uint8
    ).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        bits = np.unpackbits(hashes[start:start + HASHES_AT_ONCE], axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str, text_column: str, shingle: int) -> DataFrame:
    """``id``, ``fingerprint`` (the 64 bits as a long) and ``text_key`` of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                found = [fingerprint(spaced_words(text), shingle)
                         for text in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.array(found, np.uint64).view(np.int64)),
                     part.column("text_key")], names=["id", "fingerprint", "text_key"])

    source = id_and_text(docs, id_column, text_column).withColumn("text_key", text_key(F.col("text")))
    return source.mapInArrow(of, "id long, fingerprint long, text_key long")


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``budget + 1`` blocks that cover 64 bits."""
    cuts = [64 * at // (budget + 1) for at in range(budget + 2)]
    return [(start, stop - start) for start, stop in zip(cuts, cuts[1:])]


def walk_pairs(
    values: np.ndarray, firsts: np.ndarray, seconds: np.ndarray, depth: int, budget: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of values within ``budget`` differing bits.

    ``firsts`` and ``seconds`` are (start, end) ranges of ``values``, each sorted
    and alike in its ``depth`` highest bits: the node pairs to begin with. Where
    both are the same range, each pair of it is found once.
    """
    a_lo, a_hi = firsts.T
    b_lo, b_hi = seconds.T
    spent = np.zeros(len(firsts), np.int8)
    for bit in range(63 - depth, -1, -1):
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = (a_lo == b_lo) & (a_hi == b_hi)
        found = []
        for al, ah, bl, bh, cost, keep in (
            (a_lo, a_mid, b_lo, b_mid, 0, True),
            (a_mid, a_hi, b_mid, b_hi, 0, True),
            (a_lo, a_mid, b_mid, b_hi, 1, True),
            (a_mid, a_hi, b_lo, b_mid, 1, ~same),
        ):
            go = (al < ah) & (bl < bh) & (spent + cost <= budget) & keep
            found.append((al[go], ah[go], bl[go], bh[go], spent[go] + cost))
        a_lo, a_hi, b_lo, b_hi, spent = map(np.concatenate, zip(*found))
        # A lone value paired with itself has nothing more to give.
        go = ~((a_lo == b_lo) & (a_hi == b_hi) & (a_hi - a_lo == 1))
        a_lo, a_hi, b_lo, b_hi, spent = a_lo[go], a_hi[go], b_lo[go], b_hi[go], spent[go]
    return a_lo, b_lo


def _turned(start: int) -> Column:
    """The fingerprint rotated so that the bits from ``start`` on lead."""
    if not start:
        return F.col("fingerprint")
    return F.shiftleft("fingerprint", start).bitwiseOR(F.shiftrightunsigned("fingerprint", 64 - start))


def links(distinct: DataFrame, budget: int) -> DataFrame:
    """Edges (high, low) of fingerprints that span all links within the budget.

    ``distinct`` has each ``fingerprint`` once. In every task the pairs found are
    reduced to edges that connect the same fingerprints, at most one per member.
    """
    cut = blocks(budget)
    members = distinct.select(F.explode(F.array(*[
        F.struct(F.lit(at).alias("turn"), F.lit(start).alias("start"), F.lit(bits).alias("bits"),
                 _turned(start).alias("value"))
        for at, (start, bits) in enumerate(cut)
    ])).alias("one")).select("one.*").withColumn(
        "node", F.expr("shiftrightunsigned(value, 64 - bits)"))
    tasks = pair_tasks(members, ["turn", "node"], "value", SUBTREE)
    groups = (
        tasks.groupBy("turn", "node", "task_a", "task_b")
        .agg(F.first("start").alias("start"),
             F.collect_list(F.when(~F.col("second"), F.col("value"))).alias("firsts"),
             F.collect_list(F.when(F.col("second"), F.col("value"))).alias("seconds"))
        .where(F.size("firsts") + F.size("seconds") > 1)
        .select("start", (F.col("task_a") == F.col("task_b")).alias("within"),
                "firsts", "seconds")
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, bits in cut:
                rows = batch.filter(pc.equal(batch.column("start"), start))
                for left, right in _walk_groups(rows, bits, budget):
                    high, low = spanning_edges(_turned_back(left, start), _turned_back(right, start))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(high), pa.array(low)], names=["high", "low"])

    return groups.mapInArrow(joined, "high long, low long")


def _turned_back(values: np.ndarray, start: int) -> np.ndarray:
    if start:
        values = values >> np.uint64(start) | values << np.uint64(64 - start)
    return values.view(np.int64)


def _walk_groups(
    rows: pa.RecordBatch, bits: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of values of the groups in ``rows``, several groups at a time."""
    values: list[np.ndarray] = []
    firsts: list[tuple[int, int]] = []
    seconds: list[tuple[int, int]] = []
    held = 0
    within = rows.column("within").to_pylist()
    for at in range(rows.num_rows + 1):
        if firsts and (at == rows.num_rows or held > MEMBERS_AT_ONCE):
            laid = np.concatenate(values)
            left, right = walk_pairs(laid, np.array(firsts), np.array(seconds), bits, budget)
            if left.size:
                yield laid[left], laid[right]
            values, firsts, seconds, held = [], [], [], 0
        if at < rows.num_rows:
            one, two = (np.sort(rows.column(name)[at].values.to_numpy().view(np.uint64))
                        for name in ("firsts", "seconds"))
            if within[at] or (one.size and two.size):
                split = held + one.size
                firsts.append((held, split))
                seconds.append((held, split) if within[at] else (split, split + two.size))
                values += [one, two]
                held = split + two.size


def simhash_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    budget: int = BUDGET,
) -> DataFrame:
    """One row per input row: ``id``, ``fingerprint``, ``group``, ``component_id``, ``text_key``.

    ``group`` is the smallest fingerprint (both as 16 hex digits), and
    ``component_id`` the smallest id, that can be reached over links of
    ``budget`` or fewer differing bits, the row's own included; ``text_key``
    tells texts of one id apart. Equal fingerprints are joined first, so copies
    cost one trie entry. Null, empty and wordless texts have fingerprint zero and
    are linked like any other; a text of fewer words than a shingle is one
    shingle. Texts of any length are read whole; repeated rows each give a row; a
    null id names no group, and its component is null if no other row of it has
    an id. An empty table gives an empty result. Only the two named columns are
    read.
    """
    prints = kept(fingerprints(docs, id_column, text_column, shingle), "fingerprints")
    return grouped(prints, links(prints.select("fingerprint").distinct(), budget))


def grouped(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of ``simhash_groups`` for these fingerprints, linked by ``edges`` (high, low)."""
    distinct = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    roots = components(edges)
    named = (
        distinct.join(roots, F.col("fingerprint") == F.col("node"), "left")
        .select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    )
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = named.join(lowest, "root").select("fingerprint", "root", "component_id")
    return prints.join(of_print, "fingerprint").select(
        "id", _hex("fingerprint").alias("fingerprint"), _hex("root").alias("group"),
        "component_id", "text_key")


def drop_near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    budget: int = BUDGET,
) -> DataFrame:
    """``docs`` with all its columns, one row of each group: that of the smallest id.

    Of rows with one id the text decides, and of equal rows one stays. Rows
    without an id give way to rows with one.
    """
    groups = simhash_groups(docs, id_column, text_column, shingle, budget)
    return keep_lowest(docs, groups, id_column, text_column)


def keep_lowest(docs: DataFrame, groups: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of ``docs`` that stand for their ``groups``: the smallest id, then the text."""
    chosen = groups.groupBy("group").agg(F.min(F.struct(
        F.col("id").isNull().alias("last"), "id", "text_key")).alias("one"))
    key = fresh_name("row")
    stay = chosen.select(_row_key(F.col("one.id"), F.col("one.text_key")).alias(key))
    own = docs.withColumn(key, _row_key(column(id_column).cast("long"), text_key(column(text_column))))
    return own.join(stay, key, "left_semi").dropDuplicates([key]).select(*map(column, docs.columns))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _row_key(ident: Column, text_key: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(ident.cast("string"), F.lit("-")), text_key.cast("string"))


def _hex(name: str) -> Column:
    return F.lpad(F.lower(F.hex(name)), 16, "0")
