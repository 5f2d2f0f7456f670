"""The prefix trie of all conversations, some of which start like their neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import remainder
from tidemark.llm.conversation_trie import sequences, trie_nodes


def with_shared_starts(found: DataFrame) -> DataFrame:
    """``found`` (as of ``sequences``), each conversation with another's first turns.

    Conversation c takes the first h = crc32(c as text) mod 9 turns of
    conversation c - c mod 5 (all if it has fewer, none if there is no such one),
    and keeps its own after its first h. The five that share a donor stand in one
    window, so no join is needed.
    """
    block = F.col("conv_id") - F.pmod("conv_id", F.lit(5))
    donor = F.max(F.when(F.col("conv_id") == block, F.struct("ids", "sizes"))).over(
        Window.partitionBy(block))
    h = remainder(F.col("conv_id"), 9)
    rebuilt = {
        name: F.concat(
            F.coalesce(F.slice(F.col("donor")[name], 1, h), F.slice(name, 1, 0)),
            F.slice(name, h + 1, F.size(name)))
        for name in ("ids", "sizes")
    }
    return found.withColumn("donor", donor).select(
        "conv_id", *[taken.alias(name) for name, taken in rebuilt.items()])


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie_nodes(with_shared_starts(sequences(turns)))


QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLES: dict[str, str] = {}
