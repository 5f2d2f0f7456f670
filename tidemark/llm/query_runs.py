"""Periodic runs of all documents, some of which are made to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text
from tidemark.llm.periodic_runs import periodic_runs

# Fixed value: what parts the words of the query's contract.
BLANKS = r"[\x20\x09-\x0D]+"


def with_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id`` and ``text``; for about a tenth of the ids the words repeat from some place on.

    With h = crc32(id as text) and g = h div 10: where h mod 10 is 0, each word i
    from a = g mod n on becomes word a + (i - a) mod p, where p is
    1 + (n - a) div (3 + g mod 8). A null id counts as the empty text; a text
    without words stays.
    """
    picked = id_and_text(docs, id_column, text_column).withColumn(
        "h", F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    ).withColumn("g", F.floor(F.col("h") / 10)).withColumn(
        # Only the picked rows are cut; the column is used often, so Spark keeps it apart.
        "words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", BLANKS), lambda one: one != "")))
    n, g = F.size("words"), F.col("g")
    placed = picked.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)).cast("int"))
    a, p, words = F.col("a"), F.col("p"), F.col("words")
    repeated = F.concat(F.slice(words, 1, a), F.transform(
        F.sequence(a, n - 1), lambda i: F.get(words, a + (i - a) % p)))
    return placed.select("id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(with_repeats(docs), "id")
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # Runs come by start, then period: of equal exponents the first one stays.
    top = F.aggregate("runs", none, lambda best, one: F.when(
        best.isNull() | (one.length * best.period > best.length * one.period), one).otherwise(best))
    lines = F.transform("runs", lambda one: F.concat(
        F.concat_ws(",", one.start.cast("string"), one.length.cast("string"), one.period.cast("string")),
        F.lit("\n")))
    return found.withColumn("top", top).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
