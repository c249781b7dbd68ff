"""Exact duplicates by splitting heavy digests from the rest.

Misra-Gries summaries of every task, added up, name the digests with the largest sure counts, among them every one that
holds more than 2 / (counters + 1) of the rows: a task's summary understates a count by 1 / (counters + 1) of its rows at
most, and no more than ``counters`` digests can be left with more than that share. Those are counted exactly and their
winners, at most ``counters`` rows, are broadcast, so copies of a heavy text are decided where they are read. All other
digests are grouped by an ordinary shuffle, in which no key can hold more than twice that share.

A text is normalised by deleting white space; null is empty. Equal means an equal SHA-256 of the normalised text.
Of equal texts the row with the most characters stays, then the smallest id (null last), then the row read first.
Rows that repeat an id are rows of their own, and only one row of each group stays. No rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgewater.llm.words import SPACE, fresh
from ridgewater.session import stage

COUNTERS = 1023


def digest(text) -> F.Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", ""), 256)


def frequent(values: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Columns value and at_least: values of the one string column with lower bounds of their counts, the highest first;
    at most ``counters`` rows, among them every value that holds more than 2 / (counters + 1) of all."""

    def trim(held: dict) -> dict:
        if len(held) <= counters:
            return held
        least = sorted(held.values(), reverse=True)[counters]
        return {v: c - least for v, c in held.items() if c > least}

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for part in pc.value_counts(batch.column(0)).to_pylist():
                held[part["values"]] = held.get(part["values"], 0) + part["counts"]
            held = trim(held)
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["value", "n"])

    parts = values.toDF("value").mapInArrow(summarise, "value string, n long")
    return parts.groupBy("value").agg(F.sum("n").alias("at_least")).orderBy(F.desc("at_least"), "value").limit(counters)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest and chars (its length)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        digest(F.col(text_col)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "digests")
    spark, total = docs.sparkSession, rows.count()

    def decided(part: DataFrame) -> DataFrame:
        """Rank of a row as a struct whose minimum is the winner."""
        rank = F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id").alias("id"), F.col("row").alias("row"))
        return part.groupBy("digest").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))

    candidates = frequent(rows.select("digest"), counters).select(F.col("value").alias("digest"))
    heavy = decided(rows.join(F.broadcast(candidates), "digest")).filter(F.col("group_size") * (counters + 1) > total)
    heavy = stage(heavy, "heavy")
    known = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    out = known.unionByName(rest.join(decided(rest), "digest"))
    return out.select(
        "id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
        "chars",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by id, digest and length; rows that repeat all three are reduced to one of them.
    """
    own = ("id", "digest", "chars", "group_size")
    *names, made, length = fresh(docs.columns, *[f"__{c}" for c in own], "__made", "__length")
    named = dict(zip(own, names))
    won = exact_groups(docs, id_col, text_col).filter("kept").select(*[F.col(c).alias(n) for c, n in named.items()])
    met = docs.select("*", digest(F.col(text_col)).alias(made), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias(length))
    same = F.col(id_col).eqNullSafe(F.col(named["id"])) & (F.col(made) == F.col(named["digest"])) & (F.col(length) == F.col(named["chars"]))
    met = met.join(won, same)
    single = met.filter(F.col(named["group_size"]) == 1)
    once = met.filter(F.col(named["group_size"]) > 1).dropDuplicates([named["digest"]])
    return single.unionByName(once).select(*docs.columns)
