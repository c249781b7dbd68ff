"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

A document's set is its distinct five-word shingles (all words as one shingle if there are fewer; nothing without
words). Under each hash function both the least and the greatest shingle are kept, which gives two signature parts for
one evaluation; bands of five parts, no band with both ends of one function, propose candidates. There are as many bands
as it takes to miss a link at the similarity ``like`` with probability below 1e-6: 24 (60 functions) at 0.85, 35 (88) at
0.80.

Documents with equal sets form a class first, so copies are never compared. In a bucket, every class is confirmed
against the bucket's smallest class, its leader; connected components follow. Where the classes of a leader are still in
several components, those of different components are compared by wide signatures of 380 more functions, in blocks of
bounded size that are tasks of their own; only pairs that reach the margin leave the task, and are confirmed too. The
margin follows from ``like`` and the same probability. A
leader's classes within one component need no further pair. Links are confirmed by exact intersection and union of
the sets. Comparing signatures takes work with the square of the classes of one leader that stay unlinked, but no rows.

Null and empty texts and texts without words have size 0 and are linked with nothing. Rows that repeat an id are the
same document and get the same answer; rows with a null id are compared and reported with a null component. No rows
in, no rows out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgewater.llm.components import components
from ridgewater.llm.words import fresh, mix, word_windows, words_of
from ridgewater.session import stage

SHINGLE = 5
ROWS = 5
LIKE = 0.85
MISS = 1e-6
WIDE = 380
BLOCK = 4_000
MOST = 1 << 12
_A = np.random.default_rng(97).integers(0, 2**63, MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(98).integers(0, 2**64, MOST, dtype=np.uint64)
_BAND = np.random.default_rng(99).integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Plan(NamedTuple):
    """What a similarity needs: bands, functions (the wide ones follow them), and wide parts in which a pair must agree."""

    bands: int
    functions: int
    agree: int

    def parts(self) -> np.ndarray:
        """Part i * bands + b of the signature is row i of band b; minima come first, then maxima."""
        return np.arange(self.bands * ROWS).reshape(ROWS, self.bands).T


def plan(like: float) -> Plan:
    bands = 2 if like >= 1 else math.ceil(math.log(MISS) / math.log1p(-(like**ROWS)))
    functions = math.ceil(bands * ROWS / 2)
    if functions + WIDE > MOST:
        raise ValueError(f"similarity {like} needs {functions} hash functions; {MOST - WIDE} are there")
    # Parts are single bytes, which are also equal by chance.
    same, parts = min(like, 1.0) + (1 - min(like, 1.0)) / 256, 2 * WIDE
    if same >= 1:
        return Plan(bands, functions, parts)
    below, agree = 0.0, 0
    while True:
        logs = math.lgamma(parts + 1) - math.lgamma(agree + 1) - math.lgamma(parts - agree + 1)
        below += math.exp(logs + agree * math.log(same) + (parts - agree) * math.log1p(-same))
        if below > MISS:
            return Plan(bands, functions, agree)
        agree += 1


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; A-Z are lower-cased, other letters are not."""
    for part in words_of(column, lower=True):
        every = word_windows(part.hashes, size)
        for a, b in zip(part.first[:-1].tolist(), part.first[1:].tolist()):
            if b - a >= size:
                yield np.unique(every[a : b - size + 1])
            elif b > a:
                yield word_windows(part.hashes[a:b], b - a)
            else:
                yield every[:0]


def _signatures(sets: list[np.ndarray], first: int, functions: int) -> np.ndarray:
    """Minima, then maxima, under functions ``first`` and following; one row per (not empty) set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = np.concatenate(sets)
    out = np.empty((len(sets), 2 * functions), np.uint64)
    for f in range(functions):
        hashed = every * _A[first + f] + _B[first + f]
        hashed ^= hashed >> np.uint64(32)
        out[:, f] = np.minimum.reduceat(hashed, starts)
        out[:, functions + f] = np.maximum.reduceat(hashed, starts)
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """id, n_shingles, set_a and set_b (a digest of the set), bands (one bucket key each)."""
    count, functions, _ = made_for = plan(like)
    places = made_for.parts()
    kind = dict(docs.dtypes)[id_col]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 400):
                few = batch.slice(at, 400)
                sets = list(shingle_sets(few.column(1)))
                sizes = np.array([len(s) for s in sets], np.int64)
                a = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(77))) if len(s) else 0 for s in sets], np.uint64)
                bands = np.zeros((len(sets), count), np.uint64)
                has = np.flatnonzero(sizes)
                if len(has):
                    made = _signatures([sets[i] for i in has], 0, functions)
                    key = np.zeros((len(has), count), np.uint64)
                    for r in range(ROWS):
                        key = mix((key + made[:, places[:, r]]) * _BAND[r])
                    bands[has] = mix(key + np.arange(count, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        few.column(0),
                        pa.array(sizes),
                        pa.array(a.view(np.int64)),
                        pa.array(b.view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), count).cast(pa.list_(pa.int64())),
                    ],
                    ["id", "n_shingles", "set_a", "set_b", "bands"],
                )

    schema = f"id {kind}, n_shingles long, set_a long, set_b long, bands array<long>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(make, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, like: float = LIKE) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the similarity; sets has columns id and members (binary)."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = both >= like * (len(x) + len(y) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(keep))

    left = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def wide_signatures(sets: DataFrame, like: float = LIKE) -> DataFrame:
    """id and parts: one byte for each part of the wide signature."""
    functions = plan(like).functions

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                few = batch.slice(at, 100)
                own = [np.frombuffer(x.as_buffer(), np.uint64) for x in few.column(1)]
                made = (_signatures(own, functions, WIDE) >> np.uint64(13)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([r.tobytes() for r in made], pa.binary())], ["id", "parts"])

    return sets.select("id", "members").mapInArrow(make, "id long, parts binary")


def _crossing(members: DataFrame, partitions: int, block: int = BLOCK) -> DataFrame:
    """Pairs of classes of one leader, but of different components, whose wide signatures agree often enough.

    members: first (the leader), id, label, parts, agree (in how many parts a pair must agree). A leader with more than ``block`` classes has them cut into blocks, and
    every two blocks meet in a group of their own, so a group holds two blocks at most.
    """
    sizes = members.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "first").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.select("first", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "label", "parts", "agree")

    def compare(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        agree = int(group["agree"].iloc[0])
        parts = np.frombuffer(b"".join(group["parts"]), np.uint8).reshape(len(group), -1)
        names, inverse, counts = np.unique(group["label"].to_numpy(), return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(counts, kind="stable")[::-1]] = np.arange(len(names))
        by = np.argsort(rank[inverse], kind="stable")
        ids, own, place, parts = group["id"].to_numpy()[by], group["own"].to_numpy()[by], rank[inverse][by], parts[by]
        apart = group["low"].iloc[0] != group["high"].iloc[0]
        for i in range(int((place == 0).sum()), len(ids)):
            before = int(np.searchsorted(place, place[i]))
            near = (parts[:before] == parts[i]).sum(axis=1, dtype=np.int32) >= agree
            near = np.flatnonzero(near & (own[:before] != own[i]) if apart else near)
            if len(near):
                yield pd.DataFrame({"a": np.minimum(ids[near], ids[i]), "b": np.maximum(ids[near], ids[i])})

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for _, rows in batch.groupby(["first", "low", "high"], sort=False):
                if held and (held[0][["first", "low", "high"]].iloc[0] != rows[["first", "low", "high"]].iloc[0]).any():
                    yield from compare(pd.concat(held))
                    held.clear()
                held.append(rows)
        if held:
            yield from compare(pd.concat(held))

    keys = ["first", "low", "high"]
    return placed.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInPandas(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """One row per input row: id, n_shingles, class_id (smallest id with an equal set), component_id, kept."""
    rows = stage(signatures(docs, id_col, text_col, like), "signatures")
    filled = rows.filter("n_shingles > 0 and id is not null")
    same_set = ["set_a", "set_b", "n_shingles"]
    classes = filled.groupBy(*same_set).agg(F.min("id").cast("long").alias("class"))
    classes = stage(classes, "classes")
    leaders = filled.join(classes, same_set).filter(F.col("id") == F.col("class")).dropDuplicates(["class"])
    exploded = stage(leaders.select("class", F.explode("bands").alias("key")), "bands")
    buckets = exploded.groupBy("key").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stage(exploded.join(buckets.select("key", "first"), "key").select("first", "class").distinct(), "members")
    stars = members.filter("class != first").select(F.col("first").alias("a"), F.col("class").alias("b"))
    wanted = members.select("class").distinct()
    sets = stage(_sets(docs, wanted, id_col, text_col), "sets")
    links = stage(confirmed(stars, sets, like), "links")
    labels = components(wanted.withColumnRenamed("class", "id"), links)

    labelled = stage(members.join(labels.withColumnRenamed("id", "class"), "class"), "labelled")
    several = labelled.groupBy("first").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    crossing = labelled.join(several.select("first"), "first")
    wide = wide_signatures(sets.join(crossing.select(F.col("class").alias("id")).distinct(), "id", "left_semi"), like)
    crossing = crossing.withColumnRenamed("class", "id").join(wide, "id").withColumn("agree", F.lit(plan(like).agree))
    pairs = _crossing(crossing, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = stage(pairs.join(stars, ["a", "b"], "left_anti"), "pairs")
    more = stage(confirmed(pairs, sets, like), "more")
    if not more.isEmpty():
        labels = components(wanted.withColumnRenamed("class", "id"), links.unionByName(more))

    named = classes.join(labels.withColumnRenamed("id", "class"), "class", "left")
    named = named.select(*same_set, "class", F.coalesce("label", "class").alias("component"))
    out = rows.join(named, same_set, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id").cast("long"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        "id",
        "n_shingles",
        F.coalesce("class", F.col("id").cast("long")).alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The full sets of the wanted classes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 400):
                few = batch.slice(at, 400)
                members = [s.tobytes() for s in shingle_sets(few.column(1))]
                yield pa.RecordBatch.from_arrays([few.column(0).cast(pa.int64()), pa.array(members, pa.binary())], ["id", "members"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Shuffled at every size, so that what a small run shows holds for a large one.
    chosen = named.join(wanted.withColumnRenamed("class", "id").hint("merge"), "id", "left_semi")
    return chosen.mapInArrow(make, "id long, members binary").dropDuplicates(["id"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", like: float = LIKE) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, and every row with a null id."""
    (name,) = fresh(docs.columns, "__id")
    gone = near_duplicates(docs, id_col, text_col, like).filter("not kept").select(F.col("id").alias(name)).distinct()
    return docs.join(gone.hint("merge"), F.col(id_col) == F.col(name), "left_anti")
