"""Where passages repeat: anchors, homes, runs and covered places. Shared by the two substring operators.

A passage of ``length`` symbols (words or bytes) has ``length - k + 1`` inner k-mers; the one with the least hash is an
anchor of the text wherever the passage stands, because selecting it needs no context. A repeated passage therefore
contains a repeated anchor. The home of an anchor is the smallest document that has it. All runs around anchors of one
home meet in one group, so each occurrence of a repeated passage is met by all others, and long copies stay in one
piece. Groups are bounded: a home with many occurrences is dealt out by its anchors, and an anchor with many
occurrences by the hashes of the passages around it, which are counted by an ordinary aggregation.

In periodic text every place is an anchor; places of one anchor so near that the passages around them overlap are one
stretch, kept as its first and last place, so repetition inside a document adds no rows.

A document is an id and a text: rows that repeat both are one document and get the same answer. Different texts of one
id, or of no id, are documents of their own; they follow each other by ``part``, a 64-bit hash of the text. Documents
without an id come before all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgewater.llm.words import byte_windows, buffers, row_chunks, word_windows, words_of
from ridgewater.session import stage

# What one group may hold: places of anchors, each of which brings at most two passages of text. An anchor found at more
# places is dealt out by passages, a home with more by its anchors.
HOT_ANCHOR = 20_000
HOT_HOME = 20_000
NULL_ID = -(2**63)


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


def anchor_places(kmers: np.ndarray, width: int) -> np.ndarray:
    """Places of the values that are least in some window of ``width``."""
    if len(kmers) < width:
        return np.zeros(0, np.int64)
    least = sliding(kmers, width, np.minimum)
    pad = np.zeros(width - 1, kmers.dtype)
    highest = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    return np.flatnonzero(kmers == highest)


class Symbols:
    """What a text is made of: how to hash it, cut a run out of it, and name its passages."""

    def __init__(self, unit: str, length: int, k: int):
        self.unit, self.length, self.k = unit, length, k

    def texts(self, column: pa.Array) -> Iterator[tuple]:
        """(k-mer hashes, passage hashes maker, run maker, number of symbols) of each row."""
        if self.unit == "word":
            for part in words_of(column):
                grams = word_windows(part.hashes, self.k)
                for a, b in zip(part.first[:-1].tolist(), part.first[1:].tolist()):
                    yield grams[a : max(a, b - self.k + 1)], _WordText(part, a, b), b - a
        else:
            data, offsets = buffers(column)
            for i, j in row_chunks(offsets):
                part = data[offsets[i] : offsets[j]]
                grams = byte_windows(part, self.k)
                for a, b in zip((offsets[i:j] - offsets[i]).tolist(), (offsets[i + 1 : j + 1] - offsets[i]).tolist()):
                    yield grams[a : max(a, b - self.k + 1)], _ByteText(part[a:b]), b - a


class _WordText:
    def __init__(self, part, a: int, b: int):
        self.part, self.a, self.b = part, a, b

    def run(self, start: int, stop: int) -> bytes:
        starts, ends, data = self.part.starts[self.a :], self.part.ends[self.a :], self.part.data
        return b" ".join(data[s:e].tobytes() for s, e in zip(starts[start:stop].tolist(), ends[start:stop].tolist()))

    def passages(self, length: int) -> np.ndarray:
        return word_windows(self.part.hashes[self.a : self.b], length)


class _ByteText:
    def __init__(self, data: np.ndarray):
        self.data = data

    def run(self, start: int, stop: int) -> bytes:
        return self.data[start:stop].tobytes()

    def passages(self, length: int) -> np.ndarray:
        return byte_windows(self.data, length)


def _occurrences(docs: DataFrame, symbols: Symbols) -> DataFrame:
    width = symbols.length - symbols.k + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                few = batch.slice(at, 500)
                anchors, ids, parts, places, lasts, counts = [], [], [], [], [], []
                for doc, own_part, (grams, _, _) in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), symbols.texts(few.column(2))):
                    place = anchor_places(grams, width)
                    own = grams[place]
                    order = np.lexsort((place, own))
                    place, own = place[order], own[order]
                    begins = np.ones(len(place), bool)
                    begins[1:] = (own[1:] != own[:-1]) | (place[1:] - place[:-1] > symbols.length)
                    heads = np.flatnonzero(begins)
                    tails = np.append(heads[1:], len(place))[: len(heads)] - 1
                    anchors.append(own[heads])
                    places.append(place[heads])
                    lasts.append(place[tails])
                    counts.append(tails - heads + 1)
                    ids.append(np.full(len(heads), doc, np.int64))
                    parts.append(np.full(len(heads), own_part, np.int64))
                if anchors:
                    columns = [np.concatenate(anchors).view(np.int64), np.concatenate(ids), np.concatenate(parts)]
                    columns += [np.concatenate(c).astype(np.int32) for c in (places, lasts, counts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "doc", "part", "place", "last", "n"])

    return docs.mapInArrow(find, "anchor long, doc long, part long, place int, last int, n int")


def _merged(places: np.ndarray, lasts: np.ndarray, before: int, after: int, size: int) -> Iterator[tuple[int, int]]:
    """The union of [place - before, last + after) within [0, size), as ranges."""
    order = np.argsort(places, kind="stable")
    places, lasts = places[order], np.maximum.accumulate(lasts[order])
    heads = np.append(0, np.flatnonzero(places[1:] - before > lasts[:-1] + after) + 1)
    for head, tail in zip(heads, np.append(heads[1:], len(places)) - 1):
        yield max(0, int(places[head]) - before), min(size, int(lasts[tail]) + after)


def covered(docs: DataFrame, symbols: Symbols, judge: Callable[[DataFrame], DataFrame], keep_first: bool) -> DataFrame:
    """doc, part, start, stop: ranges covered by passages that occur elsewhere (``keep_first``: that start earlier).

    docs: columns doc, part (long) and text. ``judge`` turns the runs (kind, key, doc, part, start, run) into such ranges.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length, k = symbols.length, symbols.k
    # One exchange serves the counting and the join back.
    found = _occurrences(docs, symbols).repartition(parts, "anchor")
    known = found.groupBy("anchor").agg(F.sum("n").alias("times"), F.count(F.lit(1)).alias("places"), F.min("doc").alias("home"))
    known = known.filter("times > 1")
    spots = stage(found.join(known, "anchor").select("doc", "part", "place", "last", "anchor", "places", "home"), "spots")

    calm, hot = spots.filter(F.col("places") <= HOT_ANCHOR), spots.filter(F.col("places") > HOT_ANCHOR)
    crowded = calm.groupBy("home").agg(F.count(F.lit(1)).alias("own")).filter(F.col("own") > HOT_HOME).select("home", F.lit(1).alias("kind"))
    keyed = calm.join(crowded, "home", "left").select("doc", "part", "place", "last", F.coalesce("kind", F.lit(0)).alias("kind"), F.when(F.col("kind") == 1, F.col("anchor")).otherwise(F.col("home")).alias("key"))
    keyed = keyed.groupBy("doc", "part").agg(F.collect_list(F.struct("kind", "key", "place", "last")).alias("spots"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                few = batch.slice(at, 100)
                rows = []
                for doc, part, own, (_, text, size) in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), few.column(3), symbols.texts(few.column(2))):
                    kinds, keys, places, lasts = [np.asarray(c) for c in own.values.flatten()]
                    order = np.lexsort((keys, kinds))
                    kinds, keys, places, lasts = kinds[order], keys[order], places[order], lasts[order]
                    edges = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
                    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                        for start, stop in _merged(places[a:b], lasts[a:b], length - k, length, size):
                            rows.append((int(kinds[a]), int(keys[a]), doc, part, start, text.run(start, stop)))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["kind", "key", "doc", "part", "start", "run"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    # Joins with texts are shuffled at every size, so that what a small run shows holds for a large one.
    runs = docs.join(keyed.hint("merge"), ["doc", "part"]).select("doc", "part", "text", "spots")
    runs = runs.mapInArrow(cut, "kind int, key long, doc long, part long, start long, run binary")
    runs = runs.repartition(parts, "kind", "key").sortWithinPartitions("kind", "key", "doc", "part", "start")
    ranges = judge(runs)
    if hot.isEmpty():
        return ranges

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                few = batch.slice(at, 100)
                hashes, ids, own_parts, starts = [], [], [], []
                for doc, part, own, (_, text, _) in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), few.column(3), symbols.texts(few.column(2))):
                    every = text.passages(length)
                    spans = _merged(*[np.asarray(c) for c in own.values.flatten()], length - k, 1, len(every))
                    own = np.concatenate([np.arange(a, b) for a, b in spans if a < b] or [np.zeros(0, np.int64)])
                    hashes.append(every[own])
                    starts.append(own)
                    ids.append(np.full(len(own), doc, np.int64))
                    own_parts.append(np.full(len(own), part, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in ([h.view(np.int64) for h in hashes], ids, own_parts, [s.astype(np.int64) for s in starts])],
                    ["passage", "doc", "part", "start"],
                )

    places = hot.groupBy("doc", "part").agg(F.collect_list(F.struct("place", "last")).alias("places"))
    passages = docs.join(places.hint("merge"), ["doc", "part"]).select("doc", "part", "text", "places")
    passages = passages.mapInArrow(around, "passage long, doc long, part long, start long")
    # Not staged: within one query the texts shuffled for the runs serve here as well, and only the hashing is done twice.
    passages = passages.distinct() if not keep_first else passages
    first = passages.groupBy("passage").agg(F.min(F.struct("doc", "part", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = passages.join(first, "passage")
    if keep_first:
        repeated = repeated.filter(F.struct("doc", "part", "start") > F.col("first"))
    return ranges.unionByName(repeated.select("doc", "part", "start", (F.col("start") + length).alias("stop")))


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc, text and the ranges of every row (null if there are none)."""
    ranges = ranges.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return docs.join(ranges.hint("merge"), ["doc", "part"], "left").select("doc", "text", "ranges")


def mask(own, size: int) -> np.ndarray:
    """True for each of ``size`` places that lies in one of the ranges."""
    if own.values is None or not size:
        return np.zeros(size, bool)
    starts, stops = [np.asarray(c) for c in own.values.flatten()]
    change = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(np.minimum(stops, size), minlength=size + 1)
    return np.cumsum(change)[:size] > 0


def by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, part, text of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("part"), text.alias("text"))


def shown_id() -> F.Column:
    return F.when(F.col("doc") != NULL_ID, F.col("doc"))
