"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of like length share a block: a matrix of bits with a column for each document, stored row by row, so that one
row says for every document of the block at once whether one hash position is set. A document sets the positions of its
terms, and of (term, level) for every level its count of the term reaches; the levels are 1, 2, 3, 4, 6, 8, 12, 16 ...
Ands of a term's rows never miss a document that holds the term, and the levels bound its count from above. Term weights
times the largest share such a count can give, summed over an item's terms, bound the score from above.

1. ``signatures`` reads every text once and writes the blocks, which do not depend on the items.
2. The documents with the highest bounds are scored exactly; each item's k-th best score is its threshold.
3. Every document whose bound reaches the threshold (at equal bound: with an id that could still win) is scored exactly
   on its whole text. All others are proven to be below the k best.

Only an item batch's terms and weights go to the tasks, at most ``BATCH_TERMS`` of them (or one item's) at a time; nothing
of the documents reaches the driver but two thresholds an item. Weights come from exact counts over all documents.

Null texts, empty texts and texts of separators hold no terms: such documents count nowhere and such items have no result.
Rows that repeat an id are documents of their own; a null id comes after all others. Item rows are items of their own,
whatever their id. Empty tables give no rows. Other columns are not read, so their names may be anything.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewater.llm.words import _hashes, mix, words_of
from ridgewater.session import stage

TOP = 10
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Rows of bits each key sets, bits a key has at least, bits of a block and documents of a block at most.
HASHES, SPARE, BLOCK_BITS, BLOCK_DOCS = 3, 16, 1 << 22, 2048
# Terms that one batch of items may send to the tasks, and cells of the table that a block's bounds are summed in.
BATCH_TERMS, SLAB = 200_000, 1 << 20

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[c for c in range(128) if not chr(c).isalnum()]] = True
LEVELS = np.array(sorted({1} | {1 << p for p in range(1, 40)} | {3 << p for p in range(39)}), np.int64)
_LEVEL = mix(np.arange(1, len(LEVELS) + 1, dtype=np.uint64))
_PLACE = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max
_TERM = re.compile(APART.replace("[", "[^") + "+")
_CASE = str.maketrans(UPPER, LOWER)


def terms_of(text: Column) -> Column:
    """The terms of a text, with repeats; only A-Z are lower-cased."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), f"{APART}+"), lambda t: t != "")


class _Block:
    def __init__(self, rows: int):
        self.width = max(1, min(BLOCK_DOCS, BLOCK_BITS // rows))
        self.bits = np.zeros((rows, self.width), bool)
        self.ids, self.keys, self.sizes = [], [], []

    def batch(self) -> pa.RecordBatch:
        packed = np.packbits(self.bits[:, : len(self.ids)], axis=1)
        values = [pa.array([x], pa.list_(pa.int64())) for x in (self.ids, self.keys, self.sizes)]
        return pa.RecordBatch.from_arrays(
            [*values, pa.array([len(self.bits)], pa.int64()), pa.array([packed.tobytes()], pa.binary())], ["ids", "keys", "sizes", "rows", "bits"]
        )


def _positions(hashes: np.ndarray, level: int, rows: int) -> np.ndarray:
    """The rows that (term, level) sets: one line for each of the HASHES functions."""
    return (mix((hashes ^ _LEVEL[level]) + _PLACE[:, None]) & np.uint64(rows - 1)).astype(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of at most BLOCK_DOCS documents: ids, keys (a hash of each text), sizes (terms with repeats), rows, bits.

    A document joins the block of its size class: a power of two of rows, SPARE to 2 * SPARE for each of its keys, so a
    long text has as few chance hits as a short one.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in words_of(batch.column(2), lower=True, space=_SEPARATES):
                for at, (a, b) in enumerate(zip(part.first[:-1].tolist(), part.first[1:].tolist()), part.row):
                    if a == b:
                        continue
                    own, counts = np.unique(part.hashes[a:b], return_counts=True)
                    reached = [own[counts >= x] for x in LEVELS[: np.searchsorted(LEVELS, counts.max(), side="right")]]
                    rows = 1 << int(max(256, SPARE * sum(map(len, reached))) - 1).bit_length()
                    block = blocks.get(rows) or blocks.setdefault(rows, _Block(rows))
                    for level, hashes in enumerate(reached):
                        block.bits[_positions(hashes, level, rows).ravel(), len(block.ids)] = True
                    block.ids.append(ids[at])
                    block.keys.append(keys[at])
                    block.sizes.append(b - a)
                    if len(block.ids) == block.width:
                        yield block.batch()
                        del blocks[rows]
        for block in blocks.values():
            yield block.batch()

    schema = "ids array<long>, keys array<long>, sizes array<long>, rows long, bits binary"
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long"), F.xxhash64(text), text).mapInArrow(make, schema)


class Query(NamedTuple):
    """A batch of items: ``hashes`` and ``weights`` of their terms, item by item; ``starts`` of those; N and L."""

    hashes: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    documents: int
    terms: int


def bounds(rows: int, bits: bytes, sizes: np.ndarray, query: Query) -> np.ndarray:
    """No score of an item (line) for a document (column) is above this; all values are whole and below 2 ** 53."""
    width = len(sizes)
    table = np.frombuffer(bits, np.uint8).reshape(rows, -1)
    levels = int(np.searchsorted(LEVELS, sizes.max(), side="right"))
    spread = 8 * (10 + 90 * sizes * query.documents // query.terms)
    share = np.zeros((levels + 1, width))
    for level in range(levels):
        most = np.minimum(LEVELS[level + 1] - 1, sizes)
        share[level + 1] = 1_000_000_000 * most // (1000 * most + spread)
    out = np.zeros((len(query.starts) - 1, width))
    item = np.repeat(np.arange(len(out)), np.diff(query.starts))
    columns, step = np.arange(width), max(1, SLAB // width)
    for at in range(0, len(query.hashes), step):
        own, found = np.arange(at, min(at + step, len(query.hashes))), None
        for level in range(levels):
            there = np.bitwise_and.reduce(table[_positions(query.hashes[own], level, rows)], axis=0)
            there = there if found is None else there & above
            some = there.any(axis=1)
            if found is None:
                own, there, some = own[some], there[some], some[some]
                found = np.zeros((len(own), width), np.uint8)
                line = np.arange(len(own))
            if not some.any():
                break
            line, own, above = line[some], own[some], there[some]
            found[line] += np.unpackbits(above, axis=1, count=width)
            if level == 0:
                held = own
        if found is not None and len(found):
            gives = share[found, columns]
            gives *= query.weights[held][:, None]
            first = np.flatnonzero(np.diff(item[held], prepend=-1))
            out[item[held][first]] += np.add.reduceat(gives, first, axis=0)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], query: Query) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids (null: the largest), keys and bounds of each block, with which ids are null."""
    for batch in batches:
        for i in range(len(batch)):
            own = batch.column(0)[i].values
            ids = own.fill_null(_LAST).to_numpy(zero_copy_only=False)
            keys, sizes = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2))
            yield ids, own.is_null().to_numpy(zero_copy_only=False), keys, bounds(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), sizes, query)


def _found(q: np.ndarray, ids: np.ndarray, null: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(ids, mask=null), pa.array(keys)], ["q", "id", "key"])


_FOUND = "q long, id long, key long"


def leaders(index: DataFrame, query: Query, k: int) -> DataFrame:
    """q, id, key of the documents with the k highest bounds of each item. A task keeps k of each item."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(query.starts) - 1
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * items
        least = np.zeros(items)
        for ids, null, keys, most in _blocks(batches, query):
            for q in np.flatnonzero((most > least[:, None]).any(axis=1)).tolist():
                new = np.flatnonzero(most[q] > least[q])
                both = [np.concatenate(x) for x in zip(best[q], (most[q][new], ids[new], null[new], keys[new]))]
                chosen = np.argsort(-both[0], kind="stable")[:k]
                best[q] = tuple(x[chosen] for x in both)
                least[q] = best[q][0][-1] if len(chosen) == k else 0
        for q, (most, ids, null, keys) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([*_found(np.full(len(ids), q), ids, null, keys).columns, pa.array(most)], ["q", "id", "key", "most"])

    found = index.mapInArrow(make, f"{_FOUND}, most double")
    w = Window.partitionBy("q").orderBy(F.desc("most"), F.asc_nulls_last("id"), "key")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).select("q", "id", "key")


def candidates(index: DataFrame, query: Query, least: np.ndarray, last: np.ndarray) -> DataFrame:
    """q, id, key of every document that may score above ``least``, or equal to it with an id up to ``last``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, null, keys, most in _blocks(batches, query):
            may = (most > least[:, None]) | ((most == least[:, None]) & (most > 0) & (ids <= last[:, None]))
            q, column = np.nonzero(may)
            if len(q):
                yield _found(q, ids[column], null[column], keys[column])

    return index.mapInArrow(make, _FOUND)


def scored(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, items: list[list[tuple[str, int]]], query: Query, k: int) -> DataFrame:
    """q, id, score of the pairs (q, id, key) with a score above 0, from the whole texts.

    Equal rows of documents are scored once; of their copies k are kept, as no more can be among the k best.
    """
    wanted = [dict(x) for x in items]
    documents, total = query.documents, query.terms

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, ids, scores, copies = [], [], [], []
            for i, text, asked in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2))):
                counts = Counter(_TERM.findall(text.translate(_CASE)))
                spread = 8 * (10 + 90 * counts.total() * documents // total)
                for one in asked:
                    held, own = wanted[one["q"]], counts if len(counts) < len(wanted[one["q"]]) else wanted[one["q"]]
                    score = sum(held[t] * (1_000_000_000 * counts[t] // (1000 * counts[t] + spread)) for t in own if t in held and t in counts)
                    if score > 0:
                        q.append(one["q"])
                        ids.append(i)
                        scores.append(score)
                        copies.append(one["n"])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, ids, scores, copies)], ["q", "id", "score", "n"])

    counted = pairs.groupBy("q", "id", "key").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    # At most one entry for each item of the batch.
    asked = stage(counted.groupBy("id", "key").agg(F.collect_list(F.struct("q", "n")).alias("asked")), "asked")
    text = F.col(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    joined = texts.join(asked, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_key") == F.col("key")))
    joined = joined.dropDuplicates(["id", "key"]).select("id", "_text", "asked")
    made = joined.mapInArrow(make, "q long, id long, score long, n long")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("q", "id", "score")


def _best(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def term_weights(docs: DataFrame, text_col: str, wanted: DataFrame, documents: int) -> DataFrame:
    """term, w of the wanted terms that some document holds."""
    held = docs.select(F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term"))
    counts = held.join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    return counts.select("term", weight.alias("w"))


def _batches(weighted: DataFrame) -> Iterator[tuple[list, list[list[tuple[str, int]]]]]:
    """Ids and weighted terms of some items at a time, at most BATCH_TERMS terms or one item."""
    ids, items, held = [], [], 0
    for row in weighted.toLocalIterator():
        if ids and held + len(row.terms) > BATCH_TERMS:
            yield ids, items
            ids, items, held = [], [], 0
        ids.append(row.item_id)
        items.append([(t.term, t.w) for t in row.terms])
        held += len(row.terms)
    if ids:
        yield ids, items


def search(
    docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item row."""
    spark = docs.sparkSession
    index = stage(signatures(docs, id_col, text_col), "signatures")
    size = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not size[1]:
        return out
    rows = stage(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")), "items")
    asked = stage(rows.select("row", "item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")), "terms")
    weights = stage(term_weights(docs, text_col, asked.select("term").distinct(), size[0]), "weights")
    weighted = asked.join(weights.filter("w > 0"), "term").groupBy("row", "item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
    for ids, chosen in _batches(weighted):
        terms = [t.encode() for x in chosen for t, _ in x]
        ends = np.cumsum([len(t) for t in terms])
        hashes = _hashes(np.frombuffer(b"".join(terms), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
        query = Query(hashes, np.array([w for x in chosen for _, w in x], float), np.cumsum([0] + [len(x) for x in chosen]), *size)
        best = _best(scored(leaders(index, query, k), docs, id_col, text_col, chosen, query, k), k).filter(F.col("rank") == k)
        least, last = np.zeros(len(ids)), np.full(len(ids), _LAST)
        for row in best.collect():  # one row an item of the batch
            least[row.q], last[row.q] = row.score, _LAST if row.id is None else row.id
        found = stage(candidates(index, query, least, last), "candidates")
        named = spark.createDataFrame(list(enumerate(ids)), "q long, item_id long")
        ranked = _best(scored(found, docs, id_col, text_col, chosen, query, k), k)
        out = out.unionByName(stage(ranked.join(named, "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "ranked"))
    return out
