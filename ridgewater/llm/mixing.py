"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. A source's documents fall into blocks by a hash of their ids, which is a random permutation, and
the stream of a source is its blocks in order, repeated as often as its target needs. A draw is one block of one
pass; the last draw of a source is cut so that its words equal the target rounded to a whole number. How many draws
of each source every output shard gets is decided by a tree: a node holds the exact draws per source of its shards
and splits them between its halves with a multivariate hypergeometric sample seeded by the node, so any task can
compute any part of the tree and reruns agree. Draws are dealt to the shards in a permuted order, without overlap,
and every shard is shuffled on its own.

Targets: the weights share 100 % of all words; no target is above ``most`` times its source's size, and what is
above is shared again by weight. Documents without words are never drawn. A null source is a source of its own. Rows
that repeat an id are documents of their own. No rows in, no rows out; without any words all targets are 0. The
table of sources, one row each, is held by the driver and by every tree task; nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewater.llm.words import WORD, fresh
from ridgewater.operators.scale import running_totals
from ridgewater.session import stage

BLOCK_WORDS = 65_536
SHARD_WORDS = 4_194_304
# Primes that carry a draw's number to its place in the permuted order.
_STRIDE, _OTHER_STRIDE = 1_000_003, 998_244_353


def count_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, rank, source_size, target from columns source and size. Weights go to the sources in code point order,
    null last, repeating.

    In order of size / weight the first sources are held at their limit; the level at which the rest share what is
    left is the first that does not exceed the next source's limit.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per_source.select(
        "*", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("long").alias("rank")
    ).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    levels = (
        ranked.withColumn("limit", F.col("source_size") * most)
        .withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    )
    return levels.select("source", "rank", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def shard_quotas(spark, quotas: dict[int, int], shards: int, seed: int = 0, group: int = 64) -> DataFrame:
    """shard, rank, start, n: draws ``start`` .. ``start + n - 1`` of a source's permuted order go to the shard."""
    ranks = np.array(sorted(quotas), np.int64)
    root = np.array([quotas[r] for r in ranks], np.int64)
    total, depth = int(root.sum()), max(0, int(shards - 1).bit_length())
    top = max(0, depth - max(0, int(group - 1).bit_length()))

    def upto(leaf: int) -> int:
        return total * min(leaf, shards) // shards

    def split(level: int, index: int, own: np.ndarray) -> np.ndarray:
        """What the left half gets of a node's draws."""
        width = 1 << (depth - level)
        wanted = upto(index * width + width // 2) - upto(index * width)
        return np.random.default_rng([seed, level, index]).multivariate_hypergeometric(own, wanted, method="marginals")

    def leaves(level: int, index: int, own: np.ndarray, start: np.ndarray) -> Iterator[pd.DataFrame]:
        if level == depth:
            has = own > 0
            if has.any():
                yield pd.DataFrame({"shard": index, "rank": ranks[has], "start": start[has], "n": own[has]})
            return
        left = split(level, index, own)
        yield from leaves(level + 1, 2 * index, left, start)
        yield from leaves(level + 1, 2 * index + 1, own - left, start + left)

    def subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node in batch["id"]:
                own, start = root, np.zeros_like(root)
                for level in range(top):
                    index = int(node) >> (top - level)
                    left = split(level, index, own)
                    if int(node) >> (top - level - 1) & 1:
                        own, start = own - left, start + left
                    else:
                        own = left
                yield from leaves(top, int(node), own, start)

    nodes = spark.range(1 << top)
    return nodes.mapInPandas(subtrees, "shard long, rank long, start long, n long")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 0,
    row_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, draws). Documents: row, id, source, size, source_size, target. Draws: row, id, copy, words, shard and
    position, the place of the draw in its shard's own shuffle. ``row_col`` names a column of unique row numbers; without
    it rows are numbered here."""
    spark = docs.sparkSession
    sizes = docs.select(
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        count_words(F.col(text_col)).alias("size"),
    )
    sizes = stage(sizes, "sizes")
    targets = stage(source_targets(sizes), "targets")
    joined = sizes.join(F.broadcast(targets), sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    joined = joined.withColumn("key", key).withColumn("wanted", F.floor(F.col("target") + 0.5))
    blocks_of = F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1)).cast("long")
    placed = joined.filter("size > 0").withColumn("block", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % blocks_of)
    placed = stage(placed.select("row", "id", "rank", "size", "source_size", "wanted", "key", "block"), "placed")

    blocks = placed.groupBy("rank", "block", "source_size", "wanted").agg(F.sum("size").alias("block_size"))
    blocks = running_totals(blocks, ["rank"], "block", {"upto": F.col("block_size"), "number": F.lit(1)})
    blocks = blocks.withColumn("begin", F.col("upto") - F.col("block_size"))
    passes = F.floor((F.col("wanted") - F.col("begin") + F.col("source_size") - 1) / F.col("source_size"))
    draws = blocks.select("*", F.explode(F.sequence(F.lit(1), F.greatest(passes, F.lit(1)).cast("int"))).alias("copy"))
    draws = draws.filter(F.col("begin") + (F.col("copy") - 1) * F.col("source_size") < F.col("wanted"))
    counts = blocks.groupBy("rank").agg(F.max("number").alias("per_pass"))
    draws = draws.join(F.broadcast(counts), "rank").withColumn("draw", (F.col("copy") - 1) * F.col("per_pass") + F.col("number") - 1)
    draws = stage(draws.select("rank", "block", "begin", "copy", "draw"), "draws")

    quotas = {r["rank"]: r["n"] for r in draws.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shards = max(1, -(-words // shard_words))
    dealt = shard_quotas(spark, quotas, shards, seed)
    places = dealt.select("shard", "rank", F.explode(F.expr("sequence(start, start + n - 1)")).alias("place"))
    amounts = draws.groupBy("rank").agg(F.count(F.lit(1)).alias("q"))
    stride = F.when(F.col("q") % _STRIDE == 0, F.lit(_OTHER_STRIDE)).otherwise(F.lit(_STRIDE))
    permuted = draws.join(F.broadcast(amounts), "rank").withColumn("place", (F.col("draw") * stride + seed) % F.col("q"))
    permuted = permuted.join(places, ["rank", "place"]).select("rank", "block", "begin", "copy", "shard")

    inside = Window.partitionBy("rank", "block").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("ahead"))
    room = F.col("wanted") - (F.col("copy") - 1) * F.col("source_size") - F.col("begin") - F.col("ahead")
    taken = within.join(permuted, ["rank", "block"]).withColumn("words", F.least(room, F.col("size"))).filter("words > 0")
    local = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "key", "copy"), "row", "copy")
    taken = taken.select("row", "id", "copy", "words", "size", "shard", F.row_number().over(local).alias("position"))
    return joined.select("row", "id", "source", "size", "source_size", "target"), taken


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars"
) -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as it is drawn, with all columns; the one document per source
    at which the target is reached has its text cut after the words that are taken, and its length set anew.

    A document that is never drawn is left out. Draws find their rows by a number that is written with the documents, so
    rows with a null or a repeated id come back as often as each of them is drawn.
    """
    row, drawn, words, size, cut_text = fresh(docs.columns, "__row", "__drawn", "__words", "__size", "__text")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    _, draws = mix_sources(numbered, id_col, text_col, source_col, row_col=row)
    draws = draws.select(F.col("row").alias(drawn), F.col("words").alias(words), F.col("size").alias(size))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, F.col(words).cast("int")), "")
    is_cut = F.col(words) < F.col(size)
    out = numbered.join(draws, F.col(row) == F.col(drawn)).withColumn(cut_text, F.when(is_cut, cut).otherwise(F.col(text_col)))
    columns = {c: F.col(c) for c in docs.columns} | {text_col: F.col(cut_text)}
    if length_col in columns:
        kind = dict(docs.dtypes)[length_col]
        columns[length_col] = F.when(is_cut, F.length(cut_text).cast(kind)).otherwise(F.col(length_col))
    return out.select(*[column.alias(name) for name, column in columns.items()])
