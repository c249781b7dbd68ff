"""Document fingerprints from closed syncmers.

The sequence is the words of a text. A k-mer of ``k`` words is an anchor if the least hash of its inner ``s``-word
substrings lies at its first or last place; that depends on the k-mer alone, so a passage has the same anchors wherever
it stands. The fingerprint is the ``size`` smallest distinct anchor hashes in order, as eight hex digits each.
A text of fewer than ``k`` words, or without any anchor, has one anchor made of all its words; a text without words
has the empty fingerprint.

The likeness of two fingerprints is their share of the ``size`` smallest hashes of both together (1 for two empty
ones). Only built-in column functions are used, each word is visited a fixed number of times, and long texts stay
one row. A null text is empty. The next document is the next in descending id, null last, then by content; repeated
rows follow each other; a single row follows itself. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewater.llm.words import SPACE
from ridgewater.session import stage

K, S, SIZE = 3, 1, 64


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S, size: int = SIZE) -> DataFrame:
    """Add ``out``, the sorted array of the smallest anchor hashes. Steps are separate projections, so that each array is
    made once and not once per use."""
    plain = [c for c in df.columns if c != out]
    words = F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SPACE + "+"), "")
    df = df.select(*plain, F.transform(words, lambda w: F.xxhash64(w)).alias("__words"))
    if s == 1:
        df = df.withColumn("__inner", F.col("__words"))
    else:
        starts = F.sequence(F.lit(1), F.greatest(F.size("__words") - (s - 1), F.lit(1)))
        df = df.withColumn("__inner", F.transform(starts, lambda i: F.xxhash64(F.slice("__words", i, s))))
    gap = k - s

    def anchor(first: Column, i: Column) -> Column:
        inner = [F.get("__inner", i + j) for j in range(1, gap)]
        edge = F.least(F.get("__inner", i), F.get("__inner", i + gap))
        kmer = F.hash(first, *[F.get("__words", i + j) for j in range(1, k)])
        return F.when(edge <= F.least(edge, *inner), kmer) if inner else kmer

    found = F.transform(F.slice("__words", F.lit(1), F.greatest(F.size("__words") - (k - 1), F.lit(0))), anchor)
    df = df.select(*plain, "__words", F.array_compact(found).alias("__found"))
    whole = F.when(F.size("__words") > 0, F.array(F.hash("__words"))).otherwise(F.array().cast("array<int>"))
    every = F.when(F.size("__found") > 0, F.col("__found")).otherwise(whole)
    return df.select(*plain, F.slice(F.sort_array(F.array_distinct(every)), 1, size).alias(out))


def as_text(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: str, b: str, size: int = SIZE) -> Column:
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(least) > 0, shared / F.size(least)).otherwise(F.lit(1.0))


def with_next(df: DataFrame, id_col: str, carried: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: its value in the next row in descending order of the id.

    Ids are cut into equally filled ranges and each range is ordered alone; the first row of the range that follows is
    appended to it, so text moves in one shuffle only and no task sees more than its range.
    """
    spark = df.sparkSession
    names = df.columns
    tie = F.xxhash64(*carried)
    ids = stage(df.select(F.col(id_col).alias("id"), tie.alias("tie")), "ids")
    buckets = min(2_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(ids.withColumn("at", F.col("id").cast("double")).approxQuantile("at", [i / buckets for i in range(1, buckets)], 0.25 / buckets)))
    edges = [float("-inf"), *cuts, float("inf")]

    def ranged(rows: DataFrame, column: str) -> DataFrame:
        rows = rows.withColumn("__at", F.col(column).cast("double"))
        if not cuts:
            return rows.withColumn("__range", F.when(F.col("__at").isNull(), -1.0).otherwise(0.0)).drop("__at")
        rows = Bucketizer(splits=edges, inputCol="__at", outputCol="__range", handleInvalid="keep").transform(rows)
        return rows.withColumn("__range", F.when(F.col("__at").isNull(), -1.0).otherwise(F.col("__range"))).drop("__at")

    heads = ranged(ids, "id").groupBy("__range").agg(F.max(F.struct("id", "tie")).alias("head"))
    everywhere = Window.partitionBy()
    above = F.lag("__range").over(Window.orderBy(F.desc("__range")))
    heads = heads.select(F.coalesce(above, F.min("__range").over(everywhere)).alias("__goes"), "head")
    heads = heads.select(F.col("__goes"), F.col("head.id").alias("__hid"), F.col("head.tie").alias("__htie"))
    marked = df.withColumn("__tie", tie)
    first = marked.join(F.broadcast(heads), F.col(id_col).eqNullSafe(F.col("__hid")) & (F.col("__tie") == F.col("__htie")))
    first = first.dropDuplicates(["__goes"]).select(*names, "__tie", F.col("__goes").alias("__range"), F.lit(True).alias("__extra"))
    rows = ranged(marked, id_col).select(*names, "__tie", "__range", F.lit(False).alias("__extra"))
    order = Window.partitionBy("__range").orderBy("__extra", F.desc_nulls_last(id_col), F.desc("__tie"))
    out = rows.unionByName(first).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return out.filter("not __extra").drop("__tie", "__range", "__extra")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text and anchors of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_anchors(rows, "text", "anchors")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: how a fingerprint takes the
    replacement of the last half of a text by the beginning of the next one."""
    rows = with_next(fingerprints(docs, id_col, text_col), "id", ["text", "anchors"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.expr("left(next_text, cast(floor(n_chars / 2) as int))"))
    rows = rows.select("id", "n_chars", "anchors", "next_anchors", edited.alias("edited"))
    rows = with_anchors(rows, "edited", "edited_anchors")
    return rows.select(
        "id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("anchors").alias("fingerprint"),
        as_text("edited_anchors").alias("edited_fingerprint"),
        likeness("anchors", "edited_anchors").alias("near_edited"),
        likeness("anchors", "next_anchors").alias("near_next"),
    )
