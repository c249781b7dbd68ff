"""Spelling correction of place names against a table of known places of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewater.functions.text import similarity
from ridgewater.session import stage


def _edits(length: Column, least: float) -> Column:
    """How many edits a pair may have whose longer word has this length."""
    return F.floor(F.round(length * (1.0 - least), 9)).cast("int")


def _segment(length: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """(start from 0, length) of the i-th of ``parts`` segments of a word, which differ by one letter at most."""
    start = F.floor(length * i / parts).cast("int")
    return start, F.floor(length * (i + 1) / parts).cast("int") - start


def similar_names(words: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """(word, name, score) for all pairs with 1 - edit distance / longer length >= ``least``, case ignored.

    ``words``: word; ``names``: name; both distinct. A name is cut into one segment more than a pair of these two
    lengths may have edits, so a similar word holds one of them unchanged, moved by no more letters than the edits
    before and after it allow. Both sides are joined on lengths, segment and its text; no pair that shares none is
    ever made, and the distances of the others are then worked out. ``least`` must be above 0.5 (a segment would
    be empty otherwise). Null and empty words have no similar names.
    """
    if not 0.5 < least <= 1:
        raise ValueError("the least similarity must be above 0.5 and at most 1")

    def other_lengths(n: Column) -> Column:
        # The longer length M of a pair gives the shorter at least M - edits(M).
        return F.filter(F.sequence(F.lit(1), F.ceil(n / least).cast("int")), lambda m: F.abs(n - m) <= _edits(F.greatest(n, m), least))

    def lengths_of(df: DataFrame, text: str) -> DataFrame:
        return df.select(F.length(F.lower(text)).alias("_o")).distinct()

    # Lengths that the other side has: one row each, so that odd long words are not cut for nobody.
    there = {False: lengths_of(names, "name"), True: lengths_of(words, "word")}

    def keyed(df: DataFrame, text: str, name_side: bool) -> DataFrame:
        low = df.select(F.col(text), F.lower(text).alias("_t")).filter("length(_t) > 0").withColumn("_n", F.length("_t"))
        pairs = low.select(text, "_t", "_n", F.explode(other_lengths(F.col("_n"))).alias("_o")).join(there[name_side], "_o", "left_semi")
        pairs = pairs.withColumn("_k", _edits(F.greatest("_n", "_o"), least))
        cut = pairs.select("*", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("seg"))
        name_len = F.col("_n") if name_side else F.col("_o")
        start, width = _segment(name_len, F.col("_k") + 1, F.col("seg"))
        if name_side:
            starts = F.array(start)
        else:
            moved = F.col("_n") - F.col("_o")
            first = F.greatest(start - F.col("seg"), start + moved - (F.col("_k") - F.col("seg")), F.lit(0))
            last = F.least(start + F.col("seg"), start + moved + (F.col("_k") - F.col("seg")), F.col("_n") - width)
            starts = F.when(first <= last, F.sequence(first, last))
        pieces = F.array_distinct(F.transform(starts, lambda s: F.substr(F.col("_t"), s + 1, width)))
        lengths = ("_o", "_n") if name_side else ("_n", "_o")
        return cut.select(text, F.col(lengths[0]).alias("word_len"), F.col(lengths[1]).alias("name_len"), "seg", F.explode(pieces).alias("piece"))

    on = ["word_len", "name_len", "seg", "piece"]
    met = keyed(words, "word", False).join(keyed(names, "name", True), on).select("word", "name").distinct()
    return met.withColumn("score", similarity(F.col("word"), F.col("name"))).filter(F.col("score") >= least)


def correct_spelling(queries: DataFrame, query: str, places: DataFrame, least: float = 0.6) -> DataFrame:
    """``queries`` with ``fixed``: the first comma-separated part replaced by the most similar known place.

    ``places``: place and position; of equally similar places the first counts, then the least name. A query stays as it is where its
    part is empty or null, nothing is similar enough, or the best place is that part, case ignored. Each spelling is
    looked up once, however many queries have it.
    """
    first = F.trim(F.element_at(F.split(F.col(query), ","), 1))
    asked = stage(queries.withColumn("_word", first), "asked")
    words = asked.select(F.col("_word").alias("word")).filter("length(word) > 0").distinct()
    known = places.groupBy(F.col("place").alias("name")).agg(F.min("position").alias("position"))
    scored = similar_names(words, known.select("name"), least).join(known, "name")
    order = F.struct((-F.col("score")).alias("_s"), "position", "name")
    best = scored.groupBy(F.col("word").alias("_word")).agg(F.min_by("name", order).alias("_best"))
    whole, at = F.col(query), F.position(F.col("_word"), F.col(query))
    swapped = F.concat(F.left(whole, at - 1), F.col("_best"), F.substr(whole, at + F.length("_word")))
    wanted = F.col("_best").isNotNull() & (F.lower("_best") != F.lower("_word"))
    joined = asked.join(best, "_word", "left")
    return joined.select(*queries.columns, F.when(wanted, swapped).otherwise(whole).alias("fixed"))
