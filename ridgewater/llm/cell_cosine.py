"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

1. Equal vectors of one label become one class with a count.
2. Spherical k-means on a bounded sample of classes (``SAMPLE`` vectors, ``SAMPLE_VALUES`` numbers at most) gives the
   centres; every class lies in the cell of the centre with the largest product.
3. A class also visits each cell whose bisecting plane with its own lies within half the longest chord of a link. Of two
   linked vectors in different cells at least one lies that close to the plane, so no link is lost: recall is 1 at every
   number of cells. What both see is counted in the cell with the lower number.
4. The classes of one label in one cell are cut into blocks; every two blocks meet in a group of their own, which takes the
   products in double precision and returns each vector's count of links and its smallest partner by connection inside the
   group: one row a vector, never the pairs.
5. Components of these connections over all groups; the smallest id of a component stays.

Vectors that are null, empty, all zero or hold null or non-finite components, and vectors with a null label, link with
nothing; so do vectors of different lengths. Rows that repeat an id are vectors of their own. A null id takes part but is
never a component's smallest id; if no other is reachable component_id is null and the row stays. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewater.operators.graph import components
from ridgewater.operators.scale import spread_join
from ridgewater.session import stage

LIKE = 0.98
# Vectors and numbers that the centres are fitted on at most; classes for each centre; centres at most; rounds of fitting.
SAMPLE, SAMPLE_VALUES, EACH, MOST, ROUNDS = 20_000, 4_000_000, 4_000, 1_000, 10
# Centres at least, so that small tables take the same way as large ones.
FEWEST = 8
BLOCK = 1_024


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    number = vector.cast("array<double>")
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(number, lambda x: x != 0), F.lit(False))


def _units(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors; scaled by the largest part first, so squares neither vanish nor overflow."""
    made = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    made /= np.abs(made).max(axis=1, keepdims=True)
    return made / np.sqrt((made * made).sum(axis=1, keepdims=True))


def _flat(made: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` parts, zeros where there are fewer."""
    return made[:, :size] if made.shape[1] >= size else np.pad(made, ((0, 0), (0, size - made.shape[1])))


def centres(classes: DataFrame, wanted: int) -> np.ndarray:
    """Spherical k-means on a sample that depends only on the vectors."""
    n, longest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    most = max(1, min(SAMPLE, SAMPLE_VALUES // longest))
    share = F.pmod(F.xxhash64("vector"), F.lit(1 << 30))
    chosen = classes.filter(share < math.ceil(min(1.0, most / n) * (1 << 30)))
    rows = chosen.select("vector", share.alias("s")).limit(2 * most).collect()
    rows.sort(key=lambda r: (r.s, list(r.vector)))
    held = np.concatenate([_flat(_units(pa.array([r.vector], pa.list_(pa.float64()))), longest) for r in rows] or [np.zeros((0, longest))])
    if not len(held):
        return np.eye(1, longest)
    made = held[np.linspace(0, len(held) - 1, min(wanted, len(held))).astype(int)]
    for _ in range(ROUNDS):
        cell = (held @ made.T).argmax(axis=1)
        sums = np.zeros_like(made)
        np.add.at(sums, cell, held)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        made = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), made)
    return made


def in_cells(classes: DataFrame, made: np.ndarray, like: float = LIKE) -> DataFrame:
    """One row for each class and cell it lies in or visits: also home (the cell it lies in) and visits (all others)."""
    apart = np.sqrt(np.maximum(((made[:, None] - made[None]) ** 2).sum(axis=2), 0)) if len(made) <= 64 else None
    half = math.sqrt(max(0.0, 2 - 2 * like)) / 2 + 1e-9
    size = made.shape[1]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy()
            for length in np.unique(lengths):
                for at in np.array_split(np.flatnonzero(lengths == length), -(-int((lengths == length).sum()) // 1000)):
                    few = batch.take(pa.array(at))
                    products = _flat(_units(few.column("vector")), size) @ made.T
                    home = products.argmax(axis=1)
                    gap = apart[home] if apart is not None else np.sqrt(np.maximum(2 - 2 * made[home] @ made.T, 0)) + 1e-7
                    sees = products[np.arange(len(at)), home][:, None] - products <= half * gap
                    sees[np.arange(len(at)), home] = True
                    row, cell = np.nonzero(sees)
                    kept = few.take(pa.array(row))
                    ends = np.cumsum(np.bincount(row, minlength=len(at)))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(cell.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, pa.array(cell.astype(np.int32)), pa.array(home[row].astype(np.int32)), lists.take(pa.array(row))],
                        [*kept.schema.names, "cell", "home", "visits"],
                    )

    kinds = ", ".join(f"{n} {t}" for n, t in classes.dtypes)
    return classes.mapInArrow(make, f"{kinds}, cell int, home int, visits array<int>")


def _sees(rows: pd.DataFrame, homes: np.ndarray) -> np.ndarray:
    """Whether each row sees each of the (sorted) cells."""
    out = np.zeros((len(rows), len(homes)), bool)
    every, line = np.concatenate(list(rows["visits"])), np.repeat(np.arange(len(rows)), rows["visits"].map(len))
    at = np.minimum(np.searchsorted(homes, every), len(homes) - 1)
    hit = homes[at] == every
    out[line[hit], at[hit]] = True
    return out


def _counted_here(guests: pd.DataFrame, hosts: pd.DataFrame, cell: int) -> np.ndarray:
    """For guests (lines) and hosts (columns) of a cell: not counted in the guest's own cell already."""
    homes, place = np.unique(guests["home"].to_numpy(), return_inverse=True)
    return ~(_sees(hosts, homes) & (homes < cell))[:, place].T


def linked_in_blocks(placed: DataFrame, like: float = LIKE, block: int = BLOCK) -> DataFrame:
    """class, links (vectors linked within the group), root (the smallest class connected within the group)."""
    keys = ["label", "length", "cell"]
    sizes = placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cut = placed.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cut = cut.select(*keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "n", "vector", "home", "visits")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("class", ignore_index=True)
        cell, low, high = int(rows["cell"].iloc[0]), rows["low"].iloc[0], rows["high"].iloc[0]
        made = _units(pa.array(rows["vector"], pa.list_(pa.float64())))
        near = made @ made.T >= like
        near |= near.T
        np.fill_diagonal(near, False)
        own = rows["own"].to_numpy()
        if low != high:
            near &= own[:, None] != own[None, :]
        guest = (rows["home"] != cell).to_numpy()
        near[np.ix_(guest, guest)] = False
        if near.any() and guest.any():
            here = _counted_here(rows[guest], rows[~guest], cell)
            near[np.ix_(guest, ~guest)] &= here
            near[np.ix_(~guest, guest)] &= here.T
        links = near @ rows["n"].to_numpy(np.int64)
        root, left = np.arange(len(rows)), links > 0
        while left.any():
            start = int(left.argmax())
            front = np.array([start])
            left[start] = False
            while len(front):
                root[front] = start
                front = np.flatnonzero(near[front].any(axis=0) & left)
                left[front] = False
        some = links > 0
        ids = rows["class"].to_numpy()
        return pd.DataFrame({"class": ids[some], "links": links[some], "root": ids[root][some]})

    return cut.groupBy(*keys, "low", "high").applyInPandas(compare, "class long, links long, root long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", like: float = LIKE
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``; ``like`` is above 0."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    usable = F.coalesce(F.col("label").isNotNull() & _usable(F.col("vector")), F.lit(False))
    rows = stage(rows.withColumn("usable", usable), "vectors")
    able = rows.filter("usable").drop("usable")
    classes = able.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
    classes = classes.select("label", F.size("vector").alias("length"), "vector", "id", "n", F.monotonically_increasing_id().alias("class"))
    classes = stage(classes, "classes")
    count = classes.count()
    made = centres(classes, max(FEWEST, min(MOST, count // EACH))) if count else np.eye(1)
    placed = stage(in_cells(classes.drop("id"), made, like), "cells")
    found = stage(linked_in_blocks(placed, like), "links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    names = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")).filter("a != b"))
    named = classes.join(links, "class", "left").join(names.withColumnRenamed("node", "class"), "class", "left")
    named = stage(
        named.select("label", "vector", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component")),
        "named",
    )
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stage(spread_join(named, least, ["component"], "id").select("label", "vector", "n_links", "component_id"), "named")
    out = spread_join(able, named, ["label", "vector"], "vec_id", max_rows=0).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.col("component_id").isNull() | F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.unionByName(alone).withColumn("kept", kept)
