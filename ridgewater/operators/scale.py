"""Building blocks that keep large or lopsided data spread over the cluster.

Every helper is exact: hot keys are split and groups are cut into ranges, no row is dropped.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewater.session import stage

SMALL_SIDE_ROWS = 200_000
HOT_KEYS_AT_MOST = 1_000
HOT_KEY_MIN_ROWS = 1_000_000


def small_or_plain(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> tuple[DataFrame, bool]:
    """(df marked for broadcast, True) if it has at most ``max_rows`` rows, else (df, False)."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle into the session's full number of partitions, ahead of a step that multiplies small rows.

    Adaptive execution merges partitions by their bytes, which would leave few tasks for such a step.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_KEY_MIN_ROWS) -> DataFrame | None:
    """Keys holding more than 1/1000 of all rows (and at least ``min_rows``), with the splits each needs.

    At most HOT_KEYS_AT_MOST keys can pass the share test, so the result is always small enough to
    broadcast. None when the table is too small to have any.
    """
    total = df.count()
    if total <= min_rows:
        return None
    limit = max(min_rows, total // HOT_KEYS_AT_MOST)
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_splits"))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    row_id: str,
    how: str = "inner",
    min_rows: int = HOT_KEY_MIN_ROWS,
    max_rows: int = SMALL_SIDE_ROWS,
) -> DataFrame:
    """Equi-join of a large left table with a lookup table on the right.

    A right side of a checked size is broadcast and the left is never moved. Otherwise both sides are
    shuffled, and left keys that hold a large share of the rows are split by ``row_id`` while the
    matching right rows are repeated once per split.
    """
    right, small = small_or_plain(right, max_rows)
    if small:
        return left.join(right, keys, how)
    hot = hot_keys(left, keys, min_rows)
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    left = left.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(row_id), splits)).drop("_splits")
    right = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (splits - 1).cast("long"))))
        .drop("_splits")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _range_bucket(df: DataFrame, order: str, buckets: int | None) -> DataFrame:
    """Add ``_bucket``: which of about ``buckets`` equally filled ranges of ``order`` a row falls in."""
    spark = df.sparkSession
    wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(wanted, 2_000)
    if wanted <= 1:
        return df.withColumn("_bucket", F.lit(0.0))
    cuts = sorted(set(df.approxQuantile(order, [i / wanted for i in range(1, wanted)], 0.25 / wanted)))
    if not cuts:
        return df.withColumn("_bucket", F.lit(0.0))
    edges = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=edges, inputCol=order, outputCol="_bucket", handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame,
    group: list[str],
    order: str,
    sums: dict[str, Column],
    descending: bool = False,
    buckets: int | None = None,
    staged: bool = False,
) -> DataFrame:
    """Cumulative sums along ``order`` within ``group`` without putting a group in one task.

    Rows must be unique per (group, order), so aggregate first. The order column is cut into ranges;
    each range is summed on its own and receives the total of the ranges before it. The table of range
    totals has one row per group and range. ``sums`` maps each new column to what it accumulates. The
    input is read three times, so it is written out first unless ``staged`` says it already is.
    """
    df = df if staged else stage(df, "running")
    df = _range_bucket(df.withColumn("_order", F.col(order).cast("double")), "_order", buckets)
    df = df.select("*", *[c.alias(f"_in_{name}") for name, c in sums.items()])
    direction = F.desc if descending else F.asc
    totals = df.groupBy(*group, "_bucket").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*group).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = df.select("*", *[F.sum(f"_in_{n}").over(inside).alias(f"_r_{n}") for n in sums])
    out = out.join(offsets, [*group, "_bucket"])
    kept = [c for c in df.columns if not c.startswith("_in_") and c not in ("_order", "_bucket")]
    return out.select(*kept, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, probs: list[float], buckets: int | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group and probability.

    Equal values are counted first, then located by running totals, so neither a hot group nor a hot
    value is gathered in one task. Columns: the group, p, n, quantile.
    """
    if not group:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, buckets).drop("_all")
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = stage(counts, "counts")
    placed = running_totals(counts, group, value, {"_upto": F.col("_c")}, buckets=buckets, staged=True)
    sizes = counts.groupBy(*group).agg(F.sum("_c").alias("n"))
    placed = placed.join(sizes, group)
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    rank = F.col("p") * (F.col("n") - 1)
    lower, upper = F.floor(rank), F.ceil(rank)
    first, last = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    hits = placed.withColumn("p", wanted).filter((first <= upper) & (last >= lower))
    return (
        hits.groupBy(*group, "p", "n")
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .select(
            *group,
            "p",
            "n",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (rank - lower)).alias("quantile"),
        )
    )


def ordered_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running totals over all rows in the given order, without one task seeing all rows.

    The rows are sorted into ranges; each range is summed alone and receives the totals of those before it.
    """
    df = stage(df.orderBy(*order).select("*", F.spark_partition_id().alias("_range"), *[c.alias(f"_in_{n}") for n, c in sums.items()]), "sorted")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy("_range").agg(*[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums])
    ranges = ranges.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.select("*", *[F.sum(f"_in_{n}").over(inside).alias(f"_r_{n}") for n in sums]).join(ranges, "_range")
    kept = [c for c in df.columns if c != "_range" and not c.startswith("_in_")]
    return out.select(*kept, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def global_positions(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds the place of every row in the given order, from 0."""
    return ordered_totals(df, order, {name: F.lit(1)}).withColumn(name, F.col(name) - 1)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; Spark trims each task to one row per key before shuffling."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def carry_forward(
    df: DataFrame, group: list[str], order: list[str], values: list[str], buckets: int | None = None, inclusive: bool = True
) -> DataFrame:
    """As-of lookup: the last non-null value of each of ``values`` up to the row, within ``group``.

    Works on time ranges like ``running_totals``, so a group of any size is spread over many tasks. The
    first of ``order`` must be a timestamp or number; the others break ties. New columns: last_<value>.
    With ``inclusive`` false a row's own value does not count.
    """
    df = stage(df, "asof").withColumn("_order", F.col(order[0]).cast("double"))
    df = _range_bucket(df, "_order", buckets)
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    key = F.struct(*order)
    ends = df.groupBy(*group, "_bucket").agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), key)).alias(f"_end_{v}") for v in values]
    )
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(*group, "_bucket", *[F.last(f"_end_{v}", True).over(before).alias(f"_before_{v}") for v in values])
    out = df.select("*", *[F.last(v, True).over(frame).alias(f"_in_{v}") for v in values]).join(offsets, [*group, "_bucket"])
    return out.select(
        *[c for c in df.columns if c not in ("_order", "_bucket")],
        *[F.coalesce(f"_in_{v}", f"_before_{v}").alias(f"last_{v}") for v in values],
    )
