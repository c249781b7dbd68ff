"""Threshold calibration against recorded events.

Hold-out years are handled by keeping one running count per year beside the total: what the other
years say about a value is the total minus the year's own count. Nothing is refitted in a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgewater.functions.columns import let
from ridgewater.operators.rain import FLOOD_WINDOWS, day_peaks, in_season, running_total
from ridgewater.operators.scale import exact_quantiles, running_totals, spread_join
from ridgewater.session import stage

EXCLUSION_DAYS = 3
LONGEST_EVENT_DAYS = 6
MOST_YEARS = 400


def _years(df: DataFrame, year: str) -> list[int]:
    found = [r[0] for r in df.select(year).distinct().limit(MOST_YEARS + 1).collect()]
    if len(found) > MOST_YEARS:
        raise ValueError(f"more than {MOST_YEARS} values of {year}")
    return sorted(y for y in found if y is not None)


def _pick_year(columns: dict[int, Column], year: Column) -> Column:
    """The column belonging to the row's year."""
    out = None
    for y, c in columns.items():
        out = F.when(year == y, c) if out is None else out.when(year == y, c)
    return out


def year_counts(df: DataFrame, keys: list[str], value: str, year: str, years: list[int], counted: Column) -> DataFrame:
    """Per key and distinct value: ``upto_<year>``, rows of that year with ``counted`` true and value <= v."""
    per_year = [F.sum(F.when((F.col(year) == y) & counted, 1).otherwise(0)).alias(f"_n{y}") for y in years]
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*per_year)
    placed = running_totals(counts, keys, value, {f"upto_{y}": F.col(f"_n{y}") for y in years})
    return placed.select(*keys, value, *[f"upto_{y}" for y in years])


def other_years_share(df: DataFrame, reference: DataFrame, keys: list[str], value: str, year: str, row_id: str) -> DataFrame:
    """Share of the key's reference values of other years that are <= the row's value (null with one year).

    Every value of ``df`` must occur in ``reference`` for its key, as a window's peak occurs among its totals.
    """
    years = _years(reference, year)
    placed = year_counts(reference, keys, value, year, years, F.lit(True))
    sizes = reference.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        *[F.sum(F.when(F.col(year) == y, 1).otherwise(0)).alias(f"_size{y}") for y in years]
    )
    joined = spread_join(df, placed, [*keys, value], row_id).join(sizes, keys)
    every = sum((F.col(f"upto_{y}") for y in years), F.lit(0))
    n = sum((F.col(f"_size{y}") for y in years), F.lit(0))
    own = _pick_year({y: F.col(f"upto_{y}") for y in years}, F.col(year))
    own_n = _pick_year({y: F.col(f"_size{y}") for y in years}, F.col(year))
    rest = n - own_n
    return joined.select(*df.columns, ((every - own) / F.when(rest > 0, rest)).alias("share"))


def relative_predictors(hourly: DataFrame, windows: dict[str, int] = FLOOD_WINDOWS) -> DataFrame:
    """District-day rarity per window: the day's peak against the cell's own totals of other years.

    ``hourly``: district, point_id, year, ts, mm. The rarest cell of the district counts.
    Columns: district, year, day, <window>_rel.
    """
    keys = ["district", "point_id", "year"]
    names = list(windows)
    totals = hourly.select(*keys, *[running_total(h, keys).alias(w) for w, h in windows.items()])
    reference = totals.unpivot(keys, names, "window_name", "mm")
    peaks = day_peaks(hourly, windows).unpivot([*keys, "day"], names, "window_name", "mm")
    peaks = peaks.withColumn("row_id", F.xxhash64(*keys, "day", "window_name"))
    rated = other_years_share(peaks, reference, ["district", "point_id", "window_name"], "mm", "year", "row_id")
    worst = rated.groupBy("district", "year", "day", "window_name").agg(F.max("share").alias("share"))
    return worst.groupBy("district", "year", "day").agg(
        *[F.max(F.when(F.col("window_name") == w, F.col("share"))).alias(f"{w}_rel") for w in names]
    )


def build_episodes(days: DataFrame, gap_days: int = EXCLUSION_DAYS) -> DataFrame:
    """Event days of a district joined into episodes: next day at most ``gap_days`` later, end capped at a week.

    ``days``: district, day (repeats allowed). Columns: district, start, end, n_days.
    """
    distinct = days.select("district", "day").distinct()
    w = Window.partitionBy("district").orderBy("day")
    fresh = F.coalesce((F.datediff("day", F.lag("day").over(w)) > gap_days).cast("int"), F.lit(1))
    numbered = distinct.withColumn("_new", fresh).withColumn("_episode", F.sum("_new").over(w))
    return (
        numbered.groupBy("district", "_episode")
        .agg(F.min("day").alias("start"), F.max("day").alias("_last"), F.count(F.lit(1)).alias("n_days"))
        .select("district", "start", F.least(F.col("_last"), F.date_add("start", LONGEST_EVENT_DAYS)).alias("end"), "n_days")
    )


def label_days(
    frame: DataFrame, events: DataFrame, predictors: list[str], carried: list[str] | None = None,
    positive_kinds: tuple = ("rain",),
) -> DataFrame:
    """Labelled cases: one positive per event and district, negatives away from every event.

    ``frame``: district, day, predictors and carried columns. ``events``: event_id, district, start, end, kind.
    Predictors take their maximum over the event, carried columns the first day's value. Days within three
    days of any event are no negatives. An event outside the season forms no positive.
    """
    carried = carried or []
    span = events.withColumn("day", F.explode(F.sequence("start", "end")))
    during = span.filter(F.col("kind").isin(*positive_kinds) & in_season(F.col("start"))).select("event_id", "district", "day")
    positives = (
        frame.join(during, ["district", "day"])
        .groupBy("event_id", "district")
        .agg(
            F.min("day").alias("day"),
            *[F.max(p).alias(p) for p in predictors],
            *[F.min_by(c, "day").alias(c) for c in carried],
        )
        .withColumn("label", F.lit(1))
    )
    around = events.select(
        "district", F.explode(F.sequence(F.date_sub("start", EXCLUSION_DAYS), F.date_add("end", EXCLUSION_DAYS))).alias("day")
    ).distinct()
    negatives = (
        frame.join(around, ["district", "day"], "left_anti")
        .select(F.lit(None).cast(positives.schema["event_id"].dataType).alias("event_id"), "district", "day", *predictors, *carried)
        .withColumn("label", F.lit(0))
    )
    return positives.select(negatives.columns).unionByName(negatives)


def _long(frame: DataFrame, windows: list[str], keep: list[str]) -> DataFrame:
    return frame.unpivot(keep, windows, "window_name", "_value")


def fold_scores(frame: DataFrame, windows: list[str], row_id: str, year: str = "year", label: str = "label") -> tuple[DataFrame, list[int]]:
    """Any-window score of every row under every hold-out year: row_id, year, label, score_<fold>.

    The score is the largest share, over windows, of the training years' dry values at or below the row's.
    """
    years = _years(frame, year)
    keep = [row_id, year, label]
    long = _long(frame, windows, keep)
    placed = year_counts(long, ["window_name"], "_value", year, years, F.col(label) == 0)
    dry = {
        r[year]: r["n"]
        for r in frame.filter(F.col(label) == 0).groupBy(year).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per year
    }
    total = sum(dry.values())
    joined = spread_join(long.filter(F.col("_value").isNotNull()), placed, ["window_name", "_value"], row_id)
    every = sum((F.col(f"upto_{y}") for y in years), F.lit(0))
    shares = [
        F.max((every - F.col(f"upto_{y}")) / F.lit(max(1, total - dry.get(y, 0)))).alias(f"score_{y}") for y in years
    ]
    return joined.groupBy(*keep).agg(*shares), years


def fixed_false_alarm(
    frame: DataFrame, windows: list[str], targets: list[float], row_id: str, year: str = "year", label: str = "label"
) -> DataFrame:
    """Leave-one-year-out flags at fixed false-alarm targets: row_id, year, label, target, score, cut, flag.

    Each year is scored against the other years; its cut is their dry scores' (1 - target) quantile and the
    flag is score > cut.
    """
    scored, years = fold_scores(frame, windows, row_id, year, label)
    scored = stage(scored, "fold-scores")
    folds = F.explode(F.array(*[F.struct(F.lit(y).alias("fold"), F.col(f"score_{y}").alias("score")) for y in years]))
    training = scored.filter(F.col(label) == 0).select(year, folds.alias("_f")).filter(F.col(year) != F.col("_f.fold"))
    cuts = exact_quantiles(
        training.select("_f.fold", "_f.score"), ["fold"], "score", sorted({1.0 - t for t in targets})
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(1.0 - t).alias("p")) for t in targets]))
    own = scored.select(
        row_id, year, label, _pick_year({y: F.col(f"score_{y}") for y in years}, F.col(year)).alias("score"), wanted.alias("_t")
    )
    cut = F.broadcast(cuts.select(F.col("fold").alias(year), "p", F.col("quantile").alias("cut")))  # years x targets rows
    return (
        own.select(row_id, year, label, "score", "_t.target", "_t.p")
        .join(cut, [year, "p"])
        .select(row_id, year, label, "target", "score", "cut", (F.col("score") > F.col("cut")).alias("flag"))
    )


def operating_curve(frame: DataFrame, windows: list[str], targets: list[float], row_id: str) -> DataFrame:
    """Contingency scores per false-alarm target."""
    from ridgewater.operators.verify import confusion

    return confusion(fixed_false_alarm(frame, windows, targets, row_id), "flag", "label", ["target"], rounded=False)


def thresholds_at(frame: DataFrame, windows: list[str], target: float, row_id: str, label: str = "label") -> DataFrame:
    """The rule fitted on all years as one threshold per window: window_name, p, threshold."""
    dry = frame.filter(F.col(label) == 0)
    long = _long(dry, windows, [row_id])
    counts = long.groupBy("window_name", "_value").agg(F.count(F.lit(1)).alias("_c"))
    placed = running_totals(counts, ["window_name"], "_value", {"_upto": F.col("_c")}).drop("_c")
    n = dry.count()
    scores = (
        spread_join(long, placed, ["window_name", "_value"], row_id)
        .groupBy(row_id)
        .agg(F.max(F.col("_upto") / F.lit(max(1, n))).alias("score"))
    )
    p = exact_quantiles(scores, [], "score", [1.0 - target]).first()["quantile"]
    p = min(p, 1.0)
    return exact_quantiles(long, ["window_name"], "_value", [p]).select(
        "window_name", "p", F.col("quantile").alias("threshold")
    )


def best_tss_by_year(frame: DataFrame, windows: list[str], year: str = "year", label: str = "label") -> DataFrame:
    """Per hold-out year and window the best-TSS cut of the other years: fold, window_name, threshold, tss."""
    years = _years(frame, year)
    rounded = F.when(F.col(label) == 1, F.round("_value", 5)).otherwise(F.col("_value"))
    long = _long(frame, windows, [year, label])
    # A positive's value rounded to 5 places is the candidate; the original value is what gets flagged.
    tagged = long.filter(F.col("_value").isNotNull()).withColumn(
        "_rows",
        F.when(
            (F.col(label) == 1) & (rounded != F.col("_value")),
            F.array(F.struct(F.col("_value").alias("v"), F.lit(1).alias("n"), F.lit(0).alias("cand")),
                    F.struct(rounded.alias("v"), F.lit(0).alias("n"), F.lit(1).alias("cand"))),
        ).otherwise(F.array(F.struct(F.col("_value").alias("v"), F.lit(1).alias("n"), F.col(label).cast("int").alias("cand")))),
    )
    rows = tagged.select("window_name", year, label, F.inline("_rows"))
    counts = rows.groupBy("window_name", "v").agg(
        *[F.sum(F.when((F.col(year) == y) & (F.col(label) == k), F.col("n")).otherwise(0)).alias(f"_n{k}_{y}") for y in years for k in (0, 1)],
        *[F.sum(F.when(F.col(year) == y, F.col("cand")).otherwise(0)).alias(f"_cand_{y}") for y in years],
    )
    placed = running_totals(
        counts, ["window_name"], "v", {f"ge{k}_{y}": F.col(f"_n{k}_{y}") for y in years for k in (0, 1)}, descending=True
    )
    sizes = {
        (r[year], r[label]): r["n"] for r in frame.groupBy(year, label).agg(F.count(F.lit(1)).alias("n")).collect()  # 2 per year
    }
    total = {k: sum(n for (_, kk), n in sizes.items() if kk == k) for k in (0, 1)}

    def others(prefix: str, held: int) -> Column:
        return sum((F.col(f"{prefix}_{y}") for y in years if y != held), F.lit(0))

    options = [
        F.struct(
            F.lit(y).alias("fold"),
            (
                others("ge1", y) / F.lit(max(1, total[1] - sizes.get((y, 1), 0)))
                - others("ge0", y) / F.lit(max(1, total[0] - sizes.get((y, 0), 0)))
            ).alias("tss"),
            others("_cand", y).alias("cand"),
        )
        for y in years
    ]
    each = placed.select("window_name", "v", F.explode(F.array(*options)).alias("o")).filter("o.cand > 0")
    best = each.groupBy(F.col("o.fold").alias("fold"), "window_name").agg(
        F.max(F.struct(F.col("o.tss").alias("tss"), (-F.col("v")).alias("neg"))).alias("b")
    )
    return best.select("fold", "window_name", (-F.col("b.neg")).alias("threshold"), F.col("b.tss").alias("tss"))


def leave_one_year_out(frame: DataFrame, windows: list[str], row_id: str, year: str = "year", label: str = "label") -> DataFrame:
    """Flags of the best-TSS rule for each held-out year: row_id, year, label, flag."""
    cuts = best_tss_by_year(frame, windows, year, label).select(F.col("fold").alias(year), "window_name", "threshold")
    long = _long(frame, windows, [row_id, year, label]).join(F.broadcast(cuts), [year, "window_name"], "left")  # years x windows
    hit = F.coalesce(F.col("_value") >= F.col("threshold"), F.lit(False))
    return long.groupBy(row_id, year, label).agg(F.max(hit).alias("flag"))


def baseline_flags(frame: DataFrame, zone_thresholds: DataFrame, windows: list[str], row_id: str) -> DataFrame:
    """Flags of a threshold table: the lowest threshold of a district's zones decides each window.

    ``zone_thresholds``: district, window_name, threshold. Adds ``flag`` and ``covered``.
    """
    lowest = zone_thresholds.groupBy("district", "window_name").agg(F.min("threshold").alias("threshold"))
    long = _long(frame, windows, [row_id, "district", "label"]).join(lowest, ["district", "window_name"], "left")
    return long.groupBy(row_id, "district", "label").agg(
        F.max(F.coalesce(F.col("_value") >= F.col("threshold"), F.lit(False))).alias("flag"),
        F.max(F.col("threshold").isNotNull()).alias("covered"),
    )


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear value of sorted (xs, ys) at x, flat beyond the ends; the last of equal xs counts."""

    def at(j: Column) -> Column:
        x0, x1, y0, y1 = (F.try_element_at(a, k) for a in (xs, ys) for k in (F.greatest(j, F.lit(1)), j + 1))
        return (
            F.when(j == 0, F.element_at(ys, 1))
            .when(j >= F.size(xs), F.element_at(ys, -1))
            .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
        )

    return let(F.size(F.filter(xs, lambda e: e <= x)), at)


def to_live_units(mm: Column, archive_q: Column, live_q: Column, levels: Column) -> Column:
    """An archive amount as the live feed's amount of the same rarity; beyond the last quantile the ratio is kept."""
    top, live_top = F.element_at(archive_q, -1), F.element_at(live_q, -1)
    mapped = let(interpolate(mm, archive_q, levels), lambda level: interpolate(level, levels, live_q))
    return F.when(mm >= top, mm * live_top / top).otherwise(mapped)


def bias_table(pairs: DataFrame, levels: list[float], by: list[str]) -> DataFrame:
    """Quantile vectors, correlation and p99 ratio of paired archive and live daily maxima.

    ``pairs``: group, archive, live. Quantiles are exact; the group's quantile arrays come back in order.
    """
    def vector(column: str) -> DataFrame:
        q = exact_quantiles(pairs, by, column, levels)
        return q.groupBy(*by).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("p", "quantile"))), lambda s: s.quantile).alias(f"{column}_quantiles")
        )  # one entry per level

    p99 = exact_quantiles(pairs, by, "archive", [0.99]).select(*by, F.col("quantile").alias("_a99"))
    l99 = exact_quantiles(pairs, by, "live", [0.99]).select(*by, F.col("quantile").alias("_l99"))
    stats = pairs.groupBy(*by).agg(F.corr("archive", "live").alias("correlation"), F.count(F.lit(1)).alias("n"))
    out = stats.join(p99, by).join(l99, by).join(vector("archive"), by).join(vector("live"), by)
    ratio = F.col("_l99") / F.greatest(F.col("_a99"), F.lit(1e-6))
    return out.withColumn("p99_ratio", ratio).drop("_a99", "_l99")


def point_thresholds(hourly: DataFrame, windows: dict[str, int], rarity: dict[str, dict[str, float]], bias: DataFrame | None = None) -> DataFrame:
    """Each point's own rain at the fitted rarities: point_id, window_name, watch, critical.

    ``rarity``: level -> {window: probability}. A group is one point's record, so its size is the record's hours.
    ``bias``: window_name, archive_quantiles, live_quantiles, levels; maps amounts to live units.
    """
    keys = ["point_id", "year"]
    totals = hourly.select(*keys, *[running_total(h, keys).alias(w) for w, h in windows.items()])
    aggs = [F.percentile(w, F.lit(rarity[lv][w])).alias(f"{w}|{lv}") for w in windows for lv in ("watch", "critical")]
    wide = totals.groupBy("point_id").agg(*aggs)
    rows = F.explode(
        F.array(*[F.struct(F.lit(w).alias("window_name"), F.col(f"`{w}|watch`").alias("watch"), F.col(f"`{w}|critical`").alias("critical")) for w in windows])
    )
    out = wide.select("point_id", rows.alias("_r")).select("point_id", "_r.*")
    if bias is not None:
        joined = out.join(F.broadcast(bias), "window_name")  # one row per window
        maps = [F.col("archive_quantiles"), F.col("live_quantiles"), F.col("levels")]
        out = joined.select(
            "point_id", "window_name", *[F.round(to_live_units(F.col(lv), *maps), 1).alias(lv) for lv in ("watch", "critical")]
        )
    return out


def inverted_thresholds(points: DataFrame) -> DataFrame:
    """Rows that break watch < critical; must be empty before publishing."""
    return points.filter(~(F.col("watch") < F.col("critical")))


def publish_gate(new_scores: DataFrame, old_scores: DataFrame) -> bool:
    """True when the new rule's TSS beats the old one's. Both are one-row contingency tables."""
    return new_scores.first()["tss"] > old_scores.first()["tss"]


def stratified_sample(df: DataFrame, group: str, row_id: str, size: int, seed: int = 42) -> DataFrame:
    """One row per group and the rest at random, by hash order, until ``size`` rows."""
    drawn = df.withColumn("_draw", F.xxhash64(F.col(row_id), F.lit(seed)))
    firsts = drawn.groupBy(group).agg(F.min(F.struct("_draw", row_id)).alias("_f"))
    firsts = firsts.select(F.col(f"_f.{row_id}").alias(row_id), F.lit(1).alias("_first"))
    ordered = drawn.join(firsts, row_id, "left").orderBy(F.coalesce("_first", F.lit(0)).desc(), "_draw", row_id)
    return ordered.limit(size).drop("_draw", "_first")
