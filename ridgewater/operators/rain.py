"""Hourly rain series to trailing totals, forecast windows and daily predictors.

All windows run within one point (and year); a partition holds at most the hours of a year, whatever
share of the raw readings the point has, because readings are summed to hours first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Window lengths in hours.
FLOOD_WINDOWS = {"1h": 1, "3h": 3, "24h": 24}
SLIDE_WINDOWS = {"24h": 24, "72h": 72, "168h": 168}
READING_WINDOWS = {"1h": 1, "3h": 3, "24h": 24, "antecedent_48h": 48, "72h": 72, "168h": 168}
FORECAST_HOURS = 6


def densify(observed: DataFrame) -> DataFrame:
    """Every hour between the first and last reading for every point; absent hours are null.

    A reading fills the hours up to the next one of its point, so only readings are shuffled, by point, and what
    follows by point is not shuffled again. Readings off the hours counted from the first are left out.
    """
    rest = [c for c in observed.columns if c not in ("point_id", "ts")]
    span = F.broadcast(observed.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi")))  # one row
    starts = observed.select("point_id").distinct().join(span, F.lit(True)).filter("_lo IS NOT NULL").select(
        "point_id", F.col("_lo").alias("ts"), "_hi", F.lit(0).alias("_real")
    )
    whole = (F.unix_micros("ts") - F.unix_micros("_lo")) % F.lit(3_600_000_000) == 0
    real = observed.join(span, F.lit(True)).filter(whole & F.col("point_id").isNotNull()).drop("_lo").withColumn("_real", F.lit(1))
    hour = F.expr("interval 1 hour")
    by_time = Window.partitionBy("point_id").orderBy("ts", "_real")
    rows = starts.unionByName(real, allowMissingColumns=True).withColumn(
        "_next", F.coalesce(F.lead("ts").over(by_time), F.col("_hi") + hour)
    )
    hours = F.when(F.col("_next") > F.col("ts"), F.sequence("ts", F.col("_next") - hour, hour)).when(F.col("_real") == 1, F.array("ts"))
    filled = rows.select("point_id", "_real", *rest, F.posexplode(hours).alias("_at", "ts"))
    own = (F.col("_at") == 0) & (F.col("_real") == 1)
    return filled.select("point_id", "ts", *[F.when(own, F.col(c)).alias(c) for c in rest])


def read_point_years(records: DataFrame) -> DataFrame:
    """Point-year records (array of hourly mm) of complete district-years, one row per hour.

    A district-year is complete when it has as many points as the district's fullest year.
    """
    counts = records.groupBy("district", "year").agg(F.count(F.lit(1)).alias("_points"))
    full = Window.partitionBy("district")
    complete = counts.withColumn("_full", F.max("_points").over(full)).filter("_points = _full")
    return (
        records.join(complete.select("district", "year"), ["district", "year"], "left_semi")
        .select("district", "lat", "lon", "year", "start", F.posexplode("precipitation_mm").alias("_h", "mm"))
        .select(
            "district",
            F.format_string("%.5f,%.5f", "lat", "lon").alias("point_id"),
            "lat",
            "lon",
            "year",
            (F.to_timestamp("start") + F.make_interval(hours=F.col("_h"))).alias("ts"),
            F.when(~F.isnan("mm"), F.col("mm")).alias("mm"),
        )
    )


def _frame(hours: int, keys: list[str], end: int = 0):
    return Window.partitionBy(*keys).orderBy("ts").rowsBetween(end - hours + 1, end)


def running_total(hours: int, keys: list[str]) -> Column:
    """Partial at the start of the series; missing hours count as 0."""
    return F.sum(F.coalesce(F.col("mm"), F.lit(0.0))).over(_frame(hours, keys))


def full_total(hours: int, keys: list[str], decimals: int = 2) -> Column:
    """Null unless the whole window is in the series; missing hours count as 0."""
    frame = _frame(hours, keys)
    return F.when(
        F.count(F.lit(1)).over(frame) == hours,
        F.round(F.sum(F.coalesce(F.col("mm"), F.lit(0.0))).over(frame), decimals),
    )


def present_total(hours: int, keys: list[str], decimals: int = 2) -> Column:
    """Partial allowed; missing hours are skipped; null when none is present."""
    return F.round(F.sum("mm").over(_frame(hours, keys)), decimals)


def antecedent_to_now(keys: list[str], decimals: int = 2) -> Column:
    """Rain of the 48 hours ending now."""
    return full_total(48, keys, decimals)


def antecedent_before_day(keys: list[str], decimals: int = 2) -> Column:
    """Rain of the 48 hours before the last 24; in the first day only the first hour is used."""
    by_time = Window.partitionBy(*keys).orderBy("ts")
    before = F.round(F.sum("mm").over(_frame(48, keys, end=-24)), decimals)
    first = F.round(F.first("mm").over(by_time.rowsBetween(Window.unboundedPreceding, 0)), decimals)
    return F.when(F.row_number().over(by_time) <= 24, first).otherwise(before)


def readings(hourly: DataFrame, keys: list[str], decimals: int = 2) -> DataFrame:
    """All trailing totals of a reading at every hour."""
    return hourly.select(
        *keys, "ts", "mm", *[full_total(h, keys, decimals).alias(w) for w, h in READING_WINDOWS.items()]
    )


def forecasts(hourly: DataFrame, keys: list[str], ahead: int = FORECAST_HOURS, decimals: int = 2) -> DataFrame:
    """Per hour an array of what each window will read 1..ahead hours later, as far as the series goes."""
    by_time = Window.partitionBy(*keys).orderBy("ts")
    totals = hourly.select(
        *keys, "ts", "mm", *[full_total(h, keys, decimals).alias(w) for w, h in FLOOD_WINDOWS.items()]
    )
    now = F.struct(*[F.col(w).alias(w) for w in FLOOD_WINDOWS])
    coming = F.array(*[F.lead(now, k).over(by_time) for k in range(1, ahead + 1)])
    return totals.withColumn("forecast", F.filter(coming, lambda x: x.isNotNull()))


def latest_at(hourly: DataFrame, keys: list[str], now: Column | str) -> DataFrame:
    """As-of: per key the row of the latest hour not after ``now``."""
    now = F.col(now) if isinstance(now, str) else now
    past = hourly.filter(F.col("ts") <= F.date_trunc("hour", now))
    cols = [c for c in hourly.columns if c not in keys]
    best = past.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("ts")).alias("_r"))
    return best.select(*keys, "_r.*")


def parse_payload(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Live feed text (one location object or a list of them) to one row per location and hour.

    Columns: every other column of ``raw``, location, current_time, ts, mm.
    """
    one = (
        "struct<latitude:double,longitude:double,current:struct<time:string,precipitation:double>,"
        "hourly:struct<time:array<string>,precipitation:array<double>>>"
    )
    rest = [c for c in raw.columns if c != column]
    text = F.trim(column)
    many = F.when(text.startswith("["), F.from_json(text, f"array<{one}>")).otherwise(F.array(F.from_json(text, one)))
    per_location = raw.select(*rest, F.posexplode(many).alias("location", "_p"))
    hours = F.arrays_zip(F.col("_p.hourly.time").alias("time"), F.col("_p.hourly.precipitation").alias("mm"))
    return per_location.select(
        *rest,
        "location",
        F.col("_p.latitude").alias("latitude"),
        F.col("_p.longitude").alias("longitude"),
        F.try_to_timestamp(F.substring("_p.current.time", 1, 16), F.lit("yyyy-MM-dd'T'HH:mm")).alias("current_time"),
        F.explode(hours).alias("_h"),
    ).select(
        *rest,
        "location",
        "latitude",
        "longitude",
        "current_time",
        F.try_to_timestamp("_h.time", F.lit("yyyy-MM-dd'T'HH:mm")).alias("ts"),
        F.col("_h.mm").alias("mm"),
    )


def _ending(hours: int, now: Column, ahead: int, decimals: int, first: Column, last: Column | None = None) -> Column:
    """Rain of the ``hours`` hours ending ``ahead`` hours after ``now``; null unless the series spans them."""
    end = now + F.expr(f"interval {ahead} hours")
    start = end - F.expr(f"interval {hours - 1} hours")
    total = F.coalesce(F.sum(F.when(F.col("ts").between(start, end), F.col("mm"))), F.lit(0.0))
    spans = F.min(first) <= F.min(start)
    if last is not None:
        spans = spans & (F.max(last) >= F.max(end))
    return F.when(spans, F.round(total, decimals))


def reading_at(observed: DataFrame, span: DataFrame, keys: list[str], decimals: int = 2) -> DataFrame:
    """Reading of every series at one moment in a single aggregation, with no window and no hourly spine.

    ``observed`` may lack hours (they count as 0). ``span``: one row, first and now.
    """
    timed = observed.join(F.broadcast(span), F.lit(True))  # one row
    totals = [_ending(h, F.col("now"), 0, decimals, F.col("first")).alias(w) for w, h in READING_WINDOWS.items()]
    return timed.groupBy(*keys).agg(*totals)


def readings_now(parsed: DataFrame, keys: list[str], decimals: int = 2, ahead: int = FORECAST_HOURS) -> DataFrame:
    """Reading with its forecast at the current hour of each location of a parsed payload.

    The current hour is the latest slot not after the payload's clock, or the last slot without a clock.
    """
    hour = F.date_trunc("hour", "current_time")
    slots = parsed.groupBy(*keys).agg(
        F.max(F.when(hour.isNull() | (F.col("ts") <= hour), F.col("ts"))).alias("now"),
        F.min("ts").alias("first"), F.max("ts").alias("last"),
    )
    timed = parsed.join(slots, keys)
    now, first, last = F.col("now"), F.col("first"), F.col("last")
    totals = [_ending(h, now, 0, decimals, first).alias(w) for w, h in READING_WINDOWS.items()]
    steps = [
        F.when(
            F.max(last) >= F.max(now + F.expr(f"interval {k} hours")),
            F.struct(*[_ending(h, now, k, decimals, first).alias(w) for w, h in FLOOD_WINDOWS.items()]),
        )
        for k in range(1, ahead + 1)
    ]
    found = timed.groupBy(*keys).agg(F.min(now).alias("ts"), *totals, F.array(*steps).alias("forecast"))
    return found.withColumn("forecast", F.filter("forecast", lambda x: x.isNotNull()))


def plausible(mm: Column, limit: float = 3000.0) -> Column:
    return mm.isNotNull() & ~F.isnan(mm) & mm.between(0.0, limit)


def daily_maxima(hourly: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """Largest running total of each whole day."""
    per_hour = hourly.select(*keys, "ts", running_total(hours, keys).alias("_t"))
    return (
        per_hour.groupBy(*keys, F.to_date("ts").alias("day"))
        .agg(F.max("_t").alias("peak_mm"), F.count(F.lit(1)).alias("_n"))
        .filter("_n = 24")
        .drop("_n")
    )


def _two_days(ts: Column) -> Column:
    """The days whose day-before-to-day span an hour belongs to."""
    return F.array(F.to_date(ts), F.date_add(F.to_date(ts), 1))


def day_peaks(hourly: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Per point, day and window the largest running total over that day and the day before.

    ``hourly``: district, point_id, year, ts, mm. Only days with all 48 hours in the series are kept.
    """
    keys = ["district", "point_id", "year"]
    totals = hourly.select(*keys, "ts", *[running_total(h, keys).alias(w) for w, h in windows.items()])
    spans = totals.withColumn("day", F.explode(_two_days(F.col("ts"))))
    return (
        spans.groupBy(*keys, "day")
        .agg(*[F.max(w).alias(w) for w in windows], F.count(F.lit(1)).alias("_n"))
        .filter("_n = 48")
        .drop("_n")
    )


def antecedent_days(hourly: DataFrame, days: int = 5) -> DataFrame:
    """Per point and day, rain of the ``days`` days before the day-before-to-day span."""
    keys = ["district", "point_id", "year"]
    daily = hourly.groupBy(*keys, F.to_date("ts").alias("_d")).agg(F.sum("mm").alias("_mm"))
    later = F.explode(F.sequence(F.date_add("_d", 2), F.date_add("_d", days + 1)))
    return (
        daily.withColumn("day", later)
        .groupBy(*keys, "day")
        .agg(F.coalesce(F.sum("_mm"), F.lit(0.0)).alias("antecedent"))
    )


def district_days(hourly: DataFrame, windows: dict[str, int] = FLOOD_WINDOWS) -> DataFrame:
    """District-day predictors: wettest point's peak per window, and mean antecedent 5-day rain."""
    peaks = day_peaks(hourly, windows)
    earlier = antecedent_days(hourly)
    both = peaks.join(earlier, ["district", "point_id", "year", "day"], "left")
    return both.groupBy("district", "year", "day").agg(
        *[F.max(w).alias(w) for w in windows],
        F.avg(F.coalesce("antecedent", F.lit(0.0))).alias("antecedent_5d"),
    )


def in_season(day: Column, first: int = 601, last: int = 930) -> Column:
    """Month-day compare; the default season is 1 June to 30 September."""
    return (F.month(day) * 100 + F.dayofmonth(day)).between(first, last)


def has_full_history(day: Column) -> Column:
    """Days of the season with seven full days of record before them: 4 June to 30 September."""
    return F.date_format(day, "MM-dd").between("06-04", "09-30")
