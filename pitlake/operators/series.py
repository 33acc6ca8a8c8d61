"""Trailing features of dated series.

Input is long: one row per (series, date). A trailing feature needs only the last rows of each series, and
``row_number() <= k`` lets Spark keep at most k rows per series in every map task before the shuffle, so a
series holding a third of all rows never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitlake.operators.asof import as_of_join
from pitlake.tables import columns

# Windows are counted in observations, never calendar days.
RETURN_WINDOWS = {"return_20d": 20, "return_60d": 60, "return_120d": 120}
VOLATILITY_WINDOWS = {"volatility_20d": 20}
DRAWDOWN_WINDOWS = {"max_drawdown_60d": 60}
LOOKBACK_DAYS = {"daily": 260, "monthly": 400}


def last_rows(points: DataFrame, by: Sequence[str], date: str, count: int) -> DataFrame:
    """The last ``count`` rows per series, numbered from the end in ``from_end``."""
    recent = Window.partitionBy(*by).orderBy(F.col(date).desc())
    return points.withColumn("from_end", F.row_number().over(recent)).where(F.col("from_end") <= count)


def trailing_return(points: DataFrame, n: int, by: Sequence[str], date: str = "obs_date", value: str = "value") -> DataFrame:
    """Percent change over n observations; needs n + 1 points and a nonzero start."""
    ends = last_rows(points, by, date, n + 1).groupBy(*by).agg(
        F.max(F.when(F.col("from_end") == 1, F.col(value))).alias("_end"),
        F.max(F.when(F.col("from_end") == n + 1, F.col(value))).alias("_start"),
        F.max(date).alias("as_of_date"),
    )
    return ends.select(*by, "as_of_date", ((F.try_divide(F.col("_end"), F.col("_start")) - 1) * 100).alias("value"))


def trailing_volatility(points: DataFrame, n: int, by: Sequence[str], date: str = "obs_date", value: str = "value") -> DataFrame:
    """Sample standard deviation of n simple returns in percent; a zero previous value voids it."""
    ordered = Window.partitionBy(*by).orderBy(date)
    steps = last_rows(points, by, date, n + 1).withColumn("_prev", F.lag(value).over(ordered))
    folded = steps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.bool_or(F.col("_prev") == 0).alias("_void"),
        F.stddev_samp(F.try_divide(F.col(value), F.col("_prev")) - 1).alias("_sd"),
        F.max(date).alias("as_of_date"),
    )
    usable = (F.col("_rows") == n + 1) & ~F.coalesce(F.col("_void"), F.lit(False))
    return folded.select(*by, "as_of_date", F.when(usable, F.col("_sd") * 100).alias("value"))


def trailing_max_drawdown(points: DataFrame, n: int, by: Sequence[str], date: str = "obs_date", value: str = "value") -> DataFrame:
    """Worst fall from the running peak of the last n observations, in percent and never above 0."""
    upto = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    peaks = last_rows(points, by, date, n).withColumn("_peak", F.max(value).over(upto))
    fall = F.when(F.col("_peak") > 0, (F.col(value) / F.col("_peak") - 1) * 100)
    folded = peaks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"), F.least(F.lit(0.0), F.min(fall)).alias("_worst"), F.max(date).alias("as_of_date")
    )
    return folded.select(*by, "as_of_date", F.when(F.col("_rows") == n, F.col("_worst")).alias("value"))


def latest_value(points: DataFrame, by: Sequence[str], date: str = "obs_date", value: str = "value") -> DataFrame:
    return points.groupBy(*by).agg(F.max(date).alias("as_of_date"), F.max_by(value, date).alias("value"))


def yoy_by_month(points: DataFrame, by: Sequence[str], date: str = "obs_date", value: str = "value") -> DataFrame:
    """Latest value against the same calendar month one year before; a missing or zero base gives NULL."""
    months = points.groupBy(*by, F.trunc(date, "MM").alias("_month")).agg(
        F.max(F.struct(date, value)).alias("_late"), F.min(F.struct(date, value)).alias("_early")
    )
    latest = months.groupBy(*by).agg(F.max("_late").alias("_late"))
    latest = latest.withColumn("_base_month", F.add_months(F.trunc(F.col("_late")[date], "MM"), -12))
    base = months.select(*by, F.col("_month").alias("_base_month"), F.col("_early")[value].alias("_base"))
    change = (F.try_divide(F.col("_late")[value], F.col("_base")) - 1) * 100
    return latest.join(base, [*by, "_base_month"], "left").select(*by, F.col("_late")[date].alias("as_of_date"), change.alias("value"))


def single_row(df: DataFrame, name: str) -> DataFrame:
    """The only row of ``df`` with a constant key; more than one row stops the job, none gives none."""
    n = F.count(F.lit(1))
    only = F.when(n <= 1, F.min(name)).otherwise(F.raise_error(F.lit("spread without keys takes one row a side")).cast(df.schema[name].dataType))
    return df.groupBy(F.lit(1).alias("_one")).agg(only.alias(name))


def spread(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """left - right; dated by the later side; source codes are the sorted union. Columns: as_of_date, value, source_codes.

    Without ``by`` each side is one value; a side with more rows stops the job instead of pairing every row with every other.
    """
    a = left.select(*columns(by), F.struct("as_of_date", "value", "source_codes").alias("_a"))
    b = right.select(*columns(by), F.struct("as_of_date", "value", "source_codes").alias("_b"))
    both = a.join(b, list(by)) if by else single_row(a, "_a").join(single_row(b, "_b"), "_one").drop("_one")
    return both.select(
        *columns(by),
        F.greatest("_a.as_of_date", "_b.as_of_date").alias("as_of_date"),
        (F.col("_a.value") - F.col("_b.value")).alias("value"),
        F.array_sort(F.array_union("_a.source_codes", "_b.source_codes")).alias("source_codes"),
    )


def rolling_features(points: DataFrame, by: Sequence[str], date: str = "obs_date", value: str = "value") -> DataFrame:
    """Every trailing feature at every date, so any number of as-of dates is one lookup each.

    Work is linear in the points: fixed row frames, and a slice of at most 60 values for the drawdown.
    """
    line = Window.partitionBy(*by).orderBy(date)
    out = points.withColumn("_prev", F.lag(value).over(line)).withColumn("_seen", F.row_number().over(line))
    out = out.withColumn("_step", F.try_divide(F.col(value), F.col("_prev")) - 1)
    for name, n in RETURN_WINDOWS.items():
        out = out.withColumn(name, (F.try_divide(F.col(value), F.lag(value, n).over(line)) - 1) * 100)
    for name, n in VOLATILITY_WINDOWS.items():
        frame = line.rowsBetween(-(n - 1), 0)
        void = F.coalesce(F.bool_or(F.col("_prev") == 0).over(frame), F.lit(False))
        out = out.withColumn(name, F.when((F.col("_seen") > n) & ~void, F.stddev_samp("_step").over(frame) * 100))
    for name, n in DRAWDOWN_WINDOWS.items():
        slice_ = F.collect_list(value).over(line.rowsBetween(-(n - 1), 0))
        worst = F.aggregate(
            slice_,
            F.struct(F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("worst")),
            lambda acc, x: F.struct(
                F.greatest(acc["peak"], x).alias("peak"),
                F.when(
                    F.greatest(acc["peak"], x) > 0, F.least(acc["worst"], (x / F.greatest(acc["peak"], x) - 1) * 100)
                ).otherwise(acc["worst"]).alias("worst"),
            ),
            lambda acc: acc["worst"],
        )
        out = out.withColumn(name, F.when(F.col("_seen") >= n, worst))
    names = [*RETURN_WINDOWS, *VOLATILITY_WINDOWS, *DRAWDOWN_WINDOWS]
    return out.select(*columns(by), date, F.col(value).alias("index_level"), *names)


def monthly_yoy(points: DataFrame, by: Sequence[str], date: str = "obs_date", value: str = "value") -> DataFrame:
    """Year-over-year change at every point, matched by calendar month."""
    base = points.groupBy(*by, F.add_months(F.trunc(date, "MM"), 12).alias("_month")).agg(F.min_by(value, date).alias("_base"))
    lined = points.withColumn("_month", F.trunc(date, "MM")).join(base, [*by, "_month"], "left")
    return lined.select(*columns(by), date, ((F.try_divide(F.col(value), F.col("_base")) - 1) * 100).alias("yoy"))


def market_context(index: DataFrame, rates: Mapping[str, DataFrame], monthly: DataFrame, as_of: DataFrame) -> DataFrame:
    """Context features for many as-of dates at once, long; what cannot be computed is an absent row.

    ``index`` and ``monthly`` are (obs_date, value); ``rates`` maps a feature name to such a series and its first
    entry is the one the yearly change is subtracted from. ``as_of`` has one distinct DATE column ``as_of``. The lookups are
    independent of each other and meet once per date, where ten features at most come together.
    """
    from_index = ["index_level", *RETURN_WINDOWS, *VOLATILITY_WINDOWS, *DRAWDOWN_WINDOWS]
    lookups = [(rolling_features(index, []), from_index), (monthly_yoy(monthly, []), ["yoy"])]
    lookups += [(points.withColumnRenamed("value", name), [name]) for name, points in rates.items()]
    lead, cells = next(iter(rates)), None
    for points, names in lookups:
        found = as_of_join(as_of, points, [], "as_of", "obs_date", names, matched_ts="as_of_date")
        listed = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value"), "as_of_date") for n in names])
        part = found.select("as_of", F.inline(listed)).where(F.col("value").isNotNull())
        cells = part if cells is None else cells.unionByName(part)

    def of(feature: str) -> Column:
        return F.max(F.when(F.col("feature") == feature, F.struct("value", "as_of_date")))

    dated = cells.groupBy("as_of").agg(F.collect_list(F.struct("feature", "value", "as_of_date")).alias("_all"), of(lead).alias("_rate"), of("yoy").alias("_yoy"))
    gap = F.struct(F.lit(f"{lead}_minus_yoy").alias("feature"), (F.col("_rate.value") - F.col("_yoy.value")).alias("value"),
                   F.greatest("_rate.as_of_date", "_yoy.as_of_date").alias("as_of_date"))
    return dated.select("as_of", F.inline(F.array_append("_all", gap))).where(F.col("value").isNotNull())


def fetch_watermarks(points: DataFrame, registry: DataFrame, reference_date, date: str = "obs_date") -> DataFrame:
    """Next needed date per registered series: last date + 1, else the reference date less the lookback.

    ``registry`` has (series, frequency); the batch start is the earliest need of its frequency.
    """
    last = points.groupBy("series").agg(F.max(date).alias("_last"))
    back = F.create_map(*[F.lit(x) for pair in LOOKBACK_DAYS.items() for x in pair])
    start = F.coalesce(F.date_add("_last", 1), F.date_sub(F.lit(reference_date).cast("date"), F.try_element_at(back, F.col("frequency"))))
    need = registry.join(last, "series", "left").select("series", "frequency", start.alias("next_date"))
    earliest = need.groupBy("frequency").agg(F.min("next_date").alias("batch_start"))
    return need.join(earliest, "frequency").select("series", "frequency", "next_date", "batch_start")


def calendar_gaps(points: DataFrame, keys: DataFrame, start, end, known_missing: DataFrame | None = None, date: str = "obs_date") -> DataFrame:
    """Weekdays in [start, end] without a point per key; weekends are skipped, known holidays left out."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    names = keys.columns
    wanted = keys.select(*names, days.alias("missing_date")).where(~F.dayofweek("missing_date").isin(1, 7))
    have = points.select(*names, F.col(date).alias("missing_date"))
    gaps = wanted.join(have, [*names, "missing_date"], "left_anti")
    if known_missing is not None:
        gaps = gaps.join(known_missing.select(F.col(date).alias("missing_date")), "missing_date", "left_anti")
    return gaps.select(*names, "missing_date")
