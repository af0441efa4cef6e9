"""Weekly counts, trend and spike alerts.

All statistics come from sums of integers over the weekly counts, so one partial aggregation
per step is enough and no result depends on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorale import rules
from chorale.functions.values import fixed, week_key
from chorale.operators.attach import attach


def weekly_counts(df: DataFrame, keys: list[str], moment: str) -> DataFrame:
    """Rows per key and week. Weeks without rows are absent."""
    return df.groupBy(*keys, week_key(F.col(moment)).alias("week_key")).agg(F.count("*").alias("n"))


def zero_filled(weekly: DataFrame, keys: list[str]) -> DataFrame:
    """Add the weeks that other keys have and this key lacks, between its first and last one."""
    bounds = weekly.groupBy(*keys).agg(F.min("week_key").alias("_lo"), F.max("week_key").alias("_hi"))
    weeks = weekly.agg(F.array_sort(F.collect_set("week_key")).alias("_weeks"))
    filled = attach(bounds, weeks, []).select(*keys, "_lo", "_hi", F.explode("_weeks").alias("week_key")).where(
        F.col("week_key").between(F.col("_lo"), F.col("_hi"))
    )
    return filled.drop("_lo", "_hi").join(weekly, [*keys, "week_key"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def _exact(name: str) -> Column:
    """A count as DECIMAL: squares of large counts pass BIGINT, and differences of them pass DOUBLE."""
    return F.col(name).cast("decimal(19,0)")


def _deviation(count: Column, total: Column, squares: Column) -> Column:
    whole = "decimal(38,0)"
    spread = count.cast("decimal(10,0)") * squares.cast("decimal(28,0)") - total.cast("decimal(19,0)") * total.cast("decimal(19,0)")
    return F.sqrt(F.greatest(spread.cast(whole).cast("double"), F.lit(0.0))) / count.cast("double")


def history(weekly: DataFrame, keys: list[str], order: str = "week_key") -> DataFrame:
    """Per key: weeks, latest count, and mean and deviation of all earlier weeks."""
    sums = weekly.groupBy(*keys).agg(
        F.count("*").alias("weeks"),
        F.max_by("n", order).alias("latest"),
        F.sum(_exact("n")).alias("_sum"),
        F.sum(_exact("n") * _exact("n")).alias("_squares"),
    )
    before = F.col("weeks") - 1
    earlier = before.cast("double")
    rest = F.col("_sum") - _exact("latest")
    squares = F.col("_squares") - _exact("latest") * _exact("latest")
    total, spread = rest.cast("double"), _deviation(before, rest, squares)
    return sums.select(
        *keys, "weeks", "latest",
        F.when(F.col("weeks") > 1, total / earlier).alias("baseline_mean"),
        F.when(F.col("weeks") > 1, spread).alias("baseline_std"),
    )


def trend_delta(latest: Column, mean: Column) -> Column:
    delta = (latest - mean) / F.greatest(F.lit(1.0), mean)
    return F.coalesce(F.round(delta, 4), F.lit(0.0))


def trends(weekly: DataFrame, keys: list[str]) -> DataFrame:
    return history(weekly, keys).select(
        *keys, "weeks", "latest",
        trend_delta(F.col("latest"), F.col("baseline_mean")).alias("trend_delta"),
    )


def spike_alerts(
    past: DataFrame,
    min_weeks: int = rules.MIN_HISTORY_WEEKS,
    sigmas: float = rules.SPIKE_SIGMAS,
    name: str = "cluster_id",
) -> DataFrame:
    """Info rows for a short history, spike rows above mean + sigmas * deviation, else none."""
    mean, std, latest = F.col("baseline_mean"), F.col("baseline_std"), F.col("latest")
    threshold = mean + sigmas * std
    ratio = latest / F.greatest(F.lit(1.0), mean)
    short = F.col("weeks") < min_weeks
    spiking = ~short & (latest > threshold) & (latest > mean)
    reason = F.concat(
        F.lit("Latest week count "), latest.cast("string"),
        F.lit(" exceeded baseline threshold "), fixed(threshold), F.lit("."),
    )
    return past.where(short | spiking).select(
        *[c for c in past.columns if c not in ("latest", "baseline_mean", "baseline_std")],
        F.concat(F.lit("alert_"), F.col(name), F.when(short, "_history").otherwise("_spike")).alias("alert_id"),
        F.when(short, "ANOMALY_CHECK").otherwise("ANOMALY_SPIKE").alias("type"),
        F.when(short, "info").when(ratio >= rules.HIGH_SPIKE_RATIO, "high").otherwise("medium").alias("severity"),
        F.when(short, "insufficient_history").otherwise(reason).alias("reason"),
        F.when(~short, F.round(ratio, 3)).alias("spike_ratio"),
        short.alias("insufficient_history"),
    )


def prior_week_stats(weekly: DataFrame, keys: list[str]) -> DataFrame:
    """For each week the mean and deviation of all weeks before it (weeks per key are few)."""
    before = Window.partitionBy(*keys).orderBy("week_key").rowsBetween(Window.unboundedPreceding, -1)
    count = F.count("n").over(before)
    total = F.sum(_exact("n")).over(before)
    squares = F.sum(_exact("n") * _exact("n")).over(before)
    return weekly.select(
        *keys, "week_key", "n",
        F.when(count > 0, total.cast("double") / count).alias("prior_mean"),
        F.when(count > 0, _deviation(count, total, squares)).alias("prior_std"),
    )
