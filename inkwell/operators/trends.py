"""Reports by period: counts and sums of events in windows of time, without gaps.

Periods are aligned to the epoch. Each group has a row for every period from the first to the
last of all groups, zero where nothing happened, and its change to the period before.

Cases: events without a time are not counted; null groups are one; null values add nothing to a
sum; no events give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.operators.dedup import written


def by_period(events: DataFrame, group: str, at: str, value: str, days: int = 7) -> DataFrame:
    """(group, period, n, total, change): ``period`` is the first day of each, ``change`` that of n."""
    period = F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(F.unix_date(F.to_date(at)) / days) * days).cast("int"))
    counts = events.filter(F.col(at).isNotNull()).groupBy(F.col(group).alias("_group"), period.alias("_period")).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    counts = written(counts, "counts")  # a row a group and period
    first, last = counts.agg(F.min("_period"), F.max("_period")).first()
    periods = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr(f"interval {days} days")))
    every = counts.select("_group").distinct().select(F.col("_group").alias(group), periods.alias("period"))
    out = every.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("period") == F.col("_period")), "left")
    out = out.select(group, "period", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))
    before = F.lag("n").over(Window.partitionBy(group).orderBy("period"))  # a row a period, not an event
    return out.withColumn("change", F.col("n") - before)
