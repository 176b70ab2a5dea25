"""Figures of any span of days from stored states that add up, without the records.

``daily`` makes one row for each day and group: how many records, how many
numbers among their values, sums and moments of value over days, and sketches
of the distinct members (HyperLogLog) and of the values (KLL).  States of parts
of a day, or of different days, merge by sums and unions, so a day that comes
late is one more row.  ``figures`` answers a span by its days' states.

Counts, averages and slopes are exact up to the rounding of sums; the distinct
count has a relative standard error of about 1.04 / 2 ** (LG / 2), and the
median's rank an error of about 1.3 %.  Null members and values are no members
and no numbers, NaN is no number; a span without values has no average, slope
and median, and a span of one day no slope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The logarithm of a HyperLogLog sketch's cells.
LG = 12
#: Fixed value: days are counted from here, so that moments stay small.
EPOCH = "2020-01-01"


def daily(records: DataFrame, time: str, by: list[str], member: str, value: str) -> DataFrame:
    """day, by, n, numbers, and the sums, moments and sketches of each day and group."""
    y = F.when(~F.isnan(value), F.col(value).cast("double"))
    x = F.when(y.isNotNull(), F.datediff(F.col(time).cast("date"), F.lit(EPOCH).cast("date")).cast("long"))
    rows = records.select(F.col(time).cast("date").alias("day"), *by, F.col(member).cast("string").alias("_m"), x.alias("_x"), y.alias("_y"))
    return rows.groupBy("day", *by).agg(
        F.count("*").alias("n"), F.count("_y").alias("numbers"), F.sum("_x").alias("x"), F.sum("_y").alias("y"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_x") * F.col("_y")).alias("xy"),
        F.hll_sketch_agg("_m", F.lit(LG)).alias("members"), F.kll_sketch_agg_double("_y").alias("values"),
    )


def merged(states: DataFrame, by: list[str | Column]) -> DataFrame:
    """The states of groups of states."""
    sums = [F.sum(c).alias(c) for c in ("n", "numbers", "x", "y", "xx", "xy")]
    return states.groupBy(*by).agg(*sums, F.hll_union_agg("members").alias("members"), F.kll_merge_agg_double("values").alias("values"))


def figures(states: DataFrame, by: list[str | Column]) -> DataFrame:
    """by, n, average, slope (of value a day), distinct (an estimate) and median (an estimate) of each group of states."""
    made = merged(states, by)
    keys = [c for c in made.columns if c not in ("n", "numbers", "x", "y", "xx", "xy", "members", "values")]
    spread = F.col("numbers") * F.col("xx") - F.col("x") * F.col("x")
    slope = F.when(spread > 0, (F.col("numbers") * F.col("xy") - F.col("x") * F.col("y")) / spread)
    some = F.col("numbers") > 0
    median = F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(0.5)))
    return made.select(*keys, "n", F.when(some, F.col("y") / F.col("numbers")).alias("average"), slope.alias("slope"), F.hll_sketch_estimate("members").alias("distinct"), median.alias("median"))
