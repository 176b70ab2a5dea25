"""Numeric helpers with the rounding and length rules of the data model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often it is used.

    Column expressions are substituted into one another; inside a lambda that
    would compute an array anew for each of its elements.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def round_half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves towards positive infinity; Spark's round goes away from zero."""
    k = float(10**places)
    return F.floor(x * k + 0.5).cast("double") / k


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def kl_term(p: Column, q: Column) -> Column:
    return F.when(p <= 0, 0.0).when(q <= 0, F.lit(float("inf"))).otherwise(p * F.log2(p / q))


def beta_posterior(successes: Column, failures: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """struct(alpha, beta, mean, variance) of a Beta prior after so many trials."""
    a = F.lit(alpha if alpha > 0 else 1.0) + F.greatest(F.coalesce(successes, F.lit(0)), F.lit(0))
    b = F.lit(beta if beta > 0 else 1.0) + F.greatest(F.coalesce(failures, F.lit(0)), F.lit(0))
    n = a + b
    return F.struct(a.cast("double").alias("alpha"), b.cast("double").alias("beta"), (a / n).alias("mean"), (a * b / (n * n * (n + 1))).alias("variance"))


def exploration_bonus(trials: Column, used: Column, weight: float = 1.0) -> Column:
    return F.lit(weight) * F.sqrt(F.log(trials + F.lit(2.718281828459045)) / (F.greatest(used, F.lit(0)) + 1))


def ewma(values: Column, alpha: float = 0.3) -> Column:
    """The last value of the moving average over an array, seeded by its first; 0 without numbers."""
    clean = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    last = F.aggregate(F.slice(clean, 2, F.greatest(F.size(clean), F.lit(1))), F.element_at(clean, 1), lambda a, v: F.lit(alpha) * v + F.lit(1 - alpha) * a)
    return F.when(F.size(clean) > 0, last).otherwise(F.lit(0.0))


def ewma_series(values: Column, alpha: float = 0.3) -> Column:
    """All values of the moving average, in order."""
    clean = F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))
    empty = F.array().cast("array<double>")
    grow = lambda a, v: F.concat(a, F.array(F.when(F.size(a) == 0, v).otherwise(F.lit(alpha) * v + F.lit(1 - alpha) * F.try_element_at(a, F.lit(-1)))))
    return F.aggregate(clean, empty, grow)


def code_unit_hash(text: Column) -> Column:
    """The 31-polynomial over UTF-16 code units in wrapped 32 bits, as an absolute value."""
    hexes = F.hex(F.encode(text, "UTF-16BE"))
    count = (F.length(hexes) / 4).cast("int")
    codes = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.conv(F.substring(hexes, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))
    signed = F.when(wrapped >= 2147483648, wrapped - 4294967296).otherwise(wrapped)
    return F.when(count > 0, F.abs(signed)).otherwise(F.lit(0).cast("long"))


def code_unit_seed(text: Column) -> Column:
    """Sum of the UTF-16 code units modulo 999, plus 1."""
    hexes = F.hex(F.encode(text, "UTF-16BE"))
    count = (F.length(hexes) / 4).cast("int")
    codes = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.conv(F.substring(hexes, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    total = F.when(count > 0, F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a + c)).otherwise(F.lit(0).cast("long"))
    return total % 999 + 1


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two item arrays after trimming and lower-casing; 0 where a side is empty."""
    x, y = normal_set(a), normal_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / F.size(F.array_union(x, y)))


def normal_set(items: Column) -> Column:
    low = F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.lower(F.trim(F.coalesce(s, F.lit("")))))
    return F.array_distinct(F.filter(low, lambda s: s != ""))
