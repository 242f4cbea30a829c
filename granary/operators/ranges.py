"""Running sums and order statistics over all rows, without a window over all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.staging import stage

#: Ranges at most: their bounds are part of the plan.
RANGES = 1000


def running(counts: DataFrame, *by: str) -> DataFrame:
    """counts: by, v, n, a row for each value v of a group. Adds below (the n of smaller values of the group) and total (all its n).

    Values are dealt to ranges whose bounds are read once, so the range of a value is fixed wherever it is computed. Each range is summed
    by itself and offset by those before it; there are as many offsets as ranges and groups. For few groups.
    """
    counts = stage(counts, "counts")
    parts = max(2, min(RANGES, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    size = F.col("v").cast("double")
    bounds = counts.agg(F.percentile_approx(size, [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or [0.0]
    dealt = counts.withColumn("part", F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b < size)))
    ahead = Window.partitionBy(*by, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    every = Window.partitionBy(*(by or [F.lit(1)]))
    sums = dealt.groupBy(*by, "part").agg(F.sum("n").alias("m"))
    sums = sums.select(*by, "part", F.coalesce(F.sum("m").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("m").over(every).alias("total"))
    return inside.join(sums, [*by, "part"]).select(*by, "v", "n", (F.col("inside") + F.col("offset")).alias("below"), "total")


def median_of_few(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, n, med: the exact median of few groups that may hold very many different values."""
    ranked = running(df.groupBy(*by, value.alias("v")).agg(F.count("*").alias("n")), *by)
    middle = (F.col("total") - 1) / 2
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("v")))
    return ranked.groupBy(*by).agg(F.max("total").alias("n"), ((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias("med"))


def quantiles_of_few(df: DataFrame, by: list[str], value: Column, shares: Sequence[float]) -> DataFrame:
    """by, n, and q<per mille> for each share: exact, interpolated quantiles of few groups that may hold very many different values."""
    ranked = running(df.groupBy(*by, value.alias("v")).agg(F.count("*").alias("n")), *by)
    at = lambda place: F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("v")))
    ends = []
    for q in shares:
        place = (F.col("total") - 1) * q
        ends += [at(F.floor(place)).alias(f"low_{q}"), at(F.ceil(place)).alias(f"high_{q}")]
    found = ranked.groupBy(*by).agg(F.max("total").alias("n"), *ends)
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    between = lambda q: F.col(f"`low_{q}`") + part(q) * (F.col(f"`high_{q}`") - F.col(f"`low_{q}`"))
    return found.select(*by, "n", *[between(q).alias(f"q{round(1000 * q)}") for q in shares])
