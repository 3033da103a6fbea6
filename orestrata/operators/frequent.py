"""The most frequent entries of a table of counts, as many as a bound allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def most_frequent(counts: DataFrame, n: Column, most: int) -> DataFrame:
    """At most ``most`` rows of ``counts``: all if they are so few, else those whose ``n`` reaches a power of two.

    The power is the least that keeps the bound; only how many rows there are of
    each power comes to the driver. Rows whose ``n`` isn't positive are left out.
    """
    power = F.floor(F.log2(n)).cast("int")
    positive = counts.where(n > 0)
    sizes = sorted(((r.p, r.c) for r in positive.groupBy(power.alias("p")).agg(F.count("*").alias("c")).collect()), reverse=True)
    held, least = 0, None
    for p, c in sizes:
        if held + c > most:
            return positive.where(power >= least) if least is not None else positive.where(F.lit(False))
        held, least = held + c, p
    return positive
