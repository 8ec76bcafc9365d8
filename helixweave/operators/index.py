"""The seed index: postings by hash, how often a hash occurs, and the caps taken from that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entries(seeds: DataFrame) -> DataFrame:
    """Distinct (hash, node, offset)."""
    return seeds.select("hash", "node", "offset").dropDuplicates()


def frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("hash").agg(F.count("*").alias("n"))


def histogram(freq: DataFrame) -> DataFrame:
    return freq.groupBy("n").agg(F.count("*").alias("hashes"))


def cap_at(freq: DataFrame, ordinal) -> DataFrame:
    """One row, cap: 1 more than the count at an ordinal (a function of the number of hashes) of the ascending counts.

    Read off the histogram (as many rows as there are distinct counts), so counts are never sorted one by one.
    """
    h = histogram(freq)
    up_to = F.sum("hashes").over(Window.orderBy("n"))  # rows: distinct counts, about the square root of the postings at most
    total = F.sum("hashes").over(Window.partitionBy())
    return h.select("n", up_to.alias("up_to"), total.alias("total")).where(F.col("up_to") > ordinal(F.col("total"))).agg((F.min("n") + 1).alias("cap"))


def percentile_cap(freq: DataFrame, p: float) -> DataFrame:
    return cap_at(freq, lambda n: F.least(F.floor(n * p), n - 1))


def top_fraction_cap(freq: DataFrame, fraction: float, low: int, high: int) -> DataFrame:
    raw = cap_at(freq, lambda n: F.least(F.floor(n * (1 - fraction)), n - 1))
    return raw.select(F.least(F.greatest("cap", F.lit(low)), F.lit(high)).cast("long").alias("cap"))


def lookup(seeds: DataFrame, index: DataFrame, cap: DataFrame) -> DataFrame:
    """Seeds joined with the index; seeds over the cap drop out before their postings are expanded."""
    allowed = frequencies(index).crossJoin(F.broadcast(cap)).where("n <= cap").select("hash", "n")  # cap is one row
    return seeds.join(allowed, "hash").join(index, "hash")
