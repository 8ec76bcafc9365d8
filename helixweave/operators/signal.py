"""Normalisation, t-statistics, events and landmarks of sampled signals. Samples are rows (read, idx, pa)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixweave.functions.signal import in_pa_range


def filtered(samples: DataFrame, low: float = 30.0, high: float = 200.0) -> DataFrame:
    """Samples in range, numbered anew (idx)."""
    kept = samples.where(in_pa_range(F.col("pa"), low, high))
    return kept.withColumn("idx", (F.row_number().over(Window.partitionBy("read").orderBy("idx")) - 1).cast("long"))


def zscored(samples: DataFrame, most: float = 3.0) -> DataFrame:
    """Whole-read z-scores strictly within most."""
    w = Window.partitionBy("read")
    z = (F.col("pa") - F.avg("pa").over(w)) / F.stddev_pop("pa").over(w)
    return samples.where("pa is not null").withColumn("sd", F.stddev_pop("pa").over(w)).withColumn("z", F.when(F.col("sd") > 0, z)).where(F.abs("z") < most).drop("sd")


def zscored_by_chunk(samples: DataFrame, chunk: int, most: float = 3.0) -> DataFrame:
    """Each chunk of samples by the statistics of all samples so far, its own included."""
    cut = samples.withColumn("chunk", F.floor(F.col("idx") / chunk).cast("long"))
    sums = cut.groupBy("read", "chunk").agg(F.count("*").alias("n"), F.sum("pa").alias("s"), F.sum(F.col("pa") * F.col("pa")).alias("ss"))
    w = Window.partitionBy("read").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select("read", "chunk", *(F.sum(c).over(w).alias(c) for c in ("n", "s", "ss")))
    mean = run.select("read", "chunk", (F.col("s") / F.col("n")).alias("mu"), (F.col("ss") / F.col("n")).alias("m2"))
    stat = mean.select("read", "chunk", "mu", F.sqrt(F.greatest(F.col("m2") - F.col("mu") * F.col("mu"), F.lit(0.0))).alias("sd")).where("sd > 1e-6")
    return cut.join(stat, ["read", "chunk"]).withColumn("z", (F.col("pa") - F.col("mu")) / F.col("sd")).where(F.abs("z") < most).select("read", "chunk", "idx", "z")


def t_statistic(samples: DataFrame, w: int) -> DataFrame:
    """read, idx, t: how far the means of the w samples before idx and the w from idx on differ; 0 near the ends."""
    by = Window.partitionBy("read").orderBy("idx")
    left, right = by.rowsBetween(-w, -1), by.rowsBetween(0, w - 1)
    x, xx = F.col("pa"), F.col("pa") * F.col("pa")
    m1, m2 = F.avg(x).over(left), F.avg(x).over(right)
    var = F.greatest((F.avg(xx).over(left) - m1 * m1 + F.avg(xx).over(right) - m2 * m2) / w, F.lit(1.17549435e-38))
    full = (F.count(x).over(left) == w) & (F.count(x).over(right) == w)
    return samples.select("read", "idx", F.when(full, F.abs(m2 - m1) / F.sqrt(var)).otherwise(0.0).alias("t"))


def trimmed_means(segments: DataFrame) -> DataFrame:
    """read, seg, mean: of each segment's samples within one quartile range of its quartiles (by rank n/4 and 3n/4)."""
    s = segments.groupBy("read", "seg").agg(F.sort_array(F.collect_list("pa")).alias("x")).withColumn("n", F.size("x"))
    q = s.withColumn("q1", F.get("x", F.floor(F.col("n") / 4).cast("int"))).withColumn("q3", F.get("x", F.floor(F.col("n") * 3 / 4).cast("int")))
    band = q.withColumn("y", F.filter("x", lambda v: (v >= 2 * F.col("q1") - F.col("q3")) & (v <= 2 * F.col("q3") - F.col("q1"))))
    return band.select("read", "seg", F.col("n").cast("long").alias("n"), (F.aggregate("y", F.lit(0.0), lambda a, v: a + v) / F.size("y")).alias("mean"))


def valleys(signals: DataFrame) -> DataFrame:
    """read, pos, v of local minima (ends included) in arrays of 3 values or more."""
    at = signals.where(F.size("values") >= 3).select("read", F.size("values").alias("n"), F.posexplode("values").alias("pos", "v"))
    w = Window.partitionBy("read").orderBy("pos")
    left, right = F.lag("v").over(w), F.lead("v").over(w)
    low = (left.isNull() | (F.col("v") <= left)) & (right.isNull() | (F.col("v") <= right))
    return at.withColumn("low", low).where("low").select("read", F.col("pos").cast("long").alias("pos"), "v")
