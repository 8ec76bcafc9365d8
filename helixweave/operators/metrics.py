"""Scores of predictions against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def binary(pairs: DataFrame) -> DataFrame:
    """pairs: truth, pred (boolean). One row: tp, fp, fn, tn, precision, recall, specificity, f1 (0 on zero denominators)."""
    count = lambda t, p: F.count_if((F.col("truth") == t) & (F.col("pred") == p))
    c = pairs.agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    c = c.withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp")))
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def by_class(pairs: DataFrame) -> DataFrame:
    """Per class: tp, fp, fn, precision, recall, f1; from one aggregation over both columns."""
    side = F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.lit(True).alias("is_truth")), F.struct(F.col("pred").alias("cls"), F.lit(False).alias("is_truth"))))
    hit = F.col("truth") == F.col("pred")
    s = pairs.select(hit.alias("hit"), side.alias("x")).groupBy(F.col("x.cls").alias("cls")).agg(
        F.count_if(F.col("hit") & F.col("x.is_truth")).alias("tp"), F.count_if(~F.col("hit") & ~F.col("x.is_truth")).alias("fp"), F.count_if(~F.col("hit") & F.col("x.is_truth")).alias("fn"))
    s = s.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
