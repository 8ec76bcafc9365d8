"""Integer and sequence functions as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(x: Column, bits: int) -> Column:
    return x.bitwiseAND((1 << bits) - 1)


def hash_steps(bits: int) -> list[Callable[[Column], Column]]:
    """The invertible integer mixer over bits (at most 62) bits, as steps to apply in turn: each names its argument
    two or three times, so they are applied as columns or lambdas of their own, never nested. Sums are masked
    pairwise, so nothing overflows."""

    def up(v: Column, n: int) -> Column:
        # what a shift would push past the mask is cut first
        return F.shiftleft(masked(v, max(0, bits - n)), n) if n < bits else F.lit(0).cast("long")

    def add(a: Column, b: Column) -> Column:
        return masked(a + b, bits)

    def down(n: int) -> Callable[[Column], Column]:
        return lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, n))

    return [
        lambda x: add(masked(F.bitwise_not(x), bits), up(x, 21)), down(24),
        lambda x: add(add(x, up(x, 3)), up(x, 8)), down(14),
        lambda x: add(add(x, up(x, 2)), up(x, 4)), down(28),
        lambda x: add(x, up(x, 31)),
    ]


def with_hash(df: DataFrame, code: str, bits: int, out: str = "hash") -> DataFrame:
    """df with the mixed code."""
    df = df.withColumn(out, masked(F.col(code).cast("long"), bits))
    for step in hash_steps(bits):
        df = df.withColumn(out, step(F.col(out)))
    return df


def hash_array(codes: Column, bits: int) -> Column:
    """Each value of an array mixed."""
    codes = F.transform(codes, lambda x: masked(x, bits))
    for step in hash_steps(bits):
        codes = F.transform(codes, step)
    return codes


def base_code(kmer: Column) -> Column:
    """2 bits for each of ACGT, first base highest; null where another letter is in it."""
    digits = F.translate(F.upper(kmer), "ACGT", "0123")
    return F.when(digits.rlike("^[0-3]+$"), F.conv(digits, 4, 10).cast("long"))


def revcomp(seq: Column) -> Column:
    """Reverse complement; letters other than ACGT become N."""
    return F.reverse(F.regexp_replace(F.translate(F.upper(seq), "ACGT", "TGCA"), "[^ACGT]", "N"))


def mapq(score: Column, second: Column, anchors: Column) -> Column:
    """Mapping quality 0 to 60 from a chain's score, the next chain's and the number of anchors."""
    penalty = F.least(F.when(anchors > 10, 1.0).otherwise(0.1 * anchors), F.when(score > 100, 1.0).otherwise(0.01 * score))
    raw = penalty * 40.0 * (1.0 - F.greatest(second, F.lit(15.0)) / score) * F.log(score)
    return F.when(score <= 0, 0).otherwise(F.least(F.lit(60), F.greatest(F.lit(0), F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw))))).cast("long")
