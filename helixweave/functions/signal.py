"""Sample functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_pa(raw: Column, offset: Column, range_: Column, digitisation: Column) -> Column:
    """ADC counts to pA; unit 1 where digitisation is 0."""
    return (raw + offset) * F.when(digitisation == 0, 1.0).otherwise(range_ / digitisation)


def in_pa_range(pa: Column, low: float = 30.0, high: float = 200.0) -> Column:
    return (pa > low) & (pa < high)


def adaptive_token(x: Column, fine_min: float = -2.0, fine_max: float = 2.0, fine_range: float = 0.4, bits: int = 4) -> Column:
    """Piecewise quantiser: the fine band takes fine_range of the levels, the tails share the rest."""
    unit = lambda v: (v + 3.0) / 6.0
    c = F.least(F.lit(3.0), F.greatest(F.lit(-3.0), x))
    u, a, b = unit(c), (fine_min + 3.0) / 6.0, (fine_max + 3.0) / 6.0
    side = (1.0 - fine_range) / 2.0
    q = F.when((c >= fine_min) & (c <= fine_max), fine_range * (u - a) / (b - a)).when(u < 0.5, fine_range + side * u).otherwise(fine_range + side + side * u)
    return F.when(x.isNotNull() & ~F.isnan(x), F.floor(q * ((1 << bits) - 1)).cast("long"))


def log_level(x: Column, most: float = 4.0, bits: int = 2) -> Column:
    """Logarithmic quantiser of a magnitude."""
    clipped = F.least(F.abs(x), F.lit(most))
    return F.least(F.floor(F.log1p(clipped) / F.log1p(F.lit(most)) * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")


def kept_by_difference(values: Column, least: float) -> Column:
    """Positions (from 0) of an array that differ from the last kept one by least or more; null values are kept and don't count as last."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<int>").alias("at"))
    pairs = F.transform(values, lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i")))

    def step(s: Column, x: Column) -> Column:
        keep = x["v"].isNull() | s["last"].isNull() | (F.abs(x["v"] - s["last"]) >= least)
        return F.when(keep, F.struct(F.coalesce(x["v"], s["last"]).alias("last"), F.array_append(s["at"], x["i"]).alias("at"))).otherwise(s)

    return F.aggregate(pairs, start, step, lambda s: s["at"]) if least > 0 else F.transform(pairs, lambda x: x["i"])
