"""The engine's functions under SQL names: temporary functions made of built-in ones, and two table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


def mix_sql(x: str) -> str:
    """The integer mixer under a mask of at most 62 bits, as one expression of lets: every sum is masked pairwise, so nothing overflows."""
    up = lambda v, n: f"shiftleft({v} & shiftrightunsigned(m, {n}), {n})"
    steps = ["((~x & m) + {u21} & m)", "(x ^ shiftrightunsigned(x, 24))", "((x + {u3} & m) + {u8} & m)", "(x ^ shiftrightunsigned(x, 14))", "((x + {u2} & m) + {u4} & m)",
             "(x ^ shiftrightunsigned(x, 28))", "(x + {u31} & m)"]
    out = f"({x} & m)"
    for s in steps:
        out = f"transform({out if out.startswith('transform') else f'array({out})'}, x -> {s.format(**{f'u{n}': up('x', n) for n in (2, 3, 4, 8, 21, 31)})})"
    return f"{out}[0]"


@udtf(returnType="pos long, kmer string")
class Kmers:
    """Each k-mer of a sequence with its place."""

    def eval(self, seq: str, k: int):
        for i in range(len(seq or "") - k + 1):
            yield i, seq[i : i + k]


@udtf(returnType="segment string, rev boolean")
class GfaSteps:
    """The steps of a P line."""

    def eval(self, line: str):
        fields = (line or "").split("\t")
        if fields[0] == "P" and len(fields) >= 3:
            for s in fields[2].split(","):
                if s[-1:] in ("+", "-") and len(s) > 1:
                    yield s[:-1], s[-1] == "-"


def register(spark: SparkSession) -> None:
    """hash64(x, mask), revcomp(s), mapq(score, second, anchors), rh2_token(x), kmers(seq, k), gfa_steps(line)."""
    make = lambda head, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    make("hash64(v BIGINT, m BIGINT) RETURNS BIGINT", mix_sql("v"))
    make("revcomp(s STRING) RETURNS STRING", "reverse(regexp_replace(translate(upper(s), 'ACGT', 'TGCA'), '[^ACGT]', 'N'))")
    raw = "least(if(anchors > 10, 1D, 0.1D * anchors), if(score > 100, 1D, 0.01D * score)) * 40D * (1D - greatest(second, 15D) / score) * ln(score)"
    make("mapq(score DOUBLE, second DOUBLE, anchors BIGINT) RETURNS BIGINT", f"if(score <= 0, 0L, least(60L, greatest(0L, cast({raw} as bigint))))")
    make("rh2_token(x DOUBLE) RETURNS BIGINT", "floor(15 * case when least(3D, greatest(-3D, x)) between -2 and 2 then 0.4D * (least(3D, greatest(-3D, x)) + 2D) / 4D "
         "when x < 0 then 0.4D + 0.3D * (greatest(-3D, x) + 3D) / 6D else 0.7D + 0.3D * (least(3D, x) + 3D) / 6D end)")
    spark.udtf.register("kmers", Kmers)
    spark.udtf.register("gfa_steps", GfaSteps)
