"""Mapping records of chains as GAF and PAF lines, and their way to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAB, STAR = "\t", "*"
#: Fixed columns of a chain: read, read_len, q_start, q_end, path, path_len, ref_start, ref_end, matches, mapq, score, anchors, rank, n_chains, standout, decision, chunks; walk (null: none).
REVERSE = "_reverse"


def text(c: str) -> Column:
    return F.col(c).cast("string")


def tag(name: str, kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}:{kind}:"), value.cast("string"))


def share(pattern: str, part: Column, whole: Column) -> Column:
    """Formatted part / whole; null, and so left out, where whole is 0."""
    return F.when(whole > 0, F.format_string(pattern, part / whole))


def clamped(rows: DataFrame) -> DataFrame:
    """Reference ends within the path."""
    return rows.withColumn("ref_start", F.greatest("ref_start", F.lit(0))).withColumn("ref_end", F.least("ref_end", "path_len"))


def stranded(rows: DataFrame) -> DataFrame:
    """strand, and path and reference ends on the forward strand of paths that are named as reversed."""
    back = F.col("path").endswith(REVERSE)
    rows = rows.select("*", F.when(back, "-").otherwise("+").alias("strand"), F.when(back, F.col("path_len") - F.col("ref_end")).otherwise(F.col("ref_start")).alias("a"),
                       F.when(back, F.col("path_len") - F.col("ref_start")).otherwise(F.col("ref_end")).alias("b"))
    return rows.withColumn("path", F.regexp_replace("path", f"{REVERSE}$", "")).withColumn("ref_start", F.col("a")).withColumn("ref_end", F.col("b")).drop("a", "b")


def chain_tags() -> list[Column]:
    q, r = F.col("q_end") - F.col("q_start"), F.col("ref_end") - F.col("ref_start")
    return [tag("cs", "i", F.floor("score")), tag("an", "i", F.col("anchors")), share("se:f:%.3f", F.col("score"), q), share("ad:f:%.4f", F.col("anchors").cast("double"), r)]


def decision_tags() -> list[Column]:
    return [F.format_string("ws:f:%.3f", F.col("standout")), tag("nc", "i", F.col("n_chains")), tag("df", "A", F.col("decision")), tag("ck", "i", F.col("chunks"))]


def gaf_lines(chains: DataFrame, secondary: int = 9) -> DataFrame:
    """read, rank, value: a line for each chain of mapped reads, up to `secondary` beside the first; one line for each unmapped read, with its best chain's query span if it has a chain (q_start not null)."""
    mapped = F.col("decision") != "U"
    rows = stranded(clamped(chains.where(mapped & (F.col("rank") <= secondary))))
    walk = F.coalesce("walk", "path")
    first = F.col("rank") == 0
    line = F.concat_ws(TAB, text("read"), text("read_len"), text("q_start"), text("q_end"), "strand", walk, text("path_len"), text("ref_start"), text("ref_end"), text("matches"),
                       (F.col("ref_end") - F.col("ref_start")).cast("string"), text("mapq"), F.when(F.col("walk").isNotNull(), tag("pn", "Z", F.col("path"))),
                       tag("tp", "A", F.when(first, "P").otherwise("S")), *chain_tags(), *(F.when(first, t) for t in decision_tags()))
    some = F.col("q_start").isNotNull()
    span = [F.when(some, text(c)).otherwise(STAR) for c in ("q_start", "q_end")]
    none = F.concat_ws(TAB, text("read"), text("read_len"), *span, *[F.lit(STAR)] * 5, F.lit("0"), F.lit("0"), F.coalesce(text("mapq"), F.lit("0")), F.lit("pn:Z:*"), F.lit("tp:A:U"),
                       *(F.when(some, t) for t in chain_tags()), *decision_tags())
    return rows.select("read", "rank", line.alias("value")).unionByName(chains.where(~mapped & (F.col("rank") == 0)).select("read", "rank", none.alias("value")))


def paf_lines(chains: DataFrame) -> DataFrame:
    """read, rank, value: the first chain of mapped reads on the forward strand with no target name, and unmapped reads."""
    mapped = F.col("decision") != "U"
    rows = clamped(chains.where(F.col("rank") == 0))
    line = F.concat_ws(TAB, text("read"), text("read_len"), text("q_start"), text("q_end"), F.lit("+"), F.lit(STAR), text("path_len"), text("ref_start"), text("ref_end"), text("matches"),
                       (F.col("ref_end") - F.col("ref_start")).cast("string"), text("mapq"), *chain_tags(), *decision_tags())
    none = F.concat_ws(TAB, text("read"), text("read_len"), *[F.lit(STAR)] * 7, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("tp:A:U"), *decision_tags())
    return rows.select("read", "rank", F.when(mapped, line).otherwise(none).alias("value"))


def lines_for(path: str):
    """By the file's name: PAF for .paf, GAF for all else."""
    return paf_lines if path.lower().endswith(".paf") else gaf_lines


def best_first(chains: DataFrame) -> DataFrame:
    """chains with rank and n_chains of each read."""
    own = Window.partitionBy("read")
    return chains.withColumn("rank", (F.row_number().over(own.orderBy(F.desc("score"), "path", "q_start", "ref_start")) - 1).cast("long")).withColumn("n_chains", F.count(F.lit(1)).over(own))
