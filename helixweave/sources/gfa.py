"""GFA text: segments, links, paths and walks as DataFrames.

Lines are numbered within their file by position in the scan (``monotonically_increasing_id``), which keeps their
order without bringing them to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixweave.store import row_numbers


def lines(spark: SparkSession, path: str) -> DataFrame:
    """at (ascending in file order), f (fields); blank lines and comments left out."""
    text = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return text.where((F.trim("value") != "") & ~F.col("value").startswith("#")).select("at", F.split("value", "\t").alias("f"))


def of_kind(rows: DataFrame, kind: str, fields: int) -> DataFrame:
    """Records of a kind; too few fields raise when the record is read."""
    least = F.when(F.size("f") >= fields, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"{kind} record with fewer than {fields} fields: "), F.array_join("f", " "))))
    return rows.where(F.get("f", F.lit(0)) == kind).withColumn("f", least)


def overlap(cigar: Column) -> Column:
    """Aligned bases of a CIGAR; null for * and empty."""
    counts = F.regexp_extract_all(cigar, F.lit("(\\d+)[M=X]"), 1)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.when((cigar != "*") & (cigar != ""), total)


def segments(rows: DataFrame) -> DataFrame:
    s = of_kind(rows, "S", 3)
    return row_numbers(s.select("at", F.col("f")[1].alias("id"), F.col("f")[2].alias("sequence")), [F.asc("at")], "ord").select("ord", "id", "sequence")


def links(rows: DataFrame) -> DataFrame:
    f = F.col("f")
    return of_kind(rows, "L", 6).select(f[1].alias("from"), (f[2] == "-").alias("from_rev"), f[3].alias("to"), (f[4] == "-").alias("to_rev"), overlap(f[5]).alias("overlap_bases"))


def path_steps(rows: DataFrame) -> DataFrame:
    """name, step_idx, segment_id, is_rev of P lines and of valid W lines (named sample#haplotype#sequence)."""
    f = F.col("f")
    p = of_kind(rows, "P", 3).select(f[1].alias("name"), F.posexplode(F.filter(F.split(f[2], ","), lambda x: x.rlike(".[+-]$"))).alias("step_idx", "s"))
    p = p.select("name", "step_idx", F.regexp_replace("s", "[+-]$", "").alias("segment_id"), F.col("s").endswith("-").alias("is_rev"))
    w = of_kind(rows, "W", 7).where(f[6].rlike("^([<>][^<>]+)+$"))
    w = w.select(F.concat_ws("#", f[1], f[2], f[3]).alias("name"), F.posexplode(F.regexp_extract_all(f[6], F.lit("([<>][^<>]+)"), 1)).alias("step_idx", "s"))
    return p.unionByName(w.select("name", "step_idx", F.substring("s", 2, 1 << 30).alias("segment_id"), F.col("s").startswith("<").alias("is_rev")))


def gfa_lines(segs: DataFrame, lnk: DataFrame) -> DataFrame:
    """value: H, S and L lines, to be written as text in order of (kind, key)."""
    side = lambda c: F.when(F.col(c), "-").otherwise("+")
    head = segs.sparkSession.createDataFrame([(0, "", "H\tVN:Z:1.0")], "kind int, key string, value string")
    s = segs.select(F.lit(1).alias("kind"), F.lpad(F.col("ord").cast("string"), 20, "0").alias("key"), F.concat_ws("\t", F.lit("S"), "id", "sequence").alias("value"))
    cigar = F.coalesce(F.concat(F.col("overlap_bases").cast("string"), F.lit("M")), F.lit("*"))
    rows = lnk.select(F.lit(2).alias("kind"), F.concat_ws(" ", "from", "to").alias("key"), F.concat_ws("\t", F.lit("L"), "from", side("from_rev"), "to", side("to_rev"), cigar).alias("value"))
    return head.unionByName(s).unionByName(rows).orderBy("kind", "key", "value").select("value")


def step_rows(segs: DataFrame, steps: DataFrame) -> DataFrame:
    """path (number of the name in order of names), name, step, node (ordinal of the segment), rev; steps on unknown segments drop out."""
    names = row_numbers(steps.select("name").distinct(), [F.asc("name")], "path")
    known = steps.join(segs.select(F.col("id").alias("segment_id"), F.col("ord").alias("node")), "segment_id").join(names, "name")
    return known.select("path", "name", F.col("step_idx").cast("long").alias("step"), "node", F.col("is_rev").alias("rev"))


def path_lines(steps: DataFrame) -> DataFrame:
    """value: P lines of steps (name, step_idx, segment_id, is_rev)."""
    one = F.struct("step_idx", F.concat("segment_id", F.when(F.col("is_rev"), "-").otherwise("+")).alias("s"))
    walks = steps.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]), ",").alias("walk"))
    return walks.select(F.concat_ws("\t", F.lit("P"), "name", "walk", F.lit("*")).alias("value"))


def from_sequences(seqs: DataFrame) -> DataFrame:
    """value: read_id, sequence as a graph of one segment and one path each."""
    s = F.concat_ws("\t", F.lit("S"), "read_id", "sequence")
    p = F.concat_ws("\t", F.lit("P"), "read_id", F.concat("read_id", F.lit("+")), F.lit("*"))
    return seqs.select(F.explode(F.array(s, p)).alias("value"))


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """segments, links and steps of a graph file, by the file's name: .gfa (or .gfa.gz) only."""
    if not path.lower().removesuffix(".gz").endswith(".gfa"):
        raise ValueError(f"no graph format is known for {path}")
    rows = lines(spark, path)
    return {"segments": segments(rows), "links": links(rows), "steps": path_steps(rows)}
