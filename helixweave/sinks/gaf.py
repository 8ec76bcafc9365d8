"""Mapping records as tab-separated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAB = "\t"


def short_line() -> Column:
    """Read, path, quality and decision tag of a decided read."""
    unmapped = F.col("decision") == "U"
    return F.concat_ws(TAB, F.concat(F.lit("read"), F.col("read").cast("string")), F.when(unmapped, "*").otherwise(F.concat(F.lit("order"), F.col("chain").cast("string"))),
                       F.col("mapq").cast("string"), F.concat(F.lit("dc:A:"), F.col("decision")))


def parsed(lines: DataFrame) -> DataFrame:
    """value: GAF lines. The twelve columns and tags as map<string, string>; comments and short lines skipped."""
    f = lines.where(~F.col("value").startswith("#")).select(F.split("value", TAB).alias("f")).where(F.size("f") >= 12)
    names = ("query_name", "query_len", "query_start", "query_end", "strand", "graph_path", "path_len", "path_start", "path_end", "matches", "block_len", "mapq")
    tags = F.map_from_entries(F.transform(F.expr("slice(f, 13, size(f) - 12)"), lambda t: F.struct(F.substring_index(t, ":", 1), F.regexp_replace(t, "^[^:]*:[^:]*:", ""))))
    return f.select(*(F.col("f")[i].alias(n) if i in (0, 4, 5) else F.col("f")[i].try_cast("long").alias(n) for i, n in enumerate(names)), tags.alias("tags"))


def write(records: DataFrame, path: str) -> None:
    """value and source_file: one folder of text files for each source file."""
    records.select("value", "source_file").write.mode("overwrite").partitionBy("source_file").text(path)
