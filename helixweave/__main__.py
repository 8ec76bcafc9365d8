"""python -m helixweave index|map|inspect: sequences to a stored index, reads to records."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixweave import config
from helixweave.operators import index, seeds
from helixweave.plans import mapping
from helixweave.sinks import records
from helixweave.sources import reads
from helixweave.sources.index_store import Index, save
from helixweave.store import row_numbers, written


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixweave", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    make = sub.add_parser("index", help="sequences (FASTA, FASTQ) to an index")
    make.add_argument("sequences")
    make.add_argument("out")
    make.add_argument("-k", type=int, default=mapping.K)
    make.add_argument("-w", type=int, default=mapping.W)
    run = sub.add_parser("map", help="reads to records against an index")
    run.add_argument("index")
    run.add_argument("reads")
    run.add_argument("out", help=".paf for PAF, GAF else")
    show = sub.add_parser("inspect", help="what an index holds")
    show.add_argument("index")
    return top


def numbered(seqs: DataFrame) -> DataFrame:
    """read (number in order of names), name, seq."""
    return row_numbers(seqs, [F.asc("read_id"), F.asc("source_file")], "read").select("read", F.col("read_id").alias("name"), F.col("sequence").alias("seq"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("helixweave").getOrCreate()
    if a.command == "index":
        paths = written(numbered(reads.provider(a.sequences)(spark, a.sequences)), f"{a.out}/paths")
        save(seeds.minimizers(seeds.base_kmers(paths, a.k), a.w).select("hash", F.col("read").alias("node"), F.col("pos").alias("offset")), a.out, "base", a.k, a.w)
        return
    built = Index(spark, a.index, "base")
    if a.command == "inspect":
        r = built.counts.agg(F.count("*").alias("hashes"), F.sum("n").alias("entries"), F.max("n").alias("most")).first()
        print(f"mode {built.mode}, k {built.k}, w {built.w}, hashes {config.as_count(r.hashes)}, entries {config.as_count(r.entries or 0)}, most for one hash {r.most}")
        index.histogram(built.counts).orderBy("n").show()
        return
    paths = spark.read.schema("read long, name string, seq string").parquet(f"{a.index}/paths")
    asked = numbered(reads.provider(a.reads)(spark, a.reads))
    rows = mapping.chain_records(asked.select("read", "seq"), paths.select("read", "seq"), built)
    names = paths.select(F.col("read").cast("string").alias("path"), F.col("name").alias("target"))
    rows = rows.join(names, "path", "left").withColumn("path", F.col("target")).join(asked.select("read", "name"), "read").withColumn("read", F.col("name"))
    records.lines_for(a.out)(rows).select("value").write.mode("overwrite").text(a.out)


if __name__ == "__main__":
    main()
