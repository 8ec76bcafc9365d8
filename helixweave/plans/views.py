"""The engine's concepts over the driver's tables, once as DataFrames and once as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of an order's lines: unique, so ties can't differ between engines.
STEP_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sequences(self, name: str, key: str) -> DataFrame:
        """read, seq: the letters ACGT of a text."""
        return self.table(name).select(F.col(key).alias("read"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))

    def docs(self) -> DataFrame:
        return self.sequences("documents", "doc_id")

    def items(self) -> DataFrame:
        return self.sequences("benchmark", "item_id")

    def nodes(self) -> DataFrame:
        """ord, len, seq: a part as a segment of p_size bases."""
        base = lambda i: F.substring(F.lit("ACGT"), (F.pmod(F.col("p_partkey") * 7 + i * i * 3 + i * 5, F.lit(4)) + 1).cast("int"), F.lit(1))
        return self.table("part").select(F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("len"),
                                         F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") - 1), base), "").alias("seq"))

    def steps(self) -> DataFrame:
        """path, step, node, rev: an order's lines as a walk over parts; returned lines are walked backwards."""
        w = Window.partitionBy("l_orderkey").orderBy(*STEP_ORDER)
        return self.table("lineitem").select(F.col("l_orderkey").alias("path"), (F.row_number().over(w) - 1).cast("long").alias("step"),
                                             F.col("l_partkey").alias("node"), (F.col("l_returnflag") == "R").alias("rev"))

    def samples(self) -> DataFrame:
        """read, idx, pa, source: a user's events as a read."""
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("user_id").alias("read"), (F.row_number().over(w) - 1).cast("long").alias("idx"),
                                           F.col("value").alias("pa"), F.col("event_type").alias("source"))

    def norm(self) -> DataFrame:
        """read, values array<double>: an embedding as a normalised signal."""
        return self.table("embeddings").select(F.col("vec_id").alias("read"), F.transform("embedding", lambda v: v.cast("double") * 6.0).alias("values"))

    def chains(self) -> DataFrame:
        """read, chain, score, anchors, path length: an order as a chain of its customer."""
        n = self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("anchors"))
        return (self.table("orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"))
                .select(F.col("o_custkey").alias("read"), F.col("o_orderkey").alias("chain"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"), "anchors"))


#: The same views in DuckDB.
CTE = {
    "docs": "docs AS (SELECT doc_id AS read, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM documents)",
    "items": "items AS (SELECT item_id AS read, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS seq FROM benchmark)",
    "nodes": """nodes AS (SELECT p_partkey AS ord, CAST(p_size AS BIGINT) AS len,
      array_to_string(list_transform(range(p_size), lambda i: substr('ACGT', CAST((p_partkey * 7 + i * i * 3 + i * 5) % 4 + 1 AS BIGINT), 1)), '') AS seq FROM part)""",
    "steps": f"""steps AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(STEP_ORDER)}) - 1 AS step,
      l_partkey AS node, l_returnflag = 'R' AS rev FROM lineitem)""",
    "samples": "samples AS (SELECT user_id AS read, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS pa, event_type AS source FROM events)",
    "norm": "norm AS (SELECT vec_id AS read, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 6.0) AS vals FROM embeddings)",
    "chains": """chains AS (SELECT o_custkey AS read, o_orderkey AS chain, floor(o_totalprice / 1000) AS score, n AS anchors
      FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)""",
}


def with_views(sql: str, *names: str) -> str:
    return f"WITH {', '.join(CTE[n] for n in names)}{',' if sql.lstrip()[:6].upper() != 'SELECT' else ''} {sql}"
