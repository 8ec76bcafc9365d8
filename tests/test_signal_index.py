"""The index of signals: seeds that come once are stored as they are, without being dealt by hash."""

from collections import Counter

from helixweave import catalog
from helixweave.sources import index_store


def test_unique_seeds_give_the_same_index(spark, tmp_path):
    rows = [(h % 7, n, o) for n in range(40) for o, h in enumerate(range(n, n + 25))]
    seeds = spark.createDataFrame(rows, "hash long, node long, offset long")
    for name, unique in (("dealt", False), ("own", True)):
        index_store.save(seeds, f"{tmp_path}/{name}", "signal", 4, 1, 4, unique=unique)
        found = index_store.Index(spark, f"{tmp_path}/{name}", "signal")
        assert sorted(map(tuple, found.entries.collect())) == sorted(rows)
        assert {r.hash: r.n for r in found.counts.collect()} == Counter(h for h, _, _ in rows)


def test_one_seed_for_every_six_bases_of_a_path(spark, tmp_path):
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string"
    # paths of 5, 6 and 3 + 8 bases; the first has no seed
    spark.createDataFrame([(k, n, p, 1, 1.0, 1.0, "RN"[n % 2]) for k, n, p in [(1, 1, 5), (2, 1, 6), (3, 1, 3), (3, 2, 8)]], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p, p) for p in (3, 5, 6, 8)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert sum(r.n for r in catalog.queries()["signal_index"](spark, str(tmp_path)).collect()) == 0 + 1 + 6
