"""Golden values and small cases of the mapping operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixweave import config
from helixweave.functions import bits, register, signal
from helixweave.operators import adaptive, anchors, chaining, events, graph, seeds
from helixweave.sinks import records
from helixweave.sources import gfa, index_store, reads
from helixweave.store import row_numbers


def test_token_hashes(spark):
    rows = spark.createDataFrame([([1, 2, 3],)], "t array<bigint>").select(F.inline(seeds.token_kmers(F.col("t"), 2, 4))).collect()
    assert [(r.idx, r.hash) for r in rows] == [(0, 3911557750), (1, 447855090)]


def test_adaptive_tokens(spark):
    rows = spark.createDataFrame([(0.0,), (-3.0,), (3.0,)], "x double").select(signal.adaptive_token(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [3, 6, 15]


def mixed(x, width):
    m = (1 << width) - 1
    x = (~x + (x << 21)) & m
    x ^= x >> 24
    x = (x + (x << 3) + (x << 8)) & m
    x ^= x >> 14
    x = (x + (x << 2) + (x << 4)) & m
    x ^= x >> 28
    return (x + (x << 31)) & m


def test_hash_of_any_width(spark):
    for width in (8, 24, 30, 40, 62):
        codes = [k * 2654435761 % (1 << width) for k in range(200)]
        got = bits.with_hash(spark.createDataFrame([(c,) for c in codes], "code bigint"), "code", width).collect()
        assert [r.hash for r in got] == [mixed(c, width) for c in codes]


def test_revcomp(spark):
    r = spark.createDataFrame([("acgtNR",)], "s string").select(bits.revcomp(F.col("s")).alias("s")).first()
    assert r.s == "NNACGT"


def test_gfa(spark, tmp_path):
    p = tmp_path / "g.gfa"
    p.write_text("H\tVN:Z:1.0\n# note\n\nS\t1\tACGT\nS\t2\tGG\nL\t1\t+\t2\t-\t0M\nP\tpath1\t1+,2-\t0M\nW\ts\t0\tq\t0\t6\t>1<2\nX\tignored\n")
    rows = gfa.lines(spark, str(p))
    assert [tuple(r) for r in gfa.segments(rows).collect()] == [(0, "1", "ACGT"), (1, "2", "GG")]
    assert [tuple(r) for r in gfa.links(rows).collect()] == [("1", False, "2", True, 0)]
    steps = sorted(tuple(r) for r in gfa.path_steps(rows).collect())
    assert steps == [("path1", 0, "1", False), ("path1", 1, "2", True), ("s#0#q", 0, "1", False), ("s#0#q", 1, "2", True)]
    assert gfa.gfa_lines(gfa.segments(rows), gfa.links(rows)).count() == 4


def test_fastq(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@a x\nACGT\n+\nIIII\n>b\nGG\n@bad\nAC\n+\nI\n")
    rows = reads.sequences(spark, str(tmp_path)).collect()
    assert [(r.read_id, r.sequence) for r in rows] == [("a", "ACGT"), ("b", "GG")]


def test_chain_rules():
    cfg = chaining.ChainConfig(min_score=5)
    line = chaining.extracted(np.array([10, 30, 50]), np.array([10, 30, 50]), 20, cfg)
    assert line[0][1] == [0, 1, 2]
    assert chaining.extracted(np.array([10, 700]), np.array([10, 30]), 20, cfg) == []  # off the band
    assert chaining.extracted(np.array([10, 30]), np.array([30, 10]), 20, cfg) == []  # backwards


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20) if k != 10] + [(30, 31)], "u bigint, v bigint")
    labels = {r.node: r.label for r in graph.components(edges).collect()}
    assert labels[10] == 0 and labels[20] == 11 and labels[31] == 30


def plain_peaks(short, long, cfg):
    """The two detectors one value at a time."""
    class Detector:
        def __init__(self, width, limit):
            self.width, self.limit, self.until = width, limit, 0
            self.restart(float("inf"))

        def restart(self, level):
            self.peak, self.level, self.sure = None, level, False

    a, b, found = Detector(cfg.window_short, cfg.threshold_short), Detector(cfg.window_long, cfg.threshold_long), []
    for i in range(1, len(short)):
        for d, now in ((a, short[i]), (b, long[i])):
            if d.until >= i:
                continue
            if d.peak is None:
                if now - d.level > cfg.height:
                    d.peak, d.level = i, now
                else:
                    d.level = min(d.level, now)
                continue
            if now > d.level:
                d.peak, d.level = i, now
            if d is a and a.level > a.limit:
                b.until = a.peak + a.width
                b.restart(float("inf"))
            d.sure = d.sure or (d.level > d.limit and d.level - now > cfg.height)
            if d.sure and i - d.peak > d.width // 2:
                found.append(d.peak)
                d.restart(now)
    return found


def test_peaks_against_single_steps(spark):
    rng = np.random.default_rng(3)
    cfg = events.EventConfig()
    rows = [(k, [(float(a), float(b)) for a, b in rng.gamma(1.2, 2.5, (n, 2))]) for k, n in enumerate([0, 1, 2, 10, 50, 80, 80, 80, 120, 200])]
    rows.append((99, [(0.0, 0.0)] * 50))
    df = spark.createDataFrame(rows, "read long, x array<struct<a: double, b: double>>").select("read", events.peaks(F.col("x"), cfg).alias("p"))
    got = {r.read: r.p for r in df.collect()}
    assert got == {k: plain_peaks([a for a, _ in x], [b for _, b in x], cfg) for k, x in rows}
    assert got[99] == [] and sum(map(len, got.values())) > 10


def test_event_settings():
    assert events.event_config("R10.4").window_long == 10 and events.event_config("r9", sensitivity=2.0).threshold_short == 2.0
    assert events.event_config("r10", height=0.1).height == 0.1


def test_chains_are_paths_of_trees():
    rng = np.random.default_rng(5)
    cfg = chaining.ChainConfig(min_score=15, max_dist=200, band=60)
    for n in (1, 2, 10, 40):
        ref, q = np.sort(rng.integers(0, 400, n)), rng.integers(0, 400, n)
        f, back = chaining.chain_scores(ref, q, 20, cfg)
        taken, plain = set(), []
        for end in sorted(range(n), key=lambda k: (-f[k], k)):  # from the best end back to where another chain has been
            if f[end] < cfg.min_score or end in taken:
                continue
            walk, at = [], end
            while at >= 0 and at not in taken:
                taken.add(at)
                walk.append(at)
                at = int(back[at])
            if at < 0 and len(walk) >= cfg.min_anchors:
                plain.append((float(f[end]), walk[::-1]))
        plain = [c for c in plain[: cfg.max_chains] if c[0] >= cfg.secondary_ratio * plain[0][0]]
        assert chaining.extracted(ref, q, 20, cfg) == plain
        assert set(np.flatnonzero(chaining.used_anchors(ref, q, 20, cfg))) == taken


def test_tolerant_merge(spark):
    hits = spark.createDataFrame([(1, 1, 10, 100, 20, 20), (1, 1, 15, 105, 20, 20), (1, 2, 0, 0, 5, 5), (1, 2, 30, 30, 5, 5)], "read long, node long, offset long, q long, span long, length long")
    got = sorted(tuple(r) for r in anchors.merged(hits, 10).collect())
    assert got == [(1, 1, 10, 100, 25, 25), (1, 2, 0, 0, 5, 5), (1, 2, 30, 30, 5, 5)]


def test_stored_index(spark, tmp_path):
    where = f"file://{tmp_path}/index"
    assert not index_store.probe(spark, where)
    seeds_ = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (7, 2, 5), (9, 1, 3)], "hash long, node long, offset long")
    index_store.save(seeds_, where, "base", 12, 3)
    found = index_store.Index(spark, where, "base")
    assert (found.k, found.w, found.entries.count()) == (12, 3, 3)
    assert {tuple(r) for r in found.counts.collect()} == {(7, 2), (9, 1)}
    cap = spark.createDataFrame([(1,)], "cap long")
    assert [r.node for r in found.lookup(spark.createDataFrame([(7,), (9,)], "hash long"), cap).collect()] == [1]
    for bad in (lambda: index_store.Index(spark, where, "signal"), lambda: index_store.Index(spark, where + "x")):
        with pytest.raises(ValueError):
            bad()


def test_learned_fallback(spark):
    rows = spark.createDataFrame([(0, 2, 1, 2, 400.0, "S"), (0, 2, 2, 2, 103.0, "F"), (0, 2, 3, 2, 107.0, "U"), (0, 2, 4, 1, 500.0, "G"), (1, 2, 1, 3, 103.0, "U")],
                                 "source long, depth long, read long, n_chains long, score double, decision string")
    got = {(r.source, r.read): (r.decision, round(r.threshold, 6)) for r in adaptive.with_learned_fallback(rows).collect()}
    assert got == {(0, 1): ("S", 100.0), (0, 2): ("U", 106.0), (0, 3): ("F", 106.0), (0, 4): ("G", 106.0), (1, 1): ("F", 100.0)}


def test_row_numbers(spark):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "x long")
    assert {r.x: r.n for r in row_numbers(df, [F.desc("x")], "n").collect()} == {k: 100 - k for k in range(101)}


def test_readers_and_names(spark, tmp_path):
    (tmp_path / "m.model").write_text("kmer\tlevel_mean\tlevel_stdv\nAAAAGT\t82.866866\t1\nAAAAGC\t80\t1\n")
    rows = {r.kmer: r.level for r in reads.pore_model(spark, str(tmp_path / "m.model")).collect()}
    assert rows == {"AAAAGT": 82.866866, "AAAAGC": 80.0}
    head = "#slow5_version\t0.2.0\n@asic_id\tx\n#read_id\tread_group\tdigitisation\toffset\trange\tsampling_rate\tlen_raw_signal\traw_signal\n"
    (tmp_path / "a.slow5").write_text(head + "r1\t0\t8192\t6\t1467.61\t4000\t3\t1,2,3\n")
    r = reads.provider("x/a.slow5")(spark, str(tmp_path)).first()
    assert (r.read_id, list(r.raw_signal), r.len_raw_signal) == ("r1", [1, 2, 3], 3)
    pa = spark.createDataFrame([(10, 5.0, 100.0, 200.0), (1, 0.0, 5.0, 0.0)], "raw int, o double, r double, d double").select(signal.to_pa(F.col("raw"), F.col("o"), F.col("r"), F.col("d")).alias("x")).collect()
    assert [x.x for x in pa] == [7.5, 1.0]
    assert reads.provider("a.fq.gz") is reads.sequences
    for name in ("a.pod5", "a.blow5", "a.txt"):
        with pytest.raises(ValueError):
            reads.provider(name)
    with pytest.raises(ValueError):
        gfa.load(spark, "a.vg")
    assert records.lines_for("x.PAF") is records.paf_lines and records.lines_for("x") is records.gaf_lines


def test_settings():
    assert config.tokenizer("nope") is config.tokenizer("rh2") and config.extractor("nope") is config.extractor("kmer")
    assert config.preset("small").ratio_high == 1.7 and config.preset("", min_anchors=9).min_anchors == 9
    assert (config.as_bytes(2048), config.as_count(1500), config.as_duration(3700)) == ("2.0 KB", "1.5K", "1h 1m 40s")


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql("select hash64(1193046, 16777215) as h, revcomp('acgtN') as s, mapq(200D, 20D, 12L) as q, rh2_token(0D) as a, rh2_token(-3D) as b, rh2_token(3D) as c").first()
    assert (r.h, r.s, r.a, r.b, r.c) == (mixed(1193046, 24), "NACGT", 3, 6, 15)
    assert r.q == 60
    assert [tuple(x) for x in spark.sql("select * from kmers('ACGT', 3)").collect()] == [(0, "ACG"), (1, "CGT")]
    assert [tuple(x) for x in spark.sql("select * from gfa_steps('P\\tp\\t1+,2-\\t*')").collect()] == [("1", False), ("2", True)]


def test_stream_in_several_batches(spark, tmp_path):
    from helixweave.streaming import chunk_state

    rows = [(k, k % 3, 40.0 + k % 50) for k in range(300)]
    for part in range(4):
        spark.createDataFrame(rows[part::4], "event_id long, read long, pa double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, read long, pa double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (chunk_state.states(stream, 10).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
         .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))).start())
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch").distinct().count() >= 3
    last = {r.read: (r.n, r.total) for r in out.groupBy("read").agg(F.max_by(F.struct("n", "total"), "n").alias("s")).select("read", "s.*").collect()}
    assert last == {k: (100, sum(p for _, r, p in rows if r == k)) for k in range(3)}


def test_command_line(spark, tmp_path, capsys):
    from helixweave.__main__ import main

    rng = np.random.default_rng(9)
    seqs = ["".join(rng.choice(list("ACGT"), 600)) for _ in range(3)]
    (tmp_path / "p.fa").write_text("".join(f">p{k}\n{s}\n" for k, s in enumerate(seqs)))
    (tmp_path / "r.fa").write_text(f">hit\n{seqs[1][100:300]}\n>none\n{'ACGT' * 10}\n")
    where = str(tmp_path / "index")
    main(["index", str(tmp_path / "p.fa"), where], spark)
    main(["inspect", where], spark)
    assert "mode base, k 12, w 3" in capsys.readouterr().out
    main(["map", where, str(tmp_path / "r.fa"), str(tmp_path / "out.gaf")], spark)
    lines = {r.value.split("\t")[0]: r.value.split("\t") for r in spark.read.text(str(tmp_path / "out.gaf")).collect()}
    hit = lines["hit"]
    assert hit[12] == "pn:Z:p1" and 100 <= int(hit[7]) < 120 and 280 < int(hit[8]) <= 300 and lines["none"][5] == "*"
