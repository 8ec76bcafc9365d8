"""The named queries over the driver's tables, and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixweave.functions import bits, signal
from helixweave.operators import chaining, decide, graph, index, metrics, seeds
from helixweave.operators import signal as sig
from helixweave.plans import mapping
from helixweave.plans.views import CTE, Views
from helixweave.streaming import chunk_state

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None, uses: str = ""):
    """Registers a function of Views by its name; sql may be a SELECT or further common table expressions and a SELECT."""
    def add(f: Callable[[Views], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            views = [CTE[n] for n in uses.split()]
            body = sql.strip()
            more = not body[:6].upper() == "SELECT"
            _ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(views)}{', ' if more and views else ' '}{body}" if views or more else body)
        return f
    return add


def r6(c, name=None):
    out = F.round(c, 6)
    return out.alias(name) if name else out


# ---- hashing in DuckDB -------------------------------------------------------------------------------------------

def _hash(source: str, width: int, out: str = "hash") -> str:
    """CTEs h1 to h4: source's column code mixed over width bits; the last has column `out`."""
    p = 1 << width
    big = "CAST({} AS HUGEINT)"
    return f"""h1 AS (SELECT * EXCLUDE y, xor(y, y // 16777216) AS x FROM (SELECT *, ({p - 1} - code + {big.format('code')} * 2097152 % {p}) % {p} AS y FROM {source})),
h2 AS (SELECT * EXCLUDE (x, y), xor(y, y // 16384) AS x FROM (SELECT *, x * 265 % {p} AS y FROM h1)),
h3 AS (SELECT * EXCLUDE (x, y), xor(y, y // 268435456) AS x FROM (SELECT *, x * 21 % {p} AS y FROM h2)),
h4 AS (SELECT * EXCLUDE x, CAST((x + x * 2147483648) % {p} AS BIGINT) AS {out} FROM h3)"""


def _kmers(source: str, k: int, prefix: str) -> str:
    """CTE <prefix>hash (read, pos, hash) of the k-mers of a view, chained through names of its own."""
    code = " + ".join(f"(instr('ACGT', substr(seq, p + {j}, 1)) - 1) * {4 ** (k - 1 - j)}" for j in range(1, k))
    code = f"(instr('ACGT', substr(seq, p, 1)) - 1) * {4 ** (k - 1)} + {code}"
    sql = f"h0 AS (SELECT read, p - 1 AS pos, CAST({code} AS BIGINT) AS code FROM (SELECT read, seq, unnest(range(1, length(seq) - {k} + 2)) AS p FROM {source} WHERE length(seq) >= {k})), {_hash('h0', 2 * k)}"
    for j in range(5):
        sql = sql.replace(f"h{j} ", f"{prefix}h{j} ").replace(f"h{j})", f"{prefix}h{j})")
    return sql


def _minimizers(prefix: str, w: int) -> str:
    """CTE <prefix>min (read, pos, hash)."""
    return f"""{prefix}w AS (SELECT read, pos AS place, min(CAST(hash AS HUGEINT) * 4294967296 + pos) OVER win AS best, count(*) OVER win AS size
  FROM {prefix}h4 WINDOW win AS (PARTITION BY read ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)),
{prefix}min AS (SELECT read, CAST(best % 4294967296 AS BIGINT) AS pos, CAST(best // 4294967296 AS BIGINT) AS hash FROM
  (SELECT *, lag(best % 4294967296) OVER (PARTITION BY read ORDER BY place) AS last FROM {prefix}w WHERE size = {w}) WHERE last IS NULL OR last <> best % 4294967296)"""


_ITEM_MIN = f"{_kmers('items', 12, 'i')}, {_minimizers('i', 3)}"
_DOC_MIN = f"{_kmers('docs', 12, 'd')}, {_minimizers('d', 3)}"
_INDEX = f"{_DOC_MIN}, freq AS (SELECT hash, count(*) AS n FROM dmin GROUP BY hash)"
_CAP = "cap AS (SELECT list_sort(list(n))[least(CAST(floor(count(*) * 0.99) AS BIGINT), count(*) - 1) + 1] + 1 AS cap FROM freq)"
_ANCHORS = f"{_ITEM_MIN}, {_INDEX}, {_CAP}, anchors AS (SELECT imin.read, dmin.read AS path, dmin.pos AS ref, imin.pos AS q FROM imin JOIN freq USING (hash) JOIN dmin USING (hash) WHERE n <= (SELECT cap FROM cap))"
_GAP = 0.8 * 0.01 * 12
_SCORE = f"least(12, least(dr, dq)) - CASE WHEN dr <> dq OR least(dr, dq) > 12 THEN CAST(floor({_GAP} * abs(dr - dq) + 0.5 * log2(abs(dr - dq) + 1.0)) AS BIGINT) ELSE 0 END"
_BAND = "dr > 0 AND dr <= 2500 AND dq > 0 AND dq <= 2500 AND abs(dr - dq) <= 500"
#: Exact chain scores: the state carries all scores so far of a group, each step adds one anchor's.
_CHAINS = f"""groups AS (SELECT read, path, count(*) AS n, list(ref ORDER BY ref, q) AS rs, list(q ORDER BY ref, q) AS qs FROM anchors GROUP BY read, path),
dp(read, path, n, rs, qs, i, f) AS (
  SELECT read, path, n, rs, qs, CAST(1 AS BIGINT), [CAST(12 AS BIGINT)] FROM groups
  UNION ALL
  SELECT read, path, n, rs, qs, i + 1, list_append(f, greatest(12, coalesce(list_max(list_transform(range(1, i + 1), lambda j: (SELECT CASE WHEN {_BAND} THEN f[j] + {_SCORE} END FROM (SELECT rs[i + 1] - rs[j] AS dr, qs[i + 1] - qs[j] AS dq)))), 12))) FROM dp WHERE i < n
)"""


def _inline_dp() -> str:
    dr, dq = "(rs[i + 1] - rs[j])", "(qs[i + 1] - qs[j])"
    band = _BAND.replace("dr", dr).replace("dq", dq)
    score = _SCORE.replace("dr", dr).replace("dq", dq)
    a = _CHAINS.index("lambda j: ") + len("lambda j: ")
    b = _CHAINS.index(")))), 12)))")
    return _CHAINS[:a] + f"CASE WHEN {band} THEN f[j] + {score} END" + ")), 12)))" + _CHAINS[b + len(")))), 12)))"):]


_SCORED = f"{_ANCHORS}, {_inline_dp()}, scored AS (SELECT read, path, n, list_max(f) AS score FROM dp WHERE i = n)"
_MAPQ = "CASE WHEN score <= 0 THEN 0 ELSE CAST(least(60, greatest(0, trunc(least(CASE WHEN anchors > 10 THEN 1.0 ELSE 0.1 * anchors END, CASE WHEN score > 100 THEN 1.0 ELSE 0.01 * score END) * 40.0 * (1.0 - greatest(second, 15.0) / score) * ln(score)))) AS BIGINT) END"
_RANKED = """ranked AS (SELECT read, chain, score, anchors, rank FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY score DESC, chain) - 1 AS rank, max(score) OVER (PARTITION BY read) AS best FROM {}) WHERE rank < 10 AND score >= 0.3 * best),
quality AS (SELECT read, chain, score, anchors, rank, {} AS mapq FROM (SELECT *, coalesce(lead(score) OVER (PARTITION BY read ORDER BY score DESC, chain), 0.0) AS second FROM ranked))"""
_DECIDED = """best AS (SELECT read, count(*) AS n_chains, avg(mapq) AS mq, avg(score) AS mc FROM quality GROUP BY read),
top AS (SELECT read, n_chains, chain, CAST(score AS DOUBLE) AS score, mapq, anchors,
  0.35 * least(mapq / 30.0, 1.0) + 0.05 * CASE WHEN mapq > 0 THEN greatest(0.0, 1.0 - mq / mapq) ELSE 0.0 END + 0.6 * CASE WHEN score > 0 THEN greatest(0.0, 1.0 - mc / score) ELSE 0.0 END AS standout
  FROM best JOIN quality USING (read) WHERE rank = 0),
decided AS (SELECT *, CASE WHEN n_chains = 1 AND anchors >= 5 THEN 'G' WHEN n_chains > 1 AND standout >= 0.45 THEN 'S' WHEN n_chains > 1 AND score >= 100 THEN 'F' ELSE 'U' END AS decision FROM top)"""


# ---- sequence mapping --------------------------------------------------------------------------------------------

@query(f"{_SCORED}, src AS (SELECT read, path AS chain, CAST(score AS DOUBLE) AS score, n AS anchors FROM scored WHERE score >= 15), {_RANKED.format('src', _MAPQ)}, {_DECIDED} "
       "SELECT read, n_chains, chain AS path, score, mapq, anchors, round(standout, 6) AS standout, decision FROM decided", "items docs")
def flagship_map_passages(v):
    return mapping.mapped(v.items(), v.docs()).withColumn("standout", r6("standout"))


@query(f"{_kmers('items', 12, 'i')} SELECT read, pos, hash FROM ih4", "items")
def base_kmer_hashes(v):
    return seeds.base_kmers(v.items(), 12)


@query(f"{_ITEM_MIN} SELECT read, pos, hash FROM imin", "items")
def base_minimizers(v):
    return seeds.minimizers(seeds.base_kmers(v.items(), 12), 3)


@query(f"{_INDEX} SELECT hash, read AS node, pos AS \"offset\" FROM dmin", "docs")
def seed_index(v):
    return mapping.base_index(v.docs())


@query(f"{_INDEX} SELECT n, count(*) AS hashes FROM freq GROUP BY n", "docs")
def seed_freq_hist(v):
    return index.histogram(index.frequencies(mapping.base_index(v.docs())))


@query(f"{_INDEX} SELECT count(*) AS unique_hashes, CAST(sum(n) AS BIGINT) AS entries, max(n) AS max_n, max(n) + 1 AS stored_threshold FROM freq", "docs")
def index_stats(v):
    return index.frequencies(mapping.base_index(v.docs())).agg(F.count("*").alias("unique_hashes"), F.sum("n").alias("entries"), F.max("n").alias("max_n"), (F.max("n") + 1).alias("stored_threshold"))


@query(f"{_INDEX}, {_CAP} SELECT cap FROM cap", "docs")
def freq_cap_percentile(v):
    return index.percentile_cap(index.frequencies(mapping.base_index(v.docs())), 0.99)


@query(f"{_INDEX} SELECT CAST(least(greatest(list_sort(list(n))[least(CAST(floor(count(*) * (1 - 0.0002)) AS BIGINT), count(*) - 1) + 1] + 1, 10), 1000000) AS BIGINT) AS cap FROM freq", "docs")
def freq_cap_topfrac(v):
    return index.top_fraction_cap(index.frequencies(mapping.base_index(v.docs())), 0.0002, 10, 1_000_000)


@query(f"{_ANCHORS} SELECT read, path, ref, q FROM anchors", "items docs")
def seed_lookup(v):
    return mapping.anchors(v.items(), v.docs())


def _item_hits(v):
    freq = index.frequencies(mapping.base_index(v.docs()))
    return seeds.minimizers(seeds.base_kmers(v.items(), 12), 3).join(freq, "hash")


@query(f"{_ITEM_MIN}, {_INDEX} SELECT read, pos, n FROM (SELECT read, pos, n, coalesce(sum(n) OVER (PARTITION BY read ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM imin JOIN freq USING (hash)) WHERE before < 40", "items docs")
def hit_cap(v):
    before = F.coalesce(F.sum("n").over(Window.partitionBy("read").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _item_hits(v).withColumn("before", before).where("before < 40").select("read", "pos", "n")


@query(f"""{_ITEM_MIN}, {_INDEX}, hits AS (SELECT read, pos, n, n > 3 AS high FROM imin JOIN freq USING (hash)),
isl AS (SELECT *, sum(CASE WHEN high THEN 0 ELSE 1 END) OVER (PARTITION BY read ORDER BY pos) AS island FROM hits),
hi AS (SELECT *, row_number() OVER (PARTITION BY read, island ORDER BY n, pos) AS r, max(pos) OVER (PARTITION BY read, island) - min(pos) OVER (PARTITION BY read, island) AS span FROM isl WHERE high)
SELECT read, pos, n FROM hits WHERE NOT high UNION ALL SELECT read, pos, n FROM hi WHERE r <= greatest(1, (span + 10) // 20)""", "items docs")
def occ_select(v):
    hits = _item_hits(v).withColumn("high", F.col("n") > 3)
    low = F.sum(F.when(F.col("high"), 0).otherwise(1)).over(Window.partitionBy("read").orderBy("pos"))
    isl = Window.partitionBy("read", "island")
    hi = hits.withColumn("island", low).where("high").withColumn("r", F.row_number().over(isl.orderBy("n", "pos"))).withColumn("span", F.max("pos").over(isl) - F.min("pos").over(isl))
    kept = hi.where(F.col("r") <= F.greatest(F.lit(1), F.floor((F.col("span") + 10) / 20)))
    return hits.where("not high").select("read", "pos", "n").unionByName(kept.select("read", "pos", "n"))


_PAIR = _SCORE.replace("dr", "(a.ref - b.ref)").replace("dq", "(a.q - b.q)")
_NEAR = _BAND.replace("dr", "(a.ref - b.ref)").replace("dq", "(a.q - b.q)")


@query(f"{_ANCHORS} SELECT a.read, a.path, a.ref AS ri, a.q AS qi, b.ref AS rj, b.q AS qj, {_PAIR} AS score FROM anchors a JOIN anchors b ON a.read = b.read AND a.path = b.path WHERE {_NEAR}", "items docs")
def band_pairs_scored(v):
    a = mapping.anchors(v.items(), v.docs()).withColumn("span", F.lit(12).cast("long")).withColumn("grp", F.struct("read", "path"))
    return chaining.band_pairs(a, chaining.ChainConfig().scaled(12)).select("grp.read", "grp.path", "ri", "qi", "rj", "qj", "score")


@query(f"{_SCORED} SELECT read, path, n, CAST(score AS DOUBLE) AS score FROM scored", "items docs")
def chain_exact(v):
    return chaining.best_scores(mapping.anchors(v.items(), v.docs()), 12, chaining.ChainConfig().scaled(12))


@query(f"""{_ANCHORS}, d AS (SELECT *, ref - q AS diag, lag(q) OVER w + 12 AS reach FROM anchors WINDOW w AS (PARTITION BY read, path, ref - q ORDER BY q)),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR q > reach THEN 1 ELSE 0 END) OVER (PARTITION BY read, path, diag ORDER BY q) AS isl FROM d)
SELECT read, path, min(ref) AS ref, min(q) AS q, max(q) + 12 - min(q) AS length FROM g GROUP BY read, path, diag, isl""", "items docs")
def diag_merge_islands(v):
    w = Window.partitionBy("read", "path", "diag").orderBy("q")
    d = mapping.anchors(v.items(), v.docs()).withColumn("diag", F.col("ref") - F.col("q"))
    d = d.withColumn("new", F.coalesce(F.col("q") > F.lag("q").over(w) + 12, F.lit(True)).cast("int"))
    g = d.withColumn("isl", F.sum("new").over(w))
    return g.groupBy("read", "path", "diag", "isl").agg(F.min("ref").alias("ref"), F.min("q").alias("q"), (F.max("q") + 12 - F.min("q")).alias("length")).drop("diag", "isl")


@query("SELECT read, replace(replace(replace(replace(reverse(seq), 'A', 't'), 'C', 'g'), 'G', 'c'), 'T', 'a').upper() AS seq FROM items", "items")
def revcomp_sequences(v):
    return v.items().select("read", bits.revcomp(F.col("seq")).alias("seq"))


@query(f"""pre AS (SELECT read, unnest(range(1, CAST(ceil(length(seq) / 20.0) AS BIGINT) + 1)) AS chunk, seq FROM items), items2 AS (SELECT read * 100000 + chunk AS read, substr(seq, 1, 20 * chunk) AS seq FROM pre), {_kmers('items2', 12, 'i')}
SELECT read // 100000 AS read, read % 100000 AS chunk, count(*) AS kmers FROM ih4 GROUP BY 1, 2""", "items")
def prefix_chunks(v):
    pre = v.items().where("seq <> ''").select("read", "seq", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.length("seq") / 20))).alias("chunk"))
    pre = pre.select(F.struct("read", "chunk").alias("read"), F.expr("substring(seq, 1, cast(20 * chunk as int))").alias("seq"))
    return seeds.base_kmers(pre, 12).groupBy("read").agg(F.count("*").alias("kmers")).select("read.read", "read.chunk", "kmers")


# ---- decisions over orders as chains -----------------------------------------------------------------------------

_Q = _RANKED.format("chains", _MAPQ)


@query(f"{_Q} SELECT read, chain, rank, score FROM ranked", "chains")
def secondary_topk(v):
    return decide.ranked(v.chains()).select("read", "chain", "rank", "score")


@query(f"{_Q} SELECT read, chain, mapq FROM quality", "chains")
def mapq(v):
    return decide.with_mapq(decide.ranked(v.chains())).select("read", "chain", "mapq")


@query(f"{_Q}, {_DECIDED} SELECT read, n_chains, round(standout, 6) AS standout FROM decided", "chains")
def standout(v):
    return decide.standout(decide.with_mapq(decide.ranked(v.chains()))).select("read", "n_chains", r6("standout", "standout"))


@query(f"{_Q}, {_DECIDED} SELECT read, chain, decision FROM decided", "chains")
def gate_decision(v):
    return decide.decided(decide.standout(decide.with_mapq(decide.ranked(v.chains())))).select("read", "chain", "decision")


@query(f"""{_Q}, {_DECIDED} SELECT count(*) AS reads, count(*) FILTER (decision <> 'U') AS mapped, count(*) FILTER (decision = 'U') AS unmapped,
  CAST(sum(n_chains) AS BIGINT) AS written, CAST(sum(n_chains - 1) AS BIGINT) AS secondary FROM decided""", "chains")
def map_stats(v):
    d = decide.decided(decide.standout(decide.with_mapq(decide.ranked(v.chains()))))
    return d.agg(F.count("*").alias("reads"), F.count_if(F.col("decision") != "U").alias("mapped"), F.count_if(F.col("decision") == "U").alias("unmapped"), F.sum("n_chains").alias("written"), F.sum(F.col("n_chains") - 1).alias("secondary"))


@query(f"{_Q}, {_DECIDED} SELECT decision, count(*) AS reads, CAST(sum(mapq) AS BIGINT) AS mapq_sum FROM decided GROUP BY decision", "chains")
def fallback_floor(v):
    d = decide.decided(decide.standout(decide.with_mapq(decide.ranked(v.chains()))))
    return d.groupBy("decision").agg(F.count("*").alias("reads"), F.sum("mapq").alias("mapq_sum"))


# ---- signals -----------------------------------------------------------------------------------------------------

_FILT = "filt AS (SELECT read, row_number() OVER (PARTITION BY read ORDER BY idx) - 1 AS idx, pa, source FROM samples WHERE pa > 30 AND pa < 200)"


@query(f"{_FILT} SELECT read, idx, pa, source FROM filt", "samples")
def pa_range_filter(v):
    return sig.filtered(v.samples())


@query(f"{_FILT} SELECT read, idx, round((pa - m) / s, 6) AS z FROM (SELECT *, avg(pa) OVER (PARTITION BY read) AS m, stddev_pop(pa) OVER (PARTITION BY read) AS s FROM filt) WHERE s > 0 AND abs((pa - m) / s) < 3", "samples")
def zscore_read(v):
    return sig.zscored(sig.filtered(v.samples())).select("read", "idx", r6("z", "z"))


@query(f"""{_FILT}, c AS (SELECT *, idx // 10 AS chunk FROM filt), s AS (SELECT read, chunk, count(*) AS n, sum(pa) AS s, sum(pa * pa) AS ss FROM c GROUP BY 1, 2),
r AS (SELECT read, chunk, sum(s) OVER w / sum(n) OVER w AS mu, sum(ss) OVER w / sum(n) OVER w AS m2 FROM s WINDOW w AS (PARTITION BY read ORDER BY chunk)),
t AS (SELECT read, chunk, mu, sqrt(greatest(m2 - mu * mu, 0.0)) AS sd FROM r)
SELECT read, chunk, idx, round((pa - mu) / sd, 6) AS z FROM c JOIN t USING (read, chunk) WHERE sd > 1e-6 AND abs((pa - mu) / sd) < 3""", "samples")
def zscore_progressive(v):
    return sig.zscored_by_chunk(sig.filtered(v.samples()), 10).withColumn("z", r6("z"))


@query(f"""{_FILT} SELECT read, idx, CASE WHEN n1 = 3 AND n2 = 3 THEN round(abs(m2 - m1) / sqrt(greatest((a1 - m1 * m1 + a2 - m2 * m2) / 3, 1.17549435e-38)), 4) ELSE 0.0 END AS t FROM (
SELECT read, idx, avg(pa) OVER l AS m1, avg(pa) OVER r AS m2, avg(pa * pa) OVER l AS a1, avg(pa * pa) OVER r AS a2, count(*) OVER l AS n1, count(*) OVER r AS n2 FROM filt
WINDOW l AS (PARTITION BY read ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY read ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))""", "samples")
def tstat_profile(v):
    return sig.t_statistic(sig.filtered(v.samples()), 3).select("read", "idx", F.round("t", 4).alias("t"))


@query(f"""{_FILT}, s AS (SELECT read, idx // 8 AS seg, list_sort(list(pa)) AS x FROM filt GROUP BY 1, 2), q AS (SELECT *, x[len(x) // 4 + 1] AS q1, x[len(x) * 3 // 4 + 1] AS q3 FROM s)
SELECT read, seg, CAST(len(x) AS BIGINT) AS n, round(list_avg(list_filter(x, lambda v: v >= 2 * q1 - q3 AND v <= 2 * q3 - q1)), 6) AS mean FROM q""", "samples")
def event_means_iqr(v):
    return sig.trimmed_means(sig.filtered(v.samples()).withColumn("seg", F.floor(F.col("idx") / 8))).withColumn("mean", r6("mean"))


@query("""f(read, vals, i, last, kept) AS (SELECT read, vals, CAST(1 AS BIGINT), vals[1], [CAST(0 AS BIGINT)] FROM norm UNION ALL
SELECT read, vals, i + 1, CASE WHEN abs(vals[i + 1] - last) >= 0.35 THEN vals[i + 1] ELSE last END, CASE WHEN abs(vals[i + 1] - last) >= 0.35 THEN list_append(kept, i) ELSE kept END FROM f WHERE i < len(vals))
SELECT read, unnest(kept) AS pos FROM f WHERE i = len(vals)""", "norm")
def diff_filter(v):
    return v.norm().select("read", F.explode(signal.kept_by_difference(F.col("values"), 0.35)).alias("pos")).select("read", F.col("pos").cast("long").alias("pos"))


_TOK = """tok AS (SELECT read, p - 1 AS pos, CASE WHEN c >= -2 AND c <= 2 THEN floor(0.4 * ((c + 3.0) / 6.0 - a) / (b - a) * 15) WHEN (c + 3.0) / 6.0 < 0.5 THEN floor((0.4 + 0.3 * ((c + 3.0) / 6.0)) * 15) ELSE floor((0.4 + 0.3 + 0.3 * ((c + 3.0) / 6.0)) * 15) END AS token
FROM (SELECT read, p, least(3.0, greatest(-3.0, vals[p])) AS c, (-2.0 + 3.0) / 6.0 AS a, (2.0 + 3.0) / 6.0 AS b FROM (SELECT read, vals, unnest(range(1, len(vals) + 1)) AS p FROM norm)))"""


@query(f"{_TOK} SELECT read, pos, CAST(token AS BIGINT) AS token FROM tok", "norm")
def rh2_tokens(v):
    at = v.norm().select("read", F.posexplode("values").alias("pos", "x"))
    return at.select("read", F.col("pos").cast("long").alias("pos"), signal.adaptive_token(F.col("x")).alias("token"))


@query(f"{_TOK}, l AS (SELECT read, list(CAST(token AS BIGINT) ORDER BY pos) AS t FROM tok GROUP BY read), h0 AS (SELECT read, idx, t[idx + 1] * 4096 + t[idx + 2] * 256 + t[idx + 3] * 16 + t[idx + 4] AS code FROM (SELECT read, t, unnest(range(0, len(t) - 3)) AS idx FROM l)), {_hash('h0', 32)} SELECT read, idx, hash FROM h4", "norm")
def kmer_seed_hashes(v):
    tokens = F.transform("values", lambda x: signal.adaptive_token(x))
    return v.norm().select("read", F.inline(seeds.token_kmers(tokens, 4, 4)))


@query(f"{_TOK}, l AS (SELECT read, list(CAST(token AS BIGINT) ORDER BY pos) AS t FROM tok GROUP BY read), h0 AS (SELECT read, idx AS pos, t[idx + 1] * 4096 + t[idx + 2] * 256 + t[idx + 3] * 16 + t[idx + 4] AS code FROM (SELECT read, t, unnest(range(0, len(t) - 3)) AS idx FROM l)), {_hash('h0', 32)}, zh4 AS (SELECT * FROM h4), {_minimizers('z', 5)} SELECT read, pos, hash FROM zmin", "norm")
def token_minimizers(v):
    tokens = F.transform("values", lambda x: signal.adaptive_token(x))
    found = v.norm().select("read", F.inline(seeds.token_kmers(tokens, 4, 4))).withColumnRenamed("idx", "pos")
    return seeds.minimizers(found, 5)


_VAL = """pt AS (SELECT read, p - 1 AS pos, vals[p] AS v FROM (SELECT read, vals, unnest(range(1, len(vals) + 1)) AS p FROM norm)),
low AS (SELECT read, pos, v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM pt WINDOW w AS (PARTITION BY read ORDER BY pos)) WHERE (a IS NULL OR v <= a) AND (b IS NULL OR v <= b))"""


@query(f"{_VAL} SELECT read, pos, round(v, 6) AS v FROM low", "norm")
def landmark_raw_valleys(v):
    return sig.valleys(v.norm()).withColumn("v", r6("v"))


@query(f"""{_VAL}, nxt AS (SELECT read, pos, v, lead(pos) OVER w AS p2, lead(v) OVER w AS v2 FROM low WINDOW w AS (PARTITION BY read ORDER BY pos)),
pk AS (SELECT nxt.read, nxt.pos, p2, nxt.v, v2, max(pt.v) AS top FROM nxt JOIN pt ON pt.read = nxt.read AND pt.pos BETWEEN nxt.pos AND p2 WHERE p2 IS NOT NULL GROUP BY ALL)
SELECT read, p2 AS pos, least(CAST(floor(ln(1 + least(top - v, 4.0)) / ln(5.0) * 4) AS BIGINT), 3) * 4 + least(CAST(floor(ln(1 + least(top - v2, 4.0)) / ln(5.0) * 4) AS BIGINT), 3) AS token FROM pk""", "norm")
def landmark_tokens(v):
    w = Window.partitionBy("read").orderBy("pos")
    nxt = sig.valleys(v.norm()).select("read", "pos", "v", F.lead("pos").over(w).alias("p2"), F.lead("v").over(w).alias("v2")).where("p2 is not null")
    both = nxt.join(v.norm(), "read").select("*", F.array_max(F.expr("slice(values, cast(pos as int) + 1, cast(p2 - pos as int) + 1)")).alias("top"))
    return both.select("read", F.col("p2").alias("pos"), (signal.log_level(F.col("top") - F.col("v")) * 4 + signal.log_level(F.col("top") - F.col("v2"))).alias("token"))


@query(f"""{_FILT}, c AS (SELECT read, idx // 10 AS chunk, count(*) AS n, sum(pa) AS s FROM filt GROUP BY 1, 2)
SELECT read, CAST(sum(n) AS BIGINT) AS n, round(sum(s), 4) AS total, count(*) AS chunks FROM c GROUP BY read""", "samples")
def stream_chunk_state(v):
    return chunk_state.run(v, 10)


# ---- graphs ------------------------------------------------------------------------------------------------------

_RC = "replace(replace(replace(replace(reverse(seq), 'A', 't'), 'C', 'g'), 'G', 'c'), 'T', 'a').upper()"
_DIR = "dir AS (SELECT path, step, node * 2 + CASE WHEN rev THEN 1 ELSE 0 END AS node_id FROM steps)"
_EDGE = f"{_DIR}, edge AS (SELECT DISTINCT u, v FROM (SELECT node_id AS u, lead(node_id) OVER (PARTITION BY path ORDER BY step) AS v FROM dir) WHERE v IS NOT NULL)"
_LIN = "lin AS (SELECT path, step, node, rev, len, CAST(coalesce(sum(len) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS coord FROM steps JOIN nodes ON node = ord)"


@query(f"SELECT ord * 2 AS node_id, seq, len FROM nodes UNION ALL SELECT ord * 2 + 1, {_RC}, len FROM nodes", "nodes")
def expand_nodes(v):
    return graph.expand_nodes(v.nodes())


@query(f"{_EDGE} SELECT DISTINCT u, v FROM (SELECT u, v FROM edge UNION ALL SELECT xor(v, 1), xor(u, 1) FROM edge)", "steps")
def expand_edges(v):
    return graph.expand_edges(graph.links(v.steps()))


@query(f"{_DIR}, l AS (SELECT *, max(step) OVER (PARTITION BY path) AS last FROM dir) SELECT path * 2 AS path_id, step, node_id FROM l UNION ALL SELECT path * 2 + 1, last - step, xor(node_id, 1) FROM l", "steps")
def expand_paths(v):
    return graph.expand_paths(v.steps())


@query(f"{_LIN} SELECT path, step, node, rev, len, coord FROM lin", "steps nodes")
def linearize(v):
    return graph.linearized(v.steps(), v.nodes())


@query(f"{_LIN} SELECT path, count(*) AS n_steps, CAST(CASE WHEN sum(len) >= 30 THEN sum(len) ELSE 0 END AS BIGINT) AS length FROM lin GROUP BY path", "steps nodes")
def path_lengths(v):
    return graph.path_lengths(graph.linearized(v.steps(), v.nodes()), 30)


@query(f"{_LIN} SELECT path, step, CASE WHEN rev THEN '<' ELSE '>' END || node AS step_name, coord + len AS cum_bp FROM lin", "steps nodes")
def path_step_table(v):
    lin = graph.linearized(v.steps(), v.nodes())
    return lin.select("path", "step", F.concat(F.when(F.col("rev"), "<").otherwise(">"), F.col("node").cast("string")).alias("step_name"), (F.col("coord") + F.col("len")).alias("cum_bp"))


@query(f"{_LIN} SELECT path % 7 AS file, CAST(coalesce(sum(len) FILTER (NOT rev), 0) AS BIGINT) AS forward, CAST(coalesce(sum(len) FILTER (rev), 0) AS BIGINT) AS backward FROM lin GROUP BY 1", "steps nodes")
def path_length_pivot(v):
    lin = graph.linearized(v.steps(), v.nodes()).select((F.col("path") % 7).alias("file"), F.when(F.col("rev"), "backward").otherwise("forward").alias("side"), "len")
    return lin.groupBy("file").pivot("side", ["forward", "backward"]).agg(F.sum("len")).na.fill(0)


_SEQ = f"known AS (SELECT path, step, CASE WHEN rev THEN {_RC} ELSE seq END AS s FROM steps JOIN nodes ON node = ord), seqs AS (SELECT path, string_agg(s, '' ORDER BY step) AS seq FROM known GROUP BY path)"


@query(f"""{_SEQ}, km AS (SELECT path, p - 1 AS pos, (instr('ACGT', substr(seq, p, 1)) - 1) * 16 + (instr('ACGT', substr(seq, p + 1, 1)) - 1) * 4 + instr('ACGT', substr(seq, p + 2, 1)) - 1 AS code
FROM (SELECT path, seq, unnest(range(1, length(seq) - 1)) AS p FROM seqs)) SELECT path, count(*) AS n, CAST(sum((code * 37) % 101 - 50) AS BIGINT) AS level_sum, CAST(sum(pos * ((code * 37) % 101 - 50)) AS BIGINT) AS moment FROM km GROUP BY path""", "steps nodes")
def squiggle_levels(v):
    seqs = graph.path_sequences(v.steps(), v.nodes()).where(F.length("seq") >= 3)
    at = seqs.select("path", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 2)).alias("p"))
    code = bits.base_code(F.substring(F.col("seq"), F.col("p"), F.lit(3)))
    level = (code * 37) % 101 - 50
    return at.select("path", (F.col("p") - 1).cast("long").alias("pos"), level.alias("x")).groupBy("path").agg(F.count("*").alias("n"), F.sum("x").alias("level_sum"), F.sum(F.col("pos") * F.col("x")).alias("moment"))


@query(f"{_LIN}, tot AS (SELECT path, sum(len) AS total FROM lin GROUP BY path), ask AS (SELECT path, unnest([0, total // 2, total - 1]) AS pos FROM tot) SELECT DISTINCT ask.path, CAST(ask.pos AS BIGINT) AS pos, node, CAST(ask.pos - coord AS BIGINT) AS \"offset\" FROM ask JOIN lin ON ask.path = lin.path AND ask.pos >= coord AND ask.pos < coord + len", "steps nodes")
def pos_to_node_offset(v):
    lin = graph.linearized(v.steps(), v.nodes())
    total = lin.groupBy("path").agg(F.sum("len").alias("t"))
    ask = total.select("path", F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("t") / 2), F.col("t") - 1)).alias("pos")).distinct()
    hit = (F.col("pos") >= F.col("coord")) & (F.col("pos") < F.col("coord") + F.col("len"))
    return ask.join(lin, "path").where(hit).select("path", "pos", "node", (F.col("pos") - F.col("coord")).alias("offset"))


_COMP = """e AS (SELECT c_custkey * 2 AS u, CAST(c_nationkey AS BIGINT) * 2 + 1 AS v FROM customer
UNION ALL SELECT s_suppkey * 2 + 1000000, CAST(s_nationkey AS BIGINT) * 2 + 1 FROM supplier), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
cc(node, label) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, cc.label FROM cc JOIN b ON cc.node = b.u), labels AS (SELECT node, min(label) AS label FROM cc GROUP BY node)"""


@query(f"{_COMP}, sz AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS component FROM labels GROUP BY label) SELECT node, component, size FROM labels JOIN sz USING (label)")
def components(v):
    c = v.table("customer").select((F.col("c_custkey") * 2).alias("u"), (F.col("c_nationkey").cast("long") * 2 + 1).alias("v"))
    s = v.table("supplier").select((F.col("s_suppkey") * 2 + 1_000_000).alias("u"), (F.col("s_nationkey").cast("long") * 2 + 1).alias("v"))
    return graph.numbered(graph.components(c.unionByName(s)))


@query(f"{_DIR}, w AS (SELECT path, string_agg(CASE WHEN node_id % 2 = 1 THEN '<' ELSE '>' END || node_id // 2, '' ORDER BY step) AS walk FROM (SELECT *, lag(node_id) OVER (PARTITION BY path ORDER BY step) AS last FROM dir) WHERE last IS NULL OR last <> node_id GROUP BY path) SELECT path, walk FROM w", "steps")
def node_walk(v):
    w = Window.partitionBy("path").orderBy("step")
    run = graph.directed(v.steps()).withColumn("last", F.lag("node_id").over(w)).where("last is null or last <> node_id")
    name = F.concat(F.when(F.col("node_id") % 2 == 1, "<").otherwise(">"), F.floor(F.col("node_id") / 2).cast("string"))
    return run.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", name.alias("n")))), lambda x: x["n"]), "").alias("walk"))


@query(f"""{_LIN}, p AS (SELECT path, sum(len) AS total, least(5, sum(len)) AS a, sum(len) - sum(len) // 3 AS b, path % 2 = 1 AS back FROM lin GROUP BY path)
SELECT path, CASE WHEN back THEN '-' ELSE '+' END AS strand, CAST(CASE WHEN back THEN total - b ELSE a END AS BIGINT) AS ref_start, CAST(CASE WHEN back THEN total - a ELSE b END AS BIGINT) AS ref_end FROM p""", "steps nodes")
def strand_flip(v):
    t = graph.linearized(v.steps(), v.nodes()).groupBy("path").agg(F.sum("len").alias("total"))
    a, b = F.least(F.lit(5), F.col("total")), F.col("total") - F.floor(F.col("total") / 3)
    back = F.col("path") % 2 == 1
    return t.select("path", F.when(back, "-").otherwise("+").alias("strand"), F.when(back, F.col("total") - b).otherwise(a).cast("long").alias("ref_start"), F.when(back, F.col("total") - a).otherwise(b).cast("long").alias("ref_end"))


@query(f"{_LIN} SELECT path, min(coord + len / 4.0) AS ci, max(coord + len * 3 / 4.0) AS ce FROM (SELECT path, CASE WHEN rev THEN coord + len / 2.0 ELSE CAST(coord AS DOUBLE) END AS coord, len FROM lin) GROUP BY path", "steps nodes")
def canonical_interval(v):
    lin = graph.linearized(v.steps(), v.nodes())
    at = F.when(F.col("rev"), F.col("coord") + F.col("len") / 2.0).otherwise(F.col("coord").cast("double"))
    return lin.groupBy("path").agg(F.min(at + F.col("len") / 4.0).alias("ci"), F.max(at + F.col("len") * 3 / 4.0).alias("ce"))


@query(f"{_DIR}, w AS (SELECT path, list(node_id ORDER BY step) AS walk, count(*) AS n FROM dir GROUP BY path) SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY walk ORDER BY n DESC, path) AS r FROM w) WHERE r = 1", "steps")
def walk_dedup(v):
    w = graph.directed(v.steps()).groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "node_id"))), lambda x: x["node_id"]).alias("walk"), F.count("*").alias("n"))
    return w.groupBy("walk").agg(F.min("path").alias("path")).select("path")


@query(f"{_EDGE}, votes AS (SELECT d.path % 50 AS grp, d.node_id, count(*) AS n FROM dir d GROUP BY 1, 2) SELECT grp, node_id, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, node_id) AS r FROM votes) WHERE r = 1", "steps")
def path_vote(v):
    votes = graph.directed(v.steps()).groupBy((F.col("path") % 50).alias("grp"), "node_id").agg(F.count("*").alias("n"))
    best = votes.groupBy("grp").agg(F.max_by(F.struct("node_id", "n"), F.struct("n", -F.col("node_id"))).alias("b"))
    return best.select("grp", "b.node_id", "b.n")


@query("""SELECT ord, len, 'a' AS graph FROM nodes UNION ALL SELECT ord + (SELECT max(ord) + 1 FROM nodes), len, 'b' FROM nodes""", "nodes")
def concat_graphs(v):
    a = v.nodes().select("ord", "len")
    top = a.agg((F.max("ord") + 1).alias("top"))  # one row
    b = a.crossJoin(F.broadcast(top)).select((F.col("ord") + F.col("top")).alias("ord"), "len")
    return a.withColumn("graph", F.lit("a")).unionByName(b.withColumn("graph", F.lit("b")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(list_sum(list_transform(regexp_extract_all(c, '(\\d+)[M=X]', 1), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS overlap FROM
(SELECT *, l_linenumber || 'M' || (l_suppkey % 9) || 'D' || CAST(l_quantity AS BIGINT) || '=' || (l_partkey % 5) || 'X' AS c FROM lineitem)""")
def cigar_overlap(v):
    from helixweave.sources.gfa import overlap

    c = F.concat(F.col("l_linenumber").cast("string"), F.lit("M"), (F.col("l_suppkey") % 9).cast("string"), F.lit("D"), F.col("l_quantity").cast("long").cast("string"), F.lit("="), (F.col("l_partkey") % 5).cast("string"), F.lit("X"))
    return v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", overlap(c).alias("overlap"))


@query(f"{_Q}, {_DECIDED} SELECT 'read' || read || chr(9) || CASE WHEN decision = 'U' THEN '*' ELSE 'order' || chain END || chr(9) || mapq || chr(9) || 'dc:A:' || decision AS line FROM decided", "chains")
def gaf_columns(v):
    from helixweave.sinks.gaf import short_line

    return decide.decided(decide.standout(decide.with_mapq(decide.ranked(v.chains())))).select(short_line().alias("line"))


# ---- evaluation --------------------------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT quality = 1 AS truth, n_chars > 200 AS pred FROM labels JOIN documents USING (doc_id))"
_DIV = "CASE WHEN {1} > 0 THEN {0} / ({1}) ELSE 0.0 END"


def _truth(v):
    return v.table("labels").join(v.table("documents"), "doc_id").select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 200).alias("pred"))


@query(f"""{_PAIRS}, c AS (SELECT count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn, count(*) FILTER (NOT truth AND NOT pred) AS tn FROM pairs),
m AS (SELECT *, {_DIV.format('tp', 'tp + fp')} AS precision, {_DIV.format('tp', 'tp + fn')} AS recall, {_DIV.format('tn', 'tn + fp')} AS specificity FROM c)
SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round({_DIV.format('2 * precision * recall', 'precision + recall')}, 6) AS f1 FROM m""")
def binary_metrics(v):
    return metrics.binary(_truth(v)).select("tp", "fp", "fn", "tn", *(r6(c, c) for c in ("precision", "recall", "specificity", "f1")))


_CLS = "pairs AS (SELECT label AS truth, list_position(embedding, list_max(embedding)) % 10 AS pred FROM embeddings)"


def _classes(v):
    return v.table("embeddings").select(F.col("label").cast("long").alias("truth"), (F.array_position("embedding", F.array_max("embedding")) % 10).alias("pred"))


@query(f"{_CLS} SELECT CAST(truth AS BIGINT) AS truth, CAST(pred AS BIGINT) AS pred, count(*) AS n FROM pairs GROUP BY 1, 2")
def confusion_matrix(v):
    return metrics.confusion(_classes(v))


_PRF = f"""{_CLS}, k AS (SELECT DISTINCT truth AS cls FROM pairs UNION SELECT pred FROM pairs), c AS (SELECT cls, (SELECT count(*) FROM pairs WHERE truth = cls AND pred = cls) AS tp,
(SELECT count(*) FROM pairs WHERE truth <> cls AND pred = cls) AS fp, (SELECT count(*) FROM pairs WHERE truth = cls AND pred <> cls) AS fn FROM k),
m AS (SELECT *, {_DIV.format('tp', 'tp + fp')} AS precision, {_DIV.format('tp', 'tp + fn')} AS recall FROM c), prf AS (SELECT *, {_DIV.format('2 * precision * recall', 'precision + recall')} AS f1 FROM m)"""


@query(f"{_PRF} SELECT CAST(cls AS BIGINT) AS cls, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf")
def class_prf(v):
    return metrics.by_class(_classes(v)).select("cls", "tp", "fp", "fn", *(r6(c, c) for c in ("precision", "recall", "f1")))


@query(f"{_PRF} SELECT round(avg(f1), 6) AS macro_f1, count(*) AS classes FROM prf")
def macro_f1(v):
    return metrics.by_class(_classes(v)).agg(r6(F.avg("f1"), "macro_f1"), F.count("*").alias("classes"))


@query(f"{_Q}, {_DECIDED} SELECT n_chains, count(*) AS total, count(*) FILTER (decision <> 'U') AS mapped, round(count(*) FILTER (decision <> 'U') / count(*), 6) AS recall FROM decided GROUP BY n_chains", "chains")
def recall_grid(v):
    d = decide.decided(decide.standout(decide.with_mapq(decide.ranked(v.chains()))))
    mapped = F.count_if(F.col("decision") != "U")
    return d.groupBy("n_chains").agg(F.count("*").alias("total"), mapped.alias("mapped"), r6(mapped / F.count("*"), "recall"))


@query("""r AS (SELECT o_orderkey AS read, CAST(o_totalprice AS BIGINT) % 1000 AS ts, CAST(o_totalprice AS BIGINT) % 700 AS ps, o_orderstatus FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice, o_orderstatus FROM orders))
SELECT o_orderstatus, count(*) FILTER (least(ts + 200, ps + 200) - greatest(ts, ps) > 0) AS correct, count(*) AS total, count(*) FILTER (least(ts + 200, ps + 200) - greatest(ts, ps) > 0) * 100 // count(*) AS accuracy FROM r GROUP BY 1""")
def position_accuracy(v):
    p = F.floor("o_totalprice")
    r = v.table("orders").select("o_orderstatus", (p % 1000).alias("ts"), (p % 700).alias("ps"))
    hit = F.count_if(F.least(F.col("ts") + 200, F.col("ps") + 200) - F.greatest("ts", "ps") > 0)
    return r.groupBy("o_orderstatus").agg(hit.alias("correct"), F.count("*").alias("total"), F.floor(hit * 100 / F.count("*")).alias("accuracy"))


@query("SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') THEN 'brass' WHEN contains(p_type, 'STEEL') THEN 'steel' WHEN contains(p_type, 'TIN') THEN 'tin' ELSE 'other' END AS cls FROM part")
def class_rules(v):
    t = F.col("p_type")
    return v.table("part").select("p_partkey", F.when(t.contains("BRASS"), "brass").when(t.contains("STEEL"), "steel").when(t.contains("TIN"), "tin").otherwise("other").alias("cls"))


# ---- entry points ------------------------------------------------------------------------------------------------

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["flagship_map_passages"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# registers its queries here
from helixweave import catalog_chains  # noqa: E402, F401
