"""More named queries: events, anchors, chains, decisions, records, stored indexes and layouts."""

from __future__ import annotations

import dataclasses
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixweave.catalog import _ANCHORS, _DECIDED, _FILT, _INDEX, _ITEM_MIN, _LIN, _MAPQ, _Q, _RANKED, _SCORE, _BAND, _hash, query, r6
from helixweave.functions import signal as sigfn
from helixweave.functions.bits import base_code, with_hash
from helixweave.operators import adaptive, chaining, decide, events, graph, index, seeds
from helixweave.operators import anchors as anc
from helixweave.operators import signal as sig
from helixweave.plans import mapping
from helixweave.sinks import gaf, records
from helixweave.sources import gfa, index_store, reads
from helixweave.store import fresh_folder

# ---- events ------------------------------------------------------------------------------------------------------

_T = f"""{_FILT}, w AS (SELECT read, idx, pa, avg(pa) OVER l3 AS a1, avg(pa) OVER r3 AS a2, avg(pa * pa) OVER l3 AS a3, avg(pa * pa) OVER r3 AS a4, count(*) OVER l3 AS an, count(*) OVER r3 AS am,
avg(pa) OVER l9 AS b1, avg(pa) OVER r9 AS b2, avg(pa * pa) OVER l9 AS b3, avg(pa * pa) OVER r9 AS b4, count(*) OVER l9 AS bn, count(*) OVER r9 AS bm FROM filt
WINDOW l3 AS (PARTITION BY read ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r3 AS (PARTITION BY read ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING),
l9 AS (PARTITION BY read ORDER BY idx ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING), r9 AS (PARTITION BY read ORDER BY idx ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)),
t AS (SELECT read, count(*) AS n, list(pa ORDER BY idx) AS vals, list(CASE WHEN an = 3 AND am = 3 THEN abs(a2 - a1) / sqrt(greatest((a3 - a1 * a1 + a4 - a2 * a2) / 3, 1.17549435e-38)) ELSE 0.0 END ORDER BY idx) AS a,
list(CASE WHEN bn = 9 AND bm = 9 THEN abs(b2 - b1) / sqrt(greatest((b3 - b1 * b1 + b4 - b2 * b2) / 9, 1.17549435e-38)) ELSE 0.0 END ORDER BY idx) AS b FROM w GROUP BY read)"""
_DET = f"""{_T}, det(read, n, vals, a, b, i, sp, sv, sk, lp, lv, lk, lu, out) AS (
SELECT read, n, vals, a, b, CAST(1 AS BIGINT), CAST(-1 AS BIGINT), CAST('inf' AS DOUBLE), FALSE, CAST(-1 AS BIGINT), CAST('inf' AS DOUBLE), FALSE, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM t
UNION ALL
SELECT read, n, vals, a, b, i + 1, CASE WHEN e1 THEN -1 ELSE p1 END, CASE WHEN e1 THEN x ELSE v1 END, k1 AND NOT e1, CASE WHEN skip THEN p0 WHEN e2 THEN -1 ELSE p2 END, CASE WHEN skip THEN v0 WHEN e2 THEN y ELSE v2 END,
  CASE WHEN skip THEN k0 ELSE k2 AND NOT e2 END, u, list_concat(list_concat(out, CASE WHEN e1 THEN [p1] ELSE [] END), CASE WHEN e2 AND NOT skip THEN [p2] ELSE [] END)
FROM (SELECT *, lon AND k2 AND i - p2 > 4 AS e2 FROM (SELECT *, k0 OR (lon AND v2 > 3.5 AND v2 - y > 0.4) AS k2 FROM (
SELECT *, p0 >= 0 AS lon, CASE WHEN lrise THEN i ELSE p0 END AS p2, CASE WHEN lrise THEN y WHEN p0 < 0 THEN least(v0, y) ELSE v0 END AS v2 FROM (
SELECT *, u >= i AS skip, CASE WHEN p0 < 0 THEN y - v0 > 0.4 ELSE y > v0 END AS lrise FROM (
SELECT *, CASE WHEN hi THEN p1 + 3 ELSE lu END AS u, CASE WHEN hi THEN -1 ELSE lp END AS p0, CASE WHEN hi THEN CAST('inf' AS DOUBLE) ELSE lv END AS v0, lk AND NOT hi AS k0, son AND k1 AND i - p1 > 1 AS e1 FROM (
SELECT *, sk OR (hi AND v1 - x > 0.4) AS k1 FROM (SELECT *, son AND v1 > 4.0 AS hi FROM (
SELECT *, sp >= 0 AS son, CASE WHEN rise THEN i ELSE sp END AS p1, CASE WHEN rise THEN x WHEN sp < 0 THEN least(sv, x) ELSE sv END AS v1 FROM (
SELECT *, CASE WHEN sp < 0 THEN x - sv > 0.4 ELSE x > sv END AS rise FROM (SELECT *, a[i + 1] AS x, b[i + 1] AS y FROM det WHERE i < n))))))))))
), found AS (SELECT read, vals, out FROM det WHERE i = n)"""


@query(f"{_DET} SELECT read, k - 1 AS ord, out[k] AS peak FROM (SELECT read, out, unnest(range(1, len(out) + 1)) AS k FROM found)", "samples")
def event_peaks(v):
    return events.event_peaks(sig.filtered(v.samples()))


@query(f"""{_DET}, seg AS (SELECT read, k - 1 AS ord, CASE WHEN k = 1 THEN 0 ELSE out[k - 1] END AS a, out[k] AS b, vals FROM (SELECT read, vals, out, unnest(range(1, len(out) + 1)) AS k FROM found)),
srt AS (SELECT *, list_sort(CASE WHEN b > a THEN vals[a + 1:b] ELSE [] END) AS x FROM seg WHERE b - a < 500), q AS (SELECT *, x[len(x) // 4 + 1] AS q1, x[len(x) * 3 // 4 + 1] AS q3 FROM srt)
SELECT read, ord, CAST(a AS BIGINT) AS start, b AS "end", CASE WHEN len(x) = 0 THEN 0.0 ELSE round(list_avg(list_filter(x, lambda v: v >= 2 * q1 - q3 AND v <= 2 * q3 - q1)), 6) END AS mean FROM q""", "samples")
def event_segments(v):
    return events.events(sig.filtered(v.samples())).withColumn("mean", r6("mean"))


# ---- anchors -----------------------------------------------------------------------------------------------------

_HITS = "hits AS (SELECT l_orderkey AS read, l_partkey AS node, l_suppkey % 5 AS \"offset\", l_linenumber * 10 AS q, 3 + l_suppkey % 4 AS span FROM lineitem)"


def _hits(v):
    key = F.col("l_suppkey")
    return v.table("lineitem").select(F.col("l_orderkey").alias("read"), F.col("l_partkey").alias("node"), (key % 5).alias("offset"), (F.col("l_linenumber").cast("long") * 10).alias("q"), (3 + key % 4).alias("span"))


@query(f"""{_LIN}, tot AS (SELECT path, CASE WHEN sum(len) >= 30 THEN sum(len) ELSE 0 END AS length FROM lin GROUP BY path), {_HITS}
SELECT h.read, lin.path, CAST(coord + h."offset" AS BIGINT) AS ref, CAST(q AS BIGINT) AS q, span FROM hits h JOIN lin ON lin.node = h.node JOIN tot ON tot.path = lin.path WHERE coord + h."offset" + span <= length""", "steps nodes")
def anchor_expand(v):
    lin = graph.linearized(v.steps(), v.nodes())
    return anc.expanded(_hits(v), lin, graph.path_lengths(lin, 30))


@query("""h AS (SELECT user_id AS read, CAST(floor(value) AS BIGINT) // 50 AS node, list({'o': o, 'q': q, 's': CAST(10 AS BIGINT), 'l': CAST(10 AS BIGINT)} ORDER BY o, q) AS h FROM (SELECT *, CAST(floor(value) AS BIGINT) % 50 AS o, event_id % 100 AS q FROM events) GROUP BY 1, 2),
f(read, node, h, i, cur, out) AS (SELECT read, node, h, CAST(1 AS BIGINT), h[1], h[1:0] FROM h UNION ALL
SELECT read, node, h, i + 1, CASE WHEN ok THEN {'o': cur.o, 'q': least(cur.q, x.q), 's': least(greatest(cur.q + cur.s, x.q + x.s) - least(cur.q, x.q), 65535), 'l': least(greatest(cur.o + cur.l, x.o + x.l) - cur.o, 65535)} ELSE x END, CASE WHEN ok THEN out ELSE list_append(out, cur) END
FROM (SELECT *, greatest(x.q - (cur.q + cur.s), 0) <= 20 AND greatest(x.o - (cur.o + cur.l), 0) <= 20 AS ok FROM (SELECT *, h[i + 1] AS x FROM f WHERE i < len(h))))
SELECT read, node, m.o AS "offset", m.q AS q, m.s AS span, m.l AS length FROM (SELECT read, node, unnest(list_append(out, cur)) AS m FROM f WHERE i = len(h))""")
def seed_merge_tolerance(v):
    at = F.floor("value")
    ten = F.lit(10).cast("long")
    hits = v.table("events").select(F.col("user_id").alias("read"), F.floor(at / 50).alias("node"), (at % 50).alias("offset"), (F.col("event_id") % 100).alias("q"), ten.alias("span"), ten.alias("length"))
    return anc.merged(hits, 20)


@query(f"""{_ANCHORS}, o AS (SELECT DISTINCT read, q, path FROM anchors), nx AS (SELECT *, lead(q) OVER (PARTITION BY read ORDER BY q) AS next_q FROM (SELECT DISTINCT read, q FROM o))
SELECT nx.read, nx.q, next_q, count(*) AS paths FROM nx JOIN o a ON a.read = nx.read AND a.q = nx.q JOIN o b ON b.read = nx.read AND b.q = next_q AND b.path = a.path GROUP BY 1, 2, 3""", "items docs")
def shared_paths(v):
    return anc.shared_paths(mapping.anchors(v.items(), v.docs()))


@query(f"{_ITEM_MIN}, {_INDEX} SELECT read, pos, n FROM imin JOIN freq USING (hash) WHERE n <= 20", "items docs")
def hard_cap(v):
    built = mapping.stored_index(v.docs())
    hits = seeds.minimizers(seeds.base_kmers(v.items(), 12), 3).join(built.counts, "hash")
    return hits.where("n <= 20").select("read", "pos", "n")


@query(f"{_INDEX} SELECT 'base' AS mode, 12 AS k, 3 AS w, (SELECT count(*) FROM freq) AS hashes, (SELECT CAST(sum(n) AS BIGINT) FROM freq) AS entries", "docs")
def index_saved(v):
    built = mapping.stored_index(v.docs())
    n = built.counts.agg(F.count("*").alias("hashes"), F.sum("n").alias("entries"))
    return n.select(F.lit(built.mode).alias("mode"), F.lit(built.k).alias("k"), F.lit(built.w).alias("w"), "hashes", "entries")


# ---- chains ------------------------------------------------------------------------------------------------------

_DR, _DQ = "(rs[i + 1] - rs[j])", "(qs[i + 1] - qs[j])"
_NEAR, _LINK = _BAND.replace("dr", _DR).replace("dq", _DQ), _SCORE.replace("dr", _DR).replace("dq", _DQ)
#: The exact programme with predecessors: f scores, r roots, c anchors so far, u ancestors of each anchor, itself included.
_TREE = f"""{_ANCHORS}, grp AS (SELECT read, path, count(*) AS n, list(ref ORDER BY ref, q) AS rs, list(q ORDER BY ref, q) AS qs FROM anchors GROUP BY read, path),
tree(read, path, n, rs, qs, i, f, r, c, u) AS (
  SELECT read, path, n, rs, qs, CAST(1 AS BIGINT), [CAST(12 AS BIGINT)], [CAST(1 AS BIGINT)], [CAST(1 AS BIGINT)], [[CAST(1 AS BIGINT)]] FROM grp
  UNION ALL
  SELECT read, path, n, rs, qs, i + 1, list_append(f, greatest(12, best)), list_append(r, CASE WHEN best > 12 THEN r[pz] ELSE i + 1 END), list_append(c, CASE WHEN best > 12 THEN c[pz] + 1 ELSE 1 END), list_append(u, CASE WHEN best > 12 THEN list_append(u[pz], i + 1) ELSE [i + 1] END)
  FROM (SELECT *, list_position(s, best) AS pz FROM (SELECT *, coalesce(list_max(s), 0) AS best FROM (SELECT *, list_transform(range(1, i + 1), lambda j: CASE WHEN {_NEAR} THEN f[j] + {_LINK} ELSE -1000000 END) AS s FROM tree WHERE i < n))))
, ends AS (SELECT read, path, rs, qs, f, r, c, u, unnest(range(1, n + 1)) AS e FROM tree WHERE i = n),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY read, path, r[e] ORDER BY f[e] DESC, e) AS k FROM ends) WHERE k = 1 AND f[e] >= 15 AND c[e] >= 2),
ord AS (SELECT *, row_number() OVER (PARTITION BY read, path ORDER BY f[e] DESC, e) - 1 AS rank, max(f[e]) OVER (PARTITION BY read, path) AS top FROM one),
chains2 AS (SELECT read, path, rank, CAST(f[e] AS DOUBLE) AS score, c[e] AS anchors, qs[r[e]] AS q_start, qs[e] + 12 AS q_end, rs[r[e]] AS ref_start, rs[e] + 12 AS ref_end FROM ord WHERE rank < 10 AND f[e] >= 0.3 * top)"""


def _anchors(v):
    return mapping.anchors(v.items(), v.docs())


def _cfg():
    return chaining.ChainConfig().scaled(12)


@query(f"{_TREE} SELECT read, path, rank, score, anchors, q_start, q_end, ref_start, ref_end FROM chains2", "items docs")
def chain_path(v):
    return chaining.chains(_anchors(v), 12, _cfg())


@query(f"{_TREE}, alive AS (SELECT DISTINCT read, path, unnest(u[e]) AS i, rs, qs FROM ends WHERE f[e] >= 15) SELECT read, path, rs[i] AS ref, qs[i] AS q FROM alive", "items docs")
def survivors(v):
    return chaining.survivors(_anchors(v), 12, _cfg())


@query(f"""{_TREE}, alive AS (SELECT DISTINCT read, qs[i] AS q FROM (SELECT read, qs, unnest(u[e]) AS i FROM ends WHERE f[e] >= 15)) SELECT imin.read, imin.pos AS q, imin.hash FROM imin JOIN alive ON alive.read = imin.read AND alive.q = imin.pos""", "items docs")
def survivor_hits(v):
    hits = seeds.minimizers(seeds.base_kmers(v.items(), 12), 3).withColumnRenamed("pos", "q")
    return chaining.kept_hits(hits, chaining.survivors(_anchors(v), 12, _cfg())).select("read", "q", "hash")


_DEAD = "greatest(abs(dr - dq) - floor(0.05 * least(dr, dq)), 0)"
_LINK2 = f"least(12, least(dr, dq)) - CASE WHEN {_DEAD} > 0 OR least(dr, dq) > 12 THEN CAST(floor({0.8 * 0.01 * 12} * {_DEAD} + 0.5 * log2({_DEAD} + 1.0)) AS BIGINT) ELSE 0 END".replace("dr", _DR).replace("dq", _DQ)


def _layout_tree(sign: str, name: str) -> str:
    """CTEs of the exact programme over anchors on the layout, in one direction; the last is <name>one."""
    grp, tail = _TREE[_TREE.index("grp AS"):].split("chains2 AS")[0].rsplit(",", 1)[0].split("tree(read", 1)
    sql = (grp + "tree(read" + tail).replace("FROM anchors", f"FROM (SELECT read, path % 10 AS path, {sign}(path * 4000 + ref * 2) AS ref, q FROM anchors)").replace(_LINK, _LINK2)
    sql = sql[: sql.index("ord AS")].rstrip().rstrip(",")
    for cte in ("grp", "tree", "ends", "one"):
        sql = re.sub(rf"\b{cte}\b", f"{name}{cte}", sql)
    return sql


_TOP10 = "row_number() OVER (PARTITION BY read, path ORDER BY f[e] DESC, e) <= 10"


@query(f"""{_ANCHORS}, {_layout_tree('', 'x')}, {_layout_tree('-', 'y')}, al AS (SELECT read, path, f[e] AS score, c[e] AS anchors, qs[r[e]] AS q_start, qs[e] + 12 AS q_end, rs[r[e]] AS ref_start, rs[e] AS ref_end, FALSE AS backward FROM xone QUALIFY {_TOP10}
UNION ALL SELECT read, path, f[e], c[e], qs[r[e]], qs[e] + 12, -rs[e], -rs[r[e]], TRUE FROM yone QUALIFY {_TOP10}),
rk AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY score DESC, path, backward, q_start, ref_start) - 1 AS rank FROM al)
SELECT read, path, rank, CAST(score AS DOUBLE) AS score, anchors, q_start, q_end, CAST(ref_start AS DOUBLE) AS ref_start, CAST(ref_end AS DOUBLE) AS ref_end, backward FROM rk WHERE rank < 10""", "items docs")
def chain_sort(v):
    hits = _anchors(v).select("read", F.col("path").alias("node"), F.col("ref").alias("offset"), "q")
    # documents one after another on ten components, at two places for each base
    at = F.col("read") * 4000
    layout = v.docs().select(F.col("read").alias("node"), (F.col("read") % 10).alias("component"), at.cast("double").alias("start"), (at + F.length("seq") * 2).cast("double").alias("end"), F.length("seq").alias("len"))
    return chaining.layout_chains(chaining.on_layout(hits, layout), 12, dataclasses.replace(_cfg(), tolerance=0.05))


_BYREAD = f"""{_TREE}, lens AS (SELECT read, length(seq) AS n FROM items), plens AS (SELECT read AS path, length(seq) AS n FROM docs),
src AS (SELECT c.*, row_number() OVER (PARTITION BY read ORDER BY score DESC, path, q_start, ref_start) AS chain FROM chains2 c),
{_RANKED.format('(SELECT read, chain, score, anchors FROM src)', _MAPQ)}, {_DECIDED},
rec AS (SELECT lens.read, lens.n AS read_len, src.* EXCLUDE (read, rank, chain, score, anchors), quality.chain, quality.score, quality.anchors, quality.rank, quality.mapq, plens.n AS path_len, decided.n_chains, decided.standout, coalesce(decision, 'U') AS decision
  FROM lens LEFT JOIN quality ON quality.read = lens.read LEFT JOIN src ON src.read = quality.read AND src.chain = quality.chain LEFT JOIN plens ON plens.path = src.path LEFT JOIN decided ON decided.read = lens.read)"""


def _chain_records(v):
    return mapping.chain_records(v.items(), v.docs(), prefix="doc")


def _f(x: str, digits: int) -> str:
    """Rounded half up at so many digits, as text."""
    p = 10 ** digits
    n = f"CAST(floor(({x}) * {p} + 0.5) AS BIGINT)"
    return f"({n} // {p} || '.' || lpad(CAST({n} % {p} AS VARCHAR), {digits}, '0'))"


_TAGS = f"chr(9) || 'cs:i:' || CAST(score AS BIGINT) || chr(9) || 'an:i:' || anchors || chr(9) || 'se:f:' || {_f('score / (q_end - q_start)', 3)} || chr(9) || 'ad:f:' || {_f('anchors / (b - a)', 4)}"
_WS = f"chr(9) || 'ws:f:' || {_f('coalesce(standout, 0)', 3)} || chr(9) || 'nc:i:' || coalesce(n_chains, 0) || chr(9) || 'df:A:' || decision || chr(9) || 'ck:i:1'"
_NONE = f"read || chr(9) || read_len || chr(9) || coalesce(CAST(q_start AS VARCHAR), '*') || chr(9) || coalesce(CAST(q_end AS VARCHAR), '*') || repeat(chr(9) || '*', 5) || chr(9) || '0' || chr(9) || '0' || chr(9) || coalesce(mapq, 0)"


@query(f"""{_BYREAD}, cl AS (SELECT *, greatest(ref_start, 0) AS a, least(ref_end, path_len) AS b FROM rec)
SELECT read, rank, read || chr(9) || read_len || chr(9) || q_start || chr(9) || q_end || chr(9) || '+' || chr(9) || '>' || path || chr(9) || path_len || chr(9) || a || chr(9) || b || chr(9) || anchors * 12 || chr(9) || b - a || chr(9) || mapq || chr(9) || 'pn:Z:doc' || path
  || chr(9) || 'tp:A:' || CASE WHEN rank = 0 THEN 'P' ELSE 'S' END || {_TAGS} || CASE WHEN rank = 0 THEN {_WS} ELSE '' END AS value FROM cl WHERE decision <> 'U'
UNION ALL SELECT read, 0, {_NONE} || chr(9) || 'pn:Z:*' || chr(9) || 'tp:A:U' || CASE WHEN q_start IS NULL THEN '' ELSE {_TAGS} END || {_WS} FROM cl WHERE decision = 'U' AND coalesce(rank, 0) = 0""", "items docs")
def gaf_records(v):
    return records.lines_for("out.gaf")(_chain_records(v))


@query(f"""{_BYREAD}, cl AS (SELECT *, greatest(ref_start, 0) AS a, least(ref_end, path_len) AS b FROM rec WHERE coalesce(rank, 0) = 0)
SELECT read, CAST(0 AS BIGINT) AS rank, CASE WHEN decision <> 'U' THEN read || chr(9) || read_len || chr(9) || q_start || chr(9) || q_end || chr(9) || '+' || chr(9) || '*' || chr(9) || path_len || chr(9) || a || chr(9) || b || chr(9) || anchors * 12 || chr(9) || b - a || chr(9) || mapq || {_TAGS} || {_WS}
ELSE read || chr(9) || read_len || repeat(chr(9) || '*', 7) || repeat(chr(9) || '0', 3) || chr(9) || 'tp:A:U' || {_WS} END AS value FROM cl""", "items docs")
def paf_records(v):
    return records.lines_for("out.paf")(_chain_records(v))


@query(f"""{_BYREAD} SELECT CAST(read AS VARCHAR) AS query_name, CAST(read_len AS BIGINT) AS query_len, CASE WHEN decision = 'U' THEN '*' ELSE '>' || path END AS graph_path, CAST(CASE WHEN decision = 'U' THEN NULL ELSE greatest(ref_start, 0) END AS BIGINT) AS path_start,
CAST(coalesce(mapq, 0) AS BIGINT) AS mapq, CASE WHEN decision = 'U' THEN 'U' WHEN rank = 0 THEN 'P' ELSE 'S' END AS tp FROM rec WHERE decision <> 'U' OR coalesce(rank, 0) = 0""", "items docs")
def gaf_roundtrip(v):
    where = fresh_folder(v.spark, "records")
    gaf.write(records.gaf_lines(_chain_records(v)).select("value", (F.col("read") % 2).alias("source_file")), where)
    back = gaf.parsed(v.spark.read.text(where))
    return back.select("query_name", "query_len", "graph_path", "path_start", "mapq", F.col("tags")["tp"].alias("tp"))


@query("""c AS (SELECT read, list({'c': chain, 's': score, 'g': chain % 3, 'a': chain * 37 % 200, 'b': chain * 37 % 200 + 20 + anchors * 5} ORDER BY chain) AS l FROM chains GROUP BY read),
k(read, l, i, kept) AS (SELECT read, l, CAST(1 AS BIGINT), l[1:1] FROM c UNION ALL
SELECT read, l, i + 1, CASE WHEN pz IS NULL OR pz = 0 THEN list_append(kept, x) WHEN x.s > kept[pz].s THEN list_concat(list_append(kept[1:pz - 1], x), kept[pz + 1:]) ELSE kept END
FROM (SELECT *, list_position(list_transform(kept, lambda y: y.g = x.g AND least(y.b, x.b) > greatest(y.a, x.a) AND (least(y.b, x.b) - greatest(y.a, x.a)) / greatest(y.b - y.a, x.b - x.a) >= 0.8), TRUE) AS pz FROM (SELECT *, l[i + 1] AS x FROM k WHERE i < len(l))))
SELECT read, m.c AS chain, m.s AS score FROM (SELECT read, unnest(kept) AS m FROM k WHERE i = len(l))""", "chains")
def interval_dedup(v):
    start = (F.col("chain") * 37 % 200).cast("double")
    rows = v.chains().select("read", "chain", "score", (F.col("chain") % 3).alias("component"), start.alias("start"), (start + 20 + F.col("anchors") * 5).alias("end"))
    return anc.distinct_intervals(rows)


# ---- decisions ---------------------------------------------------------------------------------------------------

@query(f"""pre AS (SELECT read * 10 + k AS read, chain, score, anchors FROM chains, range(1, 5) r(k) WHERE chain % 4 < k), {_RANKED.format('pre', _MAPQ)}, {_DECIDED},
d AS (SELECT read // 10 AS read, read % 10 AS chunk, decision, score FROM decided), f AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY decision = 'U', CASE WHEN decision = 'U' THEN -chunk ELSE chunk END) AS k FROM d)
SELECT read, chunk, decision, score FROM f WHERE k = 1""", "chains")
def early_exit(v):
    chunk = F.explode(F.array(*(F.lit(k).cast("long") for k in range(1, 5)))).alias("chunk")
    return adaptive.decided_by_chunk(v.chains().select("*", chunk).where("chain % 4 < chunk"))


@query(f"""{_Q}, {_DECIDED}, o AS (SELECT read % 3 AS source, n_chains AS depth, list({{'r': read, 'n': n_chains, 's': score, 'd': decision}} ORDER BY read) AS l FROM decided GROUP BY 1, 2),
e(source, depth, l, i, mean, out) AS (SELECT source, depth, l, CAST(0 AS BIGINT), CAST(100.0 AS DOUBLE), [{{'r': l[1].r, 'd': 'U', 't': CAST(100.0 AS DOUBLE)}}][1:0] FROM o UNION ALL
SELECT source, depth, l, i + 1, CASE WHEN x.n > 1 AND x.d = 'S' THEN CAST(0.02 AS DOUBLE) * x.s + (CAST(1.0 AS DOUBLE) - CAST(0.02 AS DOUBLE)) * mean ELSE mean END, list_append(out, {{'r': x.r, 'd': CASE WHEN x.n <= 1 OR x.d = 'S' THEN x.d WHEN x.s >= greatest(mean, 100.0) THEN 'F' ELSE 'U' END, 't': greatest(mean, CAST(100.0 AS DOUBLE))}})
FROM (SELECT *, l[i + 1] AS x FROM e WHERE i < len(l)))
SELECT source, CAST(depth AS BIGINT) AS depth, m.r AS read, m.d AS decision, round(m.t, 6) AS threshold FROM (SELECT source, depth, unnest(out) AS m FROM e WHERE i = len(l))""", "chains")
def ema_fallback(v):
    best = decide.decided(decide.standout(decide.with_mapq(decide.ranked(v.chains()))))
    rows = best.withColumns({"source": F.col("read") % 3, "depth": F.col("n_chains")})
    return adaptive.with_learned_fallback(rows).withColumn("threshold", r6("threshold"))


@query(f"""{_Q}, {_DECIDED} SELECT c_nationkey AS cls, count(*) AS truths, count(*) FILTER (decision <> 'U') AS mapped, count(*) FILTER (coalesce(decision, 'U') = 'U') AS unmapped, count(*) FILTER (decision IS NULL) AS missing,
count(DISTINCT CASE WHEN decision <> 'U' THEN c_custkey END) AS kept_reads, round(count(*) FILTER (decision <> 'U') / count(*), 6) AS fraction FROM customer LEFT JOIN decided ON read = c_custkey GROUP BY 1""", "chains")
def truth_join(v):
    best = decide.decided(decide.standout(decide.with_mapq(decide.ranked(v.chains())))).select(F.col("read").alias("c_custkey"), "decision")
    rows = v.table("customer").join(best, "c_custkey", "left")
    mapped = F.count_if(F.coalesce("decision", F.lit("U")) != "U")
    return rows.groupBy(F.col("c_nationkey").alias("cls")).agg(F.count("*").alias("truths"), mapped.alias("mapped"), F.count_if(F.coalesce("decision", F.lit("U")) == "U").alias("unmapped"), F.count_if(F.col("decision").isNull()).alias("missing"),
                                                               F.countDistinct(F.when(F.col("decision") != "U", F.col("c_custkey"))).alias("kept_reads"), r6(mapped / F.count("*"), "fraction"))


@query(f"{_Q}, {_DECIDED} SELECT c_custkey AS read FROM customer WHERE c_custkey NOT IN (SELECT read FROM decided)", "chains")
def unseen_reads(v):
    seen = v.chains().select(F.col("read").alias("c_custkey"))
    return v.table("customer").join(seen, "c_custkey", "left_anti").select(F.col("c_custkey").alias("read"))


# ---- graphs and layouts ------------------------------------------------------------------------------------------

_PLINK = "pl AS (SELECT DISTINCT node AS u, coalesce(lead(node) OVER (PARTITION BY path ORDER BY step), node) AS v FROM steps2)"
_STEPS2 = "steps2 AS (SELECT o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step, o_orderkey * 2 + o_custkey % 2 AS node FROM orders)"


def _order_steps(v):
    """A customer's orders as a walk: paths that share no node."""
    step = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    return v.table("orders").select(F.col("o_custkey").alias("path"), step.alias("step"), (F.col("o_orderkey") * 2 + F.col("o_custkey") % 2).alias("node"))


@query(f"{_STEPS2}, lab AS (SELECT node, min(node) OVER (PARTITION BY path) AS label FROM steps2) SELECT node, label FROM lab")
def path_components(v):
    return graph.components(graph.path_links(_order_steps(v)))


@query(f"{_STEPS2}, lab AS (SELECT node, min(node) OVER (PARTITION BY path) AS label, CAST(node * 3 AS DOUBLE) AS x FROM steps2) SELECT node, label, x - min(x) OVER (PARTITION BY label) AS x FROM lab")
def component_zero_base(v):
    steps = _order_steps(v)
    layout = steps.select("node", (F.col("node") * 3).cast("double").alias("x"))
    return graph.zero_based(layout, graph.components(graph.path_links(steps)))


@query("SELECT ord AS node, CAST(coalesce(sum(len) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS x FROM nodes", "nodes")
def layout_by_order(v):
    return graph.initial_layout(v.nodes())


@query(f"{_LIN} SELECT node, CAST(coord AS DOUBLE) AS x FROM (SELECT node, coord, row_number() OVER (PARTITION BY node ORDER BY path, step) AS k FROM lin) WHERE k = 1", "steps nodes")
def layout_by_path(v):
    return graph.initial_layout(v.nodes(), lin=graph.linearized(v.steps(), v.nodes()))


@query("SELECT range AS round, round(1000.0 * exp(-ln(100000.0) / 29 * abs(range - 5)), 6) AS rate FROM range(30)")
def layout_rates(v):
    return graph.learning_rates(v.spark, 30, 1000.0, 0.01, 5).withColumn("rate", r6("rate"))


@query(f"{_LIN} SELECT path, row_number() OVER (PARTITION BY path ORDER BY coord, step) - 1 AS rank, node, coord FROM lin WHERE NOT rev", "steps nodes")
def layout_samples(v):
    return graph.sampling_index(graph.linearized(v.steps(), v.nodes()))


@query("SELECT ord AS node, CAST(ord * 100 AS DOUBLE) AS start, CAST(ord * 100 + len AS DOUBLE) AS \"end\" FROM nodes", "nodes")
def coordinates_roundtrip(v):
    where = fresh_folder(v.spark, "coordinates")
    layout = v.nodes().select(F.col("ord").alias("node"), (F.col("ord") * 100).cast("double").alias("start"), "len")
    reads.coordinate_lines(layout).write.option("sep", "\t").option("header", "true").csv(where)
    return reads.coordinates(v.spark, where)


@query("SELECT path AS name, step, CAST(node AS VARCHAR) AS segment_id, rev AS is_rev FROM steps", "steps")
def gfa_roundtrip(v):
    """Segments and walks written as GFA and read again."""
    where = fresh_folder(v.spark, "graph")
    segs = v.nodes().select(F.col("ord"), F.col("ord").cast("string").alias("id"), F.col("seq").alias("sequence"))
    steps = v.steps().select(F.col("path").cast("string").alias("name"), F.col("step").cast("int").alias("step_idx"), F.col("node").cast("string").alias("segment_id"), F.col("rev").alias("is_rev"))
    no_links = v.spark.createDataFrame([], "from string, from_rev boolean, to string, to_rev boolean, overlap_bases long")
    gfa.gfa_lines(segs, no_links).unionByName(gfa.path_lines(steps)).write.text(f"{where}/g.gfa")
    back = gfa.load(v.spark, f"{where}/g.gfa")["steps"]
    return back.select(F.col("name").cast("long").alias("name"), F.col("step_idx").cast("long").alias("step"), "segment_id", "is_rev")


@query("SELECT read AS id, seq AS sequence, 1 AS paths FROM items", "items")
def sequences_as_graph(v):
    """Each sequence as a graph of one segment and one path, written and read again."""
    where = fresh_folder(v.spark, "sequences")
    gfa.from_sequences(v.items().select(F.col("read").cast("string").alias("read_id"), F.col("seq").alias("sequence"))).write.text(f"{where}/s.gfa")
    back = gfa.load(v.spark, f"{where}/s.gfa")
    n = back["steps"].groupBy(F.col("name").alias("id")).agg(F.count("*").cast("int").alias("paths"))
    return back["segments"].join(n, "id").select(F.col("id").cast("long").alias("id"), "sequence", "paths")


# ---- an index of signals -----------------------------------------------------------------------------------------

_SIG = """pts AS (SELECT path, pos, least(3.0, greatest(-3.0, ((code * 37) % 101 - 50) / 17.0)) AS c, (-2.0 + 3.0) / 6.0 AS a, (2.0 + 3.0) / 6.0 AS b FROM (SELECT path, p - 1 AS pos, (instr('ACGT', substr(seq, p, 1)) - 1) * 16 + (instr('ACGT', substr(seq, p + 1, 1)) - 1) * 4 + instr('ACGT', substr(seq, p + 2, 1)) - 1 AS code
FROM (SELECT path, seq, unnest(range(1, length(seq) - 1)) AS p FROM seqs))), tk AS (SELECT path, pos, CASE WHEN c >= -2 AND c <= 2 THEN floor(0.4 * ((c + 3.0) / 6.0 - a) / (b - a) * 15) WHEN (c + 3.0) / 6.0 < 0.5 THEN floor((0.4 + 0.3 * ((c + 3.0) / 6.0)) * 15) ELSE floor((0.4 + 0.3 + 0.3 * ((c + 3.0) / 6.0)) * 15) END AS token FROM pts),
tl AS (SELECT path, list(CAST(token AS BIGINT) ORDER BY pos) AS t FROM tk GROUP BY path), h0 AS (SELECT path, idx, t[idx + 1] * 4096 + t[idx + 2] * 256 + t[idx + 3] * 16 + t[idx + 4] AS code FROM (SELECT path, t, unnest(range(0, len(t) - 3)) AS idx FROM tl))"""


@query(f"""known AS (SELECT path, step, CASE WHEN rev THEN replace(replace(replace(replace(reverse(seq), 'A', 't'), 'C', 'g'), 'G', 'c'), 'T', 'a').upper() ELSE seq END AS s FROM steps JOIN nodes ON node = ord),
seqs AS (SELECT path, string_agg(s, '' ORDER BY step) AS seq FROM known GROUP BY path), {_SIG}, {_hash('h0', 32)} SELECT hash, count(*) AS n FROM h4 GROUP BY hash""", "steps nodes")
def signal_index(v):
    """Paths as levels, tokens, seeds and a stored index: how often each hash occurs."""
    seqs = graph.path_sequences(v.steps(), v.nodes()).where(F.length("seq") >= 6)
    # a seed is four neighbouring tokens of three bases each: of six bases, so each of the 4^6 is worked out once
    digit = lambda k: F.substring(F.lit("ACGT"), F.pmod(F.shiftright("id", 2 * k), F.lit(4)).cast("int") + 1, F.lit(1))
    six = v.spark.range(4**6).select(F.concat(*[digit(k) for k in reversed(range(6))]).alias("bases"))
    # levels of a made-up pore model
    token = lambda k: sigfn.adaptive_token(((base_code(F.substring("bases", k, 3)) * 37) % 101 - 50).cast("double") / 17.0)
    code = token(1) * 4096 + token(2) * 256 + token(3) * 16 + token(4)
    known = with_hash(six.select("bases", code.alias("code")), "code", 32).select("bases", "hash")
    at = seqs.select(F.col("path").alias("node"), "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 5)).alias("p"))
    at = at.select("node", (F.col("p") - 1).cast("long").alias("offset"), F.substring(F.col("seq"), F.col("p"), F.lit(6)).alias("bases"))
    found = at.join(F.broadcast(known), "bases")
    where = fresh_folder(v.spark, "index")
    index_store.save(found.select("hash", "node", "offset"), where, "signal", 4, 1, 4, unique=True)
    return index_store.Index(v.spark, where, "signal").counts
