"""The catalogue's queries in DuckDB SQL, written independently of the DataFrame code."""

from __future__ import annotations

from .inputs import ARCS, HITS, INNER_SUBS, LENGTHS, LOOSE_ARCS, READS, SEEDS, SUBS, WIDE_SEEDS, for_duckdb

K, W = 15, 5
_F32 = "CAST(CAST(0.001 AS FLOAT) AS DOUBLE)"


def _minimizers() -> str:
    """CTEs that end in minis(read_id, pos, strand, hash)."""
    lag = lambda j: f"lag(code, {j}) OVER w" if j else "code"
    forward = " + ".join(f"{lag(j)} * {4**j}" for j in range(K))
    backward = " + ".join(f"(3 - {lag(j)}) * {4 ** (K - 1 - j)}" for j in range(K))
    m = 4**K - 1
    return f"""reads AS ({READS}),
bases AS (SELECT read_id, unnest(range(length(seq))) AS p, unnest(string_split(seq, '')) AS b FROM reads WHERE length(seq) > 0),
codes AS (SELECT read_id, p, CASE b WHEN 'a' THEN 0 WHEN 'c' THEN 1 WHEN 'g' THEN 2 WHEN 't' THEN 3 WHEN 'u' THEN 3 ELSE 4 END::BIGINT AS code FROM bases),
kmers AS (SELECT read_id, p, {forward} AS f, {backward} AS r, max(code) OVER (PARTITION BY read_id ORDER BY p ROWS {K - 1} PRECEDING) AS worst FROM codes WINDOW w AS (PARTITION BY read_id ORDER BY p)),
whole AS (SELECT read_id, p, CASE WHEN f < r THEN 0 ELSE 1 END AS strand, least(f, r) AS x FROM kmers WHERE p >= {K - 1} AND worst < 4 AND f <> r),
h1 AS (SELECT read_id, p, strand, ((~x) + (x << 21)) & {m} AS x FROM whole), h2 AS (SELECT read_id, p, strand, xor(x, x >> 24) AS x FROM h1),
h3 AS (SELECT read_id, p, strand, (x * 265) & {m} AS x FROM h2), h4 AS (SELECT read_id, p, strand, xor(x, x >> 14) AS x FROM h3),
h5 AS (SELECT read_id, p, strand, (x * 21) & {m} AS x FROM h4), h6 AS (SELECT read_id, p, strand, xor(x, x >> 28) AS x FROM h5),
h7 AS (SELECT read_id, p, strand, (x + (x << 31)) & {m} AS x FROM h6),
win AS (SELECT read_id, p, strand, x, CASE WHEN count(*) OVER back = {W} THEN min(x) OVER back END AS low FROM h7 WINDOW back AS (PARTITION BY read_id ORDER BY p RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW)),
best AS (SELECT read_id, p, strand, x, max(low) OVER (PARTITION BY read_id ORDER BY p RANGE BETWEEN CURRENT ROW AND {W - 1} FOLLOWING) AS top FROM win),
minis AS (SELECT read_id, p::INT AS pos, strand::INT AS strand, x AS hash FROM best WHERE x = top)"""


def _h32(x: str) -> str:
    step = lambda y: f"((xor({y} >> 16, {y}) * 73244475) & 4294967295)"
    a = step(step(f"({x} & 4294967295)"))
    return f"xor({a} >> 16, {a})"


_CAP = f"""occ AS (SELECT hash, count(*) AS occ FROM minis GROUP BY hash),
ranked AS (SELECT occ, row_number() OVER (ORDER BY occ) - 1 AS i, count(*) OVER () AS n FROM occ),
cap AS (SELECT least(min(occ) + 1, 65535, 2048)::BIGINT AS max_occ FROM ranked WHERE i = CAST(floor((1.0::DOUBLE - {_F32}) * n) AS BIGINT))"""

_SEED_JOIN = f"""{_CAP},
q AS (SELECT hash, read_id AS qid, pos AS qpos, strand AS qs, (row_number() OVER (PARTITION BY read_id ORDER BY pos, hash) - 1)::INT AS j FROM minis),
t AS (SELECT m.hash, read_id AS tid, pos AS rpos, strand AS ts FROM minis m JOIN occ USING (hash), cap WHERE occ = 1 OR occ <= max_occ),
seeds AS (SELECT qid, tid, qs <> ts AS rev, (CASE WHEN qs = ts THEN 2147483648 + rpos - qpos ELSE rpos + qpos END)::BIGINT AS diag, j, qpos, rpos FROM q JOIN t USING (hash)
WHERE NOT (qid = tid AND qpos = rpos) AND {_h32('qid')} >= {_h32('tid')})"""


def _class(hits: str, lengths: str, hang: int, fraction: float, least: int, where: str = "true") -> str:
    """A query with the hit's columns, ql, tl, class, u, v, l, ol."""
    return f"""SELECT qid, qs, qe, tid, ts, te, rev, ml, bl, ql, tl, class,
CASE WHEN class = 'ARC' THEN qid * 2 + (CASE WHEN qs > t5 THEN 0 ELSE 1 END) END::BIGINT AS u,
CASE WHEN class = 'ARC' THEN tid * 2 + (CASE WHEN (qs > t5) = rev THEN 1 ELSE 0 END) END::BIGINT AS v,
CASE WHEN class = 'ARC' THEN CASE WHEN qs > t5 THEN qs - t5 ELSE ql - qe - t3 END END::INT AS l,
CASE WHEN class = 'ARC' THEN ql - CASE WHEN qs > t5 THEN qs - t5 ELSE ql - qe - t3 END END::INT AS ol FROM (
SELECT *, CASE WHEN e5 > {hang} OR e3 > {hang} OR (qe - qs)::FLOAT < (qe - qs + e5 + e3)::FLOAT * {fraction}::FLOAT THEN 'INT'
WHEN qs <= t5 AND ql - qe <= t3 THEN 'QCONT' WHEN qs >= t5 AND ql - qe >= t3 THEN 'TCONT'
WHEN qe - qs + e5 + e3 < {least} OR te - ts + e5 + e3 < {least} THEN 'SHORT' ELSE 'ARC' END AS class FROM (
SELECT *, least(qs, t5) AS e5, least(ql - qe, t3) AS e3 FROM (
SELECT h.*, a.len AS ql, b.len AS tl, CASE WHEN rev THEN b.len - te ELSE ts END AS t5, CASE WHEN rev THEN ts ELSE b.len - te END AS t3
FROM ({hits}) h JOIN ({lengths}) a ON a.read_id = qid JOIN ({lengths}) b ON b.read_id = tid WHERE {where})))"""


def _depth(clip: int) -> str:
    return f"""WITH hits AS ({HITS}), good AS (SELECT qid, qs + {clip} AS s, qe - {clip} AS e FROM hits WHERE qid <> tid AND ml >= bl * 0.05::FLOAT AND qe - {clip} > qs + {clip}),
ev AS (SELECT qid, s AS pos, 0 AS k, 1 AS d FROM good UNION ALL SELECT qid, e, 1, -1 FROM good),
run AS (SELECT qid, pos, k, sum(d) OVER (PARTITION BY qid ORDER BY pos, k, d ROWS UNBOUNDED PRECEDING) AS dp, row_number() OVER (PARTITION BY qid ORDER BY pos, k, d) AS i FROM ev),
edge AS (SELECT qid, pos, dp, lag(dp, 1, 0) OVER (PARTITION BY qid ORDER BY i) AS before, i FROM run),
ups AS (SELECT qid, pos AS s, row_number() OVER (PARTITION BY qid ORDER BY i) AS n FROM edge WHERE dp >= 3 AND before < 3),
downs AS (SELECT qid, pos AS e, row_number() OVER (PARTITION BY qid ORDER BY i) AS n FROM edge WHERE dp < 3 AND before >= 3),
best AS (SELECT qid, s, e, row_number() OVER (PARTITION BY qid ORDER BY e - s DESC, s) AS r FROM ups JOIN downs USING (qid, n))"""


def _depth_out(clip: int) -> str:
    return f"{_depth(clip)} SELECT q.qid AS read_id, coalesce(s - {clip}, 0)::INT AS s, coalesce(e + {clip}, 0)::INT AS e, s IS NULL AS del FROM (SELECT DISTINCT qid FROM hits) q LEFT JOIN best b ON b.qid = q.qid AND r = 1"


_TWIN = lambda x: f"xor({x}, 1)"


def _symm(arcs: str) -> str:
    """CTE bodies: one(u, v, l, ol) without parallels and sym(u, v, l, ol) with twins only."""
    return f"one AS (SELECT u, v, l, ol FROM (SELECT *, row_number() OVER (PARTITION BY u, v ORDER BY l, ol DESC) AS r FROM ({arcs})) WHERE r = 1), sym AS (SELECT * FROM one a WHERE EXISTS (SELECT 1 FROM one b WHERE b.u = {_TWIN('a.v')} AND b.v = {_TWIN('a.u')}))"


_TRANSITIVE = f"""WITH RECURSIVE arcs AS ({ARCS}), most AS (SELECT u, max(l) + 1000 AS m FROM arcs GROUP BY u),
walks AS (SELECT a.u, a.v AS w, a.l, list(DISTINCT b.v) AS ends FROM arcs a JOIN most ON most.u = a.u JOIN arcs b ON b.u = a.v JOIN arcs c ON c.u = a.u AND c.v = b.v WHERE a.l + b.l <= m GROUP BY a.u, a.v, a.l),
steps AS (SELECT u, w, ends, row_number() OVER (PARTITION BY u ORDER BY l, w) AS i, count(*) OVER (PARTITION BY u) AS n FROM walks),
fold AS (SELECT DISTINCT u, 0::BIGINT AS i, []::BIGINT[] AS gone, n FROM steps
UNION ALL SELECT f.u, f.i + 1, CASE WHEN list_contains(f.gone, s.w) THEN f.gone ELSE list_distinct(list_concat(f.gone, s.ends)) END, f.n FROM fold f JOIN steps s ON s.u = f.u AND s.i = f.i + 1),
gone AS (SELECT u, unnest(gone) AS v FROM fold WHERE i = n)"""


#: CTEs that end in utg(utg_id, len, circ, start, stop, path, pieces, first): heads of simple paths are walked to their ends, circles
#: from each of their vertices; of a path and its twin that with the lowest vertex stays.
_UNITIGS = f"""WITH RECURSIVE arcs AS ({ARCS}), deg AS (SELECT u, count(*) AS n FROM arcs GROUP BY u),
single AS (SELECT a.u, a.v, a.l FROM arcs a JOIN deg d ON d.u = a.u AND d.n = 1 JOIN deg b ON b.u = {_TWIN('a.v')} AND b.n = 1),
vs AS (SELECT u AS x FROM arcs UNION SELECT v FROM arcs), heads AS (SELECT x FROM vs WHERE x NOT IN (SELECT v FROM single)),
lin AS (SELECT x AS cur, [x] AS path, []::INT[] AS steps FROM heads UNION ALL SELECT s.v, list_append(path, s.v), list_append(steps, s.l) FROM lin JOIN single s ON s.u = cur),
whole AS (SELECT path, list_append(steps, 12000) AS pieces, false AS circ FROM lin WHERE cur NOT IN (SELECT u FROM single)),
rest AS (SELECT u AS x FROM single WHERE u NOT IN (SELECT unnest(path) FROM whole)),
cyc AS (SELECT x AS top, x AS cur, [x] AS path, []::INT[] AS steps, false AS shut FROM rest UNION ALL SELECT top, s.v, CASE WHEN s.v = top THEN path ELSE list_append(path, s.v) END, list_append(steps, s.l), s.v = top FROM cyc JOIN single s ON s.u = cur WHERE NOT shut),
every AS (SELECT row_number() OVER () AS i, * FROM (SELECT * FROM whole UNION ALL SELECT path, steps, true FROM cyc WHERE shut AND list_min(path) = top)),
seen AS (SELECT i, unnest(path) AS x FROM every), own AS (SELECT i, min(x) AS own FROM seen WHERE x IN (SELECT u FROM deg) GROUP BY i), other AS (SELECT i, min({_TWIN('x')}) AS other FROM seen WHERE {_TWIN('x')} IN (SELECT u FROM deg) GROUP BY i),
low AS (SELECT every.*, own, other FROM every LEFT JOIN own USING (i) LEFT JOIN other USING (i)),
utg AS (SELECT (row_number() OVER (ORDER BY own) - 1)::INT AS utg_id, list_sum(pieces)::INT AS len, circ, CASE WHEN NOT circ THEN path[1] END AS start, CASE WHEN NOT circ THEN {_TWIN('path[-1]')} END AS stop, path, pieces FROM low WHERE own IS NOT NULL AND (other IS NULL OR own <= other) QUALIFY row_number() OVER (PARTITION BY own ORDER BY circ) = 1)"""

#: CTE bodies after _UNITIGS: link(u, v, l, ol) between ends of linear unitigs.
_LINKS = f"""ends AS (SELECT start AS x, utg_id::BIGINT * 2 AS t FROM utg WHERE NOT circ UNION ALL SELECT stop, utg_id::BIGINT * 2 + 1 FROM utg WHERE NOT circ),
link AS (SELECT {_TWIN('a.t')} AS u, b.t AS v, (CASE WHEN o.len < arcs.ol THEN 1 ELSE o.len - arcs.ol END)::INT AS l, arcs.ol FROM arcs JOIN ends a ON a.x = {_TWIN('arcs.u')} JOIN ends b ON b.x = arcs.v JOIN utg o ON o.utg_id = a.t // 2)"""

_SIGN = lambda x: f"CASE WHEN {x} % 2 = 1 THEN '-' ELSE '+' END"
_LINES = f"""name AS (SELECT *, printf('utg%06d%s', utg_id + 1, CASE WHEN circ THEN 'c' ELSE 'l' END) AS name FROM utg),
part AS (SELECT name, unnest(path) AS x, unnest(pieces) AS n, unnest(list_transform(range(1, len(pieces) + 1), lambda i: coalesce(list_sum(pieces[1:i - 1]), 0))) AS off FROM name),
deg2 AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT concat_ws(chr(9), 'S', name, '*', 'LN:i:' || len) AS line FROM name
UNION ALL SELECT concat_ws(chr(9), 'a', name, off::BIGINT, printf('Read-%06d:1-12000', x // 2), {_SIGN('x')}, n) FROM part
UNION ALL SELECT concat_ws(chr(9), 'L', a.name, {_SIGN('link.u')}, b.name, {_SIGN('link.v')}, ol || 'M', 'SD:i:' || l) FROM link JOIN name a ON a.utg_id = link.u // 2 JOIN name b ON b.utg_id = link.v // 2
UNION ALL SELECT CASE WHEN circ THEN concat_ws(chr(9), 'x', name, len, len(path)) ELSE concat_ws(chr(9), 'x', name, len, len(path), coalesce(r.n, 0), coalesce(f.n, 0), printf('Read-%06d:1-12000', start // 2), {_SIGN('start')}, printf('Read-%06d:1-12000', stop // 2), {_SIGN('stop')}) END FROM name LEFT JOIN deg2 r ON r.u = utg_id::BIGINT * 2 + 1 LEFT JOIN deg2 f ON f.u = utg_id::BIGINT * 2"""


def _strict() -> str:
    """The strict sketch after the CTEs of ``_minimizers``; K is odd, so every base is a slot. ``c`` orders slots by value, then from the right."""
    empty, shift = 4**K, 1 << 32
    return f"""slots AS (SELECT read_id, p, strand, coalesce(x, {empty}) AS v, p - coalesce(max(CASE WHEN code > 3 THEN p END) OVER (PARTITION BY read_id ORDER BY p), -1) AS run FROM codes LEFT JOIN h7 USING (read_id, p)),
least_of AS (SELECT *, min((v + 1) * {shift} - p) OVER (PARTITION BY read_id ORDER BY p ROWS {W - 1} PRECEDING) AS c FROM slots),
pending AS (SELECT *, ({shift} - c % {shift}) % {shift} AS m, (c + {shift} - 1) // {shift} - 1 AS mv FROM least_of),
moved AS (SELECT *, lag(m) OVER r AS om, lag(mv) OVER r AS omv, lead(p) OVER r IS NULL AS ends FROM pending WINDOW r AS (PARTITION BY read_id ORDER BY p)),
ties AS (SELECT read_id, unnest(range(p - {W - 1}, p + 1)) AS t, mv AS tv, m AS own FROM moved WHERE m <> om AND om = p - {W} AND v > omv AND run >= {W + K - 1}
UNION ALL SELECT read_id, unnest(range(p - {W - 1}, p)), omv, om FROM moved WHERE run = {W + K - 1}),
written AS (SELECT read_id, om AS p FROM moved WHERE m <> om AND run >= {W + K} UNION ALL SELECT read_id, m FROM moved WHERE ends AND mv < {empty}
UNION ALL SELECT y.read_id, t FROM ties y JOIN slots s ON s.read_id = y.read_id AND s.p = t AND s.v = tv WHERE t <> own)
SELECT read_id, p::INT AS pos, strand::INT AS strand, v::BIGINT AS hash FROM written JOIN slots USING (read_id, p)"""


def sql() -> dict[str, str]:
    m = f"WITH {_minimizers()}"
    strict = _class(HITS, LENGTHS, 1000, 0.8, 2000)
    gone = f"SELECT DISTINCT CASE class WHEN 'QCONT' THEN qid ELSE tid END AS read_id FROM ({_class(HITS, LENGTHS, 1000, 0.8, 2000)}) WHERE class IN ('QCONT', 'TCONT')"
    cut = f"""SELECT qid, tid, rev, ml, bl, (greatest(qs + CASE WHEN rev THEN greatest(0, te - te0) ELSE greatest(0, ts0 - ts) END, qs0) - qs0)::INT AS qs,
(least(qe - CASE WHEN rev THEN greatest(0, ts0 - ts) ELSE greatest(0, te - te0) END, qe0) - qs0)::INT AS qe,
(greatest(ts + CASE WHEN rev THEN greatest(0, qe - qe0) ELSE greatest(0, qs0 - qs) END, ts0) - ts0)::INT AS ts,
(least(te - CASE WHEN rev THEN greatest(0, qs0 - qs) ELSE greatest(0, qe - qe0) END, te0) - ts0)::INT AS te
FROM (SELECT h.*, a.s AS qs0, a.e AS qe0, b.s AS ts0, b.e AS te0 FROM ({HITS}) h JOIN ({SUBS}) a ON a.read_id = qid AND NOT a.del JOIN ({SUBS}) b ON b.read_id = tid AND NOT b.del)"""
    short = f"""short AS (SELECT u, v FROM (SELECT u, v, ol, row_number() OVER w AS i, first_value(ol) OVER w AS top FROM ({ARCS}) WINDOW w AS (PARTITION BY u ORDER BY l, v)) WHERE i > 1 AND ol < trunc((top::FLOAT * 0.8::FLOAT)::DOUBLE + 0.499)),
rest AS (SELECT a.* FROM ({ARCS}) a ANTI JOIN short USING (u, v))"""
    found = {
        "shared_minimizers": f"{m}, {_SEED_JOIN} SELECT qid, tid, count(*) AS n FROM seeds GROUP BY qid, tid",
        "fasta_reads": f"WITH r AS ({READS}), n AS (SELECT row_number() OVER (ORDER BY read_id) - 1 AS i, concat('>', read_id) AS header, seq, len FROM r), s AS (SELECT *, strlen(header) + 1 AS a, strlen(seq) + 1 AS b FROM n) SELECT i AS read_id, header, seq, len, (coalesce(sum(a + b) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + a)::BIGINT AS file_off FROM s",
        "read_prefix_offsets": f"SELECT read_id, len, coalesce(sum(len) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum_off FROM ({READS})",
        "block_packing": f"""WITH RECURSIVE r AS (SELECT read_id, len, row_number() OVER (ORDER BY read_id) AS i FROM ({READS})),
f AS (SELECT i, read_id, 0 AS block, len::BIGINT AS size FROM r WHERE i = 1 UNION ALL SELECT r.i, r.read_id, CASE WHEN size + len > 65536 THEN block + 1 ELSE block END, CASE WHEN size + len > 65536 THEN len ELSE size + len END FROM f JOIN r ON r.i = f.i + 1)
SELECT block::INT AS block_id, min(read_id) AS first_read, count(*)::INT AS n_reads FROM f GROUP BY block""",
        "nt4_encode": f"SELECT (CASE WHEN b = 'a' THEN 0 WHEN b = 'c' THEN 1 WHEN b = 'g' THEN 2 WHEN b IN ('t', 'u') THEN 3 ELSE 4 END)::INT AS code, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS b FROM ({READS}) WHERE length(seq) > 0) GROUP BY 1",
        "kmer_canonical": f"{m} SELECT read_id, f AS forward, r AS reverse, least(f, r) AS value, (f > r)::INT AS strand FROM kmers WHERE p >= {K - 1} AND worst < 4 AND f <> r",
        "hash64_mix": """WITH a AS (SELECT DISTINCT (l_partkey * 7919 + l_suppkey) % 1073741824 AS x0 FROM lineitem), b AS (SELECT x0, ((~x0) + (x0 << 21)) & 1073741823 AS x FROM a), c AS (SELECT x0, xor(x, x >> 24) AS x FROM b), d AS (SELECT x0, (x * 265) & 1073741823 AS x FROM c),
e AS (SELECT x0, xor(x, x >> 14) AS x FROM d), f AS (SELECT x0, (x * 21) & 1073741823 AS x FROM e), g AS (SELECT x0, xor(x, x >> 28) AS x FROM f) SELECT x0 AS x, (x + (x << 31)) & 1073741823 AS h FROM g""",
        "hash32_mix": f"SELECT x, {_h32('x')} AS h FROM (SELECT DISTINCT l_orderkey AS x FROM lineitem)",
        "pack_unpack": "SELECT DISTINCT l_orderkey AS high, l_partkey AS low, l_orderkey * 4294967296 + l_partkey AS packed, l_orderkey AS high_again, l_partkey AS low_again FROM lineitem",
        "minimizers": f"{m} SELECT read_id, pos, strand, hash FROM minis",
        "minimizers_strict": f"{m}, {_strict()}",
        "index_postings": f"{m} SELECT hash, count(*) AS occ, min(read_id) AS first_read, max(read_id) AS last_read, count(*) AS n_places FROM minis GROUP BY hash",
        "index_key_stats": f"{m}, occ AS (SELECT count(*) AS c FROM minis GROUP BY hash) SELECT count(*) AS n_keys, count(*) FILTER (WHERE c = 1) AS n_single, coalesce(sum(c) FILTER (WHERE c > 1), 0)::BIGINT AS n_multi_values FROM occ",
        "occ_quantile": f"{m}, {_CAP} SELECT max_occ FROM cap",
        "offset_asof_join": f"""WITH r AS (SELECT read_id, len, coalesce(sum(len) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum_off FROM ({READS})),
p AS (SELECT DISTINCT (l_orderkey * 31 + l_partkey * 17) * 1000003 % (SELECT sum(len)::BIGINT FROM r) + 1 AS gpos FROM lineitem) SELECT gpos, read_id, (gpos - cum_off)::INT AS pos FROM p JOIN r ON gpos > cum_off AND gpos <= cum_off + len""",
        "seed_join": f"{m}, {_SEED_JOIN} SELECT qid, tid, rev, diag, j, qpos, rpos FROM seeds",
        "seed_diagonal": f"SELECT qid, tid, rev, qpos, rpos, (CASE WHEN rev THEN rpos + qpos ELSE 2147483648 + rpos - qpos END)::BIGINT AS diag FROM ({SEEDS})",
        "seed_clusters": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY qid, tid, rev ORDER BY diag, j, rpos, qpos) AS rn FROM ({WIDE_SEEDS})),
l AS (SELECT *, max(rn) OVER (PARTITION BY qid, tid, rev ORDER BY diag RANGE BETWEEN CURRENT ROW AND 500 FOLLOWING) AS last FROM s),
g AS (SELECT *, CASE WHEN last - rn + 1 >= 4 THEN last END AS reach FROM l),
r AS (SELECT *, max(reach) OVER (PARTITION BY qid, tid, rev ORDER BY rn ROWS UNBOUNDED PRECEDING) AS upto, max(reach) OVER (PARTITION BY qid, tid, rev ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g)
SELECT qid, tid, rev, diag, j, qpos, rpos, sum(CASE WHEN prev IS NULL OR rn > prev THEN 1 ELSE 0 END) OVER (PARTITION BY qid, tid, rev ORDER BY rn ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM r WHERE upto >= rn""",
        "chain_gap_split": f"""WITH s AS (SELECT qid, tid, rev, qpos, min(rpos) AS rpos FROM ({SEEDS}) GROUP BY ALL), g AS (SELECT *, coalesce(qpos - lag(qpos) OVER w > 1000 AND abs(rpos - lag(rpos) OVER w) > 1000, false) AS gap FROM s WINDOW w AS (PARTITION BY qid, tid, rev ORDER BY qpos)),
p AS (SELECT *, sum(gap::INT) OVER (PARTITION BY qid, tid, rev ORDER BY qpos ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM g) SELECT qid, tid, rev, part, count(*) AS cnt, min(qpos) AS qs, max(qpos) AS qe, min(rpos) AS rs, max(rpos) AS re FROM p GROUP BY qid, tid, rev, part""",
        "interval_union_len": f"SELECT qid, tid, rev, sum(least(15, coalesce(qpos - before, 15)))::BIGINT AS total FROM (SELECT *, lag(qpos) OVER (PARTITION BY qid, tid, rev ORDER BY qpos) AS before FROM ({SEEDS})) GROUP BY qid, tid, rev",
        "hits_filtered": f"SELECT qid, qs, qe, tid, ts, te, rev, ml, greatest(qe - qs, te - ts)::INT AS bl FROM ({HITS}) WHERE ml >= 40 AND qe - qs >= 2000 AND te - ts >= 2000 AND ml >= 100",
        "hits_mirrored": f"SELECT qid, qs, qe, tid, ts, te, rev, ml, bl FROM ({HITS}) UNION ALL SELECT tid, ts, te, qid, qs, qe, rev, ml, bl FROM ({HITS}) WHERE qid <> tid",
        "depth_regions": _depth_out(0),
        "depth_regions_clipped": _depth_out(1000),
        "mean_depth": f"""WITH k AS (SELECT * FROM ({_class(HITS, LENGTHS, 1500, 0.5, 1000)}) WHERE class IN ('ARC', 'QCONT', 'TCONT')),
t AS (SELECT sum(CASE class WHEN 'ARC' THEN l WHEN 'QCONT' THEN ql ELSE tl END)::BIGINT AS tot_dp FROM k), n AS (SELECT sum(ql)::BIGINT AS tot_len FROM (SELECT DISTINCT qid, ql FROM k)) SELECT tot_len, tot_dp, tot_dp::DOUBLE / tot_len::DOUBLE AS cov FROM t, n""",
        "hit_cut": f"SELECT * FROM ({cut}) WHERE qe - qs >= 2000 AND te - ts >= 2000",
        "sub_merge": f"SELECT a.read_id, (a.s + coalesce(b.s, 0))::INT AS s, (a.s + coalesce(b.e, 0))::INT AS e, a.del FROM ({SUBS}) a LEFT JOIN ({INNER_SUBS}) b ON a.read_id = b.read_id",
        "hit_filter_relaxed": f"SELECT qid, qs, qe, tid, ts, te, rev, ml, bl FROM ({_class(HITS, LENGTHS, 1500, 0.5, 1000)}) WHERE class IN ('ARC', 'QCONT', 'TCONT')",
        "overlap_class": strict,
        "contained_reads": gone,
        "used_reads": f"SELECT qid AS read_id FROM ({HITS}) UNION SELECT tid FROM ({HITS})",
        "survivor_renumber": f"""WITH gone AS ({gone}), hits AS ({HITS}), live AS (SELECT read_id FROM ({LENGTHS}) WHERE read_id IN (SELECT qid FROM hits UNION SELECT tid FROM hits) AND read_id NOT IN (SELECT read_id FROM gone)),
ids AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS i FROM live) SELECT a.i AS qid, b.i AS tid, qs, qe, ts, te, rev, ml, bl FROM hits JOIN ids a ON a.read_id = qid JOIN ids b ON b.read_id = tid""",
        "string_graph_arcs": f"""WITH c AS ({strict}), gone AS (SELECT qid AS r FROM c WHERE class = 'QCONT' OR (class = 'ARC' AND qid = tid AND rev AND qs = ts AND qe = te))
SELECT u, v, l, ol FROM c WHERE class = 'ARC' AND qid <> tid AND qid NOT IN (SELECT r FROM gone) AND tid NOT IN (SELECT r FROM gone)""",
        "arc_multi_dedupe": f"WITH {_symm(LOOSE_ARCS)} SELECT * FROM one",
        "arc_symmetric": f"WITH {_symm(LOOSE_ARCS)} SELECT * FROM sym",
        "transitive_reduction": f"{_TRANSITIVE} SELECT u, v FROM gone",
        "reduced_graph": f"{_TRANSITIVE}, {_symm('SELECT a.* FROM arcs a ANTI JOIN gone USING (u, v)')} SELECT * FROM sym",
        "short_overlap_drop": f"WITH {short}, {_symm('SELECT * FROM rest')} SELECT * FROM sym",
        "vertex_end_type": f"""WITH arcs AS ({ARCS}), deg AS (SELECT u, count(*) AS n, min(v) AS nxt FROM arcs GROUP BY u), vs AS (SELECT u AS x FROM arcs UNION SELECT v FROM arcs UNION SELECT {_TWIN('u')} FROM arcs UNION SELECT {_TWIN('v')} FROM arcs)
SELECT x AS vertex, coalesce(d.n, 0)::BIGINT AS degree, CASE WHEN d.n IS NULL THEN 'TIP' WHEN d.n > 1 THEN 'MULTI_OUT' WHEN coalesce(b.n, 0) > 1 THEN 'MULTI_NEI' ELSE 'MERGEABLE' END AS type FROM vs LEFT JOIN deg d ON d.u = x LEFT JOIN deg b ON b.u = {_TWIN('d.nxt')}""",
        "unitigs": f"{_UNITIGS} SELECT utg_id, len, circ, start, stop AS end, len(path) AS n_reads, path::VARCHAR AS vertices FROM utg",
        "unitig_links": f"{_UNITIGS}, {_LINKS} SELECT u, v, l, ol FROM link",
        "gfa_lines": f"{_UNITIGS}, {_LINKS}, {_LINES}",
        "random_sample": "SELECT o_orderkey, o_custkey FROM orders ORDER BY substr(md5(concat(o_orderkey, ':11')), 1, 12), o_orderkey LIMIT 100",
        "order_statistic": "SELECT v AS value FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) AS v, row_number() OVER (ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT)) - 1 AS i FROM lineitem) WHERE i = (SELECT count(*) // 2 FROM lineitem)",
        "read_stats": f"SELECT count(*) AS n_reads, sum(len)::BIGINT AS bases, max(len) AS max_len FROM ({READS})",
        "vertex_degree": f"SELECT u AS vertex, count(*) AS degree FROM ({ARCS}) GROUP BY u",
        "linear_walk": f"""WITH RECURSIVE arcs AS ({ARCS}), deg AS (SELECT u, count(*) AS n, min(v) AS nxt FROM arcs GROUP BY u), vs AS (SELECT u AS x FROM arcs UNION SELECT v FROM arcs UNION SELECT {_TWIN('u')} FROM arcs UNION SELECT {_TWIN('v')} FROM arcs),
kinds AS (SELECT x, CASE WHEN d.n IS NULL THEN 'TIP' WHEN d.n > 1 THEN 'MULTI_OUT' WHEN coalesce(b.n, 0) > 1 THEN 'MULTI_NEI' ELSE 'MERGEABLE' END AS type, d.nxt FROM vs LEFT JOIN deg d ON d.u = x LEFT JOIN deg b ON b.u = {_TWIN('d.nxt')}),
walk AS (SELECT x AS vertex, x AS last, 0::BIGINT AS steps, type, nxt FROM kinds UNION ALL SELECT w.vertex, k.x, w.steps + 1, k.type, k.nxt FROM walk w JOIN kinds k ON k.x = w.nxt WHERE w.type = 'MERGEABLE' AND w.steps < 4)
SELECT vertex, last, steps, type FROM walk QUALIFY row_number() OVER (PARTITION BY vertex ORDER BY steps DESC) = 1""",
        "graph_components": f"""WITH RECURSIVE e AS (SELECT u >> 1 AS a, v >> 1 AS b FROM ({ARCS})), r AS (SELECT a, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a) SELECT a AS read_id, min(c) AS component FROM r GROUP BY a""",
        "partition_histogram": "SELECT (l_orderkey % 3)::INT AS node, (l_orderkey // 3 % 256)::INT AS part, count(*) AS n FROM lineitem GROUP BY 1, 2",
        "run_length": """WITH a AS (SELECT *, row_number() OVER w AS i, lag(l_returnflag) OVER w AS before FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag)),
b AS (SELECT *, sum(CASE WHEN i = 1 OR l_returnflag IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_returnflag ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a) SELECT l_partkey, run, l_returnflag, count(*) AS n FROM b GROUP BY ALL""",
        "list_union": "SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2",
        "id_set_union": "SELECT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1 UNION SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2",
        "id_set_difference": "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_linenumber = 1 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 5)",
    }
    return {name: for_duckdb(text) for name, text in found.items()}
