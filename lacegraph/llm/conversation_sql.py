"""The conversation queries in DuckDB SQL."""

from __future__ import annotations


def _crc(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    step = f"lambda a, b: list_reduce(list_concat([xor(a, b)], {[0] * 8}::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len({text}) + 1), lambda i: ord(({text})[i])::BIGINT)), {step}), 4294967295)"


#: Every prefix as a list; nodes are its groups, and a node lies below those of its smallest conversation's prefixes.
OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(len(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, count(*) AS own, c - c % 5 AS base, {_crc("c::VARCHAR")} % 9 AS h FROM t GROUP BY c),
z AS (SELECT s.c, s.own, s.base, s.h, least(s.h, coalesce(b.own, 0)) AS given FROM s LEFT JOIN s b ON b.c = s.base),
q AS (SELECT z.c, p + 1 AS d, r, x FROM z JOIN t ON t.c = z.base AND p < given UNION ALL SELECT z.c, p - h + given + 1, r, x FROM z JOIN t ON t.c = z.c AND p >= h),
k AS (SELECT c, d, octet_length(encode(x)) AS b, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY d) AS k FROM q UNION ALL SELECT c, 0, 0, [] FROM z),
n AS (SELECT c, max(d) AS n FROM k GROUP BY c),
g AS (SELECT d, min(c) AS node, count(*) AS members, any_value(b) AS b, k FROM k GROUP BY d, k),
m AS (SELECT k.c, k.d, g.node FROM k JOIN g ON k.d = g.d AND k.k = g.k),
f AS (SELECT g.d, g.node, g.members, g.b, m.node AS parent FROM g LEFT JOIN m ON m.c = g.node AND m.d = g.d - 1),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS children FROM f WHERE parent IS NOT NULL GROUP BY ALL),
l AS (SELECT f.*, coalesce(children, 0) AS children FROM f LEFT JOIN kids USING (d, node)),
u AS (SELECT m.d, m.node, sum((l.children = 0)::INT) AS leaves, sum((l.members - 1) * l.b) AS saved FROM l JOIN m ON m.c = l.node AND m.d <= l.d GROUP BY ALL),
e AS (SELECT m.d, m.node, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends FROM m JOIN n ON n.c = m.c AND n.n = m.d GROUP BY ALL)
SELECT l.node AS conv_id, l.d::BIGINT AS depth, l.parent AS parent_conv_id, l.members::BIGINT AS n_convs, l.children::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM l JOIN u USING (d, node) LEFT JOIN e USING (d, node)
"""

#: Row by row the cheapest way to each state with its whole audit and text; four insertions before a row are allowed.
OP12_SQL = f"""
WITH RECURSIVE o AS (SELECT conv_id AS c, turn AS t, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
f AS (SELECT *, {_crc("key")} % 20 AS f FROM o),
d AS (SELECT c, t, CASE WHEN f = 4 THEN 'user' ELSE r END AS r, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(x, '.!?', '') ELSE x END AS x, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE f <> 0),
p AS (SELECT c, t, r, x, rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e, row_number() OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, sha256(x), copy) AS n, lag(r) OVER (PARTITION BY c ORDER BY t NULLS FIRST, r, sha256(x), copy) AS before, row_number() OVER (PARTITION BY c, r, x ORDER BY t NULLS FIRST, copy) AS seen FROM d),
k AS (SELECT c, t, r, x, n, before, left(r, 1) AS i, CASE WHEN e = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(e, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p),
runs(q, ins, st, spent, audit, said) AS (SELECT unnest([0, 1, 2, 3]), 0, unnest([0, 1, 2, 3]), 0, '', '' UNION ALL
  SELECT q, ins + 1, CASE st WHEN 2 THEN 3 ELSE 2 END, spent + 5, audit || 'I', said || chr(10) || CASE st WHEN 2 THEN 'assistant:' ELSE 'user:' END FROM runs WHERE ins < 4),
edits AS (SELECT * FROM (VALUES ('D', 2), ('K', 0), ('R', 1)) v(edit, price)),
kept AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) v(st, i, into_state)),
ways AS (SELECT DISTINCT c FROM o),
dp AS (SELECT c, 0::BIGINT AS n, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS best FROM ways UNION ALL
  SELECT c, n, q, min(best) FROM (
    SELECT dp.c, k.n, CASE edit WHEN 'D' THEN runs.st WHEN 'K' THEN kept.into_state WHEN 'R' THEN CASE runs.st WHEN 2 THEN 3 ELSE 2 END END AS q,
      {{'cost': best.cost + spent + price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 5 ELSE 0 END, 'audit': best.audit || runs.audit || edit,
        'said': best.said || runs.said || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r || ':' || x ELSE chr(10) || CASE runs.st WHEN 2 THEN 'assistant:' ELSE 'user:' END || x END}} AS best
    FROM dp JOIN k ON k.c IS NOT DISTINCT FROM dp.c AND k.n = dp.n + 1 JOIN runs ON runs.q = dp.q CROSS JOIN edits LEFT JOIN kept ON kept.st = runs.st AND kept.i = k.i AND edit = 'K'
    WHERE (edit = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (edit <> 'K' OR kept.into_state IS NOT NULL)) GROUP BY c, n, q),
last AS (SELECT c, max(n) AS n FROM dp GROUP BY c),
fin AS (SELECT dp.c, min({{'cost': best.cost + spent, 'audit': best.audit || runs.audit, 'said': best.said || runs.said}}) AS best FROM dp JOIN last ON last.c IS NOT DISTINCT FROM dp.c AND last.n = dp.n JOIN runs ON runs.q = dp.q WHERE runs.st IN (0, 3) GROUP BY dp.c),
a AS (SELECT c, coalesce(max(t) - min(t) + 1 - count(DISTINCT t), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND left(before, 1) || i NOT IN ('su', 'ua', 'au')) AS illegal FROM k GROUP BY c)
SELECT fin.c AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.cost::BIGINT AS cost, best.audit AS audit, sha256(substr(best.said, 2)) AS repaired_sha256 FROM fin LEFT JOIN a ON a.c IS NOT DISTINCT FROM fin.c
"""
