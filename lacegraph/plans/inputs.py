"""Synthetic inputs of single operators, as SQL that Spark and DuckDB both run.

The driver's tables hold no reads, hits or arcs. Documents become reads letter by letter; hits, seeds and arcs come from
lineitem and orders by integer arithmetic. Braces name the driver's tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import PROSE_FROM, PROSE_TO

_FROM = PROSE_FROM.replace("\n", "")
READS = f"SELECT doc_id AS read_id, translate(lower(text), concat('{_FROM}', chr(10)), '{PROSE_TO}') AS seq, CAST(length(text) AS INT) AS len FROM {{documents}} WHERE text IS NOT NULL"

#: Reads of hits come in blocks of 997, a new one for each 60,000 order keys, so that their number grows with the table.
_BLOCK = "997 * CAST(floor(l_orderkey / 60000) AS BIGINT)"
_Q, _T = f"l_orderkey % 997 + {_BLOCK}", f"l_partkey % 997 + {_BLOCK}"
LENGTHS = f"SELECT DISTINCT {_T} AS read_id, CAST(12000 + (l_partkey % 997) * 7 % 1500 AS INT) AS len FROM {{lineitem}} UNION SELECT DISTINCT {_Q} AS read_id, CAST(12000 + (l_orderkey % 997) * 7 % 1500 AS INT) AS len FROM {{lineitem}}"

_RAW = f"""SELECT {_Q} AS qid, {_T} AS tid, CASE WHEN l_linenumber % 4 = 2 AND l_partkey % 997 % 3 > 0 THEN 0 WHEN l_orderkey % 997 = l_partkey % 997 THEN 1 ELSE l_linenumber % 4 END AS k, 2000 + (l_orderkey * 13 + l_linenumber * 7) % 5000 AS span,
12000 + (l_orderkey % 997) * 7 % 1500 AS ql, 12000 + (l_partkey % 997) * 7 % 1500 AS tl, (l_orderkey * 3 + l_suppkey) % 1200 AS a, (l_partkey * 5 + l_linenumber) % 900 AS b,
(l_suppkey * 37 + l_linenumber * 911 + l_orderkey) % 5000 AS x, (l_partkey * 53 + l_orderkey) % 5000 AS y, l_linenumber AS n FROM {{lineitem}}"""
#: Dovetails on one strand and on opposite ones, containments and inner matches, with overhangs of up to 1200. Only reads
#: divisible by 3 are contained, so that others survive at every scale; hits of a read with itself are reverse dovetails,
#: some of them palindromic.
HITS = f"""SELECT qid, CAST(CASE k WHEN 2 THEN a % 200 WHEN 3 THEN x ELSE ql - span - a END AS INT) AS qs,
CAST(CASE k WHEN 2 THEN ql - b % 200 WHEN 3 THEN x + span ELSE ql - a END AS INT) AS qe, tid,
CAST(CASE WHEN k = 1 AND qid = tid AND n % 2 = 0 THEN ql - span - a WHEN k = 0 THEN b WHEN k = 1 THEN tl - span - b WHEN k = 2 THEN 0 ELSE y END AS INT) AS ts,
CAST(CASE WHEN k = 1 AND qid = tid AND n % 2 = 0 THEN ql - a WHEN k = 0 THEN b + span WHEN k = 1 THEN tl - b WHEN k = 2 THEN tl - a % 100 ELSE y + span END AS INT) AS te,
k = 1 OR (k = 3 AND x % 2 = 0) AS rev, CAST(floor(span * (1 + n) / 40.0) AS INT) AS ml, CAST(span AS INT) AS bl FROM ({_RAW}) raw"""

SUBS = f"SELECT read_id, CAST((read_id * 11) % 1500 AS INT) AS s, CAST(12000 - (read_id * 17) % 2500 AS INT) AS e, read_id % 41 = 0 AS del FROM (SELECT DISTINCT {_T} AS read_id FROM {{lineitem}} UNION SELECT DISTINCT {_Q} AS read_id FROM {{lineitem}}) ids"
INNER_SUBS = f"SELECT read_id, CAST((read_id * 3) % 400 AS INT) AS s, CAST(8000 - (read_id * 5) % 700 AS INT) AS e, false AS del FROM (SELECT DISTINCT {_T} AS read_id FROM {{lineitem}}) ids WHERE read_id % 5 <> 0"

#: A query read for each 700 order keys, so that pairs of reads grow with the table.
SEEDS = """SELECT CAST(floor(l_orderkey / 700) AS BIGINT) AS qid, l_partkey % 5 AS tid, (l_partkey + l_linenumber) % 2 = 0 AS rev, (l_suppkey * 97 + l_partkey * 31 + l_orderkey * 7) % 20000 AS diag,
CAST((l_orderkey * 5 + l_linenumber) % 4000 AS INT) AS j, CAST((l_orderkey * 5 + l_linenumber) % 4000 * 3 AS INT) AS qpos, CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 12000 AS INT) AS rpos FROM {lineitem}"""

#: The same seeds between few reads: pairs of reads whose seeds grow with the table.
WIDE_SEEDS = SEEDS.replace("CAST(floor(l_orderkey / 700) AS BIGINT) AS qid", "l_orderkey % 7 AS qid")

_TWIN = "{0} + 1 - 2 * ({0} % 2)"
#: Parallel and one-sided arcs.
LOOSE_ARCS = "SELECT (l_partkey % 1500) * 2 + l_linenumber % 2 AS u, (l_suppkey * 13 + l_orderkey) % 1500 * 2 + l_orderkey % 2 AS v, CAST(100 + (l_orderkey * 7 + l_partkey) % 3000 AS INT) AS l, CAST(12000 - (100 + (l_orderkey * 7 + l_partkey) % 3000) AS INT) AS ol FROM {lineitem}"
_CHAIN = """SELECT o_orderkey * 2 AS u, (o_orderkey + 1) * 2 AS v, 1000 + o_orderkey % 500 AS l FROM {orders} WHERE o_orderkey % 50 <> 49
UNION ALL SELECT o_orderkey * 2, (o_orderkey + 2) * 2, 2000 + o_orderkey % 700 FROM {orders} WHERE o_orderkey % 9 = 0 AND o_orderkey % 50 < 48
UNION ALL SELECT o_orderkey * 2, (o_orderkey + 1000000000) * 2, 900 + o_orderkey % 3000 FROM {orders} WHERE o_orderkey % 13 = 0
UNION ALL SELECT o_orderkey * 2, (o_orderkey + 2000000000) * 2, 1100 + o_orderkey % 90 FROM {orders} WHERE o_orderkey % 17 = 0 AND o_orderkey % 50 < 47
UNION ALL SELECT (o_orderkey + 2000000000) * 2, (o_orderkey + 2) * 2, 1200 FROM {orders} WHERE o_orderkey % 17 = 0 AND o_orderkey % 50 < 47
UNION ALL SELECT o_orderkey * 2, (o_orderkey + 5) * 2 + 1, 3000 + o_orderkey % 800 FROM {orders} WHERE o_orderkey % 101 = 0"""
#: Chains of 50 reads with skips, dead ends, bubbles and turns; every arc has its twin.
ARCS = f"""SELECT u, v, CAST(min(l) AS INT) AS l, CAST(12000 - min(l) AS INT) AS ol FROM (SELECT u, v, l FROM ({_CHAIN}) c
UNION ALL SELECT {_TWIN.format('v')} AS u, {_TWIN.format('u')} AS v, l FROM ({_CHAIN}) d) both_ways GROUP BY u, v"""

_NAME = re.compile(r"\{(\w+)\}")


def for_duckdb(sql: str) -> str:
    return _NAME.sub(r"\1", sql)


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(_NAME.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))
