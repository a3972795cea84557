"""Logical tables of the dataflow, as Spark DDL."""

# Column names and types of the tables.
READS = "read_id BIGINT, header STRING, seq STRING, len INT, file_off BIGINT, cum_off BIGINT"
MINIMIZERS = "read_id BIGINT, pos INT, strand INT, hash BIGINT"
SEEDS = "qid BIGINT, tid BIGINT, rev BOOLEAN, diag BIGINT, j INT, qpos INT, rpos INT"
REGIONS = "qid BIGINT, tid BIGINT, rev BOOLEAN, cnt INT, len INT, qs INT, qe INT, rs INT, re INT"
HITS = "qid BIGINT, qs INT, qe INT, tid BIGINT, ts INT, te INT, rev BOOLEAN, ml INT, bl INT"
SUBS = "read_id BIGINT, s INT, e INT, del BOOLEAN"
ARCS = "u BIGINT, v BIGINT, l INT, ol INT"
UNITIGS = "utg_id INT, len INT, circ BOOLEAN, start BIGINT, end BIGINT, reads ARRAY<STRUCT<vertex: BIGINT, len: INT>>"
