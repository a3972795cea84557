"""The queries op1 to op13 over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import bpe, conv_repair, decontam, fingerprint, html_extract, langid, linededup, neardup, prefix_trie, secrets, token_counts, toxicity, url_filter
from .common import read
from .conversation_sql import OP11_SQL, OP12_SQL


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    known = labels.select("doc_id", "toxic").where(_fold(4) != 2)
    model = toxicity.fit(docs.select("doc_id", "text").join(known, "doc_id"))
    scored = toxicity.score(docs, model)
    held_out = F.coalesce(_fold(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_report(read(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digest(bpe.encode(read(spark, sf_dir, "documents"), path, pattern, decoded=True))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang").where((_fold(5) != 0) & F.col("lang").isNotNull()))
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    got = html_extract.extract(pages, html_extract.fit(pages))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return decontam.judge(docs, decontam.overlaps(docs, read(spark, sf_dir, "benchmark")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), width=4)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"), prefix_trie.rebuilt)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return conv_repair.report(conv_repair.damage(turns), turns)


#: The rules of op13_url_filter; the URLs that they decide are its labels.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    model = url_filter.fit(url_filter.labelled_by(pages, RULES))
    return url_filter.judge(pages, RULES, model)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_fingerprints, op4_byte_bpe, op5_language_id, op6_html_extraction, op7_decontamination, op8_line_dedup, op9_token_counts, op10_near_duplicates, op11_prefix_trie, op12_conversation_repair, op13_url_filter, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": OP7_SQL, "op8_line_dedup": OP8_SQL, "op10_near_duplicates": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_conversation_repair": OP12_SQL}


OP8_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM t WHERE text IS NOT NULL),
h AS (SELECT source, count(*) AS total FROM t GROUP BY source),
c AS (SELECT source, line, count(DISTINCT r) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY source, line),
b AS (SELECT c.source, c.line FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE pages > 1 AND pages / total > {linededup.RATIO}),
k AS (SELECT l.r, l.pos, l.line, b.line IS NOT NULL AS dropped FROM l LEFT JOIN b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source),
g AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped FROM k GROUP BY r)
SELECT t.doc_id, t.source, g.text, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_dropped, 0)::BIGINT AS n_dropped FROM t LEFT JOIN g USING (r)
"""

_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
#: The links by counting common shingles, and what each document reaches over them.
OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^ \\t\\n\\x0b\\f\\r]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT r.a AS doc_id, any_value(n.n) AS n_shingles, min(r.b) AS component_id, min(r.b) = r.a AS kept FROM r JOIN n ON n.doc_id = r.a GROUP BY r.a
"""


def _words_sql(table: str, key: str) -> str:
    return f"SELECT {key}, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]+', '', 'g'), '\\s+', ' ', 'g')), ' ') AS ws FROM {table} WHERE text IS NOT NULL"


#: Without seeds: equal words of a document and an item at one offset, counted in windows that begin at each of them. A
#: window that would pass the alignment's end holds the same words when it is moved back.
OP7_SQL = f"""
WITH d AS ({_words_sql("documents", "doc_id")}), b AS ({_words_sql("benchmark", "item_id")}),
dw AS (SELECT doc_id, len(ws) AS dn, unnest(ws) AS word, unnest(range(len(ws))) AS dp FROM d), bw AS (SELECT item_id, len(ws) AS bn, unnest(ws) AS word, unnest(range(len(ws))) AS bp FROM b),
e AS (SELECT doc_id, item_id, dp - bp AS off, bp, dn, bn, least({decontam.WINDOW}, bn) AS w FROM dw JOIN bw USING (word) WHERE word <> ''),
c AS (SELECT * FROM e WHERE least(bn, dn - off) - greatest(0, -off) >= w QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, off) >= ceil(w * {decontam.AGREE})),
f AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, item_id, w, count(*) OVER (PARTITION BY doc_id, item_id, off ORDER BY bp RANGE BETWEEN CURRENT ROW AND {decontam.WINDOW - 1} FOLLOWING) AS n FROM c) WHERE n >= ceil(w * {decontam.AGREE}))
SELECT t.doc_id, count(f.item_id) > 0 AS contaminated, count(f.item_id) AS n_items, coalesce(string_agg(f.item_id, ',' ORDER BY f.item_id), '') AS items FROM documents t LEFT JOIN f USING (doc_id) GROUP BY t.doc_id
"""
