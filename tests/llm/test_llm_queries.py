"""The registered queries over small tables, against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from lacegraph.llm import queries

WORDS = {"de": "der und nicht schön über gehen wir", "en": "the and not with them going we", "fr": "le et pas avec être vous nous", "es": "el y no con señor vosotros niño"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(21), []
    for i in range(400):
        lang = list(WORDS)[i % 4]
        words = [rng.choice(WORDS[lang].split()) + rng.choice("abcdefg") for _ in range(rng.randint(20, 90))]
        if i % 5 == 0:
            words[3:3] = ["vile", "nasty", "foul", "vile"]
        out.append((7 * i, " ".join(words), lang))
    odd = [None, "", "  ", "12 !", 'token = "0123456789abcdef0123"', "AKIA" + "Z9" * 9, "Password: abcdefghijklmnop", "é漢😀\x00 x", out[0][1], out[0][1], "a " * 30_000]
    return out + [(100_000 + i, t, None) for i, t in enumerate(odd)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, c, f"s{i % 3}", len(t) if t is not None else None, "clash", 1) for i, t, c in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, id string, score int").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0), 0) for i, t, c in rows if c and i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, y int").write.parquet(f"{path}/labels.parquet")
    pages = [(i, f"u{i}", f"<nav><a href=x>menu {i}</a></nav><article><h1>Title {i}</h1><p>Some words &amp; more of page {i}.</article><footer>foot</footer>") for i in range(30)]
    spark.createDataFrame([*pages, (30, None, None), (31, "u", "")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    turns = [(i % 7, i // 7, "user", f"turn {i}.", 1) for i in range(40)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, place int").write.parquet(f"{path}/conversations.parquet")
    return path


def run(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def test_op1(spark, folder, rows):
    base = [("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12), ("access", r"(AKIA[A-Z0-9]+)", 18), ("hex", r"([0-9a-f]+)", 16)]
    expected = Counter()
    for i, t, _ in rows:
        found = [(m.start(), n, m.end(), k) for n, (k, p, least) in enumerate(base) for m in re.finditer(p, t or "", re.A) if len(m[1]) >= least]
        expected[i, *(sum(x[3] == k for x in found) for k, *_ in base), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)))] += 1
    got = run(spark, folder, "op1_secret_scan")
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == expected
    assert {r.doc_id for r in got if "literal" in r.spans} >= {100_004, 100_006}


def test_op2_learns_no_held_out_label(spark, folder, rows, tmp_path):
    got = {r.doc_id: r for r in run(spark, folder, "op2_toxicity")}
    assert {i: r.held_out for i, r in got.items()} == {i: fold(i, 4) == 2 for i, *_ in rows}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert sum(r.predicted != (i % 5 == 0) for i, r in got.items() if i < 100_000) <= 8
    assert got[100_000].score == got[100_001].score == min(r.score for r in got.values()) and got[100_008].score == got[100_009].score == got[0].score
    spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "'xx' AS lang", "'yy' AS source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    flipped = [(r.doc_id, 1, r.toxic if fold(r.doc_id, 4) != 2 else 1 - r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id: r.score for r in run(spark, str(tmp_path), "op2_toxicity")} == pytest.approx({i: r.score for i, r in got.items()})


def test_op3(spark, folder, rows):
    order = sorted(rows, key=lambda r: -r[0])
    got = {r.doc_id: r for r in run(spark, folder, "op3_fingerprints")}
    assert len(got) == len(rows)
    for n, (i, t, _) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(t[: len(t) - half] + after[:half]))
    assert got[100_008].fingerprint == got[100_009].fingerprint == got[0].fingerprint and got[100_009].near_next == 1.0


def test_op4_and_op9(spark, folder, rows):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: library.encode_ordinary(t or "") for i, t, _ in rows}
    assert Counter(tuple(r)[:4] for r in run(spark, folder, "op4_byte_bpe")) == Counter((i, len(ids[i]), sha(" ".join(map(str, ids[i]))), sha(t or "")) for i, t, _ in rows)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.no_truncation()
    other.no_padding()
    counts = {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows}
    assert Counter(tuple(r)[:4] for r in run(spark, folder, "op9_token_counts")) == Counter((i, len((t or "").encode()), counts[i], counts[i] > 512) for i, t, _ in rows)


def test_op5_learns_no_held_out_language(spark, folder, rows, tmp_path):
    got = {r.doc_id: r for r in run(spark, folder, "op5_language_id")}
    assert {i: r.held_out for i, r in got.items()} == {i: fold(i, 5) == 0 for i, *_ in rows}
    assert sum(got[i].lang_pred != c for i, _, c in rows if c) <= 4 and all(0 <= r.score <= 1 for r in got.values())
    assert [(got[100_000 + i].lang_pred, got[100_000 + i].score) for i in range(4)] == [("und", 0.0)] * 4
    wrong = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'zz' ELSE lang END AS lang")
    wrong.write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: r.lang_pred for r in run(spark, str(tmp_path), "op5_language_id")}
    assert again == {i: r.lang_pred for i, r in got.items()}


def test_op6(spark, folder):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in run(spark, folder, "op6_html_extraction")}
    texts = {i: f"Title {i}\nSome words & more of page {i}." for i in range(30)}
    assert got == {i: (f"u{i}", t, len(t)) for i, t in texts.items()} | {30: (None, "", 0), 31: ("u", "", 0)}


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "pages", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(1, "some words of an item that nothing holds")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
