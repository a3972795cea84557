"""Operators on small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import itertools
import math
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lacegraph.llm import bpe, decontam, fingerprint, html_extract, langid, linededup, neardup, queries, secrets, token_counts, toxicity
from lacegraph.llm.neardup import components

#: Extra columns clash with the operators' own names.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, tokens string, spans int, host string, bucket string, b int, rep string, component string, score int"
BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def prose(rng, n, words=("alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "zeta", "theta", "iota", "lambda", "rho", "tau", "phi", "chi", "psi")):
    return " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(1)
    base = prose(rng, 120)
    rows = [None, "", "  \n\t ", "one", base, base, base.replace(base.split()[60], "changed", 1), base.upper(), prose(rng, 20000), "é漢😀 x", 'password = "Zx81kQp0LmN4"', "A\nB\nA\n\nB", base + " " + prose(rng, 10)]
    rows += [prose(rng, rng.randint(1, 80)) for _ in range(30)]
    return [(i * 3, t) for i, t in enumerate(rows)] + [(12, base), (15, prose(rng, 30)), (None, "no id here at all")]


@pytest.fixture(scope="module")
def docs(spark, cases):
    return spark.createDataFrame([(i, t, "en", None if n % 5 == 0 else f"s{n % 2}", 0, 7, "t", 1, "h", "x", 2, "r", "c", 3) for n, (i, t) in enumerate(cases)], DOCS).repartition(3)


def table(df):
    return Counter(tuple(r) for r in df.collect())


def test_secret_scan(docs, cases):
    got = secrets.digest(secrets.scan(docs))
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    join = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    expected = Counter()
    for i, t in cases:
        spans = secrets.all_spans(t or "")
        base = [x for x in spans if x[2] != "literal"]
        expected[i, *(sum(k == n for *_, k in base) for n in ("assign", "access", "hex")), hashlib.sha256(join(base).encode()).hexdigest(), join(spans)] += 1
    assert table(got) == expected


def test_bpe(docs, cases):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=BPE[1], mergeable_ranks=bpe.load_ranks(BPE[0]), special_tokens={})
    expected = Counter()
    for i, t in cases:
        ids = library.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert table(bpe.digest(bpe.decode(bpe.encode(docs, *BPE), BPE[0]))) == expected
    assert table(bpe.digest(bpe.encode(docs, *BPE, decoded=True))) == expected


def test_token_counts(docs, cases):
    path = public_tokenizers.path("byte_bpe_50k.json")
    of = token_counts.counter(path)
    assert table(token_counts.count(docs, path, 512)) == Counter((i, len((t or "").encode()), n := of([t or ""])[0], n > 512) for i, t in cases)
    model = public_tokenizers.path("piece_bpe_32k.model")
    assert {r.doc_id: r.n_tokens for r in token_counts.count(docs.where("doc_id = 9"), model, 512).collect()} == {9: token_counts.counter(model)(["one"])[0]}


def test_fingerprint_report(docs, cases):
    got = {}
    for r in fingerprint.edited_report(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(cases)
    ids = [c for c in cases if Counter(i for i, _ in cases)[c[0]] == 1 and c[0] is not None]
    order = sorted((c for c in cases if c[0] is not None), key=lambda c: -c[0])

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, (i, t) in enumerate(order):
        if (i, t) not in ids:
            continue
        follow = order[(n + 1) % len(order)]
        if follow not in ids:
            continue
        t, nxt = t or "", follow[1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i][0]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(shingles(t), shingles(edited))) < 0.12
        assert abs(r.near_next - like(shingles(t), shingles(nxt))) < 0.12
    assert len({r.fingerprint for r in got[12]}) == 1 and got[12][0].fingerprint == got[0 + 12][1].fingerprint


def test_next_across_buckets(spark):
    rng = random.Random(3)
    for ids in ([5], sorted(rng.sample(range(10**6), 200)), [-(2**62), 0, 2**62], list(range(50))):
        df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
        got = {r.id: r.next_text for r in fingerprint.with_next(df, "doc_id", "text", lambda d: (d, []), bucket_rows=7).collect()}
        order = sorted(ids, reverse=True)
        assert got == {i: f"t{order[(n + 1) % len(order)]}" for n, i in enumerate(order)}
    assert fingerprint.edited_report(df.where("doc_id < 0")).count() == 0


def test_sketches_merge_and_estimate(spark):
    rng = random.Random(4)
    a, b = prose(rng, 3000), prose(rng, 1500)
    df = spark.createDataFrame([("x", a), ("x", b), ("y", a), ("z", "")], "k string, text string")
    parts = fingerprint.add_sketch(df, "text", "s")
    merged = {r.k: r.s for r in fingerprint.merge_parts(parts, "k", "s").collect()}
    single = {(r.k, len(r.text)): r.s for r in parts.collect()}
    assert merged["x"] == sorted(set(single["x", len(a)]) | set(single["x", len(b)]))[: fingerprint.K]
    assert merged["y"] == single["y", len(a)] and merged["z"] == []
    row = parts.where("k = 'y'").select(fingerprint.distinct_shingles(F.col("s")).alias("n"), fingerprint.containment(F.col("s"), F.col("s")).alias("c"), fingerprint.resemblance(F.col("s"), F.array().cast("array<bigint>")).alias("r")).first()
    assert abs(row.n - 2996) < 500 and row.c == 1.0 and row.r == 0.0


def test_line_dedup(spark, docs, cases):
    assert linededup.drop_lines(docs).count() == len(cases)
    rows = [(i, "big", f"menu\nown {i}\n\nshared {i % 3}\nmenu") for i in range(40)] + [(100 + i, "small", "menu\nx") for i in range(3)] + [(200, None, "menu"), (201, "big", None), (202, "big", "menu")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for bound in (linededup.BROADCAST_ROWS, 0):
        old, linededup.BROADCAST_ROWS = linededup.BROADCAST_ROWS, bound
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.drop_lines(df).collect()}
        linededup.BROADCAST_ROWS = old
        assert got[7] == ("own 7\n", 5, 3) and got[100] == ("", 2, 2)
        assert got[200] == ("menu", 1, 0) and got[201] == (None, 0, 0) and got[202] == ("", 1, 1)
    import duckdb

    con = duckdb.connect()
    documents = df.toPandas()  # noqa: F841
    con.sql("CREATE TABLE documents AS SELECT * FROM documents")
    expected = Counter(con.sql(queries.OP8_SQL).fetchall())
    assert table(linededup.drop_lines(df).select("doc_id", "source", "text", "n_lines", "n_dropped")) == expected


def test_line_dedup_with_columns_of_its_own_names(spark):
    rows = [(i, "s", f"menu\nown {i}", 99, 98, "h", 1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_lines int, n_dropped int, host string, a int, total int")
    got = linededup.drop_lines(df)
    assert got.columns == ["doc_id", "source", "text", "host", "a", "total", "n_lines", "n_dropped"]
    assert {tuple(r) for r in got.collect()} == {(i, "s", f"own {i}", "h", 1, 2, 2, 1) for i in range(30)}
    assert linededup.drop_lines(df.where("doc_id < 0")).count() == 0


def test_line_dedup_judges_small_hosts(spark):
    rows = [(100 * n + i, f"h{n}", f"menu\nown {i}") for n in (1, 2, 3, 19) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in linededup.drop_lines(df).collect()}
    assert got == {i: t if h == "h1" else t[5:] for i, h, t in rows}


def test_line_dedup_and_its_stage_keep_any_column(spark):
    import corpus_pipeline

    names = ["__p", "__kept", "__s", "__host", "__drop", "__first", "row", "lines", "kept", "salt", "its", "n_lines", "n.dots"]
    rows = [(i, f"menu\nown {i}", "s", 0, *range(len(names))) for i in range(6)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, n_chars long, {', '.join(f'`{n}` int' for n in names)}")
    for bound in (linededup.BROADCAST_ROWS, 0):
        old, linededup.BROADCAST_ROWS = linededup.BROADCAST_ROWS, bound
        got = linededup.drop_lines(df)
        assert {tuple(r) for r in got.select("doc_id", "text", *(f"`{n}`" for n in names if n != "n_lines")).collect()} == {(i, f"own {i}", *(k for k, n in enumerate(names) if n != "n_lines")) for i in range(6)}
        linededup.BROADCAST_ROWS = old
    staged = corpus_pipeline.lines(spark, df, "")
    assert staged.columns == df.columns and {tuple(r) for r in staged.collect()} == {(i, f"own {i}", "s", len(f"own {i}"), *range(len(names))) for i in range(6)}


def test_templates_without_inner_rows_do_not_meet(spark):
    """Sets of 400 words that share 320 to 355: no shingle of the template joins rows in which no set has it among its rarest."""
    rng = random.Random(14)
    for shared in (320, 340):
        template = prose(rng, shared)
        rows = [(i, f"{template} {prose(rng, 400 - shared, tuple('abcdefgh'))}") for i in range(400)]
        df = spark.createDataFrame(rows, "id long, text string")
        pairs = neardup.rare_pairs(df, df.select("id", F.col("id").alias("component")), neardup.features(df, 4, "id", "text"), 4, 80)
        assert pairs.count() < 100


def test_decontamination(spark, docs, cases):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate((40, 20, 15, 7, 3))] + [(9, None), (10, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def changed(text, every):
        return " ".join("other" if i % every == every - 1 else w for i, w in enumerate(text.split()))

    fill = lambda: prose(rng, 60, ("uno", "dos", "tres"))
    texts = [
        f"{fill()} {items[0][1]} {fill()}", f"{fill()} {changed(items[0][1], 7)} {fill()}", f"{fill()} {' '.join(items[0][1].split()[:10])} {fill()}", f"{items[1][1].upper()}!", items[2][1].replace(" ", " ,  "),
        f"{fill()} {items[3][1]}", f"{fill()} {items[4][1]} {fill()}", changed(items[1][1], 2), " ".join(items[0][1].split()[5:25]), None, "", f"{items[0][1]} {items[1][1]}",
    ]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(0, fill(), 1, 2)], "doc_id long, text string, item long, d long")
    judged = decontam.judge(df, decontam.overlaps(df, bench)).collect()
    got = {r.doc_id: r["items"] for r in judged}
    assert got == {0: "0", 1: "0", 2: "", 3: "1", 4: "2", 5: "3", 6: "4", 7: "", 8: "0", 9: "", 10: "", 11: "0,1"} and len(judged) == len(texts) + 1
    left = decontam.clean(df, bench)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [2, 7, 9, 10]
    assert {r.doc_id for r in decontam.overlaps(df, bench, least_words=5).collect()} == {0, 1, 3, 4, 5, 8, 11}
    old = decontam.BROADCAST_ROWS, decontam.HIT_ROWS
    decontam.BROADCAST_ROWS = decontam.HIT_ROWS = 0  # the same by shuffles
    assert {r.doc_id: r["items"] for r in decontam.judge(df, decontam.overlaps(df, bench)).collect()} == got
    decontam.BROADCAST_ROWS, decontam.HIT_ROWS = old
    assert decontam.overlaps(docs, bench.where("item_id = 10")).count() == 0
    assert decontam.overlaps(docs.where("doc_id < 0"), bench).count() == 0


def test_decontamination_misses_no_overlap(spark):
    """Every change that leaves 80 % of an item is found, and no change of one word more."""
    rng, items, texts = random.Random(16), [], []
    for n in range(1, 14):
        words, most = [f"w{n}x{j}" for j in range(n)], n - math.ceil(decontam.AGREE * n)
        items.append((n, " ".join(words)))
        for k, good in ((most, True), (most + 1, False)):
            for gone in itertools.combinations(range(n), k) if good else [rng.sample(range(n), k)]:
                texts.append((f"uno dos {' '.join('other' if j in gone else w for j, w in enumerate(words))} tres", n if good else None))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = decontam.overlaps(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, n) for i, (_, n) in enumerate(texts) if n}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_decontamination_equals_search_without_seeds(spark):
    docs, bench = (queries.read(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    ids: dict[str, int] = {}

    def words(text):
        clean = "".join(c for c in (text or "").lower() if c in " \t\n\x0b\f\r" or unicodedata.category(c)[0] in "LN")
        return np.array([ids.setdefault(w, len(ids)) for w in clean.split()], int)

    expected, items = set(), [(r.item_id, words(r.text)) for r in bench.collect()]
    for r in docs.select("doc_id", "text").collect():
        d = words(r.text)
        for item, b in items:
            w = min(decontam.WINDOW, len(b))
            if len(b) and len(d) >= w:
                ext = np.concatenate([np.full(len(b), -1), d, np.full(len(b), -1)])
                same = np.lib.stride_tricks.sliding_window_view(ext, len(b)) == b
                sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), 1)
                if (sums[:, w:] - sums[:, :-w]).max() >= math.ceil(decontam.AGREE * w):
                    expected.add((r.doc_id, item))
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()} == expected and expected


def brute_components(cases, width):
    def sets(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    own = [(i, sets(t)) for i, t in cases]
    par = {i: i for i, _ in own}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for n, (i, a) in enumerate(own):
        for j, b in own[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                par[y] = x
    return Counter((i, len(s), root(i), root(i) == i) for i, s in own)


def test_near_duplicates(spark, docs, cases):
    assert table(neardup.near_duplicates(docs.where("doc_id is not null"), width=4)) == brute_components([c for c in cases if c[0] is not None], 4)
    rng = random.Random(8)
    base, rows = prose(rng, 130).split(), []
    for i in range(90):  # a cloud of copies around one text, with a few changes each
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, prose(rng, 40)) for i in range(20)] + [(200 + i, rows[3][1]) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert table(neardup.near_duplicates(df, width=4)) == brute_components(rows, 4)
    assert table(neardup.near_duplicates(df, width=4, exact=True)) == brute_components(rows, 4)
    assert neardup.near_duplicates(df.where("doc_id < 0")).count() == 0
    kept = neardup.drop_copies(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, _, k in brute_components(rows, 5) if k)


def test_templates_make_few_pairs(spark):
    """Texts that share a template below the least similarity don't meet, and those that link do."""
    rng = random.Random(12)
    template = prose(rng, 280)
    rows = [(i, f"{template} {prose(rng, 120, tuple('abcdefgh'))}") for i in range(400)]
    rows += [(1000 + i, t.replace(t.split()[7], "other", 1)) for i, t in rows[:5]]
    df = spark.createDataFrame(rows, "id long, text string")
    pairs = neardup.rare_pairs(df, df.select("id", F.col("id").alias("component")), neardup.features(df, 4, "id", "text"), 4, 80)
    got = {tuple(r) for r in pairs.collect()}
    assert {(i, 1000 + i) for i in range(5)} <= got and len(got) < 100
    found = neardup.near_duplicates(df.withColumnRenamed("id", "doc_id"), width=4)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i % 1000 for i, _ in rows}


def test_rare_pairs_miss_no_link(spark):
    rng = random.Random(13)
    for percent, words in ((80, 30), (50, 25), (80, 6)):
        rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, words)))) for i in range(150)]
        df = spark.createDataFrame(rows, "id long, text string")
        got = {tuple(r) for r in neardup.rare_pairs(df, df.select("id", F.col("id").alias("component")), neardup.features(df, 2, "id", "text"), 2, percent).collect()}
        sets = {i: frozenset(neardup.shingles(t, 2, {}).tolist()) for i, t in rows}
        need = {(i, j) for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
        assert need <= got and need


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(500, 530)]
    par = {}

    def root(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        par[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for p in links for x in p if p[0] != p[1]} | {x: root(x) for x in got}


def test_toxicity(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80) + (" vile" + rng.choice("abc") + " nasty " if i % 5 == 0 else " ") + prose(rng, 40), int(i % 5 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 400"))
    scored = {r.doc_id: r for r in toxicity.score(df.unionByName(spark.createDataFrame([(1000, None, 0), (1001, "", 1)], df.schema)), model).collect()}
    wrong = sum((scored[i].score >= 0.3) != y for i, _, y in rows if i >= 400)
    assert wrong <= 2 and all(0 <= r.score <= 1 for r in scored.values())
    assert scored[1000].score == scored[1001].score == min(r.score for r in scored.values())
    place = scored[400].passages
    assert place and any(p.first <= 81 <= p.end for p in place)
    flat = toxicity.fit(df.where("toxic = 0"))
    assert all(r.score < 0.3 for r in toxicity.score(df, flat).collect())
    assert all(r.score < 0.3 for r in toxicity.score(df, toxicity.fit(df.where("doc_id < 0"))).collect())


def test_language_id(spark):
    rng = random.Random(4)
    words = {"de": "der und nicht schön über gehen wir", "en": "the and not with them going we", "fr": "le et pas avec être vous nous", "es": "el y no con señor vosotros niño"}
    rows = [(i, " ".join(rng.choice(words[c].split()) for _ in range(30)), c) for i, c in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1000, None, "de"), (1001, "123 !", None), (1002, "", "x"), (1003, rows[0][1] * 500, None)], df.schema)
    model = langid.fit(df.where("doc_id % 3 > 0"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df.unionByName(odd), model).collect()}
    assert sum(got[i][0] != c for i, _, c in rows if i % 3 == 0) == 0
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3 and got[1003][0] == "de"
    kept = langid.keep(df.unionByName(odd), model)
    assert kept.columns == df.columns and kept.count() == len(rows) + 1
    one = langid.fit(df.where("lang = 'fr'"))
    assert {r.lang_pred for r in langid.predict(df, one).collect()} == {"fr"}
    assert {r.lang_pred for r in langid.predict(df, langid.fit(df.where("doc_id < 0"))).collect()} == {"und"}


def test_html_extraction(spark):
    page = "<html><body><nav><a>m</a></nav><article><h1>Head</h1><p>Some words here and more.</p></article><footer>f</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = table(html_extract.extract(df, html_extract.fit(df)))
    assert got == {(1, "u", "Head\nSome words here and more."): 2, (2, None, ""): 1, (3, "u", ""): 1}
    assert html_extract.extract(df.where("page_id > 9"), html_extract.fit(df.where("page_id > 9"))).count() == 0


def test_pipeline(spark, tmp_path, docs, cases):
    import corpus_pipeline

    rng = random.Random(9)
    words = {"de": "der und nicht schön über gehen wir", "en": "the and not with them going we"}
    item = prose(rng, 30)
    text = {i: " ".join(rng.choice(words[c].split()) + rng.choice("abc") for _ in range(60)) for i, c in enumerate(["de", "en"] * 40)}
    rows = [(i, ("common line\n" if i % 2 else "") + t, ["de", "en"][i % 2], "s", len(t)) for i, t in text.items()]
    rows += [(100, text[4], "de", "s", 1), (101, "12 34", "en", "s", 5), (102, None, "en", "s", None), (103, f"{text[6]} {item}", "de", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(text)
    for i, t in text.items():
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
