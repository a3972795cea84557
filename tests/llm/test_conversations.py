"""The prefix trie and the repair of conversations against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lacegraph.llm import conv_repair, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, place int, `__at` int, key string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(text):
    return zlib.crc32(text.encode())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], TURNS)


def random_rows(rng, n, most):
    texts = ["Yes.", "No", "", " \t", "why?", "é漢😀!", "a\nb.", "x" * 3000 + "."]
    out = []
    for c in rng.sample(range(-40, 200), n):
        for t in range(rng.randint(1, most)):
            out.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice([*texts, None])))
    return out + [out[0]] * 3


def digest(text):
    return hashlib.sha256(text.encode()).digest()


def plain_trie(rows, graft):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", digest(f"{len(r or '')}:{r or ''}{x or ''}"), x or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in own.items()}
    held = {}
    for c, turns in own.items():
        h, base = crc(str(c)) % 9 if graft else 0, c - abs(c) % 5 * (1 if c >= 0 else -1)
        held[c] = own.get(base, [])[:h] + turns[h:] if graft else turns
    members = defaultdict(list)
    for c in sorted(held):
        for d in range(len(held[c]) + 1):
            members[tuple(held[c][:d])].append(c)
    below = defaultdict(list)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    out, sums = Counter(), {}
    for k in sorted(members, key=len, reverse=True):
        m, kids = members[k], below[k]
        bytes_saved = (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        sums[k] = sum(sums[x][0] for x in kids) or 1, bytes_saved + sum(sums[x][1] for x in kids)
        ends = ",".join(str(c) for c in m if len(held[c]) == len(k))
        out[m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids), *sums[k], sha(ends)] += 1
    return out


@pytest.mark.parametrize("seed", [0])
def test_trie(spark, seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 60, 6)
    rows += [(c, t, "user", f"turn {t}.") for c in range(300, 340) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "x"), (None, 1, "user", "y")]
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(table(spark, rows), prefix_trie.rebuilt).collect())
    assert got == plain_trie(rows, True)
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(table(spark, rows)).collect()) == plain_trie(rows, False)


def test_trie_of_copies_chains_and_ranges(spark, monkeypatch):
    """Thousands of conversations that end in one node, in pieces; one long conversation alone; one conversation only."""
    monkeypatch.setattr(prefix_trie, "IDS_A_PIECE", 7)
    rows = [(5 * c, t, "user", f"{t}") for c in range(700) for t in range(3)] + [(9000, t, "user", f"long {t}") for t in range(900)]
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(table(spark, rows)).collect()) == plain_trie(rows, False)
    for one in ([(7, 0, "user", "x")], [(7, None, None, None), (7, 1, None, None)]):
        for graft in (False, True):
            got = prefix_trie.prefix_trie(table(spark, one), prefix_trie.rebuilt if graft else prefix_trie.whole)
            assert Counter(tuple(r) for r in got.collect()) == plain_trie(one, graft)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(table(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(table(spark, [(None, 1, "user", "x")]), prefix_trie.rebuilt).count() == 0


NEXT, KEPT = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def every_audit(rows):
    """The cheapest, then least, of all edits of (initial, kind) rows."""
    found, most = [], 2 * len(rows)  # deleting all is allowed

    def go(i, state, cost, audit, run):
        if cost > most:
            return
        if i == len(rows) and state in (0, 3):
            found.append((cost, audit))
        if run < 4:
            go(i, NEXT[state], cost + 5, audit + "I", run + 1)
        if i == len(rows):
            return
        initial, kind = rows[i]
        go(i + 1, state, cost + 2, audit + "D", 0)
        if kind != "d":
            more = 5 * (kind == "t")
            if (state, initial) in KEPT:
                go(i + 1, KEPT[state, initial], cost + more, audit + "K", 0)
            go(i + 1, NEXT[state], cost + more + 1, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return min(found)


def best_strings(rows):
    """The same with one whole audit for each state, for longer conversations."""
    states = {0: (0, "")}
    for initial, kind in rows:
        new = {}
        for at, (cost, audit) in states.items():
            for run in range(4):
                ways = [(at, 2, "D")]
                if kind != "d":
                    ways += [(KEPT.get((at, initial)), 5 * (kind == "t"), "K")] * ((at, initial) in KEPT) + [(NEXT[at], 1 + 5 * (kind == "t"), "R")]
                for to, more, edit in ways:
                    value = cost + 5 * run + more, audit + "I" * run + edit
                    new[to] = min(new.get(to, value), value)
                at = NEXT[at]
        states = new
    done = []
    for at, (cost, audit) in states.items():
        for run in range(4):
            if at in (0, 3):
                done.append((cost + 5 * run, audit + "I" * run))
            at = NEXT[at]
    return min(done)


def in_pieces(rng, text):
    cuts = sorted(rng.sample(range(len(text) + 1), rng.randint(0, min(3, len(text)))))
    parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
    return conv_repair.cheapest([(p, conv_repair.through(p)) for p in parts])


def test_repair_is_cheapest_and_least():
    rng = random.Random(5)
    for _ in range(1200):
        rows = [(rng.choice("suaouaua"), rng.choice("nnnntd")) for _ in range(rng.randint(0, 6))]
        assert every_audit(rows) == best_strings(rows) == in_pieces(rng, "".join(map(conv_repair.LETTER.get, rows))), rows
    for _ in range(200):
        rows = [(rng.choice("suaouaua"), rng.choice("nnnntd")) for _ in range(rng.randint(20, 90))]
        assert best_strings(rows) == in_pieces(rng, "".join(map(conv_repair.LETTER.get, rows))), rows


def plain_damage(rows):
    out = []
    for c, t, r, x in rows:
        fault = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        r, x = " " if r is None else r, " " if x is None else x
        if fault:
            x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
            out += [(c, t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
    return out


def plain_report(rows, ids):
    held = {c: [] for c in ids}
    for row in rows:
        held[row[0]].append(row)
    out, turns = Counter(), Counter()
    for c, v in held.items():
        v = sorted(v, key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[3])))
        seen, kinds, faults = set(), [], Counter()
        for _, _, r, x in v:
            end = x.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((r, x))
            faults[fault] += 1
            kinds.append((r[0] if r and r[0] in "sua" else "o", {"": "n", "truncated": "t"}.get(fault, "d")))
        known = [t for _, t, _, _ in v if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(v, v[1:]))
        cost, audit = best_strings(kinds)
        lines, state, rest = [], 0, iter(v)
        for edit in audit:
            if edit == "I":
                state = NEXT[state]
                lines.append((edit, "user" if state == 2 else "assistant", ""))
                continue
            *_, r, x = next(rest)
            if edit != "D":
                state = KEPT[state, r[0]] if edit == "K" else NEXT[state]
                lines.append((edit, r if edit == "K" else "user" if state == 2 else "assistant", x))
        out[c, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{x}" for _, r, x in lines))] += 1
        turns.update((c, i, *line) for i, line in enumerate(lines))
    return out, turns


@pytest.mark.parametrize("seed, piece", [(1, 1 << 14), (2, 3), (3, 1)])
def test_repair(spark, seed, piece, monkeypatch):
    monkeypatch.setattr(conv_repair, "PIECE_ROWS", piece)
    rows = random_rows(random.Random(seed), 80, 12) + [(None, t % 4, "user", f"{t % 3}.") for t in range(20)] + [(None, None, None, None)]
    rows += [(1000, t, ("user", "assistant")[t % 2], f"t{t // 5}.") for t in range(400)]
    turns = table(spark, rows)
    damaged = conv_repair.damage(turns)
    assert Counter(tuple(r) for r in damaged.collect()) == Counter(plain_damage(rows))
    expected, _ = plain_report(plain_damage(rows), {r[0] for r in rows})
    assert Counter(tuple(r) for r in conv_repair.report(damaged, turns).collect()) == expected
    expected, lines = plain_report([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})
    assert Counter(tuple(r) for r in conv_repair.report(turns).collect()) == expected
    assert Counter(tuple(r) for r in conv_repair.repaired(turns).collect()) == lines


def test_repair_of_nothing(spark):
    nothing = table(spark, [])
    assert conv_repair.report(nothing).count() == conv_repair.repaired(nothing).count() == 0
    ids = table(spark, [(4, 0, "user", "x"), (4, 1, "user", "x")])
    assert [tuple(r) for r in conv_repair.report(nothing, ids).collect()] == [(4, 0, 0, 0, 0, 0, 0, "", sha(""))]
