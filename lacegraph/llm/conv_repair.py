"""Conversation structure repair: a rank-compressed dynamic programme over macro edits.

The cheapest edits turn a conversation's rows into one whose role initials are ``(s?(ua)+)?``, and among equally cheap ones
the audit string of their initials is the least. A macro edit is a run of insertions and one edit of a row: the codes
D, ID, IID, IIK, IIR, IK, IR, K, R, in their order. No code begins another one, so audits of equally many rows compare like
their sequences of codes. A layer of the programme therefore needs no audit: for each state of the automaton (start, after
s, after u, after a) it holds the cost and the rank of the least audit among the layer's states, and a next layer's rank
follows from the rank of the state before and the code's place. Edits are read back from the parent pointers.

Such a layer composes: for a piece of a conversation, cost and rank from each state to each state are all that its
surroundings need. Rows are sorted in ranges of (conversation, turn, role, digest) and each range is cut into pieces of
bounded length, on which the programme runs on its own, so no task needs all rows of a conversation there; the pieces'
tables are then put together in order. Only a conversation's audit, one byte a row, and its digest, which is sequential by
nature and streamed, are made in one place. Texts are shuffled once, for the digest or the repaired turns.

Defined results: null roles and texts are one space; rows of one turn are ordered by role and then by digest, a null turn
first; repeated rows are duplicates but the first; very long texts are read whole; a null conversation id is one
conversation; other columns are ignored; a conversation without rows has zeros, an empty audit and the empty text; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, map_stream

#: Rows of a piece of a conversation.
PIECE_ROWS = 1 << 14
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # costs
START, AFTER_S, AFTER_U, AFTER_A = STATES = range(4)
SPACE = " \t\n\x0b\x0c\r"

#: A row as one letter: the initial of its role, and whether it is in order, truncated, or has to go.
INITIALS, KINDS = "suao", "ntd"
LETTER = {(i, k): chr(ord("A") + 3 * n + m) for n, i in enumerate(INITIALS) for m, k in enumerate(KINDS)}
_MEANS = {letter: what for what, letter in LETTER.items()}
_NEXT = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # where an insertion or a new role leads
_KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}


def _macros(letter: str) -> dict[int, dict[int, tuple[int, int, str]]]:
    """For each state, (cost, place of the code, code) of the best macro edit of a row to each state.

    Three insertions lead where one does, so a run has two at most.
    """
    initial, kind = _MEANS[letter]
    codes = sorted("I" * n + edit for n in range(3) for edit in "DKR")
    best: dict[int, dict[int, tuple[int, int, str]]] = {q: {} for q in STATES}
    for q in STATES:
        for place, code in enumerate(codes):
            at = q
            for _ in code[:-1]:
                at = _NEXT[at]
            edit, cost = code[-1], INSERT * (len(code) - 1)
            if edit == "D":
                to, cost = at, cost + DELETE
            elif kind == "d":
                continue
            else:
                to = _KEPT.get((at, initial)) if edit == "K" else _NEXT[at]
                cost += (KEEP if edit == "K" else REROLE) + TRUNCATED * (kind == "t")
            if to is not None:
                best[q][to] = min(best[q].get(to, (cost, place, code)), (cost, place, code))
    return best


MACROS = {letter: _macros(letter) for letter in _MEANS}


def _ranked(found: dict[int, tuple], order) -> dict[int, int]:
    return {q: rank for rank, q in enumerate(sorted(found, key=order))}


def _layers(rows: str, start: int) -> Iterator[tuple[dict[int, tuple[int, int, str]], dict[int, int]]]:
    """For each row, (cost, state before, code) and rank of each state that is reached from ``start``."""
    cost, rank = {start: 0}, {start: 0}
    for letter in rows:
        found: dict[int, tuple[int, tuple[int, int], int, str]] = {}
        for q, spent in cost.items():
            for to, (more, place, code) in MACROS[letter][q].items():
                new = (spent + more, (rank[q], place), q, code)
                if to not in found or new < found[to]:
                    found[to] = new
        rank = _ranked(found, lambda to: found[to][1])
        cost = {to: x[0] for to, x in found.items()}
        yield {to: (x[0], x[2], x[3]) for to, x in found.items()}, rank


def _through(rows: str) -> tuple[tuple[tuple[int, int] | None, ...], ...]:
    """(cost, rank) of a piece from each state to each state, or None."""
    out = []
    for q in STATES:
        layer, rank = {q: (0, q, "")}, {q: 0}
        for layer, rank in _layers(rows, q):
            pass
        out.append(tuple((layer[to][0], rank[to]) if to in layer else None for to in STATES))
    return tuple(out)


def _edits(rows: str, start: int, end: int) -> str:
    """The audit of a piece between two states, by its parent pointers."""
    layers, codes, at = [layer for layer, _ in _layers(rows, start)], [], end
    for layer in reversed(layers):
        _, at, code = layer[at]
        codes.append(code)
    return "".join(reversed(codes))


_short_through, _short_edits = lru_cache(1 << 14)(_through), lru_cache(1 << 14)(_edits)


def through(rows: str):
    return _short_through(rows) if len(rows) <= 64 else _through(rows)


def edits(rows: str, start: int, end: int) -> str:
    return _short_edits(rows, start, end) if len(rows) <= 64 else _edits(rows, start, end)


def cheapest(pieces: list[tuple[str, tuple]]) -> tuple[int, str]:
    """(cost, audit) of pieces (rows, their table) in order."""
    cost, rank, back = {START: 0}, {START: 0}, []
    for _, table in pieces:
        found: dict[int, tuple[int, tuple[int, int], int]] = {}
        for q, spent in cost.items():
            for to in STATES:
                if table[q][to] is not None:
                    new = (spent + table[q][to][0], (rank[q], table[q][to][1]), q)
                    if to not in found or new < found[to]:
                        found[to] = new
        rank = _ranked(found, lambda to: found[to][1])
        cost = {to: x[0] for to, x in found.items()}
        back.append({to: x[2] for to, x in found.items()})
    closing = {START: 0, AFTER_A: 0, AFTER_U: 1, AFTER_S: 2}  # insertions at the end
    total, _, at = min((spent + INSERT * closing[q], rank[q], q) for q, spent in cost.items())
    audit = ["I" * closing[at]]
    for (rows, _), before in zip(reversed(pieces), reversed(back)):
        audit.append(edits(rows, before[at], at))
        at = before[at]
    return total, "".join(reversed(audit))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with planted faults by CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its
    text, 2 takes out ``[.!?]``, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("role", "text"))
    fault = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn"))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("__fault")).where("__fault <> 0")
    changed = F.when(F.col("__fault") == 1, "").when(F.col("__fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("__fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("__fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("__copy")).drop("__copy")


def _pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces of sorted (conv, turn, role, digest, initial, truncated, blank, first, copies)."""
    part = TaskContext.get().partitionId()
    for conv, group in groupby(rows, key=lambda r: r[0]):
        letters, faults, turns, n = [], [0, 0, 0], [], 0

        def piece():
            text = "".join(letters)
            got = (conv, part, n, text, [x for row in through(text) for cell in row for x in (cell or (-1, -1))], *faults, len(turns), min(turns, default=None), max(turns, default=None))
            letters.clear(), turns.clear()
            faults[:] = 0, 0, 0
            return got

        for _, turn, _, _, initial, truncated, blank, first, copies in group:
            if turn is not None and (not turns or turns[-1] != turn):
                turns.append(turn)
            initial = initial if initial and initial in INITIALS[:3] else "o"
            for copy in range(copies):
                later = copy > 0 or not first
                kind = "d" if blank or later else "t" if truncated else "n"
                faults[0 if blank else 1 if later else 2] += kind != "n"
                letters.append(LETTER[initial, kind])
                if len(letters) == PIECE_ROWS:
                    yield piece()
                    n += 1
                    if turn is not None:
                        turns.append(turn)
        if letters:
            yield piece()


_LEGAL = {(a, b) for a, b in ("su", "ua", "au")}


def _judged(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation's pieces in order."""
    for conv, group in groupby(rows, key=lambda r: r[0]):
        pieces, faults, distinct, low, high, illegal, last = [], [0, 0, 0], 0, None, None, 0, None
        for _, _, _, letters, table, blank, duplicate, truncated, n_turns, first, final in group:
            cells = [tuple(table[i : i + 2]) if table[i] >= 0 else None for i in range(0, 32, 2)]
            pieces.append((letters, tuple(tuple(cells[4 * q : 4 * q + 4]) for q in STATES)))
            faults = [a + b for a, b in zip(faults, (blank, duplicate, truncated))]
            if n_turns:
                distinct += n_turns - (high == first)  # a turn may go on in the next piece
                low, high = first if low is None else low, final
            for letter in letters:
                initial = _MEANS[letter][0]
                illegal += last is not None and (last, initial) not in _LEGAL
                last = initial
        yield conv, high - low + 1 - distinct if distinct else 0, *faults, illegal, *cheapest(pieces)


def judge(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of conversations with rows."""
    keys = ["conv", "turn", "role", "digest"]
    end = F.rtrim("text", F.lit(SPACE))
    seen = rows.select(*keys, (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    once = scratch.put(seen.groupBy(*keys).agg(F.first("blank").alias("blank"), F.first("truncated").alias("truncated"), F.count("*").alias("copies")), "once")
    turn = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    said = once.where("not blank").groupBy(F.col("conv").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d")).agg(F.min(turn).alias("__turn"))
    same = F.col("conv").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d"))
    marked = once.join(said, same, "left").withColumn("first", F.coalesce(turn.eqNullSafe(F.col("__turn")), F.lit(True)))
    ordered = marked.select(*keys, F.left("role", F.lit(1)).alias("initial"), "truncated", "blank", "first", "copies").repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = "conv long, part int, piece int, letters string, table array<long>, blank long, duplicate long, truncated long, n_turns long, first long, final long"
    pieces = map_stream(ordered, _pieces, schema)
    joined = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    return map_stream(joined, _judged, f"conv long, {', '.join(f'{n} long' for n in COUNTS)}, audit string", rows=64)


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the audit makes of a conversation's rows."""
    state = START
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            yield edit, "user" if state == AFTER_U else "assistant", ""
            continue
        role, text = next(rows)
        if edit == "D":
            continue
        state = _KEPT[state, role[0]] if edit == "K" else _NEXT[state]
        yield edit, role if edit == "K" else "user" if state == AFTER_U else "assistant", text


def _stream(digests: bool):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda r: r[0]):
            counts, audit, more = (0,) * len(COUNTS), "", None
            for row in group:
                if row[1] == 1:
                    counts, audit = row[6 : 6 + len(COUNTS)], row[-1]
                elif row[1] == 2:
                    more = row
                    break
            repaired = _turns(audit, ((r[3], r[5]) for r in (chain((more,), group) if more else ())))
            if digests:
                digest = hashlib.sha256()
                for i, (_, role, text) in enumerate(repaired):
                    digest.update(f"{'\n' if i else ''}{role}:{text}".encode())
                for _ in group:
                    pass
                yield conv, *counts, audit, digest.hexdigest()
            else:
                for i, turn in enumerate(repaired):
                    yield conv, i, *turn

    return run


def _repair(conversations: DataFrame, ids: DataFrame, digests: bool) -> DataFrame:
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    scratch = Scratch(spark)
    try:
        judged = scratch.put(judge(rows, scratch), "judged")
        scratch.drop("once")
    except BaseException:
        scratch.drop()
        raise
    kind = lambda n: F.lit(n).alias("kind")
    both = rows.select("conv", kind(2), "turn", "role", "digest", "text")
    both = both.unionByName(judged.select("conv", kind(1), *COUNTS, "audit"), True).unionByName(ids.select(F.col("conv_id").cast("long").alias("conv"), kind(0)).distinct(), True)
    columns = ("conv", "kind", "turn", "role", "digest", "text", *COUNTS, "audit")
    joined = both.select(*columns).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "digest")
    if digests:
        return map_stream(joined, _stream(True), f"conv_id long, {', '.join(f'{n} long' for n in COUNTS)}, audit string, repaired_sha256 string")
    return map_stream(joined, _stream(False), "conv_id long, place long, edit string, role string, text string")


def report(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``conversations`` has conv_id, turn, role and text; ``ids`` (conv_id) names conversations that may have lost all rows.
    The table of audits in the scratch folder stays.
    """
    return _repair(conversations, conversations if ids is None else ids, True)


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of each conversation after its cheapest edits."""
    return _repair(conversations, conversations, False)
