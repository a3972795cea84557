"""Secret scan: assignment-aware lexing.

Source and configuration text is cut into comments, strings, names and operators, and a parser with a stack of open
brackets and indents turns these into pairs of a target's path and its literal: assignments, annotated ones too, entries
of objects and arrays, YAML and JSON nesting, named and positional arguments, subscripts, XML elements and attributes, and
``name``/``value`` neighbours. A right side that names an earlier target of the same or an outer scope takes over its
literals (constant propagation); concatenated ones are joined. Results of calls are no literals, but what a decoder or a
type's constructor is given is. Comments are read on their own, and so are strings that begin with a name and a sign; what an
f-string fills in doesn't count, and a bare identifier or a word with a mark behind it is no literal. A literal is scored by how sensitive the names on its
path are, the nearest most, and by how much it looks like a credential. Fixed patterns run beside it and their spans
always stay.

Defined results: a null or empty text has no spans; very long texts are read whole, in time proportional to their length;
offsets are code points, end exclusive; spans that start alike are listed by kind; equal rows give equal results; columns
other than the id and the text are ignored and never clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

# The base patterns, in the order in which equal starts are listed.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]{16,}")),
)
KINDS = ("assign", "access", "hex", "literal")
# Weight of a word in a target name.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "pass": 1.5, "secret": 3.0, "token": 2.5, "credential": 2.5,
    "credentials": 2.5, "apikey": 3.0, "auth": 1.5, "authorization": 2.0, "bearer": 2.0, "private": 1.5, "access": 1.0,
    "signing": 1.0, "encryption": 1.0, "client": 0.5, "api": 1.0, "key": 1.5, "salt": 1.0, "cert": 0.5, "conn": 0.5, "dsn": 1.0,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|changeme|example|dummy|test|null|none|true|false|todo|your[\w-]*|<.*>|\$\{.*\}|%\(.*\)s)$")
#: Least score of a literal that is reported, and the least length of one.
LEAST_SCORE, LEAST_LENGTH = 4.0, 8

#: What is left of a name's weight for each level further out on the path. A constant put together from earlier ones is
#: weighed as a whole up to so many characters; beyond, its own literals are weighed with the short ones among the earlier
#: constants, and each long one as it was.
OUTER, JOINED, SHORT = 0.8, 4096, 64
SCHEMES = {"bearer", "basic", "token"}  # words before a credential
# Calls that return what they are given, and neighbours that name and hold a value.
GIVERS = {"str", "string", "bytes", "bytearray", "b64decode", "atob", "decode", "from", "fromhex", "unhexlify", "secretstr", "char", "literal", "secret"}
NAMING, HOLDING = {"name", "key", "id", "k"}, {"value", "val", "v"}

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BARE = re.compile(r"""[^\s"'`,;#(){}\[\]<>|]++""")
_PATH = re.compile(r"[A-Za-z_$][A-Za-z_$]*+(?:[.\->:]++[A-Za-z_$][A-Za-z_$]*+)++")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.-]*+")
_LINE_END, _HOLE = re.compile(r"[ \t\r]*+(?:\n|\Z)"), re.compile(r"\{[^{}]*\}")
_NAMED = re.compile(r"[A-Za-z][\w.-]*+[ ]?[:=]")
_CODE = re.compile(r"_*[A-Za-z]+(?:_+[A-Za-z]+)+_*|[a-z]+(?:[A-Z][a-z]+)+|[A-Za-z]+[!?.]+")  # an identifier, or a word that ends a sentence
_LONGEST = max(map(len, GIVERS))
_ELEMENT = re.compile(r"[^<>]*+(?=</)")
_COMMENT = r"""(?P<block>/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))|(?P<line>(?<![^\s;{}(),])(?:\#|//|--[ ])[^\n]*+)|"""
_TOKEN = r"""(?P<nl>\n[ \t]*+(?:-[ ]++)*+)
    |(?P<str>(?:\b[rbfuRBFU]{1,2}|(?<!\w))(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*+(?:\"\"\"|\Z)|\'\'\'(?:[^'\\]|\\.|'(?!''))*+(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`))
    |(?P<elem></?[A-Za-z][\w.:-]*+)
    |(?P<name>[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+)
    |(?P<op>=>|:=|[=!<>]=|::|->|[=:+,;()\[\]{}>])"""
_LEX, _WITHIN = re.compile(_COMMENT + _TOKEN, re.X | re.S), re.compile(_TOKEN, re.X | re.S)
_CLOSES = {")": "(", "]": "[", "}": "{"}


def name_weight(name: str) -> float:
    words = dict.fromkeys(w.lower() for w in _WORDS.findall(name))
    return sum(SENSITIVE.get(w) or SENSITIVE.get(w.removesuffix("s"), 0.0) for w in words)


def under(outer: float, name: str) -> float:
    """The weight of a path from that of its outer part and its last name."""
    return max(name_weight(name), OUTER * outer)


def literal_weight(value: str) -> float:
    """Bits of entropy a character, plus what length and mixed character classes add."""
    n = len(value)
    if n < LEAST_LENGTH or PLACEHOLDER.match(value) or "://" in value and "@" not in value or _PATH.fullmatch(value):
        return -10.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(entropy, 4.0) / 2 + min(n, 32) / 32 + 0.5 * (classes - 1) - (1.5 if value.isalpha() else 0)


@dataclass(slots=True)
class Part:
    """A literal that stands in the text: its place and its value."""

    start: int
    end: int
    value: str


class Places:
    """Places of literals, and those of earlier constants; shared, never copied."""

    __slots__ = ("own", "of")

    def __init__(self, own: tuple[tuple[int, int], ...], of: tuple["Places", ...]):
        self.own, self.of = own, of


@dataclass(slots=True)
class Constant:
    """What a name was set to: its value if that is short, its weight once it was asked for, and its literals."""

    value: str | None
    weight: float | None
    places: Places

    def weigh(self) -> float:
        if self.weight is None:
            self.weight = literal_weight(self.value)
        return self.weight


@dataclass(slots=True)
class Frame:
    """What is open: a bracket or the whole text."""

    opened: str = ""
    path: float = 0.0  # the weight of the names that it stands under
    takes: bool = False  # bare literals in it belong to its path
    want: str | None = None  # the target whose right side is being read, and the weight of its path
    weight: float = 0.0
    parts: list[Part] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)  # the value, while it is short and known
    size: int = 0
    refs: dict[int, Constant] = field(default_factory=dict)
    first: str = ""  # the first literal argument, or the last name of a name and value pair
    known: set[str] = field(default_factory=set)  # the names that it sets
    base: str = ""  # the name before a subscript
    indents: list[tuple[int, float]] = field(default_factory=list)  # YAML mappings and the weights of their paths
    scopes: list[tuple[int, set[str]]] = field(default_factory=list)  # indented bodies, by their head's indent

    @property
    def held(self) -> bool:
        return bool(self.parts or self.refs or self.pieces)

    def clear(self) -> None:
        self.parts, self.pieces, self.size, self.refs = [], [], 0, {}

    def add(self, value: str | None) -> None:
        self.size += JOINED + 1 if value is None else len(value)
        if self.size <= JOINED:
            self.pieces.append(value)
        else:
            self.pieces.clear()


def _unquoted(text: str, start: int, end: int) -> Part:
    a = start
    while text[a] not in "\"'`":
        a += 1
    quote = text[a] * (3 if text[a : a + 3] in ('"""', "\'\'\'") and end - a >= 6 else 1)
    low, high = a + len(quote), max(a + len(quote), end - (len(quote) if text.endswith(quote, a + len(quote), end) else 0))
    value = text[low:high]
    return Part(low, high, _HOLE.sub("", value) if "f" in text[start:a].lower() else value)


class Reader:
    """One pass over a text's tokens; ``found`` are the spans of the literals that sensitive names hold."""

    def __init__(self, text: str, low: int = 0, high: int | None = None, found: set[tuple[int, int]] | None = None):
        self.text, self.low, self.high = text, low, len(text) if high is None else high
        self.found = set() if found is None else found
        self.known: dict[str, list[Constant]] = {}  # for each name what the open scopes set it to, the inmost last
        self.told: dict[int, Places] = {}  # places that were reported as a whole
        self.stack = [Frame()]
        self.indent = self.refused = 0
        self.read()

    def lookup(self, name: str) -> Constant | None:
        return self.known[name][-1] if self.known.get(name) else None

    def leave(self, names: set[str]) -> None:
        """A scope has ended."""
        for name in names:
            self.known[name].pop()

    def define(self, scope: set[str], name: str, constant: Constant) -> None:
        if name in scope:
            self.known[name][-1] = constant
        else:
            scope.add(name)
            self.known.setdefault(name, []).append(constant)

    def tell(self, constants: list[Constant]) -> None:
        """Report all places of constants, each only once."""
        todo = [x.places for x in constants]
        while todo:
            places = todo.pop()
            if id(places) not in self.told:
                self.told[id(places)] = places
                self.found.update(places.own)
                todo += places.of

    def judge(self, weight: float, part: Part) -> None:
        """Report one literal under names of some weight."""
        if weight > 0 and weight + literal_weight(part.value) >= LEAST_SCORE:
            self.found.add((part.start, part.end))

    def finish(self, frame: Frame) -> None:
        """The right side has ended."""
        name, parts, refs = frame.want, frame.parts, list(frame.refs.values())
        if name is not None and frame.held:
            if frame.size <= JOINED:
                constant = Constant("".join(frame.pieces), None, self.places(parts, refs))
            else:
                short = [x.value for x in refs if x.value is not None and len(x.value) <= SHORT]
                weights = [x.weigh() for x in refs if x.value is None or len(x.value) > SHORT]
                constant = Constant(None, max([literal_weight("".join([*(p.value for p in parts), *short])), *weights]), self.places(parts, refs))
            self.hold(frame.weight, constant, parts, refs)
            self.define(frame.scopes[-1][1] if frame.scopes else frame.known, name, constant)
            if name.lower() in NAMING:
                frame.first = constant.value or ""
            elif name.lower() in HOLDING and frame.first:
                self.hold(under(frame.path, frame.first), constant, parts, refs)
        frame.want = None
        frame.clear()

    @staticmethod
    def places(parts: list[Part], refs: list[Constant]) -> Places:
        return refs[0].places if len(refs) == 1 and not parts else Places(tuple((p.start, p.end) for p in parts), tuple(x.places for x in refs))

    def hold(self, weight: float, constant: Constant, parts: list[Part], refs: list[Constant]) -> None:
        """Report what a target of some weight is set to: what stands here as one span, and each literal of earlier names."""
        if weight > 0 and weight + constant.weigh() >= LEAST_SCORE:
            if parts:
                self.found.add((parts[0].start, parts[-1].end))
            self.tell(refs)

    def item(self, frame: Frame, part: Part) -> None:
        """A literal that no name stands before: an array's element or an argument."""
        if frame.takes:
            self.judge(under(frame.path, frame.first) if frame.opened == "(" and frame.first else frame.path, part)
        if frame.opened == "(" and not frame.first and _IDENTIFIER.fullmatch(part.value):
            frame.first = part.value

    def inside(self, part: Part) -> None:
        """A string may hold a name and its value itself, as headers and addresses of databases do."""
        if self.low == 0 and _NAMED.match(self.text, part.start, part.end):
            Reader(self.text, part.start, part.end, self.found)

    def bare(self, frame: Frame, at: int) -> int:
        """An unquoted right side at a place; where it ends."""
        while at < self.high and self.text[at] in " \t":
            at += 1
        m = _BARE.match(self.text, at, self.high) if at >= self.refused and self.text[at : at + 1] != "+" else None
        if not m:
            return at
        value = m.group().rstrip(":")
        after = self.text[m.end() : min(m.end() + 1, self.high)]
        got = self.lookup(value)
        if got is not None:
            frame.refs[id(got)] = got
            frame.add(got.value)
            return m.end()
        if value.lower() in SCHEMES and after == " " and (then := _BARE.match(self.text, m.end() + 1, self.high)):
            at, m, value, after = m.end() + 1, then, then.group(), self.text[then.end() : min(then.end() + 1, self.high)]
        if after not in ("(", "[", "{", '"', "'", "`"):
            if not _CODE.fullmatch(value):
                frame.parts.append(Part(at, at + len(value), value))
            frame.add(value)
            return m.end()
        self.refused = m.end()  # what begins within it ends alike
        return at

    def caller(self, end: int) -> str:
        """The name that ends before a bracket, if it is no longer than those of ``GIVERS``."""
        start = end
        while start > self.low and end - start <= _LONGEST and (self.text[start - 1].isalnum() or self.text[start - 1] == "_"):
            start -= 1
        return self.text[start:end]

    def read(self) -> None:
        text = self.text
        before, name, skip = "", "", -1  # the kind of the last token, and the name that an operator would assign to
        tokens = (_WITHIN if self.low else _LEX).finditer(text, self.low, self.high)
        m = next(tokens, None)
        while m is not None:
            kind, (start, end), m = m.lastgroup, m.span(), next(tokens, None)
            if start < skip:
                continue
            frame = self.stack[-1]
            if kind in ("line", "block"):
                lead = 1 if text[start] == "#" else 2 if kind == "line" or text[start] == "/" else 4
                Reader(text, start + lead, end, self.found)
                continue
            if kind == "nl":
                if before == "assign" and frame.want is not None and not frame.held and not frame.opened:
                    frame.indents.append((self.indent, frame.weight))  # a YAML mapping
                    frame.want = None
                elif before not in ("assign", "join"):
                    self.finish(frame)
                if not frame.opened:
                    dash = text[end - 2 : end] == "- "
                    self.indent = end - start - 1
                    while frame.indents and frame.indents[-1][0] >= self.indent:
                        frame.indents.pop()
                    while frame.scopes and frame.scopes[-1][0] >= self.indent and end < self.high and text[end] != "\n":
                        self.leave(frame.scopes.pop()[1])
                    if dash:
                        frame.first = ""
                        if frame.indents and (entry := _BARE.match(text, end, self.high)) and ":" not in entry.group() and _LINE_END.match(text, entry.end(), self.high):
                            self.judge(frame.indents[-1][1], Part(*entry.span(), entry.group()))
                before = "nl" if before not in ("assign", "join") else before
                continue
            token = text[start:end]
            if kind == "str":
                part = _unquoted(text, start, end)
                self.inside(part)
                if frame.want is not None and before in ("assign", "join", "str", "given"):
                    frame.parts.append(part)
                    frame.add(part.value)
                    before = "str"
                    continue
                self.finish(frame)
                if m is not None and m.lastgroup == "op" and m.group() in (":", "=>", "="):
                    name = part.value
                else:
                    self.item(frame, part)
                    name = part.value if frame.opened == "[" and frame.base else ""
                before = "str"
            elif kind in ("name", "elem"):
                if kind == "elem":
                    self.finish(frame)
                    frame.first, name = "", token.lstrip("</")
                    before = "open element" if token[1] != "/" else "elem"
                    continue
                if frame.want is not None and before == "join":
                    skip = self.bare(frame, start)
                    before = "value"
                    continue
                if frame.want is not None and before not in ("assign",):
                    self.finish(frame)
                if token in ("def", "class", "function", "func", "fn") and not frame.opened:
                    frame.scopes.append((self.indent, set()))
                name = token
                before = "in element" if before in ("open element", "in element") else "name"
            elif token in ("=", ":", "=>", ":="):
                if not name:
                    before = "op"
                    continue
                if token == "=" and frame.want is not None and (before == "name" or before == "value"):
                    frame.clear()  # a name with its type before the sign
                else:
                    self.finish(frame)
                    frame.want, frame.weight = name, under(frame.indents[-1][1] if frame.indents and not frame.opened else frame.path, name)
                skip = self.bare(frame, end)
                before = "value" if skip > end and frame.held else "assign"
            elif token == "+":
                before = "join" if frame.want is not None else "op"
            elif token in (",", ";"):
                self.finish(frame)
                before, name = "op", ""
            elif token in "([{":
                deep = Frame(token, frame.path)
                if frame.want is not None and before == "assign" and (token != "(" or not name or text[start - 1 : start] in " =:("):
                    deep.path, deep.takes = frame.weight, True
                elif token == "(" and frame.want is not None and before in ("assign", "name"):
                    gives = self.caller(start).lower() in GIVERS
                    deep.path, deep.takes = (frame.weight, True) if gives else (0.0, False)
                elif token == "(" and before in ("name", "in element"):
                    deep.path, deep.takes = under(frame.path, name), True
                elif token == "[" and before == "name" and text[start - 1 : start] not in " \t":
                    deep.base = name
                elif token != "(":
                    deep.takes = frame.takes
                self.stack.append(deep)
                before, name = "op", ""
            elif token in _CLOSES:
                if len(self.stack) > 1 and frame.opened == _CLOSES[token]:
                    self.finish(frame)
                    self.leave(self.stack.pop().known)
                    name = f"{frame.base}.{name}" if frame.base else ""
                    before = "name" if frame.base else "close"
                else:
                    before, name = "op", ""
            elif token == ">":
                if before in ("open element", "in element", "str") and name and text[end - 2] != "/":
                    self.finish(frame)
                    if before == "open element" and (held := _ELEMENT.match(text, end, self.high)) and (value := held.group().strip()):
                        at = text.index(value, end)
                        self.judge(under(frame.path, name), Part(at, at + len(value), value))
                before, name = "op", ""
            else:
                self.finish(frame)
                before, name = "op", ""
        for frame in self.stack:
            self.finish(frame)


def literals(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that sensitive names hold, directly or through earlier names."""
    small = text.lower()
    return sorted(Reader(text).found) if any(w in small for w in SENSITIVE) else []


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    for kind, pattern in BASE:
        if kind == "assign" and ":" not in text and "=" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "hex" or len(m.group(2) if kind == "assign" else m.group()) >= (12 if kind == "assign" else 18):
                spans.append((*m.span(), kind))
    return spans


def all_spans(text: str) -> list[tuple[int, int, str]]:
    """Base spans and scored literals, by start and then kind as listed."""
    spans = base_spans(text)
    spans += [(s, e, "literal") for s, e in literals(text)]
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array of struct(kind, start, end, base)): one row for each row of ``docs``."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in all_spans(t)] if t else [] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["id", "spans"])

        return each

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(chosen, make, "id long, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and joined spans of scan()'s rows."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(id_col, *(count(k) for k in ("assign", "access", "hex")), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
