"""Main text of web pages: maximum-scoring subsequence of words and tags.

A page is a sequence of tokens. A word scores positive and a tag negative; words do so by their kind (in a paragraph,
heading, list item or bare box; mostly linked or not; in a short or long block), and kinds that stand outside the content
score negative too. One linear scan finds the contiguous region of the largest sum, which is the content. The weights are
log-odds of each kind inside against outside the content, learned from pages that label it themselves with an ``article``
or ``main`` element. Names (words of classes and ids) are learned likewise, from the words below them. A kind or name that
the pages hold rarely keeps most of its prior weight, one that they don't hold all of it.

Elements that are no content by their meaning (menus, headers, footers, sidebars, forms, hidden ones) or by a name of
weight ``LEAST_NAME`` or less are taken out of the sequence before the scan; but a name never takes out the only
label or what holds it, or, on a page without a label, what holds most of its words. On a page with a label, what stands outside
of every label is taken out too and the label's weight is added to the words inside.

Defined results: a null or empty page, and one without words, gives the empty text; where no region scores above 0 all
that was not taken out is content; unclosed elements end with their parent, and menus that were left open where the label
begins; what follows an unclosed comment or raw element belongs to it, and a tag that never ends is dropped; character
references are decoded once; blocks are joined by one line feed and inner white space is one space. Very long and broken
pages take time in proportion to their length. Of regions that score alike the earliest wins; other columns are ignored;
equal rows give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow

# Elements by their role.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
HIDDEN = {"noscript", "template", "head", "svg", "math", "object", "audio", "video", "canvas", "map"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "select", "input", "label", "menu", "dialog", "fieldset", "option", "datalist"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
METADATA = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
LABEL = {"article", "main"}
CONTEXT = {"p": "para", "blockquote": "para", "pre": "para", "dd": "para", "figcaption": "para"} | {f"h{i}": "head" for i in range(1, 7)} | dict.fromkeys(("li", "dt", "td", "th", "summary"), "item")
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form", "toolbar"}
#: Names that are no content unless labelled pages say otherwise.
CHROME_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer",
    "disqus", "discussion", "footer", "form", "gdpr", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination",
    "pager", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidenav", "signup", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "teaser", "toc", "toolbar", "topbar", "warning", "widget",
}
#: Weights of words and tags before anything is learned; short blocks have fewer than ``SHORT`` words.
PRIOR = {
    "para": 1.0, "para short": 0.5, "para link": -1.0, "head": 0.5, "head link": -0.5, "item": 0.5, "item short": 0.1, "item link": -2.0, "bare": 0.8, "bare short": -0.5, "bare link": -2.0,
    "tag": -0.3, "label": 5.0, "name": -3.0,
}
SHORT, LEAST_NAME = 15, -2.0
#: An element with so many of the page's words, on a page without a label, is no part of it that a name could take out.
MOST = 0.75
#: So often a page is read anew because names would take out its content.
NESTED = 8
#: Labelled pages that are read, and the words or tags of a kind at which its prior weight and the learned one count alike.
SAMPLE_PAGES, HALF = 5000, 1000

# Possessive, so that a search never goes back; SIMPLE takes over on a page whose quotes don't close.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|))*+)>""")
_SIMPLE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=/>]++)(?:\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in RAW}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        out.setdefault(m[1].lower(), next((g for g in m.groups()[1:] if g is not None), ""))
    return out


@dataclass(slots=True)
class Block:
    """Neighbouring words below one block element, and the tags before them."""

    text: str = ""
    words: int = 0
    linked: int = 0
    context: str = "bare"
    chrome: bool = False
    label: bool = False
    tags: int = 0

    def kind(self) -> str:
        if 2 * self.linked > self.words:
            return f"{self.context} link"
        return f"{self.context} short" if self.words < SHORT and self.context != "head" else self.context

    def score(self, weights: dict[str, float]) -> float:
        return weights[self.kind()] * self.words + weights["tag"] * self.tags + weights["label"] * self.words * self.label


@dataclass(slots=True)
class Open:
    name: str
    hidden: bool
    chrome: bool
    link: bool
    label: bool
    block: int  # place in the stack of the nearest block element
    names: tuple[str, ...] = ()
    first: int = -1  # place in the stack of the outermost element that is no content
    doubt: tuple[int, int, int] | None = None  # of one with a name: its number, and the words and labels before it
    until: int = -1  # number of the last closing tag of those that are none


def tags_of(page: str):
    """("text", string, "", "") and ("open" or "close", name, raw attributes, "/" if it closes itself), in page order."""
    at, size, pattern, last = 0, len(page), _TAG, page.rfind(">")
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], "", ""
            return
        if lt > at:
            yield "text", page[at:lt], "", ""
        follow = page[lt + 1 : lt + 2]
        if follow in ("!", "?"):
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                at = end + 3 if end >= 0 else size
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                yield "cdata", page[lt + 9 : end if end >= 0 else size], "", ""
                at = end + 3 if end >= 0 else size
            else:
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else size
            continue
        tag = follow.isascii() and follow.isalpha() or follow == "/" and page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha()
        if not tag:
            yield "text", "<", "", ""
            at = lt + 1
            continue
        m = pattern.match(page, lt) if lt < last else None
        if not m and lt < last and pattern is _TAG:
            pattern = _SIMPLE
            m = pattern.match(page, lt)
        if not m:
            return
        at, name = m.end(), m[2].lower()
        yield ("close" if m[1] else "open"), name, m[3], "/" if m[3].rstrip().endswith("/") else ""
        if not m[1] and name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else size


def closed_after(stream: list[tuple]) -> dict[int, int]:
    """Of each opening tag that its own closing tag ends, the number of the latter."""
    stacks: dict[str, list[int]] = {}
    out: dict[int, int] = {}
    for i, (what, name, _, own) in enumerate(stream):
        if what == "open" and name not in VOID and name not in RAW and not own:
            stacks.setdefault(name, []).append(i)
        elif what == "close" and stacks.get(name):
            out[stacks[name].pop()] = i
    return out


def blocks(page: str | None, names: dict[str, float], seen: dict[str, list[int]] | None = None, spare: set[int] = frozenset(), doubts: dict[int, tuple[int, int]] | None = None) -> list[Block]:
    """The blocks in page order. ``seen`` gathers the words inside and outside of labels below each name, and the tags.

    ``doubts`` gathers the words below each element that its name takes out, by its number, and the labels; -1 stands for
    the page and the labels outside of all of them. Names say nothing of the elements in ``spare``.
    """
    stream = list(tags_of(page or ""))
    ends = closed_after(stream) if any(t[0] == "open" and t[1] in LABEL for t in stream) else {}
    out: list[Block] = []
    parts: list[str] = []
    now, stack, counts, below = Block(), [Open("", False, False, False, False, 0)], Counter(), [[0, 0]]
    words_read = labels = doubted = free = 0

    def flush() -> None:
        nonlocal now
        text = " ".join("".join(parts).split())
        parts.clear()
        if text or now.tags:
            now.text, now.words = text, text.count(" ") + 1 if text else 0
            out.append(now)
        now = Block()

    def pop() -> Open:
        nonlocal doubted
        top, (a, b) = stack.pop(), below.pop()
        below[-1][0] += a
        below[-1][1] += b
        counts[top.name] -= 1
        if top.doubt and doubts is not None:
            number, words, before = top.doubt
            doubted -= 1
            doubts[number] = words_read - words, labels - before
        if seen is not None:
            for n in top.names:
                got = seen.setdefault(n, [0, 0])
                got[0] += a
                got[1] += b
        return top

    for i, (what, value, raw, own) in enumerate(stream):
        top = stack[-1]
        if what in ("text", "cdata"):
            if top.hidden:
                continue
            text = entities.unescape(value) if what == "text" else value
            n = len(text.split())
            words_read += n
            near = stack[top.block]
            if seen is not None:
                below[-1][0 if top.label and not top.chrome else 1] += n
            if top.chrome and not near.chrome:
                continue  # a part of a line that is no content
            if not parts:
                now.context, now.chrome, now.label = CONTEXT.get(near.name, "bare"), near.chrome, top.label
            parts.append(text)
            now.linked += n if top.link else 0
            continue
        name = value
        if what == "close":
            if name in BLOCK:
                flush()
            if counts[name] > 0:
                while pop().name != name:
                    pass
            continue
        if name in RAW:
            continue
        if counts["head"] > 0 and (name == "body" or name in BLOCK) and name not in METADATA:
            while pop().name != "head":
                pass
        if name in BLOCK:
            flush()
            top = stack[-1]
            if stack[top.block].name == "p":  # a block ends an open paragraph and what is open in it
                for _ in range(len(stack) - top.block):
                    pop()
            if name == "li" and stack[-1].name == "li":
                pop()
        elif name == "br":
            parts.append(" ")
        elif name == "a" and stack[-1].name == "a":
            pop()
        if name in LABEL and stack[-1].chrome:  # menus that nothing closes after the label were left open before it
            if stack[-1].until <= ends.get(i, i):
                for _ in range(len(stack) - stack[-1].first):
                    pop()
        top = stack[-1]
        found = attributes(raw) if raw and not raw.isspace() else {}
        words = tuple({w.lower() for w in _NAME.findall(f"{found.get('class', '')} {found.get('id', '')}")}) if found else ()
        doubtful, out_of = False, name in CHROME or found.get("role", "").lower() in CHROME_ROLES
        if found and name not in ("html", "body"):
            out_of |= "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_NONE.search(found.get("style", "")))
            doubtful = any(names.get(w, 0.0) <= LEAST_NAME for w in words) and i not in spare and not out_of
            out_of |= doubtful
        if not (top.hidden or name in HIDDEN):
            now.tags += not (top.chrome or out_of)
            if seen is not None and name not in LABEL:
                seen.setdefault("", [0, 0])[0 if top.label and not (top.chrome or out_of) else 1] += 1
        if name in VOID or own:
            continue
        is_label = top.label or name in LABEL
        entry = Open(name, top.hidden or name in HIDDEN, top.chrome or out_of, top.link or name == "a", is_label, len(stack) if name in BLOCK else top.block, words if seen is not None else ())
        entry.first = top.first if top.chrome else len(stack) if out_of else -1
        entry.until = max(top.until, ends.get(i, -1)) if out_of else top.until
        entry.doubt = (i, words_read, labels) if doubtful else None
        doubted += doubtful
        labels += name in LABEL
        free += name in LABEL and not doubted
        stack.append(entry)
        below.append([0, 0])
        counts[name] += 1
    flush()
    while len(stack) > 1:
        pop()
    if doubts is not None:
        doubts[-1] = words_read, free
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[first, end) of the contiguous run with the largest sum; (0, 0) if none is positive. The earliest wins ties."""
    best, first, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, end = total, start, i + 1
    return first, end


@dataclass
class Model:
    weights: dict[str, float]
    names: dict[str, float]


PLAIN = Model(dict(PRIOR), dict.fromkeys(CHROME_NAMES, PRIOR["name"]))


def extract_text(page: str | None, model: Model = PLAIN) -> str:
    spare: set[int] = set()
    for _ in range(NESTED):
        doubts: dict[int, tuple[int, int]] = {}
        parts = [b for b in blocks(page, model.names, spare=spare, doubts=doubts) if not b.chrome]
        words, free = doubts.pop(-1)
        n, labels = max(doubts.values(), key=lambda d: (d[1] > 0, d), default=(0, 0))
        if free or not labels and n < max(1, MOST * words):
            break
        # All wrappers around the same labels, or else around most words, at once.
        spare |= {i for i, d in doubts.items() if (d[1] == labels if labels else d[0] >= MOST * words)}
    if any(b.label and b.words for b in parts):
        parts = [b for b in parts if b.label]
    first, end = best_region([b.score(model.weights) for b in parts])
    return "\n".join(b.text for b in (parts[first:end] if end else parts) if b.text)


def fit(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> Model:
    """Weights of kinds and names from at most about ``sample_pages`` pages that label their content."""
    own = pages.select(F.col(html_col).cast("string").alias("html")).where(F.col(html_col).rlike("(?i)<(article|main)[ >]"))
    share = min(1.0, sample_pages / max(own.count(), 1))
    sample = own.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            total: Counter = Counter()
            names: dict[str, list[int]] = {}
            for page in batch.column(0).to_pylist():
                for b in blocks(page, {}, names):
                    total[b.kind(), b.label and not b.chrome] += b.words
            for name, (a, b) in names.items():
                kind = f"name {name}" if name else "tag"
                total[kind, True], total[kind, False] = a, b
            rows = [(k, s, n) for (k, s), n in total.items() if n]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "inside", "n"])

        return each

    counted = map_arrow(sample, make, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return model_of({(r.kind, r.inside): r.n for r in counted.collect()})  # the kinds, and the names of a bounded sample


def model_of(counts: dict[tuple[str, bool], int]) -> Model:
    """Log-odds inside against outside; a kind or name of n words has n / (n + HALF) of it and the rest of its prior."""
    total = {side: sum(n for (k, i), n in counts.items() if i == side and not k.startswith("name ")) + 1 for side in (True, False)}

    def weight(kind: str, prior: float) -> float:
        inside, outside = (counts.get((kind, side), 0) for side in (True, False))
        odds = math.log((inside + 0.5) / total[True]) - math.log((outside + 0.5) / total[False])
        trust = (inside + outside) / (inside + outside + HALF)
        return trust * odds + (1 - trust) * prior

    weights = {k: weight(k, p) for k, p in PRIOR.items()}
    weights["label"] = PRIOR["label"] + math.log(total[True])
    known = CHROME_NAMES | {k[5:] for k, _ in counts if k.startswith("name ")}
    return Model(weights, {n: w for n in known if (w := weight(f"name {n}", PRIOR["name"] if n in CHROME_NAMES else 0.0)) < 0})


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, url, text): one row for each row of ``pages``."""
    handle = pages.sparkSession.sparkContext.broadcast(model)  # of a bounded sample

    def make():
        own = handle.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract_text(p, own) for p in batch.column(2).to_pylist()], pa.string())], names=["id", "url", "text"])

        return each

    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    chosen = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(chosen, make, "id long, url string, text string", rows=256).withColumnRenamed("id", id_col)
