"""Main text of web pages as the maximum-scoring contiguous region.

A page is a line of tokens: words and tags.  A tag costs; a word gains or costs
by the log-odds that it belongs to the main text, given the elements around it,
their names, and the links, length and sentences of its block.  Both are learned
from the labelled pages of :mod:`pathloom.llm.labelled_pages`: the words' by
logistic regression, the tags' by counts.  One linear scan (Kadane's) finds the
contiguous run of tokens with the highest sum.  Text within it that is unlikely
to be part of the article, such as an advert between paragraphs, is left out:
its own log-odds are negative, and what its elements alone say is below
``DOUBT`` or the log-odds are below ``CLEAR``.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import ship

#: Attributes; no '<' inside, and nothing is tried twice, so a page of broken tags takes linear time.
_REST = r"""(?>[^<>"']+|"[^"<]*"|'[^'<]*'|["'])*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b{_REST}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_REST})>|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening one ends an open one of the same kind.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCKED_BY_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SCOPES = frozenset("article main section div nav aside header footer form body table ul ol blockquote".split())


#: Log-odds below which text inside the region is no part of it (see above), and the bound of a word's gain or cost.
DOUBT, CLEAR, LIMIT = -1.0, -2.0, 3.0


class Element:
    """An open element: what is known of it and of all around it."""

    __slots__ = ("tag", "block", "link", "kinds")

    def __init__(self, tag: str, block: str, link: bool, kinds: frozenset[str]):
        self.tag, self.block, self.link, self.kinds = tag, block, link, kinds


_ROOT = Element("", "", False, frozenset())


def _inside(outer: Element, tag: str, attributes: str, known: frozenset[str] | None) -> Element:
    """The element ``tag`` in ``outer``; of tags and names only ``known`` ones are noted, if given."""
    link = outer.link or tag == "a"
    if tag in _INLINE:
        return Element(tag, outer.block, link, outer.kinds) if link != outer.link else outer
    kinds = {f"in {tag}"} if tag not in ("div", "section") else set()  # these wrap anything
    if attributes:
        kinds.update(f"named {part}" for found in _NAMES.findall(attributes) for part in _PART.findall("".join(found).lower()))
    if known is not None:
        kinds &= known
    return Element(tag, tag, link, outer.kinds if kinds <= outer.kinds else outer.kinds | kinds)


def items(page: str, known: frozenset[str] | None = None) -> Iterator[tuple[str, str, Element]]:
    """(what, text or tag, the element around it) for each run of text ("text"), tag ("open", "close") and skipped code ("code").

    Each tag takes constant time on average, however elements are nested or left
    open: of every kind the places of the open ones are kept.
    """
    stack: list[tuple[str, Element]] = []
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    at = 0

    def pop(n: int) -> None:
        for k in range(len(stack) - 1, n - 1, -1):
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in _SCOPES:
                scopes.pop()

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else -1

    for m in _TOKEN.finditer(page):
        here = stack[-1][1] if stack else _ROOT
        if m.start() > at:
            yield "text", page[at : m.start()], here
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            yield "code", (m[1] or "!").lower(), here
            continue
        scope = scopes[-1] if scopes else -1
        if m[2]:
            n = last(tag)
            if n >= 0 and (tag in _SCOPES or n > scope):
                pop(n)
            yield "close", tag, stack[-1][1] if stack else _ROOT
            continue
        ends = _CLOSES.get(tag, ()) or (("p",) if tag in _BLOCKED_BY_P else ())
        n = max((last(e) for e in ends), default=-1)
        if n > scope:
            pop(n)
        if tag not in _VOID and not m[4].rstrip().endswith("/"):
            here = _inside(stack[-1][1] if stack else _ROOT, tag, m[4], known)
            places.setdefault(tag, []).append(len(stack))
            if tag in _SCOPES:
                scopes.append(len(stack))
            stack.append((tag, here))
        yield "open", tag, stack[-1][1] if stack else _ROOT
    if at < len(page):
        yield "text", page[at:], stack[-1][1] if stack else _ROOT


class Run:
    """A run of text with its element and block, or a tag."""

    __slots__ = ("what", "value", "element", "block", "words")

    def __init__(self, what: str, value: str, element: Element, block: int):
        self.what, self.value, self.element, self.block = what, value, element, block
        self.words = len(value.split()) if what == "text" else 0


def runs_of(page: str, known: frozenset[str] | None = None) -> tuple[list[Run], list[list[str]]]:
    """The runs of a page and the features of each block: links, length, sentences."""
    runs, block = [], 0
    words, linked, ends = [0], [0], [False]
    for what, value, element in items(page, known):
        if what in ("open", "close") and value not in _INLINE:
            block += 1
            words.append(0)
            linked.append(0)
            ends.append(False)
        run = Run(what, value, element, block)
        runs.append(run)
        if run.words:
            words[block] += run.words
            linked[block] += run.words * element.link
            ends[block] |= value.rstrip()[-1:] in ".!?…。" or any(x in value for x in (". ", "! ", "? ", "。"))
    features = [
        [f"links {0 if not k else 1 if 3 * k < n else 2 if k < n else 3}", f"length {min(5, n.bit_length())}", f"sentence {int(e)}"]
        for n, k, e in zip(words, linked, ends, strict=True)
    ]
    return runs, features


class Weights:
    """Log-odds of words by the features around them, and costs of tags."""

    def __init__(self, features: dict[str, float], bias: float, tags: dict[str, float]):
        self.features, self.bias, self.tags = features, bias, tags
        self.known = frozenset(k for k in features if k.startswith(("in ", "named ")))
        self._sums: dict[frozenset, float] = {}

    @classmethod
    def learn(cls, pages: Iterable[str], mark: str = "data-main", keep: float = 4.0) -> Weights:
        """From pages whose main blocks bear the attribute ``mark``: logistic regression by Newton steps, drawn to 0 with the force ``keep``.

        A run counts by the root of its words, and for a fourth of that once
        more, as on a site without names and tags that tell the main text.
        """
        rows, sides, counts = [], [], []
        tags: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for page in pages:
            marked = _Marks(page, mark)
            runs, blocks = runs_of(page)
            for run in runs:
                inside = marked.now(run.what, run.value)
                if run.words:
                    plain = {f"at {run.element.block}", *blocks[run.block]}
                    rows += [plain | run.element.kinds, plain | {k for k in run.element.kinds if k[:2] == "in" and k not in ("in article", "in main")}]
                    sides += [inside] * 2
                    counts += [math.sqrt(run.words), math.sqrt(run.words) / 4]
                elif run.what in ("open", "close"):
                    tags[inside][run.value] += 1
        names = sorted(set().union(*rows))
        place = {k: i for i, k in enumerate(names)}
        x = np.zeros((len(rows), len(names) + 1))
        x[:, -1] = 1
        for line, row in zip(x, rows, strict=True):
            line[[place[k] for k in row]] = 1
        y, c, w = np.array(sides, float), np.array(counts), np.zeros(len(names) + 1)
        pull = np.full(len(w), keep)
        pull[-1] = 1e-3
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (c * (p - y)) + pull * w)
        odds = lambda t: math.log((tags[True][t] + 0.5) / (tags[False][t] + 0.5))
        return cls(dict(zip(names, w.tolist(), strict=False)), float(w[-1]), {t: max(-LIMIT, min(-0.05, odds(t))) for t in {*tags[True], *tags[False]}})

    def elements(self, element: Element) -> float:
        """What the elements around a word say by themselves."""
        if element.kinds not in self._sums:
            if len(self._sums) >= 10_000:
                self._sums.clear()
            self._sums[element.kinds] = sum(self.features.get(k, 0.0) for k in sorted(element.kinds))
        return self._sums[element.kinds]

    def word(self, run: Run, block: list[str]) -> float:
        get = self.features.get
        return max(-LIMIT, min(LIMIT, self.bias + self.elements(run.element) + get(f"at {run.element.block}", 0.0) + sum(get(k, 0.0) for k in block)))

    def tag(self, tag: str) -> float:
        return self.tags.get(tag, -0.5)


class _Marks:
    """Follows a labelled page and says whether the current item lies in a marked element."""

    def __init__(self, page: str, mark: str):
        self._flags = iter([bool(m[4] and mark in m[4]) for m in _TOKEN.finditer(page) if m[3] and not m[2]])
        self._open: list[tuple[str, bool]] = []

    def now(self, what: str, value: str) -> bool:
        inside = any(f for _, f in self._open)
        if what == "open":
            flag = next(self._flags)
            if value not in _VOID:
                self._open.append((value, flag))
            return inside or flag
        if what == "close":
            for n in range(len(self._open) - 1, -1, -1):
                if self._open[n][0] == value:
                    del self._open[n:]
                    break
        return inside


@cache
def default_weights() -> Weights:
    from pathloom.llm.labelled_pages import pages

    return Weights.learn(pages())


def best_region(gains: list[float]) -> tuple[int, int]:
    """The first contiguous range of the highest sum above 0, by one linear scan; (0, 0) if there is none."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for n, gain in enumerate(gains):
        if total <= 0:
            total, start = 0.0, n
        total += gain
        if total > best:
            best, begin, end = total, start, n + 1
    return begin, end


def main_text(page: str, weights: Weights | None = None) -> str:
    """The main text: blocks in page order joined by a line feed, white space in a block squeezed to one space.

    Every tag that is not inline, ``<br>`` included, begins a new block.
    """
    weights = weights or default_weights()
    runs, blocks = runs_of(page, weights.known)
    odds = [weights.word(r, blocks[r.block]) if r.words else 0.0 for r in runs]
    begin, end = best_region([o * r.words if r.words else weights.tag(r.value) if r.what in ("open", "close") else 0.0 for r, o in zip(runs, odds, strict=True)])
    found: list[list[str]] = [[]]
    last = -1
    for run, o in zip(runs[begin:end], odds[begin:end], strict=True):
        if run.what == "text":
            if run.block != last:
                found.append([])
                last = run.block
            if o >= 0 or o >= CLEAR and weights.elements(run.element) >= DOUBT:
                found[-1].append(run.value)
    squeezed = (" ".join(_html.unescape("".join(b)).split()) for b in found)
    return "\n".join(b for b in squeezed if b)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py() or "") for x in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, one without words and one without any region of
    positive score give the empty text.  Ids and urls are carried along, null
    or repeated as they are.  Other columns of the input are not looked at.  An
    empty table gives an empty result.  Pages are read in one pass and no page
    needs another's data.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(_run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
