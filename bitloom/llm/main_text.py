"""Main text of web pages: boosted trees judge the nodes of a page, a tree-wide decoding makes their verdicts agree.

Every element of a page gets features of its subtree (how much text, how dense in links, tags and marks of sentences),
of its names (tokens of element name, class, id and role), its depth, its place and its siblings. Boosted trees give
the chance that it is article (C), something else (B) or holds both (O). Below B all is B, below C is C or B: of all
labellings that keep this the likeliest is taken, by maxima from the leaves up and choices from the root down. The
texts that stand directly in C are the main text.

Trees are learned from PAGES random layouts (page_layouts), since no table labels pages; nothing of the pages read
is learned. A page is one row: neither pages nor their order are shuffled.

Null and empty html give an empty text and no characters. Repeated rows each give a row; other columns are not read.
Pages cut short are read to their end, unclosed elements end with their parents. A very long page costs memory in
proportion to its bytes. Equal chances go to C before O before B.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .page_layouts import Layout

#: Layouts to learn from, and the classes of nodes.
PAGES = 700
C, O, B = 0, 1, 2

#: Elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSHOWN = frozenset("head script style title template noscript svg math iframe object audio video canvas select textarea datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Opening one of these ends an open one of those, unless one of the third kind lies between.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CELLS = frozenset("td th table caption".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?/](?![A-Za-z])[^>]*+>?|</([A-Za-z][^\s/>]*+)[^>]*+>?|<([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>?)""", re.S)
_NAMED = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARK = re.compile(r"[.,;:!?](?=\s|$)")


@lru_cache(maxsize=20_000)
def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    found = [t.lower() for m in _NAMED.findall(attributes) for t in _TOKEN.findall("".join(m))] if "=" in attributes else []
    return (f"<{name}>", *dict.fromkeys(found))


class Page:
    """The elements of a page in document order, and its texts between breaks.

    parent, end: places of elements (an element's subtree reaches from its own place to its end). linked, hidden:
    within a link, never shown. texts: (element, text), with element -1 for a break.
    """

    def __init__(self, html: str):
        self.names, self.attributes, self.parent, self.depth, self.end = ["#"], [""], [0], [0], [0]
        self.linked, self.hidden = [False], [False]
        self.texts: list[tuple[int, str]] = []
        self._stack, self._open = [0], {"#": 1}
        at = 0
        while (m := _TAG.search(html, at)) is not None:
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            closed, opened = m.group(1), m.group(2)
            if opened:
                name = opened.lower()
                self._begin(name, m.group(3))
                if name in RAW:
                    ends = re.compile(f"</{name}(?=[\\s/>]|$)", re.I).search(html, at)
                    at = ends.start() if ends else len(html)
            elif closed:
                self._finish(closed.lower())
        self._text(html[at:])
        while self._stack:
            self._pop()

    def _text(self, text: str) -> None:
        if text:
            self.texts.append((self._stack[-1], references.unescape(text) if "&" in text else text))

    def _begin(self, name: str, attributes: str) -> None:
        if name in ENDS_P and self._open.get("p"):
            self._close({"p"}, CELLS)
        if name in SIBLINGS:
            self._close(*SIBLINGS[name])
        if name not in INLINE:
            self.texts.append((-1, ""))
        node = len(self.names)
        self.names.append(name)
        self.attributes.append(attributes)
        above = self._stack[-1]
        self.parent.append(above)
        self.linked.append(self.linked[above] or name == "a")
        self.hidden.append(self.hidden[above] or name in UNSHOWN)
        self.depth.append(len(self._stack))
        self.end.append(node + 1)
        if name not in VOID:
            self._stack.append(node)
            self._open[name] = self._open.get(name, 0) + 1

    def _pop(self) -> None:
        node = self._stack.pop()
        self.end[node] = len(self.names)
        self._open[self.names[node]] -= 1
        if self.names[node] not in INLINE:
            self.texts.append((-1, ""))

    def _close(self, names: set[str], within: frozenset | set) -> None:
        """End the outermost open element of these names that lies within the innermost of the others."""
        if not any(self._open.get(n) for n in names):
            return
        found = 0
        for k in range(len(self._stack) - 1, 0, -1):
            name = self.names[self._stack[k]]
            if name in within:
                break
            if name in names:
                found = k
        while found and len(self._stack) > found:
            self._pop()

    def _finish(self, name: str) -> None:
        if name == "br":
            self.texts.append((-1, ""))
        if not self._open.get(name) or name == "#":
            return
        inline = name in INLINE
        for k in range(len(self._stack) - 1, 0, -1):
            here = self.names[self._stack[k]]
            if here == name:
                while len(self._stack) > k:
                    self._pop()
                return
            if here in CELLS and name not in ("tr", "tbody", "thead", "tfoot", "table", "body", "html") or inline and here not in INLINE:
                return

    def text_of(self, kept: np.ndarray) -> str:
        """The texts of the kept elements, white space as one blank, breaks too."""
        return " ".join("".join(text if node >= 0 and kept[node] else " " if node < 0 else "" for node, text in self.texts).split())


def _log(x: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(x, 0))


def _from_above(own: np.ndarray, parent: np.ndarray, depth: np.ndarray, worse: np.ufunc) -> np.ndarray:
    """worse (maximum or minimum) of own and 0 over all ancestors, level by level."""
    out, order = np.zeros(len(own)), np.argsort(depth, kind="stable")
    starts = np.flatnonzero(np.diff(depth[order], prepend=-1))
    for level in np.split(order, starts[1:])[1:]:
        above = parent[level]
        out[level] = worse(out[above], own[above])
    return out


def node_features(pages: list[Page], scores: dict[str, float]) -> np.ndarray:
    """One row of features for each element of the pages, one page after another."""
    sizes = np.array([len(p.names) for p in pages])
    roots = np.cumsum(sizes) - sizes
    offset, root = np.repeat(roots, sizes), np.repeat(roots, sizes)
    n = int(sizes.sum())
    joined = lambda of: np.fromiter((x for p in pages for x in of(p)), dtype=np.int64, count=n)
    parent, end, depth = joined(lambda p: p.parent) + offset, joined(lambda p: p.end) + offset, joined(lambda p: p.depth)
    known: dict[str, int] = {}
    kind = joined(lambda p: [known.setdefault(x, len(known)) for x in p.names])
    is_a = lambda *of: np.isin(kind, [known[x] for x in of if x in known]).astype(float)
    linked = joined(lambda p: p.linked).astype(bool)
    texts = [(o + node, len(t), text.count(" ") + 1, len(_MARK.findall(text))) for p, o in zip(pages, roots.tolist()) for node, text in p.texts if node >= 0 and not p.hidden[node] and (t := text.strip())]
    at, length, count, mark = np.array(texts, dtype=np.int64).reshape(-1, 4).T
    chars, words, marks, pieces = (np.bincount(at, w, n) for w in (length, count, mark, np.ones(len(at))))

    def below(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(x)])
        return sums[end] - sums[:n]

    sub_chars, sub_words, sub_links, sub_marks, sub_pieces = map(below, (chars, words, chars * linked, marks, pieces))
    so_far = np.cumsum(chars) - chars
    before, every = so_far - so_far[root], np.maximum(1.0, sub_chars[root])
    density, share, said = sub_links / np.maximum(sub_chars, 1), sub_chars / every, _log(sub_chars)

    @lru_cache(maxsize=None)
    def judged(name: str, attributes: str) -> tuple[float, float]:
        own = [scores[t] for t in _tokens(name, attributes) if t in scores]
        return max(own, default=0.0), min(own, default=0.0)

    high, low = np.array([judged(x, a) for p in pages for x, a in zip(p.names, p.attributes)]).reshape(-1, 2).T
    heading, h1 = is_a("h1", "h2", "h3", "h4", "h5", "h6"), is_a("h1")
    # Where the first h1 of a page stands; pages without one have none before anything.
    title = np.full(len(pages), np.inf)
    of_h1 = np.flatnonzero(h1)
    np.minimum.at(title, np.searchsorted(roots, of_h1, side="right") - 1, (before / every)[of_h1])
    title = np.where(np.isinf(title), -1.0, title)[np.searchsorted(roots, np.arange(n), side="right") - 1]
    # Siblings behind one another.
    order = np.lexsort((np.arange(n), parent))
    order = order[parent[order] != order]
    opens = np.flatnonzero(np.diff(parent[order], prepend=-1))
    group = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(order))))
    index, siblings, alike, most = np.zeros(n), np.ones(n), np.ones(n), np.maximum(sub_chars, 1)
    around = np.zeros((6, n))
    if len(order):
        index[order] = np.arange(len(order)) - opens[group]
        siblings[order] = np.bincount(group)[group]
        _, which, times = np.unique(group * len(known) + kind[order], return_inverse=True, return_counts=True)
        alike[order] = times[which]
        most[order] = np.maximum(1, np.maximum.reduceat(sub_chars[order], opens)[group])
        near = group[1:] == group[:-1]
        for column, values in enumerate((said, density, high)):
            around[2 * column][order[1:]] = np.where(near, values[order[:-1]], 0)
            around[2 * column + 1][order[:-1]] = np.where(near, values[order[1:]], 0)
    return np.column_stack([
        depth, said, _log(sub_words), density, sub_words / np.maximum(sub_pieces, 1), sub_marks / np.maximum(sub_words, 1), (end - np.arange(n)) / np.maximum(sub_words, 1),
        _log(below(is_a("p"))), _log(below(is_a("li"))), _log(below(is_a("a"))), _log(below(is_a("input", "button", "select", "textarea", "label"))), below(is_a("img")), _log(below(heading)), below(h1),
        share, before / every, (before + sub_chars) / every, before / every - title, chars / np.maximum(sub_chars, 1),
        index, siblings, alike, index / siblings, sub_chars / most, *around,
        said[parent], density[parent], share[parent], share[parent[parent]], siblings[parent], sub_chars / np.maximum(sub_chars[parent], 1),
        high, low, high[parent], low[parent], _from_above(high, parent, depth, np.maximum), _from_above(low, parent, depth, np.minimum), below((high > 1).astype(float)), below((low < -1).astype(float)),
        is_a("p"), is_a("div", "section"), is_a("ul", "ol", "dl"), is_a("li"), is_a("a"), heading, is_a("table", "tr", "td", "tbody"), is_a(*INLINE), linked.astype(float),
    ])


def decode_tree(page: Page, chances: np.ndarray) -> np.ndarray:
    """The likeliest labels of all elements together: below B only B, below C only C or B."""
    n, parent = len(page.names), page.parent
    score = chances.tolist()
    for i, name in enumerate(page.names):
        if name in UNSHOWN:
            score[i] = [-1e9, -1e9, 0.0]
    for i in range(n - 1, 0, -1):
        c, o, b = score[i]
        above = score[parent[i]]
        inner = max(c, b)
        above[C] += inner
        above[O] += max(inner, o)
        above[B] += b
    labels = [O] * n
    for i in range(n):
        c, o, b = score[i]
        at = O if i == 0 else labels[parent[i]]
        if at == B:
            labels[i] = B
        elif at == C:
            labels[i] = C if c >= b else B
        else:
            labels[i] = C if c >= o and c >= b else O if o >= b else B
    return np.array(labels)


class MainTextModel:
    """Token scores and boosted trees; score: log of how much oftener a token names other things than articles."""

    def __init__(self, scores: dict[str, float], trees: BoostedTrees):
        self.scores, self.trees = scores, trees

    def texts(self, pages: list[str]) -> list[str]:
        parsed = [Page(p) for p in pages]
        if not parsed:
            return []
        features = node_features(parsed, self.scores)
        chances = self.trees.log_probabilities(features)
        chances[features[:, 1] == 0] = 0.0  # no text below: no say
        out, at = [], 0
        for page in parsed:
            out.append(page.text_of(decode_tree(page, chances[at : at + len(page.names)]) == C))
            at += len(page.names)
        return out


def _labels(page: Page) -> np.ndarray:
    """C and B from the marks of a layout; elements above them are O where they hold both."""
    n = len(page.names)
    marks = [re.search(r'data-y="(.)"', a) for a in page.attributes]
    labels = [-1] * n
    for i in range(1, n):
        labels[i] = {"C": C, "B": B}[marks[i].group(1)] if marks[i] else labels[page.parent[i]]
    kinds = [set() for _ in range(n)]
    for node, text in page.texts:
        if node >= 0 and text.strip():
            kinds[node].add(labels[node])
    for i in range(n - 1, 0, -1):
        kinds[page.parent[i]] |= kinds[i]
    return np.array([x if x >= 0 else O if len(k - {-1}) != 1 else next(iter(k - {-1})) for x, k in zip(labels, kinds)])


@lru_cache(maxsize=2)
def train_main_text_model(pages: int = PAGES, seed: int = 7) -> MainTextModel:
    """Learn from so many layouts; the same model for the same arguments."""
    parsed = [Page(Layout(seed * 1_000_003 + k).page()) for k in range(pages)]
    labels = [_labels(p) for p in parsed]
    counts: dict[str, list[int]] = {}
    for page, y in zip(parsed, labels):
        for name, attributes, label in zip(page.names, page.attributes, y):
            for token in _tokens(name, attributes.replace("data-y", "")):
                counts.setdefault(token, [0, 0, 0])[label] += 1
    scores = {t: float(np.clip(np.log((c[B] + 1) / (c[C] + 1)), -4, 4)) for t, c in counts.items() if sum(c) >= 8}
    rows, y = node_features(parsed, scores), np.concatenate(labels)
    said = rows[:, 1] > 0
    return MainTextModel(scores, BoostedTrees().fit(rows[said], y[said], 3))


def extract_main_text(pages: DataFrame, model: MainTextModel | None = None, pages_at_once: int = 64) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text, n_chars (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train_main_text_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, pages_at_once):
                part = batch.slice(k, pages_at_once)
                texts = shared.value.texts([h or "" for h in part.column("html").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select("page_id", "url", "html")
    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
