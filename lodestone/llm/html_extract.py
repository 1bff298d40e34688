"""Main text of web pages: gradient-boosted trees over DOM nodes and a decoding that respects the tree.

A page is parsed into elements in document order. Each element has features of its subtree (text, links, tags,
density), of its attributes' tokens, its depth and its siblings. Trees give the log-odds that the element's own text
is content. Decoding keeps a set of elements that is closed upwards (whoever is kept has its parent kept) and has the
largest sum of log-odds, weighted by the text concerned: an exact dynamic programme over the tree, so that no content
can hang below an element that was thrown away.

The trees learn from pages whose author marked the content (article, main, and their opposites nav, footer, aside).
The marks themselves, all of which count as plain containers, are kept from the features, so that what is learned holds
for pages without them. Only the fit sees a bounded sample of pages (``max_pages``, those of the smallest hash of the id).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import _flat, _gbt
from lodestone.llm._common import col, ship

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea")}
#: Skipped with all that they hold, if they end.
_SKIP = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I) for t in ("noscript", "template", "svg")}
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What a start tag ends, if it is open nearer than any of the tags of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_P_ENDS = _BLOCK - {"body", "html", "td", "th", "tr", "li", "title"}
_P_SCOPE = frozenset("article aside body button div footer header html li main nav section table td th".split())
_KINDS = ["p", "heading", "list", "item", "link", "inline", "cell", "table", "container", "quote", "image", "form", "head", "unseen", "root", "other"]
_KIND = {t: _KINDS.index(k) for k, ts in {"p": "p", "heading": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl", "item": "li dt dd", "link": "a", "inline": "b i em strong span u small sub sup code mark abbr font cite q time label", "cell": "td th", "table": "table tbody thead tr tfoot", "container": "div article main section nav footer header aside center details figure", "quote": "blockquote pre figcaption", "image": "img picture video audio canvas iframe", "form": "form button select option input fieldset", "head": "head title meta base link", "unseen": "script style noscript template svg textarea", "root": "html body"}.items() for t in ts.split()}
_OTHER = _KINDS.index("other")
_CONTENT, _AROUND = frozenset(("article", "main")), frozenset(("nav", "footer", "aside"))
_GOOD = re.compile(r"article|body|content|entry|main|post|story|text|blog|page", re.I)
_BAD = re.compile(r"\bads?\b|advert|banner|breadcrumb|button|comment|cookie|copyright|disclaimer|footer|header|legal|login|masthead|menu|meta|modal|nav|newsletter|paging|popup|promo|related|share|sidebar|social|sponsor|subscribe|tag|toolbar|tracking|widget", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_BOGUS = ("/", "!", "?")
_ATTRIBUTES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

FEATURES = ["kind", "parent_kind", "depth", "order", "own", "own_words_a_mark", "subtree_text", "subtree_nodes", "density", "link_share", "good_tokens", "bad_tokens", "good_above", "bad_above", "siblings", "place_among_siblings", "like_siblings", "sibling_text", "share_of_parent", "share_of_page", "before_text", "after_text", "list_share", "paragraphs", "parent_text", "parent_density", "parent_link_share", "grand_kind", "grand_text"]


class Page:
    """Elements in document order (0 is the root) and pieces of text, each in one element."""

    __slots__ = ("parent", "kind", "depth", "end", "good", "bad", "mark", "text_node", "text", "block")

    def __init__(self) -> None:
        self.parent, self.kind, self.depth, self.end = [-1], [_KINDS.index("root")], [0], [1]
        self.good, self.bad, self.mark = [0], [0], [0]
        self.text_node: list[int] = []
        self.text: list[str] = []
        self.block: list[int] = []  # number of the block that a piece of text is in


def _tag_ends(source: str) -> tuple[list[int], list[int]]:
    """Positions of quotes and '>', ascending, and for each the first '>' outside of quotes from there on (-1: none, or a
    quote isn't closed). One pass from the back, however many tags are never closed."""
    at = [m.start() for m in _SPECIAL.finditer(source)]
    ends = [-1] * (len(at) + 1)
    last = {'"': -1, "'": -1}
    for k in range(len(at) - 1, -1, -1):
        c = source[at[k]]
        if c == ">":
            ends[k] = at[k]
        else:
            ends[k] = ends[last[c] + 1] if last[c] >= 0 else -1
            last[c] = k
    return at, ends


def _matched(source: str, tag: str, special: tuple[list[int], list[int]]) -> dict[int, int]:
    """Where the end tag of each start tag ends, by where the start tag does; start tags without one are left out."""
    out, starts = {}, []
    for m in _SKIP[tag].finditer(source):
        end = special[1][bisect_left(special[0], m.end())]
        if end < 0:
            continue
        if m[1]:
            if starts:
                out[starts.pop()] = end + 1
        elif tag != "svg" or source[end - 1] != "/":
            starts.append(end + 1)
    return out


class _Open:
    """Open elements, and where in the stack those of each tag are: no question takes longer where the stack is deep."""

    __slots__ = ("nodes", "tags", "where", "scopes")

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#root"]
        self.where: dict[str, list[int]] = {}
        self.scopes: list[int] = []  # places of tags that end the search for an open paragraph

    def last(self, tag: str) -> int:
        """The place of the innermost open element of a tag, or 0."""
        places = self.where.get(tag)
        return places[-1] if places else 0

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0

    def push(self, node: int, tag: str) -> None:
        place = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.where.setdefault(tag, []).append(place)
        if tag in _P_SCOPE:
            self.scopes.append(place)

    def cut(self, place: int, end: list[int], n: int) -> None:
        """Close all from ``place`` on."""
        while len(self.nodes) > place:
            end[self.nodes.pop()] = n
            tag = self.tags.pop()
            self.where[tag].pop()
            if tag in _P_SCOPE:
                self.scopes.pop()


def parse(source: str) -> Page:
    """Lenient: what is never closed ends with its parent, end tags without a start are ignored, a '<' that opens nothing
    is text. The time is linear in the source, also where tags are never closed or nest without end."""
    page = Page()
    parent, kinds, depth, end, good, bad, mark = page.parent, page.kind, page.depth, page.end, page.good, page.bad, page.mark
    block, at, size = 0, 0, len(source)
    stack = _Open()
    special = _tag_ends(source)
    last_close = source.rfind(">")
    skips: dict[str, dict[int, int]] = {}
    while at < size:
        if source[at] != "<":
            to = source.find("<", at)
            to = size if to < 0 else to
            text, at = source[at:to], to
        else:
            text = None
            if source.startswith("<!--", at):
                to = source.find("-->", at + 4)
                at = size if to < 0 else to + 3
                continue
            if source.startswith("<![CDATA[", at):
                to = source.find("]]>", at + 9)
                at = size if to < 0 else to + 3
                continue
            m = _TAG.match(source, at, at + 3)
            if m:
                to = special[1][bisect_left(special[0], at)]
                m = _TAG.match(source, at, max(to, at + 3))
            elif source[at + 1 : at + 2] in _BOGUS:
                to = source.find(">", at) if at < last_close else -1
            else:
                to = -1
            if to < 0:
                text, at = "<", at + 1
        if text is not None:
            if not text.isspace():
                page.text_node.append(stack.nodes[-1])
                page.text.append(html.unescape(text) if "&" in text else text)
                page.block.append(block)
            continue
        at = to + 1
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCK or tag == "br":
                block += 1
            k = stack.last(tag)
            if k and (tag in _BLOCK or stack.scope() <= k):
                stack.cut(k, end, len(parent))
            continue
        rest = source[m.start(2) + len(tag) : to]
        if tag in _BLOCK or tag == "br":
            block += 1
        k = 0
        if tag in _P_ENDS and stack.last("p"):
            k = stack.last("p") if stack.scope() <= stack.last("p") else 0
        elif tag in _ENDS:
            ends, scope = _ENDS[tag]
            k = max(stack.last(t) for t in ends)
            k = k if k > max(stack.last(t) for t in scope) else 0
        if k:
            stack.cut(k, end, len(parent))
        node = len(parent)
        top = stack.nodes[-1]
        parent.append(top)
        kinds.append(_KIND.get(tag, _OTHER))
        depth.append(depth[top] + 1)
        end.append(node + 1)
        mark.append(1 if tag in _CONTENT else -1 if tag in _AROUND else mark[top])
        g = b = 0
        if rest:
            for a in _ATTRIBUTES.findall(rest):
                value = a[0] or a[1] or a[2]
                g += bool(_GOOD.search(value))
                b += bool(_BAD.search(value))
        good.append(g)
        bad.append(b)
        if tag in _RAW:
            m = _RAW[tag].search(source, at)
            at = m.end() if m else size
        elif tag in _SKIP:
            if not (tag == "svg" and rest.endswith("/")):
                if tag not in skips:
                    skips[tag] = _matched(source, tag, special)
                at = skips[tag].get(at, at)
        elif tag not in _VOID:
            stack.push(node, tag)
    n = len(parent)
    for node in stack.nodes:
        end[node] = n
    return page


class Batch:
    """Elements of many pages, one after another, as arrays; parents and ends are positions in them."""

    def __init__(self, pages: list[Page]) -> None:
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.cuts = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(self.cuts[:-1], sizes)
        join = lambda name: np.array([x for p in pages for x in getattr(p, name)], np.int64)
        self.parent, self.end = join("parent"), join("end") + shift
        self.parent[self.parent >= 0] += shift[self.parent >= 0]
        self.kind, self.depth, self.good, self.bad, self.mark = (join(k) for k in ("kind", "depth", "good", "bad", "mark"))
        pieces = np.array([len(p.text) for p in pages], np.int64)
        self.text_cuts = np.concatenate([[0], np.cumsum(pieces)])
        self.text_node = join("text_node") + np.repeat(self.cuts[:-1], pieces)
        texts = [t for p in pages for t in p.text]
        n = len(self.parent)
        length = np.array([len(t) for t in texts], float)
        words = np.array([t.count(" ") + 1 for t in texts], float)
        marks = np.array([t.count(".") + t.count(",") for t in texts], float)
        add = lambda v: np.bincount(self.text_node, v, n) if len(v) else np.zeros(n)
        self.own, self.words, self.marks = add(length), add(words), add(marks)
        self.page = np.repeat(np.arange(len(pages)), sizes)

    def subtree(self, v: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(v, dtype=float)])
        return sums[self.end] - sums[np.arange(len(v))]

    def features(self) -> np.ndarray:
        n = len(self.parent)
        at = np.arange(n)
        up = np.maximum(self.parent, 0)
        up[self.parent < 0] = at[self.parent < 0]
        grand = up[up]
        text, nodes = self.subtree(self.own), (self.end - at).astype(float)
        link = _KINDS.index("link")
        linked = self.subtree(np.where((self.kind == link) | (self.kind[up] == link), self.own, 0.0))
        items = self.subtree(np.isin(self.kind, [_KINDS.index("item"), link]).astype(float))
        paragraphs = self.subtree((self.kind == _KINDS.index("p")).astype(float))
        first = self.cuts[self.page]
        total, count = text[first], nodes[first]
        inner = self.parent >= 0
        children = np.bincount(self.parent[inner], minlength=n)
        sibling_text = np.bincount(self.parent[inner], text[inner], n)
        like = self.parent * len(_KINDS) + self.kind
        like[~inner] = -1 - at[~inner]
        _, inverse, alike = np.unique(like, return_inverse=True, return_counts=True)
        order = np.argsort(self.parent, kind="stable")
        place = np.zeros(n)
        cut = np.flatnonzero(np.concatenate([[True], self.parent[order][1:] != self.parent[order][:-1]]))
        place[order] = at - np.repeat(cut, np.diff(np.append(cut, n)))
        place[~inner] = 0
        # what stands beside an element: the text of the elements before it and after it at any depth
        sums = np.concatenate([[0.0], np.cumsum(self.own)])
        before = sums[at] - sums[np.maximum(at - 8, first)]
        last = self.cuts[self.page + 1]
        after = sums[np.minimum(self.end + 8, last)] - sums[self.end]
        good, bad = self._above(self.good, up), self._above(self.bad, up)
        ratio = lambda a, b: a / np.maximum(b, 1.0)
        density, link_share = text / nodes, ratio(linked, text)
        columns = [
            self.kind, self.kind[up], self.depth, (at - first) / count, np.log1p(self.own), ratio(self.words, self.marks + 1), np.log1p(text), np.log1p(nodes), np.log1p(density), link_share, self.good, self.bad, good, bad, np.log1p(children[up]), place / np.maximum(children[up], 1),
            ratio(alike[inverse].ravel(), children[up]), np.log1p(ratio(np.maximum(sibling_text[up] - text, 0), children[up] - 1.0)), ratio(text, sibling_text[up]), ratio(text, total), np.log1p(before), np.log1p(after), items / nodes, np.log1p(paragraphs), np.log1p(text[up]), np.log1p(density[up]), link_share[up], self.kind[grand], np.log1p(text[grand]),
        ]
        return np.stack([np.asarray(c, float) for c in columns], 1)

    def _above(self, v: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Sum over the ancestors."""
        out = np.zeros(len(v))
        for at in _levels(self.depth)[1:]:
            out[at] = out[up[at]] + v[up[at]]
        return out

    def decode(self, odds: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Which elements stay: the set, closed upwards, of the largest sum of odds * weight. An element of no weight costs
        nothing by itself and stays where something below it does."""
        return keep_closed(self.parent, self.depth, odds * weight)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    """Positions by depth, each in order."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []


def keep_closed(parent: np.ndarray, depth: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """best(v) = max(0, gain(v) + sum of best(children)); v stays if its parent does and best(v) > 0."""
    total = gain.astype(float).copy()
    levels = _levels(depth)
    for at in levels[:0:-1]:
        np.add.at(total, parent[at], np.maximum(total[at], 0))
    keep = np.zeros(len(parent), bool)
    for k, at in enumerate(levels):
        keep[at] = (total[at] > 0) & (keep[parent[at]] if k else True)
    return keep


def _weight(own: np.ndarray) -> np.ndarray:
    return np.sqrt(own)


def extract(sources: list[str], forest: _gbt.Forest) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(main text, elements, elements kept) of each page. Blocks are lines; blanks within are single."""
    pages = [parse(s) for s in sources]
    if not pages:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = Batch(pages)
    some = np.flatnonzero(b.own > 0)
    odds = np.zeros(len(b.own))
    odds[some] = forest.raw(b.features()[some])
    keep = b.decode(odds, _weight(b.own))
    shown = keep[b.text_node]
    out = []
    for page, low in zip(pages, b.text_cuts[:-1], strict=True):
        lines: list[list[str]] = []
        at = -1
        for k, (text, block) in enumerate(zip(page.text, page.block, strict=True)):
            if shown[low + k]:
                if block != at:
                    lines.append([])
                    at = block
                lines[-1].append(text)
        out.append("\n".join(x for line in lines if (x := " ".join("".join(line).split()))))
    has = keep & (b.own > 0)
    return out, np.diff(b.cuts), np.add.reduceat(has, b.cuts[:-1], dtype=np.int64)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return _flat.slices(batch, "html", _flat.BLOCK)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in _slices(whole):
            b = Batch([parse(s or "") for s in part.column("html").to_pylist()])
            some = np.flatnonzero((b.own > 0) & (np.bincount(b.page, b.mark > 0)[b.page] > 0))
            x = b.features()[some]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([flat, pa.array((b.mark[some] > 0).astype(np.int32))], ["x", "y"])


def fit_extractor(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 400, trees: int = 40, depth: int = 4) -> _gbt.Forest:
    """Trees from the pages whose author marked the content; without any, every text counts as content."""
    ship(pages.sparkSession)
    rows = pages.select(col(id_col).cast("long").alias("id"), col(html_col).cast("string").alias("html")).where("html IS NOT NULL")
    marked = rows.where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = marked.select(F.xxhash64("id").alias("h"), F.xxhash64("html").alias("g")).orderBy("h", "g").limit(max_pages).distinct()
    picked = marked.withColumn("h", F.xxhash64("id")).withColumn("g", F.xxhash64("html")).join(F.broadcast(chosen), ["h", "g"], "left_semi").select("html").distinct()
    got = picked.mapInArrow(_examples, "x array<double>, y int").toArrow()
    if not got.num_rows:
        return _gbt.Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 1.0, 1)
    x, y = np.stack([np.asarray(v) for v in got.column("x").to_numpy()]), got.column("y").to_numpy().astype(int)
    order = np.lexsort((*x.T, y))
    return _gbt.fit(x[order], y[order], trees, depth)


def _run(forest: _gbt.Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _slices(whole):
                source = part.column("html")
                texts, nodes, kept = extract([s or "" for s in source.to_pylist()], forest)
                missing = source.is_null().to_numpy(zero_copy_only=False)
                text = pa.array([None if m else t for t, m in zip(texts, missing, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), text, pa.array(nodes), pa.array(kept)], ["page_id", "text", "n_nodes", "n_kept"])

    return run


def extract_text(pages: DataFrame, forest: _gbt.Forest, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_nodes, n_kept) for every row: n_kept counts the elements whose own text was kept.

    A null page has a null text, an empty one an empty text (their only element is the root); a null id is passed on,
    repeated rows are extracted each. A page of any length is parsed whole, in time linear in its length, also where its
    markup is broken. An empty table gives no rows. Other columns are ignored, whatever their names. Ids are cast to
    long, what can't be is an error."""
    ship(pages.sparkSession)
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_run(forest), "page_id long, text string, n_nodes long, n_kept long")
