"""Main-text extraction by wrapper induction.

Each page becomes a tree of its block elements; adjacent siblings of equal structure (the paragraphs of an article, the
entries of a menu) fold into one repeated node. The commonest tree of a host is its template, and every page
of the host is aligned with it by simple tree matching: the order-keeping pairs of children with the most matching nodes
below them. Aligned nodes share a key; a node without a partner gets one from its partnered ancestor and its path.
Grouped aggregation over all of a host's different pages then gives the wrapper:

* a text that stands at the same node on CONSTANT of the pages is template; what varies is a slot;
* a repeated slot whose text is nearly all link text is a menu;
* a slot below an element that names itself as advert, comments, notice and the like isn't content, unless hardly any
  varying text would be left: then the name is mistaken for the element that holds the most.

Elements that HTML itself sets apart (nav, aside, form, script, header and footer of the page) are left out before; where a page
marks its article, only what stands there counts, and menus aren't looked for. Pages that mark their article and
pages that don't are kept apart.

A constant needs FEW different pages where an article is marked (copies of one article keep their text), else two; where
the different pages are fewer than FEW, the varying text must also outweigh the constant one, or the pages are copies.
A host with one page has no constants. The result doesn't depend on how the pages are split among tasks.

Cases: null html is empty and gives an empty text. Broken markup closes as browsers do, in simple form.
A null url, or one without a host, belongs to the host ''. Repeated rows each give a row and count as one page. An empty table
gives no rows. Other columns are ignored. Depth and width of a page are bounded by its length only.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinlens.llm.common import saved, steps, table, text_of

FEW = 5
#: Share of a host's different pages that a constant is on.
CONSTANT = 0.9
#: Share of link text that makes a repeated slot a menu.
LINKS = 0.9
#: Share of the varying text that must stand outside of elements with telling names.
OUTSIDE_NAMES = 0.1
#: Templates that a task holds before it passes them on, and results of matching that it keeps.
HELD = 20_000
KEPT_MATCHES = 200_000

# Names of HTML elements and attribute words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe".split())  # text up to the end tag, or the page's end
FOREIGN = frozenset("svg math".split())
#: Start tags that end an open svg, math or select.
BREAKOUT = frozenset("address article blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header li main nav ol p pre section table ul".split())
ISLAND = frozenset("foreignobject annotation-xml desc".split())  # HTML inside of svg or math
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav aside form script style noscript template iframe svg math select button textarea title dialog menu head input object video audio canvas".split())
OUTSIDE = frozenset("header footer".split())
WORDS = frozenset("ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer login menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget masthead topbar".split())
#: Whole class or id names: the words, and the words of a whole site's frame after these.
FRAME = frozenset(f"{a}-{b}" for a in ("site", "main", "top", "global", "primary", "secondary") for b in ("header", "footer", "menu", "nav", "navbar", "navigation", "sidebar", "banner"))
KEPT = frozenset("html body main article".split())  # names and roles say nothing about these
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
CONTENT = frozenset("article content entry post story".split())  # with one of these, a header is the article's own
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "p": "p"}
SCOPE = frozenset("ul ol dl table article section div main body td th blockquote".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!?/?[A-Za-z][^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*>|<[!?][^>]*>", re.S)
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9:-]*)")
_BARE = re.compile(r"=\s*[^\s\"'>]*/>$")  # an attribute's bare value with a slash at its end
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Node:
    name: str
    label: str  # its name and the class and id names that have no digit
    dropped: bool = False
    doubtful: bool = False  # a class or id names it as navigation, advert and the like
    main: bool = False
    parts: list = field(default_factory=list)  # str and Node, in page order


def _attributes(tag: str, name_end: int) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(tag, name_end)}


def tree(page: str) -> Node:
    root = Node("root", "root")
    stack = [root]
    still = Counter()  # names of open elements
    at, end = 0, len(page)
    last = max(page.rfind(">"), page.rfind("<!--"))

    def close(i: int) -> None:
        still.subtract(n.name for n in stack[i:])
        del stack[i:]

    while at < end:
        m = _TAG.search(page, at) if at <= last else None
        stop = m.start() if m else end
        if stop > at:
            stack[-1].parts.append(page[at:stop])
        if not m:
            break
        at, tag = m.end(), m.group()
        found = _NAME.match(tag)
        if not found:
            continue
        name = found[1].lower()
        if tag[1] == "/":
            if still[name] > 0:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                close(i)
            continue
        foreign = False
        enclosed = still["svg"] + still["math"] + still["select"] > 0
        for i in range(len(stack) - 1, 0, -1) if enclosed else ():
            if stack[i].name in ISLAND:
                break
            if stack[i].name in FOREIGN or stack[i].name == "select":
                if name in BREAKOUT or stack[i].name == "select" and name in ("select", "input", "textarea"):
                    close(i)
                else:
                    foreign = stack[i].name in FOREIGN
                break
        if name in CLOSES_P and still["p"] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in SCOPE:
                    break
        if name in CLOSES and name != "p" and any(still[c] > 0 for c in CLOSES[name].split()):
            closes = CLOSES[name].split()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in closes:
                    close(i)
                    break
                if stack[i].name in SCOPE - {"td", "th"} or name in ("td", "th") and stack[i].name == "tr":
                    break
        closed = tag.endswith("/>") and not _BARE.search(tag)
        node = Node(name, name, main=name == "main")
        if found.end() < len(tag) - 1:
            a = _attributes(tag, found.end())
            own = set(f"{a.get('class', '')} {a.get('id', '')}".lower().split())
            node.label = ".".join([name, *sorted(w for w in own if w.isalpha() or not any(map(str.isdigit, w)))])
            style = a.get("style", "").replace(" ", "").lower()
            if name not in ("html", "body"):
                node.dropped = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or name not in KEPT and a.get("role", "").lower() in ROLES
            node.doubtful = name not in KEPT and a.get("role") != "main" and own.isdisjoint(CONTENT) and ("header" in own or not own.isdisjoint(WORDS) or not own.isdisjoint(FRAME))
            if name == "article" and still["article"] > 0 and not own.isdisjoint(("comment", "reply")):
                node.doubtful = True
            node.main |= a.get("role") == "main"
        raw = name in RAW and not (foreign and closed)
        if raw:
            shut = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if shut or not foreign:
                at = shut.end() if shut else end
        stack[-1].parts.append(node)
        if name not in VOID and not raw and not closed:
            stack.append(node)
            still[name] += 1
    return root


def _marked(root: Node, doubtful: bool = False) -> list[Node]:
    """Outermost article or main elements that aren't inside dropped (or doubtful) ones; main only counts where no article is in it."""
    nodes, parent, stack = [], [], [(root, -1)]
    while stack:
        node, above = stack.pop()
        here = len(nodes)
        nodes.append(node)
        parent.append(above)
        if node.name != "article":
            stack += [(p, here) for p in reversed(node.parts) if isinstance(p, Node) and not p.dropped and (doubtful or not p.doubtful) and p.name not in NEVER and p.name not in OUTSIDE]
    holds, marks = [False] * len(nodes), []
    for i in range(len(nodes) - 1, -1, -1):
        mark = nodes[i].name == "article" or nodes[i].main and not holds[i]
        if mark:
            marks.append(nodes[i])
        if parent[i] >= 0:
            holds[parent[i]] |= mark or holds[i]
    return marks[::-1]


def _tidy(pieces: list[str]) -> str:
    text = "".join(pieces)
    if "&" in text:
        text = entities.unescape(text)
    return " ".join(text.split())


def _hashed(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


@dataclass
class Page:
    """A page's block elements in page order, folded, and its text blocks."""

    marked: bool
    labels: list[str]
    doubt: list[int]  # the outermost element above (or at) a node with a telling name, or -1
    blocks: list[tuple[int, str, int]]  # node, text, characters of link text
    runs: list[list[list[int]]] = field(default_factory=list)  # each node's children with text, in runs of equal structure
    shape: list[int] = field(default_factory=list)  # a hash of the structure below a node
    size: list[int] = field(default_factory=list)
    many: list[bool] = field(default_factory=list)  # in a run of several


def read(page: str) -> Page:
    root = tree(page)
    starts = _marked(root) or _marked(root, True)  # an element that holds the only article isn't left out for its name
    out = Page(bool(starts), ["article" if starts else "page"], [-1], [])
    children: list[list[int]] = [[]]
    pieces: list[str] = []
    linked = 0

    def flush(at: int) -> None:
        nonlocal linked
        if pieces and (text := _tidy(pieces)):
            out.blocks.append((at, text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def enter(node: Node, above: int) -> tuple:
        here = len(out.labels)
        out.labels.append(node.label)
        out.doubt.append(out.doubt[above] if out.doubt[above] >= 0 or not node.doubtful else here)
        children.append([])
        children[above].append(here)
        return node, here, False, True, iter(node.parts)

    for start in starts or [root]:
        stack = [enter(Node(start.name, start.label, parts=start.parts), 0)]
        while stack:
            node, at, link, block, parts = stack[-1]
            for p in parts:
                if isinstance(p, str):
                    pieces.append(p)
                    if link:
                        linked += len(p.strip())
                elif p.name == "br":
                    pieces.append(" ")
                elif p.dropped or p.name in NEVER or p.name in OUTSIDE and not (starts and p.name == "header"):
                    if p.name not in INLINE:
                        flush(at)
                elif p.name in INLINE:
                    stack.append((p, at, link or p.name == "a", False, iter(p.parts)))
                    break
                else:
                    flush(at)
                    stack.append(enter(p, at))
                    break
            else:
                stack.pop()
                if block:
                    flush(at)
    n = len(out.labels)
    out.runs, out.shape, out.size, out.many = [[] for _ in range(n)], [0] * n, [1] * n, [False] * n
    own = [False] * n
    for at, _, _ in out.blocks:
        own[at] = True
    for i in range(n - 1, -1, -1):
        runs: list[list[int]] = []
        for c in children[i]:
            if not own[c] and not out.runs[c]:
                continue  # without text
            if runs and out.shape[runs[-1][0]] == out.shape[c]:
                runs[-1].append(c)
            else:
                runs.append([c])
        for r in runs:
            if len(r) > 1:
                for c in r:
                    out.many[c] = True
        out.runs[i] = runs
        out.size[i] = 1 + sum([out.size[r[0]] for r in runs])
        out.shape[i] = _hashed(out.labels[i].encode("utf-8", "surrogatepass"), b"1" if own[i] else b"0", *[out.shape[r[0]].to_bytes(8, "little", signed=True) for r in runs])
    return out


@dataclass
class Template:
    """The folded tree of a page, nodes in page order."""

    labels: list[str]
    shape: list[int]
    size: list[int]
    children: list[list[int]]

    @staticmethod
    def of(page: Page) -> Template:
        out = Template([], [], [], [])
        stack = [(0, -1)]
        while stack:
            node, above = stack.pop()
            here = len(out.labels)
            out.labels.append(page.labels[node])
            out.shape.append(page.shape[node])
            out.size.append(page.size[node])
            out.children.append([])
            if above >= 0:
                out.children[above].append(here)
            stack += [(r[0], here) for r in reversed(page.runs[node])]
        return out

    def written(self) -> str:
        return json.dumps([self.labels, self.shape, self.size, self.children], separators=(",", ":"))


class Matcher:
    """Simple tree matching of pages with one template. Scores are kept by structure, so equal parts are matched once."""

    def __init__(self, template: Template) -> None:
        self.t = template
        self.scores: dict[tuple[int, int], int] = {}
        self.paired: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def __len__(self) -> int:
        return len(self.paired) + len(self.scores)

    def score(self, page: Page, a: int, b: int) -> int:
        """Nodes that match in the two trees; 0 if the roots differ."""
        t, stack = self.t, [(a, b)]
        while stack:
            x, y = stack[-1]
            key = (page.shape[x], t.shape[y])
            if key in self.scores:
                stack.pop()
            elif page.labels[x] != t.labels[y]:
                self.scores[key] = 0
            elif key[0] == key[1]:
                self.scores[key] = page.size[x]
            else:
                ours = {page.shape[r[0]]: r[0] for r in page.runs[x]}
                theirs = {t.shape[c]: c for c in t.children[y]}
                missing = [(p, q) for s, p in ours.items() for z, q in theirs.items() if (s, z) not in self.scores]
                if missing:
                    stack += missing
                else:
                    self.scores[key] = 1 + self._row(*self._table([page.shape[r[0]] for r in page.runs[x]], [t.shape[c] for c in t.children[y]]))
        return self.scores[page.shape[a], self.t.shape[b]]

    def _table(self, xs: list[int], ys: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the structures on both sides and the scores of their pairs."""
        us, ws = {s: i for i, s in enumerate(dict.fromkeys(xs))}, {s: i for i, s in enumerate(dict.fromkeys(ys))}
        scores = np.array([[self.scores[u, w] for w in ws] for u in us], np.int64).reshape(len(us), len(ws))
        return np.array([us[s] for s in xs], np.int64), np.array([ws[s] for s in ys], np.int64), scores

    @staticmethod
    def _rows(a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The best order-keeping total of all of a with each prefix of b."""
        row = np.zeros(len(b) + 1, np.int64)
        for x in a:
            new = row.copy()
            np.maximum(new[1:], row[:-1] + scores[x][b], out=new[1:])
            row = np.maximum.accumulate(new)
        return row

    def _row(self, a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> int:
        return int(self._rows(a, b, scores)[-1]) if len(a) and len(b) else 0

    def _best(self, a: np.ndarray, b: np.ndarray, scores: np.ndarray) -> list[tuple[int, int]]:
        """The best order-keeping pairs, by halves, in memory that grows with the lengths only."""
        out, stack = [], [(0, len(a), 0, len(b))]
        while stack:
            i, j, k, m = stack.pop()
            if i == j or k == m:
                continue
            if j - i == 1:
                own = scores[a[i]][b[k:m]]
                if own.max() > 0:
                    out.append((i, k + int(own.argmax())))
                continue
            half = (i + j) // 2
            left, right = self._rows(a[i:half], b[k:m], scores), self._rows(a[half:j][::-1], b[k:m][::-1], scores)[::-1]
            cut = k + int((left + right).argmax())
            stack += [(i, half, k, cut), (half, j, cut, m)]
        return sorted(out)

    def pairs(self, page: Page, x: int, y: int) -> list[tuple[int, int]]:
        """The runs of a page's node and the children of a template's node that belong together."""
        key = (page.shape[x], y)
        if key not in self.paired:
            xs, ys = [page.shape[r[0]] for r in page.runs[x]], [self.t.shape[c] for c in self.t.children[y]]
            head = 0
            while head < min(len(xs), len(ys)) and xs[head] == ys[head]:
                head += 1
            tail = 0
            while tail < min(len(xs), len(ys)) - head and xs[-1 - tail] == ys[-1 - tail]:
                tail += 1
            found = [(i, i) for i in range(head)]
            i, j = len(xs) - tail, len(ys) - tail
            if head < i and head < j:
                ours, theirs = dict(zip(xs[head:i], range(head, i), strict=True)), dict(zip(ys[head:j], range(head, j), strict=True))
                for p in ours.values():
                    for q in theirs.values():
                        self.score(page, page.runs[x][p][0], self.t.children[y][q])
                found += [(head + p, head + q) for p, q in self._best(*self._table(xs[head:i], ys[head:j]))]
            found += [(i + k, j + k) for k in range(tail)]
            if len(self) > KEPT_MATCHES:
                self.paired.clear()
                self.scores.clear()
            self.paired[key] = found
        return self.paired[key]

    def keys(self, page: Page) -> list[int]:
        """A key for each node of the page: its partner's number, or one by its path from the nearest ancestor with a partner."""
        out, partner = [0] * len(page.labels), [-1] * len(page.labels)
        stack = [0]
        if page.labels[0] == self.t.labels[0]:
            out[0], partner[0] = 1, 0
        while stack:
            x = stack.pop()
            with_partner = dict(self.pairs(page, x, partner[x])) if partner[x] >= 0 else {}
            for i, run in enumerate(page.runs[x]):
                if i in with_partner:
                    t = self.t.children[partner[x]][with_partner[i]]
                    key = t + 1
                else:
                    t, key = -1, _hashed(out[x].to_bytes(8, "little", signed=True), page.labels[run[0]].encode("utf-8", "surrogatepass"))
                for c in run:
                    out[c], partner[c] = key, t
                stack += run
        return out


#: A text block as it is stored: a hash of its node and text, the node's and its telling ancestor's key, whether it is in a run, and its characters of link text.
BLOCKS = "array<struct<entry:long,key:long,doubt:long,many:boolean,links:int,text:string>>"
_BLOCK = pa.struct([("entry", pa.int64()), ("key", pa.int64()), ("doubt", pa.int64()), ("many", pa.bool_()), ("links", pa.int32()), ("text", pa.string())])


def aligned(page: Page, matcher: Matcher | None) -> list[tuple]:
    """The page's text blocks as they are stored."""
    keys = (Matcher(Template.of(page)) if matcher is None else matcher).keys(page)
    return [(_hashed(keys[i].to_bytes(8, "little", signed=True), text.encode("utf-8", "surrogatepass")), keys[i], keys[page.doubt[i]] if page.doubt[i] >= 0 else 0, page.many[i], links, text) for i, text, links in page.blocks]


def main_text(page: str | None) -> str:
    """The main text of a page that is alone on its host."""
    read_page = read(page or "")
    found = aligned(read_page, None)
    menus = set()
    for key in {b[1] for b in found} if not read_page.marked else ():
        own = [b for b in found if b[1] == key]
        if sum(b[4] for b in own) >= LINKS * sum(len(b[5]) for b in own) and 2 * sum(b[3] for b in own) >= len(own):
            menus.add(key)
    varying = Counter()
    for b in found:
        if b[1] not in menus:
            varying[b[2]] += len(b[5])
    named = [d for d in varying if d]
    released = max(named, key=lambda d: (varying[d], d)) if named and varying[0] < OUTSIDE_NAMES * sum(varying.values()) else 0
    return "\n".join(b[5] for b in found if b[1] not in menus and b[2] in (0, released))


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _host().alias("host"), text_of(pages, "html").alias("html"))


def templates(pages: DataFrame) -> DataFrame:
    """host, marked, unmarked: the commonest tree of the host's pages of each kind (of equally common ones, that with the least hash)."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bool, int], list] = {}

        def emit() -> pa.RecordBatch:
            hosts, marked, shapes = zip(*known, strict=True)
            counts, written = zip(*known.values(), strict=True)
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((hosts, marked, shapes, counts, written), (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["host", "marked", "shape", "n", "tree"])

        for batch in steps(batches, "html"):
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = read(html)
                seen = known.setdefault((host, page.marked, page.shape[0]), [0, ""])
                seen[0] += 1
                seen[1] = seen[1] or Template.of(page).written()
            if len(known) > HELD:
                yield emit()
        if known:
            yield emit()

    found = _rows(pages).select("host", "html").mapInArrow(trees, "host string, marked boolean, shape long, n long, tree string")
    each = found.groupBy("host", "marked", "shape").agg(F.sum("n").alias("n"), F.min("tree").alias("tree"))
    best = F.max(F.struct("n", F.col("shape").alias("s"), "tree"))
    most = each.groupBy("host", "marked").agg(best.alias("best")).select("host", "marked", "best.tree")
    return most.groupBy("host").agg(F.max(F.when(F.col("marked"), F.col("tree"))).alias("marked"), F.max(F.when(~F.col("marked"), F.col("tree"))).alias("unmarked"))


def align(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, url, site, sign, blocks: every page's text blocks with their nodes' keys. Pages with one sign have equal blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[tuple[str, bool], Matcher] = {}
        for batch in steps(batches, "html"):
            sites, signs, ends, out = [], [], [0], []
            for host, html, *both in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                page = read(html)
                if (host, page.marked) not in matchers:
                    if len(matchers) > 200 or sum(map(len, matchers.values())) > KEPT_MATCHES:
                        matchers.clear()
                    matchers[host, page.marked] = Matcher(Template(*json.loads(both[0] if page.marked else both[1])))
                own = aligned(page, matchers[host, page.marked])
                sites.append(host + ("#" if page.marked else ""))
                signs.append(_hashed(np.array([b[0] for b in own], np.int64).tobytes()))
                out += own
                ends.append(len(out))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_BLOCK), _BLOCK, strict=True)]
            blocks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_BLOCK)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sites, pa.string()), pa.array(signs, pa.int64()), blocks], ["page_id", "url", "site", "sign", "blocks"])

    both = _rows(pages).join(found, "host", "left").select("page_id", "url", "host", "html", "marked", "unmarked")
    return both.mapInArrow(run, f"page_id long, url string, site string, sign long, blocks {BLOCKS}")


def induce(blocks: DataFrame) -> DataFrame:
    """site, constants, menus, released: what of a site's blocks is template, and which telling name is mistaken (0: none).

    All from sums over the site's different pages, whatever their number and split.
    """
    # Pages with equal blocks are one page. Texts stay behind: only their lengths go on.
    light = F.transform("blocks", lambda b: F.struct(b["entry"].alias("entry"), b["key"].alias("key"), b["doubt"].alias("doubt"), b["many"].alias("many"), b["links"].alias("links"), F.char_length(b["text"]).alias("chars")))
    different = saved(blocks.where(F.size("blocks") > 0).select("site", "sign", light.alias("blocks")).dropDuplicates(["site", "sign"]), "different")
    pages = different.groupBy("site").agg(F.count("*").alias("pages"))
    often = different.select("site", F.explode(F.array_distinct("blocks.entry")).alias("entry")).groupBy("site", "entry").agg(F.count("*").alias("n")).where("n > 1")
    least = F.when(F.col("site").endswith("#"), F.lit(FEW)).otherwise(F.lit(2))
    equal = often.join(pages, "site").where((F.col("pages") >= least) & (F.col("n") >= CONSTANT * F.col("pages")))
    sites = saved(pages.join(equal.groupBy("site").agg(F.collect_list("entry").alias("constants")), "site", "left"), "sites")
    each = different.join(sites, "site").select("site", "constants", F.inline("blocks"))
    fixed = F.coalesce(F.array_contains("constants", F.col("entry")), F.lit(False))
    sums = each.groupBy("site", "key", "doubt").agg(F.count("*").alias("n"), F.sum(F.col("many").cast("int")).alias("many"), F.sum("links").alias("links"), F.sum("chars").alias("chars"), F.sum(F.when(~fixed, F.col("chars")).otherwise(0)).alias("varying"))
    menu = ~F.col("site").endswith("#") & (F.col("links") >= LINKS * F.col("chars")) & (2 * F.col("many") >= F.col("n"))
    free = F.sum(F.when(menu, 0).otherwise(F.col("varying"))).alias("free")
    named = sums.groupBy("site", "doubt").agg(free, F.sum("varying").alias("varying"), F.sum("chars").alias("chars"), F.collect_list(F.when(menu, F.col("key"))).alias("menus"))
    most = F.max(F.when((F.col("doubt") != 0) & (F.col("free") > 0), F.struct("free", "doubt"))).alias("most")
    outside = F.sum(F.when(F.col("doubt") == 0, F.col("free")).otherwise(0)).alias("outside")
    whole = named.groupBy("site").agg(F.sum("free").alias("total"), F.sum("varying").alias("varying"), F.sum("chars").alias("chars"), outside, most, F.flatten(F.collect_list("menus")).alias("menus"))
    out = whole.join(sites, "site")
    copies = (F.col("varying") == 0) | (F.col("pages") < FEW) & (2 * F.col("varying") <= F.col("chars"))
    mistaken = F.col("outside") < OUTSIDE_NAMES * F.col("total")
    return out.select("site", F.when(~copies, F.col("constants")).alias("constants"), "menus", F.when(mistaken, F.col("most.doubt")).alias("released"))


def extract(blocks: DataFrame, wrappers: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    none = F.array().cast("array<long>")

    def content(b: Column) -> Column:
        named = (b["doubt"] == 0) | (b["doubt"] == F.coalesce(F.col("released"), F.lit(0)))
        return named & ~F.array_contains(F.coalesce("constants", none), b["entry"]) & ~F.array_contains(F.coalesce("menus", none), b["key"])

    kept = F.transform(F.filter("blocks", content), lambda b: b["text"])
    return blocks.join(wrappers, "site", "left").select("page_id", "url", F.array_join(kept, "\n").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    blocks = saved(align(pages, saved(templates(pages), "templates")), "blocks")
    return extract(blocks, saved(induce(blocks), "wrappers"))


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
