"""HTML extraction by minimum-cut labelling of blocks.

A page becomes a list of text blocks (runs of text between block tags).  A
linear classifier on the block's place in the page, its links and its wording
gives each block a score for being content; both classes' costs become the
capacities of its edges to the two terminals.  Neighbouring blocks and blocks
of one parent are joined by smoothness edges, stronger the closer they are in
the element tree.  The minimum cut is the labelling of least total cost; blocks
on the source side are the main text.

Scripts, styles, comments, templates, form fields and the page head are no
text.  Character references are decoded; white space inside a block becomes one
space, and ``<br>`` counts as white space.  Unclosed, crossed and unknown tags
are read as a browser would roughly do: a block tag ends an open paragraph, an
end tag closes the nearest open element of that name.

A null or empty page, and one without content, gives an empty text; repeated
rows get equal rows; an empty table gives an empty table; only ``page_id``,
``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as H
import math
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements without an end tag, with raw text, that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math textarea select title object canvas noembed noframes xmp audio video button datalist".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
                  "th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first closes an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "body": {"head"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|[="'])*+)>|<[!?][^>]*>""", re.S)
ATTR = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

# The classifier: weights on features of the block and its ancestors (log odds of content).
BAD_TAGS = {"nav": -6.0, "aside": -5.0, "footer": -6.0, "form": -5.0, "menu": -6.0, "dialog": -5.0, "search": -5.0, "header": -2.5}
GOOD_TAGS = {"article": 4.0, "main": 2.5}
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|sidebar|side|aside|footer|foot|header|masthead|ad|ads|adv|advert|adverts|advertisement|advertising|"
    r"sponsor|sponsored|banner|promo|promotion|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|"
    r"login|comment|comments|disqus|reply|replies|respond|discussion|share|sharing|social|related|recommend|recommended|more|widget|breadcrumb|"
    r"breadcrumbs|pagination|pager|tags|toolbar|search|copyright|legal|disclaimer|complementary|contentinfo|skip|paywall|teaser|trending|popular)"
    r"(?=$|[\s_-]|\d)", re.I)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|post|story|main|body|text|hentry)(?=$|[\s_-]|\d)", re.I)
W_BAD_NAME, W_GOOD_NAME, W_COMMENT = -5.0, 1.5, -9.0
COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|reply|replies|respond|discussion)(?=$|[\s_-]|\d)", re.I)
W_BIAS, W_WORDS, W_LINKS, W_SENTENCE, W_HEADING, W_LIST, W_PARAGRAPH, W_MARK = -1.0, 0.6, -4.0, 0.8, 0.4, -0.5, 0.8, -3.0
MARKS = re.compile(r"(?:©|\(c\)\s*\d{4}|all rights reserved|cookie|subscribe|sign up|log in|privacy policy|terms of (?:use|service))", re.I)
SMOOTH_NEXT, SMOOTH_SIBLING = 1.2, 0.8
WIDE, COMMENTS_WIDE = (0.5, 0.7), 0.9  # shares of a page's text between which an element's bad names lose their weight
_BAD_ANCESTOR = -3.0  # a block whose ancestors weigh less lies in a region of its own


class Block:
    __slots__ = ("text", "links", "tag", "parent", "path", "weight", "comment")

    def __init__(self, text, links, element):
        self.text, self.links, self.tag = text, links, element.tag
        self.parent, self.path = element.parent or element, element
        self.weight, self.comment = 0.0, False  # see ``weigh``


class Element:
    __slots__ = ("tag", "parent", "depth", "good", "bad", "inside", "comment", "link", "hidden", "chars", "main_chars", "weight", "met")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent = tag, parent
        self.good = self.bad = 0.0  # the element's own weights
        self.comment = False
        self.chars = self.main_chars = 0  # of the text under it, and of that in an article or main element
        self.weight, self.met = 0.0, False
        if parent is None:
            self.depth, self.link, self.hidden, self.inside = 0, False, False, False
            return
        self.depth = parent.depth + 1
        self.inside = parent.inside or tag in GOOD_TAGS
        self.link = parent.link or tag == "a"
        self.hidden = parent.hidden
        w = 0.0
        if tag in GOOD_TAGS:
            self.good += GOOD_TAGS[tag]
        elif tag in BAD_TAGS:
            # a header inside an article holds its headline
            w += 0.0 if tag == "header" and parent.inside else BAD_TAGS[tag]
        if attrs and ("=" in attrs or "hidden" in attrs):
            self.hidden = self.hidden or bool(HIDDEN.search(attrs))
            names = " ".join(a or b or c for a, b, c in ATTR.findall(attrs))
            if names and tag not in ("html", "body"):
                if COMMENT_NAMES.search(names):
                    self.comment = True
                if BAD_NAMES.search(names):
                    w += W_BAD_NAME
                elif GOOD_NAMES.search(names):
                    self.good += W_GOOD_NAME
        self.bad = w


def weigh(found: list[Block]) -> None:
    """Weights of all blocks from the elements around them.

    A name or tag that speaks against content counts the less, the more of the page's text lies under the element: a wrapper of the whole
    page (``layout sidebar-left``, a page-wide form) is no sidebar.  That holds only where no article or main element lies elsewhere.
    """
    around: list[Element] = []
    for b in found:
        e = b.path
        e.chars += len(b.text)
        e.main_chars += len(b.text) * e.inside
        while e is not None and not e.met:
            e.met = True
            around.append(e)
            e = e.parent
    around.sort(key=lambda e: e.depth)
    for e in reversed(around):
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.main_chars += e.main_chars
    for e in around:
        root, share = around[0], e.chars / around[0].chars
        whole = e.main_chars == root.main_chars  # no article elsewhere
        lost = min(1.0, max(0.0, (share - WIDE[0]) / (WIDE[1] - WIDE[0]))) if whole else 0.0
        e.weight = e.good + e.bad * (1.0 - lost)
        e.comment = e.comment and not (whole and share > COMMENTS_WIDE)
        if e.parent is not None:
            e.weight += e.parent.weight
            e.comment = e.comment or e.parent.comment
    for b in found:
        b.weight, b.comment = b.path.weight, b.path.comment


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    root = Element("", None)
    at, out = root, []
    text: list[str] = []
    links = 0
    owner = root
    pos, n = 0, len(page)
    endless: set[str] = set()

    def flush():
        nonlocal links
        if text:
            t = " ".join("".join(text).split())
            if t and not owner.hidden:
                out.append(Block(t, min(links, len(t)), owner))
            text.clear()
        links = 0

    def add(raw):
        nonlocal links, owner
        if "&" in raw:
            raw = H.unescape(raw)
        if not text:
            e = at
            while e.parent is not None and e.tag not in BLOCK:  # the block an inline element lies in
                e = e.parent
            owner = e
        text.append(raw)
        if at.link:
            links += len(raw.strip())

    while pos < n:
        m = TAG.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            e = at
            while e.parent is not None and e.tag != tag:
                e = e.parent
            if tag in BLOCK:
                flush()
            if e.parent is not None and (tag in BLOCK or e is at or not _blocks_between(at, e)):
                at = e.parent
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            if end is None:
                endless.add(tag)  # none follows further on either
            if end:
                pos = end.end()
            elif tag in ("script", "style", "title", "textarea"):
                pos = n
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            at = _before(at, tag)
        elif tag == "a":
            e = at
            while e.parent is not None and e.tag not in BLOCK:
                if e.tag == "a":  # no link inside a link
                    at = e.parent
                    break
                e = e.parent
        if not m[3].endswith("/") or tag in BLOCK:
            at = Element(tag, at, m[3])
    flush()
    return out


def _blocks_between(low: Element, high: Element) -> bool:
    while low is not high:
        if low.tag in BLOCK:
            return True
        low = low.parent
    return False


def _before(at: Element, tag: str) -> Element:
    """Open element after which a block tag starts: an open paragraph or item of its kind ends first."""
    e = at
    while e.parent is not None and e.tag not in BLOCK:
        e = e.parent
    if e.tag == "p" or e.tag in HEADING and tag not in ("div", "span"):
        return e.parent
    closes = CLOSES.get(tag)
    if closes:
        scope, e = SCOPES.get(tag, ()), at
        while e.parent is not None and e.tag not in scope:
            if e.tag in closes:
                return e.parent
            e = e.parent
    if e.tag in HEADING:
        return at
    # unclosed inline elements end with the paragraph they were opened in
    e = at
    while e.parent is not None and e.tag not in BLOCK:
        e = e.parent
    return e


def score(b: Block) -> float:
    """Log odds that a block is content."""
    words = b.text.count(" ") + 1
    z = W_BIAS + b.weight + W_WORDS * min(math.log1p(words), 4.0) + W_LINKS * b.links / len(b.text)
    if b.text[-1] in ".!?:;\"')”»…":
        z += W_SENTENCE
    if b.tag == "p":
        z += W_PARAGRAPH
    elif b.tag in HEADING:
        z += W_HEADING
    elif b.tag == "li":
        z += W_LIST
    if words < 30 and b.weight <= 0 and MARKS.search(b.text):
        z += W_MARK
    return z + (W_COMMENT if b.comment else 0.0)


def _soft(z: float) -> float:
    return z if z > 30 else math.log1p(math.exp(z))


def _near(a: Block, b: Block) -> float:
    """Proximity of two blocks in the element tree, from 0 to 1."""
    x, y, steps = a.path, b.path, 0
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    near = 1.0 / max(1, steps - 1)
    # a region of its own (menu, advert, comments) is not pulled along
    if a.comment != b.comment or abs(a.weight - b.weight) >= -_BAD_ANCESTOR:
        near *= 0.1
    return near


def min_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Nodes on the source side of a minimum cut (the smallest such set), by blocking flows in level graphs."""
    n = len(to_source)
    s, t = n, n + 1
    adj: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[float] = []

    def edge(a, b, c, back):
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(to_source[i], to_sink[i])  # flows straight through
        if to_source[i] > both:
            edge(s, i, to_source[i] - both, 0.0)
        if to_sink[i] > both:
            edge(i, t, to_sink[i] - both, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                v = to[e]
                if level[v] < 0 and cap[e] > least:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        # every edge leads on or is given up once a level graph
        nxt, path, u = [0] * (n + 2), [], s
        while True:
            if u == t:
                flow = min(cap[e] for e in path)
                cut = next(i for i, e in enumerate(path) if cap[e] - flow <= least)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                u = to[path[cut] ^ 1]  # on from the first edge that is full
                del path[cut:]
                continue
            while nxt[u] < len(adj[u]):
                e = adj[u][nxt[u]]
                if cap[e] > least and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == s:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def label(found: list[Block]) -> list[bool]:
    """Content or not, for each block."""
    z = [score(b) for b in found]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, SMOOTH_NEXT * _near(found[i - 1], b)))
        k = last.get(id(b.parent))
        if k is not None and k < i - 1:
            edges.append((k, i, SMOOTH_SIBLING * _near(found[k], b)))
        last[id(b.parent)] = i
    return min_cut([_soft(x) for x in z], [_soft(-x) for x in z], edges)


def main_text(page: str | None) -> str:
    """Content blocks of a page, one a line."""
    if not page:
        return ""
    found = blocks(page)
    weigh(found)
    return "\n".join(b.text for b, keep in zip(found, label(found)) if keep)


def _extract(batches):
    for batch in batches:
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
