"""Main text of web pages by wrapper induction (operator 1).

Pages become DOM trees. The trees of a host are aligned by simple tree matching: the largest top-down, order-keeping
matching of nodes with equal labels (tag, id, class), by dynamic programming over child lists whose weights are the
matchings of the subtrees. Of matchings of one size, the one with more equal content wins.

Each host has up to `REFS` reference pages, those with the smallest hashes in each residue class of the hash. Every
distinct page of the host is aligned with them, and each node of a reference counts the pages that have it and those
that have it with the same content. Counts are plain sums, so neither partitions nor the order of rows matter, and a hot
host is spread over all tasks: a task gives a row of counts for each reference it met. A node whose content is the same
on at least `SHARE` of the other pages (one more page than there are counts against it) is template; slots whose content
varies may be content. The wrapper's content slot is the innermost container whose varying text (links and named boxes
left out) makes up at least `FOCUS` of the pages' text on average, each page weighing the same.

On a host with fewer than `LEAST` distinct pages no node can reach that share: its pages are read by their own structure
alone, as are pages without the slot of their host.

A page's text: blocks of the content slot, there under article or main where it has one. It goes without elements that
are template on the host or that say by their tag, role, id or class that they are not the article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments). A header within the article stays if it holds a
heading; a container with such a name stays if it holds main, or an article or h1 and half of the page's text.

Parsing, alignment of lists whose ends are equal, and reading take time in proportion to the page; between unequal lists
of n and m children a matching takes n * m steps in memory of at most `CELLS` cells.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (unclosed elements end
with their parent, a cut character reference stays as it is, a quote that never closes is a character of its tag);
repeated pages give repeated rows and count once in the template; a page without url belongs to host ''; an empty table
gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import marked, materialise

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>?", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SKIP = {"head", "script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "nav", "footer", "aside", "form", "button", "select", "input", "textarea", "dialog", "menu", "title"}
#: Words of an id, class or role that say that an element is not the article.
BAD_WORDS = {"ad", "ads", "adbox", "adsense", "adslot", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "share", "social", "related", "comment", "comments", "disqus", "replies", "respond", "search", "login", "complementary", "contentinfo", "widget", "toolbar", "pagination", "pager"}
CLOSES = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}
REFS, SHARE, FOCUS = 3, 0.8, 0.6
#: The fewest pages of which a node can be template: k others with k / (k + 1) >= SHARE, and the page itself.
LEAST = next(k for k in range(1, 100) if k / (k + 1) >= SHARE) + 1
CELLS, BROADCAST = 1 << 22, 32 << 20
HOLDS = {"main": 1, "article": 2, "h1": 4 | 8, "h2": 8, "h3": 8}


#: Words beside a word of BAD_WORDS in a name that say no more of what the element holds.
NEUTRAL = {"area", "articles", "bar", "block", "body", "bottom", "box", "button", "col", "column", "container", "content", "default", "fixed", "float", "footer", "form", "group", "head", "header", "holder", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "module", "outer", "overlay", "page", "pane", "panel", "policy", "posts", "primary", "region", "right", "row", "secondary", "section", "site", "slot", "small", "sticky", "stories", "strip", "tile", "top", "unit", "wrap", "wrapper"}
DIGITS = re.compile(r"\d+")


@lru_cache(1 << 14)
def names_of(values: str) -> frozenset[str]:
    """The words of BAD_WORDS that name an element: those of tokens all of whose words are bad or NEUTRAL, so that
    related-posts is named by `related`, and related-work by nothing."""
    out: set[str] = set()
    for token in values.lower().split():
        words = re.findall(r"[a-z]+", token)
        bad = BAD_WORDS.intersection(words)
        if bad and all(w in bad or w in NEUTRAL or len(w) < 3 for w in words):
            out |= bad
    return frozenset(out)


class Node:
    __slots__ = ("tag", "label", "words", "kids", "text", "parent", "block", "inside", "crc", "mass", "chars", "holds", "bad", "hidden", "shape", "at", "elements", "crcs", "masses")

    def __init__(self, tag, attrs, parent):
        self.tag, self.parent, self.kids, self.text, self.label, self.words = tag, parent, [], "", tag, ()
        self.crc = self.mass = self.chars = self.holds = self.shape = self.at = 0
        self.bad = self.hidden = False
        self.elements: list[Node] = []
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        if "=" not in attrs:
            return
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
        if not found:
            return
        self.label = DIGITS.sub("0", tag + "#" + found.get("id", "") + "." + found.get("class", ""))
        self.words = names_of(" ".join(found.values()))


def parse(page: str) -> Node:
    """The DOM tree; text nodes are children with tag '' ."""
    root = at = Node("html", "", None)
    open_tags: dict[str, int] = {}
    pos, last, n = 0, 0, len(page)

    def close(upto):
        """Leave the elements from at up to and with upto."""
        up = at
        while up is not upto.parent:
            if up.parent is not None:
                open_tags[up.tag] -= 1
            up = up.parent
        return upto.parent

    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            break
        if m.start() > last:
            add_text(at, page[last : m.start()])
        pos = last = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_tags.get(tag):
                up = at
                while up.tag != tag:
                    up = up.parent
                at = close(up)
            continue
        if tag == "html" and at is root:
            continue
        if tag in BLOCKS and at.tag in CLOSES and tag in CLOSES[at.tag] and at is not root:
            at = close(at)
        elif tag in BLOCKS and tag != "br" and at.block.tag == "p" and tag in CLOSES["p"]:
            at = close(at.block)
        node = Node(tag, m[3], at)
        at.kids.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(page, pos)
            stop = end.start() if end else n
            node.text = page[pos:stop]
            pos = last = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            at = node
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if last < n:
        add_text(at, page[last:])
    seal(root)
    return root


RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}


def add_text(at: Node, raw: str) -> None:
    node = Node("", "", at)
    node.text = raw
    at.kids.append(node)


def seal(root: Node) -> None:
    """Give each node the CRC of its content (of its words, and of its children's content in order), what it holds,
    whether it or an element around it isn't the article, and the mass of its text: characters of words outside links and
    elements that aren't the article."""
    nodes = list(walk(root))
    for node in reversed(nodes):
        if node.tag:
            crc = chars = holds = 0
            for k in node.kids:
                if k.crc:
                    crc = crc32(k.crc.to_bytes(4, "little"), crc)
                chars += k.chars
                holds |= k.holds
            node.crc, node.chars, node.holds = crc, chars, holds | HOLDS.get(node.tag, 0)
        else:
            words = node.text.split()
            node.crc = crc32(" ".join(words).encode("utf-8", "surrogatepass")) if words else 0
            node.chars = node.mass = sum(map(len, words))
    for node in nodes:
        if node.tag:
            node.bad = is_bad(node, root.chars)
            node.hidden = node.parent is not None and node.parent.hidden or node.bad and node.tag not in ("main", "body", "html")
    for node in reversed(nodes):
        if node.tag and node.tag != "a" and not node.bad:
            node.mass = sum(k.mass for k in node.kids)


def is_bad(node: Node, total: int) -> bool:
    if node.tag in SKIP:
        return True
    if node.words and not BAD_WORDS.isdisjoint(node.words):  # a wrapper with a name like has-sidebar holds the article
        return not (node.holds & 1 or node.holds & 6 and 2 * node.chars >= total)
    return node.tag == "header" and not (node.inside and node.holds & 8)


def walk(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.kids))


def elements(node: Node) -> list[Node]:
    """The children that take part in the matching."""
    return [k for k in node.kids if k.tag and k.tag not in VOID and k.tag not in RAW]


class Shapes:
    """Trees of labels, each kept once, and the sizes of their simple tree matchings."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def name(self, root: Node) -> Node:
        """Number the nodes in document order (`at`) and give each its elements and shape, and the root their contents and
        thousandths of its mass in this order."""
        nodes, stack = [], [root]
        while stack:
            x = stack.pop()
            x.at = len(nodes)
            nodes.append(x)
            x.elements = elements(x)
            stack.extend(reversed(x.elements))
        for x in reversed(nodes):
            kids = tuple([k.shape for k in x.elements])
            key = (x.label, kids)
            if (shape := self.ids.get(key)) is None:
                shape = self.ids[key] = len(self.label)
                self.label.append(x.label)
                self.kids.append(kids)
                self.size.append(1 + sum(self.size[k] for k in kids))
            x.shape = shape
        root.crcs = np.array([x.crc for x in nodes], np.int64)
        root.masses = 1000 * np.array([x.mass for x in nodes], np.int64) // (root.mass or 1)
        return root

    def matching(self, x: int, y: int) -> int:
        """How many nodes the largest matching of two shapes has."""
        stack = [(x, y)]
        while stack:
            p, q = stack[-1]
            if self.at_once(p, q) is not None:
                stack.pop()
                continue
            a, b = self.kids[p], self.kids[q]
            lead, tail = equal_ends(a, b)
            own = sum(self.size[k] for k in a[:lead]) + sum(self.size[k] for k in a[len(a) - tail :])
            a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
            missing = [(i, j) for i in set(a) for j in set(b) if self.at_once(i, j) is None] if a and b else ()
            if missing:
                stack.extend(missing)
                continue
            best = best_score(self.weights(a, b)) if a and b else 0
            self.known[min(p, q), max(p, q)] = 1 + own + best
        return self.at_once(x, y)

    def at_once(self, x: int, y: int) -> int | None:
        if x == y:
            return self.size[x]
        if self.label[x] != self.label[y]:
            return 0
        return self.known.get((min(x, y), max(x, y)))

    def weights(self, a, b):
        """Rows of the matchings of each shape of a with each of b."""
        if len(a) * len(b) <= 64:
            return [[self.at_once(i, j) for j in b] for i in a]
        kinds, col = np.unique(b, return_inverse=True)
        rows = {i: np.array([self.at_once(i, j) for j in kinds.tolist()], np.int64)[col] for i in set(a)}
        return [rows[i] for i in a]


def equal_ends(a, b, same=eq) -> tuple[int, int]:
    """How many first and last items are equal. Matching them is never worse: nothing matches an item better than its like."""
    most, lead, tail = min(len(a), len(b)), 0, 0
    while lead < most and same(a[lead], b[lead]):
        lead += 1
    while tail < most - lead and same(a[-1 - tail], b[-1 - tail]):
        tail += 1
    return lead, tail


def best_score(weights) -> int:
    if isinstance(weights[0], list):
        line = [0] * (len(weights[0]) + 1)
        for row in weights:
            new = [0]
            for j, w in enumerate(row):
                new.append(max(line[j + 1], new[j], line[j] + w))
            line = new
        return line[-1]
    return int(score_line(weights)[-1])


def score_line(weights) -> np.ndarray:
    """Best scores of all rows against the first 0, 1, .. columns."""
    line = np.zeros(len(weights[0]) + 1, np.int64)
    for row in weights:
        line[1:] = np.maximum.accumulate(np.maximum(line[1:], line[:-1] + row))
    return line


def best_pairs(weights) -> list[tuple[int, int]]:
    """Index pairs of the heaviest order-keeping matching; beyond CELLS by halves, in memory of one line."""
    n, m = len(weights), len(weights[0])
    if n > 1 and n * m > CELLS:
        half = n // 2
        ahead = score_line(weights[:half]) + score_line([np.asarray(r)[::-1] for r in reversed(weights[half:])])[::-1]
        cut = int(ahead.argmax())
        first = best_pairs([r[:cut] for r in weights[:half]]) if cut else []
        return first + ([(i + half, j + cut) for i, j in best_pairs([r[cut:] for r in weights[half:]])] if cut < m else [])
    if isinstance(weights[0], list):
        lines = [[0] * (m + 1)]
        for row in weights:
            line, new = lines[-1], [0]
            for j, w in enumerate(row):
                new.append(max(line[j + 1], new[j], line[j] + w))
            lines.append(new)
    else:
        lines = np.zeros((n + 1, m + 1), np.int64)
        for i, row in enumerate(weights):
            lines[i + 1, 1:] = np.maximum.accumulate(np.maximum(lines[i, 1:], lines[i, :-1] + row))
    out, i, j = [], n, m
    while i and j:
        if lines[i][j] == lines[i - 1][j]:
            i -= 1
        elif lines[i][j] == lines[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(a: list[Node], b: list[Node], shapes: Shapes) -> list[tuple[Node, Node]]:
    """The matched pairs of two child lists: the most matched nodes and, among those, the most equal content."""
    same = lambda x, y: x.shape == y.shape and x.crc == y.crc
    lead, tail = equal_ends(a, b, same)
    out, n, m = list(zip(a[:lead], b[:lead], strict=True)), len(a) - tail, len(b) - tail
    last = list(zip(a[n:], b[m:], strict=True))
    if lead == n or lead == m:
        return out + last
    a, b = a[lead:n], b[lead:m]
    if len(a) == len(b) == 1:
        return out + ([(a[0], b[0])] if a[0].label == b[0].label else []) + last
    ours, theirs = {x.shape for x in a}, {x.shape for x in b}
    if len(ours | theirs) == 1 and {x.crc for x in a}.isdisjoint({x.crc for x in b}):
        return out + list(zip(a, b, strict=False)) + last  # all matchings of this size weigh the same
    for i in ours:
        for j in theirs:
            if shapes.at_once(i, j) is None:
                shapes.matching(i, j)
    sizes, more = shapes.weights([x.shape for x in a], [x.shape for x in b]), min(len(a), len(b)) + 1
    if isinstance(sizes[0], list):
        rows = [[more * w + (w > 0 and 0 != x.crc == y.crc) for w, y in zip(row, b, strict=True)] for row, x in zip(sizes, a, strict=True)]
    else:
        crc = np.array([y.crc for y in b], np.int64)
        rows = [more * row + ((row > 0) & (crc == x.crc) & (x.crc != 0)) for row, x in zip(sizes, a, strict=True)]
    return out + [(a[i], b[j]) for i, j in best_pairs(rows)] + last


def count(ref: Node, page: Node, shapes: Shapes, counts: np.ndarray) -> None:
    """Add one page to the counts of a reference's nodes: rows for having it, for equal content, and for thousandths of
    the page's mass."""
    stack = [(ref, page)]
    had, met = [], []
    while stack:
        x, y = stack.pop()
        if x.shape == y.shape:  # only all nodes in order match all
            a, b, n = x.at, y.at, shapes.size[x.shape]
            if n > 1:
                counts[0, a : a + n] += 1
                counts[1, a : a + n] += ref.crcs[a : a + n] == page.crcs[b : b + n]
                counts[2, a : a + n] += page.masses[b : b + n]
                continue
        had.append(x.at)
        met.append(y.at)
        if x.elements and y.elements:
            stack += align(x.elements, y.elements, shapes)
    counts[0, had] += 1
    counts[1, had] += ref.crcs[had] == page.crcs[met]
    counts[2, had] += page.masses[met]


def is_template(equal: int, pages: int) -> bool:
    return equal - 1 >= SHARE * pages  # less the reference page itself; there are pages - 1 others


def constants(ref: Node, counts: np.ndarray, pages: int) -> set[int]:
    """CRCs of label and content of the reference's nodes that are template."""
    out, stack = set(), list(ref.elements)
    while stack:
        x = stack.pop()
        if x.crc and is_template(counts[1, x.at], pages):
            out.add(crc32(x.label.encode(), x.crc))
        stack += x.elements
    return out


def content_slot(ref: Node, counts: np.ndarray, pages: int) -> tuple[int, list[str]]:
    """The mass and the labels from the root down to the slot whose varying content makes up most of the pages' text."""
    path, at, mass = [], ref, 0
    while at.tag not in ("article", "main") and not any(k.tag == "h1" for k in at.kids):
        varying = [k for k in at.elements if k.tag in CONTAINERS and not is_template(counts[1, k.at], pages)]
        best = max(varying, key=lambda k: counts[2, k.at], default=None)
        if best is None or counts[2, best.at] < 1000 * FOCUS * pages:
            break
        path.append(best.label)
        at, mass = best, int(counts[2, best.at])
    return mass, path


def at_slot(root: Node, slot, constant) -> Node:
    """The slot of a page: of children with equal labels, the one with the most text that isn't template."""
    at = root
    for label in slot:
        same = [k for k in at.kids if k.tag and k.label == label and crc32(label.encode(), k.crc) not in constant]
        if not same:
            return root
        at = max(same, key=lambda k: k.mass)
    return at


def outermost(top: Node, tag: str) -> list[Node]:
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        if x.tag == tag:
            out.append(x)
        else:
            stack.extend(reversed(x.kids))
    return out


def main_text(page: str, constant=frozenset(), slot=()) -> str:
    root = parse(page)
    top = at_slot(root, slot, constant)
    articles = [x for x in outermost(top, "article") if not x.hidden]
    roots = [max(articles, key=lambda x: x.mass)] if articles else outermost(top, "main")[:1] or [top]  # teasers beside it go
    if all(x.hidden for x in roots):
        roots = [root]
    text = text_of(roots, constant)
    return text if text or not constant else text_of(roots, frozenset())  # the template never empties a page


def text_of(roots: list[Node], constant) -> str:
    blocks, now = [], []

    def flush():
        text = SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if text:
            blocks.append(text)

    for top in roots:
        if top.hidden:
            continue
        stack = [(top, False)]
        while stack:
            node, closing = stack.pop()
            if not node.tag:
                now.append(entities.unescape(node.text))
                continue
            block = node.tag in BLOCKS
            if closing:
                flush()
                continue
            if node is not top and node.tag not in ("main", "body") and (node.bad or constant and node.crc and crc32(node.label.encode(), node.crc) in constant):
                if block:
                    flush()
                continue
            if block:
                flush()
                stack.append((node, True))
            stack.extend((k, False) for k in reversed(node.kids))
        flush()
    return " ".join(blocks)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def references(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, pages, refs array<string>) of hosts with at least LEAST distinct pages, and the distinct pages (host, html).

    Pages are told apart by 64-bit hashes of host and html. Only pages whose hash is repeated or chosen are shuffled.
    """
    own = pages.where("html <> ''").select("host", "html", F.xxhash64("host", "html").alias("key"))
    seen = materialise(own.groupBy("host", "key").agg(F.count("*").alias("n")))
    turn = F.pmod("key", F.lit(REFS))
    least = seen.groupBy("host").agg(F.count("*").alias("pages"), *[F.min(F.when(turn == j, F.col("key"))).alias(f"r{j}") for j in range(REFS)])
    picked = F.explode(F.filter(F.array(*[f"r{j}" for j in range(REFS)]), lambda k: k.isNotNull())).alias("key")
    chosen = materialise(least.where(F.col("pages") >= LEAST).select("host", "pages", picked))
    found = marked(own, chosen, "key").where("__mark").join(chosen, ["host", "key"]).groupBy("host", "key").agg(F.first("html").alias("html"), F.first("pages").alias("pages"))
    refs = found.groupBy("host").agg(F.first("pages").alias("pages"), F.array_sort(F.collect_list(F.struct("key", "html"))).alias("refs"))
    told = marked(own, seen.where("n > 1").select("key"), "key")
    distinct = told.where("NOT __mark").select("host", "html").unionByName(told.where("__mark").dropDuplicates(["host", "key"]).select("host", "html"))
    return materialise(refs.select("host", "pages", F.expr("transform(refs, r -> r.html)").alias("refs"))), distinct


def with_references(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, html, refs). The hosts of the most pages, as many as have BROADCAST bytes of references, are broadcast, so
    that their pages, however many, stay where they are; those of the other hosts are joined by host."""
    rank = F.floor(F.log2(F.col("pages"))).cast("int")
    sizes = refs.groupBy(rank.alias("rank")).agg(F.sum(F.expr("aggregate(refs, 0L, (a, r) -> a + octet_length(r))")).alias("size")).orderBy(F.desc("rank")).collect()  # 64 rows at most
    total, least = 0, 64
    for r in sizes:
        total += r["size"]
        if total > BROADCAST:
            break
        least = r["rank"]
    many = F.broadcast(refs.where(rank >= least).select("host", "refs"))
    met = pages.join(many, "host")
    if total > BROADCAST:
        few = refs.where(rank < least).select("host", "refs")
        met = met.unionByName(pages.join(many.select("host"), "host", "left_anti").join(few, "host"))
    return met


class Known:
    """The reference trees of the hosts that a task meets, and their shapes; forgotten together when they grow large."""

    def __init__(self):
        self.shapes, self.trees = Shapes(), {}

    def of(self, host: str, refs: pa.ListScalar) -> list[Node]:
        if len(self.shapes.label) + len(self.shapes.known) > 500_000:
            self.shapes, self.trees = Shapes(), {}
        if host not in self.trees:
            self.trees[host] = [self.shapes.name(parse(r)) for r in refs.as_py()]
        return self.trees[host]


def templates(pages: DataFrame) -> DataFrame:
    """(host, constant array<long>, slot array<string>): each host's template nodes and the way to its content."""
    refs, distinct = references(pages)

    def rows(held):
        names = [(host, j) for host, c in held.items() for j in range(len(c[1]))]
        cols = [
            pa.array([h for h, _ in names], pa.string()), pa.array([j for _, j in names], pa.int32()), pa.array([held[h][0] for h, _ in names], pa.int64()),
            pa.array([held[h][1][j].ravel() for h, j in names], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["host", "ref", "pages", "counts"])

    def induce(batches):
        held, cells, known = {}, 0, Known()
        for batch in batches:
            for host, page, ref in zip(*(batch.column(c) for c in ("host", "html", "refs")), strict=True):
                host = host.as_py()
                trees = known.of(host, ref)
                if host not in held:
                    held[host] = [0, [np.zeros((3, known.shapes.size[t.shape]), np.int64) for t in trees]]
                    cells += sum(c.size for c in held[host][1])
                tree = known.shapes.name(parse(page.as_py()))
                held[host][0] += 1
                for t, c in zip(trees, held[host][1], strict=True):
                    count(t, tree, known.shapes, c)
            if cells > 4_000_000:
                yield rows(held)
                held, cells = {}, 0
        if held:
            yield rows(held)

    def combine(batches):
        """Rows come sorted by host."""
        host, trees, pages, sums, shapes = None, [], 0, {}, Shapes()

        def result():
            total = [sums[j] for j in range(len(trees))]
            constant = sorted(set().union(*(constants(t, c, pages) for t, c in zip(trees, total, strict=True))))
            slot = max((content_slot(t, c, pages) for t, c in zip(trees, total, strict=True)), key=lambda x: x[0])[1]
            return host, constant, slot

        def batch_of(out):
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())))]
            return pa.RecordBatch.from_arrays(cols, names=["host", "constant", "slot"])

        for batch in batches:
            out = []
            for h, j, n, c, ref in zip(*(batch.column(k) for k in ("host", "ref", "pages", "counts", "refs")), strict=True):
                h, j = h.as_py(), j.as_py()
                if h != host:
                    if host is not None:
                        out.append(result())
                    shapes = Shapes()
                    host, pages, sums, trees = h, 0, {}, [shapes.name(parse(r)) for r in ref.as_py()]
                pages += n.as_py() if j == 0 else 0
                c = c.values.to_numpy().reshape(3, -1)
                sums[j] = sums[j] + c if j in sums else c
            yield batch_of(out)
        if host is not None:
            yield batch_of([result()])

    counted = with_references(distinct, refs).mapInArrow(induce, "host string, ref int, pages bigint, counts array<bigint>")
    met = counted.join(refs.select("host", "refs"), "host").repartition("host").sortWithinPartitions("host")
    return met.mapInArrow(combine, "host string, constant array<bigint>, slot array<string>").where("size(constant) + size(slot) > 0")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    held = materialise(templates(pages))
    met = pages.join(held, "host", "left").select("page_id", "url", "html", "constant", "slot")

    def run(batches):
        for batch in batches:
            out = []
            for page, c, slot in zip(*(batch.column(x) for x in ("html", "constant", "slot")), strict=True):
                page = page.as_py()
                out.append(main_text(page, frozenset(c.as_py() or ()), slot.as_py() or ()) if page else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return met.mapInArrow(run, f"page_id {df.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint")
