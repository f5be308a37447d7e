"""HTML extraction by tree scoring.

Each page is parsed into a tree (a small forgiving parser over one regular expression). Elements that never hold an
article's text (menus, forms, scripts, ...) are cut off by name or role. Paragraphs pass points for their length and
commas to their ancestors: all to the parent, half to the grandparent, and to each further ancestor a third of what the
one below it gets. Points are discounted by link density. The container with most points is kept, with those of its
siblings that have a fifth of its points or are text like it; where it lies inside an ``article`` or ``main`` element,
that element is the container. Inside what is kept, lists and sections that are mostly links go.

Names in class and id are evidence, not verdicts: a block whose names mark it as furniture goes unless it holds at
least half of the page's paragraph points; one that is named for readers' comments goes unless the article is in it.

A text block is what stands between block-level elements: references decoded, white space runs (line breaks
included) one space, ends trimmed. Blocks are joined by one line feed.

Rows are independent, so pages stream through ``mapInArrow`` without a shuffle; memory is one Arrow batch.

Defined results: a null or empty page has the empty text; a page without tags is one block; a page without any scored
paragraph gives its ``article``, ``main`` or ``body`` text (or all of it); unclosed elements end with the page; further columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strophe.llm.common import table

# Element names of HTML by their role here, and words that mark furniture in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "option", "optgroup", "legend"}
SCOPE = frozenset("html body article main section div td th table caption blockquote aside figure form ul ol dl li dd button object template".split())
FURNITURE = frozenset(
    "head nav menu header footer aside form script style noscript template iframe object embed canvas svg button select option input textarea"
    " dialog title meta link audio video map applet frame frameset noframes datalist fieldset label legend".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion"
    " nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar"
    " header masthead footer colophon copyright sidebar sidebars aside rail widget widgets"
    " notice notices notification cookie cookies consent gdpr banner popup modal overlay alert disclaimer"
    " comment comments commentlist disqus reply replies respond discussion feedback"
    " share sharing social related recommended recommendations newsletter subscribe subscription signup login search form".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MIN_PARAGRAPH = 25
#: Text of its own that makes a paragraph of another block element.
MIN_BLOCK = 100
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion feedback".split())
#: Blocks that go from what is kept when half their text is links.
LISTS = frozenset("ul ol dl div section table center details figure".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("commas", "far", "inside", "kids", "length", "links", "marks", "near", "next", "own", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, marks: str = ""):
        self.tag, self.parent, self.marks, self.kids = tag, parent, marks, []
        self.clear()

    def clear(self) -> None:
        """Text lengths, and points: of its own, of its children, grandchildren, all below those; and of all in it."""
        self.length, self.links, self.commas = 0, 0, 0
        self.score = self.own = self.near = self.next = self.far = self.inside = 0.0


def parse(html: str) -> Node:
    root = here = Node("#root", None)
    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            here.kids.append(unescape(html[at:]))
            break
        if m.start() > at:
            here.kids.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                here.kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1] or m[4]:  # end tag: up to the open element of that name, if there is one
            node = here
            while node.parent and node.tag != tag:
                node = node.parent
            if node.parent:
                here = node.parent
            elif tag == "br":
                here.kids.append(" ")
            continue
        if tag in CLOSES_P:
            here = _close(here, "p")
        if tag in ("li", "option", "tr"):
            here = _close(here, tag, frozenset(("ul", "ol", "menu", "select", "table")))
        elif tag in ("dt", "dd"):
            here = _close(_close(here, "dt", frozenset(("dl",))), "dd", frozenset(("dl",)))
        elif tag in ("td", "th"):
            here = _close(_close(here, "td", frozenset(("tr", "table"))), "th", frozenset(("tr", "table")))
        node = Node(tag, here, m[3] or m[6] or "")
        here.kids.append(node)
        if tag in RAW:  # everything up to its end tag is no markup
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and not (tag in ("svg", "math", "path") and node.marks.endswith("/")):
            here = node
    return root


def _close(here: Node, tag: str, scope: frozenset = SCOPE) -> Node:
    node = here
    while node.parent and node.tag != tag and node.tag not in scope:
        node = node.parent
    return node.parent if node.tag == tag and node.parent else here


def _is_furniture(node: Node, points: float) -> bool:
    """Whether a node goes, on a page with so many paragraph points."""
    if node.tag in FURNITURE:
        return True
    if not node.marks or node.tag in ("html", "body", "main", "article"):
        return False
    for m in ATTR.finditer(node.marks):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "role":
            if value.strip() in ROLES:
                return True
            continue
        names = set(SPLIT.split(value))
        if not COMMENTS.isdisjoint(names) and not _holds_article(node):
            return True
        if not WORDS.isdisjoint(names) and (not node.inside or 2 * node.inside < points) and not _holds_article(node):
            return True
    return False


def _holds_article(node: Node) -> bool:
    """An article or main in it: then its class speaks of a layout, not of furniture."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main"):
            return True
        todo += [k for k in x.kids if not isinstance(k, str)]
    return False


def prune(root: Node) -> None:
    """Cut furniture: first by element and role, then, when points are known without those, by names."""
    for by_name in (False, True):
        if by_name:
            score(_order(root))
        todo, points = [root], root.inside
        while todo:
            node = todo.pop()
            node.kids = [k for k in node.kids if isinstance(k, str) or not (_is_furniture(k, points) if by_name else k.tag in FURNITURE)]
            todo += [k for k in node.kids if not isinstance(k, str)]


def _order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out += [k for k in node.kids if not isinstance(k, str)]
    return out


def score(nodes: list[Node]) -> None:
    for node in nodes:
        node.clear()
    for node in reversed(nodes):
        texts = [" ".join(k.split()) for k in node.kids if isinstance(k, str)]
        direct = sum(map(len, texts))
        node.length += direct
        node.commas += sum(t.count(",") + t.count("،") + t.count("，") for t in texts)
        if node.tag == "a":
            node.links = node.length
        if node.length >= MIN_PARAGRAPH and (node.tag in PARAGRAPHS or node.tag in ("div", "section", "article", "main", "body") and direct >= MIN_BLOCK):
            node.own = (1 + node.commas + min(node.length / 100, 3)) * (1 - _density(node))
        node.inside += node.own
        node.score = (0.0 if node.tag in PARAGRAPHS else node.own) + node.near + node.next / 2 + node.far
        if up := node.parent:
            up.length += node.length
            up.links += node.links
            up.commas += node.commas
            up.inside += node.inside
            up.near += node.own
            up.next += node.near
            up.far += (node.next / 2 + node.far) / 3
    for node in nodes:
        node.score *= 1 - _density(node)


def _density(node: Node) -> float:
    return min(node.links / node.length, 1.0) if node.length else 0.0


def _kept(nodes: list[Node]) -> list[Node]:
    best = max((n for n in nodes if n.parent and n.tag not in ("html", "p", "a", "span")), key=lambda n: n.score, default=nodes[0])
    if not best.score:
        return [next((n for tag in ("article", "main", "body") for n in nodes if n.tag == tag), nodes[0])]
    up: Node | None = best
    while up:
        if up.tag in ("article", "main") and _density(up) < 0.5:
            return [up]
        up = up.parent
    if not best.parent or best.tag == "body":
        return [best]
    out: list[Node] = []
    heads: list[Node] = []
    for k in best.parent.kids:
        if isinstance(k, str):
            continue
        like = k.tag in PARAGRAPHS and not k.links and (k.length > 80 or k.length >= MIN_PARAGRAPH and k.own > 1) or k.tag in PARAGRAPHS and k.length > 80 and _density(k) < 0.25
        if k is best or k.score >= 0.2 * best.score or like:
            out += [*heads, k]
            heads = []
        elif k.tag in HEADINGS and not k.links:
            heads.append(k)  # kept if what it heads is
        else:
            heads = []
    return out


def _without_links(node: Node) -> None:
    """Lists and sections inside it that are mostly links go."""
    todo = [node]
    while todo:
        x = todo.pop()
        x.kids = [k for k in x.kids if isinstance(k, str) or not (k.tag in LISTS and k.links and _density(k) >= 0.5)]
        todo += [k for k in x.kids if not isinstance(k, str)]


def blocks(node: Node) -> list[str]:
    """Text blocks below a node, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.kids)
        elif x.tag == "br":
            run.append(" ")
        else:
            todo += reversed(x.kids)
    flush()
    return out


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    nodes = _order(root)
    score(nodes)
    kept = _kept(nodes)
    for node in kept:
        _without_links(node)
    return "\n".join(b for node in kept for b in blocks(node))


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in ``text`` (in place of a column of that name) instead of the markup."""
    keep = [f for f in pages.schema.fields if f.name not in (html, text)]
    schema = T.StructType([*keep, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array([extract(x) for x in part.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + [texts], [f.name for f in keep] + [text])

    return pages.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
