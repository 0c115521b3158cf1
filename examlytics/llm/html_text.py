"""Main text of web pages by composite text density (operator 2).

For every DOM node the link-adjusted characters per tag (composite text density,
CTD) is computed, with C characters, T tags, LC link characters, LT link tags
below the node and the body's own figures (index b):

    CTD = C / T * log[ln(C / (C - LC) * LC + LC_b / C_b * C + e)](C / LC * T / LT)

Zero denominators count as one. A node's density sum is the sum over its
children. The container (a block that can hold paragraphs) with the largest sum
is kept whole; of equal sums, that of an article or main element, then the outer
one. The smallest density on its path to the body is the threshold: every other
subtree of the body whose density reaches it is kept too, whole, and so is bare
text (with the inline elements in it) on the path, unless most of it is links.
Element names choose nothing else. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments (by element, role, class and
id) take no part.

Blocks: a block-level element starts and ends a block; a line break is white
space. Character references are decoded, white space inside a block becomes one
space, blocks are trimmed, empty ones dropped, the rest joined by two \\n.

Each page is handled on its own, whole, by a mapInArrow pass without a shuffle.
Defined cases: a null or empty html gives an empty text; text without any markup
is one block; unclosed and stray tags are repaired as browsers do; repeated rows
and null ids or urls pass through; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard and naming habits of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Blocks that are a paragraph, heading, item or caption, and no container, unless a block is below them.
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd li td th caption figcaption summary legend option address hr".split())
NOT_TEXT = frozenset(
    "head nav aside form footer script style textarea title xmp iframe noembed noframes noscript template svg math object canvas "
    "button select input label fieldset dialog audio video".split()
)
CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}),
    "dt": ("dt dd", {"dl"}),
    "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th", {"table"}),
    "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}),
    "option": ("option", {"select"}),
    "tbody": ("tr td th thead tbody tfoot", {"table"}),
    "tfoot": ("tr td th thead tbody tfoot", {"table"}),
}
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars aside nav "
    "navbar navigation menu menus breadcrumb breadcrumbs masthead header topbar footer bottombar cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus reply replies "
    "respond discussion related recommended recommendations share sharing social widget widgets toolbar pagination pager copyright "
    "disclaimer login search skip".split()
)
OWN = frozenset("article entry post story content main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    noise: bool
    kids: list = field(default_factory=list)  # node numbers and pieces of text, in page order
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0


def is_noise(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in NOT_TEXT or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "main", "article") or not attrs:
        return tag == "article" and bool(_names(attrs) & {"comment", "comments", "reply"})
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or got.get("role", "").lower() in NOISE_ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return True
    names = _names(attrs)
    bad = names & NOISE
    return bool(bad) and not (bad <= {"header", "banner"} and names & OWN)


def _names(attrs: str) -> set[str]:
    """Words of class and id, cut at punctuation and at capitals."""
    got = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    text = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{got.get('class', '')} {got.get('id', '')}")
    return set(re.split(r"[^a-z0-9]+", text.lower()))


def parse(page: str) -> list[Node]:
    """The DOM as a list of nodes in page order; node 0 is the root."""
    nodes = [Node("#root", -1, False)]
    stack = [0]
    article = 0  # open article and main elements
    pos = 0

    def text(s: str) -> None:
        if s:
            nodes[stack[-1]].kids.append(s)

    def close_to(depth: int) -> None:
        nonlocal article
        for n in stack[depth:]:
            article -= nodes[n].tag in ("article", "main")
        del stack[depth:]

    while pos < len(page):
        lt = page.find("<", pos)
        if lt < 0:
            text(page[pos:])
            break
        m = TAG.match(page, lt)
        if not m:  # a bare less-than sign
            text(page[pos : lt + 1])
            pos = lt + 1
            continue
        text(page[pos:lt])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    close_to(depth)
                    break
                if tag not in BLOCK and nodes[stack[depth]].tag in BLOCK:
                    break  # an inline end tag never closes a block
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if nodes[stack[depth]].tag == "p":
                    close_to(depth)
                    break
                if nodes[stack[depth]].tag in BLOCK:
                    break
        if tag in CLOSES:
            shut, limit = CLOSES[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag in limit:
                    break
                if nodes[stack[depth]].tag in shut.split():
                    close_to(depth)
        if tag == "body" and any(nodes[n].tag == "head" for n in stack):
            close_to(next(d for d, n in enumerate(stack) if nodes[n].tag == "head"))
        up = nodes[stack[-1]]
        nodes.append(Node(tag, stack[-1], up.noise or is_noise(tag, m[3], article > 0)))
        up.kids.append(len(nodes) - 1)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(len(nodes) - 1)
            article += tag in ("article", "main")
    return nodes


def measure(nodes: list[Node]) -> None:
    """Characters and tags below every node, noise left out; children come after parents in the list."""
    linked = [False] * len(nodes)
    for i, n in enumerate(nodes):
        linked[i] = n.tag == "a" or (n.parent >= 0 and linked[n.parent])
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.noise:
            continue
        own = sum(len(SPACE.sub(" ", entities.unescape(k)).strip()) for k in n.kids if isinstance(k, str))
        n.chars += own
        n.link_chars += own if linked[i] else 0
        if n.parent >= 0:
            up = nodes[n.parent]
            up.chars += n.chars
            up.link_chars += n.link_chars
            up.tags += n.tags + 1
            up.link_tags += n.link_tags + (n.tag == "a")


def density(n: Node, body: Node) -> float:
    """Composite text density of a node."""
    c, t = n.chars, max(n.tags, 1)
    if not c:
        return 0.0
    plain = max(c - n.link_chars, 1)
    base = math.log(c / plain * n.link_chars + body.link_chars / max(body.chars, 1) * c + math.e)
    power = c / max(n.link_chars, 1) * t / max(n.link_tags, 1)
    # base is 1 without any link: its logarithm is floored, which scales all nodes alike
    return c / t * math.log(max(power, 1.0)) / max(math.log(base), 0.1)


def select(nodes: list[Node]) -> list[int | str | None]:
    """Subtrees and pieces of text that make up the article, in page order; None ends a block."""
    body = next((i for i, n in enumerate(nodes) if n.tag == "body"), 0)
    if not nodes[body].chars:
        body = 0
    live = [i for i in range(len(nodes)) if not nodes[i].noise]
    dens = {i: density(nodes[i], nodes[body]) for i in live}
    total = dict.fromkeys(live, 0.0)
    inside = {body}
    for i in live:
        if nodes[i].parent in total:
            total[nodes[i].parent] += dens[i]
        if nodes[i].parent in inside:
            inside.add(i)
    over = [False] * len(nodes)  # a block is below the node
    for i in range(len(nodes) - 1, 0, -1):
        over[nodes[i].parent] |= over[i] or nodes[i].tag in BLOCK
    containers = [i for i in live if i in inside and (i == body or (nodes[i].tag in BLOCK and (over[i] or nodes[i].tag not in PARAGRAPH)))]
    best = max(containers, key=lambda i: (total[i], nodes[i].tag in ("article", "main"), -i), default=body)
    if not total.get(best):
        return [body]
    path = {best}
    at = best
    while at != body:
        at = nodes[at].parent
        path.add(at)
    threshold = min(dens[i] for i in path)
    out: list[int | str | None] = []
    stack: list = [body]
    while stack:
        k = stack.pop()
        if k is None:
            out.append(None)
        elif isinstance(k, list):
            out.extend(k)
        elif k == best or (k not in path and dens[k] >= threshold):
            out.append(k)
        else:
            parts: list = []
            for inline, run in groupby(nodes[k].kids, lambda x: isinstance(x, str) or not (over[x] or nodes[x].tag in BLOCK)):
                if inline:
                    run = list(run)
                    parts += [None, run if _is_text(nodes, run, nodes[body], None if k in path else threshold) else None]
                else:
                    parts += [x for x in run if x in dens and nodes[x].chars]
            stack.extend(reversed([None, *parts, None]))
    return out


def _is_text(nodes: list[Node], run: list, body: Node, threshold: float | None) -> bool:
    """Whether a run of bare text and inline elements between two blocks is text: beside the path to the body as dense as the threshold, on it mostly not links."""
    n = Node("#run", -1, False)
    for k in run:
        if isinstance(k, str):
            n.chars += len(SPACE.sub(" ", entities.unescape(k)).strip())
        elif not nodes[k].noise:
            n.chars += nodes[k].chars
            n.link_chars += nodes[k].link_chars
            n.tags += nodes[k].tags + 1
            n.link_tags += nodes[k].link_tags + (nodes[k].tag == "a")
    return n.chars > 2 * n.link_chars if threshold is None else n.chars > 0 and density(n, body) >= threshold


def blocks(nodes: list[Node], roots: list[int | str | None]) -> list[str]:
    """Texts of the blocks below the roots, in page order."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        s = SPACE.sub(" ", entities.unescape("".join(now))).strip()
        now.clear()
        if s:
            out.append(s)

    stack: list = [*reversed(roots)]
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            now.append(k)
        elif not nodes[k].noise:
            n = nodes[k]
            if n.tag == "br":
                now.append(" ")
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(reversed(n.kids))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page as blocks joined by two line feeds."""
    if not page:
        return ""
    nodes = parse(page)
    measure(nodes)
    return "\n\n".join(blocks(nodes, select(nodes)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(x.as_py()) for x in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op2_html_text: the main text of every row of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
