"""Main text of HTML pages by composite text density.

1. Density.  Every DOM node has its characters per tag, adjusted for the share of its text that is link text.
2. Sums.  The densities of a node's children are summed; the node with the largest sum holds the article (``densest``).
3. Threshold.  The smallest density on the path from body to that node, and of the nodes that reach it the one with the largest sum.
4. Widening.  From that node upwards to body, what stands beside the path is kept if it reaches the threshold, holds a heading or is prose
   (``kept_beside``); within an article or main nothing is left out but what its links or its class show to be none of it.

Parts that are no article whatever their density (menus, page heads and feet, sidebars, forms, notices, adverts, reader comments, scripts) go
before densities are computed, by tag, role, attribute or class.  A class or id alone does not prune what holds main or h1, an article at least
as long as all text that no class prunes, or most of the text outside links (unless it names a discussion); nor does the tag form.

Tags, attributes, comments and the ends that a start tag implies are read by the rules of the HTML standard, in time linear in the page.

Defined results: null or empty html has an empty text; html without markup is one block; a page that ends anywhere, even within a tag or a
character reference, is read as far as it goes; equal sums go to the outer node that comes first; repeated rows are extracted each by itself;
columns beyond page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
PRUNED = frozenset("nav footer aside button dialog menu head noscript template svg math object select canvas audio video input".split()) | RAW
FOREIGN = frozenset({"svg", "math"})
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LANDMARKS = frozenset({"article", "main"})
#: Start tags that close an open p, and elements that bound the search for what an end tag or an implied end closes.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
SCOPE = frozenset("table td th caption html body article section div main aside nav header footer blockquote form ul ol".split())
#: A node of these holds blocks; any other stands for the nearest one above it.
HOLDERS = frozenset("html body div section article main td center blockquote form header hgroup #root".split())

#: Parts of a class or id that name what is no article.
HARD = frozenset(
    "ad ads advert advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar widget widgets related recommended recommendations share sharing social".split()
)
#: Of these, what may hold most of a page's text without being its article.
TALK = frozenset("comment comments commentlist replies respond disqus discussion".split())
#: Parts that name a page's frame, but also the head and foot of an article.
SOFT = frozenset("header masthead topbar toolbar footer foot legal disclaimer copyright skip tags tag byline search rail side meta".split())
#: A class that begins so speaks of the layout.
LAYOUT = frozenset("with no has without is not".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

_VALUE = r"(?>\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)"
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?>\s*+=\s*+{_VALUE}?+)?+"
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[\s/]++|{_ATTRIBUTE})*+)(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?>\s*+=\s*+({_VALUE})?+)?+", re.S)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
PROSE_CHARS = 80


class Node:
    """``hard``, ``talk`` and ``soft`` say what a class or id names; ``subs`` are the children that are nodes."""

    drop = hard = talk = soft = headed = False
    own = chars = link_chars = tags = link_tags = 0
    density = sum = 0.0

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.subs = tag, parent, [], []

    def kids(self) -> list[Node]:
        return [x for x in self.subs if not x.drop]


def _names(node: Node, value: str) -> None:
    for token in value.lower().split():
        parts = [x for x in re.split(r"[-_:]+", token) if x]
        if parts and parts[0] not in LAYOUT:
            ends = {parts[0], parts[-1], token}
            node.talk |= bool(ends & TALK)
            node.hard |= bool(ends & HARD)
            node.soft |= bool(ends & SOFT)


def _describe(node: Node, attrs: str, in_landmark: bool) -> None:
    tag = node.tag
    if tag in PRUNED or (tag == "header" and not in_landmark):
        node.drop = True
    elif tag == "form":
        node.hard = True
    if not attrs or tag in ("html", "body") or node.drop:
        return
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value)
        if name == "hidden" or (name == "role" and value.strip().lower() in ROLES) or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and HIDDEN.search(value)):
            node.drop = True
        elif name in ("class", "id"):
            _names(node, value)


def parse(text: str) -> Node:
    """A tree of nodes; the children of a node are nodes and strings, with character references decoded."""
    root = Node("#root", None)
    stack, at, end = [root], 0, len(text)
    places: dict[str, list[int]] = defaultdict(list)  # of open elements by tag
    scopes, blocks, landmarks = [0], [0], 0

    def pop(to: int) -> None:
        nonlocal landmarks
        while len(stack) > to:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in SCOPE:
                scopes.pop()
            if tag in BLOCKS:
                blocks.pop()
            landmarks -= tag in LANDMARKS

    def last(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def add(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece) if "&" in piece else piece)

    while at < end:
        m = TOKEN.search(text, at)
        if m is None:
            add(text[at:])
            break
        add(text[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag, attrs = m["tag"].lower(), m["attrs"]
        if m["close"]:
            # An end tag does not reach over a container, that of an inline element not over any block.
            bound = 0 if tag in SCOPE else scopes[-1] if tag in BLOCKS else blocks[-1]
            if last(tag) > bound:
                pop(last(tag))
            continue
        if tag in CLOSES_P or tag in ("td", "th", "tr", "table"):
            if (foreign := last(*FOREIGN)) > scopes[-1]:
                pop(foreign)
            closed = [last("p")] + ([last("li")] if tag == "li" else [last("dt"), last("dd")] if tag in ("dt", "dd") else [])
            closed = [x for x in closed if x > scopes[-1]]
            if closed and tag in CLOSES_P:
                pop(min(closed))
            elif tag in ("td", "th") and last("td", "th") > last("table", "tr"):
                pop(last("td", "th"))
            elif tag == "tr" and (row := max(last("tr"), 0)) > last("table"):
                pop(row)
        node = Node(tag, stack[-1])
        _describe(node, attrs, landmarks > 0)
        stack[-1].children.append(node)
        stack[-1].subs.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(text, at)
            at = close.end() if close else end
        elif tag not in VOID and not (attrs.endswith("/") and last(*FOREIGN)):
            places[tag].append(len(stack))
            if tag in SCOPE:
                scopes.append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            landmarks += tag in LANDMARKS
            stack.append(node)
    return root


def walk(root: Node) -> list[Node]:
    """Nodes before their children, in page order, without pruned ones."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += reversed(node.kids())
    return out


def prune(root: Node) -> Node:
    """Drop the nodes that go by their class or id, but none that holds the article."""
    nodes = walk(root)
    if not any(n.hard or n.talk for n in nodes):
        return root
    for n in nodes:
        n.own = sum(len(x.strip()) for x in n.children if isinstance(x, str))

    def plain(skip) -> dict[int, int]:
        """Characters outside links of every subtree, without those of nodes to skip."""
        out: dict[int, int] = {}
        for n in reversed(nodes):
            out[id(n)] = 0 if n.tag == "a" or skip(n) else n.own + sum(out[id(x)] for x in n.kids())
        return out

    outside = plain(lambda n: n.hard or n.talk)
    unnamed = outside[id(root)]
    most = plain(lambda n: n.talk)
    own = plain(lambda n: False)
    # Where something that is not named so is marked as the article, what is named so is not it, however long.
    reached, stack = [], [root]
    while stack:
        reached.append(n := stack.pop())
        stack += [x for x in n.kids() if x.tag == "form" or not (x.hard or x.talk)]
    marked = any(outside[id(n)] > 0 and (n.tag in LANDMARKS or n.tag == "h1") for n in reached)
    every = most[id(root)]
    holds: dict[int, bool] = {}
    for n in reversed(nodes):
        inside = any(holds.get(id(x), False) for x in n.kids())
        if (n.hard or n.talk) and not inside and (n.talk or marked or 2 * most[id(n)] <= every):
            n.drop = True
        holds[id(n)] = not n.drop and (inside or (n.tag in ("main", "h1") and own[id(n)] > 0) or (n.tag == "article" and most[id(n)] > 0 and most[id(n)] >= unnamed))
    return root


def measure(nodes: list[Node]) -> None:
    """Characters, tags, link characters and link tags of every subtree; densities; sums of the children's densities."""
    for node in reversed(nodes):
        c, t, lc, lt, headed = 0, 0, 0, 0, node.tag in HEADINGS
        for x in node.children:
            if isinstance(x, str):
                c += len(SPACE.sub(" ", x).strip())
            elif not x.drop:
                c, t, lc, lt, headed = c + x.chars, t + 1 + x.tags, lc + x.link_chars, lt + x.link_tags, headed or x.headed
        if node.tag == "a":
            lc, lt = c, t + 1
        node.chars, node.tags, node.link_chars, node.link_tags, node.headed = c, t, lc, lt, headed
    top = nodes[0]
    share = top.link_chars / top.chars if top.chars else 0.0
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = math.log(c / max(c - lc, 1) * max(lc, 1) + share * c + math.e)
            node.density = c / t * max(0.0, math.log(c / max(lc, 1) * t / max(lt, 1), base))
        if node.subs:
            node.sum = sum(x.density for x in node.subs if not x.drop)


def path(node: Node, top: Node) -> list[Node]:
    """From a node up to ``top``."""
    out = [node]
    while out[-1] is not top:
        out.append(out[-1].parent)
    return out


def densest(nodes: list[Node]) -> tuple[Node, float]:
    """The maximum-sum subtree among the nodes that reach the threshold, and the threshold; ``nodes`` starts with body and is measured."""
    body = nodes[0]
    best = max(nodes, key=lambda n: n.sum)
    if best.sum <= 0:
        return body, body.density
    threshold = min(n.density for n in path(best, body))
    return max((n for n in nodes if n.density >= threshold), key=lambda n: n.sum), threshold


def _linked(node: Node) -> bool:
    """A block that is mostly links."""
    return node.tag in BLOCKS and node.tag not in HEADINGS and node.link_tags > 0 and node.link_chars * (2 if node.soft or node.tag != "p" else 1) > node.chars - 1


def _prose(node: Node) -> bool:
    end = node
    while isinstance(end, Node):
        end = next((x for x in reversed(end.children) if (not x.drop and x.chars if isinstance(x, Node) else x.strip())), "")
    return node.chars - node.link_chars >= PROSE_CHARS and 2 * node.link_chars <= node.chars and bool(SENTENCE.search(end))


def kept_beside(node: Node, threshold: float, landmark: bool) -> bool:
    """Whether a node beside the path from the article's node to body is part of the article."""
    if not node.chars or _linked(node):
        return False
    if landmark:
        return True
    if node.soft and not node.headed:
        return False
    return node.tag in HEADINGS | {"header", "hgroup"} or (node.tag in BLOCKS and (node.density >= threshold or _prose(node) or (node.headed and any(x.tag == "h1" for x in walk(node)))))


def chosen(root: Node) -> list[Node | str]:
    """The subtrees (and texts beside them) that are the main text, in page order; what they hold and is none of it is dropped."""
    body = next((n for n in walk(root) if n.tag == "body"), root)
    nodes = walk(body)
    measure(nodes)
    if not body.chars:
        return []
    best, threshold = densest(nodes)
    # A landmark below the node whose text outside links is most of the node's is its article.
    inner = [n for n in walk(best) if n.tag in LANDMARKS and 2 * (n.chars - n.link_chars) > best.chars - best.link_chars]
    if inner:
        best = inner[-1]
    up = path(best, body)
    marks = [i for i, n in enumerate(up) if n.tag in LANDMARKS]
    holder = next((i for i, n in enumerate(up) if n.tag in HOLDERS), len(up) - 1)
    out: list[Node | str] = [up[holder]]
    _tidy(up[holder], bool(marks), threshold)
    for i in range(holder + 1, len(up)):
        if marks and i > marks[-1]:
            break
        parent, below, landmark = up[i], up[i - 1], bool(marks) and i <= marks[-1] and (up[marks[-1]].tag == "article" or i <= marks[0])
        spot = parent.children.index(below)
        before, after = [[x for x in part if (kept_beside(x, threshold, landmark) if isinstance(x, Node) and not x.drop else landmark and isinstance(x, str) and x.strip())] for part in (parent.children[:spot], parent.children[spot + 1 :])]
        for x in (*before, *after):
            if isinstance(x, Node):
                _tidy(x, landmark, threshold)
        out = [*before, *out, *after]
    return out


def _tidy(top: Node, landmark: bool, threshold: float) -> None:
    """Drop blocks below ``top`` that are lists of links, and a page's frame if ``top`` is the page."""
    page = top.tag in ("body", "#root", "html") and not landmark
    stack = top.kids()
    while stack:
        node = stack.pop()
        if (node.link_tags >= 3 and node.tag in BLOCKS and node.tag not in HEADINGS | {"p"} and node.link_chars * 5 >= node.chars * 4) or (page and node.soft and not node.headed):
            node.drop = True
        else:
            stack += [x for x in node.kids() if x.link_tags >= 3 or page]


def blocks(tops: list[Node | str]) -> list[str]:
    """Text blocks in page order: runs of text without a block boundary, white space made one space."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append(text)
            run.clear()

    for top in tops:
        stack: list = [top]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(x)
            elif not x.drop:
                if x.tag == "br":
                    run.append(" ")
                if x.tag in BLOCKS:
                    close()
                    stack.append(None)
                stack += reversed(x.children)
        if not isinstance(top, str):
            close()
    close()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(chosen(prune(parse(page))))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    # The html goes to Python as text; rows and their order within a task are kept, nothing is shuffled.
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
