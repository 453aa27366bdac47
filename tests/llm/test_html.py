"""Main text of pages: cases, a plain second implementation of the densities on random trees, and time on deep pages."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from quillgraph.llm import html_text

LONG = "A long sentence of prose that goes on, so that it is text of the article itself."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # What an article has in parts named like a page's frame stays.
        (f"<article><div class='article-header'><h1>T</h1></div><p>{LONG}</p><figure><figcaption>C</figcaption></figure><p><label>L</label> m</p><div class=legal>N.</div></article>", ["T", LONG, "C", "L m", "N."]),
        # Attribute names and unquoted values by the standard.
        (f"<p hidden-note>{LONG}</p><p class=it's>First.</p><p>It's the second.</p>", [LONG, "First.", "It's the second."]),
        (f"<!--><p>{LONG}</p><!--->x<!-- a --!>y<p hidden>z</p>", [LONG, "xy"]),
        # A heading and an introduction in an element of their own.
        (f"<div><a href=x>Home</a> <a href=y>News</a></div><div><h1>H</h1><p>Intro.</p></div><div><p>{LONG}</p><p>{LONG}</p></div><div>&copy; X</div>", ["H", "Intro.", LONG, LONG]),
        # Wrappers, sidebars, comments longer than the article, a form around all of it.
        (f"<form><div class='page with-sidebar'><div class=has-comments><h1>H</h1><p>{LONG}</p><p>So.</p></div><div class=sidebar><p>{LONG * 9}</p></div><div id=comments><p>{LONG * 9}</p></div></div><div class=footer>&copy; X</div></form>", ["H", LONG, "So."]),
        (f"<main><div class=ad>{LONG * 3}</div><h1>H</h1><p>{LONG}</p><section class=comments><article class=comment><p>{LONG * 5}</p></article></section></main>", ["H", LONG]),
        # The text is that of the densest part, also where there are landmarks.
        (f"<article><p>x</p></article><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", [LONG, LONG, LONG]),
        (f"<body><div class=header>Site</div><h1>H</h1><p>{LONG}</p><p>To.</p><div class=footer>F</div></body>", ["H", LONG, "To."]),
        (f"<article><h1>H</h1><p>{LONG} See <a href=1>one</a>.</p><ul><li><a href=1>one one</a><li><a href=2>two two</a><li><a href=3>three three</a></ul></article>", ["H", f"{LONG} See one."]),
        (f"<table><tr><td>{LONG}<td>x</table>", [LONG, "x"]),
        (f"<svg><path d=1 /><p>{LONG}</p>", [LONG]),
        (f"<script>var a='</p>'</script ><p>{LONG}</p><style>", [LONG]),
    ],
)
def test_cases(html, want):
    assert html_text.main_text(html) == "\n".join(want)


class Naive(HTMLParser):
    """Lists [tag, children] for pages whose elements are all closed."""

    def __init__(self):
        super().__init__()
        self.stack = [["#root", []]]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def every(node):
    return [node, *(x for c in node[1] if isinstance(c, list) for x in every(c))]


def chars(node, inside=False):
    """(characters, characters in links)."""
    inside = inside or node[0] == "a"
    got = [(len(c.strip()),) * 2 if isinstance(c, str) and inside else (len(c.strip()), 0) if isinstance(c, str) else chars(c, inside) for c in node[1]]
    return sum(x for x, _ in got), sum(y for _, y in got)


def link_tags(node, inside=False):
    return sum((inside or node[0] == "a" or c[0] == "a") + link_tags(c, inside or node[0] == "a") for c in node[1] if isinstance(c, list))


def density(node, body):
    c, lc = chars(node)
    t, lt = len(every(node)) - 1, link_tags(node) + (node[0] == "a")
    bc, blc = chars(body)
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * max(lc, 1) + blc / bc * c + math.e)
    return c / max(t, 1) * max(0.0, math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / math.log(base))


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 4)):
        if depth > 4 or rng.random() < 0.45:
            out.append(rng.choice(["x", "some words", "a few more words than before.", ""]) or "<b>q</b>")
        else:
            tag = rng.choice(["div", "section", "div", "a", "b", "span"]) if depth < 4 else "span"
            tag = "span" if tag == "a" and depth > 2 else tag
            out.append(f"<{tag}>" + (random_page(rng, 5 if tag in ("a", "b", "span") else depth + 1)) + f"</{tag}>")
    return "".join(out)


def test_densities_against_a_plain_reading():
    rng = random.Random(8)
    for _ in range(60):
        page = f"<body>{random_page(rng)}</body>"
        naive = Naive()
        naive.feed(page)
        body = naive.stack[0][1][0]
        nodes = html_text.walk(html_text.parse(page))[1:]
        html_text.measure(nodes)
        plain = every(body)
        assert [n.tag for n in nodes] == [n[0] for n in plain]
        assert [round(n.density, 6) for n in nodes] == [round(density(n, body), 6) for n in plain]
        sums = [sum(density(c, body) for c in n[1] if isinstance(c, list)) for n in plain]
        assert [round(n.sum, 6) for n in nodes] == [round(x, 6) for x in sums]
        best = max(range(len(plain)), key=lambda i: round(sums[i], 9))
        if sums[best] > 0:
            got, threshold = html_text.densest(nodes)
            assert round(got.sum, 6) == round(sums[best], 6)
            above = [density(n, body) for n in plain if any(x is plain[best] for x in every(n))]
            assert round(threshold, 6) == round(min(above), 6)


@pytest.mark.parametrize("page", ["<b>" * 100_000, "<div>" * 50_000 + "x", "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000, "<b>" * 20_000 + "<p>x" * 20_000, '<p class="' + "x" * 200_000, "<a " + "b " * 100_000, "<!--" * 50_000])
def test_time_is_linear(page):
    html_text.main_text(page[:1000])
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 8  # quadratic work would take minutes
