"""Extraction against a plain version over random trees; what an article keeps; pages that nest without end."""

import random
import time

import pytest

from lakequill.llm.html_text import main_text

PROSE = "This paragraph has a good length, some commas, and says what an article says in its own words."


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><p>{PROSE}</p><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul><p>{PROSE}</p></article>", f"{PROSE} one two {PROSE}"),
    (f"<article><p>{PROSE}</p><section><h2>References</h2><p><a href=1>A long title of a paper</a></p><p><a href=2>Another title</a></p></section></article>", f"{PROSE} References A long title of a paper Another title"),
    (f"<article><p>{PROSE}</p><div class='related-work'><p>{PROSE}</p></div></article>", f"{PROSE} {PROSE}"),
    (f"<article><p>{PROSE}</p><div class='related'><p>{PROSE}</p></div><div class='related-posts'><p>{PROSE}</p></div></article>", PROSE),
    (f"<article><p>{PROSE}</p><div class='text-notice'><p>{PROSE}</p></div></article>", PROSE),
    (f"<article><p>{PROSE}</p><svg width=1><p>{PROSE} 2</p></article>", f"{PROSE} {PROSE} 2"),
    (f"<title>T<body><article><p>{PROSE}</p></article>", PROSE),
    (f"<article><p>{PROSE}</p><script>var x = '<p>no</p>'", PROSE),
    (f"<section><div><p>{PROSE}</p></div><div><p>{PROSE} 2</p></div><ul><li><a href=1>menu</a></li><li><a href=2>more</a></li></ul></section>", f"{PROSE} {PROSE} 2"),
])
def test_what_an_article_keeps(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", [
    "<b>" * 100_000 + "<div>x</div>" * 20_000, "<p>x" + "<b>" * 50_000 + "<p>y</i>" * 20_000, "<div>" * 100_000 + PROSE, "</b>" * 200_000 + PROSE,
    "<p><div>" + "<b>" * 50_000 + "</p>" * 50_000, "<svg>" * 100_000 + PROSE, "<header>" * 50_000 + PROSE, "<li>" * 100_000, "<ul><li>" * 50_000, "<a href=x>" * 100_000 + PROSE, "<" * 300_000,
    "<table><tr><td>" * 30_000 + PROSE, "<!--" * 100_000, "&" * 300_000, "<p a='" * 50_000,
])
def test_pages_without_end_tags_take_linear_time(page):
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 8


class Node:
    def __init__(self, tag, name="", children=(), text=""):
        self.tag, self.name, self.children, self.text = tag, name, list(children), text

    def page(self):
        name = f" class='{self.name}'" if self.name else ""
        return f"<{self.tag}{name}>{self.text}" + "".join(c.page() for c in self.children) + f"</{self.tag}>"

    def size(self):
        return len(self.text) + sum(c.size() for c in self.children)

    def linked(self):
        return self.size() if self.tag == "a" else sum(c.linked() for c in self.children)

    def density(self):
        return self.linked() / self.size() if self.size() else 0.0

    def own(self):
        return [self.text] + [c.text for c in self.children if c.tag == "a"]

    def blocks(self):
        own = "".join(self.own())
        return ([own] if own else []) + [b for c in self.children if c.tag != "a" for b in c.blocks()]


def grown(r, depth=0):
    words = lambda: " ".join(r.choice(("word", "and,", "other", "longer")) for _ in range(r.choice((2, 8, 30))))
    if depth >= 3 or r.random() < 0.4:
        links = [Node("a", text=words()) for _ in range(r.randrange(2))] if r.random() < 0.3 else []
        return Node("p", text=words(), children=links)
    return Node(r.choice(("div", "section")), r.choice(("", "", "body", "x")), [grown(r, depth + 1) for _ in range(r.randrange(1, 5))])


def plain(root):
    """The rules as they are told, by recursion over the tree."""
    given, order, up = {}, [], {}

    def visit(node):
        order.append(node)
        for c in node.children:
            up[c] = node
            visit(c)

    visit(root)
    for node in order:
        own = sum(map(len, node.own()))
        if node.tag in ("p", "div", "section") and own:
            points = (1 + sum(t.count(",") for t in node.own()) + min(own / 100, 3)) * (1 if own >= 25 else 0.2) * (1 - node.density())
            x = node if node.tag != "p" else up[node]
            while True:
                given[x] = given.get(x, 0) + points
                if x not in up:
                    break
                x, points = up[x], points / 2
    scores = {x: (p + 25 * (x.name == "body")) * (1 - x.density()) for x, p in given.items()}
    if not scores:
        return None
    best = max(scores, key=lambda x: (scores[x], -order.index(x)))
    if best is root:
        return " ".join(texts(root, True))
    near = [best]
    for x in up[best].children:
        own = sum(map(len, x.own()))
        if x is not best and (x.tag == "p" and (own > 80 and x.density() < 0.25 or own and not x.linked()) or scores.get(x, 0) >= 0.2 * scores[best]):
            near.append(x)
    if sum(x in scores for x in near) > 1 and up[best] is not root:
        rest = [x for x in up[best].children if x in near or x.tag == "p" or x.density() <= 0.6]
        own = "".join(t.text for t in up[best].children if t.tag == "a")
        assert not own
    else:
        rest = [x for x in up[best].children if x in near]
    return " ".join(b for x in rest for b in texts(x, x in near))


def texts(node, whole):
    if whole:
        return node.blocks()
    own = "".join(node.own())
    return ([own] if own else []) + [b for c in node.children if c.tag != "a" for b in (texts(c, False) if c.tag == "p" or c.density() <= 0.6 else [])]


def test_random_trees():
    r, seen = random.Random(17), 0
    for _ in range(400):
        root = Node("body", children=[grown(r) for _ in range(r.randrange(1, 4))])
        want = plain(root)
        if want is not None:
            seen += 1
            assert main_text(root.page()) == want
    assert seen > 100
