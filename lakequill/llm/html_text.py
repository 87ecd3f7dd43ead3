"""Main text of web pages by tree scoring.

A page is read into a tree that tolerates missing and crossing end tags. Menus, headers, footers, sidebars, notices,
adverts, forms and comments are known by their elements, roles and names and are left out. Each paragraph gives points
for its length and commas to its parent, half as many to the grandparent, and half as many again with each step up to
the root; a container's points are discounted by the share of its text inside links. The best container is kept, with
those of its siblings that score well or are paragraphs of prose, and its text is returned in page order. Where several
containers score well side by side, they are parts of the one around them, whose other text is kept, too, but for lists
of links. Within a container that scored, nothing is dropped for its links: they are the article's own.

Reading, scoring and collecting take time in proportion to the page, however its tags nest.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Elements by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form button select menu dialog input textarea script style title iframe noscript template svg math object embed audio video canvas".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article figcaption".split())
ENDS_P = BLOCK - {"br", "option", "button", "legend", "caption", "summary"}
#: Elements that a start tag of the same kind ends, and the containers that keep it from doing so.
SAME = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adbox|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|"
    r"sidebar\w*|comments?|commentlist|disqus\w*|repl(?:y|ies)|discussion|respond|shar(?:e|ing)\w*|social\w*|recommend\w*|"
    r"breadcrumbs?|menu\w*|nav\w*|footer\w*|masthead|site-?header|page-?header|popup|modal|overlay|paywall|login|signup|sign-up|paginat\w*|pager|"
    r"skip-link|widget\w*|toolbar|tags|byline-share|hidden|sr-only|visually-hidden)(?:$|[\s_-])"
    r"|(?:^|[\s_-])related(?:[_-]?(?:posts?|articles?|links?|stor(?:y|ies)|content|items?|news|topics?|pages?|reading))?(?:$|\s)"
)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|main|story|text|body|prose)(?:$|[\s_-])")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: An attribute, as HTML's tokenizer takes it: quotes open a value only right after "=", and are ordinary characters elsewhere.
_NAME = r"[^\s/>][^\s/>=]*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)"
    rf"((?:[\s/]+|{_NAME}(?:\s*=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>\"'][^\s>]*)?)?)*+)(>|$)", re.S)  # fmt: skip
_ATTRIBUTE = re.compile(rf"({_NAME})(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"'][^\s>]*))?)?")
_BLANK = re.compile(r"\s+")
#: Raw elements whose text goes on to the page's end where they are not closed; others are then read as if they were empty.
_TO_THE_END = frozenset("script style textarea xmp".split())
_ENDS = {t: re.compile(f"</{t}", re.I) for t in RAW}


class Tree:
    """Elements as parallel lists, parents before children, and the page's texts as (element, text, break before)."""

    def __init__(self, page: str) -> None:
        self.tag: list[str] = ["#root"]
        self.up: list[int] = [0]
        self.weight: list[int] = [0]
        self.dropped: list[bool] = [False]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self.open: dict[str, list[int]] = defaultdict(list)
        self._read(page)

    def _add(self, tag: str, attributes: str, stack: list[int]) -> int:
        weight, drop = 0, tag in DROPPED
        if attributes.strip():
            found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}".lower()
            if tag not in ("html", "body", "article", "main"):
                # one name can say both, as text-notice does, and is bad then
                good = tag in ("div", "section") and "comment" not in names and any(_GOOD.search(x) and not _BAD.search(x) for x in names.split())
                drop |= bool(_BAD.search(names)) and not good
                drop |= found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
                drop |= "display:none" in found.get("style", "").lower().replace(" ", "")
            weight += 25 * bool(_GOOD.search(names))
            weight += 25 * (found.get("role", "").lower() in ("main", "article"))
        weight += {"article": 30, "main": 20}.get(tag, 0)
        if tag == "header":
            drop |= not (self.open["article"] or self.open["main"])
        self.tag.append(tag)
        self.up.append(stack[-1])
        self.weight.append(weight)
        self.dropped.append(drop or self.dropped[stack[-1]])
        return len(self.tag) - 1

    def _push(self, stack: list[int], node: int) -> None:
        self.open[self.tag[node]].append(len(stack))
        stack.append(node)

    def _close(self, stack: list[int], tag: str, stops: tuple[str, ...] = ()) -> None:
        """Close the nearest open element of a tag, unless one of stops is nearer; places of open elements are at hand."""
        at = self.open[tag]
        if at and all(not self.open[x] or self.open[x][-1] <= at[-1] for x in stops):
            n = at[-1]
            while len(stack) > n:
                self.open[self.tag[stack.pop()]].pop()

    def _read(self, page: str) -> None:
        stack, at = [0], 0
        endless: set[str] = set()
        while at < len(page):
            start = page.find("<", at)
            if start < 0:
                self._text(stack[-1], page[at:])
                break
            if start > at:
                self._text(stack[-1], page[at:start])
            m = _TOKEN.match(page, start)
            if m is None:
                self._text(stack[-1], "<")
                at = start + 1
                continue
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag in BLOCK:
                    self.block += 1
                if tag not in VOID:
                    self._close(stack, tag, ("table",) if tag not in ("table", "body", "html") else ())
                continue
            if not m[4]:
                break  # the page ends inside a tag
            if tag in BLOCK:
                self.block += 1
            if tag in ENDS_P:
                self._close(stack, "p", ("article", "section", "div", "td", "li", "table", "main", "body", "blockquote", "button"))
            if tag in SAME:
                self._close(stack, tag, SAME[tag])
                if tag in ("dt", "dd"):
                    self._close(stack, "dd" if tag == "dt" else "dt", SAME[tag])
            node = self._add(tag, m[3], stack)
            if tag in VOID or m[3].endswith("/") and tag in ("svg", "math"):
                continue
            if tag in RAW:
                end = None if tag in endless else _ENDS[tag].search(page, at)
                if end is None:
                    endless.add(tag)
                    if tag not in _TO_THE_END:
                        continue
                at = len(page) if end is None else end.start()
            self._push(stack, node)

    def _text(self, node: int, text: str) -> None:
        if not self.dropped[node]:
            self.texts.append((node, self.block, html.unescape(text)))


def main_text(page: str | None) -> str:
    """The main text of a page; empty if it has none."""
    if not page:
        return ""
    tree = Tree(page)
    n = len(tree.tag)
    length, linked, commas, own = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.up[i]] or tree.tag[i] == "a"
    # text counts for the nearest block element, and in sums for all ancestors
    holder = [0] * n
    for i in range(1, n):
        holder[i] = i if tree.tag[i] in BLOCK else holder[tree.up[i]]
    for node, _, text in tree.texts:
        size = len(text.strip())
        length[node] += size
        linked[node] += size * in_link[node]
        own[holder[node]] += size
        commas[holder[node]] += text.count(",") + text.count("、") + text.count("،")
    for i in range(n - 1, 0, -1):
        length[tree.up[i]] += length[i]
        linked[tree.up[i]] += linked[i]
    if not length[0]:
        return ""

    def density(i: int) -> float:
        return linked[i] / length[i] if length[i] else 0.0

    # what a node's paragraphs give to it, and half of what they give to each of its children
    points, scored = [0.0] * n, [False] * n
    for i in range(n - 1, 0, -1):
        up = tree.up[i]
        if not tree.dropped[i] and tree.tag[i] in PARAGRAPHS and own[i]:
            given = (1 + commas[i] + min(own[i] / 100, 3)) * (1.0 if own[i] >= 25 else 0.2) * (1 - density(i))
            x = i if tree.tag[i] in ("div", "section", "article") else up
            points[x] += given
            scored[x] = True
        points[up] += points[i] / 2
        scored[up] |= scored[i]
    scores = {i: (points[i] + tree.weight[i]) * (1 - density(i)) for i in range(1, n) if scored[i]}
    if not scores:
        chosen = kept = {0}
    else:
        best = max(scores, key=lambda i: (scores[i], -i))
        chosen, parent, enough = {best}, tree.up[best], 0.2 * scores[best]
        for i in range(1, n):
            if tree.up[i] != parent or i == best or tree.dropped[i]:
                continue
            prose = tree.tag[i] in ("p", "blockquote", "pre") and (own[i] > 80 and density(i) < 0.25 or own[i] and not linked[i])
            if prose or scores.get(i, 0) >= enough or tree.tag[i] in ("h1", "h2") and tree.tag[parent] in ("article", "main"):
                chosen.add(i)
        several = sum(i in scores for i in chosen) > 1 and tree.tag[parent] not in ("#root", "html", "body")
        kept = chosen | {parent} if several else chosen
    inside, own_links = [False] * n, [False] * n
    for i in range(n):
        own_links[i] = i in chosen or own_links[tree.up[i]]
        menu = not own_links[i] and i not in kept and tree.tag[i] in ("ul", "ol", "dl", "table", "div", "section") and length[i] and density(i) > 0.6
        inside[i] = (i in kept or inside[tree.up[i]]) and not tree.dropped[i] and not menu
    blocks: list[str] = []
    last, parts = -1, []
    for node, block, text in tree.texts:
        if inside[node]:
            if block != last:
                blocks.append("".join(parts))
                parts, last = [], block
            parts.append(text)
    blocks.append("".join(parts))
    return " ".join(b for b in (_BLANK.sub(" ", x).strip() for x in blocks) if b)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html), from the whole of its html.

    A null or empty page, and one without main text, has the text "". Rows stand alone, so ties, repeated rows and null
    ids need no care. Other columns are not looked at.
    """

    def each(batch: pa.RecordBatch):
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return common.mapped(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), each, "page_id long, url string, text string, n_chars long")
