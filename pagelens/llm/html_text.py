"""Main text of web pages by composite text density.

A page becomes a tree of its elements. Elements that never are article text (menus, page
headers, footers, sidebars, forms, scripts, adverts, notices, reader comments; known by tag,
role or by class and id) are cut off, but no form that wraps the page. Every other node gets its characters per tag,
adjusted for links: text inside links counts against a node, the more so the fewer links the
page has on the whole. The node whose children have the largest sum of densities holds the
main text. What stands beside it is main text too, but for blocks that are mostly links and
less dense than any node on the way from the body to it. An article (or main) element around it, or the only one in it,
is taken whole.

The time is in proportion to the page's length: the parser knows where the last open element
of each name is, so it never looks for one that isn't open.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.words import small_batches

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
HEAD = frozenset("title meta link base style script noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody tfoot thead "
    "tr caption ul".split()
)
CELLS = frozenset("td th".split())
CUT_TAGS = frozenset(
    "head nav aside footer button select option input iframe svg canvas object embed audio video dialog menu search "
    "script style textarea title noscript template noembed noframes".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices newsletter "
    "subscribe subscription comment comments disqus respond replies related recommended share sharing social popup modal "
    "overlay login signup toolbar pagination pager skip".split()
)
# Words that name a box, not what is in it: beside them a word above still says what the box holds.
BOX_WORDS = frozenset(
    "area bar block bottom box button buttons container content fixed footer form group header inner item items left link links list main "
    "outer page post posts reader right section site sticky text top unit user widget wrap wrapper".split()
)
# Words above that also occur in names of article parts: inside an article they cut what is mostly links.
WEAK_WORDS = frozenset("pager recommended related replies respond share sharing skip social".split())
# Start tags that end an open element of the same row.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}}
FENCES = frozenset("ul ol dl table body article section div main".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+)>|<[!?/][^>]*+>""", re.S
)
# Name and value; what stands in a value is never a name.
_ATTRIBUTE = re.compile(r"""(=?+[^\s/=>]++|=)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def hints(names: str) -> set[str]:
    """Words of CUT_WORDS that name a box; a name with other words (related-work, has-sidebar) means something else."""
    found = set()
    for name in names.split():
        words = {w for w in _WORD.findall(name) if not w.isdigit()}
        if words <= CUT_WORDS | BOX_WORDS:
            found |= words & CUT_WORDS
    return found


class Page:
    """Elements in page order: tag, parent, contents (texts and numbers of child elements), cut, hinted, form or not."""

    def __init__(self, source: str):
        self.tag, self.parent, self.contents, self.cut, self.hinted, self.form = ["body"], [0], [[]], [False], [False], [False]
        self.weak, self.within = [False], [False]  # hinted by weak words only; inside an article or main element
        self._open = [0]
        # Places in _open of each name, and of all blocks; the body's is 0.
        self._places: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._parse(source)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._close_from(1)
            return
        opened = self._open
        if self.tag[opened[-1]] == "head" and tag not in HEAD:
            self._close_from(len(opened) - 1)
        if tag in BLOCK:
            self._close_within({"p"}, FENCES)
        if tag in ENDS:
            self._close_within(ENDS[tag], FENCES - {"body"})
        number = len(self.tag)
        self.tag.append(tag)
        self.parent.append(opened[-1])
        self.contents.append([])
        self.contents[opened[-1]].append(number)
        cut, hinted, weak, form = tag in CUT_TAGS, False, True, tag == "form"
        if attributes and not cut:
            known = set()
            for name, *values in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name not in ("class", "id", "role", "hidden") or name in known:
                    continue
                known.add(name)  # of a repeated attribute the first one counts
                value = "".join(values).lower()
                words = _WORD.findall(value)
                if name == "hidden" or (name == "role" and not CUT_ROLES.isdisjoint(words)):
                    cut = True
                elif name == "role":
                    form = form or "form" in words
                else:
                    found = hints(value)
                    hinted = hinted or bool(found)
                    weak = weak and found <= WEAK_WORDS
        within = bool(self._places.get("article") or self._places.get("main"))
        if tag == "header" and not within:
            hinted, weak = True, False
        self.cut.append(cut)
        self.hinted.append(hinted)
        self.weak.append(weak)
        self.within.append(within)
        self.form.append(form)
        if tag not in VOID:
            self._places.setdefault(tag, []).append(len(opened))
            if tag in BLOCK:
                self._blocks.append(len(opened))
            opened.append(number)

    def _close_from(self, place: int) -> None:
        """Close the open elements from this place on."""
        for number in self._open[place:]:
            self._places[self.tag[number]].pop()
        del self._open[place:]
        while self._blocks and self._blocks[-1] >= place:
            self._blocks.pop()

    def _last(self, tags) -> int:
        """Place of the innermost open element with one of these names; 0 if there is none."""
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=0)

    def _close_within(self, tags: set[str], fences: frozenset[str]) -> None:
        place = self._last(tags)
        if place and place > self._last(fences):
            self._close_from(place)

    def _end(self, tag: str) -> None:
        place = self._last((tag,))
        fenced = tag not in BLOCK and tag not in CELLS and self._blocks and self._blocks[-1] > place
        if place and not fenced:
            self._close_from(place)

    def _text(self, text: str) -> None:
        if self.tag[self._open[-1]] == "head" and text.strip():
            self._close_from(len(self._open) - 1)
        self.contents[self._open[-1]].append(html.unescape(text) if "&" in text else text)

    def _parse(self, source: str) -> None:
        at = 0
        last = source.rfind(">")  # no tag ends behind it
        while True:
            m = _TAG.search(source, at) if at <= last or "<!--" in source[at:] else None
            if not m:
                if at < len(source):
                    self._text(source[at:])
                return
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                close = source.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else len(source)
                self._close_from(len(self._open) - 1)

    def sizes(self, out: list[bool]) -> tuple[list[int], list[int]]:
        """Characters outside and inside links, cut elements left out, of every node with all below it."""
        n = len(self.tag)
        prose, linked, inside = [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            inside[i] = self.tag[i] == "a" or inside[self.parent[i]]
        for i in range(n - 1, -1, -1):
            if out[i]:
                continue
            (linked if inside[i] else prose)[i] += sum(len("".join(t.split())) for t in self.contents[i] if isinstance(t, str))
            if i:
                prose[self.parent[i]] += prose[i]
                linked[self.parent[i]] += linked[i]
        return prose, linked

    def _below(self, cut: list[bool]) -> list[bool]:
        out = [False] * len(cut)
        for n in range(1, len(cut)):
            out[n] = out[self.parent[n]] or cut[n]
        return out

    def cut_off(self) -> list[bool]:
        """Elements that are cut, with all below them.

        A hint doesn't count for what holds a heading or an article, nor if the hints leave no
        text at all; a weak one inside an article only for what is mostly links. A form is cut
        unless it holds a heading, an article or most of the text.
        """
        holds = [t in ("h1", "article", "main") for t in self.tag]
        for n in range(len(self.tag) - 1, 0, -1):
            if holds[n]:
                holds[self.parent[n]] = True
        cut = self.cut
        hints = [hint and not h for hint, h in zip(self.hinted, holds, strict=True)]
        if any(hints):
            prose, linked = self.sizes(self._below(cut))
            for n, hint in enumerate(hints):
                if hint and self.weak[n] and self.within[n]:
                    hints[n] = linked[n] > prose[n]
            left, _ = self.sizes(self._below([c or h for c, h in zip(cut, hints, strict=True)]))
            if not left[0]:
                hints = [False] * len(hints)
        cut = [c or h for c, h in zip(cut, hints, strict=True)]
        if any(self.form):
            chars, _ = self.sizes(self._below(cut))
            cut = [c or (f and not h and 2 * k <= chars[0]) for c, f, h, k in zip(cut, self.form, holds, chars, strict=True)]
        return self._below(cut)


def densities(page: Page, cut: list[bool]) -> list[float]:
    """Link-adjusted characters per tag of every node."""
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    inside = [False] * n
    for i in range(1, n):
        inside[i] = page.tag[i] == "a" or inside[page.parent[i]]
    for i in range(n - 1, -1, -1):
        if cut[i]:
            continue
        own = sum(len("".join(t.split())) for t in page.contents[i] if isinstance(t, str))
        chars[i] += own
        if inside[i]:
            link_chars[i] += own
        if i:
            up = page.parent[i]
            chars[up] += chars[i]
            tags[up] += tags[i] + 1
            link_chars[up] += link_chars[i]
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    share = link_chars[0] / max(1, chars[0])
    out = [0.0] * n
    for i in range(n):
        c, t = chars[i], max(1, tags[i])
        if c and not cut[i]:
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e)
            ratio = c / max(1, link_chars[i]) * t / max(1, link_tags[i])
            # base is e or more before the logarithm, so 1 or more; at 1 its logarithm would be 0
            out[i] = c / t * math.log(max(ratio, 1.0)) / max(math.log(base), 1e-2)
    return out


def main_nodes(page: Page, cut: list[bool]) -> list[int]:
    """Nodes of the main text in page order; none lies inside another."""
    density = densities(page, cut)
    sums = [0.0] * len(page.tag)
    for i in range(1, len(page.tag)):
        sums[page.parent[i]] += density[i]
    best = max(range(len(sums)), key=lambda i: (sums[i], -i))
    if sums[best] <= 0:
        return [0]
    path = [best]
    while path[-1]:
        path.append(page.parent[path[-1]])
    threshold = min(density[i] for i in path)
    below = [False] * len(page.tag)
    below[best] = True
    for i in range(best + 1, len(below)):
        below[i] = below[page.parent[i]]
    for wanted in ("article", "main"):
        for node in path:
            if page.tag[node] == wanted:
                return [node]
        inner = [i for i in range(best, len(below)) if below[i] and page.tag[i] == wanted and not cut[i]]
        if len(inner) == 1 and 2 * density[inner[0]] >= threshold:
            return inner
    if best == 0:
        return [0]
    prose, linked = page.sizes(cut)
    beside = [i for i in page.contents[page.parent[best]] if not isinstance(i, str) and not cut[i]]
    return [i for i in beside if i == best or density[i] >= threshold or linked[i] <= prose[i]]


def main_text(source: str) -> str:
    """Blocks of the main text, joined by empty lines."""
    page = Page(source)
    cut = page.cut_off()
    blocks, held = [], []

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append(text)

    for node in main_nodes(page, cut):
        flush()
        stack = [(node, iter(page.contents[node]))]
        while stack:
            number, rest = stack[-1]
            item = next(rest, None)
            if item is None:
                stack.pop()
                if page.tag[number] in BLOCK:
                    flush()
                elif page.tag[number] in CELLS:
                    held.append(" ")
            elif isinstance(item, str):
                held.append(item)
            elif page.tag[item] in ("br", "wbr"):
                held.append(" " if page.tag[item] == "br" else "")
            elif cut[item]:
                if page.tag[item] in BLOCK:
                    flush()
            else:
                if page.tag[item] in BLOCK:
                    flush()
                stack.append((item, iter(page.contents[item])))
        flush()
    return "\n\n".join(blocks)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    pages: page_id, url, html; other columns are not read. A null html is empty, and a page
    without main text has an empty text. Of nodes with equal sums the first one counts.
    Repeated rows give repeated rows, no rows none.
    """

    def extract(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )
    return small_batches(rows).mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
