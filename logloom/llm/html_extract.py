"""HTML extraction: the main text of a page.

Parser events of the standard library's HTMLParser are taken as they come: one "line" for each block
of text, with the tags seen since the last one and the block element it stands in. The text-to-tag ratio
of the lines is smoothed with a Gaussian; lines above a threshold (the smoothed ratios' mean less half
of their deviation, or half of the mean if that is lower) form clusters. The clusters decide:

- Their text votes for the elements around it. An article or main around the innermost element with
  nearly all of the vote is the content region; without one, the page is.
- In it the lines of the clusters are article text. So are lines that are attached to one: in the element of a strong line, between two lines of clusters, or a paragraph, heading or item
  next to a cluster with nothing doubtful between, or in the element (not body) around a strong line's. Lines that are mostly links aren't attached, so unmarked
  menus, lists of links and footers go.
- Text whose class or id only hints at something else (WEAK) is article text if it lies in a cluster and isn't mostly links.

Never article text, and of ratio 0: text in navigation, footers, asides, forms, scripts and the like, or
in an element whose class or id says advert, comment, cookie notice, ... Such an inline element is left
out of its line. A block named so is passed over unless it proves to be a wrapper of the article: all articles and mains
of the page are in it, or, where there are none and the name only tells of the page's layout (LAYOUT, more than one word), most of the text.
Names that tell what a block has or lacks (has-sidebar, no-nav) mark nothing; share, social, related and their like only
do so alone or with words for furniture (share-buttons, not share-price).

Defined results: null or empty html, or no text, gives an empty string. One row per input row; other
columns are ignored. Documents without closing tags, or cut short, are read as far as they go; a tag
that the end of the page cuts off is dropped. Text in a button counts as the button's up to its end tag;
where that is missing, up to the next block. White space is what str.split() takes for it, so no-break
spaces count; <br> is white space. Time is linear in the length of the page.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, values

#: Element names.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template textarea select option svg math iframe object canvas audio video map datalist".split())
#: What may stand in a head; anything else ends it, as in browsers.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
ASIDE = frozenset("nav footer aside form header menu dialog".split())
#: Blocks that hold text rather than other blocks.
LEAF = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 pre blockquote caption figcaption summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of a class or id that mark what isn't the article's text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adsbygoogle banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar sidebar "
    "aside widget comment comments commentlist respond reply replies disqus cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations pagination pager toolbar skip hidden paywall".split()
)
#: Words that mark it as the whole or the last word of a name, and only hint at it elsewhere; and words that only hint.
LAST_MARKS, WEAK = frozenset("notice notices alert".split()), frozenset("legal disclaimer copyright".split())
ARTICLE_MARKS = frozenset("comment comments reply ad related promo".split())
#: Marks, but not as a section's id, as papers have sections of that name; marks that often are adjectives; words that go with these.
THREADS, ADJECTIVES = frozenset("discussion discussions".split()), frozenset("share sharing social related recommended recommendations skip hidden overlay".split())
FURNITURE = frozenset("links link buttons button icons icon bar box list lists posts post articles article stories story media items item block container wrapper wrap area section content tools this inner module top bottom left right header title feed follow us count to text".split())
#: First words of names that tell what an element has or lacks; marks that tell of a page's layout.
HAVING = frozenset("no has with without hide show".split())
LAYOUT = frozenset("nav navbar navigation menu footer foot header masthead topbar sidebar aside widget banner toolbar overlay modal hidden skip paywall pagination social related share sharing hero".split())
#: Share of a page's text that makes a block its wrapper, where it has neither article nor main.
WRAPPER = 0.6
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SIGMA, LOWER = 1.0, 0.5


def marks_of(tag: str, name: str, is_id: bool) -> set[str]:
    """The words of one class or id that mark an element."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    if not words or words[0] in HAVING or "hero" in words:
        return set()
    if tag == "article":
        return ARTICLE_MARKS.intersection(words)
    found = MARKS.intersection(words) | ({words[-1]} & LAST_MARKS) | (set() if tag == "section" and is_id else THREADS.intersection(words))
    if found & ADJECTIVES and not all(w in MARKS or w in FURNITURE or w.isdigit() for w in words):
        found -= ADJECTIVES
    return found


def doubt_of(tag: str, attrs: list) -> tuple[int, bool]:
    """(2: never article text; 1: a hint; 0), and whether that is for its names alone, all of which tell of layout by more than one word."""
    if tag in ASIDE:
        return 2, False
    marks, hint, told = set(), 0, True
    for name, value in attrs:
        value = (value or "").lower()
        if name in ("class", "id") and tag not in ("html", "body", "main"):
            for one in value.split():
                found = marks_of(tag, one, name == "id")
                marks |= found
                told &= not found or found <= LAYOUT and not one.isalnum()
                hint |= any(w in LAST_MARKS or w in WEAK for w in re.split(r"[^a-z0-9]+", one))
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return 2, False
    return (2, told) if marks else (int(hint), False)


def is_named(tag: str, attrs: list, doubt: int) -> bool:
    """Whether a block is in doubt for its class or id, so that it may prove a wrapper."""
    return doubt == 2 and tag in BLOCK and tag not in ASIDE and not any(n == "role" and (v or "").lower() in ROLES or n == "hidden" or n == "aria-hidden" and v == "true" for n, v in attrs)


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    block: int  # number of the innermost block element; 0: none
    doubt: int
    button: int  # number of the button around the block; 0: none
    mark: int = 0  # number of the innermost block around it whose name is in doubt; 0: none


class Lines(HTMLParser):
    """Collects lines, and the tree of block elements: parent and kind by number, parents first.

    The stack of open elements is searched by name and by block in constant time.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int]] = []  # name, number (blocks and buttons), doubt
        self.at: dict[str, list[int]] = defaultdict(list)  # positions in open, by name
        self.blocks: list[int] = []  # positions of blocks in open
        self.parent, self.kind = [0], [""]
        self.marked = [0]  # of the page and the open elements: the innermost block in doubt for its name
        self.above, self.layout, self.articles = [0], [False], [0]  # by number of such blocks, 0 the page: the one around it, whether it tells of layout, articles and mains directly in it
        self.silent, self.doubts, self.ended = 0, [0, 0, 0], set()
        self.parts: list[str] = []
        self.tags, self.linked, self.hid, self.weak = 0, 0, False, False

    def parse_html_declaration(self, i):
        """What isn't a comment or doctype is passed over up to its end, as browsers do; the standard parser gives up at some of it."""
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text or self.hid:
            block = self.open[self.blocks[-1]][1] if self.blocks else 0
            button = self.open[self.at["button"][-1]][1] if self.at["button"] else 0
            self.lines.append(Line(text, self.tags, self.linked, block, int(self.weak) if text else 2, button, self.marked[-1]))
            self.tags = 0
        self.parts, self.linked, self.hid, self.weak = [], 0, False, False

    def push(self, tag, attrs):
        number = 0
        if tag in BLOCK or tag == "button":
            number = len(self.kind)
            self.parent.append(self.open[self.blocks[-1]][1] if self.blocks else 0)
            self.kind.append(tag)
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.at[tag].append(len(self.open))
        doubt, layout = doubt_of(tag, attrs)
        mark = self.marked[-1]
        if is_named(tag, attrs, doubt):
            self.above.append(mark)
            self.layout.append(layout)
            self.articles.append(0)
            mark, doubt = len(self.above) - 1, 0
        elif tag in ("article", "main") and doubt < 2 and not self.doubts[2]:
            self.articles[mark] += 1
        self.marked.append(mark)
        self.open.append((tag, number, doubt))
        self.silent += tag in SILENT
        self.doubts[doubt] += 1

    def pop_to(self, position):
        while len(self.open) > position:
            tag, _, doubt = self.open.pop()
            self.marked.pop()
            self.at[tag].pop()
            self.silent -= tag in SILENT
            self.doubts[doubt] -= 1
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def last(self, tag) -> int:
        return self.at[tag][-1] if self.at[tag] else -1

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else -1

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCK and not self.at["select"] and not self.at["datalist"]:
            self.end_inline("option")  # where its end tag is left out
        if tag == "button":
            self.end_inline("button")
        if tag in BLOCK:
            self.cut()
            top = self.open[self.blocks[-1]][0] if self.blocks else ""
            if top == "p" or top in IMPLIED.get(tag, ()):
                self.pop_to(self.blocks[-1])  # inline elements left open outside stay open across blocks, as in browsers
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            self.push(tag, attrs)

    def end_head(self):
        """Head's end tag may be left out; what stands in its own silent elements stays there."""
        if self.open and self.open[-1][0] == "head":
            self.pop_to(len(self.open) - 1)

    def end_inline(self, tag):
        if self.last(tag) > self.last_block():
            self.pop_to(self.last(tag))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.cut()
        at = self.last(tag)
        if tag == "button" and at >= 0:
            self.cut()
            self.ended.add(self.open[at][1])
        # a stray inline end doesn't close the block it is in
        if at >= 0 and (tag in BLOCK or tag == "button" or at > self.last_block()):
            self.pop_to(at)

    def handle_data(self, data):
        blank = not data.strip()
        if not blank:
            self.end_head()
        if self.silent:
            return
        if self.doubts[2] or self.last("button") > self.last_block():
            self.hid |= not blank
            return
        self.parts.append(data)
        self.weak |= self.doubts[1] > 0 and not blank
        if self.at["a"]:
            self.linked += len(data.strip())

    def read(self, html: str) -> list[Line]:
        end = html.rfind(">") + 1
        self.feed(html[:end])
        rest = html[end:]
        cut_off = re.search(r"<[A-Za-z/!?]", rest)
        self.feed(rest[: cut_off.start()] if cut_off else rest)
        self.close()
        self.cut()
        silent = self.silenced()
        return [x._replace(text="", doubt=2) if x.button in self.ended or silent[x.mark] else x for x in self.lines]

    def silenced(self) -> list[bool]:
        """By number of the blocks in doubt for their names: whether they, or one around them, are no wrappers of the article."""
        weight, held = [0] * len(self.above), list(self.articles)
        for x in self.lines:
            weight[x.mark] += len(x.text)
        for m in range(len(self.above) - 1, 0, -1):
            weight[self.above[m]] += weight[m]
            held[self.above[m]] += held[m]
        out = [False] * len(self.above)
        for m in range(1, len(out)):
            wrapper = held[m] == held[0] if held[0] else self.layout[m] and weight[m] >= WRAPPER * weight[0]
            out[m] = out[self.above[m]] or not wrapper
        return out


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel, mode="valid")


def content_lines(lines: list[Line]) -> tuple[np.ndarray, np.ndarray]:
    """(lines of a cluster, strong lines): smoothed text-to-tag ratio, and the line's own, at the threshold."""
    ratio = np.array([0.0 if x.doubt > 1 else len(x.text) / max(x.tags, 1) for x in lines])
    if not ratio.any():
        return ratio > 0, ratio > 0
    smooth = smoothed(ratio)
    least = min(smooth.mean() - LOWER * smooth.std(), LOWER * smooth.mean())
    return (smooth >= least) & (ratio > 0), (ratio >= least) & (ratio > 0)


def article_of(lines: list[Line], chosen: np.ndarray, parent: list[int], kind: list[str], share: float = 0.9) -> int:
    """Number of the article or main around the innermost element that holds nearly all of the chosen text; 0: none."""
    weight = [0] * len(kind)
    for x, yes in zip(lines, chosen, strict=True):
        if yes:
            weight[x.block] += len(x.text)
    total = sum(weight)
    for b in range(len(kind) - 1, 0, -1):
        weight[parent[b]] += weight[b]
    at = max((b for b in range(1, len(kind)) if weight[b] >= share * total), default=0)
    while at and kind[at] not in ("article", "main"):
        at = parent[at]
    return at


def attached(lines: list[Line], chosen: np.ndarray, strong: np.ndarray, parent: list[int], kind: list[str]) -> np.ndarray:
    """Article text: the clusters, and what is attached to them."""
    owner = list(range(len(kind)))
    for b in range(1, len(kind)):
        if kind[b] in LEAF or kind[b] == "button":
            owner[b] = owner[parent[b]]
    own = np.array([owner[x.block] for x in lines])
    leaf = np.array([kind[x.block] in LEAF for x in lines])
    clean = np.array([x.doubt < 2 for x in lines])
    links = np.array([2 * x.linked > len(x.text) for x in lines])
    home = np.isin(own, own[chosen & strong])
    # at a cluster's edge, smoothing lifts its neighbours too: these must be attached in their own right
    core = chosen & (strong | home)
    at = np.nonzero(core)[0]
    if not len(at):
        return core
    place = np.arange(len(lines))
    between = (place > at[0]) & (place < at[-1])
    stretch = np.cumsum(~clean)  # stretches without anything doubtful
    near = np.isin(stretch, stretch[core])
    plain = np.array([x.doubt == 0 for x in lines])
    around = [parent[b] for b in set(own[chosen & strong].tolist()) if kind[parent[b]] not in ("", "html", "body")]
    return core | plain & ~links & (home | between | leaf & (near | np.isin(own, around)))


def main_text(html: str | None) -> str:
    parser = Lines()
    lines = parser.read(html or "")
    if not lines:
        return ""
    chosen, strong = content_lines(lines)
    kept = attached(lines, chosen, strong, parser.parent, parser.kind)
    if region := article_of(lines, chosen, parser.parent, parser.kind):
        inside = [False] * len(parser.kind)
        for b in range(1, len(inside)):
            inside[b] = b == region or inside[parser.parent[b]]
        kept = [yes and inside[x.block] for x, yes in zip(lines, kept, strict=True)]
    return "\n".join(x.text for x, yes in zip(lines, kept, strict=True) if yes)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, main text, and its length in code points. Narrow: no shuffle, one page in memory at a time."""

    def run(batch, _):
        texts = [main_text(h) for h in values(batch, "_html").to_pylist()]
        return {"page_id": values(batch, "_id"), "url": values(batch, "_url"), "text": texts, "n_chars": [len(t) for t in texts]}

    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return map_columns(rows, run, "page_id long, url string, text string, n_chars long", step=128)
