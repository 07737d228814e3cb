"""Main text of web pages: flat text blocks, judged by a decision tree.

A page becomes a flat list of blocks. Each has its number of words and its link density,
those of the block before and after, the part of the page it stands in, and whether it
is a heading. A decision tree, trained on a small labelled table, says which blocks are
the article; their texts are joined by line feeds.
"""

from __future__ import annotations

import re
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import map_batches, texts_of

# Parts of a page, from what is never shown to what is the article. Headers and forms end
# where an article begins inside them, and whole pages stand in forms.
SKIP, BAD, HEADER, FORM, NEUTRAL, GOOD = -4, -3, -2, -1, 0, 1
HINTED = 2  # inside an article, in an element whose name may mean something else

# Elements and words of HTML and of common page templates.
NESTED_TAGS = set("svg object template canvas audio video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template svg iframe object select button textarea head title canvas audio video datalist".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
SPACED = set("br td th img wbr option label input".split()) - {"wbr"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BAD_TAGS = set("nav aside footer menu dialog".split())
BAD_WORDS = set(
    "nav navbar navigation menu sidebar footer ad ads advert adverts advertisement advertising adsense sponsor sponsored promo "
    "promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist "
    "respond reply replies disqus discussion share sharing social related recommended breadcrumb breadcrumbs pagination "
    "pager subscribe newsletter signup login widget toolbar search hidden".split()
)
# Inside an article these name the element's use for sure, the other words may name its subject.
SURE_WORDS = BAD_WORDS - set(
    "navigation menu header footer notice notices alert comment respond reply replies discussion share sharing social related recommended "
    "login signup search toolbar widget hidden promotion sponsor banner overlay".split()
)
STRUCTURE_WORDS = set(
    "box container wrapper wrap inner outer area section list item items block blocks slot unit bar row col column left right top bottom "
    "main link links icon icons button buttons btn form group panel content post posts article entry page site body".split()
)
# Elements that begin no new content: what else comes ends an open head.
HEAD_TAGS = set("base link meta title script style noscript template".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
GOOD_WORDS = set("article content post entry story articlebody main maincontent".split())
WHOLE_PAGE = {"html", "body", "main"}

WORDS = re.compile(r"[^\W_]+", re.UNICODE)
HINTS = re.compile(r"[a-z0-9]+")
CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


class Blocks(HTMLParser):
    """Collects ``(text, words, linked words, part, heading)`` of every block with a word or sign."""

    def __init__(self, page: str = "") -> None:
        super().__init__(convert_charrefs=True)
        self.page, self.lines = page, None
        self.loose: list[int] = []  # depths of skipped elements that nothing closes
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.stack: list[tuple[str, int, int, bool]] = []
        self.open: dict[str, int] = {}
        self.part, self.links, self.heading = NEUTRAL, 0, False
        self.text: list[str] = []
        self.linked: list[str] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                linked = len(WORDS.findall("".join(self.linked))) if self.linked else 0
                self.blocks.append((text, len(WORDS.findall(text)), linked, self.part, self.heading))
            self.text, self.linked = [], []

    def closes(self, tag: str) -> bool:
        """Whether the element that begins here has an end tag before another of its name begins."""
        if self.lines is None:
            self.lines = [0, *(m.end() for m in re.finditer("\n", self.page))]
        line, column = self.getpos()
        found = re.compile(rf"<(/?){tag}\b", re.IGNORECASE).search(self.page, self.lines[line - 1] + column + 1)
        return bool(found and (found[1] or tag in NESTED_TAGS))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack and self.stack[-1][0] == "head" and tag not in HEAD_TAGS:
            self._pop()
        if tag in BLOCKS:
            while self.loose:  # a block ends what was skipped and never closed
                depth = self.loose[-1]
                while len(self.stack) > depth:
                    self._pop()
            self.flush()
            if self.links and tag != "a":
                self.links = 0  # a link that was never closed ends with its block
            if tag == "p" and self.open.get("p") and self.stack[-1][0] == "p":
                self._pop()
        elif tag in SPACED and self.part != SKIP:
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in SKIPPED and tag != "head" and self.part != SKIP and not self.closes(tag):
            self.loose.append(len(self.stack))
        self.stack.append((tag, self.part, self.links, self.heading))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.part = part_of(tag, attrs, self.part)
        if tag == "a":
            self.links = 1
        elif tag in HEADINGS:
            self.heading = True

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.open.get(tag):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, self.part, self.links, self.heading = self.stack.pop()
        self.open[tag] -= 1
        if self.loose and len(self.stack) <= self.loose[-1]:
            self.loose.pop()
        return tag

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._pop()  # text has no place in a head
        if self.part != SKIP:
            self.text.append(data)
            if self.links:
                self.linked.append(data + " ")


def part_of(tag: str, attrs: list[tuple[str, str | None]], outer: int) -> int:
    if outer == SKIP or tag in SKIPPED:
        return SKIP
    if outer == BAD or tag in BAD_TAGS:
        return BAD
    hints: set[str] = set()
    doubted = False
    for name, value in attrs:
        if name in ("class", "id", "itemprop") and value and tag not in WHOLE_PAGE:
            if outer >= GOOD:
                judged = [_judge_name(x) for x in value.lower().split()]
                if BAD in judged:
                    return BAD
                doubted = doubted or HINTED in judged
            else:
                hints.update(HINTS.findall(value.lower()))
        elif name == "role" and value:
            if value.lower() in BAD_ROLES:
                return BAD
            if value.lower() in ("main", "article"):
                return GOOD
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return BAD
        elif name == "style" and value and re.search(r"display\s*:\s*none", value):
            return BAD
    if outer >= GOOD:
        return BAD if tag == "form" else HINTED if doubted else outer
    if hints & BAD_WORDS:
        return BAD
    if tag in ("article", "main"):
        return GOOD
    if tag == "form":
        return FORM
    if tag == "header" or "header" in hints or "masthead" in hints:
        return HEADER
    if outer in (NEUTRAL, FORM) and hints & GOOD_WORDS:
        return GOOD
    return outer


def _judge_name(name: str) -> int:
    """What one class or id says inside an article: a name with other words in it says nothing."""
    words = {w for w in HINTS.findall(name) if not w.isdigit()}
    if not words & BAD_WORDS or not words <= BAD_WORDS | STRUCTURE_WORDS:
        return GOOD
    return BAD if words & SURE_WORDS else HINTED


def blocks_of(page: str | None) -> list[tuple[str, int, int, int, bool]]:
    if not page:
        return []
    cut = CUT_TAG.search(page)  # a page can end inside a tag
    page = page[: cut.start()] if cut else page
    parser = Blocks(page)
    parser.feed(page)
    parser.close()
    parser.flush()
    return parser.blocks


FEATURES = "words link words_before link_before words_after link_after part page_has_article heading".split()

# The labelled table. A row is a block of some typical page: the features in
# the order above, then whether the block belongs to the article.
LABELLED = [
    # articles that the page marks: title, long and short paragraphs, captions, lists
    (9, 0.0, 0, 0.0, 60, 0.0, 1, 1, 1, 1), (6, 0.0, 8, 0.2, 45, 0.0, 1, 1, 1, 1), (2, 0.0, 5, 1.0, 90, 0.0, 1, 1, 1, 1),
    (60, 0.0, 9, 0.0, 40, 0.0, 1, 1, 0, 1), (120, 0.05, 40, 0.0, 3, 0.0, 1, 1, 0, 1), (3, 0.0, 120, 0.05, 80, 0.1, 1, 1, 0, 1),
    (5, 0.0, 60, 0.0, 12, 0.3, 1, 1, 0, 1), (1, 0.0, 33, 0.0, 7, 0.0, 1, 1, 0, 1), (8, 0.0, 2, 0.0, 4, 0.0, 1, 1, 0, 1),
    (14, 0.4, 80, 0.0, 70, 0.0, 1, 1, 0, 1), (6, 1.0, 70, 0.0, 50, 0.0, 1, 1, 0, 1), (4, 0.5, 30, 0.0, 9, 0.1, 1, 1, 0, 1),
    (200, 0.2, 3, 0.0, 150, 0.1, 1, 1, 0, 1), (25, 0.9, 60, 0.0, 20, 0.0, 1, 1, 0, 1), (7, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0, 1),
    (0, 0.0, 40, 0.0, 40, 0.0, 1, 1, 0, 1), (10, 0.0, 1, 1.0, 12, 0.0, 1, 1, 0, 1), (11, 0.0, 9, 0.0, 11, 0.0, 1, 1, 1, 1),
    (5, 1.0, 5, 1.0, 60, 0.0, 1, 1, 0, 1), (6, 1.0, 60, 0.0, 6, 1.0, 1, 1, 0, 1), (3, 1.0, 4, 1.0, 5, 1.0, 1, 1, 0, 1),
    # the same pages outside of the article: text of any length
    (9, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0), (40, 0.0, 3, 1.0, 12, 0.0, 0, 1, 0, 0), (90, 0.0, 60, 0.0, 30, 0.0, 0, 1, 0, 0),
    (4, 0.0, 50, 0.0, 4, 1.0, 0, 1, 1, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 1, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0),
    (7, 0.0, 100, 0.0, 0, 0.0, 0, 1, 0, 0), (15, 0.3, 60, 0.0, 10, 0.5, 0, 1, 0, 0), (6, 0.0, 4, 0.0, 80, 0.0, 0, 1, 0, 0),
    (30, 0.0, 45, 0.0, 60, 0.0, 0, 1, 0, 0), (60, 0.0, 0, 0.0, 120, 0.0, 0, 1, 0, 0), (5, 0.0, 2, 1.0, 50, 0.0, 0, 1, 1, 0),
    (3, 1.0, 12, 0.0, 70, 0.0, 0, 1, 0, 0), (110, 0.1, 90, 0.0, 80, 0.0, 0, 1, 0, 0), (22, 0.0, 20, 0.0, 40, 0.1, 0, 1, 0, 0),
    # menus, headers, footers, sidebars, notices, adverts, forms and comments, marked as such
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 1, 0, 0), (2, 1.0, 2, 1.0, 1, 1.0, -1, 0, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, -1, 1, 0, 0),
    (12, 0.0, 90, 0.0, 0, 0.0, -1, 1, 0, 0), (30, 0.1, 12, 0.0, 45, 0.0, -1, 1, 0, 0), (70, 0.0, 5, 0.0, 60, 0.0, -1, 1, 0, 0),
    (150, 0.0, 90, 0.0, 80, 0.0, -1, 1, 0, 0), (4, 0.0, 70, 0.0, 30, 0.0, -1, 1, 1, 0), (5, 0.0, 1, 1.0, 60, 0.0, -1, 0, 1, 0),
    (25, 0.0, 70, 0.0, 60, 0.0, -1, 0, 0, 0), (90, 0.0, 80, 0.0, 70, 0.0, -1, 0, 0, 0), (11, 0.6, 40, 0.0, 0, 0.0, -1, 0, 0, 0),
    (4, 0.0, 20, 0.0, 60, 0.0, -1, 0, 0, 0), (6, 0.0, 7, 0.0, 40, 0.0, -1, 0, 0, 0), (3, 0.0, 70, 0.0, 50, 0.0, -1, 0, 0, 0),
    (8, 0.0, 2, 0.0, 90, 0.0, -1, 0, 0, 0), (5, 0.0, 12, 0.0, 25, 0.0, -1, 0, 1, 0), (7, 0.0, 40, 0.0, 33, 0.0, -1, 0, 0, 0),
    (0, 0.0, 3, 0.0, 2, 0.0, -1, 0, 0, 0), (18, 0.0, 3, 0.3, 2, 1.0, -1, 0, 0, 0),
    # pages that mark no article: length, links and neighbours decide
    (80, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0, 1), (45, 0.1, 80, 0.0, 50, 0.0, 0, 0, 0, 1), (24, 0.0, 45, 0.1, 3, 1.0, 0, 0, 0, 1),
    (18, 0.0, 50, 0.0, 40, 0.0, 0, 0, 0, 1), (5, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1), (3, 0.0, 35, 0.0, 28, 0.0, 0, 0, 0, 1),
    (150, 0.25, 2, 1.0, 4, 0.5, 0, 0, 0, 1), (30, 0.3, 40, 0.0, 0, 0.0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 70, 0.0, 0, 0, 1, 1),
    (5, 0.0, 60, 0.0, 45, 0.0, 0, 0, 1, 1), (10, 0.0, 0, 0.0, 55, 0.0, 0, 0, 1, 1), (22, 0.0, 3, 0.0, 35, 0.0, 0, 0, 0, 1),
    (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), (6, 1.0, 60, 0.0, 5, 1.0, 0, 0, 0, 0),
    (9, 0.7, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (7, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (4, 0.0, 3, 1.0, 6, 0.0, 0, 0, 0, 0),
    (8, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (5, 0.0, 6, 0.2, 4, 1.0, 0, 0, 0, 0), (40, 0.8, 3, 1.0, 30, 0.9, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 60, 0.0, 0, 0, 0, 0), (4, 1.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0), (12, 0.9, 3, 1.0, 80, 0.0, 0, 0, 0, 0),
    (30, 0.7, 8, 1.0, 45, 0.0, 0, 0, 0, 0), (55, 0.6, 60, 0.0, 40, 0.9, 0, 0, 0, 0), (20, 0.5, 9, 0.6, 70, 0.0, 0, 0, 0, 0),
    (3, 1.0, 1, 1.0, 90, 0.1, 0, 0, 0, 0), (16, 0.0, 7, 0.0, 4, 0.0, 0, 0, 0, 1), (40, 0.0, 4, 0.0, 6, 0.0, 0, 0, 0, 1),
    (26, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 1), (70, 0.1, 3, 1.0, 2, 1.0, 0, 0, 0, 1), (20, 0.1, 60, 0.0, 2, 1.0, 0, 0, 0, 1),
    (4, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0, 0), (6, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 8, 0.1, 1, 0.0, 0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 5, 1.0, 0, 0, 1, 0), (2, 0.0, 60, 0.0, 2, 1.0, 0, 0, 1, 0), (90, 0.7, 20, 0.9, 5, 1.0, 0, 0, 0, 0),
]
MAX_DEPTH = 8
LINKED_TEXT = 0.34


@cache
def tree() -> tuple:
    """A decision tree by Gini impurity: ``(feature, limit, below, above)`` or the answer."""
    table = np.array(LABELLED, float)
    return _grow(table[:, :-1], table[:, -1].astype(bool), MAX_DEPTH)


def _grow(x: np.ndarray, y: np.ndarray, depth: int) -> tuple | bool:
    if not depth or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < limit
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            best = min(best, (impurity, f, limit))
    _, f, limit = best
    low = x[:, f] < limit
    if low.all() or not low.any():
        return bool(y.mean() >= 0.5)
    return f, float(limit), _grow(x[low], y[low], depth - 1), _grow(x[~low], y[~low], depth - 1)


def judge(node: tuple | bool, row: tuple) -> bool:
    while not isinstance(node, bool):
        f, limit, below, above = node
        node = below if row[f] < limit else above
    return node


def features(blocks: list[tuple[str, int, int, int, bool]]) -> list[tuple]:
    edge = (0, 0.0)
    size = [edge, *((b[1], min(1.0, b[2] / b[1]) if b[1] else 0.0) for b in blocks), edge]
    marked = int(any(b[3] >= GOOD for b in blocks))
    parts = [_place(b[3], size[i + 1][1]) for i, b in enumerate(blocks)]
    return [(*size[i + 1], *size[i], *size[i + 2], parts[i], marked, int(b[4])) for i, b in enumerate(blocks)]


def _place(part: int, link: float) -> int:
    """A doubtful name inside an article lowers a block only if its links speak against it too."""
    if part == HINTED:
        return GOOD if link < LINKED_TEXT else -1
    return max(-1, part)


def main_text(page: str | None) -> str:
    blocks = blocks_of(page)
    return "\n".join(b[0] for b, row in zip(blocks, features(blocks)) if judge(tree(), row))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars``: a row per page, ``n_chars`` in code points.

    Null, empty and wordless pages have an empty text. Broken markup is read as far as it
    goes. Repeated rows give repeated rows; other columns are not looked at.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(t) for t in texts_of(batch, "t")]
        return {"key": batch.column("k"), "url": batch.column("u"), "text": texts, "n_chars": list(map(len, texts))}

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("t"))
    out = map_batches(rows, run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.withColumnsRenamed({"key": key, "url": url})
