"""HTML extraction by tree scoring.

A page is read into a tree of elements whose text lies in blocks (paragraphs, headings, list items, cells). Each block
passes points to the elements around it: more for its length and its commas, in full to the nearest element, less
with each step up. An element's points are discounted by its link density, the share of its text inside links.
Elements that never hold the article (navigation, footers, asides, forms, scripts, and what class, id or role name as
an advert, a notice, comments and so on) take no part and are left out of the text. Words that may as well say how an
article is built or what it is about ("widget", "social", "search") decide only where they are the whole name, or stand beside
words of mere position ("site-search"); in any other name they halve the element's points, and it goes only if a third of its text
is links or it holds neither a heading nor a block of 40 characters. A form, a page header or an element
left out for its name alone takes part all the same if it holds most of the points of the page's blocks (nine tenths if
named as replies) and no ``article`` or ``main`` outside it holds any: it then wraps the page. The element with the most points
is the container; it grows to an ``article`` or ``main`` around it, and siblings join it if they have enough points
of their own or are text with few links.

A ``main`` ends the navigation, footer or aside it stands in, and an ``article`` in one of them counts if the rest of the page
has no block of 25 characters but headings: such an element was not closed.

Defined results: a null or empty page, or one without text outside what is left out, gives the empty text. Blocks are
trimmed, white space inside is one space, and they are joined by one space. Unclosed and misnested tags are closed
where a browser would do so for paragraphs, list items, table cells and the head (at the body, or at the first element or
text that cannot be in a head), and at the end of the page for others. A comment or tag that the page ends in is no text.
Repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "head form script style noscript template iframe object embed svg math canvas audio video button select option textarea input".split()
)
#: Left out as well, unless they were not closed before the article.
BESIDE = frozenset("nav footer aside dialog menu".split())
#: What may stand in a head; anything else closes it.
IN_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
WHOLE = frozenset("html body article main".split())
#: Names in class, id and role that mark what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners sponsor sponsored sponsors promo promoted promotion "
    "sidebar sidebars aside complementary nav navbar navigation menu menus breadcrumb breadcrumbs masthead toolbar topbar footer foot contentinfo "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup signin login "
    "social share sharing shares related recommended recommendations outbrain taboola comment comments commentlist disqus respond reply replies "
    "widget widgets pager pagination search form skip hidden".split()
)
#: Of these, words that decide only as whole names: articles are built of widgets and may be about notices.
VAGUE = frozenset(
    "widget widgets social share sharing shares search form foot alert notice notices hidden skip banner banners overlay modal popup promotion "
    "related recommended respond reply replies aside complementary login navigation menu".split()
)
#: Words of mere position or form, which leave the meaning of a name as it is.
PLACES = frozenset(
    "area bar bars block bottom box boxes button buttons container floating global group icon icons inner item items left links list main outer page "
    "panel posts primary right row secondary section site slot sticky title toggle top unit wrap wrapper wrappers".split()
)
#: Of the names, those of what may well be longer than the article.
REPLIES = frozenset("comment comments commentlist disqus respond reply replies related recommended recommendations".split())
#: A "header" outside an article is the page's, unless its name says that it is an article's.
OF_ARTICLES = frozenset("article blog content entry post story".split())
PART = re.compile(r"[^a-z0-9]+")
#: Points that an element starts with.
START = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 2.0, "td": 1.0, "blockquote": 1.0}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
STEPS = (1.0, 0.5, 0.25, 0.125)
SIBLING = 0.2
TEXTLIKE = 80
SENTENCE = 40
HEADING = re.compile("h[1-6]")


class _Tree(HTMLParser):
    """Elements as parallel lists, in page order (a parent comes before its children)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.left_out, self.beside, self.vague = ["#"], [-1], [False], [False], [False]
        self.doubtful = [0.0]  # left out unless it holds more than this share of the page's points
        self.open = [0]
        self.blocks: list[tuple[int, str, int]] = []  # owner, text, characters inside links
        self.text: list[str] = []
        self.linked = 0
        self.links = 0
        self.owner = 0

    def _end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.owner, text, min(self.linked, len(text))))
        self.text, self.linked = [], 0
        self.owner = self.open[-1]

    def _close_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.links -= self.tag[node] == "a"
        del self.open[depth:]

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in tags:
                self._end_block()
                self._close_to(depth)
                return
            if tag in scope:
                return

    def _close_head(self, whatever_is_open: bool) -> None:
        for depth in [len(self.open) - 1] if not whatever_is_open else range(1, len(self.open)):
            if self.tag[self.open[depth]] == "head":
                self._end_block()
                self._close_to(depth)
                self.owner = self.open[-1]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD:
            self._close_head(tag == "body")
        if tag == "br":
            self.text.append(" ")
            return
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in BLOCKS:
            self._close({"p"}, {"td", "th", "table", "button"})
            self._end_block()
        if tag == "main":
            self._close(BESIDE, {"article", "main"})
        if tag in VOID:
            return
        around = self.open[-1]
        self.tag.append(tag)
        self.parent.append(around)
        self.left_out.append(self.left_out[around] or (tag in NEVER and tag != "form"))
        self.beside.append(self.beside[around] or tag in BESIDE)
        self.vague.append(tag not in WHOLE and _vaguely_named(attrs))
        doubtful = tag == "form" or (tag not in WHOLE and (_named(attrs) or self._is_page_header(tag, attrs)))
        self.doubtful.append((0.9 if _named(attrs, REPLIES) else 0.5) if doubtful else 0.0)
        self.open.append(len(self.tag) - 1)
        self.links += tag == "a"
        if tag in BLOCKS:
            self.owner = self.open[-1]

    def _inside_article(self) -> bool:
        return any(self.tag[n] in ("article", "main") for n in self.open)

    def _is_page_header(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        names = {x for name, value in attrs if name in ("class", "id") and value for x in PART.split(value.lower())}
        return (tag == "header" or "header" in names) and names.isdisjoint(OF_ARTICLES) and not self._inside_article()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no self-closing elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[depth]] == tag:
                if tag in BLOCKS or any(self.tag[n] in BLOCKS for n in self.open[depth:]):
                    self._end_block()
                self._close_to(depth)
                if tag in BLOCKS:
                    self.owner = self.open[-1]
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._close_head(False)
        if self.left_out[self.open[-1]]:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def close(self) -> None:
        if re.match("<[a-zA-Z!?/]", self.rawdata):
            self.rawdata = ""  # the page ends inside a comment or a tag
        super().close()
        self._end_block()


def _words(attrs: list[tuple[str, str | None]]) -> Iterator[frozenset[str]]:
    """The words of each single name in class, id and role."""
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for token in value.lower().split():
                yield frozenset(PART.split(token)) - {""}


def _named(attrs: list[tuple[str, str | None]], names: frozenset[str] = NAMES) -> bool:
    """Whether a name says clearly what is not the article."""
    if any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs):
        return True
    return any((words & names) - VAGUE or (words & names and words <= NAMES | PLACES) for words in _words(attrs))


def _vaguely_named(attrs: list[tuple[str, str | None]]) -> bool:
    return any(words & NAMES for words in _words(attrs))


def points(text: str) -> float:
    """Of one block: a little for being there, one for each comma and for each hundred characters up to three."""
    return 0.1 + text.count(",") + min(len(text) / 100, 3.0) + (1.0 if len(text) >= 25 else 0.0)


def _leave_out(tree: _Tree) -> None:
    """Blocks of doubtful elements go, unless the element wraps the page; so do vaguely named ones of links or scraps."""
    if not any(tree.doubtful) and not any(tree.vague):
        return
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    inside, in_article = [0.0] * n, [False] * n  # points of the blocks inside; whether it lies in an article
    clean, articles = [True] * n, [0.0] * n  # whether nothing around it is doubtful; points in such articles inside
    size, linked, prose = [0] * n, [0] * n, [False] * n
    for node in range(1, n):
        in_article[node] = in_article[parent[node]] or tag[node] in ("article", "main")
        clean[node] = clean[parent[node]] and not tree.doubtful[node]
    for owner, text, links in tree.blocks:
        given = points(text) * (1.0 - links / len(text))
        inside[owner] += given
        articles[owner] += given * (in_article[owner] and clean[owner])
        size[owner] += len(text)
        linked[owner] += links
        prose[owner] |= len(text) >= SENTENCE or HEADING.fullmatch(tag[owner]) is not None
    for node in range(n - 1, 0, -1):
        inside[parent[node]] += inside[node]
        size[parent[node]] += size[node]
        linked[parent[node]] += linked[node]
        prose[parent[node]] |= prose[node]
        articles[parent[node]] += articles[node]
    for node in range(1, n):
        wraps = inside[node] > tree.doubtful[node] * inside[0] and not articles[0]
        scraps = tree.vague[node] and not tree.doubtful[node] and (3 * linked[node] >= size[node] or not prose[node])
        tree.left_out[node] = tree.left_out[node] or tree.left_out[parent[node]] or scraps or (tree.doubtful[node] and not wraps)
    tree.blocks = [x for x in tree.blocks if not tree.left_out[x[0]]]


def _choose_blocks(tree: _Tree) -> None:
    """Blocks beside the article go; an article that lies there counts if there is no prose elsewhere."""
    given, left_out = tree.blocks, list(tree.left_out)
    tree.blocks = [x for x in given if not tree.beside[x[0]]]
    _leave_out(tree)
    if any(len(text) >= 25 and not HEADING.fullmatch(tree.tag[owner]) for owner, text, _ in tree.blocks):
        return
    back = [False] * len(tree.tag)
    for node in range(1, len(back)):
        back[node] = tree.tag[node] not in BESIDE and (back[tree.parent[node]] or (tree.beside[node] and tree.tag[node] == "article"))
    if any(back[owner] for owner, _, _ in given):
        tree.left_out = left_out
        tree.blocks = [x for x in given if back[x[0]] or not tree.beside[x[0]]]
        _leave_out(tree)


def article_text(page: str) -> str:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    _choose_blocks(tree)
    tag, parent, blocks = tree.tag, tree.parent, tree.blocks
    if not blocks:
        return ""
    n = len(tag)
    score, size, linked = [0.0] * n, [0] * n, [0] * n
    for owner, text, links in blocks:
        size[owner] += len(text)
        linked[owner] += links
        given = points(text)
        node = owner if tag[owner] not in ("p", "pre") and not re.fullmatch("h[1-6]|li|dt|dd", tag[owner]) else parent[owner]
        for share in STEPS:
            if node < 0:
                break
            score[node] += share * given
            node = parent[node]
    for node in range(n - 1, 0, -1):
        size[parent[node]] += size[node]
        linked[parent[node]] += linked[node]
    total = [
        (s + START.get(t, 0.0)) * (1.0 - k / c) * (0.5 if v else 1.0) if s and c else 0.0
        for s, t, k, c, v in zip(score, tag, linked, size, tree.vague, strict=True)
    ]
    best = max(range(n), key=lambda i: (total[i], -i))
    node = parent[best]
    while node > 0:  # the whole of an article around the container
        if tag[node] in ("article", "main"):
            best = node
        node = parent[node]
    kept = [False] * n
    kept[best] = True
    if best and tag[best] not in WHOLE:
        for node in range(1, n):
            if parent[node] == parent[best] and node != best and size[node]:
                few_links = 4 * linked[node] < size[node]
                kept[node] = total[node] >= SIBLING * total[best] or (few_links and (size[node] >= TEXTLIKE or re.fullmatch("p|h[1-6]|blockquote|pre", tag[node]) is not None))
        kept[parent[best]] = False
    for node in range(1, n):
        kept[node] = kept[node] or kept[parent[node]]
    text = " ".join(text for owner, text, _ in blocks if kept[owner])
    return text or " ".join(text for _, text, _ in blocks)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [article_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
