"""Main text of web pages by tag-path ratios.

A page's text falls into blocks: what stands between the tags of block elements.
A block's path is that of the block elements from the root down to it. Text
length outside links and punctuation are summed for each path; a path's ratios
are what a block of it holds on average. The ratios are smoothed along the page,
fused into one score, and the paths whose mean score passes a threshold are the
content paths. The smallest element that holds all blocks of content paths is
the article. Its other blocks, such as headings, lists and short paragraphs,
belong to it, but for what is marked as a menu, a form, an advert or the like.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from graniteq.llm.common import output, take

SMOOTHING = (0.25, 0.5, 0.25)  # the block before, the block itself, the block after
THRESHOLD = 0.5  # of the mean score of the blocks that may be content

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var img input embed wbr".split())
CODE = frozenset("code kbd samp tt var".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
NEVER = frozenset("head nav header footer aside noscript template iframe object svg canvas button select option dialog menu audio video".split())
ARTICLES = ("article", "main")
#: Elements that hold prose: only an advert's mark counts on them.
PROSE = frozenset("p pre h1 h2 h3 h4 h5 h6 blockquote figure figcaption li dt dd td th math caption summary details".split())
FLAT = frozenset(("", "html", "body"))
#: A smallest common element of these kinds is a part of the article, never the article.
PARTS = PROSE | frozenset("ul ol dl table thead tbody tfoot tr center".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title head".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body article main section div ul ol dl table td th nav aside header footer form blockquote".split())

#: Words in a class, id or role that mark an advert.
ADVERTS = frozenset(
    "ad ads adbanner adblock adbox adcontainer adsbygoogle adsense adslot adunit adwrapper advert adverts advertisement advertisements advertising advertorial outbrain promo promoted "
    "sponsor sponsored sponsors taboola".split()
)
#: Those that mark what else isn't the article.
MARKS = ADVERTS | frozenset(
    "addthis alertdialog banner breadcrumb breadcrumbs comment comments commentbox commentform commentlist commentsection complementary consent contentinfo cookie cookiebanner cookiebar cookieconsent cookies copyright disqus "
    "dropdown footer gdpr header leftbar login loginform mainmenu masthead menu menubar nav navbar navigation newsletter notice noticebar offcanvas pagefooter pageheader pager pagination popup readercomments related "
    "relatedarticles relatedposts replies respond responses rightbar search searchbox searchform share sharebar sharebuttons sharethis sharing sidebar sidecolumn sidenav signup signupform sitefooter siteheader sitenav "
    "skiplink social submenu subscribe subscribeform toolbar topbar topmenu topnav usercomments widget widgets".split()
)
#: Beside one of these, "header" and "notice" name a part of the article.
OWN = frozenset("article entry post story".split())

_ATTRIBUTES = r"""[^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/!?a-zA-Z][^>]*\Z",
    re.S,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LETTERS = re.compile(r"[A-Za-z]+")
#: A name that begins so tells of the page's layout: it stands on what surrounds the article too.
_LAYOUT = re.compile(r"(?:has|no|with|without)[-_]", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?¡¿…。，、；：！？]")

_BY_NAME, _BY_ELEMENT = 1, 2
_MUTED, _LINK, _IN_CODE = 0, 1, 2


def _marked(attributes: str, marks: frozenset[str], inside: bool) -> bool:
    """Whether a class, id or role holds one of the marks; an article's own header is none."""
    if "=" not in attributes:
        return False
    names = [n for m in _NAMED.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split() if not _LAYOUT.match(n)]
    words = {w.lower() for n in names for w in (*_PARTS_OF_NAME.findall(n), *_LETTERS.findall(n))}
    found = words & marks
    if inside:
        found = found - {"header"}
    return bool(found - {"header", "notice"} or (found and not words & OWN))


class _Open:
    """An open block element, and what is open of the inline elements in it that matter."""

    __slots__ = ("at", "code", "counts", "element", "entries", "inside", "linked", "tag")

    def __init__(self, tag: str, element: int, linked: bool, code: bool, inside: bool):
        self.tag, self.element, self.linked, self.code, self.inside = tag, element, linked, code, inside
        self.entries: list[list] | None = None  # [tag, how often it is open, kind]
        self.at: dict[str, list[int]] = {}
        self.counts = [0, 0, 0]

    def enter(self, tag: str, kind: int) -> None:
        if self.entries is None:
            self.entries = []
        self.at.setdefault(tag, []).append(len(self.entries))
        self.entries.append([tag, 1, kind])
        self.counts[kind] += 1

    def leave(self, tag: str) -> None:
        if not self.at.get(tag):
            return
        place = self.at[tag][-1]
        self.entries[place][1] -= 1
        if not self.entries[place][1]:
            while len(self.entries) > place:
                own, _, kind = self.entries.pop()
                self.at[own].pop()
                self.counts[kind] -= 1


class Page:
    """A page's block elements in order of their start tags, and its blocks of text.

    Element i has ``tags[i]``, the element ``parents[i]`` around it, the number
    ``paths[i]`` of its path, and ``marks[i]``: what marks it as no part of the
    article. Element 0 is the page. Block j is ``texts[j]``, right in the element
    ``owners[j]``, with ``linked[j]`` characters in links. All lists grow with the
    page, however deep it is nested.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.paths, self.marks = [""], [0], [0], [0]
        self.texts: list[str] = []
        self.owners: list[int] = []
        self.linked: list[int] = []
        self._read(html)

    def _read(self, html: str) -> None:
        numbers: dict[tuple[int, str], int] = {}
        stack = [_Open("", 0, False, False, False)]
        opened: Counter[str] = Counter()
        parts: list[str] = []
        in_links, pos, end = 0, 0, len(html)

        def flush() -> None:
            nonlocal in_links
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self.texts.append(text)
                    self.owners.append(stack[-1].element)
                    self.linked.append(min(in_links, len(text)))
            in_links = 0

        def pop_to(names, scopes=frozenset()) -> None:
            if not any(opened[n] for n in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    for x in stack[i:]:
                        opened[x.tag] -= 1
                    del stack[i:]
                    return
                if stack[i].tag in scopes:
                    return

        while pos < end:
            m = _TOKEN.search(html, pos)
            stop = m.start() if m else end
            if stop > pos:
                top = stack[-1]
                if not top.counts[_MUTED]:
                    piece = html[pos:stop]
                    parts.append(unescape(piece) if "&" in piece else piece)
                    if top.linked or top.counts[_LINK]:
                        in_links += len(parts[-1].strip())
            if not m:
                break
            pos = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if tag == "br":
                parts.append(" ")
                continue
            if tag in INLINE:
                top = stack[-1]
                if closing:
                    top.leave(tag)
                elif tag not in VOID and not attributes.endswith("/"):
                    if tag in CODE:
                        top.enter(tag, _IN_CODE)
                    elif not (top.code or top.counts[_IN_CODE]) and _marked(attributes, MARKS, top.inside):
                        top.enter(tag, _MUTED)
                    elif tag == "a":
                        top.leave(tag)
                        top.enter(tag, _LINK)
                    elif top.at.get(tag):
                        top.entries[top.at[tag][-1]][1] += 1
                continue
            flush()
            if closing:
                pop_to((tag,))
                continue
            if stack[-1].tag == "head" and tag not in HEAD_ONLY or tag == "body":
                pop_to(("head",))
            pop_to(("p",), SCOPES)
            if tag in CLOSES:
                pop_to(CLOSES[tag], SCOPES)
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, pos)
                pos = close.end() if close else end
                continue
            if tag in VOID or attributes.endswith("/"):
                continue
            top = stack[-1]
            inside = top.inside or tag in ARTICLES
            mark = 0
            if top.counts[_MUTED]:
                mark = _BY_NAME
            elif tag in NEVER and not (tag == "header" and top.inside):
                mark = _BY_ELEMENT
            elif tag == "form" or tag not in ("html", "body") and (tag not in ARTICLES or top.inside) and not top.code and _marked(attributes, ADVERTS if tag in PROSE else MARKS, top.inside):
                mark = _BY_NAME
            label = tag
            if tag not in PROSE and "class" in attributes and (c := _CLASS.search(attributes)):
                label = ".".join([tag, *sorted((c[1] or c[2] or c[3] or "").split())])
            path = numbers.setdefault((self.paths[top.element], label), len(numbers) + 1)
            stack.append(_Open(tag, len(self.tags), top.linked or bool(top.counts[_LINK]), top.code or bool(top.counts[_IN_CODE]) or tag == "pre", inside))
            opened[tag] += 1
            self.tags.append(tag)
            self.parents.append(top.element)
            self.paths.append(path)
            self.marks.append(mark)
        flush()

    def last_inside(self) -> list[int]:
        """The last element within each element; those between are all within it."""
        last = list(range(len(self.tags)))
        for i in range(len(last) - 1, 0, -1):
            last[self.parents[i]] = max(last[self.parents[i]], last[i])
        return last

    def banned(self) -> list[bool]:
        """Whether each element lies in one that is marked.

        A name's mark, or a form, counts for nothing where it surrounds the page's
        main heading or main element and over half of its text.
        """
        n = len(self.tags)
        own, heads = [0] * n, [t in ("h1", "main") for t in self.tags]
        for at, text, links in zip(self.owners, self.texts, self.linked, strict=True):
            own[at] += len(text) - links
        hidden = [False] * n
        for i in range(1, n):
            hidden[i] = hidden[self.parents[i]] or self.marks[i] == _BY_ELEMENT
        mass = [0 if h else x for h, x in zip(hidden, own, strict=True)]
        for i in range(n - 1, 0, -1):
            mass[self.parents[i]] += mass[i]
            heads[self.parents[i]] |= heads[i] and not hidden[i]
        out = [False] * n
        for i in range(1, n):
            around = heads[i] and 2 * mass[i] > mass[0]
            out[i] = out[self.parents[i]] or hidden[i] or (self.marks[i] == _BY_NAME and not around)
        return out


def path_scores(page: Page, banned: list[bool]) -> tuple[list[float], dict[int, float]]:
    """Each block's smoothed and fused score, and the mean score of each path that isn't banned."""
    totals: dict[int, list[int]] = {}
    for at, text, links in zip(page.owners, page.texts, page.linked, strict=True):
        if not banned[at]:
            t = totals.setdefault(page.paths[at], [0, 0, 0])
            t[0] += len(text) - links
            t[1] += len(_PUNCTUATION.findall(text))
            t[2] += 1
    ratios = {p: (length / n, marks / n) for p, (length, marks, n) in totals.items()}
    raw = [(0.0, 0.0) if banned[at] else ratios[page.paths[at]] for at in page.owners]
    before, own, after = SMOOTHING
    scores: list[float] = []
    sums: dict[int, list[float]] = {}
    for i, at in enumerate(page.owners):
        prior, later = raw[max(i - 1, 0)], raw[min(i + 1, len(raw) - 1)]
        length, marks = (before * p + own * x + after * q for p, x, q in zip(prior, raw[i], later, strict=True))
        scores.append(length * (1.0 + marks) if raw[i][0] else 0.0)  # a block that is banned, or all link, has none
        if not banned[at]:
            s = sums.setdefault(page.paths[at], [0.0, 0])
            s[0] += scores[-1]
            s[1] += 1
    return scores, {p: s / n for p, (s, n) in sums.items()}


def content_paths(scores: list[float], by_path: dict[int, float], n_allowed: int, threshold: float) -> set[int]:
    """The paths whose mean score is at least ``threshold`` of the mean of all blocks that may be content."""
    least = threshold * sum(scores) / n_allowed
    return {p for p, s in by_path.items() if s >= least and s > 0}


def _article(page: Page, mass: list[float]) -> int:
    """The smallest element that holds all of the content, or a near article or main element that holds as much.

    Where the content lies in several elements, an article or main element among
    them that has most of it is taken, unless others beside it have its path.
    """
    heaviest: dict[int, int] = {}
    alike: Counter[tuple[int, int]] = Counter()
    for i in range(1, len(mass)):
        p = page.parents[i]
        if mass[i] > 0:
            alike[p, page.paths[i]] += 1
            if p not in heaviest or mass[i] > mass[heaviest[p]]:
                heaviest[p] = i
    at = 0
    while at in heaviest:
        c = heaviest[at]
        if mass[c] >= mass[at] * (1 - 1e-9) or (page.tags[c] in ARTICLES and 2 * mass[c] > mass[at] and alike[at, page.paths[c]] == 1):
            at = c
        else:
            break
    chain = [at]
    while chain[-1]:
        chain.append(page.parents[chain[-1]])
    for kind in ARTICLES:
        for e in chain:
            if page.tags[e] == kind:
                return e
    return next(e for e in chain if page.tags[e] not in PARTS)


def content_blocks(page: Page, threshold: float = THRESHOLD) -> list[int]:
    """The blocks that make up the article, in order."""
    banned = page.banned()
    allowed = [i for i, at in enumerate(page.owners) if not banned[at]]
    if not allowed:
        return []
    scores, by_path = path_scores(page, banned)
    content = content_paths(scores, by_path, len(allowed), threshold)
    mass = [0.0] * len(page.tags)
    for i in allowed:
        if page.paths[page.owners[i]] in content:
            mass[page.owners[i]] += scores[i]
    for i in range(len(mass) - 1, 0, -1):
        mass[page.parents[i]] += mass[i]
    if not mass[0]:  # all text stands in links
        return [i for i in allowed if _within_article(page, page.owners[i])]
    chosen = _article(page, mass)
    if page.tags[chosen] not in FLAT:
        last = page.last_inside()[chosen]
        own = [i for i in allowed if chosen <= page.owners[i] <= last]
        heads = [i for i in allowed if i < own[0] and page.tags[page.owners[i]] == "h1"]
        return (heads[-1:] if all(page.tags[page.owners[i]] != "h1" for i in own) else []) + own
    # Nothing but the page surrounds the content: text outside of it counts where prose stands, links don't.
    unlinked = lambda i: 2 * page.linked[i] < len(page.texts[i])
    held = [i for i in allowed if page.paths[page.owners[i]] in content and unlinked(i)]
    inner = lambda i: held[0] <= i <= held[-1] and page.paths[page.owners[i]] in content
    prose = lambda i: unlinked(i) and (held[0] < i < held[-1] or page.tags[page.owners[i]] in PROSE)
    return [i for i in allowed if inner(i) or prose(i)] if held else []


def _within_article(page: Page, element: int) -> bool:
    while element:
        if page.tags[element] in ARTICLES:
            return True
        element = page.parents[element]
    return False


def extract_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The article's blocks, joined by one space; empty if there is none."""
    page = Page(html or "")
    return " ".join(page.texts[i] for i in content_blocks(page, threshold))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row: id, url, text, n_chars.

    The whole page is read, in time and memory in proportion to it, however deep
    it is nested. A null page counts as empty; a page without text that may be
    content has an empty text. Null ids and URLs are kept. Rows that repeat are
    extracted each; an empty table gives no rows. Columns are taken by place, so
    others may have clashing names.
    """
    rows = take(df, {"id": id_col, "url": url_col, "html": html_col})
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract_text(h.as_py(), threshold) for h in batch.column(2)]
            yield output({"id": (None, batch.column(0)), "url": (None, batch.column(1)), "text": (pa.string(), texts), "n_chars": (pa.int64(), [len(t) for t in texts])})

    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
