"""Main text of web pages by line-block distribution.

Markup is turned into lines: a block element is a line of text.  What a line weighs is its own
text, links taken off.  The weights are summed over a sliding window of lines; text surges
where the sums leave zero and dives where a whole window weighs nothing, so runs of bare links
and gaps lie between the regions, and short lines beside text stay.  The sums decide

* which regions of the article are text, and which are lists of links;
* whether an element whose class or id is of a doubtful kind (a notice, a discussion, related
  things) is text after all: one that surges within the article stays;
* which of several article elements belong to the page's text: those that surge.

Elements that are never text of an article (menus, footers, sidebars, adverts, forms, scripts,
reader comments, and what is hidden) become gaps of empty lines as wide as the window.

Without an article element the heaviest region and the regions of the same article are kept.
The page's frame is then the outermost container around the heaviest region that holds a
header, menu or footer itself, or else the body; regions in the heaviest one's container
within the frame are of its article, and so are regions that no header, menu, sidebar or
footer of the frame parts from it, unless half of their text is links.

Defined results: a null or empty page has an empty text; character references are decoded
once; white space inside a block is one blank; blocks are joined in page order by one
blank; nothing is capped; equal pages get equal texts; a page without any block of text
gets an empty one; unclosed and stray tags are tolerated: an element left out that is never
closed ends at the next block (a footer, or a script, at the end of the page).  The work is
proportional to the page.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table

#: Lines in a window of the distribution.
WINDOW = 3
#: Characters of own text in a window at which text surges, or half of the page's largest sum if that is less.
SURGE = 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
_RAW = frozenset("script style template noscript iframe object svg math canvas textarea title xmp noembed noframes audio video".split())
_DROPPED = frozenset("head nav footer aside menu dialog select button fieldset datalist option label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article blockquote body br caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup"
    " hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("div section ul ol dl table center".split())
#: Elements that, if they are never closed, take the rest of the page with them.
_TO_THE_END = frozenset("head footer script style".split())
#: Words in class, id or role that mark an element as no part of an article, wherever it stands.
_NEVER = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr"
    " comment comments commentlist disqus".split()
)
#: Words that mark one beside an article; inside it such an element is doubtful.
_BESIDE = frozenset(
    "promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar newsletter subscribe subscription signup share sharing"
    " pagination pager complementary contentinfo".split()
)
#: Words that say where and how an element lies: with them a mark is still a mark ("ad-slot", "left-sidebar").
_PLACES = frozenset(
    "area article bar block body bottom box button buttons center col column container content core desktop div el element entry footer form frame group"
    " header holder icons id inner item items js left line link links list main mobile module outer page panel placeholder post posts primary right row"
    " secondary section site slot small story top ui unit upper view widget wrap wrapper zone".split()
)
#: Words that mark an element as doubtful: its lines' weights decide.
_DOUBTFUL = frozenset(
    "banner aside widget widgets footer foot header masthead topbar toolbar notice notices alert popup modal overlay login search social"
    " related recommended recommendations discussion replies respond responses skip copyright legal disclaimer rail".split()
)
#: Elements of a page's frame, and the words that mark them.
_FRAME = frozenset("header nav footer".split())
_FRAME_MARKS = frozenset("header masthead topbar nav navbar navigation menu footer contentinfo sidebar".split())
#: Words that say how a container is arranged ("has-sidebar"), not what it holds.
_ARRANGEMENT = frozenset("has with no without layout".split())
_MARKS = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN_ATTRIBUTE = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

TEXT, DOUBT, SIDE, LEFT_OUT = range(4)


def _kind(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element's lines are text, doubtful, left out unless it holds most of the page's text, or left out."""
    if name in _DROPPED or name == "header" and not in_article:
        return LEFT_OUT
    kind = SIDE if name == "form" else TEXT
    if not attributes or name in ("html", "body"):
        return kind
    for m in _MARKS.finditer(attributes):
        for mark in (m[1] or m[2] or m[3] or "").lower().split():
            words = set(_WORD.findall(mark))
            if not words.isdisjoint(_ARRANGEMENT):
                continue
            if name in ("main", "article"):
                words &= {"comment", "comments"}
            never, beside = words & _NEVER, words & _BESIDE
            if not in_article:
                beside |= words & _FRAME_MARKS
            doubtful = words & _DOUBTFUL
            # a mark among words of another kind ("sharing-economy", "page-nav-open") says little about what an element holds,
            # and nothing in an article or about a paragraph
            whole = words <= never | beside | doubtful | _PLACES
            if never and whole:
                return LEFT_OUT
            if beside and whole and not in_article:
                kind = max(kind, SIDE)
            elif (beside or doubtful or never) and (whole or not in_article and name in _CONTAINERS):
                kind = max(kind, DOUBT)
    return LEFT_OUT if _HIDDEN.search(attributes) or _HIDDEN_ATTRIBUTE.search(_QUOTED.sub("", attributes)) else kind


class Line:
    """A block's text and what it weighs, its container, the article element and the doubtful element it stands in (0: none)."""

    __slots__ = ("text", "weight", "place", "article", "doubt")

    def __init__(self, text: str, weight: int, place: int, article: int, doubt: int):
        self.text, self.weight, self.place, self.article, self.doubt = text, weight, place, article, doubt


def _gap(article: int) -> list[Line]:
    return [Line("", 0, -1, article, 0) for _ in range(WINDOW)]


class Layout:
    """The container of each container (the body and what is above it are 0), and which container held a part of the frame before which line."""

    __slots__ = ("parents", "frame")

    def __init__(self):
        self.parents: dict[int, int] = {}
        self.frame: list[tuple[int, int]] = []

    def path(self, place: int) -> list[int]:
        """The containers around a place, the body first."""
        out = []
        while place:
            out.append(place)
            place = self.parents[place]
        return [0, *out[::-1]]


def _is_frame(name: str, attributes: str) -> bool:
    return name in _FRAME or any(not _FRAME_MARKS.isdisjoint(_WORD.findall((m[1] or m[2] or m[3] or "").lower())) for m in _MARKS.finditer(attributes))


def tags(page: str) -> tuple[list[tuple], list[int]]:
    """(start, end, name, closes, attributes) of each tag outside comments and raw elements, and the
    number of the tag that closes it (-1: none).  Comments and raw elements are tags without a name."""
    out: list[tuple] = []
    closed_by: list[int] = []
    opened: dict[str, list[int]] = {}
    never_closed: set[str] = set()
    at, end = 0, page.rfind(">") + 1
    while at < end:
        m = _TOKEN.search(page, at, end) if page.find("<", at, end) >= 0 else None
        if m is None:
            break
        at, name = m.end(), (m[2] or "").lower()
        if name in _RAW and not m[1]:
            close = None if name in never_closed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                never_closed.add(name)
                at = at if name in ("title", "svg", "math", "object") else len(page)
            out.append((m.start(), at, "iframe" if name in ("iframe", "noscript", "textarea") else "", False, ""))
            closed_by.append(-1)
            continue
        out.append((m.start(), at, name, bool(m[1]), m[3] or ""))
        closed_by.append(-1)
        if m[1]:
            if opened.get(name):
                closed_by[opened[name].pop()] = len(out) - 1
        elif name and name not in _VOID and not m[3].endswith("/"):
            opened.setdefault(name, []).append(len(out) - 1)
    return out, closed_by


def _own_text(page: str, found: list[tuple]) -> list[int]:
    """Characters of text outside links before each tag, and on the whole page."""
    out, total, at, linked = [], 0, 0, False
    for start, end, name, closes, _ in found:
        if not linked:
            total += len(page[at:start].strip())
        out.append(total)
        at = end
        if name == "a":
            linked = not closes
    out.append(total + len(page[at:].strip()))
    return out


def lines(page: str) -> tuple[list[Line], Layout]:
    """The page's lines; a line without text is part of a gap that an element left out has made."""
    out: list[Line] = []
    layout = Layout()
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []
    places = article = articles = linked = doubts = 0
    doubtful: list[tuple[int, int, int]] = []  # those that are open: number, closing tag, the article they stand in
    own: list[int] = []
    in_link = mute = False
    found, closed_by = tags(page)

    def flush():
        nonlocal linked
        if buffer:
            text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                doubt = doubtful[-1][0] if doubtful and doubtful[-1][2] == article else 0
                out.append(Line(text, max(0, len(text) - linked), stack[-1][1] if stack else 0, article, doubt))
        linked = 0

    at = k = 0
    while True:
        start = found[k][0] if k < len(found) else len(page)
        if start > at and not mute:
            buffer.append(page[at:start])
            linked += in_link * (start - at)
        if k == len(found):
            break
        _, at, name, closes, attributes = found[k]
        while doubtful and doubtful[-1][1] <= k:
            flush()
            doubtful.pop()
        k += 1
        if not name:
            continue
        if name == "iframe":
            flush()
            continue
        if closes:
            in_link = in_link and name != "a"
            if name in _BLOCK:
                flush()
                mute = False
                for i in range(len(stack) - 1, max(-1, len(stack) - 200), -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                if name in ("article", "main") and article and all(t not in ("article", "main") for t, _ in stack):
                    article = 0
            continue
        kind = TEXT if name in _VOID or attributes.endswith("/") else _kind(name, attributes, article > 0)
        if kind == SIDE:
            close, own = closed_by[k - 1], own or _own_text(page, found)
            kind = LEFT_OUT if close < 0 or 2 * (own[close] - own[k - 1]) <= own[-1] else TEXT
        if kind == LEFT_OUT:
            flush()
            if not article and _is_frame(name, attributes):
                layout.frame.append((stack[-1][1] if stack else 0, len(out)))
            out.extend(_gap(article))
            close = closed_by[k - 1]
            mute = close < 0
            if close >= 0:
                at, k = found[close][1], close + 1
                while doubtful and doubtful[-1][1] < k:
                    doubtful.pop()
            elif name in _TO_THE_END:
                break
            continue
        if kind == DOUBT and closed_by[k - 1] >= 0:
            flush()
            doubts += 1
            doubtful.append((doubts, closed_by[k - 1], article))
        if name in _BLOCK:
            flush()
            mute = False
            if name not in _VOID and name != "p":
                if name not in ("html", "body"):
                    places += 1
                    layout.parents[places] = stack[-1][1] if stack else 0
                if name in ("article", "main") and not article:
                    articles += 1
                    article = articles
                stack.append((name, 0 if name in ("html", "body") else places))
        elif name == "a":
            in_link = True
    flush()
    return out, layout


def sums(weights: list[int]) -> list[int]:
    """Sums over each window of lines; fewer lines than a window are one window."""
    now = sum(weights[:WINDOW])
    out = [now]
    for i in range(WINDOW, len(weights)):
        now += weights[i] - weights[i - WINDOW]
        out.append(now)
    return out


def regions(weights: list[int]) -> list[tuple[int, int]]:
    """(surge, dive) line ranges: what is left of the lines when those in a window that weighs nothing are taken out."""
    dived = [False] * len(weights)
    over = 0
    for i, total in enumerate(sums(weights)):
        if not total:
            for j in range(max(i, over), min(i + WINDOW, len(weights))):
                dived[j] = True
            over = i + WINDOW
    out, surge = [], -1
    for i, down in enumerate([*dived, True]):
        if not down and surge < 0:
            surge = i
        elif down and surge >= 0:
            out.append((surge, i))
            surge = -1
    return out


def _settled(found: list[Line]) -> list[Line]:
    """Lines of doubtful elements that do not surge as the page's text does become gaps."""
    groups: dict[int, list[Line]] = {}
    for x in found:
        if x.doubt:
            groups.setdefault(x.doubt, []).append(x)
    if not groups:
        return found
    plain = max(sums([x.weight for x in found if not x.doubt]))
    body = any(x.article and x.text for x in found)
    limit = 2 * min(SURGE, plain / 2) or 1
    text = {g for g, own in groups.items() if max(sums([x.weight for x in own])) >= limit and (own[0].article or not body)}
    out: list[Line] = []
    for x, before in zip(found, [None, *found], strict=False):
        if not x.doubt or x.doubt in text:
            out.append(x)
        elif before is None or before.doubt != x.doubt:
            out.extend(_gap(x.article))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found, layout = lines(page)
    places = {id(x): i for i, x in enumerate(found)}
    found = _settled(found)
    weights = [x.weight for x in found]
    cut = regions(weights)
    in_article: dict[int, list[Line]] = {}
    for x in found:
        if x.article and x.text:
            in_article.setdefault(x.article, []).append(x)
    if in_article:
        # a page may hold several articles and teasers of others, which have a link and do not surge
        peaks = {k: max(sums([x.weight for x in v])) for k, v in in_article.items()}
        surge = min(SURGE, max(peaks.values()) / 2)
        told = {k for k, v in peaks.items() if v >= surge or all(x.weight == len(x.text) for x in in_article[k])}
        own = [x for lo, hi in cut for x in found[lo:hi] if x.text and x.article in told]
        return " ".join(x.text for x in own or [x for x in found if x.text and x.article in told])
    if not cut:
        return ""
    weight = lambda lo, hi: sum(weights[lo:hi])
    lo, hi = max(cut, key=lambda r: (weight(*r), -r[0]))
    homes = {x.place for x in found[lo:hi] if x.text}
    paths = [layout.path(p) for p in sorted(homes)]
    around = [level[0] for level in zip(*paths, strict=False) if len(set(level)) == 1]
    holders = {p for p, _ in layout.frame}
    depth = next((k for k, p in enumerate(around) if p in holders), 0)
    frame = around[depth]
    articles = {p[depth + 1] for p in paths if len(p) > depth + 1}
    first = lambda a: next(places[id(x)] for x in found[a:] if x.text)
    parted = lambda a: sum(p == frame and i <= first(a) for p, i in layout.frame)

    def belongs(a, b):
        places = {x.place for x in found[a:b] if x.text}
        inner = [p[depth:] for p in map(layout.path, places) if len(p) > depth and p[depth] == frame]
        if homes & places or any(len(p) > 1 and p[1] in articles for p in inner):
            return True
        return bool(inner) and parted(a) == parted(lo) and weight(a, b) * 2 >= sum(len(x.text) for x in found[a:b])

    kept = [r for r in cut if r == (lo, hi) or belongs(*r)]
    return " ".join(x.text for a, b in kept for x in found[a:b] if x.text)


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``, the main text of ``html``, and ``n_chars``."""
    made = map_texts(pages, "html", lambda pages: {"text": [main_text(p) for p in pages]}, [("text", T.StringType())], keep)
    return made.withColumn("n_chars", F.length("text").cast("long"))


def op2_main_text(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
