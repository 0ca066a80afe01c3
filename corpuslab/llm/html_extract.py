"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with its root-to-leaf tag path
(names with classes and ids). Text length, link text and punctuation are
summed per path; a path's ratio is its mean own text per node, raised by its
punctuation. Ratios are smoothed along the page, fused with the unsmoothed
ones, and paths at or above a share of their spread are content. Paths that
sit in the same article as a content path, or beside it in the same parent,
are content as well, so short paragraphs and headings stay. Menus, page
headers and footers, asides, forms, adverts, notices and reader comments are
known by tag, role, class or id and do not count. A class or id only proposes:
it must name the element (``has-sidebar`` names another one, ``related-work``
is a topic), and an element that holds the page's article, or most of the text
of its article or page, is a wrapper and stays, as does a form around the
page. Text that is mostly links is navigation outside the article; inside it
only a run of many such blocks is (a linked title or two sources are text).
Pages are independent: one narrow pass.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Path ratios this share of their standard deviation and more are content.
SPREAD = 0.5
#: Blocks whose text is links to more than this share are navigation.
LINKS = 0.6
#: So many such blocks of one path are navigation even inside an article.
MANY_LINKS = 5
#: An element marked as layout with this share of its article's or page's text is a wrapper; one marked otherwise needs more.
WRAPPER = 0.5
WRAPPER_OTHER = 0.8

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*>|<[a-zA-Z][^>]*>""", re.S)
#: A tag whose quotes do not close: it ends at the next angle bracket and has no attributes.
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PUNCT = re.compile(r"[.,;:!?。，！？；：]")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template xmp iframe".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())
#: Elements whose text is no article text wherever they stand.
_NEVER = frozenset("head nav footer aside menu svg math select button dialog object audio video canvas map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar".split())
#: Words that mark such parts in classes and ids.
_MARKS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer header masthead topbar banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies widget "
    "toolbar pagination pager tags skip".split())
#: Marks of page parts whose names wrappers borrow.
_LAYOUT = frozenset("form nav navbar navigation menu sidebar aside footer header masthead topbar banner widget toolbar social tags".split())
#: Inside an article these mark the article's own head.
_HEADS = frozenset("header masthead banner".split())
#: Words that may stand beside a mark in a token; with any other word the token is a topic (share-price, social-history).
_BESIDE = frozenset(
    "area article articles bar block blocks body bottom box button buttons card cards center col column container content count counts "
    "desktop entry field fields fixed floating form forms global google grid group head hidden icon icons inline inner item items label large "
    "leaderboard left link links list lists main message messages mobile module news number outer page panel placement post posts primary "
    "region right row secondary section site skyscraper slot small sticky stories story text thread threads title toggle tools top trigger "
    "unit wide wrap wrapper zone".split())
#: Marks that are topics too; on a text element they say what it is about.
_TOPICS = frozenset(
    "alert login notice notices promotion recommended related reply replies respond share sharing signup skip social sponsor subscription tags".split())
_TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td th dd dt figcaption caption".split())
#: First words of tokens that say something about an element and do not name it.
_STATES = frozenset("has have with no not without is are can show shows hide hides js uses use supports enable enabled disable disabled".split())
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p "
    "pre section table ul".split())
_CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    links: int  # characters of link text
    holds: tuple[int, ...] = ()  # marked elements it stands in, outermost first


@dataclass
class _Hold:
    """A marked element: held back unless it turns out to be a wrapper."""

    wrapper: float  # share of the text from which it is one
    article: int | None  # the outermost article or main it stands in
    contains: bool = False  # an article or main of the page


def _label(name: str, attrs: str) -> tuple[str, bool, set[str]]:
    """(path label, whether the element is no article part by its role, marks that name it)."""
    marks, role = [], ""
    if attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            value = html.unescape(a or b or c).lower()
            if key.lower() == "role":
                role = value.strip()
            else:
                marks.extend(value.split())
    named = {"form"} if name == "form" or role == "form" else set()
    for m in marks:
        words = {w for w in re.split(r"[^a-z]+", m) if w}
        if words and re.split(r"[^a-z]+", m.lstrip("-_0123456789"))[0] not in _STATES and words <= _MARKS | _BESIDE:
            named |= words & _MARKS
    if name in _TEXT_ELEMENTS:
        named -= _TOPICS
    return ".".join([name, *sorted(marks)]), role in _ROLES, named


def blocks(page: str | None) -> list[Block]:
    """Text blocks outside the parts that are never content, in page order."""
    page = page or ""
    out: list[Block] = []
    scopes: list[int | None] = []  # the outermost article of each block
    stack: list[tuple[str, str, bool, tuple[int, ...], int | None]] = []  # (name, label, never, holds, outermost article)
    marked: list[_Hold] = []
    articles = 0
    parts: list[str] = []
    link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(parts).split())
        if text and not (stack and stack[-1][2]):
            out.append(Block(tuple(s[1] for s in stack if s[0] not in _INLINE), text, link_chars, stack[-1][3] if stack else ()))
            scopes.append(stack[-1][4] if stack else None)
        parts.clear()
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw and not (stack and stack[-1][2]):
            text = html.unescape(raw)
            parts.append(text)
            if any(s[0] == "a" for s in stack):
                link_chars += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        closing, name, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not name:
            broken = _BROKEN.match(m.group())
            if broken is None:
                continue  # a comment, doctype or other declaration
            closing, name = broken.group(1), broken.group(2).lower()
        if closing:
            if name in _INLINE or any(s[0] == name for s in stack):
                if name not in _INLINE:
                    flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if name in _INLINE and stack[k][0] not in _INLINE:
                        break  # an inline end tag does not end blocks
            elif name == "p":
                flush()
            continue
        if name in _VOID:
            if name == "br":
                parts.append("\n")
            elif name == "hr":
                flush()
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name not in _INLINE:
            flush()
            if name in _CLOSES_P:
                _close(stack, {"p"}, {"article", "section", "div", "td", "th", "li", "body", "main", "blockquote", "table"})
            if name in _CLOSES_SAME:
                _close(stack, _CLOSES_SAME[name], _SCOPE[name])
        label, role, named = _label(name, attrs)
        _, _, held, holds, article = stack[-1] if stack else ("", "", False, (), None)
        in_article = any(s[0] in ("article", "main") for s in stack)
        never = held or role or name in _NEVER or (name == "header" and not in_article)
        if name in ("html", "body", "article", "main") and not held:
            never = role and name == "article" and in_article  # a page or its article is no part of itself; a comment in it is
            if not (name == "article" and in_article):
                named = set()
        if in_article:
            named -= _HEADS
        if attrs.endswith("/") and name not in ("p", "div"):
            continue
        if not held and name in ("article", "main"):
            if article is None:
                article, articles = articles, articles + 1
            if not named and not any(s[0] == "article" for s in stack):
                for k in holds:  # what stands around an article, not a comment in one
                    marked[k].contains = True
        if not never and named:
            holds = (*holds, len(marked))
            marked.append(_Hold(WRAPPER if named <= _LAYOUT else WRAPPER_OTHER, article))
        stack.append((name, label, never, holds, article))
    flush()
    return _released(out, scopes, marked)


def _released(bs: list[Block], scopes: list[int | None], marked: list[_Hold]) -> list[Block]:
    """The blocks outside marked elements and in wrappers."""
    if not marked:
        return bs
    weight = [len(b.text) - min(b.links, len(b.text)) for b in bs]
    size, within = [0] * len(marked), defaultdict(list)
    shown: dict[int | None, int] = defaultdict(int)  # text not held back, of an article or (None) of the page
    in_articles = False  # whether an article has such text
    kept: set[int] = set()

    def show(i: int) -> None:
        shown[None] += weight[i]
        if scopes[i] is not None:
            shown[scopes[i]] += weight[i]

    for i, b in enumerate(bs):
        if not b.holds:
            show(i)
            in_articles |= scopes[i] is not None and weight[i] > 0
        for k in b.holds:
            size[k] += weight[i]
            within[k].append(i)
    # The largest first, so wrappers come before what they hold and before small parts beside them.
    for k in sorted(within, key=lambda k: (-size[k], k)):
        e, holds = marked[k], bs[within[k][0]].holds
        if any(o not in kept for o in holds[:holds.index(k)]):
            continue
        beside, layout = shown[e.article], e.wrapper == WRAPPER
        # An article elsewhere is the page's: other marked elements are no wrappers, whatever articles (comments, adverts) they hold.
        if not size[k] or (e.article is None and in_articles and not (e.contains and layout)) or (e.contains and beside and not layout):
            continue
        if (e.contains and not beside) or size[k] >= e.wrapper * (size[k] + beside):
            kept.add(k)
            for i in within[k]:
                if all(o in kept for o in bs[i].holds):
                    show(i)
                    in_articles |= scopes[i] is not None and weight[i] > 0
    return [b for b in bs if all(k in kept for k in b.holds)]


def _close(stack: list, names: set[str], scope: set[str]) -> None:
    """End the innermost open element of ``names``, looking no further out than ``scope``."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in scope:
            return


def content_paths(bs: list[Block], spread: float = SPREAD) -> set[tuple[str, ...]]:
    """Paths whose fused ratio reaches ``spread`` standard deviations, with those of the same article or parent."""
    stat: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0, 0.0])
    for b in bs:
        s = stat[b.path]
        s[0] += len(b.text)
        s[1] += min(b.links, len(b.text))
        s[2] += len(_PUNCT.findall(b.text))
        s[3] += 1
    ratio = {p: (t - k) / n * (1 + np.log1p(q / n)) for p, (t, k, q, n) in stat.items()}
    linked = {p for p, (t, k, _, _) in stat.items() if k > LINKS * t}
    line = np.array([ratio[b.path] for b in bs])
    kernel = np.array([1, 2, 4, 2, 1]) / 10
    smooth = np.convolve(np.pad(line, 2, mode="edge"), kernel, mode="valid")
    fused: dict[tuple[str, ...], float] = dict(ratio)
    for b, v in zip(bs, smooth):
        fused[b.path] = max(fused[b.path], float(v))
    values = np.array([fused[p] for p in ratio if p not in linked])
    if not len(values):
        return set()
    cut = min(spread * values.std(), values.max())
    chosen = {p for p in ratio if p not in linked and fused[p] >= cut and ratio[p] > 0}
    best = max(chosen, key=lambda p: stat[p][0] - stat[p][1], default=None)
    if best is None:
        return set()
    # The article the best path stands in, else its parent: what stands there too belongs to it.
    tops = [k for k, label in enumerate(best) if label.split(".")[0] in ("article", "main")]
    top = best[:tops[0] + 1] if tops else best[:-1]
    if tops:
        return {p for p in ratio if p[:len(top)] == top and not (p in linked and stat[p][3] >= MANY_LINKS)}
    titles = {p for p in linked if stat[p][3] == 1 and re.match(r"h[1-6](\.|$)", p[-1] if p else "")}
    return chosen | {p for p in ratio if p[:len(top)] == top and (p not in linked or p in titles)}


def main_text(page: str | None, spread: float = SPREAD) -> str:
    bs = blocks(page)
    keep = content_paths(bs, spread) if bs else set()
    return " ".join([b.text for b in bs if b.path in keep])


def extract(pages: DataFrame, spread: float = SPREAD) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty page, or one without content, has an empty text. Pages
    are read whole; rows are independent, so repeated rows repeat; other
    columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            texts = [main_text(h, spread) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
