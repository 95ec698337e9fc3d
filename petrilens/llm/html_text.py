"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block of the page, and lines of page furniture (menus, adverts, forms, comments ...)
are set aside.  The others weigh their text less twice the part in links; ``article`` and ``main`` are a prior: on a
page that has one, lines inside weigh four times as much and lines outside a quarter, less a short line's worth.
Weights are summed over a sliding window of lines.  Text lies between dives, the places where whole windows weigh
nothing; a stretch between two dives is kept if a window in it surges over the threshold, from its first weighty line to
its last.  A page on which no window surges keeps what weighs anything.

Rows: a null page is an empty one, an empty page gives an empty text, cut-off markup is read as far as it goes,
repeated rows stay, and other columns of the input never matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrilens.llm.common import bounded_batches

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|svg|math|object|textarea|select|title|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*>|<[!?][^>]*>",
    re.I | re.S,
)
_ATTR = re.compile(r"([a-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br"}
_FURNITURE = frozenset("nav footer aside form button menu dialog input label fieldset search head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class names and ids of furniture; a name counts if all its words are of these or of the layout words.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion teaser sidebar sidenav menu nav navbar navigation topnav breadcrumb breadcrumbs footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies share sharing social related recommended "
    "recommendations widget pagination pager copyright disclaimer tags".split()
)
_LAYOUT = frozenset("site page main top bottom left right upper lower box block area section wrapper wrap container list inner outer bar item items panel form header head body thread links link buttons button icons policy modal unit slot".split())
#: Elements that hold other blocks; inside an article only these can be furniture by their name.
_HOLDERS = frozenset("div section aside ul ol nav form table article header footer figure iframe details menu".split())


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a class or id value has a name made of the words ``names`` (and layout words or numbers) alone."""
    for name in value.split():
        words = [w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", name) if w]
        if any(w in names for w in words) and all(w in names or w in _LAYOUT or w.isdigit() for w in words):
            return True
    return False


def _is_furniture(tag: str, attrs: str, in_body: bool) -> bool:
    if tag in _FURNITURE or tag == "header" and not in_body:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        if m[5]:
            return True
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if (not in_body or tag in _HOLDERS) and _named(value, _NAMES) or not in_body and tag != "article" and _named(value, frozenset(["header"])):
                return True
        elif key == "role" and value.lower() in _ROLES or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def page_lines(html: str) -> list[tuple[str, int, bool, bool]]:
    """Lines of a page in its order: text, characters of it inside links, of furniture, inside an article."""
    lines, parts, link_chars = [], [], 0
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, furniture, article, link; each with what stands around it
    opened: Counter[str] = Counter()  # tags on the stack
    furniture = article = link = False

    def flush() -> None:
        nonlocal parts, link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append((text, link_chars, furniture, article))
            parts, link_chars = [], 0

    def state() -> None:
        nonlocal furniture, article, link
        _, furniture, article, link = stack[-1] if stack else ("", False, False, False)

    def close(tag: str) -> None:
        """Takes the last open ``tag`` off the stack, with all that is open inside it."""
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == tag:
                break
        state()

    def add(raw: str) -> None:
        nonlocal link_chars
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            link_chars += len(text)

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if m[0].startswith("<![CDATA["):
            add(m[0][9:].removesuffix("]]>"))
        if not tag:
            continue
        if tag in _BLOCK:
            flush()
        if m["end"] or m["end2"]:
            if opened[tag]:
                close(tag)
            continue
        if tag in _CLOSES_P and any(s[0] == "p" for s in stack[-4:]):
            close("p")
        if tag in ("li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
            close(tag)
        if tag in _VOID or m[0].endswith("/>"):
            continue
        bad = furniture or _is_furniture(tag, m["attrs"] or "", article)
        stack.append((tag, bad, article or not bad and tag in ("article", "main"), link or tag == "a"))
        opened[tag] += 1
        state()
    if at < len(html):
        add(html[at:])
    flush()
    return lines


def line_weights(lines: list[tuple[str, int, bool, bool]]) -> list[float]:
    """Weights of lines without furniture: characters less twice those in links, times four (and never nothing) inside an
    article that the markup names, a quarter less 22 outside it."""
    named = any(article for _, _, _, article in lines)
    out = []
    for text, links, _, article in lines:
        free = max(0, len(text) - 2 * links)
        out.append(len(text) + 3 * free if article else max(0.0, free / 4 - 22) if named else free)
    return out


def text_regions(weights: list[float], window: int = 3, threshold: float = 86) -> list[tuple[int, int]]:
    """Line ranges between two dives (``window`` lines that weigh nothing) in which a window sums over ``threshold``,
    each from its first weighty line to its last.  If none surges, those at threshold zero."""
    found, first, last = [], None, -1
    for k, w in [*enumerate(weights), (len(weights) + window, 1)]:
        if w <= 0:
            continue
        if first is not None and k - last > window:
            if any(sum(weights[i : min(i + window, last + 1)]) > threshold for i in range(first, last + 1)):
                found.append((first, last + 1))
            first = None
        first, last = k if first is None else first, k
    return found or (text_regions(weights, window, 0) if threshold else [])


def main_text(html: str | None, window: int = 3, threshold: float = 86) -> str:
    """The page's article: its lines between surge and dive, furniture left out, joined by one space."""
    lines = [line for line in page_lines(html or "") if not line[2]]
    weights = line_weights(lines)
    return " ".join(lines[k][0] for a, b in text_regions(weights, window, threshold) for k in range(a, b) if weights[k] > 0)


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = 3, threshold: float = 86) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (empty if none), n_chars (code points)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["text"] = [main_text(h, window, threshold) for h in b.pop("html")]
            b["n_chars"] = b["text"].str.len().astype("int64")
            yield b

    bounded_batches(pages.sparkSession)
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
