"""Main text of web pages by the distribution of text over line blocks.

Markup is cut away in one pass that leaves a line for each block of a page: its
text, how much of it is link text, and whether it stands in a part that is no
article (menu, header, footer, sidebar, notice, advert, form, comments). Such
lines count as empty. The lengths of ``WINDOW`` following lines are summed; text
starts where that sum surges and ends where it dives to nothing, and what lies
between is kept. Where a page marks its article (``main``, ``article``) the sums run
over its own lines alone, and the short ones that lead up to a surge are kept with it.

Pages are rows, each is read whole and alone: no shuffle, and Spark bounds a batch
by its bytes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlake.llm.common import need

#: Lines in a window, and the sum at which text surges on a page that marks no article (less on pages of short lines).
WINDOW = 3
SURGE = 80
#: A stretch of text is kept if it has this share of the largest one's.
LEAST_SHARE = 0.3

#: Elements by what they are for.
SILENT = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "select", "button", "textarea", "datalist", "label", "legend", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture"}
SPACES = {"br", "td", "th"}
ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "notice", "alert": "notice", "menu": "menu"}
PARTS = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}
#: Words of class and id that name a part which is no article.
NAMES = {
    "menu": {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pager", "pagination", "skip", "toolbar", "topbar", "tabs"},
    "header": {"header", "masthead", "banner"},
    "footer": {"footer", "copyright", "colophon", "legal"},
    "aside": {"sidebar", "aside", "widget", "widgets", "related", "recommended", "teaser", "teasers", "share", "sharing", "social", "tags"},
    "notice": {"cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall"},
    "advert": {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "adsense"},
    "form": {"form", "login", "signup", "search", "searchbox"},
    "comments": {"comment", "comments", "commentlist", "disqus", "respond", "replies", "discussion"},
}
_PART_OF = {word: part for part, names in NAMES.items() for word in names}
#: Words beside "header" that make it the article's own.
OWN = {"article", "entry", "post", "story", "content"}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def part_of(name: str, rest: str) -> str | None:
    """The part of a page that an element makes, if it is none of the article's."""
    if name in PARTS:
        return PARTS[name]
    if not rest or name in ("html", "body", "main") or name in INLINE and name != "span":
        return None
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
    if "hidden" in found:
        return "hidden"
    if (role := found.get("role", "").lower()) in ROLES:
        return ROLES[role]
    named = set(_WORD.findall(_HUMP.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    parts = {_PART_OF[w] for w in named if w in _PART_OF}
    if named & OWN:
        parts.discard("header")
    if name == "article":
        parts &= {"comments", "advert", "aside"}
    return min(parts, default=None)


def blocks(page: str, by_name: bool = True) -> list[tuple[str, int, str | None, bool]]:
    """(text, characters in links, part or None, whether in a marked article) of each block in page order."""
    out: list[tuple[str, int, str | None, bool]] = []
    stack: list[tuple[str, str | None]] = []  # open elements, and the part that each one starts
    part: str | None = None
    text: list[str] = []
    linked = marked = links = silent = 0

    def flush() -> None:
        nonlocal linked
        s = " ".join(html.unescape("".join(text)).split())
        if s:
            out.append((s, linked, part, marked > 0))
        text.clear()
        linked = 0

    def leave(k: int) -> None:
        """Close all open elements from the k-th on."""
        nonlocal part, marked, links, silent
        for name, _ in stack[k:]:
            marked -= name in ("main", "article")
            links -= name == "a"
            silent -= name in SILENT
        del stack[k:]
        part = next((p for _, p in reversed(stack) if p), None)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        said = page[at : m.start() if m else len(page)]
        if said and not silent:
            text.append(said)
            linked += len(said.strip()) * (links > 0)
        if not m:
            break
        at = m.end()
        if m["cdata"] is not None and not silent:
            text.append(html.escape(m["cdata"]))
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in SPACES:
            text.append(" ")
        block = name not in INLINE and name not in SPACES
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is None or name in INLINE and any(n not in INLINE for n, _ in stack[k:]):
                if block:
                    flush()
                if k is not None:  # an inline element that a block was opened in ends, the block goes on
                    links -= name == "a"
                    stack[k] = ("", stack[k][1])
                continue
            if block:
                flush()
            leave(k)
            continue
        if name in VOID or m["rest"].endswith("/") and name in SILENT:
            if block:
                flush()
            continue
        if raw := _RAW.get(name):
            if block:
                flush()
            close = raw.search(page, at)
            at = close.end() if close else len(page)
            continue
        if block:
            flush()
        if block and stack and stack[-1][0] in ("p", "li", "dt", "dd", "option"):
            # These end where the next of their kind or a block within a paragraph starts.
            if stack[-1][0] == "p" or stack[-1][0] == name:
                leave(len(stack) - 1)
        own = part_of(name, m["rest"]) if by_name or name in PARTS and name != "form" else None
        inside = own or part
        if name in ("main", "article") and not own and part not in (None, "comments", "aside", "footer", "hidden"):
            # What opened around an article is no part of its own.
            stack[:] = [(n, None if p not in ("comments", "aside", "footer", "hidden") else p) for n, p in stack]
            inside = next((p for _, p in reversed(stack) if p), None)
        if name == "header" and marked and own == "header":
            own, inside = None, part
        stack.append((name, own))
        part = inside
        marked += name in ("main", "article")
        links += name == "a"
        silent += name in SILENT
    flush()
    return out


def stretches(weights: list[int], surge: float, back: bool = False) -> list[tuple[int, int]]:
    """[start, end) of each stretch between a surge of the window sums above ``surge`` and their dive to nothing; ``back``: with the text that leads up to the surge."""
    total = [0, *accumulate(weights)]
    n = len(weights)
    sums = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if weights[i] and sums[i] > surge:
            j, first = i, i
            while back and first > (out[-1][1] if out else 0) and weights[first - 1]:
                first -= 1
            while j < n and sums[j]:
                j += 1
            out.append((first, j))
            i = j
        else:
            i += 1
    return out


def main_text(page: str | None) -> str:
    """The article of one page: its blocks joined by line breaks, empty if there is none."""
    for by_name in (True, False):
        lines = blocks(page or "", by_name)
        free = [x for x in lines if x[2] is None]
        if free:
            break
    else:
        return ""
    marked = any(x[3] for x in free)
    weights, at = [], []
    for k, (s, linked, p, inside) in enumerate(lines):
        if marked:
            if inside and not p:  # gaps in a marked article, however long, are parts that were cut out of it
                weights.append(len(s))
                at.append(k)
            continue
        if p in ("footer", "comments", "header", "menu") and weights and (k == 0 or lines[k - 1][2] != p):
            weights += [0] * WINDOW  # text doesn't reach across these
            at += [-1] * WINDOW
        weights.append(0 if p or 2 * linked > len(s) else len(s) - linked)
        at.append(k)
    most = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    found = stretches(weights, min(SURGE, most / 2), marked)
    size = [sum(weights[i:j]) for i, j in found]
    keep = [x for x, n in zip(found, size) if n >= LEAST_SHARE * max(size)]
    return "\n".join(lines[at[k]][0] for i, j in keep for k in range(i, j) if at[k] >= 0 and lines[at[k]][2] is None)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, its main text, and ``n_chars``, the code points of that.

    Null and empty pages, and pages without an article, give an empty text.
    Character references are decoded, white space within a block becomes one
    space, ``br`` and table cells part words but no blocks. Repeated rows stay;
    an empty table gives no rows; columns named ``text`` and ``n_chars`` are
    replaced, all others kept.
    """
    need(pages, html_col)
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    frame = pages.select(*[F.col(c) for c in rest], *([F.col(html_col).alias("text")] if html_col not in rest else []))
    where = frame.columns.index("text" if html_col not in rest else html_col)
    keep = [frame.columns.index(c) for c in rest]
    out = frame.select(*rest).withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(x) for x in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], [*rest, "text", "n_chars"])

    return frame.mapInArrow(run, out)


def main_text_report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; see :func:`extract_main_text`."""
    return extract_main_text(pages.select("page_id", "url", "html")).drop("html")
