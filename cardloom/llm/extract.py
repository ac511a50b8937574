"""Main text of listing pages by the distribution of text over blocks of lines."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Lines of a sliding window, and the characters of a window at which text surges.
WINDOW, SURGE = 3, 80

# HTML elements by their part in the layout.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav
    ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav aside footer form button select menu object canvas audio video dialog".split())
#: Words of class, id or role that mark what is not the article.
NOISE = frozenset("""ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion
    cookie cookies consent notice notices alert popup modal sidebar side aside menu nav navbar navigation
    breadcrumb breadcrumbs header masthead footer toolbar comment comments disqus reply replies respond
    share sharing social related recommended newsletter subscribe subscription signup login search widget
    pagination pager copyright toc complementary contentinfo""".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                  r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_WORD = re.compile(r"[a-z]+")


def _marks(name: str, attributes: str) -> tuple[bool, bool]:
    """(noise, article) by the tag's name, class, id, role and hidden state."""
    noise, article = name in DROPPED, name in ("article", "main")
    if attributes.strip():
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role"):
                found = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
                if not NOISE.isdisjoint(_WORD.findall(found)) and name not in ("html", "body"):
                    noise = True
                if value.lower() == "main":
                    article = True
            elif key == "itemprop" and value.lower() == "articlebody":
                article = True
            elif key == "aria-hidden" and value.lower() == "true":
                noise = True
        if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes):
            noise = True
    return noise, article


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, in a marked article) of each line of a page. A line is
    the text of one block with references decoded and white space joined; a block that is no
    part of the article by its mark gives ``WINDOW`` empty lines."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = [0]
    stack: list[tuple[str, bool, bool, bool]] = []   # name, noise, article, link
    open_: Counter[str] = Counter()                  # elements of the stack by name: what is not open is not looked for
    noise = article = link = 0

    def end_line() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            lines.append((text, max(0, len(text) - linked[0]), article > 0))
        parts.clear()
        linked[0] = 0

    def close(until: int) -> None:
        nonlocal noise, article, link
        while len(stack) > until:
            name, n, a, k = stack.pop()
            open_[name] -= 1
            if name in BLOCKS:
                end_line() if not noise else parts.clear()
            noise, article, link = noise - n, article - a, link - k
            if n and not noise and not article:
                lines.extend([("", 0, False)] * WINDOW)

    at = 0
    while at < len(html):
        m = _TAG.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text and not noise:
            parts.append(text)
            if link:
                linked[0] += len(" ".join(entities.unescape(text).split()))
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA[") and not noise:
                parts.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        name = m[2].lower()
        if m[1]:
            opened = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name) if open_[name] else None
            if opened is None:
                if name in BLOCKS and not noise:
                    end_line()
            elif name in BLOCKS or name in DROPPED:
                close(opened)
            elif not any(s[0] in BLOCKS for s in stack[opened + 1:]):
                close(opened)
            continue
        if name in RAW:
            over = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = over.start() if over else len(html)
            gone = _TAG.match(html, at)
            at = gone.end() if gone else len(html)
            continue
        if name in BLOCKS:
            if name != "body" and stack and stack[-1][0] in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and (
                    stack[-1][0] == "p" or stack[-1][0] == name):
                close(len(stack) - 1)
            elif name in BLOCKS and open_["p"]:
                # A block ends an open paragraph and what is open inside it.
                close(max(i for i, s in enumerate(stack) if s[0] == "p"))
            if not noise:
                end_line()
        elif name == "br" and not noise:
            parts.append(" ")
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        n, a = _marks(name, m[3])
        if name == "header" and not article:
            n = True
        if n and not noise:
            end_line() if name in BLOCKS else None
            if not article:
                lines.extend([("", 0, False)] * WINDOW)
        stack.append((name, n, a and not n and not noise, name == "a"))
        open_[name] += 1
        noise, article, link = noise + n, article + (a and not n and not noise), link + (name == "a")
    close(0)
    end_line()
    return lines


def _runs(size: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, greatest window sum) of the runs of lines from which a window holds text."""
    sums = [sum(size[i:i + WINDOW]) for i in range(len(size))]
    runs, i = [], 0
    while i < len(size):
        if not sums[i]:
            i += 1
            continue
        end = i
        while end < len(size) and sums[end]:
            end += 1
        runs.append((i, end, max(sums[i:end])))
        i = end
    return runs


def main_text(html: str | None) -> str:
    """The lines between the points where text surges and dives, joined by line ends.

    Text sums over ``WINDOW`` lines from each line on. Text begins at a line where the sum reaches
    ``SURGE`` characters and ends where it dives to nothing, that is before ``WINDOW`` empty lines;
    lines in between all stay, short ones too. Link text has no length, so menus make no surge. A
    page whose text never surges gives its longest run.

    Marks of an article weigh lines, they do not choose them: where the marked lines hold at least
    as much text as the strongest run outside them, lines outside weigh nothing, and each marked
    line weighs a surge more, link text included. Else (a teaser in a mark beside the body) lines
    weigh the same inside and outside."""
    lines = lines_of(html or "")
    size = [n for _, n, _ in lines]
    inside = sum(n for _, n, a in lines if a) or sum(len(t) for t, _, a in lines if a)
    if inside:
        outside = [0 if a else n for _, n, a in lines]
        body = max((sum(outside[a:b]) for a, b, most in _runs(outside) if most >= SURGE), default=0)
        if inside >= body:
            size = [len(t) + SURGE if a and t else 0 for t, _, a in lines]
    runs = _runs(size)
    strong = [r for r in runs if r[2] >= SURGE] or sorted(runs, key=lambda r: -sum(size[r[0]:r[1]]))[:1]
    marked = size != [n for _, n, _ in lines]
    return "\n".join(lines[i][0] for a, b, _ in strong for i in range(a, b) if lines[i][0] and (size[i] or not marked))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every listing page; NULL or text-free pages give an
    empty text. Row by row, so nothing is shuffled; repeated rows come back repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
