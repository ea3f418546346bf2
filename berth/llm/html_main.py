"""Main-text extraction by line-block distribution (operator 3).

Markup is stripped into lines, one per block element. Elements that are never
article text (scripts, menus, forms, adverts, reader comments ...) are dropped.
Where the page marks its article (``article`` or ``main``, or their role), all
lines inside are kept and none outside.

Elsewhere an element dropped outside every container leaves empty lines. Over
the lines' text lengths, without link text, a window of ``WIDTH`` lines is
summed: text starts where the sum surges above a threshold and ends at the
dive, where the whole window is empty. The lines between are kept whole, in
page order, with the link lines next to them in their container; stretches are
one where the container of one's edge holds the other's edge. The threshold is
``SURGE`` characters, or half the page's largest window where the page has
less, so short articles are kept too.

Null, empty or markup-only html gives an empty text; repeated pages are each
extracted; very long pages are read whole; other columns pass through.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from berth.llm.common import prepare, slices

WIDTH, SURGE = 3, 80

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+/?)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
_TO_END = frozenset("script style textarea title".split())  # without an end tag they run to the end of the page
_DROP = frozenset("nav footer aside form menu dialog button fieldset label input head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
# Whole attributes: a name, and its value where one is given.
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CHROME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|"
    r"masthead|cookies?\w*|consent|notices?|gdpr|popup|modal|newsletter|subscribe|subscription|sign-?up|login|share|sharing|"
    r"social|related|recommended|comments?|disqus|respond|replies|reader-?comments?|pager|pagination|toolbar|search|skip|"
    r"widget|site-?header|page-?header|site-?footer|tags?|legal|copyright)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_HOLDERS = frozenset(  # containers; body and html are the page itself
    "article aside blockquote center details div dl fieldset figure footer form header main menu nav ol section table ul".split())
_CLOSES_P = _BLOCK - {"body", "html"}


def _is_chrome(name: str, attrs: str, in_article: int) -> bool:
    if name in _DROP or (name == "header" and not in_article):
        return True
    if not attrs or name in ("body", "html", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        key, val = m[1].lower(), (m[2] or m[3] or m[4] or "").strip()
        if key == "hidden" or (key == "aria-hidden" and val.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", val, re.I):
            return True
        if key == "role" and val.lower() in _ROLES:
            return True
        if key in ("class", "id") and _CHROME.search(val):
            return True
    return False


def _raw_ends(page: str, name: str) -> dict[int, int]:
    """Start of each start tag -> end of its end tag. Script and the like end
    at the next end tag, others may be nested; a tag without an end has none."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in re.finditer(rf"<(?:(/{name}\s*)|{name}(?=[\s/>])((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*+|[^>]*))>", page, re.I):
        if m[1] is None:
            if name in _TO_END or not m[2].endswith("/"):
                opened.append(m.start())
        elif name in _TO_END:
            out.update((k, m.end()) for k in opened)
            opened.clear()
        elif opened:
            out[opened.pop()] = m.end()
    return out


def page_lines(page: str) -> tuple[list[tuple[str, int, bool, int]], list[int]]:
    """(text, characters outside links, inside a marked article, container)
    per line, and the last container inside each container. Containers are
    numbered as they open; 0 is the page."""
    lines: list[tuple[str, int, bool, int]] = []
    last, inside = [0], [0]  # by container; those open now
    parts: list[str] = []
    linked = [0]
    stack: list[tuple[str, bool, bool]] = []  # name, starts a drop, marks the article
    dropped = article = in_link = 0

    def flush(dropping: bool = False) -> None:
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append((text, max(0, len(text) - linked[0]), article > 0, inside[-1]))
            linked[0] = 0
        if dropping and not article and len(inside) == 1:
            lines.extend([("", 0, False, 0)] * WIDTH)

    def say(text: str) -> None:
        if not dropped and text:
            parts.append(text)
            if in_link:
                linked[0] += len(" ".join(_html.unescape(text).split()))

    def close(upto: int) -> None:
        nonlocal dropped, article, in_link
        while len(stack) > upto:
            name, drops, marks = stack.pop()
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in _BLOCK and not dropped:
                flush()
            if name in _HOLDERS:
                last[inside.pop()] = len(last) - 1
            if drops:
                dropped -= 1
                if not dropped:
                    flush(True)
            article -= marks

    ends: dict[str, dict[int, int]] = {}
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        attrs = m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if name in _VOID:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][2] or (stack[k][1] and name not in _BLOCK):
                    break  # a stray end tag never closes its surroundings
            continue
        if name in _RAW and (name in _TO_END or not attrs.endswith("/")):
            if name not in ends:
                ends[name] = _raw_ends(page, name)
            at = ends[name].get(m.start(), n if name in _TO_END else at)
            continue
        if name == "br" or name in ("td", "th", "option"):
            say(" ")
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or (name == "li" and stack[k][0] == "li"):
                    close(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
            if not dropped:
                flush()
        if name in _VOID or attrs.endswith("/"):
            continue
        drops = _is_chrome(name, attrs, article)
        marks = not dropped and not drops and (name in ("article", "main") or any(
            m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").strip().lower() in ("main", "article")
            for m in _ATTR.finditer(attrs)))
        if drops and not dropped:
            flush(True)
        if name in _HOLDERS:
            inside.append(len(last))
            last.append(0)
        dropped += drops
        article += marks
        in_link += name == "a"
        stack.append((name, drops, marks))
    close(0)
    flush()
    last[0] = len(last) - 1
    return lines, last


def kept_lines(lines: list[tuple[str, int, bool, int]], last: list[int], width: int = WIDTH, surge: int = SURGE) -> list[str]:
    """All lines of a marked article, else surge and dive over sliding windows
    of the lines' lengths."""
    marked = [x[0] for x in lines if x[2] and x[0]]
    if marked:
        return marked
    at = [k for k, x in enumerate(lines) if x[0]]  # lines with text
    size = [x[1] if 2 * x[1] >= len(x[0]) else 0 for x in lines]
    window = [sum(size[i:i + width]) for i in range(len(lines))]
    top = max(window, default=0)
    if not top:
        return []

    def holds(a: int, b: int) -> bool:  # the container of line a has line b, the page only its own lines
        c, d = lines[a][3], lines[b][3]
        return c == d or 0 < c <= d <= last[c]

    runs: list[list[int]] = []  # first and last place in ``at``
    for k, i in enumerate(at):
        if window[i]:
            if runs and runs[-1][1] == k - 1 and all(window[at[k - 1]:i]):
                runs[-1][1] = k
            else:
                runs.append([k, k])
    joined: list[list[int]] = []
    for n, (i, j) in enumerate(runs):
        floor = joined[-1][1] if joined else -1
        while i - 1 > floor and holds(at[i], at[i - 1]):
            i -= 1
        end = runs[n + 1][0] if n + 1 < len(runs) else len(at)
        while j + 1 < end and holds(at[j], at[j + 1]):
            j += 1
        if joined and i == floor + 1 and _same(lines[at[floor]][3], lines[at[i]][3], last):
            joined[-1][1] = j
        else:
            joined.append([i, j])
    need = min(surge, top / 2)
    return [lines[at[k]][0] for i, j in joined if max(window[at[i]:at[j] + 1]) >= need for k in range(i, j + 1)]


def _same(c: int, d: int, last: list[int]) -> bool:
    """One container is the other or holds it."""
    return c <= d <= last[c] or d <= c <= last[d]


def main_text(page: str | None) -> str:
    return "\n\n".join(kept_lines(*page_lines(page))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, col):
            texts = [main_text(x) for x in b.column(col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in b.schema.names), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())],
                names=[*b.schema.names, "text", "n_chars"])


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points); columns of ``pages``
    with these names are replaced."""
    prepare(pages.sparkSession)
    src = pages.drop("text", "n_chars")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(lambda it: _extract(it, html), f"{schema}, text string, n_chars long").drop(html)
