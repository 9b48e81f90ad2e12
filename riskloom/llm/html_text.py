"""HTML main-text extraction by tag-path ratios.

A page becomes blocks of text, each with its root-to-leaf path of block elements
(element name and class). Per path, text length, punctuation and link text are
aggregated; the length and punctuation ratios of a path are fused and smoothed with
those of everything under each of its ancestors, the nearer the more; a path through a
marked article (article, main) counts ``MARK`` times. Paths that reach a share of the
best path hold the main text. They select the content node: the deepest element path
that holds nearly all of their text (or, from a section, list, table or quotation, the
element around it; from inside a marked article, the article). Every block in the
content node is the article's, short lists, tables and captions too; outside a marked
article, paths below the share that are mostly link text go, headings stay. Paths through elements that never hold the
article (menus, footers, adverts, forms, comments, scripts) are out from the start.
Every page is judged alone: no shuffle, and memory is bounded by one page.

Class, id and role words (HINTS) tell menus, adverts, comments and the like from the
article, but not alone: they say nothing on an element that holds the page's largest
article or most of its text, nor in a negated token (no-comments, has-sidebar). On
headings ids and mixed tokens (related-work) do not count. On sections and paragraphs
inside the article they are evidence: a mixed token drops a part that is mostly link
text, an id of hint words only a part whose ratio is below the share of the best.
Reader comments are told by structure: any container (section, div, list, article) whose
token holds a comment word is out, also inside the article.

Blocks keep page order and are joined by a line feed; character references are
decoded and white space inside a block becomes one space.

Defined results: null, empty and text-less pages give an empty text; broken or cut
markup is read as far as it goes (an unfinished tag at the end is no text); rows
with null or repeated ids are read like any other; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, slices

#: Share of the best path's score that a path must reach.
THRESHOLD = 0.5
#: Weight of an ancestor in the smoothing, against the step below it.
PARENT = 0.6
#: How much more a path through a marked article counts.
MARK = 3.0
#: Share of the main paths' text that the content node holds.
MOST = 0.9
SLICE_BYTES = 8 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attr2>[^>]*+)>"
    r"|</?[a-zA-Z][^>]*\Z", re.S)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HINT = re.compile(r"[a-z]+")
RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 header footer nav aside ul ol li dl dt dd table "
    "thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary "
    "dialog center hgroup menu search legend".split())
#: Elements that never hold the article's text.
BOILERPLATE = frozenset("head nav footer aside form button select label input menu dialog search".split())
#: Class, id or role words of page parts that are not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice "
    "notification menu nav navbar navigation navigator sidebar rail comment comments disqus reply replies footer "
    "contentinfo complementary breadcrumb breadcrumbs share sharing social related recommended promo promotion "
    "newsletter subscribe subscription popup modal overlay widget toolbar pagination pager login signup "
    "search".split())
#: Words that make a class, id or role token tell of a part that is absent or elsewhere.
NEGATIONS = frozenset("no non not without has have with".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of containers that hold reader comments.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Words that with a comment word still say nothing but comments.
COMMENT_PARTS = COMMENTS | frozenset(
    "list section area thread threads wrap wrapper container box form title block body item author text content user "
    "users reader readers tree nav children depth".split())
CONTAINERS = frozenset("section div article ol ul dl li aside main details table".split())
#: Elements that are parts of an article rather than its container.
INNER = frozenset("section ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure details p "
                  "h1 h2 h3 h4 h5 h6 hgroup address".split())
_P_CLOSERS = BLOCK - {"html", "head", "body"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table body html article section div".split())


def hinted(tag: str, tokens: list[tuple[str, list[str]]], inside: bool) -> str:
    """What (kind of attribute, words) tokens say of an element: "comment" (reader comments,
    whatever they hold), "hard" (not the article), "score" or "links" (evidence that the ratio or the share of link text decides), or ""."""
    says = ""
    for kind, words in tokens:
        if not NEGATIONS.isdisjoint(words):
            continue
        if tag in CONTAINERS and not COMMENTS.isdisjoint(words):
            if (COMMENTS if tag in ("article", "main") else COMMENT_PARTS).issuperset(words):
                return "comment"
        if tag in ("article", "main") or HINTS.isdisjoint(words):
            continue
        pure = HINTS.issuperset(words)
        if tag in HEADINGS:
            one = "hard" if pure and kind != "id" else ""
        elif tag in ("section", "p") and inside:
            one = ("score" if kind == "id" else "hard") if pure else "links"
        else:
            one = "hard"
        says = max(says, one, key=("", "links", "score", "hard").index)
    return says


def blocks(page: str) -> tuple[list[tuple[tuple[str, ...], bool, str, int, int]], list[str], list[int]]:
    """Blocks of text in page order: (path, out, text, link characters, innermost part).

    Parts are the article, main and hinted elements: the second list has what is known
    of each, the third the part around it; -1 is none.
    """
    found: list = []
    parts: list[str] = []
    around: list[int] = []
    stack: list[tuple[str, str, bool, int]] = []  # element, path step, boilerplate element, innermost part
    # text of the open block; hinted inline elements have text of their own inside it:
    # depth of the stack below, pieces, link characters
    open_: list[list] = [[0, [], 0]]

    def give(depth: int, pieces: list[str], linked: int) -> None:
        clean = " ".join("".join(pieces).split())
        if clean:
            found.append((tuple(s for _, s, *_ in stack[:depth] if s), any(b for _, _, b, _ in stack[:depth]), clean,
                          min(linked, len(clean)), stack[depth - 1][3] if depth else -1))

    def flush() -> None:
        for i, (_, pieces, linked) in enumerate(open_):
            give(open_[i + 1][0] if i + 1 < len(open_) else len(stack), pieces, linked)
            open_[i][1:] = [], 0

    def pop(to: int) -> None:
        if any(tag in BLOCK or bad for tag, _, bad, _ in stack[to:]):
            flush()
        while len(open_) > 1 and open_[-1][0] >= to:
            give(len(stack), *open_.pop()[1:])
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            piece = html.unescape(page[at:m.start() if m else end])
            open_[-1][1].append(piece)
            if any(tag == "a" for tag, *_ in stack):
                open_[-1][2] += len(piece)
        if m is None:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag == "br":
            open_[-1][1].append(" ")
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _P_CLOSERS:  # a block closes an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in _SCOPES:
                    break
        if tag in _SIBLINGS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _SIBLINGS[tag]:
                    pop(i)
                    break
                if stack[i][0] in _SCOPES:
                    break
        words, tokens = [], []
        for kind, *values in _ATTR.findall(m["attr"] or m["attr2"] or ""):
            for token in "".join(values).lower().split():
                tokens.append((kind.lower(), _HINT.findall(token)))
                words += tokens[-1][1]
        inside = any(t in ("article", "main") for t, *_ in stack)
        bad = tag in BOILERPLATE or (tag == "header" and not inside)
        says = "" if tag in ("html", "body") else hinted(tag, tokens, inside)
        if tag in ("article", "main"):
            says = says or tag
        if tag in BLOCK or bad:
            flush()
        elif says:  # inline: the block around it goes on after it
            open_.append([len(stack), [], 0])
        part = stack[-1][3] if stack else -1
        if says:
            around.append(part)
            part = len(parts)
            parts.append(says)
        step = "" if tag not in BLOCK and not bad and not says else tag + "".join("." + w for w in words[:2])
        stack.append((tag, step, bad, part))
    flush()
    return found, parts, around


def _ratio(chars: int, marks: int, linked: int, nodes: int) -> float:
    """Fused ratio of a path: length per node, raised by punctuation, lowered by links."""
    return math.log1p(chars / nodes) * (1 + math.log1p(marks / nodes)) * (1 - linked / max(chars, 1))


def _add(row: list[int], text: str, linked: int) -> None:
    for i, v in enumerate((len(text), sum(map(text.count, ".,;:!?")), linked, 1)):
        row[i] += v


def dropped(found: list, parts: list[str], around: list[int]) -> set[int]:
    """The parts of a page that are not its article by their hints or those around them."""
    sums = [[0, 0, 0, 0] for _ in parts]  # characters, marks, link characters, blocks
    for _, _, text, linked, part in found:
        if part >= 0:
            _add(sums[part], text, linked)
    for k in range(len(parts) - 1, -1, -1):
        if around[k] >= 0:
            sums[around[k]] = [x + y for x, y in zip(sums[around[k]], sums[k], strict=True)]
    total = sum(len(b[2]) for b in found)
    kept = {k for k, row in enumerate(sums) if 2 * row[0] > total and parts[k] != "comment"}
    for tag in ("article", "main"):
        k = max((k for k, says in enumerate(parts) if says == tag), key=lambda k: sums[k][0], default=-1)
        while k >= 0:
            kept.add(k)
            k = around[k]
    out: set[int] = set()
    unsure: set[int] = set()
    for k, says in enumerate(parts):
        if around[k] in out or (k not in kept and (
                says in ("comment", "hard") or (says == "links" and 2 * sums[k][2] > sums[k][0]))):
            out.add(k)
        elif around[k] in unsure or (says == "score" and k not in kept):
            unsure.add(k)
    if unsure:
        paths: dict[tuple, list] = {}
        for path, _, text, linked, part in found:
            if part not in out and part not in unsure:
                _add(paths.setdefault(path, [0, 0, 0, 0]), text, linked)
        best = max((_ratio(*row) for row in paths.values()), default=0.0)
        for k in sorted(unsure):
            if around[k] in out or (parts[k] == "score" and sums[k][3] and _ratio(*sums[k]) < THRESHOLD * best):
                out.add(k)
    return out


def path_scores(found: list) -> dict[tuple, float]:
    """Smoothed ratio of every path of the blocks."""
    totals: dict[tuple, list] = {}
    for path, _, text, linked, _ in found:
        _add(totals.setdefault(path, [0, 0, 0, 0]), text, linked)
    under: dict[tuple, list] = {}
    for path, row in totals.items():
        for d in range(len(path)):
            under[path[:d]] = [x + y for x, y in zip(under.get(path[:d], [0, 0, 0, 0]), row, strict=True)]
    for path, row in totals.items():        # blocks of the path itself are under its ancestors' paths only once
        if path in under:
            under[path] = [x + y for x, y in zip(under[path], row, strict=True)]
    ratios = {path: _ratio(*row) for path, row in under.items()}
    out = {}
    for path, row in totals.items():
        parts = [_ratio(*row), *(ratios[path[:d]] for d in range(len(path) - 1, -1, -1))]
        weights = [PARENT ** i for i in range(len(parts))]
        smooth = sum(map(float.__mul__, weights, parts)) / sum(weights)
        out[path] = smooth * (1.0 if _names(path).isdisjoint(("article", "main")) else MARK)
    return out


def content_node(chars: dict[tuple, int]) -> tuple[str, ...]:
    """The element path that the main paths (with their text lengths) select."""
    under: dict[tuple, int] = {}
    for path, n in chars.items():
        for d in range(len(path)):
            under[path[:d]] = under.get(path[:d], 0) + n
    node = max((p for p, n in under.items() if n >= MOST * sum(chars.values())), key=len, default=())
    marks = [d for d, step in enumerate(node, 1) if _names((step,)) & {"article", "main"}]
    if marks:
        return node[:marks[0]]
    while node and not _names(node[-1:]).isdisjoint(INNER):
        node = node[:-1]
    return node


def main_text(page: str | None) -> str:
    """The article's text of one page."""
    found, parts, around = blocks(page or "")
    found = [b for b in found if not b[1]]
    if parts:
        out = dropped(found, parts, around)
        found = [b for b in found if b[4] not in out]
    if not found:
        return ""
    score = path_scores(found)
    best = max(score.values())
    chars: dict[tuple, int] = {}
    links: dict[tuple, int] = {}
    for path, _, text, linked, _ in found:
        chars[path] = chars.get(path, 0) + len(text)
        links[path] = links.get(path, 0) + linked
    main = {path: n for path, n in chars.items() if score[path] >= THRESHOLD * best}
    node = content_node(main)
    # outside a marked article, links alone are a menu
    sure = {path for path in chars if path in main or 2 * links[path] <= chars[path]
            or not _names(path).isdisjoint(HEADINGS | {"article", "main"})}
    return "\n".join(text for path, _, text, *_ in found if path[:len(node)] == node and path in sure)


def _names(path: tuple[str, ...]) -> set[str]:
    return {step.split(".", 1)[0] for step in path}


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text and n_chars (code points)."""
    ship(pages.sparkSession)
    src = pages.selectExpr(f"`{id_col}` AS page_id", f"`{url_col}` AS url", f"`{html_col}` AS html")
    kind = src.schema["page_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", SLICE_BYTES):
            texts = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
