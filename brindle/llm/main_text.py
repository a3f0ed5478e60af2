"""Main text of web pages by a minimum cut between content and boilerplate.

A page's blocks (runs of text between block-level tags) are nodes. A linear classifier over words, links,
punctuation and the marks of the enclosing elements gives each block a cost of being called boilerplate
or content, the capacity of its edge to the source or the sink. Neighbours on the page and the nearest
blocks of the same parent element are tied by edges that weigh less the farther apart they are in the
document tree. The maximum flow separates the two sides; the source's side is the text.

Defined results: a null or empty page has the empty text; unclosed elements end where their parent does,
a head at the first thing that can't stand in it, a title at the next tag, an unclosed comment, script, style,
textarea or iframe at the page's end; a self-closed svg or math is empty, as is another self-closed element
without an end tag of its own; a broken character reference stays as written;
repeated rows are extracted each; empty input gives no rows; other columns are not read. Pages are
worked on one by one, whole.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brindle.llm.tables import workers_import

# --- fixed values ---------------------------------------------------------------------------------

BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
RAW_TAGS = frozenset("script style textarea iframe title".split())  # without elements inside: skipped up to the end tag
SKIPPED_TAGS = frozenset("noscript template object svg math select button head canvas audio video".split())
HEAD_TAGS = frozenset("base link meta noscript template".split())  # may stand in a head, besides raw ones
FOREIGN_TAGS = frozenset("svg math".split())  # a block tag right inside ends them
ISLAND_TAGS = frozenset("foreignobject annotation-xml".split())  # but not in these
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# a tag that ends an open element of the same group
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset("ul ol dl table menu".split())
TAG_COST = {"article": 3.0, "main": 2.5, "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "dialog": -6.0,
            "fieldset": -4.0, "header": -3.0}
BAD_MARKS = frozenset("""ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie
cookies copyright disclaimer discussion disqus dropdown footer form gdpr hidden login masthead menu modal nav navbar navigation newsletter notice
notices pager pagination paywall popup privacy promo promoted promotion recommended related replies reply respond response responses search share sharing
sidebar sidebars signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets complementary contentinfo alert warning""".split())
GOOD_MARKS = frozenset("article articlebody body content entry main maincontent post posts story text".split())
MODIFIERS = frozenset("has no not with without".split())  # what follows them in a class is said of the element, not its kind
# of these an article may tell, so after a word of GOOD_MARKS they say nothing
TOPICS = frozenset("alert cookie cookies copyright disclaimer login notice notices paywall popup privacy search signup subscribe warning".split())
LAYOUT_WORDS = frozenset("area block body box buttons container content form inner items links list section text unit wrap wrapper".split())
BAD_COST, GOOD_COST = -6.0, 1.5
BAD_WORDS = re.compile(r"©|\b(?:cookies?|copyright|all rights reserved|subscribe|newsletter|sign up|log in|privacy policy|terms of use|advertisement|sponsored)\b", re.I)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_END = tuple(".!?…:;\"'”»)")


@dataclass
class Block:
    text: str
    cost: float  # above 0: better called content
    parent: int
    depth: int


# --- blocks of a page -----------------------------------------------------------------------------

def _mark(token: str) -> float:
    """What one class, id or role says of its element: by the whole of it or its last word, without what a modifier adds."""
    words = [w.lower() for w in _SPLIT.split(token) if w]
    words = words[:next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
    if not words or words[-1] in TOPICS and not GOOD_MARKS.isdisjoint(words[:-1]):
        return 0.0
    if words[-1] in BAD_MARKS or len(words) == 2 and words[0] in BAD_MARKS and words[1] in LAYOUT_WORDS:
        return BAD_COST
    good = words[-1] in GOOD_MARKS or "".join(words) in GOOD_MARKS
    return GOOD_COST if good and BAD_MARKS.isdisjoint(words) else 0.0


def _attributes(written: str) -> list[tuple[str, str]]:
    return [(a[1].lower(), a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(written)] if written and not written.isspace() else []


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value) for name, value in attributes)


def _mark_cost(written: str, tag: str) -> float:
    """Good and bad marks of one element offset each other; a bad one says nothing of an article or main element."""
    attributes = _attributes(written)
    if _hidden(attributes):
        return BAD_COST
    marks = {_mark(token) for name, value in attributes if name in ("class", "id", "role") for token in value.split()}
    if tag in ("article", "main"):
        marks.discard(BAD_COST)
    if BAD_COST in marks:
        return 0.0 if GOOD_COST in marks else BAD_COST
    return GOOD_COST if GOOD_COST in marks else 0.0


def _own_cost(text: str, tag: str, linked: int, marked: float, inside: bool) -> float:
    """The block's own cost; ``inside`` an article or main element links are references, and words say less."""
    words, ended = text.count(" ") + 1, text.endswith(_END)
    cost = min(2.0, 0.5 * words ** 0.5) - 1.0 - (1.0 if inside else 4.0) * linked / len(text)
    cost += 0.8 if ended else 0.0
    cost += {"h1": 1.0, "h2": 0.5, "h3": 0.5, "p": 0.5, "li": -0.5}.get(tag, 0.0)
    # a word of notices needs a second sign: a link, no sentence, the mark of an element around, or where notices stand
    if words < 40 and tag != "h1" and BAD_WORDS.search(text) and (linked or not ended or marked < 0 or not (tag == "p" or inside)):
        cost -= 2.0
    return cost


def blocks_of(page: str) -> list[Block]:
    """The blocks in page order, with the classifier's cost."""
    out: list[Block] = []
    stack = [("", 0.0, 0)]  # (tag, cost of the enclosing marks, number of the element)
    held: list[str] = []
    linked, link, number, at = 0, False, 0, 0

    def flush() -> None:
        nonlocal held, linked
        text = " ".join("".join(held).split())
        if text:
            tag, cost, parent = stack[-1]
            # the element around a paragraph or list item is what its siblings share
            home = stack[-2] if len(stack) > 1 and tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt") else stack[-1]
            inside = any(t in ("article", "main") for t, _, _ in stack)
            out.append(Block(text, cost + _own_cost(text, tag, min(linked, len(text)), cost, inside), home[2], len(stack)))
        held, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if link:
                linked += len(text)

    def leave(place: int) -> None:
        """Ends the elements from this place of the stack on, of which one at least is skipped."""
        nonlocal skipped
        del stack[place:]
        if place <= skipped:
            skipped = 0

    def ended_by(tag: str) -> int:
        """Place of the open element that this tag ends as its sibling; 0: none."""
        ends = CLOSED_BY_SIBLING.get(tag, ())
        for i in range(len(stack) - 1, 0, -1) if ends else ():
            if stack[i][0] in ends:
                return i
            if stack[i][0] in LISTS:
                break
        return 0

    def place_of(tag: str) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)

    size = len(page)
    skipped, has_end = 0, False  # place of the outermost open skipped element, 0: none; whether its end tag follows
    while at < size:
        token = _TOKEN.search(page, at)
        raw = page[at:token.start()] if token else page[at:]
        if skipped and stack[-1][0] == "head" and not raw.isspace() and raw:
            leave(skipped)
        if not skipped:
            add(raw)
        if token is None:
            break
        at = token.end()
        if token[2] is None:  # a comment or a declaration
            continue
        closing, tag, attributes = token[1], token[2].lower(), token[3]
        if tag in RAW_TAGS:
            if not closing and not (attributes.endswith("/") and stack[-1][0] in FOREIGN_TAGS):
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if end is None and tag == "title":
                    end = re.compile(r"(?=</?[a-zA-Z])").search(page, at)
                at = end.end() if end else size
            continue
        if skipped and not closing:  # what ends skipped elements without their end tag
            if stack[-1][0] == "head" and tag not in HEAD_TAGS or tag == "body" and stack[skipped][0] == "head":
                leave(skipped)
            elif tag in ("button", "select") and (i := place_of(tag)) >= skipped:
                leave(i)
            elif tag in BLOCK_TAGS:
                while skipped and stack[-1][0] in FOREIGN_TAGS:
                    leave(len(stack) - 1)
                if skipped and not has_end and (stack[skipped - 1][0] == "p" or 0 < ended_by(tag) < skipped):
                    leave(skipped)
        if tag in SKIPPED_TAGS and not closing:
            after = re.compile(rf"<(/?){tag}\b", re.I).search(page, at)
            own_end = after is not None and after[1] == "/"
            if attributes.endswith("/") and (tag in FOREIGN_TAGS or not own_end) or tag == "noscript" and stack[-1][0] == "head" and not own_end:
                continue
            if tag == "head":
                flush()
            stack.append((tag, stack[-1][1], stack[-1][2]))
            if not skipped:
                skipped, has_end = len(stack) - 1, own_end
            continue
        if skipped:
            if not closing:
                if tag in BLOCK_TAGS and stack[-1][0] == "p":
                    stack.pop()
                if tag in ISLAND_TAGS or tag in BLOCK_TAGS and tag not in VOID_TAGS:
                    stack.append((tag, 0.0, 0))
                continue
            link = link and tag != "a"
            place = place_of(tag) if tag in BLOCK_TAGS or tag in SKIPPED_TAGS or tag in ISLAND_TAGS else 0
            if not place or place >= skipped:
                if place:
                    leave(place)
                continue
            leave(skipped)  # the parent's end
        if tag in SKIPPED_TAGS:
            continue
        if tag not in BLOCK_TAGS:
            if tag == "a":
                link = not closing
            elif tag == "br":
                held.append(" ")
            continue
        flush()
        link = False
        if closing:
            if place := place_of(tag):
                del stack[place:]
            continue
        if stack[-1][0] == "p":
            stack.pop()
        if place := ended_by(tag):
            del stack[place:]
        if tag in VOID_TAGS:
            continue
        number += 1
        cost = TAG_COST.get(tag, 0.0)
        if tag == "header" and any(t in ("article", "main") for t, _, _ in stack):
            cost = 0.0
        stack.append((tag, stack[-1][1] + cost + (_mark_cost(attributes, tag) if tag not in ("html", "body") else 0.0), number))
    if skipped:
        leave(skipped)
    flush()
    return out


# --- the cut --------------------------------------------------------------------------------------

def _ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours on the page, and between successive blocks of one parent."""
    ties, last = [], {}
    for i, b in enumerate(blocks):
        before = last.get(b.parent)
        if before is not None:
            ties.append((before, i, 1.0 if before == i - 1 else 0.7))
        if i and before != i - 1:
            ties.append((i - 1, i, 0.3 / (1 + abs(blocks[i - 1].depth - b.depth))))
        last[b.parent] = i
    return ties


def minimum_cut(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """For every node whether it is on the source's side of a minimum cut, the smallest such side.

    A positive cost is the capacity from the source, a negative one that to the sink; a tie's weight is
    its capacity in both directions. A node with at most two ties is taken out first: the least cut of what hangs on it, for
    either side of its neighbours, is a capacity of theirs and a tie between them, so the minimum stays the same. Blocks of a page
    follow one another inside nested elements, so nearly all go this way, in linear time; the maximum flow decides the rest, and the nodes
    taken out are decided backwards from their neighbours.
    """
    near: list[dict[int, float]] = [{} for _ in costs]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    gain, taken, kept = list(costs), [], [False] * len(costs)
    queue, out = [i for i, n in enumerate(near) if len(n) <= 2], [False] * len(costs)
    while queue:
        x = queue.pop()
        if out[x] or len(near[x]) > 2:
            continue
        out[x] = True
        taken.append((x, gain[x], tuple(near[x].items())))
        around = list(near[x].items())
        for y, _ in around:
            del near[y][x]
        if len(around) == 1:
            (y, w), = around
            # what y's side saves or loses through x
            gain[y] += max(-w, min(w, gain[x]))
        elif around:
            (y, v), (z, w) = around
            least = lambda a, b: min(gain[x] + (v if a else 0.0) + (w if b else 0.0), (0.0 if a else v) + (0.0 if b else w))
            f00, f01, f10, f11 = least(0, 0), least(0, 1), least(1, 0), least(1, 1)
            tie = max(0.0, (f01 + f10 - f00 - f11) / 2)
            gain[y] += f00 - f10 + tie
            gain[z] += f00 - f01 + tie
            if tie > 1e-12:
                near[y][z] = near[y].get(z, 0.0) + tie
                near[z][y] = near[z].get(y, 0.0) + tie
        queue += [y for y, _ in around if len(near[y]) <= 2]
    core = [i for i in range(len(costs)) if not out[i]]
    if core:
        place = {i: n for n, i in enumerate(core)}
        side = _flow([gain[i] for i in core], [(place[i], place[j], w) for i in core for j, w in near[i].items() if i < j])
        for i in core:
            kept[i] = side[place[i]]
    for x, own, around in reversed(taken):
        kept[x] = own + sum(w if kept[y] else -w for y, w in around) > 1e-9
    return kept


def _flow(costs: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Shortest augmenting paths, from nodes that the source still feeds to nodes that still drain."""
    room: list[dict[int, float]] = [{} for _ in costs]
    for a, b, w in ties:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    feed, drain = [max(c, 0.0) for c in costs], [max(-c, 0.0) for c in costs]
    tiny = 1e-9
    while True:
        came = {i: -1 for i, f in enumerate(feed) if f > tiny}
        queue, end = deque(came), -1
        while queue:
            x = queue.popleft()
            if drain[x] > tiny:
                end = x
                break
            for y, c in room[x].items():
                if c > tiny and y not in came:
                    came[y] = x
                    queue.append(y)
        if end < 0:
            return [i in came for i in range(len(costs))]
        path = [end]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        flow = min([drain[end], feed[path[-1]], *(room[b][a] for a, b in zip(path, path[1:]))])
        feed[path[-1]] -= flow
        drain[end] -= flow
        for a, b in zip(path, path[1:]):
            room[b][a] -= flow
            room[a][b] += flow


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    kept = minimum_cut([b.cost for b in blocks], _ties(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, kept) if keep)


# --- Spark ----------------------------------------------------------------------------------------

def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            some = batch.slice(at, 500)
            texts = [main_text(page) for page in some.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars (code points)."""
    workers_import(pages.sparkSession)
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("page"))
    return (rows.mapInArrow(_extract, "id long, url string, text string, n_chars long")
            .select(F.col("id").alias(key), F.col("url").alias(url), "text", "n_chars"))
