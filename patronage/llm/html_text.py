"""Main text of web pages by minimum-cut labelling.

A page is read into blocks (runs of text between block tags) with what stands
around each: the open elements and their marks, the share of link text, its
length. A fixed linear classifier turns that into a cost of calling the block
content and a cost of calling it boilerplate; these are the capacities to the
two terminals. Neighbouring blocks and blocks under the same element are tied by
smoothness edges, heavier the closer they stand in the document tree. The
minimum cut splits the blocks into content and boilerplate. A boilerplate mark on
an element around the page's main text (a form over the whole page, a wrapper
named after the sidebar in it) does not count.

Most blocks are settled before any flow is computed: if a block's terminal
capacity outweighs all its open edges together, every minimum cut leaves it on
that side, and its edges become capacities of its neighbours. What stays open
is cut by augmenting paths.

Pages are independent, so this is one pass without a shuffle. Defined results:
a null or empty page has an empty text; broken markup (open tags, comments,
quotes) is read to the end of the page; repeated rows give repeated results;
other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, slices

# --- reading a page into blocks ---------------------------------------------------

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z_:][-\w:.]*)")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Names of HTML elements by how they are read.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template textarea title iframe noframes noembed xmp".split())
UNSEEN = frozenset("head svg math object select button option optgroup datalist audio video canvas map applet".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
#: Words in class, id and role that speak for one side.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin "
    "login register sidebar aside rail widget widgets related recommended recommendation recommendations share sharing "
    "social comment comments commentlist disqus reply replies respond discussion breadcrumb breadcrumbs menu nav navbar "
    "navigation navigations footer foot masthead topbar toolbar search pagination pager copyright legal skip hidden "
    "contentinfo complementary dialog tooltip outbrain taboola disclaimer privacy".split()
)
CONTENT_WORDS = frozenset("article content entry post story body main text maincontent articlebody prose".split())


class Block:
    __slots__ = ("text", "links", "path", "score")

    def __init__(self, text: str, links: int, path: tuple):
        self.text, self.links, self.path, self.score = text, links, path, 0.0


def _mark(name: str, attributes: str, inside_content: bool) -> int:
    """What an element says about the text inside: 1 content, 2 the page's main
    part, 0 nothing, -1 boilerplate by a form or by one word of a longer name, -2
    boilerplate by the element or a whole name, -3 text that does not show."""
    found = {}
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            if m[5]:
                found.setdefault(m[5].lower(), "")
            else:
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden") == "true":
        return -3
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return -3
    if name in BOILERPLATE_TAGS:
        return -1 if name in ("form", "fieldset") else -2
    if name == "header" and not inside_content:
        return -2
    if name in ("html", "body"):
        return 0
    words: list[str] = []
    whole = False
    for k in ("class", "id", "role", "itemprop"):
        for part in html.unescape(found.get(k, "")).split():
            own = [w.lower() for w in _WORDS.findall(part)]
            # "with-sidebar", "has-ads", "no-comments" speak of what stands beside
            own = own if not own or own[0] not in ("with", "has", "no", "without", "is") else []
            whole = whole or bool(own) and all(w in BOILERPLATE_WORDS for w in own)
            words += own
    bad = any(w in BOILERPLATE_WORDS for w in words)
    good = name in CONTENT_TAGS or any(w in CONTENT_WORDS for w in words)
    if bad:
        return -2 if whole else -1
    if name == "main" or "main" in found.get("role", "").lower().split():
        return 2
    return 1 if good else 0


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; markup, scripts, styles and form controls left out."""
    blocks: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # (name, mark, number of the element)
    parts: list[str] = []
    unseen: list[tuple[str, int]] = []  # open elements whose text does not show, with the depth they are at
    state = {"link": 0, "linked": 0, "number": 0}

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, min(state["linked"], len(text)), tuple(stack)))
            parts.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if text and not unseen:
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3].replace("&", "&amp;"))
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br":
            add(" ")
            continue
        if name in BLOCKS:
            flush()
        if not closing and name in RAW:
            close = re.compile(rf"</{name}\s*+[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "a":
            state["link"] = 0 if closing else 1
            continue
        if name in VOID:
            continue
        if name in UNSEEN:
            if not closing:
                if not attributes.endswith("/"):
                    unseen.append((name, len(stack)))
            elif any(x[0] == name for x in unseen):  # ends what is open inside, too
                while unseen.pop()[0] != name:
                    pass
            continue
        if name == "body" and not closing:
            unseen.clear()  # an open head ends here
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(x[0] in BLOCKS for x in stack[i:]):
                        flush()
                    del stack[i:]
                    unseen[:] = [x for x in unseen if x[1] <= i]
                    break
            if name in BLOCKS:
                state["link"] = 0
            continue
        if name in BLOCKS:
            state["link"] = 0
            if stack and stack[-1][0] == "p":
                stack.pop()
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
                if stack and stack[-1][0] in same:
                    stack.pop()
        mark = _mark(name, attributes, any(x[1] > 0 for x in stack))
        if name in BLOCKS or mark:
            state["number"] += 1
            if mark < 0 and name not in BLOCKS:
                flush()
            stack.append((name, mark, state["number"]))
    flush()
    return blocks


# --- classifier --------------------------------------------------------------------


def score(block: Block) -> float:
    """Cost of boilerplate minus cost of content: above 0 the block looks like content."""
    words = block.text.count(" ") + 1
    names = {x[0] for x in block.path}
    good = any(x[1] > 0 for x in block.path)
    bad = sum(x[1] < 0 for x in block.path)
    s = 6.0 if good else 0.0
    s -= 14.0 * min(bad, 2)
    density = block.links / len(block.text)
    s -= 3.0 * density if density > 0.3 else 0.0
    s += 1.5 if words >= 25 else 0.8 if words >= 12 else 0.0 if words >= 6 else -0.5
    s += 0.5 if block.text[-1] in ".!?:;\"'”»…" else 0.0
    if names & {"h1", "h2", "h3"} or "p" in names:
        s += 0.4
    elif names & {"li", "td", "th"}:
        s -= 0.5
    if block.text.startswith(("©", "(c) ")):
        s -= 3.0
    return s


def smoothness(a: Block, b: Block) -> float:
    """Weight of the edge between blocks next to each other: more the more
    elements they share and the fewer lie between them in the tree."""
    shared = 0
    for x, y in zip(a.path, b.path):
        if x[2] != y[2]:
            break
        shared += 1
    apart = len(a.path) + len(b.path) - 2 * shared
    return 1.2 / (1 + apart)


def without_wrappers(blocks: list[Block]) -> None:
    """Clears the boilerplate mark of elements that hold the page's main text: its
    main part, or most of the running text with the headline, or with no headline
    and no content elsewhere. Hidden elements keep theirs."""
    marked = {x[2]: x[1] for b in blocks for x in b.path if -3 < x[1] < 0}
    if not marked:
        return
    inside, main, headline = dict.fromkeys(marked, 0), set(), set()
    total, free = 0, 0  # running text, and what of it has no boilerplate mark around it
    free_content = free_headline = False
    for b in blocks:
        if any(x[1] == -3 for x in b.path):
            continue
        around = [x[2] for x in b.path if x[1] < 0]
        head = any(x[0] == "h1" for x in b.path)
        last = max((i for i, x in enumerate(b.path) if x[1] == 2 or x[0] == "main"), default=-1)
        main.update(x[2] for x in b.path[: last + 1] if x[1] < 0)
        if head:
            headline.update(around)
            free_headline = free_headline or not around
        if 2 * b.links > len(b.text) or b.text.count(" ") < 11:
            continue
        total += len(b.text)
        for k in around:
            inside[k] += len(b.text)
        if not around:
            free += len(b.text)
            free_content = free_content or any(x[1] > 0 for x in b.path)
    wrappers = set(main)
    for k, mark in marked.items():
        if 2 * inside[k] <= total:
            continue
        alone = not free_headline and not free_content and inside[k] > 2 * free
        if k in headline or alone or mark == -1 and not free:
            wrappers.add(k)
    if wrappers:
        for b in blocks:
            b.path = tuple((x[0], 0, x[2]) if x[2] in wrappers else x for x in b.path)


# --- minimum cut ---------------------------------------------------------------------


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise the sum of -gain over the True
    ones (gain below 0: its loss) plus the weights of edges between unlike
    labels. Ties go to the source side only where the gain is positive."""
    n = len(gain)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    gain = list(gain)
    label: list[bool | None] = [None] * n
    ties = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:  # settled by capacity alone
        i = todo.popleft()
        if label[i] is not None or abs(gain[i]) < ties[i] + 1e-12 and ties[i] > 1e-12:
            continue
        label[i] = gain[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                gain[j] += w if label[i] else -w
                ties[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        for i, side in zip(rest, _cut_by_flow(rest, gain, near)):
            label[i] = side
    return [bool(x) for x in label]


def _cut_by_flow(rest: list[int], gain: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Max-flow by shortest augmenting paths on the open blocks; the source side
    of the cut is what the source still reaches."""
    place = {b: k for k, b in enumerate(rest)}
    s, t = len(rest), len(rest) + 1
    room: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for b, k in place.items():
        if gain[b] > 0:
            room[s][k], room[k][s] = gain[b], 0.0
        elif gain[b] < 0:
            room[k][t], room[t][k] = -gain[b], 0.0
        for other, w in near[b].items():
            if other in place:
                room[k][place[other]] = w
    while True:
        before = {s: s}
        queue = deque([s])
        while queue and t not in before:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in before:
                    before[v] = u
                    queue.append(v)
        if t not in before:
            return [k in before for k in range(len(rest))]
        path, v = [], t
        while v != s:
            path.append((before[v], v))
            v = before[v]
        flow = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= flow
            room[v][u] = room[v].get(u, 0.0) + flow


def main_text(page: str | None) -> str:
    """The main text of a page: its content blocks in order, one a line."""
    blocks = read_blocks(page or "")
    if not blocks:
        return ""
    without_wrappers(blocks)
    gains = [score(b) for b in blocks]
    edges = [(i, i + 1, smoothness(blocks[i], blocks[i + 1])) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):  # the block before under the same parent, if others stand between
        parent = b.path[-2][2] if len(b.path) > 1 else 0
        j = last.get(parent)
        if j is not None and j < i - 1:
            edges.append((j, i, 0.4))
        last[parent] = i
    keep = minimum_cut(gains, edges)
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    short_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col(f"`{column}`").cast("string").alias("_page"))

    def run(batches):
        for b in slices(batches):
            texts = [main_text(x.as_py()) for x in b.column("_page")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
