"""Main-text extraction by minimum-cut labelling.

A page is read into blocks of text (block-level tags end a block). A linear classifier
over tag, ancestors, class and id words, link share, length and punctuation gives each
block the cost of being called content and of being called boilerplate; these are its
capacities to the two terminals. Blocks that follow each other, and more so those of
one parent element, are tied by smoothness edges. The minimum cut labels the page.

A mark that names a container as a whole (a tag or role, or a class that is such a word
but for words of layout) condemns what is in it; one that is only part of a longer name weighs
about as much as an article around it and a neighbour, so that the cut decides.

Blocks whose evidence outweighs all their edges have the same label in every minimum
cut and are fixed first. Of the rest, blocks with few neighbours are folded into these one
by one, which keeps the cost of the best labels exactly and takes time in proportion to the
page, as order and parents tie a block to few others; max-flow runs on what cannot be folded.
Of several minimum cuts the one with most content is taken.

Character references are decoded, white space in a block becomes one space, blocks
are joined by one newline. Null or empty pages, and pages without content, give an
empty text; unclosed scripts, styles and comments end with the page, other elements without
text end where they start if they are not closed. Each page is one row; repeated pages give
equal rows. Columns other than the three named are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|style|itemprop|aria-hidden|hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_END = {}

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea svg iframe title select canvas object audio video button head datalist annotation annotation-xml".split())
#: Of these, the ones whose content a reader never sees as markup, closed or not.
OPAQUE = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FORMAT = frozenset("b i em strong u small font sub sup code tt s strike big mark abbr cite q kbd samp var time del ins dfn bdi bdo nobr label".split())
MATH = frozenset("math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mphantom menclose".split())
FORMAT |= MATH
INLINE = FORMAT | {"a", "span"}
#: Start tags that end an open element of the same kind, and where the search for it stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BOILER_WORDS = frozenset("ad ads adv alert alerts announcement announcements discussion dropdown feedback leaderboard outbrain paywall popular rss taboola ticker trending advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond responses search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
MAIN_WORDS = frozenset("article articlebody content entry main post story text".split())
#: Words that also stand in names of parts of an article; in a longer name they are only a hint.
AMBIGUOUS = frozenset("alert alerts announcement announcements banner discussion disclaimer feedback footer header leaderboard login menu notice notices overlay pager pagination popular promotion reply replies respond responses search skip ticker toolbar trending widget widgets".split())
#: Words that say how something is laid out, not what it is.
LAYOUT_WORDS = frozenset("area bar block body bottom box container content group holder inner item items left list main module outer panel right row section site page top unit view wrap wrapper".split())
_NEGATED = ("no-", "has-", "with-", "without-", "hide-", "show-", "no_", "has_", "with_")

ADJACENT, SIBLING = 800, 700
#: An edge between a block with a boilerplate mark above it and one without says little.
MARKED = 100
#: Weights of the classifier, in thousandths of a nat.
BIAS, MAIN, BOILER, PARAGRAPH, HEADING, LINKED, LONG, STOPPED = -300, 5200, -12000, 1500, 1200, -6000, 600, 500
#: Of a mark that is only part of a longer name.
HINTED = -5000
#: Blocks with more neighbours than this are not folded.
_FOLD = 6


def _hint(tag: str, attrs: str) -> tuple[int, bool]:
    """Whether an element marks what is in it as boilerplate (2) or hints at it (1), and whether as the article."""
    bad, good = 2 * (tag in BOILER_TAGS), tag in ("article", "main")
    if attrs:
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "role":
                bad = max(bad, 2 * (value.lower() in BOILER_ROLES))
                good |= value.lower() in ("main", "article")
            elif name == "itemprop":
                good |= value.lower() == "articlebody"
            elif name == "style":
                bad = max(bad, 2 * ("display:none" in value.replace(" ", "").lower()))
            elif name == "hidden":
                bad = max(bad, 2 * (value.lower() != "until-found"))
            elif name == "aria-hidden":
                bad = max(bad, 2 * (value.lower() == "true"))
            else:
                for one in value.split():
                    if not one.lower().startswith(_NEGATED):
                        words = {w.lower() for w in _SPLIT.split(one) if w} | {one.lower()}
                        marks = words & BOILER_WORDS
                        if marks:
                            alone = len(marks) > 1 or one.lower() in marks or words - marks - {one.lower()} <= LAYOUT_WORDS
                            bad = max(bad, 2 if alone or marks - AMBIGUOUS else 1)
                        good |= not MAIN_WORDS.isdisjoint(words)
    return bad, good


def blocks_of(page: str) -> list[tuple]:
    """(text, linked characters, tag, mark of boilerplate above it, article ancestor, parent) of each block with text."""
    out: list[tuple] = []
    # tag, bad, good, number of the element
    stack: list[tuple] = [("", 0, False, 0)]
    parts: list[str] = []
    linked, anchor, made, pos, n = 0, 0, 0, 0, len(page)

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = stack[-1]
                up = stack[-2][3] if len(stack) > 1 else 0
                out.append((text, linked, own[0], own[1], own[2], up))
            parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if anchor:
            linked += len(text.strip())

    while pos < n:
        m = _TAG.search(page, pos)
        if not m:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos : m.start()])
        pos = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6)
        if not closing:
            if tag in RAW:
                if tag not in _END:
                    _END[tag] = re.compile(rf"</{tag}\b[^>]*>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I)
                end = _END[tag].search(page, pos)
                pos = end.end() if end else n if tag in OPAQUE else pos
                if tag != "button":
                    parts.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    parts.append(" " if tag == "br" else "")
                continue
            if tag == "a":
                anchor = 1
            if tag in FORMAT or tag == "a":
                continue
            bad, good = (0, False) if tag in ("html", "body") else _hint(tag, attrs)
            top = stack[-1]
            if tag not in INLINE or bad > top[1]:
                flush()
            if tag not in INLINE:
                anchor = 0
                if top[0] == "p":
                    stack.pop()
                if tag in IMPLIED:
                    same, stop = IMPLIED[tag]
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in stop:
                            break
                        if stack[i][0] in same:
                            del stack[i:]
                            break
            top, made = stack[-1], made + 1
            stack.append((tag, max(top[1], bad), top[2] or good, made))
        elif tag == "a":
            anchor = 0
        elif tag not in FORMAT and tag not in VOID:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE or stack[i][1] != stack[i - 1][1]:
                        flush()
                    del stack[i:]
                    break
            else:
                if tag not in INLINE:
                    flush()
    flush()
    return out


def lean(block: tuple) -> int:
    """Log odds of content against boilerplate, in thousandths."""
    text, linked, tag, bad, good, _ = block
    words = text.count(" ") + 1
    odds = BIAS + MAIN * good + (0, HINTED, BOILER)[bad] + LINKED * min(linked, len(text)) // len(text)
    odds += PARAGRAPH * (tag in ("p", "blockquote", "pre")) + HEADING * (len(tag) == 2 and tag[0] == "h")
    return odds + LONG * min(max(words.bit_length() - 2, 0), 4) + STOPPED * (text[-1] in ".!?…:;\"”»")


def min_cut(leans: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (content: True) of least total cost: ``|lean|`` for a block against its lean, the weight for an edge with two labels. Ties go to content."""
    n = len(leans)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    rest, label = list(leans), [None] * n
    pull = [sum(x.values()) for x in near]
    # Sure to be content even against all neighbours, or sure to be boilerplate with no tie.
    sure = lambda i: rest[i] >= pull[i] if rest[i] > 0 else -rest[i] > pull[i]
    todo = [i for i in range(n) if sure(i)]
    while todo:
        i = todo.pop()
        if label[i] is not None:
            continue
        label[i] = rest[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                rest[j] += w if label[i] else -w
                pull[j] -= w
                if sure(j):
                    todo.append(j)
    free = [i for i in range(n) if label[i] is None]
    links = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in free}
    order = _order(links)
    if order is None:
        _max_flow(rest, links, label)
    else:
        _fold(rest, links, order, label)
    return label


def _order(links: dict[int, dict[int, int]]) -> list[tuple[int, tuple[int, ...]]] | None:
    """Blocks with the neighbours they are folded into, in turn; None if some have too many."""
    near = {i: set(x) for i, x in links.items()}
    by_size: list[list[int]] = [[] for _ in range(_FOLD + 1)]
    for i, x in near.items():
        if len(x) <= _FOLD:
            by_size[len(x)].append(i)
    out, done = [], set()
    while len(out) < len(near):
        size = next((k for k, x in enumerate(by_size) if x), None)
        if size is None:
            return None
        i = by_size[size].pop()
        if i in done or len(near[i]) != size:
            continue
        done.add(i)
        mine = near[i]
        out.append((i, tuple(mine)))
        for j in mine:
            near[j] |= mine
            near[j] -= {i, j}
            if len(near[j]) <= _FOLD:
                by_size[len(near[j])].append(j)
    return out


def _fold(rest: list[int], links: dict[int, dict[int, int]], order: list[tuple[int, tuple[int, ...]]], label: list) -> None:
    """Labels of least cost by folding: a block's costs under each labelling of its neighbours become costs of these."""
    # Tables over some blocks: entry k is the cost where block m of them is content if bit m of k is set.
    held: dict[int, list[tuple[tuple[int, ...], list[int]]]] = {i: [((i,), [max(rest[i], 0), max(-rest[i], 0)])] for i in links}
    for i, x in links.items():
        for j, w in x.items():
            if i < j:
                table = ((i, j), [0, w, w, 0])
                held[i].append(table)
                held[j].append(table)
    chosen = []
    for i, mine in order:
        bit = {j: m for m, j in enumerate(mine)} | {i: len(mine)}
        costs = [0] * (2 << len(mine))
        for own, table in held[i]:
            at = [bit[j] for j in own]
            for k in range(len(costs)):
                costs[k] += table[sum((k >> b & 1) << m for m, b in enumerate(at))]
        half = len(costs) // 2
        keep = [costs[half + k] <= costs[k] for k in range(half)]
        chosen.append((i, mine, keep))
        folded = (mine, [min(costs[k], costs[half + k]) for k in range(half)])
        for own, table in held[i]:
            for j in own:
                if j != i:
                    held[j] = [x for x in held[j] if x[1] is not table]
        for j in mine:
            held[j].append(folded)
    for i, mine, keep in reversed(chosen):
        label[i] = keep[sum(label[j] << m for m, j in enumerate(mine))]


def _max_flow(rest: list[int], links: dict[int, dict[int, int]], label: list) -> None:
    n = len(rest)
    source, sink = n, n + 1
    flow: dict[int, dict[int, int]] = {i: dict(x) for i, x in links.items()}
    flow[source], flow[sink] = {}, {}
    for i in links:
        flow[i][sink] = max(-rest[i], 0)
        flow[sink][i] = 0
        flow[source][i] = max(rest[i], 0)
        flow[i][source] = 0
    while True:
        back = {sink: sink}
        queue = deque([sink])
        while queue and source not in back:
            x = queue.popleft()
            for y in flow[x]:
                if y not in back and flow[y][x] > 0:
                    back[y] = x
                    queue.append(y)
        if source not in back:
            break
        path, x = [], source
        while x != sink:
            path.append((x, back[x]))
            x = back[x]
        w = min(flow[x][y] for x, y in path)
        for x, y in path:
            flow[x][y] -= w
            flow[y][x] = flow[y].get(x, 0) + w
    # What still reaches the sink is boilerplate.
    for i in links:
        label[i] = i not in back


def edges_of(blocks: list[tuple]) -> list[tuple[int, int, int]]:
    """Blocks that follow each other, and those of one parent; little where only one is marked as boilerplate."""
    edges, last = [], {}
    tie = lambda i, j, w: (i, j, w if (blocks[i][3] == 2) == (blocks[j][3] == 2) else MARKED)
    for i, b in enumerate(blocks):
        if i:
            edges.append(tie(i - 1, i, ADJACENT))
        if b[5] in last:
            edges.append(tie(last[b[5]], i, SIBLING))
        last[b[5]] = i
    return edges


def extract(page: str | None) -> str:
    blocks = blocks_of(page or "")
    labels = min_cut([lean(b) for b in blocks], edges_of(blocks))
    return "\n".join(b[0] for b, keep in zip(blocks, labels, strict=True) if keep)


def _extracted(batches):
    for batch in batches:
        texts = [extract(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
