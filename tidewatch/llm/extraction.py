"""Main-text extraction from web pages by minimum cut.

A page becomes a row of text blocks. A classifier gives each block a cost for either
label: its log-odds of being content become the capacity to the source (content) or to
the sink (boilerplate). Blocks that are neighbours on the page or in the element tree are
joined by smoothness edges. The minimum cut of that graph is the labelling of least cost.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:"[^"]*"|'[^']*'|[^'">])*+>|</?[a-zA-Z][^>]*>|[^<]+|<""", re.S
)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

TARGET = re.compile(r"\shref\s*=", re.I)

# fixed values: element names by their meaning in HTML
SKIPPED = frozenset("head script style noscript template svg iframe object canvas textarea select button".split())
RAW = frozenset("script style noscript template iframe textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mspace mstyle semantics annotation".split()
)
# fixed values: what may stand inside a sentence, shown or not; and what a head may hold
PHRASING = INLINE | frozenset("script style noscript template svg canvas object iframe button select".split())
HEAD_PARTS = frozenset("title meta link style script base noscript template".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GROUPS = frozenset("ul ol dl table".split())
# fixed values: words in class names, ids and roles
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie "
    "cookies consent copyright disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification pagination popup promo promoted recommended related replies respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
CONTENT_NAMES = frozenset("article articlebody content entry main post story".split())
# fixed values: parts of compound names that speak of something else, as in `has-sidebar`
MODIFIERS = frozenset("has no not with without is show hide hidden layout page body wrap wrapper".split())
# fixed values: words that keep their meaning in compounds, and what is written together with them
PLAIN = frozenset("comment comments footer sidebar breadcrumb breadcrumbs navbar newsletter cookie disqus respond".split())
JOINED = frozenset("list area section thread box block bar links container wrap wrapper inner outer form main".split())
NEGATIONS = frozenset("has no not with without is show hide hidden layout page body".split())
CLOSERS = {name: re.compile("</" + name, re.I | re.A) for name in RAW}

CONTAINER = 600  # log-odds, in hundredths, of a container that tells content
AGAINST = 400  # against, of one that tells boilerplate; prose of 128 words outweighs it
HINT = 250  # against, of a compound name with a word of boilerplate
NEXT, NEAR = 80, 60  # smoothness of neighbours on the page, and of those with one parent
TITLE = 80  # and of a heading with what follows it


@dataclass
class Block:
    parent: int
    container: int  # CONTAINER, -AGAINST, -HINT or 0; the number of the telling element until all are read
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    group: int = 0  # number of the outermost list or table around it, 0 without


HEADER = 1  # what a plain header says depends on where it is


def _evidence(name: str, tag: str) -> int:
    """What an element says by itself about the text in it: CONTAINER, -AGAINST, -HINT, HEADER or 0."""
    if name in BOILERPLATE_TAGS:
        return -AGAINST
    names = {n for found in NAMES.findall(tag) for n in "".join(found).lower().split()}
    content, hint = name in CONTENT_TAGS, False
    for whole in names:
        if whole in BOILERPLATE_NAMES and name not in ("body", "html"):
            if not (name in CONTENT_TAGS or name == "header" and whole == "header"):
                return -AGAINST
        words = set(re.split(r"[^a-z]+", whole)) - {""}
        for word in [w for w in words if w not in BOILERPLATE_NAMES]:  # as in `commentlist`
            words |= {p for p in PLAIN if word.startswith(p) and word[len(p) :] in JOINED}
        if words & PLAIN and not words & (NEGATIONS | CONTENT_NAMES) and name not in ("body", "html", *CONTENT_TAGS):
            return -AGAINST
        content |= bool(words & CONTENT_NAMES) and not words & (BOILERPLATE_NAMES | MODIFIERS)
        content |= whole in CONTENT_NAMES
        hint |= bool(words & BOILERPLATE_NAMES) and whole not in BOILERPLATE_NAMES and not words & (CONTENT_NAMES | MODIFIERS)
    if name == "header":
        return HEADER
    if content:
        return CONTAINER
    return -HINT if hint and name not in ("body", "html") else 0


def _settle(blocks: list[Block], told: list[tuple[int, int]]) -> None:
    """Sets each block's container from `told`, the elements that tell: evidence and next one outside.

    The innermost that tells counts, and an article inside comments or a sidebar is still
    boilerplate, unless that holds most of the page's text and no content element is
    outside of it: then it is only a wrapper. Without any content element, one around
    nine tenths of the text is a wrapper.
    """
    words = [0] * len(told)
    for block in blocks:
        words[block.container] += len("".join(block.parts).split())
    articles = [int(evidence == CONTAINER) for evidence, _ in told]
    for i in range(len(told) - 1, 0, -1):
        words[told[i][1]] += words[i]
        articles[told[i][1]] += articles[i]
    says = [0] * len(told)
    for i in range(1, len(told)):
        evidence, outer = told[i]
        inherited = says[outer]
        if evidence < 0:
            most = 2 * words[i] > words[0] if articles[0] else 10 * words[i] >= 9 * words[0]
            says[i] = inherited if most and articles[i] == articles[0] else min(evidence, inherited)
        elif evidence == HEADER:
            says[i] = inherited if inherited > 0 else -AGAINST
        else:
            says[i] = inherited if inherited <= -AGAINST else evidence
    for block in blocks:
        block.container = says[block.container]


def blocks_of(page: str) -> list[Block]:
    """The text blocks in page order, without scripts, styles and markup."""
    # name, innermost element that tells, number of the block-level element, whether it is a link
    stack: list[tuple[str, int, int, bool]] = []
    blocks: list[Block] = []
    current: Block | None = None
    told = [(0, 0)]
    elements, links, skipped = 0, 0, 0
    at, end = 0, len(page)
    while at < end:
        token = TOKEN.match(page, at)
        at = token.end()
        piece = token.group()
        if piece[0] != "<" or piece == "<":
            if skipped:
                continue
            if current is None:
                if not piece.strip():
                    continue
                current = Block(stack[-1][2] if stack else 0, stack[-1][1] if stack else 0)
                current.heading = any(s[0] in HEADINGS for s in stack)
                current.group = next((s[2] for s in stack if s[0] in GROUPS), 0)
                blocks.append(current)
            current.parts.append(piece)
            if links:
                current.linked += len(piece.split())
            continue
        named = TAG.match(piece)
        if not named:
            continue
        name = named.group(1).lower()
        if piece[1] == "/":
            if any(s[0] == name for s in stack):
                while True:
                    gone, *_, linked = stack.pop()
                    skipped -= gone in SKIPPED
                    links -= linked
                    if gone == name:
                        break
            if name not in PHRASING:
                current = None
            continue
        if name == "br":
            if current is not None:
                current.parts.append(" ")
            continue
        # the head ends where something begins that it cannot hold, a link where the next begins
        ended = "head" if name not in HEAD_PARTS and name not in ("head", "html") else ""
        if ended and any(s[0] == ended for s in stack):
            while True:
                gone, *_, linked = stack.pop()
                skipped -= gone in SKIPPED
                links -= linked
                if gone == ended:
                    break
        if name == "a":
            for i, (other, inherited, parent, linked) in enumerate(stack):
                if other == "a" and linked:
                    stack[i], links = (other, inherited, parent, False), links - 1
        if name not in PHRASING:
            current = None
            while stack and stack[-1][0] in SELF_CLOSING.get(name, ()):
                stack.pop()
        if name in VOID or piece.endswith("/>") and name in SKIPPED:
            continue
        if name in RAW:
            close = CLOSERS[name].search(page, at)
            at = close.start() if close else end
        if name not in INLINE:
            elements += 1
        inherited = stack[-1][1] if stack else 0
        parent = elements if name not in INLINE else (stack[-1][2] if stack else 0)
        evidence = _evidence(name, piece)
        if evidence:
            told.append((evidence, inherited))
            inherited = len(told) - 1
        # an anchor without a target is no link
        linked = name == "a" and bool(TARGET.search(piece))
        stack.append((name, inherited, parent, linked))
        skipped += name in SKIPPED
        links += linked
    _settle(blocks, told)
    return blocks


def log_odds(block: Block, text: str, words: int | None = None) -> int:
    """Log-odds, in hundredths, that a block is content: its container, length (`words`, where
    it counts with others), links and sentence marks."""
    words = len(text.split()) if words is None else words
    odds = block.container - 150
    odds += 60 * min(words, 255).bit_length()
    odds -= 500 * block.linked // max(1, words)
    odds += 100 if re.search(r"[.!?:;…]['\"”»)]?$", text) else 0
    return odds


def minimum_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source's side of the minimum cut.

    A node with positive cost is tied to the source, one with negative cost to the sink.
    Nodes whose own tie is at least as strong as all their edges are settled first, which
    adds to the ties of their neighbours; augmenting paths settle the rest.
    """
    ties = list(costs)
    near: list[dict[int, int]] = [{} for _ in costs]
    for a, b, weight in edges:
        near[a][b] = near[a].get(b, 0) + weight
        near[b][a] = near[b].get(a, 0) + weight
    label: list[bool | None] = [None] * len(costs)
    waiting = deque(range(len(costs)))
    while waiting:
        i = waiting.popleft()
        if label[i] is None and abs(ties[i]) >= sum(near[i].values()):
            label[i] = ties[i] > 0
            for j, weight in near[i].items():
                del near[j][i]
                ties[j] += weight if label[i] else -weight
                waiting.append(j)
            near[i] = {}
    source, sink = -1, -2
    graph: dict[int, dict[int, int]] = {source: {}, sink: {}}
    for i, settled in enumerate(label):
        if settled is None:
            graph[i] = dict(near[i])
    for i in list(graph):
        if i >= 0:
            side, other = (source, i) if ties[i] > 0 else (i, sink)
            graph[side][other] = abs(ties[i])
            graph[other].setdefault(side, 0)
    while True:
        before = {source: source}
        queue = deque([source])
        while queue and sink not in before:
            a = queue.popleft()
            for b, room in graph[a].items():
                if room > 0 and b not in before:
                    before[b] = a
                    queue.append(b)
        if sink not in before:
            break
        path = [sink]
        while path[-1] != source:
            path.append(before[path[-1]])
        path.reverse()
        flow = min(graph[a][b] for a, b in zip(path, path[1:]))
        for a, b in zip(path, path[1:]):
            graph[a][b] -= flow
            graph[b][a] = graph[b].get(a, 0) + flow
    return [i in before if settled is None else settled for i, settled in enumerate(label)]


def main_text(page: str | None) -> str:
    """The content blocks of a page, one to a line; empty without any."""
    blocks, texts = [], []
    for block in blocks_of(page or ""):
        text = " ".join(html.unescape("".join(block.parts)).split())
        if text:
            blocks.append(block)
            texts.append(text)
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i and blocks[i - 1].container == block.container:
            edges.append((i - 1, i, NEXT + (TITLE if blocks[i - 1].heading and not block.heading else 0)))
        if block.parent in last:
            edges.append((last[block.parent], i, NEAR))
        last[block.parent] = i
    # without a content element, the items of a list and the cells of a table count together
    grouped, linked = Counter(), Counter()
    for b, t in zip(blocks, texts):
        grouped[b.group] += len(t.split())
        linked[b.group] += b.linked
    alone = any(b.container > 0 for b in blocks)
    sizes = [None if alone or not b.group or b.container or linked[b.group] else grouped[b.group] for b in blocks]
    labels = minimum_cut([log_odds(b, t, n) for b, t, n in zip(blocks, texts, sizes)], edges)
    if not any(labels):  # a short page is its text, unless that is links or boilerplate
        labels = [b.container >= 0 and 2 * b.linked <= len(t.split()) for b, t in zip(blocks, texts)]
    return "\n".join(t for t, content in zip(texts, labels) if content)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Null html gives an empty text; null ids and urls are passed on; repeated rows give
    repeated results; other columns are not read.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.record_batch(
                {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())}
            )

    read = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return read.mapInArrow(extracted, "page_id bigint, url string, text string").withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
