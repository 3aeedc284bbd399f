"""Main text of web pages by consensus of each host's pages.

Every page is read once by a tolerant tokeniser that keeps a stack of open block elements. Its containers are scored:
each block of text counts for its parent, and half for the parent's parent, by its length outside links; elements that
are never main text (menus, headers, footers, sidebars, forms, and those whose class, id or role says advert, notice,
comments or the like) do not count. A name alone proves little, as layout wrappers and page builders use the same words:
a name does not count where it negates the word (has-sidebar), or where the element holds the page's main element, most of
its text together with an article or its first heading, or nearly all of its text; and a page that would have no text is
read without names. Of a table that lays out the page, the cell with nearly all of its text is taken. The best container's path, as tags and classes with digits generalised, is the
page's vote. Votes are added up per host in Spark, and the path with most votes wins. Every page then is read again:
the text of its containers on its host's winning path is its main text, or that of its own best container where it has
none there. So a page with little text, or much of something else, is read as the other pages of its host suggest.

Within a container, character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by a line feed, and nothing else is dropped or cut.

Defined results: null or empty html gives the empty text; a null url, or one without "://", has the empty host, whose
pages vote together; unclosed and stray tags are tolerated, and an element without text of its own (a video, a drawing, a
button) hides nothing unless it is closed within its parent; pages of any length are read whole; repeated rows get equal
results; of paths with equally many votes the last in text order wins; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, spread, text_column
from lodestar.llm.url_filter import host_of

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Fixed values of HTML: elements by how they nest.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that show no text of their own, but hold markup.
_SKIPPED = frozenset("noscript template svg object canvas select button video audio annotation annotation-xml".split())
_BLOCK = frozenset(
    "html head body div section article main nav header footer aside ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset"
    " blockquote p h1 h2 h3 h4 h5 h6 pre figure figcaption address details summary dialog menu center hgroup search label".split()
)
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th caption figcaption blockquote address summary tr thead tbody tfoot".split())
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Of an article's header these hold links, tags and addresses; the rest is its title and lead.
_LISTS = frozenset("ul ol dl menu address details".split())
_SCOPE = frozenset("table ul ol dl div section article main body blockquote td th".split())
_ASIDE_TAGS = frozenset("head nav header footer aside form dialog menu search label".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners promo promotion sponsor sponsored sponsors sidebar sidebars widget widgets"
    " nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar toolbar footer bottombar copyright legal comment comments commentlist"
    " respond reply replies disqus discussion notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations pagination pager skip search searchbox form paywall disclaimer hidden".split()
)
#: Words of which a name is taken at its word, however much text the element holds, unless an article or heading is in it.
_FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense promo promotion sponsor sponsored sponsors comment comments commentlist respond disqus"
    " cookie cookies consent gdpr popup newsletter paywall disclaimer copyright breadcrumb breadcrumbs pagination pager".split()
)
#: Words that say nothing by themselves at the end of a name.
_NEUTRAL = frozenset(
    "wrap wrapper box container area section list block inner outer item items bar panel module row rows column group left right top bottom main"
    " buttons button links link icons icon posts post articles stories slot unit card cards label body holder region zone text title".split()
)
_NEGATIONS = frozenset("has have with no without not hide overflow".split())
#: Page builders call every block a widget.
_BUILDERS = frozenset("elementor siteorigin sow fusion wpb avia".split())
_HEADER_WORDS = frozenset("header masthead banner".split())
_ARTICLE_WORDS = frozenset("article entry post story content title headline".split())
_MOST, _NEARLY_ALL = 0.5, 0.8
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class _Node:
    tag: str
    path: str
    parent: "_Node | None"
    aside: bool
    number: int
    names: frozenset = frozenset()
    apart: bool = False
    score: float = 0.0


@dataclass
class _Skipped:
    """An open element whose text is not shown, and what stood before it."""

    tag: str
    parts: list
    links: int
    blocks: int
    depth: int
    node: _Node
    open: int = 1


@dataclass
class Page:
    """Blocks of a page in order (text, node, length outside links), and its nodes."""

    blocks: list = field(default_factory=list)
    nodes: list = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    return {m.group(1).lower(): (m.group(2) or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _is_aside(tag: str, own: dict[str, str]) -> bool:
    """Whatever it is called."""
    if tag in _ASIDE_TAGS:
        return True
    if not own or tag in ("html", "body"):
        return False
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or own.get("role", "").lower() in _ASIDE_ROLES:
        return True
    if "style" in own and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own["style"], re.I):
        return True
    return tag in ("article", "main") and bool({w.lower() for w in _WORDS.findall(own.get("class", ""))} & {"comment", "comments", "reply", "related", "ad", "advert", "sponsored", "promo"})


def _names(tag: str, own: dict[str, str]) -> frozenset:
    """Words of class and id that speak for an aside."""
    if tag in ("html", "body", "article", "main") or not ("class" in own or "id" in own):
        return frozenset()
    found, every = set(), set()
    for name in f"{own.get('class', '')} {own.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        every.update(words)
        # a name is about its last word that says something: legal-analysis is an analysis, site-legal a legal notice
        last = len(words)
        while last > 1 and words[last - 1] in _NEUTRAL:
            last -= 1
        mine = {w for w in words[last - 1 : last] if w in _ASIDE_WORDS and not _NEGATIONS & set(words[: last - 1])}
        if words and words[0] in _FOREIGN_WORDS | {"related", "recommended"} and set(words[1:]) <= _NEUTRAL | _ARTICLE_WORDS:
            mine.add(words[0])
        if mine and _ARTICLE_WORDS & set(words):
            mine -= _HEADER_WORDS
        found |= mine
    if every & _BUILDERS:
        found -= {"widget", "widgets"}
    return frozenset(found)


def _judge(page: Page, by_name: bool) -> None:
    """Which nodes are aside, and the score of the others."""
    nodes = page.nodes

    def settle(named) -> None:
        for n in nodes[1:]:
            n.apart = n.parent.apart or n.aside or named(n)

    if by_name and any(n.names for n in nodes):
        inside = [0.0] * len(nodes)
        lead = [0] * len(nodes)  # 2: main, 1: article or first heading

        def gather() -> None:
            inside[:] = [0.0] * len(nodes)
            for _, node, worth in page.blocks:
                if not node.apart:
                    inside[node.number] += worth
            for n in reversed(nodes[1:]):
                lead[n.number] = max(lead[n.number], 0 if n.apart else 2 if n.tag == "main" else 1 if n.tag in ("article", "h1") else 0)
                inside[n.parent.number] += inside[n.number]
                lead[n.parent.number] = max(lead[n.parent.number], lead[n.number])

        def holds(n, alone: bool) -> bool:
            share = inside[n.number] / inside[0] if inside[0] else 0.0
            return lead[n.number] == 2 or lead[n.number] == 1 and share > _MOST or alone and share > _NEARLY_ALL

        settle(lambda n: False)
        gather()
        foreign = {n.number for n in nodes if n.names & _FOREIGN_WORDS and not holds(n, False)}
        settle(lambda n: n.number in foreign)
        gather()

        def in_article(n) -> bool:
            node = n.parent
            while node is not None:
                if node.tag in ("article", "main"):
                    return n.names <= _HEADER_WORDS
                node = node.parent
            return False

        layout = {n.number for n in nodes if n.names - _FOREIGN_WORDS and not n.apart and not holds(n, True) and not in_article(n)}
        settle(lambda n: n.number in foreign or n.number in layout)
    else:
        settle(lambda n: False)
    for text, node, worth in page.blocks:
        if not node.apart:
            holder = node.parent if node.tag in _LEAF and node.parent is not None else node
            while holder.tag in _LEAF and holder.parent is not None:
                holder = holder.parent
            holder.score += worth
            if holder.parent is not None:
                holder.parent.score += worth / 2


def _step(tag: str, own: dict[str, str]) -> str:
    classes = sorted(set(re.sub(r"[0-9]+", "#", own.get("class", "")).split()))
    return ".".join([tag, *classes])


def read(source: str, by_name: bool = True) -> Page:
    page = Page()
    root = _Node("", "", None, False, 0)
    page.nodes.append(root)
    stack = [root]
    parts: list[str] = []
    links = 0
    in_link = False
    skipped: _Skipped | None = None

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = stack[-1]
                page.blocks.append((text, node, max(0.0, len(text) - 2.0 * links)))
        links = 0

    def close(k: int) -> None:
        nonlocal skipped
        if skipped is not None and k < skipped.depth:
            reveal()
        flush()
        del stack[k:]

    def reveal() -> None:
        """An element that is skipped has no end tag where it should: what follows its start is text like any other."""
        nonlocal skipped, links
        now, skipped = skipped, None
        if len(page.blocks) == now.blocks:
            parts[:0] = now.parts
            links += now.links
        else:
            text, worth = " ".join(entities.unescape("".join(now.parts)).split()), -2.0 * now.links
            if text and page.blocks[now.blocks][1] is now.node:  # the line goes on behind the start
                more, _, worth_of_more = page.blocks.pop(now.blocks)
                text, worth = f"{text} {more}", worth + worth_of_more - len(more)
            if text:
                page.blocks.insert(now.blocks, (text, now.node, max(0.0, len(text) + worth)))

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            parts.append(source[at:])
            break
        if m.start() > at:
            piece = source[at : m.start()]
            parts.append(piece)
            if in_link:
                links += len(piece)
        at = m.end()
        if m.group(2) is None:
            continue
        tag, ends = m.group(2).lower(), bool(m.group(1))
        if tag in _RAW:
            if not ends and not m.group(3).endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = found.end() if found else size
            parts.append(" ")
            continue
        if tag in _SKIPPED and not m.group(3).endswith("/"):
            if skipped is None and not ends:
                skipped = _Skipped(tag, parts[:], links, len(page.blocks), len(stack), stack[-1])
                parts.clear()
                links = 0
            elif skipped is not None and skipped.tag == tag:
                skipped.open += -1 if ends else 1
                if not skipped.open:
                    # what it held goes
                    del page.blocks[skipped.blocks :], stack[skipped.depth :]
                    parts[:], links = skipped.parts + [" "] * (tag != "svg"), skipped.links
                    skipped = None
            continue
        if tag == "a":
            in_link = not ends
            continue
        if tag in ("br", "hr", "img", "input", "wbr", "source", "embed"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                parts.append(" ")
            continue
        if tag not in _BLOCK:
            continue
        in_link = False
        if ends:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if k:
                close(k)
            else:
                flush()
            continue
        flush()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in _CLOSES.get(tag, ()) or stack[k].tag == "p" and tag != "label" or stack[k].tag in _HEADINGS and tag in _HEADINGS or stack[k].tag == "head" and tag == "body":
                close(k)
            elif stack[k].tag in _SCOPE:
                break
        own = _attributes(m.group(3))
        parent = stack[-1]
        aside = parent.aside or _is_aside(tag, own)
        if tag == "header" and not parent.aside and any(n.tag in ("article", "main") for n in stack):
            aside = False  # an article's own header holds its title
        if parent.tag == "header" and not parent.aside and tag in _LISTS:
            aside = True
        node = _Node(tag, f"{parent.path}/{_step(tag, own)}", parent, aside, len(page.nodes), _names(tag, own))
        page.nodes.append(node)
        stack.append(node)
    if skipped is not None:
        reveal()
    flush()
    _judge(page, by_name)
    return page


def best(page: Page) -> _Node | None:
    """Container of the highest score, the outer of two that are equal."""
    found = max((n for n in page.nodes if not n.apart and n.tag not in _LEAF), key=lambda n: (n.score, -n.number), default=None)
    if found is None or found.score <= 0:
        return None
    # of a table that only lays out the page, the cell that holds nearly all of it
    if found.tag in ("table", "tbody", "tr"):
        cells: dict[int, float] = {}
        by_number = {n.number: n for n in page.nodes}
        whole = 0.0
        for _, node, worth in page.blocks:
            cell = None
            up = node.parent
            while up is not None and up is not found:
                if up.tag in ("td", "th") and cell is None:
                    cell = up
                up = up.parent
            if up is found and not node.apart:
                whole += worth
                if cell is not None:
                    cells[cell.number] = cells.get(cell.number, 0.0) + worth
        top = max(cells, key=lambda k: (cells[k], -k), default=None)
        if top is not None and cells[top] > _NEARLY_ALL * whole:
            return by_number[top]
    # an article or main element around it is the container
    node = found
    while node is not None:
        if node.tag in ("article", "main"):
            found = node
        node = node.parent
    return found


def vote(source: str) -> str | None:
    found = (best(read(source)) or best(read(source, by_name=False))) if source else None
    return found.path if found is not None else None


def extract(source: str, winner: str | None) -> str:
    """Main text by the winning path of the host, or by the page's own best container."""
    if not source:
        return ""
    return _main_text(read(source), winner) or _main_text(read(source, by_name=False), winner)


def _main_text(page: Page, winner: str | None) -> str:
    chosen = {n.number for n in page.nodes if winner is not None and n.path == winner and not n.apart}

    def text(inside: set[int]) -> str:
        kept: dict[int, bool] = {}

        def within(node) -> bool:
            if node is None:
                return False
            if node.number not in kept:
                kept[node.number] = node.number in inside or within(node.parent)
            return kept[node.number]

        return "\n".join(t for t, node, _ in page.blocks if not node.apart and within(node))

    out = text(chosen) if chosen else ""
    if not out:
        own = best(page)
        out = text({own.number}) if own is not None else ""
    return out


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, winner, pages (their number). Votes are added up within a batch, then per host and path, so a host of any size is a few rows."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                votes = Counter()
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    votes[host, vote(source)] += 1
                keys = list(votes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h for h, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"]
                )

    votes = pages.mapInArrow(run, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    top = F.max(F.when(F.col("path").isNotNull(), F.struct("votes", "path")))
    return votes.groupBy("host").agg(top.alias("top"), F.sum("votes").alias("pages")).select("host", F.col("top.path").alias("winner"), "pages")


def main_text(pages: DataFrame, most_hosts: int = 200_000) -> DataFrame:
    """page_id, url, text, n_chars of every row. Winners of at most `most_hosts` hosts are broadcast."""
    rows = pages.select("page_id", "url", host_of(F.col("url").cast("string")).alias("host"), text_column(pages, "html").alias("html"))
    winners = winning_paths(rows.select("host", "html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [extract(h, w) for h, w in zip(part.column("html").to_pylist(), part.column("winner").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string, n_chars long"
    winners = materialise(winners, "winners")
    if winners.count() <= most_hosts:  # one short row for each host: pages stay where they are
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:  # a host of any size is spread over as many tasks as its pages ask for
        left, right = spread(rows, winners, ["host"], "pages", F.monotonically_increasing_id())
        joined = left.join(right, ["host", "__salt"], "left")
    return joined.select("page_id", "url", "html", "winner").mapInArrow(run, schema)
