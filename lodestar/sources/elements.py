"""Elements of pages and selectors over them.

One Python pass makes of each page its text and a table of elements, each with its tag, attributes, parent, last element
inside it, and stretch of the text. Selectors are compiled to expressions over that table, so nested markup, which patterns
over the source cannot follow, costs nothing more. Cards are cut out in that pass already: an expression over a page's whole
table would look at it once for every card. A selector is a list, divided by commas, of compounds that stand inside
each other (a space) or directly below each other (>); a compound is a tag or *, #id, .class and [name], [name=value] with
=, ^=, $= or *=."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lodestar.schema import placed

ELEMENT = "struct<tag:string,attrs:map<string,string>,parent:int,last:int,start:int,stop:int>"
ELEMENTS = f"struct<text:string,nodes:array<{ELEMENT}>>"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSHOWN = ("script", "style", "template")
#: Tags that end an open one of the same list, unless one of the stops lies between.
_CLOSES = {"li": ("li",), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_STOPS = ("ul", "ol", "dl", "table", "div", "section", "article", "select")


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.text: list[str] = []
        self.size = 0

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES:
            for k in range(len(self.open) - 1, -1, -1):
                name = self.nodes[self.open[k]][0]
                if name in _CLOSES[tag]:
                    self.shut(k)
                elif name in _STOPS:
                    break
        self.nodes.append([tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1] if self.open else -1, len(self.nodes), self.size, self.size])
        if tag not in _VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.shut(len(self.open) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]][0] == tag:
                self.shut(k)
                return

    def shut(self, k):
        for at in self.open[k:]:
            self.nodes[at][3], self.nodes[at][5] = len(self.nodes) - 1, self.size
        del self.open[k:]

    def handle_data(self, data):
        if not self.open or self.nodes[self.open[-1]][0] not in _UNSHOWN:
            self.text.append(data)
            self.size += len(data)


def read(source: str | None) -> dict:
    """Text and elements of one page. A page that the parser gives up on keeps what was read before."""
    table = _Table()
    try:
        table.feed(source or "")
        table.close()
    except AssertionError:  # a declaration that does not end
        pass
    table.shut(0)
    return {"text": "".join(table.text), "nodes": _named(table.nodes)}


def _named(nodes: list) -> list[dict]:
    names = ("tag", "attrs", "parent", "last", "start", "stop")
    return [dict(zip(names, (n[0], list(n[1].items()), *n[2:]))) for n in nodes]


class _Cards(_Table):
    """Only the elements that chains name and that lie in no other such one, each a table of its own. What is outside them
    is forgotten when it closes, so a page of any number of cards is read once and holds one card at a time."""

    def __init__(self, chains: list[list[Compound]]):
        super().__init__()
        self.chains, self.head, self.found = chains, None, []

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        at = len(self.nodes) - 1
        if self.head is None and any(_stands(self.nodes, chain, at) for chain in self.chains):
            self.head, self.nodes[at][4:] = at, [0, 0]
        if tag in _VOID and self.head in (None, at):
            self.forget()

    def shut(self, k):
        over = self.head is None or self.head in self.open[k:]
        super().shut(k)
        if over:
            self.forget()

    def forget(self):
        """Outside a card only the open elements stay."""
        if self.head is not None:
            own = [(*n[:2], n[2] - self.head if place else -1, n[3] - self.head, *n[4:]) for place, n in enumerate(self.nodes[self.head :])]
            self.found.append({"text": "".join(self.text), "nodes": _named(own)})
        self.head, self.text, self.size = None, [], 0
        del self.nodes[self.open[-1] + 1 if self.open else 0 :]

    def handle_data(self, data):
        if self.head is not None:
            super().handle_data(data)


def _stands(nodes: list[list], chain: list[Compound], at: int) -> bool:
    """Does a chain name the element at a place? As find, over the elements as they are read."""
    if not chain[-1].holds(nodes[at]):
        return False
    before, up = chain[:-1], nodes[at][2]
    while before and up >= 0:
        if _stands(nodes, before, up):
            return True
        up = -1 if chain[-1].child else nodes[up][2]
    return not before


#: Characters of a page that are read at a time.
_PIECE = 1 << 20


def read_cards(source: str | None, chains: list[list[Compound]]) -> Iterator[dict]:
    """Tables of the cards of one page, in page order, as they end."""
    table = _Cards(chains)
    try:
        for at in range(0, len(source or ""), _PIECE):
            table.feed(source[at : at + _PIECE])
            yield from table.found
            table.found = []
        table.close()
    except AssertionError:  # a declaration that does not end
        pass
    table.shut(0)
    yield from table.found


def with_elements(pages: DataFrame, html: str, name: str = "page") -> DataFrame:
    """pages with a column of their elements in the place of html."""
    rest = [c for c in pages.columns if c != html]
    schema = StructType(pages.select(*rest).schema.fields + StructType.fromDDL(f"{name} {ELEMENTS}").fields)
    kind = to_arrow_type(schema[name].dataType)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = pa.array([read(h) for h in part.column(html).to_pylist()], type=kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), made], names=[*rest, name])

    return pages.select(*rest, html).mapInArrow(run, schema)


# ---------------------------------------------------------------- selectors


@dataclass(frozen=True)
class Compound:
    tag: str
    tests: tuple[tuple[str, str, str], ...]
    #: Stands directly below what is before it.
    child: bool = False

    def fits(self, node: Column) -> Column:
        out = node["tag"] == self.tag if self.tag != "*" else node["tag"].isNotNull()
        for name, sign, value in self.tests:
            has = F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(None).cast("string"))
            out = out & F.coalesce({
                "": lambda h: h.isNotNull(), "=": lambda h: h == value, "^=": lambda h: h.startswith(value), "$=": lambda h: h.endswith(value), "*=": lambda h: h.contains(value),
                "~=": lambda h: F.concat(F.lit(" "), F.regexp_replace(h, r"\s+", " "), F.lit(" ")).contains(f" {value} "),
            }[sign](has), F.lit(False))
        return out

    def holds(self, node: list) -> bool:
        """The same of an element as it is read: its tag and attributes."""
        attrs = node[1]
        return self.tag in ("*", node[0]) and all(name in attrs and {
            "": lambda h, v: True, "=": str.__eq__, "^=": str.startswith, "$=": str.endswith, "*=": str.__contains__,
            "~=": lambda h, v: f" {v} " in " " + re.sub(r"\s+", " ", h, flags=re.ASCII) + " ",
        }[sign](attrs[name], value) for name, sign, value in self.tests)


_PART = re.compile(r"""\s*(?P<child>>)?\s*(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<tests>(?:[.#][\w-]+|\[[^\]]*\])*)""")
_TEST = re.compile(r"""([.#])([\w-]+)|\[\s*([\w:-]+)\s*(?:([\^$*~]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]]*)))?\s*\]""")


def parse_selector(selector: str) -> list[list[Compound]]:
    out = []
    for one in re.split(r""",(?![^\[]*\])""", selector):
        at, one, chain = 0, one.strip(), []
        while at < len(one):
            m = _PART.match(one, at)
            if m is None or m.end() == at or not (m["tag"] or m["tests"]):
                raise ValueError(f"not a selector: {selector}")
            tests = []
            for mark, word, name, sign, *values in _TEST.findall(m["tests"]):
                tests.append(({".": "class", "#": "id"}[mark], {".": "~=", "#": "="}[mark], word) if mark else (name.lower(), sign, next((v for v in values if v), "")))
            chain.append(Compound((m["tag"] or "*").lower(), tuple(tests), bool(m["child"])))
            at = m.end()
        if not chain:
            raise ValueError(f"not a selector: {selector}")
        out.append(chain)
    return out


def find(nodes: Column, selector: str) -> Column:
    """Places of the elements that a selector names, in page order."""
    chains = parse_selector(selector)

    def above(chain: list[Compound], i: Column) -> Column:
        """Does what the compounds before the last one name stand above element i?"""
        if len(chain) < 2:
            return F.lit(True)
        before = chain[:-1]
        if chain[-1].child:
            up = nodes[i]["parent"]
            return F.when(up >= 0, before[-1].fits(F.get(nodes, up)) & above(before, up)).otherwise(False)
        return F.exists(F.sequence(F.lit(0), i), lambda j: (j < i) & (F.get(nodes, j)["last"] >= i) & before[-1].fits(F.get(nodes, j)) & above(before, j))

    def named(i: Column) -> Column:
        out = None
        for chain in chains:
            one = F.when(chain[-1].fits(F.get(nodes, i)), above(chain, i)).otherwise(False)
            out = one if out is None else out | one
        return out

    every = F.when(F.size(nodes) > 0, F.sequence(F.lit(0), F.size(nodes) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(every, named)


class Element:
    """Columns of the element at the head of a table of elements, and of those inside it."""

    def __init__(self, column: Column):
        self.text_, self.nodes = column["text"], column["nodes"]

    def first(self, selector: str) -> Column:
        """The first element that a selector names (the head itself counts), or null."""
        at = F.get(find(self.nodes, selector), F.lit(0))
        return F.when(at.isNotNull(), F.get(self.nodes, at))

    def attr(self, name: str, selector: str | None = None) -> Column:
        """An attribute, null if it is missing or empty."""
        node = F.get(self.nodes, F.lit(0)) if selector is None else self.first(selector)
        return F.nullif(F.trim(F.try_element_at(node["attrs"], F.lit(name))), F.lit(""))

    def text(self, selector: str | None = None) -> Column:
        """Text with single spaces, null if there is none."""
        node = F.get(self.nodes, F.lit(0)) if selector is None else self.first(selector)
        part = F.substring(self.text_, node["start"] + 1, node["stop"] - node["start"])
        return F.nullif(F.trim(F.regexp_replace(part, r"(?U)\s+", " ")), F.lit(""))


def cards(payloads: DataFrame, selector: str, html: str = "payload") -> DataFrame:
    """A row for each element that a selector names and that lies in no other such one: the columns of payloads, `e` (the
    element's own table) and ord (place of the payload, then of the element)."""
    at, chains = F.col("ord") if "ord" in payloads.columns else F.monotonically_increasing_id(), parse_selector(selector)
    rows = payloads.withColumn("__at", at)
    rest = [c for c in rows.columns if c != html]
    schema = StructType(rows.select(*rest).schema.fields + StructType.fromDDL(f"__pos bigint, e {ELEMENTS}").fields)
    kind = to_arrow_type(schema["e"].dataType)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                found = enumerate(read_cards(batch.column(html)[at].as_py(), chains))
                while some := list(islice(found, 1024)):
                    same = batch.select(rest).slice(at, 1).take(pa.array([0] * len(some)))
                    places, made = zip(*some)
                    yield pa.RecordBatch.from_arrays([*same.columns, pa.array(places, pa.int64()), pa.array(made, kind)], names=[*rest, "__pos", "e"])

    found = rows.select(*rest, html).mapInArrow(run, schema)
    return found.withColumn("ord", placed(F.col("__at"), F.col("__pos"))).drop("__pos", "__at")
