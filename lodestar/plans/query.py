"""The query language: text to tokens to a tree, search terms, and filters hoisted from directives.

    query  = any ("OR" any)*        any = one (["AND"] one)*        one = ["NOT" | "-"] item
    item   = [field ":"] word | [field ":"] 'phrase' | "(" query ")"

Operands that are missing are left out; nothing is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from lodestar.functions import text
from lodestar.schema import ITEM_TYPES, MATCH_MODES

FIELD_NAMES = ("title", "meta", "description", "tags", "uploader", "ext", "type", "site", "url", "file_name")


@dataclass(frozen=True)
class Term:
    value: str


@dataclass(frozen=True)
class Phrase:
    value: str


@dataclass(frozen=True)
class Field:
    name: str
    child: Term | Phrase


@dataclass(frozen=True)
class Not:
    child: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Options:
    """Knobs of a search. Ranges are checked."""

    match_mode: str = "EXACT_MATCH"
    title_only: bool = False
    item_types: tuple[str, ...] = ()
    file_extensions: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    language: str | None = None
    date_from: object = None
    date_to: object = None
    duration_min: int | None = None
    duration_max: int | None = None
    max_results: int = 30
    max_pages: int = 3
    timeout_seconds: float = 35.0
    min_score: float = 0.1
    allow_cache: bool = True
    cache_ttl_seconds: float = 3600.0

    def __post_init__(self):
        for name, low, high in (("max_results", 1, 500), ("max_pages", 1, 20), ("timeout_seconds", 1, 120)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        if self.min_score < 0:
            raise ValueError("min_score must not be negative")
        if self.match_mode not in MATCH_MODES:
            raise ValueError(f"unknown match mode {self.match_mode}")
        if not set(self.item_types) <= set(ITEM_TYPES):
            raise ValueError("unknown item type")


@dataclass(frozen=True)
class Query:
    raw: str
    options: Options
    tree: object | None
    terms: tuple[str, ...] = field(default=())
    phrases: tuple[str, ...] = field(default=())

    @property
    def wanted(self) -> tuple[str, ...]:
        """Distinct terms and phrases."""
        return tuple(dict.fromkeys(self.terms + self.phrases))

    def search_terms(self) -> str:
        """What is sent to sources: phrases, then the terms that no phrase has; the raw text if there is neither."""
        covered = {w for p in self.phrases for w in text.tokens(p)}
        rest = [t for t in self.terms if t.lower() not in covered]
        return " ".join([*self.phrases, *rest]).strip() or self.raw.strip()


_PIECE = re.compile(
    r"""(?>(?:(?P<field>%s):\s*)?)
        (?: (?P<paren>[()]) | (?P<quote>["'])(?P<phrase>.*?)(?:(?P=quote)|\Z) | (?P<minus>-)(?=\S) | (?P<word>[^\s()"']+) )""" % "|".join(FIELD_NAMES),
    re.X | re.I | re.S,
)


def lex(query: str) -> list[tuple[str, str, str | None]]:
    """(kind, value, field) of each token."""
    folded, at, out = text.fold(query).strip(), 0, []
    while at < len(folded):
        if folded[at].isspace():
            at += 1
            continue
        m = _PIECE.match(folded, at)
        if m is None:  # a field name with nothing after it
            break
        at = m.end()
        name = m["field"].lower() if m["field"] else None
        if m["paren"] or m["minus"]:
            out.append(("NOT" if m["minus"] else m["paren"], m.group(), None))
        elif m["quote"]:
            out.append(("PHRASE", m["phrase"].strip(), name))
        elif m["word"].upper() in ("AND", "OR", "NOT"):
            out.append((m["word"].upper(), m["word"], None))
        else:
            out.append(("TERM", m["word"].strip(), name))
    return out


def parse_tree(query: str) -> object | None:
    left = lex(query)[::-1]  # the next token is the last

    def ahead() -> str:
        return left[-1][0] if left else ""

    def join(kind, a, b):
        return kind(a, b) if a is not None and b is not None else b if a is None else a

    def query_():
        node = any_()
        while ahead() == "OR":
            left.pop()
            node = join(Or, node, any_())
        return node

    def any_():
        node = one()
        while ahead() not in ("OR", ")", ""):
            if ahead() == "AND":
                left.pop()
            node = join(And, node, one())
        return node

    def one():
        if ahead() != "NOT":
            return item()
        left.pop()
        child = item()
        return Not(child) if child is not None else None

    def item():
        if not left:
            return None
        kind, value, name = left.pop()
        if kind == "(":
            node = query_()
            if ahead() == ")":
                left.pop()
            return node
        if kind not in ("TERM", "PHRASE") or not value:
            return None  # a misplaced operator is skipped
        node = Term(value) if kind == "TERM" else Phrase(value)
        return Field(name, node) if name else node

    return query_()


def positive(node) -> tuple[list[str], list[str]]:
    """Terms and phrases outside NOT; a phrase's words are terms too."""
    match node:
        case Term(value):
            return [value], []
        case Phrase(value):
            return text.tokens(value), [value]
        case Field(_, child):
            return positive(child)
        case And(a, b) | Or(a, b):
            (t1, p1), (t2, p2) = positive(a), positive(b)
            return t1 + t2, p1 + p2
    return [], []


def directives(node) -> list[tuple[str, str]]:
    """(field, value) of each directive outside NOT, below OR as well."""
    match node:
        case Field(name, child):
            return [(name, child.value)]
        case And(a, b) | Or(a, b):
            return directives(a) + directives(b)
    return []


def parse(query: str, options: Options | None = None) -> Query:
    """ext: and type: directives also become filters on all results."""
    options, tree = options or Options(), parse_tree(query)
    extensions, kinds = list(options.file_extensions), list(options.item_types)
    for name, value in directives(tree):
        if name == "ext" and value.lower().lstrip(".") not in extensions:
            extensions.append(value.lower().lstrip("."))
        elif name == "type" and value.strip().upper() in ITEM_TYPES and value.strip().upper() not in kinds:
            kinds.append(value.strip().upper())
    terms, phrases = positive(tree)
    return Query(query, replace(options, file_extensions=tuple(extensions), item_types=tuple(kinds)), tree, tuple(dict.fromkeys(terms)), tuple(dict.fromkeys(phrases)))
