"""A query tree compiled to column expressions over the __text struct: does a row match, and where."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.plans.query import And, Field, Not, Or, Phrase, Query, Term
from lodestar.schema import FIELDS, SPAN

_DOMAIN = re.compile(r"[a-z0-9.-]+\.[a-z]{2,}", re.I)


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


class Compiler:
    def __init__(self, query: Query):
        self.query = query
        only_title = query.options.title_only or query.options.match_mode == "TITLE_ONLY"
        self.fields = ("title", "file_name") if only_title else FIELDS
        self.stems = query.options.match_mode == "SEMANTIC_EXPANSION"

    def _scope(self, name: str | None) -> list[str]:
        if name is None:
            return list(self.fields)
        if name == "meta":
            return [f for f in self.fields if f not in ("title", "file_name")]
        return [name] if name in self.fields else []

    def _leaf(self, node: Term | Phrase, scope: str | None) -> tuple[str | None, list[str], bool]:
        """Pattern, fields, and whether hits are exact phrases."""
        if isinstance(node, Phrase):
            return text.word_pattern(node.value, phrase=True), self._scope(scope), True
        if scope == "site":
            pattern = text.word_pattern(node.value, phrase=True)
            # a host must end where the term ends
            return (pattern + r"(?![.\-\p{Alnum}])" if pattern and "." in node.value else pattern), self._scope("site"), False
        domain = scope is None and bool(_DOMAIN.fullmatch(node.value))
        return text.word_pattern(node.value, phrase=domain), self._scope(scope), False

    def prepared(self, items: DataFrame) -> DataFrame:
        """items (with __text) with what the columns of this compiler read beside it: in stem mode all fields without
        accents, made once."""
        return items.withColumn("__plain", text.plain_struct(F.col("__text"), list(FIELDS))) if self.stems else items

    def _test(self, pattern: str, node: Term | Phrase, content: Column, phrase: bool, scope: str | None) -> Column:
        """Does the pattern occur? Where the term is plain, in lowered text: a plain substring that every hit has is tried
        before the regular expression, which then needs no folding of its own."""
        low = text.low_pattern(node.value, phrase) if scope != "site" else None
        if low is None:
            return content.rlike(pattern)
        folded = text.low_column(content)
        return folded.contains(max(re.findall("[a-z0-9]+", node.value.lower()), key=len)) & folded.rlike(low)

    def matches(self, node, scope: str | None = None) -> Column:
        match node:
            case Term() | Phrase():
                pattern, fields, phrase = self._leaf(node, scope)
                if pattern is None or not fields:
                    return F.lit(False)
                tests = []
                for f in fields:
                    content = F.col(f"__text.{f}")
                    hit = self._test(pattern, node, content, phrase or scope is None and bool(_DOMAIN.fullmatch(node.value)), scope)
                    if self.stems and not phrase and not (scope == "site" and "." in node.value):
                        hit = hit | self._stem_hit(f, node.value)
                    tests.append(hit)
                return reduce(lambda a, b: a | b, tests)
            case Field(name, child):
                return self.matches(child, name)
            case Not(child):
                return ~self.matches(child, scope)
            case And(a, b):
                return self.matches(a, scope) & self.matches(b, scope)
            case Or(a, b):
                return self.matches(a, scope) | self.matches(b, scope)
        return F.lit(False)

    @staticmethod
    def _whole_word(word: str) -> str:
        return f"concat({text.literal(text.FLAGS + text.BEFORE)}, {word}, {text.literal(text.AFTER)})"

    def _stem_hit(self, name: str, term: str) -> Column:
        """A word of the same stem that stands in the field as written."""
        return F.expr(f"exists({text.stem_words_sql(f'__plain.{name}', term)}, w -> regexp_like(__text.{name}, {self._whole_word('w')}))")

    def _stem_spans(self, name: str, term: str) -> str:
        """Hits of each word of the stem, for each of its occurrences."""
        return f"flatten(transform({text.stem_words_sql(f'__plain.{name}', term)}, w -> {text.spans_sql(f'__text.{name}', self._whole_word('w'), name, term, stemmed=True)}))"

    def _leaf_spans(self, node: Term | Phrase, scope: str | None) -> Column:
        pattern, fields, phrase = self._leaf(node, scope)
        if pattern is None or not fields:
            return _no_spans()
        none, out = f"cast(array() AS array<{SPAN}>)", []
        for f in fields:
            content, written = f"__text.{f}", text.literal(pattern)
            other = self._stem_spans(f, node.value) if self.stems and not phrase and not (scope == "site" and "." in node.value) else none
            out.append(f"CASE WHEN {content} RLIKE {written} THEN {text.spans_sql(content, written, f, node.value, phrase)} ELSE {other} END")
        return F.expr(f"cast(concat({', '.join(out)}) AS array<{SPAN}>)")

    def spans(self, node, scope: str | None = None) -> Column:
        """Spans of the leaves that hold, left to right; none below NOT or a failed AND or OR."""
        match node:
            case Term() | Phrase():
                return self._leaf_spans(node, scope)
            case Field(name, child):
                return self.spans(child, name)
            case And(a, b) | Or(a, b):
                both = F.concat(self.spans(a, scope), self.spans(b, scope))
                return F.when(self.matches(node, scope), both).otherwise(_no_spans())
        return _no_spans()

    def _every_leaf(self) -> list:
        return [Term(t) for t in self.query.terms] + [Phrase(p) for p in self.query.phrases]

    def _enough(self) -> Column:
        """Half of the distinct terms at least, of terms and phrases."""
        groups: dict[str, list] = {}
        for leaf in self._every_leaf():
            groups.setdefault(leaf.value, []).append(self.matches(leaf))
        hits = sum((reduce(lambda a, b: a | b, g).cast("int") for g in groups.values()), F.lit(0))
        return hits >= max(1, -(-len(set(self.query.terms)) // 2))

    def predicate(self) -> Column:
        if self.query.tree is None:
            return reduce(lambda a, b: a | b, [self.matches(x) for x in self._every_leaf()], F.lit(False))
        strict = self.matches(self.query.tree)
        if self.query.options.match_mode == "FLEXIBLE_MATCH" and self.query.terms:
            return strict | self._enough()
        return strict

    def all_spans(self) -> Column:
        loose = F.concat(*[self.spans(x) for x in self._every_leaf()]) if self._every_leaf() else _no_spans()
        if self.query.tree is None:
            return loose
        if self.query.options.match_mode == "FLEXIBLE_MATCH" and self.query.terms:
            return F.when(self.matches(self.query.tree), self.spans(self.query.tree)).otherwise(loose)
        return self.spans(self.query.tree)
