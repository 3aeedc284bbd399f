"""URL filters: rules indexed by their rarest literal token.

Two kinds of rules. A prefix rule is a host and a path: it fits its host and all subdomains if the URL's path starts
with the rule's; the longest that fits wins. A pattern rule is a text with wildcards: `*` any characters, `^` one
separator or the end, `||` at the start of a host label, `|` the start or the end of the URL; with `@@` in front it is
an exception that allows. Prefix rules go before patterns, exceptions before blocking patterns; a URL that nothing fits
is allowed.

Every rule is compiled to a regular expression and filed under one of the literal tokens (runs of ASCII letters and
digits) that any URL it fits must have: the one that is rarest over all URLs. A URL's own tokens fetch the rules filed
under them, and only those run their regular expressions. The index is a literal hash table in the expression, so
nothing is exploded, joined or shuffled; rule sets of more than BLOCK rules are applied in several such tables.

Defined results: a null URL, or one without "://", has an empty host and path, which no prefix rule fits; URLs of any
length are read whole; repeated rows are kept; an empty table gives an empty result; of equally long prefix rules that
fit, the later in text order wins; other columns are kept, but for those named as the results (host, path, rule, pattern,
verdict), which are replaced.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import free_names

BLOCK = 5_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile("[a-z0-9]+")
_ENTRY = "array<array<struct<token:string,regex:string,kind:int,size:int,text:string,allow:boolean>>>"
_PREFIX, _PATTERN = 0, 1

#: Patterns that apply where the caller gives none.
PATTERNS = ["||doubleclick.net^", "/adserver/", "/wp-login.php", "/cgi-bin/", ".exe|", ".apk|", "@@||archive.org^"]


@dataclass(frozen=True)
class Rule:
    kind: int
    text: str
    regex: str
    allow: bool
    tokens: tuple[str, ...]
    size: int = 0


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text) if text.isascii() else "".join(_quote(c) if c.isascii() else c for c in text)


def prefix_rule(action: str, host: str, path: str) -> Rule:
    regex = "(?s)^(?:[^/]*\\.)?" + _quote(host) + (_quote(path) if path else "(?:/|$)")
    # a token at the end of the path may go on in the URL
    whole = f".{host}/" if not path else f".{host}{path}"
    tokens = [m.group() for m in _TOKEN.finditer(whole.lower()) if m.end() < len(whole)]
    return Rule(_PREFIX, host + path, regex, action == "allow", tuple(tokens), len(host + path))


def pattern_rule(text: str) -> Rule:
    allow, body = text.startswith("@@"), text.removeprefix("@@").lower()
    start, regex = "", ""
    if body.startswith("||"):
        start, regex, body = ".", "^[a-z][a-z0-9+.-]*://(?:[^/?#]*\\.)?", body[2:]
    elif body.startswith("|"):
        start, regex, body = ".", "^", body[1:]
    end = body.endswith("|")
    body = body.removesuffix("|")
    for c in body:
        regex += ".*" if c == "*" else "(?:[^a-z0-9_.%-]|$)" if c == "^" else _quote(c)
    # tokens need a separator on both sides within the pattern
    whole = start + body + ("." if end else "")
    tokens = [m.group() for m in _TOKEN.finditer(whole) if m.start() > 0 and m.end() < len(whole) and whole[m.start() - 1] != "*" and whole[m.end()] != "*"]
    return Rule(_PATTERN, text, "(?s)" + regex + ("$" if end else ""), allow, tuple(tokens))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(url: Column) -> Column:
    lowered = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), F.lit(0)))


def token_counts(urls: DataFrame, column: str, rules: list[Rule]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens; over all URLs, at most one number per token."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    found = urls.select(F.explode(_tokens(F.col(column).cast("string"))).alias("t")).where(F.col("t").isin(wanted)).groupBy("t").count()
    return {r["t"]: r["count"] for r in found.collect()}


def _table(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """A literal hash table token -> rules. Rules without any token are filed under the empty token."""
    buckets = 2 * len(rules) + 1
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    table: list[list[dict]] = [[] for _ in range(buckets)]
    for token, members in filed.items():
        for r in members:
            table[_bucket(token, buckets)].append({"token": token, "regex": r.regex, "kind": r.kind, "size": r.size, "text": r.text, "allow": r.allow})
    return F.from_json(F.lit(json.dumps(table)), _ENTRY), buckets


def _bucket(token: str, buckets: int) -> int:
    h = 0
    for c in token[-8:]:
        h = (h * 31 + ord(c)) % 1_000_003
    return (h + 7 * len(token)) % buckets


def _bucket_column(token: Column, buckets: int) -> Column:
    last = F.substring(token, -8, 8)
    chars = F.filter(F.split(last, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: (a * 31 + F.ascii(c)) % 1_000_003)
    return ((h + 7 * F.length(token)) % buckets + 1).cast("int")


def _candidates(url: Column, tokens: Column, table: Column, buckets: int) -> Column:
    mine = F.transform(tokens, lambda t: F.filter(F.element_at(table, _bucket_column(t, buckets)), lambda e: e["token"] == t))
    return F.flatten(mine)


def url_filter(df: DataFrame, rules: list[Rule], column: str = "url", block: int = BLOCK) -> DataFrame:
    """df with host, path, rule (of the prefix rule that decides, else null), pattern (of the pattern that decides, else
    null) and verdict."""
    counts = token_counts(df, column, rules)
    url = F.col(column).cast("string")
    with_parts = df.withColumns({"host": host_of(url), "path": path_of(url)})
    lowered = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    target = F.concat("host", "path")
    fits = []
    for at in range(0, max(1, len(rules)), block):
        table, buckets = _table(rules[at : at + block], counts)
        own = F.concat(_tokens(url), F.array(F.lit("")))
        found = _candidates(url, own, table, buckets)
        fits.append(F.filter(found, lambda e: F.regexp_like(F.when(e["kind"] == _PREFIX, target).otherwise(lowered), e["regex"])))
    fit, first, other = free_names(df, "__fit", "__best", "__pattern")
    matched = with_parts.withColumn(fit, fits[0] if len(fits) == 1 else F.concat(*fits))
    best = F.array_max(F.transform(F.filter(fit, lambda e: e["kind"] == _PREFIX), lambda e: F.struct(e["size"].alias("size"), e["text"].alias("text"), e["allow"].alias("allow"))))
    pattern = F.array_max(F.transform(F.filter(fit, lambda e: e["kind"] == _PATTERN), lambda e: F.struct(e["allow"].alias("allow"), e["text"].alias("text"))))
    decided = matched.withColumns({first: best, other: pattern})
    allowed = F.coalesce(F.col(f"{first}.allow"), F.col(f"{other}.allow"), F.lit(True))
    return decided.withColumns({
        "rule": F.col(f"{first}.text"),
        "pattern": F.when(F.col(first).isNull(), F.col(f"{other}.text")),
        "verdict": F.when(allowed, "allow").otherwise("block"),
    }).drop(fit, first, other)
