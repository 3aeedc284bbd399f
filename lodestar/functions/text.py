"""Text functions: folding and patterns of query text on the driver, spans and stems as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotation marks that fold to plain ones; suffixes of the stemmer with what replaces them; letter
#: groups that sound alike.
QUOTES = {"“": '"', "”": '"', "‘": "'", "’": "'", "`": "'", "«": '"', "»": '"'}
SUFFIXES = (("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("er", ""), ("s", ""), ("tion", ""), ("able", ""))
ALIKE = (("ph", "f"), ("f", "ph"), ("ck", "k"), ("k", "ck"), ("z", "s"), ("s", "z"), ("v", "b"))
BEFORE, AFTER, JOINT = "(?<![a-zA-Z0-9])", "(?![a-zA-Z0-9])", r"[\s\-_./]+"
#: Unicode case folding and white space, as in Python's re.
FLAGS = "(?iU)"


def fold(text: str) -> str:
    return unicodedata.normalize("NFKC", text or "").translate(str.maketrans(QUOTES))


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    return re.findall("[a-zA-Z0-9_]+", strip_accents(fold(text)).lower())


def quote(text: str) -> str:
    return "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in text)


@lru_cache(maxsize=2048)
def word_pattern(text: str, phrase: bool = False) -> str | None:
    """Java pattern of a term or phrase with ASCII word boundaries; None matches nothing."""
    clean = fold(text).strip()
    if not clean:
        return None
    if not phrase and " " not in clean:
        return FLAGS + BEFORE + quote(clean) + AFTER
    parts = tokens(clean)
    return FLAGS + BEFORE + JOINT.join(parts) + AFTER if parts else FLAGS + quote(clean)


@lru_cache(maxsize=2048)
def low_pattern(text: str, phrase: bool = False) -> str | None:
    """The same for text that `low_column` has lowered: no flags, so it is several times as fast. None if the text is not
    plain ASCII."""
    clean = fold(text).strip().lower()
    if not clean.isascii() or not re.search("[a-z0-9]", clean):
        return None
    if not phrase and " " not in clean:
        return BEFORE + quote(clean) + AFTER
    return BEFORE + r"[\p{IsWhite_Space}\-_./]+".join(tokens(clean)) + AFTER


def stem(word: str) -> str:
    w = word.lower()
    if len(w) > 3:
        for suffix, other in SUFFIXES:
            if w.endswith(suffix):
                s = w.removesuffix(suffix) + other
                s = s[:-1] if len(s) >= 4 and s[-1:] == s[-2:-1] else s
                if len(s) >= 3:
                    return s
    return w


def variants(text: str) -> list[str]:
    """Spellings that sound alike, and those with one of a doubled letter left out; in text order."""
    q = fold(text).lower().strip()
    alike = {q.replace(a, b) for a, b in ALIKE if a in q}
    single = {q[:i] + q[i + 1 :] for i in range(len(q) - 1) if q[i] == q[i + 1]}
    return sorted(alike | single)


# ---------------------------------------------------------------- columns


#: Characters outside ASCII that case folding takes for ASCII letters, where lower case does not do it.
_FOLDED = {c: c.upper().lower()[:1] if c.upper().isascii() else c.lower()[:1] for c in ("\u0130", "\u0131", "\u017f")}


def low_column(text: Column) -> Column:
    """Lower case, in which every character that case folding takes for an ASCII letter is that letter."""
    for written, letter in _FOLDED.items():
        text = F.replace(text, F.lit(written), F.lit(letter))
    return F.lower(text)


def plain_struct(fields: Column, names: list[str]) -> Column:
    """The fields of a struct of strings, lower-cased and without accents, of all scripts: compatibility decompositions
    without their combining marks, made in Arrow batches."""

    @F.pandas_udf(", ".join(f"{n} string" for n in names))
    def plain(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.map(lambda t: t if t is None else t.lower() if t.isascii() else strip_accents(t).lower())

    return plain(fields)


# Spans and stems are written as SQL: as columns of nested lambdas they take seconds to put together.


def literal(text: str) -> str:
    """A string in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stem_sql(word: str) -> str:
    """Stem of a lower-cased word."""
    out = word
    for suffix, other in reversed(SUFFIXES):
        cut = f"concat(substr({word}, 1, length({word}) - {len(suffix)}), '{other}')"
        once = f"CASE WHEN length({cut}) >= 4 AND right({cut}, 1) = substr({cut}, length({cut}) - 1, 1) THEN substr({cut}, 1, length({cut}) - 1) ELSE {cut} END"
        out = f"CASE WHEN right({word}, {len(suffix)}) = '{suffix}' AND length({once}) >= 3 THEN {once} ELSE {out} END"
    return f"CASE WHEN length({word}) <= 3 THEN {word} ELSE {out} END"


def stem_words_sql(plain: str, term: str) -> str:
    """Words of a text without accents that have the term's stem, once for each occurrence, but the term itself."""
    return f"filter(regexp_extract_all({plain}, '[a-z0-9_]+', 0), w -> {stem_sql('w')} = {literal(stem(term))} AND w <> {literal(term.lower())})"


def spans_sql(text: str, pattern: str, field: str, term: str, phrase: bool = False, stemmed: bool = False) -> str:
    """All hits of pattern in text, as spans with offsets in code points. Offsets add up from the pieces between hits."""
    hits = f"regexp_extract_all({text}, {pattern}, 0)"
    pairs = f"zip_with({hits}, slice(split({text}, {pattern}, -1), 1, size({hits})), (h, g) -> struct(h AS hit, g AS gap))"
    start = "struct(0 AS at, cast(array() AS array<struct<start:int,end:int,text:string>>) AS out)"
    begin = "s.at + length(p.gap)"
    add = f"struct({begin} + length(p.hit) AS at, array_append(s.out, struct({begin} AS start, {begin} + length(p.hit) AS end, p.hit AS text)) AS out)"
    places = f"aggregate({pairs}, {start}, (s, p) -> {add}, s -> s.out)"
    return (
        f"transform({places}, p -> struct({literal(field)} AS field, {literal(term)} AS term, p.start AS start, p.end AS end, p.text AS text,"
        f" {str(phrase).lower()} AS is_exact_phrase, {str(stemmed).lower()} AS is_stemmed))"
    )


def highlight(text: Column, terms: list[str]) -> Column:
    """HTML-escaped text with each term as a whole word inside mark tags."""
    out = escape_html(text)
    wanted = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if wanted:
        out = F.regexp_replace(out, "(?iU)(?<!\\w)(" + "|".join(quote(t) for t in wanted) + ")(?!\\w)", "<mark>$1</mark>")
    return out


def escape_html(text: Column) -> Column:
    for raw, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text
