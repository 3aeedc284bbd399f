import re
import random

import pytest

from lodestar.functions import text
from lodestar.plans.query import And, Field, Not, Options, Or, Phrase, Term, lex, parse, parse_tree


@pytest.mark.parametrize("query,tree", [
    ("a b", And(Term("a"), Term("b"))), ("a OR b c", Or(Term("a"), And(Term("b"), Term("c")))), ("(a or b) and c", And(Or(Term("a"), Term("b")), Term("c"))), ("-a b", And(Not(Term("a")), Term("b"))),
    ("title:x", Field("title", Term("x"))), ('TAGS: "x y"', Field("tags", Phrase("x y"))), ("“x y”", Phrase("x y")), ("categories:x", Term("categories:x")),
    ("don't panic", And(Term("don"), Phrase("t panic"))), ("title:(a b)", And(Term("a"), Term("b"))), ("-ext:zip", Not(Field("ext", Term("zip")))), ("NOT NOT x", Term("x")), ("a AND OR b", And(Term("a"), Term("b"))),
    ("OR a AND", Term("a")), ("a ) b", Term("a")), ("- a", And(Term("-"), Term("a"))), ("", None), ("title:", None), ('""', None), ("((a", Term("a")), ('"a b', Phrase("a b")),
])
def test_trees(query, tree):
    assert parse_tree(query) == tree


def test_nothing_is_an_error():
    rng = random.Random(1)
    for _ in range(3000):
        q = "".join(rng.choices("ab \"'()-:ORANDNOTtitle ", k=rng.randrange(25)))
        parse(q)
        assert all(kind in ("TERM", "PHRASE", "NOT", "AND", "OR", "(", ")") for kind, _, _ in lex(q))


def test_terms_filters_and_search_text():
    q = parse('"deep learning" deep ext:.ISO -ext:zip (x OR type:video)', Options(file_extensions=("pdf",)))
    assert q.phrases == ("deep learning",) and q.terms == ("deep", "learning", ".ISO", "x", "video")
    assert q.options.file_extensions == ("pdf", "iso") and q.options.item_types == ("VIDEO",)
    assert q.search_terms() == "deep learning .ISO x video"
    assert parse("type:nonsense").options.item_types == ()
    assert parse("-a").search_terms() == "-a"


@pytest.mark.parametrize("bad", [dict(max_results=0), dict(max_results=501), dict(max_pages=21), dict(timeout_seconds=0), dict(min_score=-1), dict(match_mode="X"), dict(item_types=("X",))])
def test_option_ranges(bad):
    with pytest.raises(ValueError):
        Options(**bad)


@pytest.mark.parametrize("word,stem", [("running", "run"), ("cats", "cat"), ("ponies", "pony"), ("runner", "run"), ("is", "is"), ("stations", "station"), ("readable", "read"), ("ring", "ring"), ("boxes", "box")])
def test_stems(word, stem):
    assert text.stem(word) == stem


def test_variants():
    assert "fish" in text.variants("phish") and "runing" in text.variants("running") and text.variants("") == []


def python_pattern(java):
    return re.compile(java.replace(text.FLAGS, ""), re.I) if java else None


def test_word_patterns():
    hit = lambda q, s, phrase=False: bool(python_pattern(text.word_pattern(q, phrase)).search(s))
    assert hit("cat", "a Cat.") and hit("cat", "my_cat_x") and not hit("cat", "category bobcat") and hit("caf", "café") and hit("c++", "in c++ now")
    assert hit("deep learning", "Deep_-learning") and not hit("deep learning", "learning deep") and hit("a.b", "x a.b y") and hit("!?", "what!?", True)
    assert text.word_pattern("  ") is None


def test_accents_of_all_scripts(spark):
    """Every assigned code point decomposes as the Unicode tables say."""
    import unicodedata

    from pyspark.sql import functions as F

    from lodestar.functions import text

    chars = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    chunks = ["|".join(f"a{c}b" for c in chars[k : k + 500]) for k in range(0, len(chars), 500)]
    rows = spark.createDataFrame(list(enumerate(chunks)), "k int, t string")
    got = rows.select("k", text.plain_struct(F.struct("t"), ["t"])["t"].alias("p")).collect()
    for r in got:
        want = "".join(c for c in unicodedata.normalize("NFKD", chunks[r.k]) if not unicodedata.combining(c)).lower()
        assert r.p == want


def test_lowered_patterns_are_those_that_fold(spark):
    """A plain term is found in lowered text exactly where the folding pattern finds it."""
    from pyspark.sql import functions as F

    from lodestar.functions import text

    odd = [chr(c) for c in range(1, 0x3000) if chr(c).lower() != chr(c) or chr(c).upper() != chr(c) or chr(c).isspace()]
    texts = [t for c in odd for t in (f"{c}sk", f"sk{c}", f"s{c}k", f"{c}k i", f"ki{c}ss", f"{c}iss", f"a{c}k")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for term, phrase in (("sk", False), ("kiss", False), ("k", False), ("i", False), ("s k", True), ("sk i", True)):
        low, full = text.low_pattern(term, phrase), text.word_pattern(term, phrase)
        wrong = rows.where(text.low_column(F.col("t")).rlike(low) != F.col("t").rlike(full)).collect()
        assert not wrong, (term, [hex(ord(c)) for r in wrong[:5] for c in r.t])
