"""Substring deduplication, filter audit and periodic runs, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import filter_audit, queries, runs, substring_dedup
from lodestar.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- substring deduplication


def without_repeats(rows, window):
    """(doc_id, words, removed, text left) in order, one window after the other."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def deduped(docs, **options):
    return sorted((tuple(r) for r in substring_dedup.dedup_substrings(docs, **options).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))


def test_substrings_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    want = without_repeats(sorted((r.doc_id, r.text) for r in docs.collect()), 20)
    assert sum(r[2] for r in want) > 0
    # in one group, and in many groups and blocks
    assert deduped(docs) == want
    assert deduped(docs, group_bytes=40_000) == want


@pytest.mark.parametrize("seed", range(3))
def test_substrings_with_many_repeats(spark, seed):
    r = random.Random(seed)
    rows = [(k * 7 - 50, r.choice([" ", "\t", "\n \x0b"]).join(r.choice("abcé") for _ in range(r.randint(0, 40)))) for k in range(60)]
    shuffled = rows[:]
    r.shuffle(shuffled)
    docs = spark.createDataFrame(shuffled, "doc_id long, text string").repartition(5)
    assert deduped(docs, window=4, group_bytes=300) == without_repeats(rows, 4)


def test_sketch_never_estimates_less(spark, monkeypatch):
    """A sketch of a few counters sends every window to the exact pass; the result is the same."""
    r = random.Random(5)
    rows = [(k, " ".join(r.choice("abcdef") for _ in range(30))) for k in range(40)]
    rows[30:] = [(k, rows[k - 30][1]) for k in range(30, 40)]
    monkeypatch.setattr(substring_dedup, "_mixed", lambda h, seed: h & np.uint64(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert deduped(docs, window=5, group_bytes=500) == without_repeats(rows, 5)


def test_substrings_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = [(2, None, "x"), (3, "", "x"), (1, "a b c d e", None), (4, " a  b c\td e f ", "y"), (5, " a b c", "z"), (7, "a b c d", "1"), (7, "0 a b c d", "2"), (None, "a b c d", "3"), (None, None, "4"), (8, long, ""), (9, "v " + long, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grp string").withColumn("row", F.lit(1)).withColumn("cells", F.lit("c")).withColumn("n_words", F.lit(0))
    order = [(1, rows[2][1]), (2, None), (3, ""), (4, rows[3][1]), (5, rows[4][1]), (7, "0 a b c d"), (7, "a b c d"), (8, long), (9, "v " + long), (None, ""), (None, "a b c d")]
    want = sorted(without_repeats(order, 4), key=lambda r: (r[0] is None, r[0] or 0, r[3], r[1]))
    assert deduped(docs, window=4, group_bytes=1000) == want
    assert deduped(docs.limit(0), window=4) == []


# ---------------------------------------------------------------- filter audit


def audited(rows, labels):
    good, toxic = ({k for k, *v in labels if v[n] == 1 and k is not None} for n in (0, 1))
    lows = {}
    for doc_id, _, text in rows:
        if doc_id is not None:
            lows[text or ""] = min(doc_id, lows.get(text or "", doc_id))
    counted = Counter()
    for doc_id, lang, text in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "".join(
            c for c, x in zip("ABCDE", (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text),
                text in lows and (doc_id is None or doc_id > lows[text])
            )) if x
        )
        counted[lang or "", fails, doc_id in good, doc_id in toxic] += 1
    out, removals = {}, Counter()
    for part in {k[0] for k in counted}:
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order):
                those = [(k[1], n, k[2], k[3]) for k, n in counted.items() if k[0] == part]
                gone = lambda f: bool(set(f) & set(order[:step]))
                removed = [x for x in those if c in x[0] and not gone(x[0])]
                out[part, order, step + 1] = [
                    sum(n for f, n, *_ in those if c not in f and not gone(f)), sum(x[1] for x in removed), sum(n for f, n, *_ in those if c in f and gone(f)), sum(n for f, n, *_ in those if f == c),
                    sum(x[1] for x in removed if x[2]), sum(x[1] for x in removed if x[3]),
                ]
                removals[part, c] += sum(x[1] for x in removed)
    return sorted((*k, *v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def report_of(frame):
    return sorted(tuple(r) for r in frame.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_audit_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "lang", "text").collect()]
    labels = [tuple(r) for r in table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").collect()]
    assert report_of(queries.QUERIES["op12_filter_audit"](spark, sf_dir)) == audited(rows, labels)


def odd_rows():
    long = " ".join(f"w{i}" for i in range(2000))
    texts = [None, "", " \n", "A B c", "A B c", "x" * 300, "x" * 299 + "y", "x" * 300, long + "1", long + "2", long + "2", "a " * 400, " ".join(f"w{i}" for i in range(199)), " ".join(f"w{i}" for i in range(200)), "\x1c".join("ab" * 200), "50 % off", "É" * 10, "É" * 10 + "AB"]
    rows = [(k, [None, "", "en"][k % 3], t) for k, t in enumerate(texts)]
    return rows + [(3, "en", "A B c"), (3, "en", "other"), (None, "en", "A B c"), (None, None, None), (None, "fr", "only here"), (None, "fr", "only here")]


def test_audit_of_odd_rows(spark):
    rows, labels = odd_rows(), [(k, k % 2, int(k % 3 == 0)) for k in range(20)] + [(3, 0, 1), (None, 1, 1), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("mask", F.lit("m")).withColumn("part", F.lit(1)).withColumn("__class", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert report_of(filter_audit.audit(docs.repartition(3), known)) == audited(rows, labels)
    assert report_of(filter_audit.audit(docs.limit(0), known)) == []


def test_copies_are_compared_in_full(spark):
    """With hashes that collide, classes hold several texts; the texts decide."""
    rows = [(k, t or "") for k, _, t in odd_rows()]
    docs = spark.createDataFrame(rows, "id long, text string")
    lows = {t: min((k for k, x in rows if x == t and k is not None), default=None) for _, t in rows}
    want = Counter((k, t) for k, t in rows if lows[t] is not None and (k is None or k > lows[t]))
    for weak in (F.xxhash64, lambda *cols: F.xxhash64(*cols) % 2, lambda *cols: F.lit(0)):
        assert Counter(tuple(r) for r in filter_audit.copies(docs, "text", "id", ["id", "text"], weak).collect()) == want


# ---------------------------------------------------------------- periodic runs


def all_runs(words, least=6, exponent=4):
    """Stretches with every period, extended as far as they go, and of each stretch the smallest period."""
    found = {}
    for p in range(1, len(words)):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = max(i + 1, j)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(doc_id, text, made_periodic):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if made_periodic and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = all_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_made_sequences(least, exponent):
    r = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(r.randint(1, 5)):
            n, k, words = r.randint(0, 70), r.choice([1, 2, 3, 6]), []
            while len(words) < n:
                words += [r.randint(0, k) for _ in range(r.randint(1, 5))] * r.randint(1, 6)
            docs.append(r.choice([words, words * 2, words + words[3:] + words[:9]]))
        offsets = np.cumsum([0] + [len(d) for d in docs])
        assert runs.find_runs(np.array([x for d in docs for x in d], np.int64), offsets, least, exponent) == [all_runs(d, least, exponent) for d in docs]


def test_long_runs():
    one, two = np.zeros(50_000, np.int64), np.arange(60_000) % 7
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 4000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert runs.find_runs(np.concatenate([one, two]), np.array([0, 50_000, 110_000])) == [[(0, 50_000, 1)], [(0, 60_000, 7)]]
    word = np.array(fibonacci[1])
    found = runs.find_runs(word, np.array([0, len(word)]), 2, 2)[0]
    assert found == all_runs(fibonacci[1], 2, 2) and len(found) > 2000


def test_runs_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 4000]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r in short:
        assert got[r.doc_id] == collapsed(r.doc_id, r.text, True)


def test_runs_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b " * 9), (3, "x " * 6), (3, "x " * 5), (4, "   \t \n" * 3), (5, "a b c " * 400 + "d"), (6, "p q p q p q p q r r r r r r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_runs", F.lit("n")).withColumn("runs", F.lit(1))
    found = runs.collapse_runs(docs)
    assert Counter(tuple(r)[:8] for r in found.collect()) == Counter(collapsed(k, t, False) for k, t in rows)
    assert {r.doc_id: (r.runs, r.collapsed) for r in found.where("doc_id = 6").collect()} == {6: ([[0, 8, 2], [8, 6, 1]], "p q r")}
    assert runs.collapse_runs(docs.limit(0)).count() == 0
