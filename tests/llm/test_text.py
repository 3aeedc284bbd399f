import os
import random
import struct
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from lodestar.llm import decontaminate, html_extract, quality, sentencepiece, svm, toxicity

needs_model = pytest.mark.skipif(not os.path.exists(sentencepiece.MODEL), reason="no model file")


# ---------------------------------------------------------------- linear models


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 * rng.normal(size=120) > 0, 1, -1)
    cost = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    w, b = svm.fit_hinge(svm.DenseRows(x), y, epochs=400, balance=False)
    best = cost(w, b)
    for _ in range(300):
        assert cost(w + rng.normal(size=3) * 0.05, b + rng.normal() * 0.05) >= best - 1e-2


def test_calibration_is_monotone():
    a, c = svm.calibrate(np.array([-2.0, -1, 0, 1, 2]), np.array([-1, -1, 1, 1, 1]))
    p = svm.probability(np.array([-2.0, 0, 2]), a, c)
    assert p[0] < p[1] < p[2]


# ---------------------------------------------------------------- classifiers, held-out accuracy

INSULTS = ["blornak", "veshti", "grumwold"]


def sentence(rng, bad=False):
    words = ["".join(rng.choice("bcdfghjklm") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 15))]
    if bad:
        words[rng.randrange(len(words))] = rng.choice(INSULTS) + rng.choice(["", "er", "as"])
    return " ".join(words) + "."


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        bad = k % 3 == 0
        lines = [sentence(rng) for _ in range(rng.randrange(2, 9))]
        if bad:
            lines[rng.randrange(len(lines))] = sentence(rng, True)
        out.append(("\n".join(lines), int(bad)))
    return out


@pytest.fixture(scope="module")
def tox():
    return toxicity.fit(corpus(450, 1), landmarks=80, negatives=1500)


def test_toxicity_held_out(tox):
    test = corpus(300, 2)
    got = tox.scores([t for t, _ in test]) >= 0.5
    want = np.array([y == 1 for _, y in test])
    assert (got == want).mean() > 0.95


@pytest.mark.parametrize("between", [".", "...", "_-_", " - ", " . ", "*" * 9, " ", ". ", "«"])
def test_signs_between_letters_do_not_hide_a_word(tox, between):
    for word in ("blornak", "blornaker"):
        assert tox.scores([f"bade cuda {word} filo."])[0] >= 0.5
        assert tox.scores([f"bade cuda, {between.join(word)} filo."])[0] >= 0.5


@pytest.mark.parametrize("insult", INSULTS)
def test_one_sign_space_or_letter_inside(tox, insult):
    for at in range(2, len(insult) - 1):
        for inside in ("-", ".", "*", " "):
            assert tox.scores([f"bade cuda {insult[:at]}{inside}{insult[at:]} filo."])[0] >= 0.5, (at, inside)
    assert tox.scores([f"bade cuda {insult[:4]}x{insult[4:]} filo."])[0] >= 0.5
    assert tox.scores(["bade cuda filo."])[0] < 0.5


def test_toxicity_scores_do_not_depend_on_company(tox):
    texts = ["", "  ", "bade cuda", "x" * 300_000, "a b c d", "you blornak", "Éİß 漢字", "...", "\n\n", "i. o. u. bade"] + [t for t, _ in corpus(20, 9)]
    together = tox.scores(texts)
    assert together.tolist() == [tox.scores([t])[0] for t in texts]
    assert together[0] == together[1] < 0.5
    long = "bade cuda filo. " * 200_000 + "you blornak"
    assert tox.scores([long])[0] > 0.5
    assert tox.scores(["you blornak. " * 3])[0] == tox.scores(["you blornak."])[0]


def test_scores_do_not_depend_on_the_vocabularys_room(tox, monkeypatch):
    texts = [t for t, _ in corpus(60, 10)]
    want = tox.scores(texts)
    monkeypatch.setattr(toxicity, "_KEEP", 40)
    monkeypatch.setattr(toxicity, "_TOGETHER", 200)
    assert (tox.scores(texts[::-1])[::-1] == want).all()


def plain_kernel(a, b):
    """Gap-weighted subsequences of two words, one by one."""
    def count(w):
        w, out = f"\x01{w}\x03", defaultdict(float)
        for order in toxicity.ORDERS:
            for places in combinations(range(len(w)), order):
                if places[-1] - places[0] < toxicity.SPAN:
                    out["".join(w[p] for p in places)] += toxicity.DECAY ** (places[-1] - places[0])
        norm = sum(max(0, len(w) - q[-1]) * v * v for q, v in toxicity._OFFSETS) ** 0.5
        return {k: v / norm for k, v in out.items()}
    x, y = count(a), count(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def test_features_give_the_kernel():
    words = ["blornak", "blorxnak", "bade", "aaaa", "no", "漢字かな"]
    row, sub, value = toxicity.features(words)
    full = np.zeros((len(words), toxicity._TABLE), dtype=np.float32)
    full[row, sub] = value
    want = [[plain_kernel(a, b) for b in words] for a in words]
    assert np.allclose(full @ full.T, want, atol=1e-4)


def test_margins_against_brute_force(tox):
    """Highest margin, numbers and shares of a text, from the windows and the words' own features."""
    table = np.zeros(toxicity._TABLE)
    table[tox.subs] = tox.weights

    def worth(word):
        _, sub, value = toxicity.features([toxicity.letters(word)])
        return float(table[sub] @ value) if len(sub) else 0.0

    for text in [t for t, _ in corpus(30, 12)] + ["bade bade cuda. bade bade cuda.", "one b l o r n a k two", "blo rnak", ""]:
        margins, words = [], set()
        for w in toxicity.windows(text):
            total = sum(worth(x) for x in set(w))
            words |= set(w)
            for a, b in zip(w, w[1:]):
                extra = worth(a + b) - max(0, worth(a)) - max(0, worth(b)) if a[:2] in tox.begins else 0
                total += max(0, extra)
                if extra + tox.bias > 0:
                    words.add(a + b + " joined")
            margins.append(total / len(set(w)) ** 0.5 + tox.bias)
        said = sum(w.endswith(" joined") or worth(w) + tox.bias > 0 for w in words)
        plain = sum(not w.endswith(" joined") for w in words)
        hits = sum(m > 0 for m in margins)
        top = [min(max(m, -1.5), 1.5) for m in sorted(margins)[::-1][:3]]
        want = [*top, *[-1.5] * (3 - len(top)), np.log1p(hits), (hits / max(1, len(margins))) ** 0.5, np.log1p(len(margins)), np.log1p(said), (said / max(1, plain)) ** 0.5]
        assert np.allclose(tox.shapes([text])[0], want, atol=1e-3), text


def test_training_without_both_classes():
    assert toxicity.fit([("a b c d", 0)] * 8).scores(["anything", ""]).max() < 1e-9
    assert quality.fit([("a b", 1)] * 8).scores(["anything", ""]).min() > 0.99


def test_quality_held_out():
    rng = random.Random(4)
    def doc(good):
        lines = [sentence(rng) for _ in range(4)]
        if good:
            return " ".join(lines)
        kind = rng.randrange(3)
        words = " ".join(lines).split()
        return " | ".join(words) if kind == 0 else " ".join(w + "###" for w in words) if kind == 1 else " ".join(w for w in words[:6] for _ in range(8))
    train, test = [(doc(k % 4), int(k % 4 > 0)) for k in range(400)], [(doc(k % 4), int(k % 4 > 0)) for k in range(200)]
    model = quality.fit(train)
    got = model.scores([t for t, _ in test]) >= 0.3
    assert (got == np.array([y == 1 for _, y in test])).mean() > 0.95
    assert model.scores([test[0][0], "", "x " * 100_000]).shape == (3,)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_scoring_frames(spark, module, label):
    rows = [(k, t, "z") for k, (t, _) in enumerate(corpus(120, 5))] + [(500, None, None), (501, "", "z"), (None, "bade", "z")]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {label} string")
    labels = spark.createDataFrame([(k, y if label == "toxic" else 1 - y) for k, (_, y) in enumerate(corpus(120, 5))] + [(999, 1), (None, 0), (3, None)], f"doc_id long, {label} int")
    model = module.train(docs, labels, per_class=50)
    out = {r[0]: r[1] for r in module.score(docs, model).collect()}
    assert len(out) == len(rows) and all(0 <= v <= 1 for v in out.values()) and out[500] == out[501]
    assert module.score(docs.limit(0), module.train(docs, labels.limit(0))).count() == 0


# ---------------------------------------------------------------- decontamination


def plain_distance(a, b):
    """Least edits of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(150):
        a, b = "".join(rng.choices("abc", k=rng.randrange(1, 30))), "".join(rng.choices("abc", k=rng.randrange(0, 50)))
        want = plain_distance(a, b)
        codes = [np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) for s in (a, b)]
        assert decontaminate.within(codes[0], codes[1], 1000) == want
        assert decontaminate.within(codes[0], codes[1], want - 1) is None


def passages(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(rng.randrange(18, 45))) for _ in range(n)]


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.05, 0.98), (0.1, 0.95), (0.13, 0.9)])
def test_recall_of_edited_passages(rate, least):
    items = passages(80, 1)
    index = decontaminate.Index(list(enumerate(items)))
    rng = random.Random(2)
    texts, plain = [], passages(80, 7)
    for item, other in zip(items, plain):
        c = list(item)
        for _ in range(int(rate * len(c))):
            p, kind = rng.randrange(len(c)), rng.random()
            c[p : p + 1] = [rng.choice("xyz")] if kind < 0.34 else [c[p], rng.choice("xyz")] if kind < 0.67 else []
        texts.append(other + "\n" + "".join(c).upper() + ", " + other)
    found = index.search(texts)
    assert np.mean([k in f for k, f in enumerate(found)]) >= least
    assert not any(index.search(plain))
    assert all(set(f) <= {k} for k, f in enumerate(found))


@pytest.mark.parametrize("size", [30, 34, 36, 40, 50, 60, 80, 120, 230, 384])
def test_every_passage_within_the_edits_is_found(size):
    """At the most edits allowed, evenly spread or random; texts of other items' words, in company and alone."""
    rng = random.Random(size)
    items = [(i + " " + j)[:size].strip().ljust(size, "q") for i, j in zip(passages(40, size), passages(40, size + 1))]
    items = [(i * 3)[:size - 1].strip().ljust(size, "q") for i in items]
    index = decontaminate.Index(list(enumerate(items)))
    most = int(0.15 * size)
    texts = []
    for k, item in enumerate(items):
        c = list(item)
        places = [int((n + 0.5) * size / most) for n in range(most)] if k % 2 else rng.sample(range(size), most)
        for n, p in enumerate(sorted(places, reverse=True)):
            kind = (n + k // 2) % 3 if k % 4 < 2 else 0
            c[p : p + 1] = [rng.choice("xyz")] if kind == 0 else [c[p], rng.choice("xyz")] if kind == 1 else []
        texts.append(" ".join(passages(3, 100 + k)) + "\n" + "".join(c) + ". " + passages(1, 200 + k)[0])
    found = index.search(texts)
    for k, (text, got) in enumerate(zip(texts, found)):
        plain = decontaminate.normalise(text)
        for i in {k, (k + 1) % len(items), *got}:
            assert got.get(i) == decontaminate.within(decontaminate.normalise(items[i]), plain, most), (k, i)
        assert k in got and index.search([text]) == [got]
    assert decontaminate.Index([(1, items[0])], max_edits=0.3).search(texts[:1])[0][0] == found[0][0]


@pytest.mark.parametrize("size", [3, 6, 7, 13, 14, 19, 20, 27, 29])
def test_short_items_are_found_within_the_edits(size):
    rng = random.Random(size)
    items = [(i[:size - 1].strip() + "qqqqqqqqq")[:size] for i in passages(20, size)]
    index = decontaminate.Index(list(enumerate(items)))
    most = int(0.15 * size)
    texts = []
    for k, item in enumerate(items):
        c = list(item)
        for p in sorted(rng.sample(range(1, size - 1), most), reverse=True):
            kind = rng.randrange(3)
            c[p : p + 1] = ["x"] if kind == 0 else [c[p], "x"] if kind == 1 else []
        texts += [passages(1, k)[0] + ". " + "".join(c) + "? " + passages(1, k + 50)[0], "".join(c), passages(1, k)[0] + "".join(c) + "zzzzzz"]
    for t, (text, got) in enumerate(zip(texts, index.search(texts))):
        words = "".join(map(chr, decontaminate.normalise(text))).split(" ")
        for i in {t // 3, *got}:
            runs = [" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, min(len(words), a + size) + 1)]
            near = [r for r in runs if abs(len(r) - len(items[i])) <= most]
            want = min((global_distance(items[i], r) for r in near), default=99)
            assert got.get(i) == (want if want <= most else None), (text, items[i])
        assert t % 3 == 2 or t // 3 in got


def global_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_decontamination_frames(spark):
    items = passages(5, 1)
    long = " ".join(passages(3, 5))
    rows = [(1, long + " " + items[0]), (2, long), (3, None), (4, ""), (1, long + " " + items[0]), (5, items[1] + " " + items[2]), (6, "say Short thing here"), (7, (long + " ") * 1500 + items[3])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(50, "short thing"), (51, ""), (52, None), (None, items[4]), (0, items[0])], "item_id long, text string")
    for most in (20_000_000, 300):
        got = sorted((r.doc_id, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench, most=most).collect())
        assert got == [(1, 0, 0), (1, 0, 0), (5, 1, 0), (5, 2, 0), (6, 50, 0), (7, 3, 0)]
        assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench, most=most).collect()) == [2, 3, 4]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("rate", [0.0, 0.08, 0.15])
def test_exhaustive_comparison(spark, rate):
    """Every document against every item, lengths from 10 to 400, passages at the start, inside and at the end."""
    rng = random.Random(int(rate * 100))
    words = " ".join(passages(40, 77)).split()
    items = [" ".join(words[rng.randrange(200) :])[: n].strip() for n in (10, 14, 20, 26, 29, 30, 34, 40, 48, 60, 80, 120, 200, 400)]
    texts = []
    for k, item in enumerate(items):
        c = list(item)
        for p in sorted(rng.sample(range(len(c)), int(rate * len(c))), reverse=True):
            c[p : p + 1] = [["z"], [c[p], "z"], []][rng.randrange(3)]
        filler = " ".join(rng.choices(["vov", "wuw", "xyx", "kik"], k=30))
        texts.append([filler + " " + "".join(c), "".join(c) + " " + filler, filler + " " + "".join(c) + " " + filler][k % 3])
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.edits, r.similarity) for r in decontaminate.contaminated(docs, bench).collect()}
    for d, text in enumerate(texts):
        plain = decontaminate.normalise(text)
        for i, item in enumerate(items):
            code = decontaminate.normalise(item)
            if len(code) >= 30:
                want = plain_distance(item.lower(), "".join(map(chr, plain)))
                assert (got[d, i][0] if (d, i) in got else None) == (want if want <= int(0.15 * len(code)) else None), (d, i)
                assert (d, i) not in got or got[d, i][1] == 1 - want / len(code)


def template(n, seed):
    """Items of about 100 characters that share an opening of 48."""
    r = random.Random(seed)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(20_000)]
    prose = lambda size: " ".join(r.choice(words) for _ in range(size // 6 + 1))[:size].strip()
    opening = "which of the following best describes the reason"
    return opening, [(k, f"{opening} {prose(52)}") for k in range(n)], prose


def test_shared_openings_cost_little():
    """Items from one template: a text that holds the opening alone is compared by counts, not item by item at length."""
    opening, items, prose = template(2000, 5)
    index = decontaminate.Index(items)
    texts = [f"{prose(3000)} {opening} {prose(3000)}" for _ in range(20)]
    began = time.process_time()
    found = index.search([*texts, "see " + items[17][1]])
    assert time.process_time() - began < 1  # 11 s before items were looked at together
    assert not any(found[:20]) and found[20] == {17: 0}
    assert index.compared < 400  # of 40 000 pairs of an item and a place


def test_a_repeated_opening_costs_little():
    opening, items, prose = template(2000, 6)
    index = decontaminate.Index(items)
    began = time.process_time()
    assert index.search([f"{opening} " * 205]) == [{}]
    assert time.process_time() - began < 3 and index.compared < 100  # 167 s before
    filled = " ".join(f"{opening} {prose(60)}" for _ in range(90))
    began = time.process_time()
    assert index.search([filled, filled + " " + items[3][1]]) == [{}, {3: 0}]
    assert time.process_time() - began < 5


def test_openings_lose_nothing():
    """Items of a template against all passages of a text, by exact distance."""
    opening, items, prose = template(40, 7)
    r = random.Random(8)
    for most in (0.15, 0.3):
        index = decontaminate.Index(items, most)
        for k in range(12):
            text = list(f"{prose(300)} {opening} {prose(80)} {items[k][1]} {prose(40)} {opening} {prose(100)}")
            for _ in range(r.randint(0, 60)):
                text[r.randrange(len(text))] = r.choice("etaoin ")
            text = "".join(text)
            codes = decontaminate.normalise(text)
            want = {}
            for n, (_, item) in enumerate(items):
                item = decontaminate.normalise(item)
                edits = decontaminate.within(item, codes, int(most * len(item)))
                if edits is not None:
                    want[n] = edits
            assert index.search([text]) == [want]


def test_repeated_ids_use_their_own_lengths(spark):
    short, long = passages(2, 3)
    long = long + " " + " ".join(passages(8, 4))
    bench = spark.createDataFrame([(1, short), (1, long), (1, short)], "item_id long, text string")
    docs = spark.createDataFrame([(7, long[:40] + "z" + long[41:]), (8, short + "x " + long)], "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.edits, r.similarity) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {7: (1, 1, 1 - 1 / len(long)), 8: (1, 0, 1.0)}


def test_items_without_an_id_count(spark):
    items = passages(3, 1)
    docs = spark.createDataFrame([(1, "see " + items[0]), (2, items[1] + " " + items[0]), (3, passages(1, 8)[0])], "doc_id long, text string")
    bench = spark.createDataFrame([(None, items[0]), (5, items[1]), (None, items[2])], "item_id long, text string")
    for most in (20_000_000, 100):
        got = [tuple(r) for r in decontaminate.contaminated(docs, bench, most=most).select("doc_id", "item_id", "edits").collect()]
        assert sorted(got, key=str) == sorted([(1, None, 0), (2, None, 0), (2, 5, 0)], key=str)
        assert [r.doc_id for r in decontaminate.keep_clean(docs, bench, most=most).collect()] == [3]


# ---------------------------------------------------------------- SentencePiece


@needs_model
def test_encoding_equals_the_library():
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece.MODEL)
    machine = sentencepiece.load()
    rng = random.Random(1)
    letters = "abcdefghe thino  \n\tÀéß漢字🙂▁1234.,'ing—<s>0x"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(800)] + ["", " ", "  ", "a" * 3000, "▁", "\n", "The quick brown fox.", "don't  stop"]
    for t in texts:
        ids = machine.encode(t)
        assert ids == library.encode(t), repr(t)
        assert machine.decode(ids) == t.replace("▁", " ")


def compiled_map(rules):
    """A double-array trie over UTF-8 bytes and its results, built the plain way: each node's children get a free base."""
    trie = {}
    for key in rules:
        node = trie
        for b in key.encode():
            node = node.setdefault(b, {})
        node[0] = key
    results, at = b"", {}
    for key, value in rules.items():
        at[key] = len(results)
        results += value.encode() + b"\0"
    units, used, bases = {}, {0}, set()

    def place(node, here):
        base = 256
        while base in bases or any(base ^ b in used for b in node):
            base += 1
        bases.add(base)
        used.update(base ^ b for b in node)
        offset = here ^ base
        units[here] = units.get(here, 0) | offset << 10 | (0x100 if 0 in node else 0)
        for b, child in node.items():
            if b == 0:
                units[base] = 0x80000000 | at[child]
            else:
                units[base ^ b] = b
                place(child, base ^ b)

    place(trie, 0)
    words = [units.get(k, 0) for k in range(max(units) + 257)]
    return struct.pack("<I", 4 * len(words)) + struct.pack(f"<{len(words)}I", *words) + results


@pytest.mark.parametrize("kind", [1, 2])
def test_character_maps_are_rewritten(kind):
    """The longest entry wins; what has none stays; spaces that the map makes are collapsed and marked."""
    rules = {"ﬁ": "fi", "A": "a", "À": "a", "Àb": "xy", "\u3000": " ", "\t": " ", "\u00ad": "", "Ⅷ": "VIII"}
    assert sentencepiece.read_charsmap(compiled_map(rules)) == rules
    letters = "abcdefghixyVI" + sentencepiece.MARK
    pieces = [("<unk>", 0.0, 2), *((c, -5.0, 1) for c in letters), ("fi", -1.0, 1), ("▁a", -2.0, 1), ("xy", -3.0, 1), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    machine = sentencepiece.Transducer(sentencepiece.ModelFile(pieces, kind=kind, prefix=True, collapse=True, charsmap=compiled_map(rules)))
    for text, want in {"ﬁg": "fig", "Àbc": "xyc", "À b": "a b", "A\u3000\tB": "a B", "\u00ad": "", "Ⅷ\u00ad!": "VIII!", " é ": "é", "": ""}.items():
        assert machine.normaliser.plain(text) == want
        assert machine.decode(machine.encode(text)) == want
        assert machine.encode(text) == machine.encode(want)


def merged(machine, line):
    """Repeated merging over the whole line, the best-scored pair first, the leftmost of equals."""
    parts = list(line)
    while True:
        pairs = [(-machine.score[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in machine.score]
        if not pairs:
            return [i for p in parts for i in machine._write(p)]
        _, k = min(pairs)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_pair_paths_equal_repeated_merging():
    rng = random.Random(8)
    for _ in range(15):
        names = {"a", "b", "c", sentencepiece.MARK}
        while len(names) < 20:
            names.add("".join(rng.choices(sorted(names), k=2)))
        order = sorted(names, key=lambda x: (len(x), rng.random()))
        machine = sentencepiece.Transducer(sentencepiece.ModelFile([("<unk>", 0.0, 2), *((p, -float(k), 1) for k, p in enumerate(order))], kind=2, prefix=True, collapse=False))
        for _ in range(40):
            text = "".join(rng.choices("abc ", k=rng.randrange(1, 14)))
            assert machine.encode(text) == merged(machine, sentencepiece.MARK + text.replace(" ", sentencepiece.MARK)), (order, text)


def test_unigram_takes_the_least_weight():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("ab", -1.0, 1), ("▁ab", -4.2, 1), ("c", -1.0, 1), ("bc", -1.5, 1), ("a", -2.0, 1)]
    machine = sentencepiece.Transducer(sentencepiece.ModelFile(pieces, kind=1, prefix=True, collapse=False))
    score = {p: s for p, s, k in pieces if k == 1}

    def best(text):
        if not text:
            return 0.0, []
        return max(((score[text[:n]] + best(text[n:])[0], [text[:n]] + best(text[n:])[1]) for n in range(1, len(text) + 1) if text[:n] in score), default=(-1e9, []))

    for text in ("abc", "ab", "abcab", "cab", "bb"):
        assert machine.encode(text) == [machine.number[p] for p in best("▁" + text)[1]]


@needs_model
def test_encoding_frames(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (4, "long " * 300_000), (None, "é▁x")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    machine = sentencepiece.load()
    encoded = sentencepiece.encode(docs, machine)
    got = encoded.collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got) and len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.text) for r in sentencepiece.decode(encoded, machine).collect()) == sorted((i or 0, (t or "").replace("▁", " ")) for i, t in rows)
    assert sentencepiece.encode(docs.limit(0), machine).count() == 0


# ---------------------------------------------------------------- HTML

PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header class='site'><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div id='cookie-notice'>We use cookies</div><div class='wrap'>"
    "<div class='content post-%d'><h1>Title &amp; more</h1><p>Para one text<script>x='</p>'</script> goes\n on <a href=x>link</a>.<p>Second <b>para<br>graph</b><ul><li>item 1<li>item 2</ul>"
    "<div class='comments'><p>nice post, I very much liked reading all of it</p></div><form><p>sign up now</p></form></div><aside><p>side</p></aside></div><!-- x --><footer>&copy; x</footer></body></html>"
)
TEXT = "Title & more\nPara one text goes on link.\nSecond para graph\nitem 1\nitem 2"


def test_main_text():
    assert html_extract.extract(PAGE % 7, None) == TEXT
    assert html_extract.vote(PAGE % 7) == "/html/body/div.wrap/div.content.post-#"
    assert [html_extract.extract(s, None) for s in ("", "text only", "<div>a</p>b</div>", "<!-- open", "<script>x", "&#65;&bogus;")] == ["", "text only", "a\nb", "", "", "A&bogus;"]
    assert html_extract.extract("<p>" * 20_000 + "x", None) == "x"


ARTICLE = "<h1>Title</h1><p>First paragraph of the text, with enough words in it.</p><p>Second paragraph of the text.</p>"
ARTICLE_TEXT = "Title\nFirst paragraph of the text, with enough words in it.\nSecond paragraph of the text."


@pytest.mark.parametrize("wrapper", ["content-sidebar-wrap", "site has-sidebar", "no-sidebar content", "with-menu", "widget", "page-form", "share-legal related", "overflow-hidden", "reply-page"])
def test_layout_wrappers_hold_the_article(wrapper):
    side = "<div class='sidebar'><p>Other things to read about</p></div><div class='comments'><p>I liked it</p></div><div class='ad'><p>Buy now</p></div>"
    for inner in (ARTICLE, f"<article>{ARTICLE}</article>", f"<div class='text'>{ARTICLE}</div>"):
        assert html_extract.extract(f"<body><div class='{wrapper}'>{inner}{side}</div></body>", None) == ARTICLE_TEXT
        assert html_extract.extract(f"<body><div id='top-menu'><p>Home</p></div><div class='{wrapper}'>{inner}</div>{side}</body>", None) == ARTICLE_TEXT


def test_names_do_not_cost_text():
    blocks = "".join(f"<div class='elementor-element elementor-widget elementor-widget-text-editor'><p>{t}</p></div>" for t in ("One block of the text.", "Another block of it.", "The third."))
    menu = "<div class='elementor-widget elementor-widget-nav-menu'><p>Home</p></div>"
    assert html_extract.extract(f"<body><div class='elementor'>{menu}{blocks}</div></body>", None) == "One block of the text.\nAnother block of it.\nThe third."
    titled = "<div class='%s'><h1>Title</h1></div><p>First paragraph.</p>"
    assert html_extract.extract(f"<body><div class='box'>{titled % 'article-header'}</div></body>", None) == "Title\nFirst paragraph."
    assert html_extract.extract(f"<body><article>{titled % 'header'}</article></body>", None) == "Title\nFirst paragraph."
    # nothing but names against it
    only = "".join(f"<div class='widget w{k}'><p>Text {k}.</p></div>" for k in range(3))
    assert html_extract.extract(f"<body><div>{only}</div></body>", None) == "Text 0.\nText 1.\nText 2."
    assert html_extract.vote(f"<body><div>{only}</div></body>") == "/body/div"
    # what is foreign stays out, however long
    long = "<div class='comments'><p>%s</p></div><div class='ad'><p>%s</p></div>" % ("very much liked " * 50, "buy " * 300)
    assert html_extract.extract(f"<body><div class='wrap'><p>Short article.</p>{long}</div></body>", None) == "Short article."


def test_pages_follow_the_vote_of_their_host(spark):
    odd = "<html><body><div class='wrap'><div class='content post-9'><p>Short.</p></div></div><div class='teasers'><p>%s</p></div></body></html>" % ("other words " * 20)
    rows = [(k, f"http://h.example.org/{k}", PAGE % k) for k in range(5)] + [(8, "http://h.example.org/8", odd), (9, "http://alone.example.org/", odd), (10, None, None), (11, "no", ""), (0, "http://h.example.org/0", PAGE % 0)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.main_text(pages).collect()}
    assert html_extract.main_text(pages).count() == len(rows)
    assert got[3] == (TEXT, len(TEXT)) and got[8][0] == "Short." and got[9][0].startswith("other words") and got[10] == ("", 0) and got[11] == ("", 0)
    assert html_extract.main_text(pages.limit(0)).count() == 0


BODY = "".join(f"<p>Sentence {k} of the article, with words enough to count as text.</p>" for k in range(4))
BODY_TEXT = "\n".join(f"Sentence {k} of the article, with words enough to count as text." for k in range(4))


@pytest.mark.parametrize("page,want", [
    (f"<article><div class='entry-header'><h1>Title</h1></div>{BODY}</article><footer><p>foot</p></footer>", "Title\n" + BODY_TEXT),
    (f"<article><h1>Title</h1>{BODY}<section class='legal-analysis'><h2>Law</h2><p>What the law says.</p></section></article>", f"Title\n{BODY_TEXT}\nLaw\nWhat the law says."),
    (f"<div class='content social-science'><h1>Title</h1>{BODY}</div><div class='footer'><p>A footer paragraph</p></div>", "Title\n" + BODY_TEXT),
    (f"<div id='menu-wrap'><h1>Title</h1>{BODY}</div>", "Title\n" + BODY_TEXT),
    (f"<div class='wrap'><h1>Title</h1>{BODY}<div class='sponsored-content'><p>Buy this now</p></div><div class='related-posts'><p>More to read</p></div></div>", "Title\n" + BODY_TEXT),
])
def test_names_are_about_their_last_word(page, want):
    assert html_extract.extract(f"<html><body>{page}</body></html>", None) == want


LAYOUTS = [
    "<body><nav><a href='/'>Home</a></nav><div class='post-{n}'>{body}</div><div class='sidebar'><p>Side note</p></div></body>",
    "<body><div id='page'><div class='head'><ul class='menu'><li>Home</li></ul></div><main>{body}</main><footer>Foot</footer></div></body>",
    "<body><table><tr><td class='left'><a href='/a'>One</a><a href='/b'>Two</a></td><td class='text'>{body}</td></tr></table></body>",
    "<body><section class='story s{n}'><header><h2>Kicker</h2></header>{body}<aside><p>Quote</p></aside></section><section class='comments'><p>Nice</p></section></body>",
]


@pytest.mark.parametrize("most", [0, 1000])
def test_hosts_of_differing_layouts(spark, most):
    """Every host has a layout of its own; the winners and texts equal a vote counted one by one."""
    rows = []
    for h in range(12):
        for n in range(1 + h % 5 * 3):
            rows.append((len(rows), f"https://h{h}.example/{n}", LAYOUTS[h % 4].format(n=n, body=BODY.replace("Sentence", f"Host {h} page {n} sentence"))))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    votes = defaultdict(lambda: defaultdict(int))
    for _, url, source in rows:
        votes[url.split("/")[2]][html_extract.vote(source)] += 1
    winners = {h: max((n, p) for p, n in v.items())[1] for h, v in votes.items()}
    got = {r.page_id: r.text for r in html_extract.main_text(pages, most_hosts=most).collect()}
    for k, url, source in rows:
        assert got[k] == html_extract.extract(source, winners[url.split("/")[2]])
        assert BODY_TEXT.replace("Sentence", f"Host {url.split('/')[2][1:-8]} page {url.rsplit('/')[-1]} sentence") in got[k]
        assert not any(x in got[k] for x in ("Home", "Side note", "Foot", "Nice", "Quote", "One"))
