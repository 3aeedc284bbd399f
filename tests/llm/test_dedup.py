import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import components, exact_dedup, simhash

TEXTS = [(1, "same text"), (2, "same text"), (5, None), (6, ""), (7, "a" * 200_000), (8, "a" * 200_000), (9, "other"), (9, "other"), (10, "Same text"), (None, "same text"), (None, None)]
SCHEMA = "doc_id long, text string, kept string, recipe int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], SCHEMA)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_against_brute_force(spark, digest_bytes):
    rng = random.Random(3)
    rows = TEXTS + [(100 + k, " ".join(rng.choices(["aa", "bb", "cc"], k=rng.randrange(4)))) for k in range(150)]
    rows += [(300 + k, "".join(rng.choices("ab \n", k=9000 + k % 3))) for k in range(4)]
    # digests of one byte clash all the time
    got = exact_dedup.exact_dedup(frame(spark, rows), digest_bytes, bits=6).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert all(len(v) == 1 for v in kept.values()) and len(kept) == len({t or "" for _, t in rows})


def test_exact_keeps_one_row_and_all_columns(spark):
    out = exact_dedup.keep_first(frame(spark, TEXTS))
    assert out.columns == ["doc_id", "text", "kept", "recipe"]
    assert sorted((r.doc_id, (r.text or "")[:9]) for r in out.collect()) == [(2, "same text"), (6, ""), (8, "aaaaaaaaa"), (9, "other"), (10, "Same text")]


def test_exact_empty_table(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    assert exact_dedup.keep_first(frame(spark, [])).count() == 0


def test_chunks_are_content_defined_and_whole():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(60_000))
    parts = exact_dedup.chunks(data, bits=8)
    assert b"".join(parts) == data and 100 < len(parts) < 500
    moved = exact_dedup.chunks(b"prefix" + data, bits=8)
    assert len(set(parts) & set(moved)) > 0.95 * len(parts)
    assert max(map(len, exact_dedup.chunks(b"x" * 1_000_000, longest=5000))) == 5000
    assert exact_dedup.chunks(b"") == []


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, "  \n", "One", "one two", "A b C", "a b c d a b c d", "Ünï Ç x y z", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [50_000, 20])
def test_components_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "DENSE", 16)
    rng = random.Random(7)
    fps = {0}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}  # one dense group
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.fp: r.root for r in simhash.near_components(df, hot=hot).collect()}
    want = brute_components(fps)
    same = defaultdict(set)
    for f in fps:
        same[want[f]].add(signed(f))
    assert {frozenset(v) for v in same.values()} == {frozenset(k for k in got if got[k] == r) for r in set(got.values())}
    assert all(got[signed(f)] == min(same[want[f]]) for f in fps)


def test_every_plan_is_exact():
    """Whatever the thresholds, close fingerprints share a key."""
    rng = np.random.default_rng(2)
    both = np.full((64, 64), 25.0)
    np.fill_diagonal(both, 50.0)
    for widths in ((2,), (3,), (4,)):
        plan = simhash.make_plan(100, both, 3, widths)
        assert sum(p.threshold + 1 for p in plan) == 4
        for _ in range(300):
            x = int(rng.integers(0, 1 << 63))
            y = x
            for b in rng.choice(64, 3, replace=False):
                y ^= 1 << int(b)
            assert any(sum((x ^ y) >> b & 1 for b in p.bits) <= p.threshold for p in plan)


@pytest.mark.parametrize("thresholds", [(1, 1), (0, 2), (2, 0), (0, 0, 1), (1, -1, 1), (0, 1, 0), (1, 0, 0)])
def test_components_by_probes(spark, monkeypatch, thresholds):
    """Plans of few partitions, as large tables get them: flipped bits meet, bit 63 among them."""
    groups = len(thresholds)
    plan = [simhash.Partition(tuple(range(g, 64, groups)), t) for g, t in enumerate(thresholds) if t >= 0]
    assert sum(p.threshold + 1 for p in plan) == 4
    monkeypatch.setattr(simhash, "make_plan", lambda *_: plan)
    rng = random.Random(9)
    fps = set()
    for k in range(40):
        x = rng.getrandbits(64)
        y = x ^ (1 << 63) ^ (1 << rng.randrange(62)) ^ (1 << 62) if k % 2 else x ^ sum(1 << b for b in rng.sample(range(64), 3))
        fps |= {x, y, x ^ (1 << 63)}
    want = brute_components(sorted(fps))
    same = defaultdict(set)
    for f in fps:
        same[want[f]].add(signed(f))
    df = spark.createDataFrame([(signed(f),) for f in sorted(fps)], "fp long")
    got = {r.fp: r.root for r in simhash.near_components(df).collect()}
    assert len(same) <= 40 and all(got[signed(f)] == min(same[want[f]]) for f in fps)


@pytest.mark.parametrize("widths", [(2,), (3,)])
def test_components_by_forced_widths(spark, monkeypatch, widths):
    """make_plan's own plans of few partitions; every single bit is flipped once."""
    planned = simhash.make_plan
    monkeypatch.setattr(simhash, "make_plan", lambda n, both, distance: planned(n, both, distance, widths))
    base = random.Random(4).getrandbits(64)
    fps = sorted({base} | {base ^ (1 << b) for b in range(64)})
    got = simhash.near_components(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    assert len(got) == 65 and {r.root for r in got} == {min(map(signed, fps))}


def test_hot_buckets_are_dealt_again(spark, monkeypatch):
    """Near copies that agree in most bits stay together in a bucket's parts, so those are split again."""
    rng = random.Random(21)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(40, 64), k)) for k in (1, 2, 3, 4) for _ in range(150)} | {rng.getrandbits(64) for _ in range(200)}
    want = brute_components(sorted(fps))
    df = spark.createDataFrame([(signed(f),) for f in sorted(fps)], "fp long")
    got = {r.fp: r.root for r in simhash.near_components(df, hot=40).collect()}
    same = defaultdict(set)
    for f in fps:
        same[want[f]].add(signed(f))
    assert all(got[signed(f)] == min(same[want[f]]) for f in fps)


def test_hot_keys_are_spread(spark, monkeypatch):
    """Large groups of copies, hubs and fingerprints take the same way as small ones."""
    from lodestar.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(components, "HOT_ROWS", 3)
    texts = ["one two three four five"] * 40 + ["one two three four five six"] * 2 + [f"text {k} of its own" for k in range(20)] + ["", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (max(same), len(same), k == max(same))
    edges = spark.createDataFrame([(0, k) for k in range(1, 60)] + [(k, k + 1) for k in range(100, 130)], "u long, v long")
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert roots == {k: 0 for k in range(60)} | {k: 100 for k in range(100, 131)}
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    prints = {k: simhash.fingerprint(t or "") for k, t in enumerate(texts)}
    want = brute_components(sorted(set(prints.values())))
    for k in found:
        assert found[k] == min(j for j in prints if want[prints[j]] == want[prints[k]])


@pytest.mark.parametrize("room", [0, 1000])
def test_rows_that_go(spark, monkeypatch, room):
    """With and without a broadcast; ids that repeat, ids that are missing, other columns."""
    from lodestar.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", room)
    rows = [(1, "a", 1), (2, "a", 2), (2, "b", 3), (2, "a", 4), (3, "c", 5), (None, "c", 6), (None, "d", 7), (4, None, 8), (5, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    kept = sorted(tuple(r) for r in exact_dedup.keep_first(docs).select("doc_id", "text").collect() if r.doc_id is not None)
    assert kept == [(2, "a"), (2, "b"), (3, "c"), (5, "")]
    assert [tuple(r) for r in exact_dedup.keep_first(docs).where("doc_id is null").select("text").collect()] == [("d",)]
    assert exact_dedup.keep_first(docs).columns == docs.columns
    assert simhash.keep_one(docs.limit(0)).count() == 0 and simhash.keep_one(docs).columns == docs.columns


def test_simhash_of_documents(spark):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(4, long), (3, long + " end"), (7, long), (8, None), (9, "  "), (11, "alone here today"), (None, long)]
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(frame(spark, rows)).collect()}
    assert got == {(4, 3), (3, 3), (7, 3), (8, 8), (9, 8), (11, 11), (None, 3)}
    assert sorted(r.doc_id for r in simhash.keep_one(frame(spark, rows)).collect()) == [3, 8, 11]
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.components(edges).collect()
    assert {r.root for r in got} == {0} and {r.node for r in got} == set(range(201))
    assert components.components(edges.limit(0)).count() == 0
