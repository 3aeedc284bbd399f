import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import pii, sharding, url_filter
from lodestar.llm.queries import URL_RULES

URLS = [
    "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x", "http://x.example.com/en/?q", "http://example.com/EN/", "http://n.net/es/", "http://n.net/es", "http://exnet/fr/", "://net/fr/a", "no", None, "",
    "http://x.org/adserver/a", "http://q.doubleclick.net/x", "http://doubleclick.net", "http://x.org/setup.EXE", "http://b.archive.org/adserver/", "http://u@com:8/", "http://com/a?://net/es/", "http://a\n.net/fr/", "http://x.com/" + "y" * 50_000,
    "http://evilcom/", "http://x.org/banner/a/b/img?", "http://ads.example.org/tracker",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


@pytest.mark.parametrize("block", [5000, 2])
def test_url_rules(spark, block):
    rules = [url_filter.prefix_rule(*r) for r in URL_RULES] + [url_filter.pattern_rule(p) for p in [*url_filter.PATTERNS, "/banner/*/img^", "||ads.example.org/track"]]
    df = spark.createDataFrame([(u, "other") for u in URLS], "url string, verdict_ string").withColumn("hosts", F.lit(1))
    blocked = {"http://x.org/adserver/a", "http://q.doubleclick.net/x", "http://doubleclick.net", "http://x.org/setup.EXE", "http://x.org/banner/a/b/img?", "http://ads.example.org/tracker"}
    for r in url_filter.url_filter(df, rules, block=block).collect():
        host, path, rule, verdict = plain_verdict(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == (verdict or ("block" if r.url in blocked else "allow")), r.url
        assert r.hosts == 1
    assert url_filter.url_filter(df.limit(0), rules).count() == 0
    assert url_filter.url_filter(df.limit(3), []).count() == 3


def test_columns_of_the_helpers_names_stay(spark):
    """Columns named as the results are replaced, all others stay, whatever they are called."""
    pages = spark.createDataFrame([(1, "https://www.example.com/en/x", "h", "f", "b", "p", "_f")], "page_id long, url string, host string, __fit string, __best string, __pattern string, ___fit string")
    got = url_filter.url_filter(pages, [url_filter.prefix_rule(*r) for r in URL_RULES]).first()
    assert (got["host"], got["__fit"], got["__best"], got["__pattern"], got["___fit"], got["verdict"]) == ("www.example.com", "f", "b", "p", "_f", "allow")
    texts = spark.createDataFrame([("call +1 980 555 6268", "a", "b", 3)], "text string, __found string, __new string, n_pseudonyms int")
    got = pii.pseudonymise(texts, key="k").first()
    assert (got["__found"], got["__new"], got["n_pseudonyms"]) == ("a", "b", 1) and got["text"] != "call +1 980 555 6268"


def test_rules_are_filed_under_whole_tokens():
    assert url_filter.prefix_rule("block", "example.com", "/en/ab").tokens == ("example", "com", "en")
    assert url_filter.pattern_rule("/banner/*/img^").tokens == ("banner", "img")
    assert url_filter.pattern_rule("track").tokens == ()


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms(spark):
    text = (
        "mail ann.b1@x.example.com, card 4944339490429605 or 4944 3394 9042 9605, ip 61.131.143.218, call 1 (704) 555-7114 or 704-555-7114, +44 20 7946 0958, ssn 123-45-6789, "
        "iban DE89 3704 0044 0532 0130 00, on 2024-02-29, 29.02.2024 and 2/29/2024"
    )
    rows = [(1, text), (2, "again 4944339490429605 and 61.131.143.218"), (3, None), (4, ""), (5, "no data"), (6, "4944339490429606 999.1.1.1 2023-02-29 000-12-3456 1234567"), (1, text), (7, "x" * 100_000 + " 10.0.0.1")]
    df = spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, n_pseudonyms string")
    out = [(r.doc_id, r.text, r.n_pseudonyms) for r in pii.pseudonymise(df, "key").collect()]
    got = dict((i, t) for i, t, _ in out)
    number = dict((i, n) for i, _, n in out)
    assert [number[i] for i in (1, 2, 4, 5, 6, 7)] == [12, 2, 0, 0, 0, 1] and got[3] is None and got[4] == "" and got[5] == "no data" and got[6] == rows[5][1]
    new = got[1]
    for old in ("ann.b1", "4944339490429605", "61.131.143.218", "704", "7946", "123-45-6789", "3704 0044", "2024-02-29", "29.02.2024"):
        assert old not in new
    cards = re.findall(r"card (\d{16}) or ([\d ]{19})", new)[0]
    assert cards[0] == cards[1].replace(" ", "") and luhn(cards[0]) and cards[0] in got[2]
    ip = re.findall(r"ip (\d+\.\d+\.\d+\.\d+)", new)[0]
    assert all(0 <= int(x) < 256 for x in ip.split(".")) and ip in got[2]
    phones = re.findall(r"call 1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})", new)[0]
    assert phones[:3] == phones[3:] and phones[0][0] in "23456789"
    iban = re.findall(r"iban ([A-Z0-9 ]+),", new)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    a, b, c = re.findall(r"on (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}) and (\d+/\d+/\d{4})", new)[0]
    assert a == "-".join(reversed(b.split("."))) and re.match(r"\d{4}-\d\d-\d\d$", a)
    assert [t for i, t, _ in out if i == 1][0] == [t for i, t, _ in out if i == 1][1]
    assert pii.pseudonymise(df.limit(0), "key").count() == 0
    assert pii.pseudonymise(df.limit(1), "other key").first().text != pii.pseudonymise(df.limit(1), "key").first().text


def test_ibans_end_at_their_countrys_length(spark):
    def iban(country, length):
        body = ("12345678901234567890" * 2)[: length - 4]
        return f"{country}{98 - int(body + ''.join(str(int(c, 36)) for c in country) + '00') % 97:02d}{body}"

    valid = ["ES9121000418450200051332", "BE68 5390 0754 7034", *(iban(c, n) for n, many in pii._IBAN_LENGTHS.items() for c in many.split())]
    valid += [" ".join(v[k : k + 4] for k in range(0, len(v), 4)) for v in valid if " " not in v] + [iban("ZZ", 22)]
    rows = [(k, f"to {v}{after} paid", v) for k, v in enumerate(valid) for after in ([" 2023", " EUR", " BIC", " 1", " 500 EUR", ", 7", ""] if v[:2] != "ZZ" else [",", ""])]
    df = spark.createDataFrame(rows, "k long, text string, v string")
    for r in pii.pseudonymise(df, "key").collect():
        assert r.n_pseudonyms == 1 and r.v not in r.text, r
        before = [t for k, t, v in rows if v == r.v]
        new = r.text[3 : 3 + len(r.v)]
        assert any(t.replace(r.v, new) == r.text for t in before)
        bare = new.replace(" ", "")
        assert bare[:2] == r.v[:2] and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def test_permutations_are_one_to_one(spark):
    days = spark.range(0, 146_097, 11).select(F.date_format(F.date_add(F.expr("DATE'1800-01-01'"), F.col("id").cast("int")), "yyyy-MM-dd").alias("t"))
    ssn = spark.range(1, 4000).select(F.concat(F.lit("123-45-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("t"))
    ip = spark.range(3000).select(F.concat(F.lit("10.0."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("t"))
    for df in (days, ssn, ip):
        n = df.count()
        assert tuple(df.select(pii.pseudonym(F.col("t"), "k").alias("p")).agg(F.count("p"), F.countDistinct("p")).first()) == (n, n)


def sharded(rows, seed, per_bucket, shards=8):
    """Shard and slot of each id, step by step."""
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    total, buckets = len(rows), -(-len(rows) // per_bucket)
    made = []
    for i, t, s in rows:
        data = (t or "").encode()
        made.append(("null" if s is None else "=" + s, digest(f"{seed}|{t or ''}"), digest(f"{seed}|{i}|{zlib.crc32(data)}|{len(data) + 1}"), i))
    copies, first = Counter(h for _, h, _, _ in made), {}
    for s, h, _, _ in made:
        first[h] = min(s, first.get(h, s))
    prefix = lambda h, parts: int(h[:8], 16) * parts >> 32
    # homes
    home, lead, mass = {}, Counter(), Counter()
    whole = sorted(h for h, n in copies.items() if n > 1 and n * 2 * shards <= total)
    for h in whole:
        mass[first[h]] += copies[h]
    for h in whole:
        home[h] = shards * (2 * lead[first[h]] + copies[h]) // (2 * mass[first[h]])
        lead[first[h]] += copies[h]
    upto = Counter()
    for h in whole:
        upto[home[h]] += copies[h]
        if max(Counter({k: sum(copies[x] for x in whole if home.get(x) == k) for k in range(shards)}).values()) > total // shards and upto[home[h]] > total // shards:
            home[h] = None
    home = {h: k for h, k in home.items() if k is not None}
    held = Counter(home[h] for _, h, _, _ in made if h in home)
    # quotas and places
    order = lambda x: (prefix(x[1], buckets), x[1] if copies[x[1]] > per_bucket else "", prefix(x[2], copies[x[1]] // per_bucket + 1) if copies[x[1]] > per_bucket else 0, x[1], x[2], x[3])
    timed = []
    for s in {x[0] for x in made}:
        mine = [x for x in made if x[0] == s]
        owed = [max(0, len(mine) - shards * sum(home.get(x[1]) == k for x in mine)) for k in range(shards)]
        front = [sum(owed[:k]) for k in range(shards + 1)]
        single = sorted((x for x in mine if x[1] not in home), key=order)
        for r, x in enumerate(single):
            at = float(2 * r + 1) * front[shards] / (2 * len(single))
            k = sum(f <= at for f in front) - 1
            timed.append((k + (at - front[k]) / owed[k], *x))
    timed.sort()
    out, at = {}, 0
    for k in range(shards):
        size = (k + 1) * total // shards - k * total // shards
        others = timed[at : at + size - held[k]]
        at += len(others)
        own = sorted((x for x in made if home.get(x[1]) == k), key=order)
        merged = sorted([(j, 1, x) for j, x in enumerate(others)] + [(len(others) * (2 * r + 1) // (2 * len(own)), 0, r, x) for r, x in enumerate(own)], key=lambda y: y[:3] if y[1] == 0 else y[:2])
        for slot, y in enumerate(merged):
            out[y[-1][-1]] = k, slot
    return out


def some_rows(kind):
    r = random.Random(kind)
    if kind == "groups":  # all rows in groups, within and across sources
        return [(k, f"group {k // 6} of six", f"s{k % 2}") for k in range(1200)]
    if kind == "large":  # one text holds a third, few others
        return [(k, None if k % 50 == 0 else "same" if k % 3 == 0 else f"té{k % 9}", "hot" if k % 3 else f"s{k % 7}" if k % 2 else None) for k in range(317)]
    if kind == "full":  # groups of near half a shard overfill some shards
        return [(k, f"g{k // 12}", "one") for k in range(203)]
    return [(k, f"text {k}" if r.random() < 0.7 else f"copy {r.randrange(60)}", r.choice(["a", "b", "c", None, "hot", "hot", "hot"])) for k in range(900)]


@pytest.mark.parametrize("per_bucket", [20_000, 7])
@pytest.mark.parametrize("kind", ["mixed", "groups", "large", "full"])
def test_shards_against_brute_force(spark, kind, per_bucket):
    rows = some_rows(kind)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("x"))
    got = sharding.interleave(df, seed=5, per_bucket=per_bucket).collect()
    want, text = sharded(rows, 5, per_bucket), {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert ((r.shard, r.slot), r.size, r.text_crc32) == (want[r.doc_id], len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()))
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sizes[k]))
    homes = defaultdict(set)
    for r in got:
        homes[text[r.doc_id]].add(r.shard)
    if kind == "mixed":  # no group is divided, and the mixture is kept
        assert all(len(v) == 1 for v in homes.values())
        for s in ("hot", "a", "b", "c", None):
            shares = Counter(r.shard for r in got if r.source == s)
            assert max(shares.values()) - min(shares.values()) <= 3
    if kind == "groups":
        assert sum(len(v) > 1 for v in homes.values()) <= 8


def test_shards_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert sharding.interleave(df.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.interleave(df).collect()] == [(7, 0)]
    same = sharding.interleave(df.union(df)).collect()
    assert sorted(r.slot for r in same) == [0, 0] and len({r.shard for r in same}) == 2
    one_id = spark.createDataFrame([(None if k % 2 else 4, f"text {k}", "s") for k in range(60)], "doc_id long, text string, source string")
    again = sharding.interleave(one_id, per_bucket=5).collect()
    assert sorted(Counter(r.shard for r in again).values()) == [7] * 4 + [8] * 4 and len({(r.shard, r.slot) for r in again}) == 60
    # groups joined as a table, not broadcast
    rows = some_rows("mixed")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = sharding.BROADCAST_ROWS
    try:
        sharding.BROADCAST_ROWS = 0
        assert {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(df, per_bucket=50).collect()} == sharded(rows, 0, 50)
    finally:
        sharding.BROADCAST_ROWS = before
