"""Pseudonyms against plain Python: the same finds, judged and permuted step by step with hashlib and the calendar."""

import hashlib
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from lodestar.llm import pii, queries
from lodestar.llm.common import table


def characters(text, key, kind):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]

    def add(own, other, step):
        noise = hashlib.sha512(f"{key}|{kind}|{step}|{other}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(own):
            by = int(noise[k % 32 * 4 : k % 32 * 4 + 4], 16)
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if c.isascii() and 0 <= ord(c) - ord(first) < size:
                    c = chr(ord(first) + (ord(c) - ord(first) + by) % size)
                    break
            out += c
        return out

    for step in range(8):
        left, right = (add(left, right, step), right) if step % 2 == 0 else (left, add(right, left, step))
    return left + right


def pair(x, y, a, b, key, kind):
    noise = lambda step, other: int(hashlib.sha256(f"{key}|{kind}|{step}|{other}".encode()).hexdigest()[:15], 16)
    for step in range(8):
        x, y = ((x + noise(step, y)) % a, y) if step % 2 == 0 else (x, (y + noise(step, x)) % b)
    return x, y


def laid_out(shape, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isdigit() else c for c in shape)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))


def spelled(text):
    return int("".join(str(int(c, 36)) for c in text))


def one(m, key):
    digits = "".join(c for c in m if c.isdigit())
    if "@" in m:
        name, host = m.split("@")
        return characters(name, key, "email") + "@" + host
    if re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9 ]+", m):
        bare = m.replace(" ", "")
        if spelled(bare[4:] + bare[:4]) % 97 != 1:
            return None
        body = characters(bare[4:], key, "iban")
        new = iter(bare[:2] + f"{98 - spelled(body + bare[:2] + '00') % 97:02d}" + body)
        return "".join(c if c == " " else next(new) for c in m)
    if re.fullmatch(r"(?:\d+\.){3}\d+", m):
        parts = m.split(".")
        if any(str(int(p)) != p or int(p) > 255 for p in parts):
            return None
        a, b, c, d = map(int, parts)
        x, y = pair(a * 256 + b, c * 256 + d, 65536, 65536, key, "ipv4")
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d?([./])\d\d?\1\d{4}", m):
        parts = [int(p) for p in re.split("[./-]", m)]
        tries = [parts] if m[4] == "-" else [parts[::-1]] + [[parts[2], parts[0], parts[1]]] * ("/" in m)
        for k, (y, mo, d) in enumerate(tries):
            try:
                n = (date(y, mo, d) - date(1800, 1, 1)).days
            except ValueError:
                continue
            cycle, place = divmod(n, 146097)
            x, z = pair(place // 773, place % 773, 189, 773, key, "date")
            new = date(1800, 1, 1) + timedelta(cycle * 146097 + x * 773 + z)
            if m[4] == "-":
                return new.isoformat()
            first, second = (new.month, new.day) if k else (new.day, new.month)
            mark, wide = ("/" if "/" in m else "."), [len(p) for p in re.split("[./]", m)]
            return f"{first:0{wide[0]}d}{mark}{second:0{wide[1]}d}{mark}{new.year:04d}"
        return None
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x, y = pair((area - (1 if area < 666 else 2)) * 99 + group - 1, serial - 1, 88902, 9999, key, "ssn")
        area = x // 99 + (1 if x // 99 < 665 else 2)
        return f"{area:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if 13 <= len(digits) <= 19 and not set(m) & set("+().") and luhn(digits) % 10 == 0:
        body = characters(digits[:-1], key, "card")
        return laid_out(m, body + str(-luhn(body + "0") % 10))
    ten = digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if re.fullmatch("[2-9][0-9]{2}[2-9][0-9]{6}", ten) and set(m) & set(" ().+-") and (m[0] != "+" or m[1] == "1"):
        x, y = pair(int(ten[:3]) - 200, int(ten[3:]) - 2_000_000, 800, 8_000_000, key, "phone")
        return laid_out(m, "1" * (len(digits) == 11) + f"{x + 200}{y + 2_000_000}")
    if m[0] == "+" and 8 <= len(digits) <= 15:
        return laid_out(m, digits[:2] + characters(digits[2:], key, "phone"))
    return None


def replaced(text, key):
    """The text with pseudonyms, and how many."""
    n = 0

    def put(m):
        nonlocal n
        new = one(m[0], key)
        n += new is not None
        return m[0] if new is None else new

    return re.sub(pii._ANY, put, text), n


def test_the_table_against_plain_python(spark, sf_dir):
    got = {r.doc_id: (r.text, r.n_pseudonyms) for r in queries.QUERIES["op5_pii"](spark, sf_dir).collect()}
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert got == {r.doc_id: replaced(r.text, "an example key") for r in rows} and sum(n for _, n in got.values()) > 10


def test_made_finds_against_plain_python(spark):
    r = random.Random(2)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card():
        body = digits(15)
        return body + str(-luhn(body + "0") % 10)

    def iban():
        body = "".join(r.choice("0123456789ABCDEF") for _ in range(18))
        whole = "GB" + f"{98 - spelled(body + 'GB00') % 97:02d}" + body
        return r.choice([whole, " ".join(whole[k : k + 4] for k in range(0, 22, 4))])

    make = [
        lambda: f"{digits(3)}x.Y{digits(2)}@mail.example.org", iban, card, lambda: " ".join(re.findall("....", card())), lambda: ".".join(str(r.randint(0, 270)) for _ in range(4)), lambda: f"{r.randint(1700, 2300)}-{r.randint(1, 13):02d}-{r.randint(1, 31):02d}",
        lambda: f"{r.randint(1, 31)}.{r.randint(1, 12):02d}.{r.randint(1900, 2100)}", lambda: f"{r.randint(1, 14):02d}/{r.randint(1, 31)}/{r.randint(1900, 2100)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{digits(4)}", lambda: f"+1 {r.randint(200, 999)} {r.randint(200, 999)} {digits(4)}", lambda: f"+49 {digits(3)} {digits(7)}", lambda: digits(r.randint(1, 20)),
    ]
    texts = [" and ".join(["é", *(r.choice(make)() for _ in range(r.randint(0, 8)))]) for _ in range(400)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").withColumn("found", F.lit(1))
    got = {x.doc_id: (x.text, x.n_pseudonyms) for x in pii.pseudonymise(frame, key="k").collect()}
    assert got == {k: replaced(t, "k") for k, t in enumerate(texts)}
    assert sum(n for _, n in got.values()) > 800
