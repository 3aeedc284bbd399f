"""Benchmark decontamination under edit distance.

A document is contaminated by a benchmark item if some passage of it lies within `max_edits` times the item's length
of edits (insertions, deletions, substitutions of characters, after lower-casing and turning every run of other than
letters and digits into one space).

The search loses nothing. An item is cut into pieces of 5 characters, side by side. One edit spoils at most one piece, so
a passage with at most k edits holds all but k of the pieces unchanged, at distances from their places in the item that
differ by at most k. Every character of the text is looked up in the pieces of all items; where as many different pieces
of an item meet as it must keep, the text around is verified by exact edit distance, unless too few of the item's
runs of two and three characters occur there, each near its place, for so few edits (all items that meet at a place are
looked at together, so a text that holds an opening of thousands of items costs little). Items that could lose all their pieces, which
takes a larger `max_edits`, are verified against the whole text.

The method named for this operator, a random-walk embedding of edit into Hamming distance with bit-sampling LSH, cannot
give these results at this cost; the README has the figures.

The benchmark travels to the executors in blocks of at most BLOCK_CHARS characters, one pass for each block; where there
are several, a block's results are written before the next one is read, so what the driver holds and what is broadcast
has a bound whatever the size of the benchmark. Documents never move.

Defined results: null or empty texts and items match nothing; items of fewer than 30 characters must occur
between word boundaries, within the same share of edits; texts of any length are scanned whole, in blocks that overlap by more than the longest item;
equal rows get equal results; items that repeat an id, or have none, are all compared, and the id is reported once, with
the closest of them; empty tables give empty results; other columns are kept by the filter, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, text_column

MAX_EDITS = 0.15
BLOCK_CHARS = 4_000_000
_SHORT = 30
#: One edit spoils at most this many runs of as many characters, and one of them where they lie side by side.
_PIECE = 5
#: Of the pieces that a passage must keep, this share, and as many at least, are looked for: few meet by chance.
_SHARE, _LEAST = 0.7, 4
#: Cells for each piece that occurs.
_ROOM = 2
#: Items whose places in a text fall in one stretch of so many characters are looked at together.
_STRETCH = 64
#: Texts are searched together up to this many characters.
_TOGETHER = 1 << 15
_TEXT_BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _plain_table() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(1 << 16)], dtype=bool)


_PLAIN = _plain_table()


def normalise(text: str) -> np.ndarray:
    """Code points of letters and digits, lower-cased, with single spaces (32) between words."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    plain = np.where(codes < (1 << 16), _PLAIN[np.minimum(codes, 0xFFFF)], True)
    keep = plain.copy()
    keep[1:] |= plain[:-1]
    out = np.where(plain, codes, np.uint32(32))[keep]
    return out[:-1] if len(out) and out[-1] == 32 else out


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hash of each run of 5 characters."""
    if len(codes) < _PIECE:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h1 = codes.astype(np.uint64) + np.uint64(7)
        h2 = h1[:-1] * _BASE + h1[1:]
        h4 = h2[:-2] * (_BASE * _BASE) + h2[2:]
        return (h4[:-1] * _BASE + h1[4:]) * np.uint64(0xD6E8FEB86659FD93)


class _Near:
    """The runs of n characters of all items, for a count of those that occur near their places. One edit spoils at most
    n of an item's runs; the others stand where they should, give or take the edits."""

    def __init__(self, items: list[np.ndarray], n: int):
        self.n = n
        runs = [self._runs(c) for c in items]
        self.known, ids = np.unique(np.concatenate(runs), return_inverse=True) if runs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.ids, self.at = ids.astype(np.int32), np.cumsum([0, *map(len, runs)])
        #: scratch: row of each run in the part that is looked at
        self.row = np.zeros(len(self.known), np.int32)

    def _runs(self, codes: np.ndarray) -> np.ndarray:
        wide = codes.astype(np.uint64)
        if len(wide) < self.n:
            return wide[:0]
        out = wide[: len(wide) - self.n + 1]
        for k in range(1, self.n):
            out = out << np.uint64(21) | wide[k : len(out) + k]
        return out

    def enough(self, part: np.ndarray, items: np.ndarray, low: np.ndarray, high: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which of the items, at offsets from low to high give or take their edits, have enough of their runs in part."""
        if not len(items) or not len(self.known):
            return np.ones(len(items), bool)
        runs = self._runs(part)
        at = np.minimum(np.searchsorted(self.known, runs), len(self.known) - 1)
        there = np.flatnonzero(self.known[at] == runs)
        ids, row = np.unique(at[there], return_inverse=True)
        # how often each run of the part stands before each place
        width = len(runs) + 1
        before = np.zeros((len(ids) + 1, width), np.int16)
        before[row + 1, there + 1] = 1
        np.cumsum(before, axis=1, out=before)
        before = before.reshape(-1)
        self.row[ids] = np.arange(1, len(ids) + 1, dtype=np.int32) * width
        counts = self.at[items + 1] - self.at[items]
        ends = np.cumsum(counts)
        place = np.arange(int(ends[-1]), dtype=np.int32)
        of = self.row[self.ids[place + np.repeat((self.at[items] - ends + counts).astype(np.int32), counts)]]
        self.row[ids] = 0
        # offsets in `before` of the first and last place at which each run may stand
        first = place + np.repeat((low - most - ends + counts).astype(np.int32), counts)
        last = first + np.repeat((high - low + 2 * most + 1).astype(np.int32), counts)
        for bound in (first, last):
            np.minimum(bound, len(runs), out=bound)
            np.maximum(bound, 0, out=bound)
            bound += of
        there = before.take(last) > before.take(first)
        kept = np.zeros(len(items), np.int64)
        some = counts > 0
        kept[some] = np.add.reduceat(there, (ends - counts)[some], dtype=np.int64)
        return kept >= counts - self.n * most


def _order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places in the order of first, then second."""
    low, bits = int(second.max()).bit_length(), len(first).bit_length()
    if int(first.max()).bit_length() + low + bits < 63:  # all in one number sorts several times as fast
        return np.sort((first << low | second) << bits | np.arange(len(first))) & ((1 << bits) - 1)
    return np.lexsort((second, first))


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def within(item: np.ndarray, text: np.ndarray, most: int) -> int | None:
    """Least edit distance of item to any part of text, if at most `most`; bit-parallel, one step per character."""
    m = len(item)
    where: dict[int, int] = defaultdict(int)
    for k, c in enumerate(item.tolist()):
        where[c] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, best = full, 0, m, m
    for c in text.tolist():
        eq = where.get(c, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        right_plus = minus | (full & ~(zero | plus))
        right_minus = plus & zero
        if right_plus & top:
            now += 1
        elif right_minus & top:
            now -= 1
        right_plus = (right_plus << 1) & full
        right_minus = (right_minus << 1) & full
        plus = right_minus | (full & ~(zero | right_plus))
        minus = right_plus & zero
        if now < best:
            best = now
    return best if best <= most else None


def at_words(item: str, text: str, start: int, most: int) -> int | None:
    """Least edit distance of item to a part of text from start to the end of a word, if at most `most`."""
    m = len(item)
    where: dict[str, int] = defaultdict(int)
    for k, c in enumerate(item):
        where[c] |= 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, best = full, 0, m, most + 1
    for at in range(start, min(len(text), start + m + most + 1)):
        c = text[at]
        if c == " " and now < best:
            best = now
        eq = where.get(c, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        right_plus = minus | (full & ~(zero | plus))
        right_minus = plus & zero
        if right_plus & top:
            now += 1
        elif right_minus & top:
            now -= 1
        right_plus = (right_plus << 1 | 1) & full
        right_minus = (right_minus << 1) & full
        plus = right_minus | (full & ~(zero | right_plus))
        minus = right_plus & zero
    return best if best <= most else None


class Index:
    """A block of benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[int, str]], max_edits: float = MAX_EDITS):
        #: id and length of each item
        self.items: list[tuple[int | None, int]] = []
        self.number, self.codes = [], []
        #: number, item, edits, and one piece more than edits, with their places
        self.short: list[tuple[int, str, int, list[tuple[int, str]]]] = []
        for number, (item_id, text) in enumerate(items):
            codes = normalise(text or "")
            self.items.append((item_id, len(codes)))
            if len(codes) >= _SHORT:
                self.number.append(number)
                self.codes.append(codes)
            elif len(codes):
                item, most = _string(codes), int(max_edits * len(codes))
                size = max(1, len(item) // (most + 1))
                self.short.append((number, item, most, [(k * size, item[k * size : (k + 1) * size]) for k in range(most + 1)]))
        self.most = [int(max_edits * len(c)) for c in self.codes]
        self.longest = max(map(len, self.codes), default=0)
        #: pieces that a passage must keep of an item
        keep = [len(c) // _PIECE - m for c, m in zip(self.codes, self.most)]
        self.anywhere = [i for i, k in enumerate(keep) if k < 1]
        seeded = [i for i, k in enumerate(keep) if k >= 1]
        # the commonest pieces of an item go, each with one of those it must keep, while a share of the latter is left
        whole = [_grams(c) for c in self.codes]
        known, often = np.unique(np.concatenate(whole), return_counts=True) if whole else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        grams, places = [], []
        for i in seeded:
            g = whole[i][::_PIECE]
            left = min(keep[i], max(_LEAST, int(np.ceil(_SHARE * keep[i]))))
            rare = np.sort(np.argsort(often[np.searchsorted(known, g)], kind="stable")[: len(g) - keep[i] + left])
            keep[i] = left
            grams.append(g[rare])
            places.append(rare * _PIECE)
        sizes = [len(g) for g in grams]
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.item = np.repeat(np.array(seeded, dtype=np.int64), sizes)[order]
        self.place = np.concatenate(places)[order] if sizes else np.zeros(0, np.int64)
        self.need = np.repeat(np.array([keep[i] for i in seeded], dtype=np.int64), sizes)[order]
        self.narrow = np.repeat(np.array([1 / (self.most[i] + 1) for i in seeded], dtype=np.float64), sizes)[order]
        self.spread = self.item * np.int64(0x9E3779B1)
        self.near = [_Near(self.codes, n) for n in (3, 2)]
        self.sizes, self.limits = np.array([len(c) for c in self.codes], np.int64), np.array(self.most, np.int64)
        #: comparisons made
        self.compared = 0
        #: texts lie so far apart that no two of them meet in one item's cells
        self.gap = self.longest + 4 * (max(self.most, default=0) + 1)
        # pieces by the first bits of their hash
        bits = max(16, int(np.ceil(np.log2(max(1, len(self.grams)) * 16))))
        self.shift = np.uint64(64 - bits)
        bucket = self.grams >> self.shift
        self.bucket = np.full(1 << bits, -1, dtype=np.int32)
        self.bucket[bucket[::-1]] = np.arange(len(bucket), dtype=np.int32)[::-1]
        self.fullest = int(np.unique(bucket, return_counts=True)[1].max()) if len(bucket) else 0

    def _places(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows (text, least and largest offset, item) where an item could start: enough of its different pieces occur, and
        at distances from their places in it that differ by less than twice the item's edits. Sorted, each once."""
        none = np.zeros((0, 4), np.int64)
        h = _grams(texts[0] if len(texts) == 1 else np.concatenate(texts))
        k = self.bucket[h >> self.shift]
        at = np.flatnonzero(k >= 0)
        k, h = k[at], h[at]
        hits = [(at[same], k[same] + j) for j in range(self.fullest) for same in [np.flatnonzero(self.grams[np.minimum(k + j, len(self.grams) - 1)] == h)]]
        if not sum(len(x) for x, _ in hits):
            return none
        at, k = (np.concatenate(x) for x in zip(*hits))
        k = np.minimum(k, len(self.grams) - 1)
        begin = np.cumsum([0, *map(len, texts)])
        text = np.searchsorted(begin, at, side="right") - 1
        times = self.times[k]
        upto = np.cumsum(times)
        total = int(upto[-1])
        post = np.repeat(self.first[k] - upto + times, times) + np.arange(total)
        diagonal = np.repeat(at + (text + 1) * self.gap, times) - self.place[post]
        cell = ((diagonal + 0.5) * self.narrow[post]).astype(np.int64)
        # counted in hashed cells first, where clashes only add
        mask = (1 << (_ROOM * total).bit_length()) - 1
        hashed = (cell + self.spread[post]) & mask
        count = np.bincount(hashed + 1, minlength=mask + 3).astype(np.int32)
        count[0], count[-1] = count[-2], count[1]
        pair = count[1:-1] + np.maximum(count[:-2], count[2:])
        left = np.flatnonzero(pair[hashed] >= self.need[post])
        if not len(left):
            return none
        post, cell, diagonal = post[left], cell[left], diagonal[left]
        order = _order(self.item[post] * (int(cell.max()) + 2) + cell, self.place[post])
        post, cell, diagonal = post[order], cell[order], diagonal[order]
        item, place = self.item[post], self.place[post]
        new = np.ones(len(post), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (item[1:] != item[:-1])
        lead = np.flatnonzero(new)
        # different pieces of each cell, and of it and the next one: at least as many as of both together
        other = new.copy()
        other[1:] |= place[1:] != place[:-1]
        size = np.add.reduceat(other, lead, dtype=np.int64)
        low, high = np.minimum.reduceat(diagonal, lead), np.maximum.reduceat(diagonal, lead)
        item, cell, need = item[lead], cell[lead], self.need[post[lead]]
        meets = np.flatnonzero((item[1:] == item[:-1]) & (cell[1:] == cell[:-1] + 1))
        both = size.copy()
        both[meets] += size[meets + 1]
        wide, far = low.copy(), high.copy()
        wide[meets], far[meets] = np.minimum(low[meets], low[meets + 1]), np.maximum(high[meets], high[meets + 1])
        good = both >= need
        item, wide, far = item[good], wide[good], far[good]
        # back from the offsets with gaps to the text and the offset in it
        starts = begin[:-1] + (np.arange(len(texts)) + 1) * self.gap
        t = np.searchsorted(starts, wide + self.longest, side="right") - 1
        rows = np.stack([t, wide - starts[t], far - starts[t], item], axis=1)
        rows = rows[np.lexsort(rows.T[::-1])]
        once = np.ones(len(rows), bool)
        once[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        return rows[once]

    def _verify(self, pieces: list[tuple[int, np.ndarray]], out: list[dict[int, int]]) -> None:
        """Put the least numbers of edits into out, for texts and the parts of them in pieces. Items that may begin near
        the same place are looked at together; an item is compared with equal parts of texts once."""
        rows = self._places([codes for _, codes in pieces]) if len(self.grams) else np.zeros((0, 4), np.int64)
        looked: dict[tuple, np.ndarray] = {}
        compared: dict[tuple[int, bytes], int | None] = {}

        def compare(t: int, i: int, part: np.ndarray) -> None:
            item, key = self.number[i], (i, part.tobytes())
            if out[t].get(item) == 0:
                return
            if key not in compared:
                self.compared += 1
                compared[key] = within(self.codes[i], part, self.most[i])
            edits = compared[key]
            if edits is not None:
                out[t][item] = min(edits, out[t].get(item, edits))

        # rows of one text whose least offsets fall in one stretch
        stretch = rows[:, 1] // _STRETCH
        edges = np.concatenate([[0], np.flatnonzero((rows[1:, 0] != rows[:-1, 0]) | (stretch[1:] != stretch[:-1])) + 1, [len(rows)]]).tolist() if len(rows) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            t, codes = pieces[int(rows[a, 0])]
            low, high, items = rows[a:b, 1:].T
            first, last = low - self.limits[items], high + self.sizes[items] + self.limits[items]
            start = max(0, int(first.min()))
            part = codes[start : max(0, int(last.max()))]
            key = (part.tobytes(), items.tobytes(), (low - start).tobytes(), (high - low).tobytes())
            if key not in looked:
                left = np.arange(len(items))
                for grams in self.near:
                    left = left[grams.enough(part, items[left], low[left] - start, high[left] - start, self.limits[items[left]])]
                looked[key] = left
            for k in looked[key].tolist():
                compare(t, int(items[k]), codes[max(0, int(first[k])) : max(0, int(last[k]))])
        for t, codes in pieces:
            for i in self.anywhere:
                compare(t, i, codes)

    def _short_items(self, text: str, found: dict[int, int]) -> None:
        for number, item, most, pieces in self.short:
            if f" {item} " in text:
                found[number] = 0
                continue
            starts = set()
            for place, piece in pieces if most else ():
                at = text.find(piece)
                while at >= 0:
                    starts.update(s for s in range(max(1, at - place - most), min(len(text), at - place + most + 1)) if text[s - 1] == " ")
                    at = text.find(piece, at + 1)
            for start in sorted(starts):
                edits = at_words(item, text, start, min(most, found.get(number, most + 1) - 1))
                if edits is not None:
                    found[number] = edits

    def search(self, texts: list[str]) -> list[dict[int, int]]:
        """For each text, the least number of edits by item, as the item's place in the list."""
        out: list[dict[int, int]] = [{} for _ in texts]
        pieces: list[tuple[int, np.ndarray]] = []
        held = 0
        for t, text in enumerate(texts):
            whole = normalise(text or "")
            if self.short and len(whole):
                self._short_items(f" {_string(whole)} ", out[t])
            if not self.longest or not len(whole):
                continue
            # parts of a long text overlap by more than any passage
            margin = 2 * self.longest + max(self.most)
            for block in range(0, len(whole), _TEXT_BLOCK):
                pieces.append((t, whole[max(0, block - margin) : block + _TEXT_BLOCK]))
                held += len(pieces[-1][1])
                if held >= _TOGETHER:
                    self._verify(pieces, out)
                    pieces, held = [], 0
        if pieces:
            self._verify(pieces, out)
        return out


    def report(self, hits: dict[int, int]) -> list[tuple[int | None, int, float]]:
        """(item id, edits, similarity) of one text's hits, the closest item of each id, in the order of ids."""
        best: dict[int | None, tuple[float, int]] = {}
        for k, edits in hits.items():
            item_id, size = self.items[k]
            best[item_id] = max(best.get(item_id, (-1.0, 0)), (1 - edits / size, -edits))
        return [(i, -edits, similarity) for i, (similarity, edits) in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Items in blocks of at most about `most` characters (items of one id stay together), each read when it is asked for,
    and whether there are several."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_column(benchmark).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = int(total // most) + 1
    key = F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id"))
    for k in range(parts):
        block = sorted({(r.item_id, r.text) for r in items.where(F.pmod(key, F.lit(parts)) == k).collect()}, key=lambda x: (x[0] is None, x))
        if block:
            yield block, parts > 1


def contaminated(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, most: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, similarity (1 - edits / length of the normalised item) for each document and item that
    it contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    out = None
    schema = "doc_id long, item_id long, edits long, similarity double"
    for block, several in blocks(benchmark, most):
        sent = spark.sparkContext.broadcast(Index(block, max_edits))

        def run(batches, sent=sent):
            index = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    found = [(d, *hit) for d, hits in zip(part.column("doc_id").to_pylist(), index.search(part.column("text").to_pylist())) for hit in index.report(hits)]
                    cols = list(zip(*found)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], names=["doc_id", "item_id", "edits", "similarity"])

        part = rows.mapInArrow(run, schema)
        if several:
            part = materialise(part, "contaminated")
            sent.destroy()
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, most: int = BLOCK_CHARS) -> DataFrame:
    """docs without contaminated rows; all columns stay. One pass for each block of the benchmark, nothing is shuffled."""
    for block, several in blocks(benchmark, most):
        sent = docs.sparkSession.sparkContext.broadcast(Index(block, max_edits))

        def run(batches, sent=sent):
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    yield part.filter(pa.array([not hits for hits in sent.value.search(part.column("text").to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = materialise(docs, "clean")
            sent.destroy()
    return docs
