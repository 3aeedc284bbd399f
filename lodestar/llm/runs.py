"""Periodic run detection: stretches of words that repeat with a period, found whole, and texts with repeats collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least `least` words
and `exponent` periods, which no neighbouring word extends keeping period q. All runs of a document are found from its LZ
blocks:

* Ranks of all stretches of 1, 2, 4, ... words by doubling give the suffix array, and the common extension of two places
  forwards or backwards by one look at each length.
* The longest previous factor of a place is its longest common prefix with the next smaller places beside it in the suffix
  array. Blocks of one such factor each follow each other from the start.
* A run that lies strictly inside a block is a copy of a run strictly inside the block's source. All others touch a start
  of a block, and the last block that they reach bounds their period: those are found by extending, for each admissible
  period, from the starts of blocks (Main). The others are then copied in order of their starts, from buckets by start.

Documents of a batch are handled together, as one sequence in which no word of one document equals one of another.

Memory: about 200 bytes for a word of a batch of documents (`_WORDS` words or one longer document).

Defined results: a null or empty text has no words and no run. Rows that repeat an id are handled one by one. A null id has
no checksum and is never made periodic. A table without rows gives one without rows. Other columns are not read."""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_batches, text_column
from lodestar.llm.words import by_size, joined, numbered, split_words

LEAST, EXPONENT = 6, 4
#: Words that are handled together.
_WORDS = 1 << 18


def _sorted(key: np.ndarray) -> np.ndarray:
    """Places of key in its order."""
    bits = max(1, int(len(key)).bit_length())
    if len(key) and int(key.max()).bit_length() + bits < 63:  # key and place in one number sort several times as fast
        return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)
    return np.argsort(key, kind="stable")


class Suffixes:
    """Ranks of the stretches of 2^k symbols at each place, for every k up to the one at which no two are equal."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        self.ranks: list[np.ndarray] = []
        bits = max(1, (n + 1).bit_length())
        rank, open_, base, key, length = np.full(n + 1, -1, np.int64), np.arange(n), np.zeros(n, np.int64), symbols, 0
        while True:
            order = _sorted(key)
            open_, base, key = open_[order], base[order], key[order]
            at = np.arange(len(key))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            # of a group that was equal before, the parts keep its first rank, counted on
            old = np.ones(len(key), bool)
            old[1:] = base[1:] != base[:-1]
            first = np.maximum.accumulate(np.where(new, at, 0))
            group = np.maximum.accumulate(np.where(old, at, 0))
            rank = rank.copy()
            rank[open_] = base + first - group
            self.ranks.append(rank)
            length = 2 * length or 1
            same = ~new
            same[:-1] |= ~new[1:]
            open_ = open_[same]
            if not len(open_):
                break
            base = rank[open_]
            key = base << bits | (rank[np.minimum(open_ + length, n)] + 1)
        self.order = np.empty(n, np.int64)
        self.order[rank[:n]] = np.arange(n)

    def _reach(self, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
        """How many symbols are equal from i and j on, or before i and j; i < j."""
        out, levels, left = np.zeros(len(i), np.int64), [], np.arange(len(i))
        for k, rank in enumerate(self.ranks):
            a, b = i[left], j[left]
            if back:
                there = a >= 1 << k
                left, a, b = left[there], a[there] - (1 << k), b[there] - (1 << k)
            left = left[rank[a] == rank[b]]
            if not len(left):
                break
            levels.append(left)
        for k in range(len(levels) - 1, -1, -1):
            left, rank = levels[k], self.ranks[k]
            a, b = (i[left] - out[left], j[left] - out[left]) if back else (i[left] + out[left], j[left] + out[left])
            if back:
                there = a >= 1 << k
                left, a, b = left[there], a[there] - (1 << k), b[there] - (1 << k)
            out[left[rank[a] == rank[b]]] += 1 << k
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._reach(i, j, False)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._reach(i, j, True)

    def _smaller(self, step: int) -> np.ndarray:
        """For each place in the suffix array, the nearest one before (step -1) or after it whose suffix begins earlier
        in the text, or one that begins with another symbol, or -1 or n. Places that are not there yet take over what the
        place they point to has found so far."""
        n, order = self.n, self.order
        value = np.append(order, -1)  # the place -1 and the place n
        group = np.append(self.ranks[0][order], -1)
        near = np.arange(n) + step
        left = np.arange(n)
        while True:
            to = near[left]
            left = left[(group[to] == group[left]) & (value[to] > order[left])]
            if not len(left):
                return near
            near[left] = near[near[left]]

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Length and source of the longest earlier occurrence of what begins at each place."""
        length, source = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        for step in (-1, 1):
            near = self._smaller(step)
            there = (near >= 0) & (near < self.n)
            place, earlier = self.order[there], self.order[near[there]]
            common = self.forward(earlier, place)
            better = common > length[place]
            length[place[better]], source[place[better]] = common[better], earlier[better]
        return length, source


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row k counts[k] times, with the numbers 1 to counts[k]."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def find_runs(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start and period; codes: numbers of words."""
    n, found = int(offsets[-1]), [[] for _ in offsets[1:]]
    if not n:
        return found
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    suffixes = Suffixes(doc * (int(codes.max()) + 1) + codes)
    length, source = suffixes.previous_factors()

    # starts of blocks, and the end of each document as the start of an empty one
    after, starts = (np.arange(n) + np.maximum(length, 1)).tolist(), []
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        while first < last:
            starts.append(first)
            first = after[first]
        starts.append(last)
    starts = np.array(starts)
    own, before = np.diff(starts, append=n), np.diff(starts, prepend=0)

    # a run's first period lies before the start of its last block, or ends behind it
    row, period = _each(np.where(before > 0, (before + own) // (exponent - 1), 0))
    at = starts[row]
    low = offsets[np.searchsorted(offsets, at - 1, side="right") - 1]  # `at` may be the end of its document
    keep = at - period >= low
    i, j, p = (at - period)[keep], at[keep], period[keep]
    row, period = _each(own // (exponent - 1))
    i, j, p = np.concatenate([i, starts[row]]), np.concatenate([j, starts[row] + period]), np.concatenate([p, period])
    ahead = np.zeros(len(i), np.int64)
    inner = j < n
    ahead[inner] = suffixes.forward(i[inner], j[inner])
    back = suffixes.backward(i, j)
    keep = p + ahead + back >= np.maximum(least, exponent * p)
    first, last, p = (i - back)[keep], (j + ahead)[keep], p[keep]
    order = np.lexsort((p, last, first))
    first, last, p = first[order], last[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])  # a multiple of a period makes the same run

    buckets: list[dict[int, list[tuple[int, int]]]] = [{} for _ in found]
    for a, b, q in zip(first[new].tolist(), last[new].tolist(), p[new].tolist()):
        buckets[int(doc[a])].setdefault(a, []).append((b - a, q))
    for k in np.flatnonzero(own >= least + 2).tolist():
        at, size = int(starts[k]), int(own[k])
        bucket, begin = buckets[int(doc[at])], int(source[at])
        if bucket:
            for x in range(begin + 1, begin + size - least):
                for long, q in bucket.get(x, ()):
                    if x + long < begin + size:
                        bucket.setdefault(x + at - begin, []).append((long, q))
    for k, bucket in enumerate(buckets):
        low = int(offsets[k])
        found[k] = sorted(((a - low, long, q) for a, those in bucket.items() for long, q in those), key=lambda r: (r[0], r[2]))
    return found


def _made_periodic(doc_ids: list, offsets: np.ndarray) -> np.ndarray:
    """Which word stands at each place: its own, or, where the checksum of the id ends in 0, one of a repeated stretch."""
    source = np.arange(int(offsets[-1]))
    for k, doc_id in enumerate(doc_ids):
        n = int(offsets[k + 1] - offsets[k])
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            low = int(offsets[k])
            source[low + a : low + n] = low + a + np.arange(n - a) % p
    return source


def _digest(batch: pa.RecordBatch, periodic: bool) -> pa.RecordBatch:
    ids = batch.column("doc_id").to_pylist()
    offsets, words = split_words(batch.column("text"))
    if periodic:
        words = words.take(pa.array(_made_periodic(ids, offsets)))
    codes, _ = numbered(words)
    rows, kept = [], np.ones(len(words), bool)
    for a, b in by_size(np.diff(offsets), _WORDS):
        low = int(offsets[a])
        for k, runs in enumerate(find_runs(codes[low : int(offsets[b])], offsets[a : b + 1] - low), a):
            change = np.zeros(int(offsets[k + 1] - offsets[k]) + 1, np.int64)
            for start, length, period in runs:
                change[start + period] += 1
                change[start + length] -= 1
            if runs:
                kept[int(offsets[k]) : int(offsets[k + 1])] = np.cumsum(change[:-1]) == 0
            best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
            listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
            rows.append((len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), [list(r) for r in runs]))
    left = joined(words.filter(pa.array(kept)), np.concatenate([[0], np.cumsum(kept)])[offsets])
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
         pa.array(cols[6], pa.list_(pa.list_(pa.int64()))), pa.array([x.decode() for x in left], pa.string())],
        names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"],
    )


def collapse_runs(docs: DataFrame, made_periodic: bool = False) -> DataFrame:
    """doc_id; number of runs; start, length, period and floor of 1000 * length / period of the run of most periods;
    digests; all runs as [start, length, period]; and the text of the words that are left: those that no run holds after
    its first period. made_periodic: a tenth of the documents is made to repeat a stretch first, chosen by the checksum of
    the id (for tests with known content)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<array<bigint>>, collapsed string"
    return map_batches(rows, lambda batch: _digest(batch, made_periodic), schema)
