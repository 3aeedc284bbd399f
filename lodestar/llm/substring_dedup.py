"""Substring deduplication: words of windows that also start earlier in the table go, found by a count-min prefilter.

Documents are dealt once, by their id, to groups of `GROUP_BYTES` of text, written as a bucketed table that three passes
read without moving texts again:

1. Each group adds its windows of `window` words to a count-min sketch of two rows. A row has at least a counter for every
   two bytes of text, so it grows with the input; it is cut into blocks, and a group hands over only the counters that it
   raised. Each block adds up what all groups hand over, and answers every group with those of its counters that are two or
   more. No task, and not the driver, holds more of the sketch than a block.
2. A window whose counters are two or more in both rows is estimated to be repeated. Estimates are never below the counts,
   so no repeated window is lost. Of those windows alone, each group hands over a 128-bit digest of the words with its
   first place; tasks for ranges of digests group them exactly and answer with the first place of each in the table.
3. A window estimated to be repeated that is not the first of its words is a repeat; the words that repeats cover go.

A group hands over each window once however often it has it, so that no key is hot; messages hold many counters or digests
each, and are never more than the windows.

Memory: a task holds a group (about 15 times its text) or a block of 2^22 counters and what raised them.

Defined results: a null or empty text has no words. Of rows that repeat an id, the one whose text sorts first counts as
earlier; rows without an id count as later than all others, in the order of a hash of their texts. Texts of any length are
taken whole: a document longer than a group is a group of its own size. A table without rows gives one without rows. Other
columns are not read."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, shared_dir, text_column
from lodestar.llm.words import joined, numbered, split_words

WINDOW = 20
#: Bytes of text that are handled together.
GROUP_BYTES = 6 << 20
#: Counters of a block of the sketch.
_BLOCK_BITS = 22
_ROWS = 2
_LAST = (1 << 63) - 1


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """64-bit numbers, well mixed (multiplications and shifts of SplitMix64; fixed values)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: the high ones, mostly zero, then compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def _unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=0).astype(np.uint32))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint32).astype(np.int64))


class _Group:
    """The documents of a group in the order of their ids: words, and the windows within documents."""

    def __init__(self, rows: pa.Table, window: int):
        order = pc.sort_indices(rows, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])  # nulls come last
        rows = rows.select(["doc_id", "text"]).take(order).combine_chunks()
        self.ids = rows["doc_id"].combine_chunks()
        self.offsets, self.words = split_words(rows["text"].combine_chunks())
        self.window, n = window, len(self.words)
        del rows
        left = np.repeat(self.offsets[1:], np.diff(self.offsets))
        left -= np.arange(n)
        self.starts = np.flatnonzero(left >= window)
        del left
        codes, vocabulary = numbered(self.words)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.as_py()) for w in vocabulary), np.uint64, len(vocabulary))[codes]
        del codes, vocabulary
        whole = np.zeros(max(0, n - window + 1), np.uint64)
        for k in range(window):
            whole *= np.uint64(0x9E3779B97F4A7C15)
            whole += hashes[k : len(whole) + k]
        del hashes
        self.hashes = whole[self.starts]

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows' counters in a row of the sketch, in order, and the places of the windows."""
        cells = (_mixed(self.hashes, row) >> np.uint64(64 - bits)).astype(np.int64)
        low = max(1, len(cells).bit_length())
        if bits + low < 63:
            both = np.sort(cells << low | np.arange(len(cells)))
            return both >> low, both & ((1 << low) - 1)
        order = np.argsort(cells, kind="stable")
        return cells[order], order

    def estimated_repeats(self, answers: pa.Table, bits: int) -> np.ndarray:
        """Places of the windows whose counters are two or more in every row."""
        hits = np.zeros(len(self.starts), np.int64)
        for row in range(_ROWS):
            of = answers.filter(pc.equal(answers["row"], row))
            raised = [(int(b) << _BLOCK_BITS) + _unpack_sorted(c) for b, c in zip(of["block"].to_pylist(), of["cells"].to_pylist())]
            if not raised:
                continue
            cells, place = self.cells(row, bits)
            raised = np.sort(np.concatenate(raised))
            change = np.zeros(len(cells) + 1, np.int64)
            change[np.searchsorted(cells, raised, "left")] += 1  # distinct counters that some window has: distinct places
            change[np.searchsorted(cells, raised, "right")] -= 1
            hits[place[np.cumsum(change[:-1]) > 0]] += 1
        return self.starts[hits == _ROWS]

    def digests(self, places: np.ndarray) -> np.ndarray:
        """Two 64-bit numbers for each window that starts at one of the places: a digest of its words."""
        if not len(places):
            return np.zeros((0, 2), np.uint64)
        text = joined(self.words, np.array([0, len(self.words)]))[0]
        lengths = np.asarray(pc.binary_length(self.words), dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(lengths + 1)])
        digest = xxhash.xxh3_128_digest
        return np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip(first[places].tolist(), (first[places + self.window] - 1).tolist())]), np.uint64).reshape(-1, 2)


def _raised(rows: pa.Table, window: int, bits: int) -> pa.Table:
    """Counters that a group raises, by row and block; those raised more than once are listed twice."""
    group, out = _Group(rows, window), []
    for row in range(_ROWS):
        cells, _ = group.cells(row, bits)
        third = np.zeros(len(cells), bool)
        third[2:] = cells[2:] == cells[:-2]
        cells = cells[~third]
        block = cells >> _BLOCK_BITS
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(cells)]]) if len(cells) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            out.append((row, int(block[a]), rows["grp"][0].as_py(), _pack_sorted(cells[a:b] & ((1 << _BLOCK_BITS) - 1))))
    row, block, grp, cells = zip(*out) if out else ((), (), (), ())
    return pa.table({"row": pa.array(row, pa.int32()), "block": pa.array(block, pa.int64()), "grp": pa.array(grp, pa.int64()), "cells": pa.array(cells, pa.binary())})


def _merged(messages: pa.Table) -> pa.Table:
    """For each group, those of its counters in this block that are two or more over all groups."""
    cells = [_unpack_sorted(c) for c in messages["cells"].to_pylist()]
    counts = np.zeros(1 << _BLOCK_BITS, np.uint8)
    for c in cells:
        new = np.ones(len(c), bool)
        new[1:] = c[1:] != c[:-1]
        counts[c[new]] = np.minimum(counts[c[new]] + 1, 2)
        counts[c[~new]] = 2
    again = counts == 2
    found = [np.unique(c[again[c]]) for c in cells]
    keep = pa.array([len(c) > 0 for c in found], pa.bool_())
    return messages.set_column(messages.schema.get_field_index("cells"), "cells", pa.array([_pack_sorted(c) for c in found], pa.binary())).filter(keep).select(["row", "block", "grp", "cells"])


def _keys(rows: pa.Table, answers: pa.Table, window: int, bits: int, ranges: int) -> pa.Table:
    """Digests of the group's estimated repeats, each with its first place, by ranges of digests."""
    group, out = _Group(rows, window), []
    places = group.estimated_repeats(answers, bits)
    keys = group.digests(places)
    order = np.lexsort((keys[:, 1], keys[:, 0]))  # stable: the first of equal ones is the first place
    keys, places = keys[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    keys, places = keys[new], places[new]
    ids = np.asarray(pc.fill_null(group.ids, _LAST), dtype=np.int64)
    docs = ids[np.searchsorted(group.offsets, places, side="right") - 1]
    part = (keys[:, 0] >> np.uint64(32)).astype(np.int64) * ranges >> 32
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        out.append((int(part[a]), rows["grp"][0].as_py(), np.ascontiguousarray(keys[a:b]).tobytes(), _pack(docs[a:b]), _pack(places[a:b].astype(np.uint32))))
    part, grp, keys, docs, places = zip(*out) if out else ((),) * 5
    return pa.table({"part": pa.array(part, pa.int64()), "grp": pa.array(grp, pa.int64()), "keys": pa.array(keys, pa.binary()), "docs": pa.array(docs, pa.binary()), "places": pa.array(places, pa.binary())})


def _firsts(messages: pa.Table) -> pa.Table:
    """For each group, the places at which a digest of this range stands first in the table."""
    if not messages.num_rows:
        return pa.table({"grp": pa.array([], pa.int64()), "places": pa.array([], pa.binary())})
    keys = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in messages["keys"].to_pylist()]
    sizes, keys = [len(k) for k in keys], np.concatenate(keys)
    docs = np.concatenate([_unpack(d, np.int64) for d in messages["docs"].to_pylist()])
    places = np.concatenate([_unpack(p, np.uint32) for p in messages["places"].to_pylist()])
    groups = np.asarray(messages["grp"], dtype=np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((places, groups[own], docs, keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    won = np.sort(order[new])
    parts = np.split(places[won], np.searchsorted(own[won], np.arange(1, len(sizes))))
    return pa.table({"grp": pa.array(groups, pa.int64()), "places": pa.array([_pack(p) for p in parts], pa.binary())})


def _left(rows: pa.Table, answers: pa.Table, window: int, bits: int) -> pa.Table:
    """The documents of a group without the words that repeats cover."""
    group = _Group(rows, window)
    first = [_unpack(p, np.uint32) for p in answers["places"].to_pylist() if p]
    places = np.setdiff1d(group.estimated_repeats(answers, bits), np.concatenate(first) if first else np.zeros(0, np.uint32), assume_unique=True)
    change = np.zeros(len(group.words) + 1, np.int64)
    change[places] += 1
    np.add.at(change, places + window, -1)
    kept = np.cumsum(change[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(kept)])[group.offsets]
    n, left = np.diff(group.offsets), np.diff(before)
    texts = joined(group.words.filter(pa.array(kept)), before)
    return pa.table({"doc_id": pc.cast(group.ids, pa.int64()), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - left, pa.int64()), "text": pa.array([x.decode() for x in texts], pa.string())})


def dedup_substrings(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and text (the words that are left, joined by one space) of every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups = int(size // group_bytes + 1)
    bits = max(8, int(size // 2).bit_length())
    ranges = max(1, 1 << bits >> _BLOCK_BITS)
    dealt = rows.withColumn("grp", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(groups)))
    name = f"lodestar_dealt_{uuid.uuid4().hex}"
    dealt.repartition(groups, "grp").write.bucketBy(groups, "grp").sortBy("grp").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    dealt = spark.table(name)

    message = "row int, block long, grp long, cells binary"
    raised = dealt.groupBy("grp").applyInArrow(lambda t: _raised(t, window, bits), message)
    answers = materialise(raised.groupBy("row", "block").applyInArrow(_merged, message), "repeats")
    keys = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(lambda t, a: _keys(t, a, window, bits, ranges), "part long, grp long, keys binary, docs binary, places binary")
    firsts = materialise(keys.groupBy("part").applyInArrow(_firsts, "grp long, places binary"), "firsts")
    both = answers.withColumn("places", F.lit(None).cast("binary")).unionByName(firsts, allowMissingColumns=True)
    return dealt.groupBy("grp").cogroup(both.groupBy("grp")).applyInArrow(lambda t, a: _left(t, a, window, bits), "doc_id long, n_words long, n_removed long, text string")
