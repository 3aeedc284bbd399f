"""Exact deduplication by content-defined chunk recipes.

Every text is cut where a rolling hash of its last 32 bytes says so. A text then is an ordered list of chunk
identifiers, its recipe, and texts are compared by recipe. Whole texts never move between machines: what is shuffled
is recipes (16 bytes for about 4 kB of text) and, to verify identifiers, one copy per task of each chunk that occurs
in a candidate group. A digest that turns out to stand for several contents is replaced by a longer identifier made
of the digest and a second, independent hash of the content, so equal recipes always mean equal texts.

Defined results: null text counts as the empty text (an empty recipe); texts of any length are taken whole; of rows
that repeat both id and text one stays; null ids sort below all others; an empty table gives an empty result; columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import map_batches, materialise, small, spread, text_column, without

CHUNK_BITS = 12
MAX_CHUNK = 1 << 16
_WINDOW = 32
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), dtype=np.uint32)


def cut_points(data: bytes, bits: int = CHUNK_BITS, longest: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of data: after each position whose rolling hash has `bits` leading zeros, and where a chunk
    would grow beyond `longest`."""
    size = len(data)
    if not size:
        return []
    cuts: list[int] = []
    block, at, last = 1 << 20, 0, 0
    while at < size:
        start = max(0, at - _WINDOW + 1)
        h = _GEAR[np.frombuffer(data, dtype=np.uint8, count=min(size, at + block) - start, offset=start)]
        width = 1
        while width < _WINDOW:
            longer = h.copy()
            longer[width:] += h[:-width] << np.uint32(width)
            h, width = longer, width * 2
        for cut in (np.flatnonzero((h[at - start :] >> np.uint32(32 - bits)) == 0) + at + 1).tolist():
            while cut - last > longest:
                last += longest
                cuts.append(last)
            if cut > last:
                cuts.append(cut)
                last = cut
        at += block
    while size - last > longest:
        last += longest
        cuts.append(last)
    if last < size:
        cuts.append(size)
    return cuts


def chunks(data: bytes, bits: int = CHUNK_BITS, longest: int = MAX_CHUNK) -> list[bytes]:
    ends = cut_points(data, bits, longest)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(docs: DataFrame, digest_bytes: int = 16, bits: int = CHUNK_BITS) -> DataFrame:
    """doc_id, row_no, text_sha256, recipe (array of chunk digests) of every row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        shas, lists = [], []
        for text in batch.column("text").to_pylist():
            data = text.encode("utf-8", "surrogatepass")
            shas.append(hashlib.sha256(data).hexdigest())
            lists.append([_digest(c, digest_bytes) for c in chunks(data, bits)])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_no"), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.binary()))],
            names=["doc_id", "row_no", "text_sha256", "recipe"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), text_column(docs).alias("text"))
    return map_batches(rows, make, "doc_id long, row_no long, text_sha256 string, recipe array<binary>")


def _chunk_contents(docs: DataFrame, digest_bytes: int, bits: int) -> DataFrame:
    """digest, content, once for each chunk and batch."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = {}
        for text in batch.column("text").to_pylist():
            for c in chunks(text.encode("utf-8", "surrogatepass"), bits):
                seen.setdefault(c, _digest(c, digest_bytes))
        return pa.RecordBatch.from_arrays([pa.array(list(seen.values()), pa.binary()), pa.array(list(seen), pa.binary())], names=["digest", "content"])

    return map_batches(docs.select(text_column(docs).alias("text")), make, "digest binary, content binary")


def exact_dedup(docs: DataFrame, digest_bytes: int = 16, bits: int = CHUNK_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the
    largest doc_id is kept."""
    rows = materialise(recipes(docs, digest_bytes, bits), "recipes")
    found = materialise(_grouped(rows), "groups")

    # verify: within groups of several rows a digest must stand for one content
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    # a table of its own, so that its size is known and texts stay where they are if it is small
    wanted = materialise(found.where(F.col("group_size") > 1).select("doc_id").distinct(), "candidates")
    wanted = small(wanted)
    contents = _chunk_contents(texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi"), digest_bytes, bits)
    clashes = contents.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low <> high").select("digest")
    clashes = materialise(clashes, "clashes")
    if clashes.isEmpty():
        return found
    return _grouped(materialise(_with_long_identifiers(docs, rows, clashes, digest_bytes, bits), "identified"))


def _grouped(rows: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 by equal recipes. A large group is spread over as many tasks as its
    size asks for, after its partial aggregates have met."""
    best = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row_no")).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    left, right = spread(rows, materialise(best, "copies"), ["recipe"], "group_size", F.col("row_no"))
    joined = left.join(right, ["recipe", "__salt"], "left")
    own = F.col("best").isNull()
    return joined.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (own | (F.col("row_no") == F.col("best.row_no"))).alias("kept"), "text_sha256",
    )


def _with_long_identifiers(docs: DataFrame, rows: DataFrame, clashes: DataFrame, digest_bytes: int, bits: int) -> DataFrame:
    """rows with every clashing digest in a recipe replaced by digest and SHA-512 of the chunk. Only texts that have
    such a digest are read again, each different one once."""
    entries = rows.select("text_sha256", F.explode("recipe").alias("digest")).join(clashes, "digest", "left_semi")
    hit = entries.groupBy("text_sha256").agg(F.collect_set("digest").alias("bad"))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, bad in zip(batch.column("text").to_pylist(), batch.column("bad").to_pylist()):
            bad, ids = set(bad), []
            for c in chunks(text.encode("utf-8", "surrogatepass"), bits):
                d = _digest(c, digest_bytes)
                ids.append(d + hashlib.sha512(c).digest() if d in bad else d)
            out.append(ids)
        return pa.RecordBatch.from_arrays([batch.column("text_sha256"), pa.array(out, pa.list_(pa.binary()))], names=["text_sha256", "longer"])

    texts = docs.select(F.sha2(text_column(docs), 256).alias("text_sha256"), text_column(docs).alias("text"))
    texts = texts.join(hit, "text_sha256").groupBy("text_sha256").agg(F.min("text").alias("text"), F.first("bad").alias("bad"))
    longer = map_batches(texts, make, "text_sha256 string, longer array<binary>")
    return rows.join(longer, "text_sha256", "left").select("doc_id", "row_no", "text_sha256", F.coalesce("longer", "recipe").alias("recipe"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() drops; all columns stay. Rows go by id, and texts do not move while the
    ids that go are few enough to broadcast. Only rows of an id that has kept and dropped rows are told apart by text."""
    found = materialise(exact_dedup(docs), "exact")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("long")).alias("kept"))
    gone = materialise(ids.where("kept = 0").select("doc_id"), "dropped")
    mixed = materialise(ids.where("kept > 0 and kept < n").select("doc_id"), "mixed")
    if mixed.isEmpty():
        return without(docs, gone)
    some = small(mixed.select(F.col("doc_id").alias("__id")))
    some = docs.join(some, docs["doc_id"].cast("long").eqNullSafe(some["__id"]), "left_semi")
    some = some.withColumn("__key", F.struct(F.col("doc_id").cast("long").alias("a"), F.sha2(text_column(some), 256).alias("b")))
    stay = found.where("kept").select(F.struct(F.col("doc_id").alias("a"), F.col("text_sha256").alias("b")).alias("__key"))
    some = some.join(stay, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")
    return without(without(docs, gone), mixed).unionByName(some)
