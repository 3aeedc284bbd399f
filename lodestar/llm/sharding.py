"""Sharding by proportional stratified interleaving, with equal texts together.

Every group of equal texts has a home: groups are shuffled by a seeded hash within their source (the first of their
sources), and a group goes where the middle of its stretch of the source's grouped rows falls, so each source's groups
spread evenly over the shards. All other rows are shuffled and ranked within each source; what a source still owes a shard
after its groups is its quota there, and the row's fractional rank, read against the quotas of shards one after the other,
is its place between 0 and the number of shards. Sorted by place and cut where each shard is full, the rows give shards
whose counts differ by one at most, and in which each source has its share, up to the few rows that a cut between ties can
shift. Within a shard the grouped rows are spread evenly between the others.

A group is divided only where counts forbid to keep it whole: if it has more than a sixteenth of all rows for eight shards
(half a shard), or where the groups of a shard, in the order of their hashes, would overfill it. Its rows then count like
others. A source whose groups are larger than its share of a shard has more there and less elsewhere.

No ranking puts a source, a group or the whole into one task: rows fall into buckets by their hash (a group larger than a
bucket into several of its own) or place; a row's rank is the number of rows in the buckets before its own, from a small
table of counts, plus its place in its bucket. The number of buckets follows the number of rows. Texts do not move: a row
is its id, source, size, checksum and two hashes.

Defined results: a null text counts as empty for size and checksum; null sources are a source of their own; null ids are
hashed as text 'null'; ids that repeat are told apart by checksum and size, so rows that are equal in all of these share an
order that may vary; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import BROADCAST_ROWS, materialise, spread

SHARDS = 8
PER_BUCKET = 5_000
_CHUNK = 1_000
_TIE = ["__hash", "__own", "doc_id", "text_crc32", "size"]


def _with_rank(rows: DataFrame, group: str | None, bucket: Column, order: list, name: str, weight: str | None = None) -> DataFrame:
    """rows with a gapless rank from 0 by (bucket, order) within group, each bucket ranked in a task of its own; with a
    weight, the sum of the weights before. bucket: a struct whose first field, b, is a number."""
    keys = ([group] if group else []) + ["__bucket"]
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    # bucket counts are added up in chunks of buckets first, so that one task orders few of them at any size
    counts = counts.withColumn("__chunk", F.floor(F.col("__bucket.b") / _CHUNK).cast("long"))
    own = [group] if group else []
    chunks = counts.groupBy(*own, "__chunk").agg(F.sum("__n").alias("__c"))
    over = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
    chunks = chunks.withColumn("__lead", F.sum("__c").over(over.orderBy("__chunk")) - F.col("__c")).drop("__c")
    within = Window.partitionBy(*own, "__chunk").orderBy("__bucket")
    offsets = counts.withColumn("__in", F.sum("__n").over(within) - F.col("__n")).join(chunks, [*own, "__chunk"])
    offsets = offsets.select(*keys, (F.col("__lead") + F.col("__in")).alias("__before"))
    place = Window.partitionBy(*keys).orderBy(*order)
    if weight:
        placed = rows.withColumn("__place", F.sum(weight).over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight))
    else:
        placed = rows.withColumn("__place", F.row_number().over(place) - 1)
    return placed.join(offsets, keys).withColumn(name, F.col("__before") + F.col("__place")).drop("__bucket", "__before", "__place")


def _part(column: str, parts: str) -> Column:
    """Number of a hash's part, of so many."""
    return F.expr(f"cast(conv(substring({column}, 1, 8), 16, 10) as long) * {parts} div {1 << 32}")


def _held(homes: DataFrame) -> dict[int, int]:
    """Rows of whole groups by shard."""
    return {r[0]: r[1] for r in homes.where("__home is not null").groupBy("__home").agg(F.sum("__copies")).collect()}


def interleave(docs: DataFrame, seed: int = 0, shards: int = SHARDS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # size and checksum tell rows of one id apart
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.crc32(text.cast("binary")).cast("string"), (F.octet_length(text) + 1).cast("string"))
    shuffled = F.md5(F.concat(F.lit(f"{seed}|"), text).cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("__source"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), shuffled.alias("__hash"), F.md5(name.cast("binary")).alias("__own"),
    )
    rows = materialise(rows, "sharding")
    total = rows.count()
    buckets = max(1, -(-total // per_bucket))
    counted = rows.groupBy("__hash").agg(F.count("*").alias("__copies"), F.min("__source").alias("__first")).where("__copies > 1")

    # homes of groups; large groups, whole or not, are known too, as they are dealt to several tasks wherever rows are ranked
    by_hash = F.struct(_part("__hash", str(buckets)).alias("b"))
    whole = _with_rank(counted.where(F.col("__copies") * (2 * shards) <= total), "__first", by_hash, ["__hash"], "__lead", "__copies")
    masses = counted.where(F.col("__copies") * (2 * shards) <= total).groupBy("__first").agg(F.sum("__copies").alias("__mass"))
    whole = whole.join(masses, "__first")
    homes = whole.select("__hash", "__copies", F.expr(f"cast({shards} * (2 * __lead + __copies) div (2 * __mass) as int)").alias("__home"))
    large = counted.where((F.col("__copies") * (2 * shards) > total) & (F.col("__copies") > per_bucket)).select("__hash", "__copies", F.lit(None).cast("int").alias("__home"))
    known = materialise(homes.union(large), "homes")
    held = _held(known)
    if max(held.values(), default=0) > total // shards:
        room = _with_rank(known.where("__home is not null"), "__home", by_hash, ["__hash"], "__lead", "__copies")
        room = room.withColumn("__home", F.when(F.col("__lead") + F.col("__copies") <= total // shards, F.col("__home"))).drop("__lead")
        known = materialise(room.unionByName(known.where("__home is null")).where(f"__home is not null or __copies > {per_bucket}"), "homes")
        held = _held(known)
    if known.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(known), "__hash", "left")
    else:
        left, right = spread(rows, known, ["__hash"], "__copies", F.col("__own"))
        rows = left.join(right, ["__hash", "__salt"], "left").drop("__salt")

    # what each source owes each shard beside its groups, in parts of a row; and where a row of a rank goes
    cells = rows.groupBy("__source", "__home").agg(F.count("*").alias("n"))
    mine = [F.coalesce(F.sum(F.when(F.col("__home") == k, F.col("n"))), F.lit(0)).alias(f"g{k}") for k in range(shards)]
    quotas = cells.groupBy("__source").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("__home").isNull(), F.col("n"))), F.lit(0)).alias("__others"), *mine)
    owed = F.array(*(F.greatest(F.lit(0).cast("long"), F.col("n") - shards * F.col(f"g{k}")) for k in range(shards)))
    quotas = quotas.select("__source", "__others", owed.alias("__owed"))
    before = [F.lit(0).cast("long")]
    for k in range(shards):
        before.append(before[-1] + F.col("__owed")[k])
    quotas = quotas.withColumn("__upto", F.array(*before))

    own = F.when(F.col("__copies") > per_bucket, F.col("__hash")).otherwise("")
    within = F.when(F.col("__copies") > per_bucket, _part("__own", f"(__copies div {per_bucket} + 1)")).otherwise(F.lit(0).cast("long"))
    bucket = F.struct(_part("__hash", str(buckets)).alias("b"), own.alias("group"), within.alias("part"))
    single = _with_rank(rows.where("__home is null").withColumn("__bucket", bucket), "__source", F.col("__bucket"), _TIE, "__rank").join(quotas, "__source")
    at = F.expr(f"cast(2 * __rank + 1 as double) * __upto[{shards}] / (2 * __others)")
    single = single.withColumn("__at", at).withColumn("__k", F.expr("size(filter(__upto, x -> x <= __at)) - 1"))
    single = single.withColumn("__time", F.expr("__k + (__at - __upto[__k]) / __owed[__k]")).drop("__rank", "__at", "__k", "__owed", "__upto", "__others", "__copies")
    # the order is that of the doubles: places closer than 2^-53 count as equal, and then go by source
    placed = _with_rank(materialise(single, "places"), None, F.struct(F.floor(F.col("__time") * buckets / shards).cast("long").alias("b")), ["__time", "__source", *_TIE], "__at")

    # of shard k, `full` rows, `held` of them in groups; the others begin at `first`
    full = [(k + 1) * total // shards - k * total // shards for k in range(shards)]
    first = [0]
    for k in range(shards):
        first.append(first[-1] + full[k] - held.get(k, 0))
    of = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    shard = F.size(F.filter(of(first[1:]), lambda x: x <= F.col("__at")))
    placed = placed.withColumn("__shard", shard).withColumns({"__j": F.col("__at") - of(first)[F.col("__shard")], "__g": of([held.get(k, 0) for k in range(shards)])[F.col("__shard")], "__f": of([full[k] - held.get(k, 0) for k in range(shards)])[F.col("__shard")]})
    # grouped row r of G stands behind the first F * (2 r + 1) div (2 G) of the F others
    ahead = F.expr("greatest(0, least(__g, (2 * cast(__g as decimal(18, 0)) * (__j + 1) + __f - 1) div (2 * __f)))")
    out = ["doc_id", "source", "size", "text_crc32"]
    others = placed.select(*out, F.col("__shard").cast("int").alias("shard"), (F.col("__j") + ahead).cast("long").alias("slot"))
    grouped = _with_rank(rows.where("__home is not null").withColumn("__bucket", bucket), "__home", F.col("__bucket"), _TIE, "__r")
    grouped = grouped.withColumns({"__g": of([held.get(k, 0) for k in range(shards)])[F.col("__home")], "__f": of([full[k] - held.get(k, 0) for k in range(shards)])[F.col("__home")]})
    return others.union(grouped.select(*out, F.col("__home").alias("shard"), F.expr("__r + cast(__f as decimal(18, 0)) * (2 * __r + 1) div (2 * __g)").cast("long").alias("slot")))
