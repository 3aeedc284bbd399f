"""Filter interaction audit: what each quality filter removes, alone and after others, in every order of the filters.

Every document gets a mask of the filters that it fails. Four filters look at the text alone. The fifth fails copies: texts
identical to that of a smaller id, found by refining a partition of the table:

* Documents are split by their length in code points, then by a hash of their first block, then of the next, each 16 times
  as long as the one before. After each split the classes of one document are dropped. Texts beyond the first block are
  read only of documents that are left.
* The full texts of the documents that survive are compared. Where a class is of one text, as all are but by a collision
  of hashes, its copies are marked by class; else by the text itself. Those whose id isn't the smallest fail.

Documents are then counted by part and mask, at most 32 masks a part, and the report is computed from these counts.

Classes and the smallest ids are broadcast only after they are written and counted, else joined, hot ones spread by size;
counts combine before shuffles, so that no group of copies meets in one task.

Defined results: a null text is the empty one; a null lang is the part of the empty string. A null id is no smaller than
any id; where ids repeat, rows of the smallest id all pass. A document is good (toxic) if any of its label rows says so;
rows without an id have no labels. An empty table gives an empty report. Other columns are not read."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import materialise, remove, small, spread, text_column

#: The filters; a document fails filter k if bit k of its mask is set.
LETTERS = "ABCDE"
COPY = 1 << LETTERS.index("E")
#: Code points of the first block; each further one is _GROWTH times as long.
BLOCK, _GROWTH = 256, 16
_SPACE = " \t\n\x0b\x0c\r"


def failures(text: Column) -> Column:
    """Mask of the filters on the text alone: A under 200 words; B under half of the words distinct; C over 3 % capitals;
    D any of #$%&*|."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    # the words and their numbers are made once
    words = F.split(trimmed, r"[ \t-\r]+")
    facts = F.struct(F.when(trimmed == "", 0).otherwise(F.size(words)).alias("n"), F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words))).alias("d"))
    length, capitals = F.length(text), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = lambda f: (
        F.when(f["n"] < 200, 1).otherwise(0) + F.when(100 * f["d"] < 50 * f["n"], 2).otherwise(0)
        + F.when(100 * capitals > 3 * length, 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    )
    return F.element_at(F.transform(F.array(facts), bits), 1)


def _blocks():
    """(offset, size) of the blocks after the first."""
    offset, size = BLOCK, BLOCK * _GROWTH
    while True:
        yield offset, size
        offset, size = offset + size, size * _GROWTH


def _repeated(rows: DataFrame, key: str, extra: list | None = None) -> DataFrame:
    """Classes of more than one row, with their sizes, written."""
    return materialise(rows.groupBy(key).agg(F.count("*").alias("size"), *(extra or [])).where("size > 1"), "classes")


def _within(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """The rows whose class is one of the classes."""
    return rows.join(small(classes.select(key)), key, "left_semi")


def copies(docs: DataFrame, text: str, doc_id: str, keep: list[str], hashed=F.xxhash64, more: dict[str, Column] | None = None) -> DataFrame:
    """The rows (columns `keep`) whose text equals that of a row with a smaller id. hashed: of the blocks. more: columns
    that are computed for the documents left after the first block alone."""
    begun = docs.select("*", F.length(text).alias("__length"))
    lengths = _repeated(begun, "__length")
    begun = _within(begun, lengths, "__length").withColumn("__class", hashed("__length", F.substring(text, 1, BLOCK)))
    classes = _repeated(begun, "__class")
    alive = materialise(_within(begun, classes, "__class").withColumns(more or {}), "alive")
    remove(docs.sparkSession, lengths)
    longest = alive.agg(F.max("__length")).first()[0] or 0
    left = alive
    for offset, size in _blocks():
        if offset >= longest:
            break
        finer = F.when(F.col("__length") > offset, hashed("__class", F.substring(F.col(text), offset + 1, size))).otherwise(F.col("__class"))
        left = left.withColumn("__class", finer)
        classes = _repeated(left, "__class")
        left = _within(left, classes, "__class")

    # full texts
    texts = materialise(left.groupBy("__class", text).agg(F.min(doc_id).alias("__low"), F.count("*").alias("__n")), "texts")
    one = materialise(texts.groupBy("__class").agg(F.min("__low").alias("__low"), F.sum("__n").alias("__n"), F.count("*").alias("__texts")).where("__n > 1"), "classes")
    of, by = spread(left.select(*keep, "__class", *([doc_id] if doc_id not in keep else [])), one.where("__texts = 1"), ["__class"], "__n", F.coalesce(F.col(doc_id), F.lit(0)))
    late = (F.col(doc_id) > F.col("__low")) | (F.col(doc_id).isNull() & F.col("__low").isNotNull())
    found = of.join(small(by.select("__class", "__salt", "__low")), ["__class", "__salt"]).where(late).select(*keep)
    mixed = _within(left, one.where("__texts > 1"), "__class")
    again = texts.where("__n > 1").join(small(one.where("__texts > 1").select("__class")), "__class").select("__class", text, "__low")
    return found.unionAll(mixed.join(again, ["__class", text]).where(late).select(*keep))


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the numbers of documents, good ones and toxic ones; written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_column(docs).alias("text"))
    mask = failures(F.col("text"))
    known = (
        labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    known = small(materialise(known, "labels"))
    counted = [F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")]
    whole = rows.select("id", "part", mask.alias("mask")).join(known, "id", "left").groupBy("part", "mask").agg(*counted)
    late = materialise(copies(rows, "text", "id", ["id", "part", "mask"], more={"mask": mask}).join(known, "id", "left").groupBy("part", "mask").agg(*counted), "late")
    less = late.select("part", "mask", *(F.negate(c).alias(c) for c in ("n", "good", "toxic")))
    more = late.withColumn("mask", F.col("mask").bitwiseOR(COPY))
    summed = [F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]
    return materialise(whole.unionAll(less).unionAll(more).groupBy("part", "mask").agg(*summed), "counts")


def report(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """For every part, order of the filters and step: what is kept after the step, removed by it, failing its filter but
    removed before, and failing its filter alone; good and toxic documents that it removes; and the filter's removals
    summed over all orders (its Shapley value times their number)."""
    orders = ["".join(p) for p in permutations(letters)]
    rows = (
        counted.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
        .withColumn("bit", F.expr(f"shiftleft(1, locate(substring(filter_order, step, 1), '{letters}') - 1)"))
        .withColumn("prior", F.expr(f"aggregate(sequence(1, step), 0, (sum, k) -> sum + shiftleft(1, locate(substring(filter_order, k, 1), '{letters}') - 1)) - bit"))
    )
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("prior")) != 0
    number = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).cast("long")
    # a document is removed by the first filter that it fails: each of its filters in an equal share of the orders
    share = F.when(fails, F.col("n") * (F.lit(len(orders)) / F.bit_count("mask")).cast("long"))
    return rows.groupBy("part", "filter_order", "step").agg(
        number(~fails & ~gone).alias("kept"), number(fails & ~gone).alias("removed"), number(fails & gone).alias("redundant"), number(F.col("mask") == F.col("bit")).alias("unique_fails"),
        number(fails & ~gone, "good").alias("good_lost"), number(fails & ~gone, "toxic").alias("toxic_lost"), F.coalesce(F.sum(share), F.lit(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over whole documents."""
    return report(counts(docs, labels))
