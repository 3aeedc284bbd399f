"""Helpers shared by the operators: reading, shared storage, Arrow mapping, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset (tests on one
    machine) a local folder is chosen."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again. This cuts the lineage, survives lost executors, and makes
    later passes cheap."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of at most so many ids are broadcast.
BROADCAST_ROWS = 1_000_000
#: A key with more rows is spread over several tasks.
HOT_ROWS = 20_000


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it is written and counted to be small; its rows must be short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column, written, no repeats; a null there is an id). Texts stay
    where they are if the ids are few enough to broadcast; else they are shuffled by id once."""
    gone = small(ids.select(ids[0].alias("__gone"), F.lit(True).alias("__is")))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["__gone"]), "left_anti")


def spread(left: DataFrame, right: DataFrame, on: list[str], size: str, by: Column, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column __salt to join on as well: a key whose `size` (number of rows in left, a column of right)
    is above `hot` is spread over size / hot tasks by the hash of `by`. At most rows / hot keys are that large; their
    hashes are a table of that size, broadcast while it is small."""
    hot = hot or HOT_ROWS
    key = F.xxhash64(*on)
    large = right.where(F.col(size) > hot).groupBy(key.alias("__key")).agg(F.max(F.ceil(F.col(size) / hot)).cast("long").alias("__salts"))
    large = small(materialise(large, "hot"))
    salts = F.coalesce("__salts", F.lit(1).cast("long"))
    a = left.withColumn("__key", key).join(large, "__key", "left").withColumn("__salt", F.pmod(F.xxhash64(by), salts)).drop("__key", "__salts")
    b = right.withColumn("__key", key).join(large, "__key", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("__key", "__salts")
    return a, b


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1024) -> DataFrame:
    """Apply fn to Arrow slices of at most `rows` rows, so that a worker holds few Python objects at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_column(df: DataFrame, name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def in_training_fold(doc_id) -> object:
    """crc32 of the id's text modulo 5 is not 0; null ids are never trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 != 0, F.lit(False))


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """(text, label) of at most per_class rows of either class, taken in the order of a hash of the id, from the
    training folds only. Bounded by 2 * per_class rows; whole texts. Only the ids that are taken travel to the text scan."""
    spark = docs.sparkSession
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & in_training_fold(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    chosen = []
    for value in (0, 1):
        chosen += known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    if not chosen:
        return []
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, r.label) for r in chosen], "doc_id long, label int"))
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text")).join(ids, "doc_id")
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    )
    rows.sort(key=lambda r: r.doc_id)
    return [(r.text, r.label) for r in rows]
