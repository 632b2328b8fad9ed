"""Tables that outlive an executor, and connected components over a link table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read from there, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (a local run)
    a temporary folder is made for it. A written table, unlike a checkpoint, does not inherit the
    size that was estimated for the plan behind it: in rounds of joins that number gains digits
    until the driver's memory is full of them.
    """
    spark, kind = df.sparkSession, df.schema
    path = f"{_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(kind).parquet(path)
    out.settled_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing will read again."""
    jvm, path = df.sparkSession.sparkContext._jvm, getattr(df, "settled_at", None)
    if path:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of an Arrow batch at most: a row holds a whole document, and the JVM keeps two batches of a
#: task, and Python as many, besides what is made of them.
BATCH = 1000


def in_batches(documents: DataFrame) -> DataFrame:
    """``documents``, whose session from now on hands rows to Python in batches of at most BATCH."""
    conf, name = documents.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(conf.get(name))
    if given <= 0 or given > BATCH:
        conf.set(name, str(BATCH))
    return documents


def one_per_id(documents: DataFrame, most: int, seed: int) -> DataFrame:
    """(text) of the ids of the ``most`` rows of least hashed id; of an id in several rows the text
    of least hash. Only the ids, bounded by ``most``, are broadcast."""
    ids = in_batches(documents).where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most).distinct()
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"))).alias("row")).select("row.text")


_local: list[str] = []


def _folder(spark: SparkSession) -> str:
    given = spark.conf.get("spark.checkpoint.dir", "")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="settled-"))
    return _local[0]


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b); a component is its least id.

    Each round every id takes the least label around it, then its label's own label; rounds
    needed grow with the logarithm of a component's width. Links of an id with many neighbours
    are combined before the shuffle, so a star does not gather in one task.
    """
    both = settle(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    before = None
    while True:
        around = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(around, labels["id"] == around["a"]).select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("k"), F.col("label").alias("higher"))
        jumped = new.join(up, new["label"] == up["k"], "left").select("id", F.least("label", F.coalesce("higher", "label")).alias("label"), "old")
        settled = settle(jumped)
        if before is not None:
            discard(before)
        if not settled.where("label <> old").limit(1).count():
            discard(both)
            return settled.select("id", F.col("label").alias("component"))
        before, labels = settled, settled.select("id", "label")
