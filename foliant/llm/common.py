"""What the training-data operators share: staged tables, bounded Arrow batches
and reading of the input tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is made and set in local mode (tests);
    on a cluster that is an error, for executors would write to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="foliant-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/foliant/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage: a lost executor costs a re-read and not a recompute,
    and values such as row numbers stay what they were.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """Inner join on keys of which one may hold any share of the rows.

    counted: staged, one row a key, with ``n``, the number of rows that have it.  A key with
    more than one in ``share`` of these is heavy; fewer than ``share`` keys can be, so they are
    broadcast and their rows stay where they are.  Rows of all other keys are shuffled.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    heavy, light = counted.where(F.col("n") * share > total), counted.where(F.col("n") * share <= total)
    spread = rows.join(F.broadcast(heavy), keys)
    dealt = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return spread.unionByName(dealt)


def join_salted(rows: DataFrame, wide: DataFrame, key: str, by: str, counted: DataFrame, share: int = 1000) -> DataFrame:
    """Inner join with ``wide``, one row a key and of any width, on a key that may hold any share of ``rows``.

    counted: the keys of the rows, once a row.  A key with more than one in ``share`` of the rows
    (fewer than ``share`` keys) is dealt by column ``by`` over as many parts as it holds such
    shares; its wide row is repeated for each, in all at most twice ``share`` times.
    """
    counts = staged(counted.groupBy(key).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(counts.where(F.col("n") * share > total).select(key, F.ceil(F.col("n") * share / F.lit(max(total, 1))).cast("int").alias("parts")))
    part = F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")), F.lit(0)).cast("int")
    dealt = rows.join(heavy, key, "left").withColumn("part", part).drop("parts")
    repeated = wide.join(heavy, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(repeated, [key, "part"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table of a query.  Queries keep Arrow batches small, as a batch of long texts
    must fit a worker beside others; operators called otherwise leave settings as they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that text operators read: other columns, also ones whose
    names clash with an operator's own, are pruned here."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
