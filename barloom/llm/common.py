"""Helpers shared by the training-data operators: spreading rows, settled tables, words, shared files."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import shared_dir, work_dir

#: Shares of a table above which one key's rows are dealt over several cells of a join.
SHARES = 1024


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out anew in partitions of the advised size; adaptive execution splits large ones and joins small ones.

    For work that costs far more per row than moving the row: a few large row groups would otherwise be a few tasks.
    """
    return df.hint("rebalance", *keys)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: later steps start from files that survive lost executors."""
    path = work_dir(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.work_path = path
    return written


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that :func:`settle` wrote, once every table made from them is written too.

    What is left then starts from the later tables, so a lost executor never asks for the earlier ones again.  A table
    that is already gone, or one that was not settled, is passed over.
    """
    for written in tables:
        path = getattr(written, "work_path", None)
        if path is not None:
            spark = written.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffled_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that moves both sides and broadcasts neither, whatever size Spark expects of them.

    For sides that grow with the table where their size is guessed too low: Spark takes an exploded row for one row, a
    collected list for one value, and a written table for its compressed bytes, and would send the whole side through the driver.
    """
    return left.hint("merge").join(right.hint("merge"), on, how)


def join_copies(rows: DataFrame, facts: DataFrame, on: str, seed: int = 17) -> DataFrame:
    """``rows`` left joined to ``facts``, which has one row at most for each value of ``on``, however many rows share a value.

    A value that holds over one in ``SHARES`` of all rows is dealt over as many cells as it has such shares, and its
    fact is copied to each; there are at most ``SHARES`` such values, so their list is broadcast.  ``rows`` should be a
    settled table: it is counted first.
    """
    total = rows.count()
    hot = rows.groupBy(on).agg(F.count("*").alias("__n")).filter(F.col("__n") * SHARES > total)
    hot = hot.select(F.col(on).alias("__hot"), F.ceil(F.col("__n") * SHARES / F.lit(max(total, 1))).cast("int").alias("__cells"))
    hot = settle(hot.filter(F.col("__hot").isNotNull()), "hot")
    told = F.broadcast(hot)
    cells = F.coalesce("__cells", F.lit(1))
    dealt = rows.join(told, rows[on] == hot["__hot"], "left").withColumn("__cell", F.floor(F.rand(seed) * cells).cast("int"))
    copied = facts.join(told, facts[on] == hot["__hot"], "left").withColumn("__cell", F.explode(F.sequence(F.lit(0), cells - 1)))
    return shuffled_join(dealt.drop("__hot", "__cells"), copied.drop("__hot", "__cells"), [on, "__cell"], "left").drop("__cell")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Have Spark delete a statement's shuffle files when it ends: what it wrote is read from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def by_file(rows: DataFrame, column: str, files: int) -> DataFrame:
    """Rows of a file in one task, about one file a task; a stated number is not coalesced, however short the rows are."""
    return rows.repartition(max(1, min(files, 100_000)), column)


def shared_files(spark: SparkSession, label: str) -> str:
    """A fresh folder name for files that tasks write themselves, below the shared folder."""
    shared_dir(spark)
    return work_dir(spark, label)


def file_system(path: str):
    """The file system of a shared path and the path on it (local, S3, GCS, HDFS and others by URI scheme)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def words(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than space and U+0009 to U+000D, in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text) -> F.Column:
    """Number of runs of characters other than space and U+0009 to U+000D; null and empty texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
