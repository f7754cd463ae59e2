"""Raw rows, screener snapshots, registry snapshots and the equity log (A-06 ... A-10, A-14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.ordered import running, time_slot

SNAPSHOT_SCHEMA = (
    "ts long, universe array<struct<venue string, symbol string, price double, rank long>>"
)


def normalize_ohlcv(df: DataFrame, row: str, keys: Sequence[str]) -> DataFrame:
    """A-06: ``[ms, o, h, l, c, v]`` arrays of text or numbers to typed bars.

    Short rows and rows with a value that does not parse are dropped; an absent or null volume is zero.
    """
    a = F.col(row)
    at = lambda i: F.try_element_at(a, F.lit(i))
    ms = at(1).try_cast("double").try_cast("long")
    volume = F.when(at(6).isNull(), F.lit(0.0)).otherwise(at(6).try_cast("double"))
    return (
        df.where(F.size(a) >= 5)
        .select(
            *keys,
            F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"),
            *(at(i).try_cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close"), start=2)),
            volume.alias("volume"),
        )
        .dropna(subset=["ts", "open", "high", "low", "close", "volume"])
    )


def write_snapshot(df: DataFrame, path: str) -> None:
    """A-07: append snapshot documents (time plus instruments), one instrument per document.

    Writers need no grouping by run that way, and a run of any size is spread over many files.
    """
    item = F.struct("venue", "symbol", "price", "rank")
    df.select("ts", F.array(item).alias("universe")).write.mode("append").json(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A-08: all instruments of all snapshots; documents that do not parse are skipped."""
    docs = spark.read.schema(SNAPSHOT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return docs.where(F.col("ts").isNotNull()).select("ts", F.inline("universe"))


def latest_snapshot(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """A-09: the newest row per key."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def snapshot_alphas(df: DataFrame, folder: str, now: str) -> str:
    """A-10: write the strategy registry below a folder named after the time; returns the path."""
    stamp = "".join(ch for ch in now if ch.isdigit())
    path = f"{folder.rstrip('/')}/taken={stamp}"
    df.write.mode("overwrite").json(path)
    return path


def equity_curve(df: DataFrame, change: str, name: str = "equity", slot_days: int = 365) -> DataFrame:
    """A-14: time-ordered running equity from a log of changes."""
    return running(df, [], ["ts"], time_slot("ts", slot_days * 86400), **{name: ("sum", change)}).select("ts", name).orderBy("ts")
