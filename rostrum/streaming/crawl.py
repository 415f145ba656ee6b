"""The crawl store fed by streams of links and of crawl outcomes.

Links are merged into a snapshot table, whose untouched files stay; adding a known link changes nothing. Outcomes go to
a log beside it, one folder per stream and batch, which a replayed batch overwrites. The state of a link is its
stored row and all its logged outcomes folded in time order, so late, doubled and out-of-order files lose nothing.

``compact_outcomes`` keeps the log short: outcomes up to a time are folded into the table, and that time is committed
together with the rows. From then on outcomes up to it, which are replays or later than the log waits for, no longer
count; they are kept in a table of their own (``read_late``).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators.dedup import url_store_add
from rostrum.operators.state import fold_outcomes
from rostrum.sources.schemas import OUTCOMES, URL_STORE
from rostrum.sources.snapshots import Files, change_snapshot, latest, read_snapshot, vacuum, write_snapshot

LINKS = "url STRING, source STRING, name STRING, cfp_url STRING, seq BIGINT, added_at DOUBLE"


def outcome_log(path: str) -> str:
    return f"{path.rstrip('/')}-outcomes"


def create_store(spark: SparkSession, path: str, rows: DataFrame | None = None) -> None:
    """Create the stored table, empty or from rows, and its empty outcome log."""
    rows = spark.createDataFrame([], URL_STORE) if rows is None else rows
    write_snapshot(rows, path, "url")
    spark.createDataFrame([], OUTCOMES).write.parquet(f"{outcome_log(path)}/run=none")


def late_log(path: str) -> str:
    return f"{path.rstrip('/')}-late"


def folded_until(spark: SparkSession, path: str) -> float:
    """Outcomes up to this time are part of the stored rows."""
    return float(latest(spark, path).notes.get("folded_until", "-inf"))


def logged_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The outcomes of the log that the stored rows don't hold yet."""
    log = spark.read.schema(f"{OUTCOMES}, run STRING").parquet(outcome_log(path)).drop("run")
    return log.filter(F.col("attempted_at") > folded_until(spark, path))


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """Outcomes that came after the table had taken up their time, replays among them."""
    if not Files(spark, late_log(path)).names(""):
        return spark.createDataFrame([], OUTCOMES)
    return spark.read.schema(f"{OUTCOMES}, run STRING").parquet(late_log(path)).drop("run")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The links with the outcomes logged so far."""
    return fold_outcomes(read_snapshot(spark, path), logged_outcomes(spark, path))


def compact_outcomes(spark: SparkSession, path: str, wait: float) -> None:
    """Fold outcomes into the table but for those of the last ``wait`` seconds, and drop log folders that are used up.

    Rows and time are one commit; a job that dies before it has changed nothing, one that dies after it leaves folders
    that nobody counts any more and the next call removes.
    """
    log = logged_outcomes(spark, path)
    newest = log.agg(F.max("attempted_at")).first()[0]
    if newest is not None:
        until = newest - wait
        ripe = log.filter(F.col("attempted_at") <= until).withColumn("url", F.regexp_replace("url", "/+$", ""))
        change_snapshot(spark, path, ripe, lambda store, own: fold_outcomes(store, own), {"folded_until": str(until)})
    until, files = folded_until(spark, path), Files(spark, outcome_log(path))
    runs = spark.read.schema(f"{OUTCOMES}, run STRING").parquet(outcome_log(path)).groupBy("run").agg(F.max("attempted_at").alias("last"))
    used_up = [r["run"] for r in runs.filter(F.col("last") <= until).select("run").collect()]  # one name per folder
    for run in used_up:
        files.fs.delete(files.at(f"run={run}"), True)
    vacuum(spark, path, keep=2)


def merge_links(spark: SparkSession, path: str, batch: DataFrame) -> None:
    batch = batch.withColumn("url", F.regexp_replace("url", "/+$", ""))
    change_snapshot(spark, path, batch, lambda store, new: url_store_add(store, new).drop("is_new").select(*store.columns))


def log_outcomes(path: str, batch: DataFrame, run: str) -> None:
    """Add a batch of outcomes to the log; ``run`` names the stream and batch, and a second time replaces the first."""
    until = folded_until(batch.sparkSession, path)
    late = F.coalesce(F.col("attempted_at") <= until, F.lit(False))
    batch.filter(~late).write.mode("overwrite").parquet(f"{outcome_log(path)}/run={run}")
    if until > float("-inf"):
        batch.filter(late).write.mode("overwrite").parquet(f"{late_log(path)}/run={run}")


def run_links(spark: SparkSession, source: str, path: str, checkpoint: str):
    """Stream link files into the store; processes what is there and stops."""
    links = spark.readStream.schema(LINKS).parquet(source)
    return (
        links.writeStream.foreachBatch(lambda batch, _: merge_links(batch.sparkSession, path, batch))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_outcomes(spark: SparkSession, source: str, path: str, checkpoint: str, wait: float | None = None, files_per_batch: int | None = None):
    """Stream crawl outcomes into the store; processes what is there and stops.

    With ``wait`` every batch is followed by a compaction that leaves the outcomes of so many last seconds in the log.
    """
    reader = spark.readStream.schema(OUTCOMES)
    outcomes = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def put(batch: DataFrame, number: int) -> None:
        log_outcomes(path, batch, f"{stream}-{number}")
        if wait is not None:
            compact_outcomes(batch.sparkSession, path, wait)

    return (
        outcomes.writeStream.foreachBatch(put)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
