"""Durable folders for checkpoints and intermediate tables.

Iterative jobs cut their lineage with a reliable ``checkpoint()``. The folder comes from
``spark.checkpoint.dir``, which a cluster points at storage all executors share; only where it is
unset (tests, a laptop) a temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session, set up once."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
        if folder:
            return folder
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="rostrum-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nobody has written yet."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that losing an executor does not replay earlier rounds."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    Like ``cut_lineage``, for tables of which every reader wants other columns.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def staged(df: DataFrame, **columns) -> DataFrame:
    """Add columns that later steps see as finished values.

    The optimizer merges neighbouring projections by copying expressions into each other; for rules over
    rules that can blow up the plan. The generator in between keeps each step as it is; it stays inside
    the row pipeline and moves no data.
    """
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over all cores before expensive row work when the input has few files for that.

    A single small file is one task whatever its rows cost, and some more files than cores leave most cores idle in the
    last wave; inputs of four files a core or more, as large ones are, stay as they are.
    """
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *[F.xxhash64(k) for k in keys]) if len(df.inputFiles()) < tasks else df
