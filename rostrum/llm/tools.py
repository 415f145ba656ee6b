"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.plans.session import configure
from rostrum.plans.skew import top_k_per_key
from rostrum.plans.storage import new_path

# rows an Arrow batch may hold: whole texts are long, and two Python workers share an executor
BATCH_ROWS = 1000

#: fixed values: the white space that separates words in the word contracts
BLANKS = "\x20\x09-\x0D"
WORD = re.compile(f"[^{BLANKS}]+")
LOWER_ASCII = str.maketrans({c: c + 32 for c in range(65, 91)})


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run: once per context, the sources go out as a py-file."""
    context = spark.sparkContext
    if getattr(context, "_rostrum_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="rostrum-py-")) / "rostrum-sources.zip"
    with zipfile.ZipFile(archive, "w") as zipped:
        for source in sorted(package.rglob("*.py")):
            zipped.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._rostrum_shipped = True


def prepared(spark: SparkSession) -> SparkSession:
    """The session with what these operators need: small Arrow batches, and the package on the workers."""
    configure(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, by: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: later steps start from finished files.

    With ``by``, one folder for each of its values; ``compression`` is that of the files, the session's if not given.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(doc_id: Column | str, base: int) -> Column:
    """crc32 of the id as text, modulo ``base``: the fold of a document."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % base


def letters_lowered(text: str) -> str:
    """A-Z lower-cased, nothing else."""
    return text.translate(LOWER_ASCII) if not text.isascii() else text.lower()


def words(text: str | None) -> list[str]:
    """The words of a text by the contract: A-Z lower-cased, cut at ASCII blanks."""
    if not text:
        return []
    low = letters_lowered(text)
    return WORD.findall(low)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """The texts of an Arrow column; null is the empty text."""
    for value in column:
        yield value.as_py() or ""


def single_threaded() -> None:
    """Native libraries in a task use the task's core only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def hash_sample(df: DataFrame, group: str, key: str, k: int, place: str = "place") -> DataFrame:
    """At most ``k`` rows of each group, those of smallest hash of ``key``, with their place.

    Groups are few (classes, languages): their sizes come to the driver and give each a hash bound that about three
    times ``k`` rows pass, so a group of any size sends only those to the task that ranks them.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).collect()
    bounds = df.sparkSession.createDataFrame(
        [(r[group], float(min(2.0, 3.0 * k / r["__n"]))) for r in sizes], f"__group {df.schema[group].dataType.simpleString()}, __bound double")
    place_of = F.xxhash64(key) / float(1 << 64) + 0.5
    some = df.join(F.broadcast(bounds), F.col(group) == F.col("__group")).filter(place_of <= F.col("__bound")).drop("__group", "__bound")
    return top_k_per_key(some, [group], [F.xxhash64(key), F.col(key)], k, place)
