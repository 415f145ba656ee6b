"""Stored tables as snapshots: immutable files, one manifest per version, one atomic rename per commit.

A table is a folder. ``data`` holds parquet files that are never changed, each with the rows of one interval of the key;
``manifests`` holds for every version a small table of its files: path, the lower bound of the interval that the file
owns, least and greatest key, and rows. ``versions/<n>`` is a text that names the manifest of version n; a version exists
once this text has its final name, so a job that dies earlier leaves the table as it was, and of two jobs that commit the
same number one is refused and starts again from the other's result. Readers never see half a change.

Intervals are disjoint and cover all keys: a write reads and replaces only the files whose interval holds one of its keys.
"""

from __future__ import annotations

import bisect
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, StringType, StructType

from rostrum.plans.skew import first_per_key
from rostrum.plans.storage import cut_lineage

ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another job has committed the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    number: int
    manifest: str
    key: str
    schema: StructType
    #: what a caller has committed together with the rows; later versions keep it
    notes: dict = field(default_factory=dict)


class Files:
    """The few file operations a commit needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        root = self.at("")
        self.fs = root.getFileSystem(self.conf)
        self.root = root.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()).toString().rstrip("/")

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        where = self.at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a new text under its final name in one step; refused if the name is taken."""
        draft = self.at(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self.at(name), plain)  # without the overwrite option a taken name is an error
        except Exception as error:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"{self.path}/{name} was committed by another job") from error
            raise


def latest(spark: SparkSession, path: str) -> Version | None:
    """The newest version of a table, None where there is no table."""
    numbers = [int(n) for n in Files(spark, path).names("versions") if n.isdigit()]
    return version(spark, path, max(numbers)) if numbers else None


def version(spark: SparkSession, path: str, number: int) -> Version:
    told = json.loads(Files(spark, path).read(f"versions/{number:012d}"))
    return Version(number, told["manifest"], told["key"], StructType.fromJson(told["schema"]), told["notes"])


def _current(spark: SparkSession, path: str) -> Version:
    found = latest(spark, path)
    if found is None:
        raise FileNotFoundError(f"{path} is no table")
    return found


def manifest(spark: SparkSession, path: str, at: Version) -> DataFrame:
    """The files of a version: file (below the table's folder), owner, low, least, greatest, records."""
    return spark.read.parquet(f"{path.rstrip('/')}/manifests/{at.manifest}")


def read_snapshot(spark: SparkSession, path: str, number: int | None = None, least=None, greatest=None) -> DataFrame:
    """A version of the table (the newest by default); with bounds, only files that may hold keys between them."""
    at = _current(spark, path) if number is None else version(spark, path, number)
    files = manifest(spark, path, at)
    if least is not None:
        files = files.filter(F.col("greatest") >= F.lit(least))
    if greatest is not None:
        files = files.filter(F.col("least") <= F.lit(greatest))
    rows = _rows_of(spark, path, at, [r["file"] for r in files.select("file").collect()])
    for bound, keeps in ((least, lambda c: c >= F.lit(least)), (greatest, lambda c: c <= F.lit(greatest))):
        rows = rows if bound is None else rows.filter(keeps(F.col(at.key)))
    return rows


def _rows_of(spark: SparkSession, path: str, at: Version, files: Sequence[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], at.schema)
    return spark.read.schema(at.schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in sorted(files)])


def count_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The number of records, from the manifest alone."""
    return manifest(spark, path, _current(spark, path)).agg(F.coalesce(F.sum("records"), F.lit(0).cast("bigint")).alias("records"))


# ---- writing ------------------------------------------------------------------------------------
def _store_rows(spark: SparkSession, path: str, rows: DataFrame, key: str) -> DataFrame:
    """Write rows (with ``__owner``) to new files, none across two owners, and return the files' manifest rows without ``low``.

    Rows are dealt by ranges of (owner, key), as many as the shuffle's size asks for, so an owner that gets many new rows
    is cut in several files.
    """
    folder = f"data/{uuid.uuid4().hex}"
    where = f"{path.rstrip('/')}/{folder}"
    rows.repartitionByRange("__owner", key).sortWithinPartitions("__owner", key).write.partitionBy("__owner").parquet(where)
    kind = rows.schema[key].dataType.simpleString()
    # which keys a file holds: one scan of the key column
    written = spark.read.schema(f"`{key}` {kind}, __owner int").parquet(where)
    name = F.concat(F.lit(f"{folder}/"), F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1))
    return written.groupBy(name.alias("file"), F.col("__owner").alias("owner")).agg(
        F.min(key).alias("least"), F.max(key).alias("greatest"), F.count(F.lit(1)).alias("records"))


def _commit(spark: SparkSession, path: str, number: int, files: DataFrame, key: str, schema: StructType, notes: dict) -> None:
    """Store the manifest and publish it as version ``number``; owners are numbered anew in key order."""
    name = uuid.uuid4().hex
    place = F.row_number().over(Window.orderBy(F.col("low").asc_nulls_first())) - 1  # one short row per file
    files.withColumn("owner", place.cast("int")).coalesce(1).write.parquet(f"{path.rstrip('/')}/manifests/{name}")
    told = {"manifest": name, "key": key, "schema": schema.jsonValue(), "notes": notes}
    Files(spark, path).put(f"versions/{number:012d}", json.dumps(told))


def _with_low(files: DataFrame, lows: DataFrame | None) -> DataFrame:
    """The lower bound of each new file: its owner's for the owner's first file, its least key for the others."""
    first = F.row_number().over(Window.partitionBy("owner").orderBy("least", "greatest")) == 1
    marked = files.withColumn("__first", first)
    if lows is None:
        return marked.withColumn("low", F.when(~F.col("__first"), F.col("least"))).drop("__first")
    joined = marked.join(lows.select("owner", F.col("low").alias("__low")), "owner", "left")
    return joined.withColumn("low", F.when(F.col("__first"), F.col("__low")).otherwise(F.col("least"))).drop("__first", "__low")


COLUMNS = ("file", "owner", "low", "least", "greatest", "records")


def write_snapshot(df: DataFrame, path: str, key: str) -> None:
    """Write a whole table as its next version. Keys are distinct, not null, whole numbers or strings."""
    spark = df.sparkSession
    kind = df.schema[key].dataType
    if not isinstance(kind, (IntegralType, StringType)):
        raise TypeError(f"a key is a whole number or a string, not {kind.simpleString()}")
    at = latest(spark, path)
    files = _with_low(_store_rows(spark, path, df.withColumn("__owner", F.lit(0)), key), None)
    _commit(spark, path, at.number + 1 if at else 0, files.select(*COLUMNS), key, df.schema, {})


def _owned(rows: DataFrame, key: str, lows: list) -> DataFrame:
    """Add ``__owner``, the place of the interval that holds the key; ``lows`` are all but the first lower bound, ascending."""
    bounds = rows.sparkSession.sparkContext.broadcast(lows)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bounds.value
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            owner = pa.array([bisect.bisect_right(known, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, owner], [*batch.schema.names, "__owner"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields]).add("__owner", IntegerType()))


def change_snapshot(
    spark: SparkSession, path: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], notes: dict | None = None,
) -> None:
    """Commit ``merge(old rows, changes)`` over the intervals that hold a changed key; other files stay as they are.

    Changes are cast to the table's types; those without a key are left out, and without changes nothing is committed.
    ``notes`` are committed together with the rows. If another job commits first, the merge is
    made again over its result.
    """
    for _ in range(ATTEMPTS):
        at = _current(spark, path)
        files = manifest(spark, path, at)
        bounds = files.select("owner", "low", "file").orderBy("owner").collect()  # one short row per file
        same = {f.name: F.col(f.name).cast(f.dataType) for f in at.schema.fields if f.name in changes.columns}
        known = changes.filter(F.col(at.key).isNotNull()).withColumns(same)
        # stored: the merge must not read a source that changes meanwhile
        owned = cut_lineage(_owned(known, at.key, [r["low"] for r in bounds[1:]]))
        touched = sorted(r["__owner"] for r in owned.select("__owner").distinct().collect())
        if not touched:
            return
        old = _rows_of(spark, path, at, [bounds[o]["file"] for o in touched if o < len(bounds)])
        merged = merge(old, owned.drop("__owner"))
        schema = merged.schema
        placed = _owned(merged, at.key, [r["low"] for r in bounds[1:]])
        fresh = _with_low(_store_rows(spark, path, placed, at.key), files)
        kept = files.filter(~F.col("owner").isin(touched))
        try:
            _commit(spark, path, at.number + 1, kept.select(*COLUMNS).unionByName(fresh.select(*COLUMNS)), at.key, schema, at.notes | (notes or {}))
            return
        except Conflict:
            continue
    raise Conflict(f"{path}: {ATTEMPTS} attempts met other writers")


def upsert_snapshot(spark: SparkSession, path: str, new: DataFrame, key: str, order: Sequence[str] = ()) -> None:
    """Rows of ``new`` replace those with the same key as whole records; others are added. Null keys are left out.

    Of several new rows with one key the last in ``order`` wins. The same batch twice gives the same table; columns that
    only the new rows have are added to the schema and null in old rows.
    """
    if order:
        new = first_per_key(new, [key], [F.col(c).desc() for c in order])

    def merge(old: DataFrame, own: DataFrame) -> DataFrame:
        return old.join(own.select(key), key, "left_anti").select(*old.columns).unionByName(own, allowMissingColumns=True)

    change_snapshot(spark, path, new, merge)


def update_snapshot(spark: SparkSession, path: str, changes: DataFrame, key: str, columns: Sequence[str]) -> None:
    """Replace the listed columns of existing keys; unknown keys are not added."""

    def merge(old: DataFrame, own: DataFrame) -> DataFrame:
        joined = old.join(own.select(key, F.struct(*columns).alias("__new")), key, "left")
        hit = F.col("__new").isNotNull()
        return joined.withColumns({c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}).select(*old.columns)

    change_snapshot(spark, path, changes, merge)


def clear_snapshot(spark: SparkSession, path: str) -> None:
    """Empty the table in one commit; key, schema and earlier versions stay."""
    at = _current(spark, path)
    _commit(spark, path, at.number + 1, manifest(spark, path, at).limit(0), at.key, at.schema, at.notes)


def vacuum(spark: SparkSession, path: str, keep: int = 1, older_than: float = 86_400.0) -> int:
    """Remove versions before the newest ``keep`` and files that no kept version has, unless younger than so many seconds.

    The age protects jobs that have written their files and not yet committed. Gives the number of removed files.
    """
    files = Files(spark, path)
    numbers = sorted(int(n) for n in files.names("versions") if n.isdigit())
    kept = [version(spark, path, n) for n in numbers[-keep:]]
    used = {r["file"] for v in kept for r in manifest(spark, path, v).select("file").collect()}
    limit = files.jvm.java.lang.System.currentTimeMillis() - int(older_than * 1000)
    for n in numbers[:-keep]:
        files.fs.delete(files.at(f"versions/{n:012d}"), False)
    for name in set(files.names("manifests")) - {v.manifest for v in kept}:
        if files.fs.getFileStatus(files.at(f"manifests/{name}")).getModificationTime() <= limit:
            files.fs.delete(files.at(f"manifests/{name}"), True)
    removed, found = 0, files.fs.listFiles(files.at("data"), True) if files.fs.exists(files.at("data")) else None
    while found is not None and found.hasNext():
        status = found.next()
        name = status.getPath().toString()[len(files.root) + 1 :]
        if name not in used and name.endswith(".parquet") and status.getModificationTime() <= limit:
            removed += bool(files.fs.delete(status.getPath(), False))
    return removed
