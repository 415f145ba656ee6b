"""Stored tables: commits, conflicts, failures between steps, and which files a write touches."""

import pytest
from pyspark.sql import functions as F

from rostrum.plans.storage import new_path
from rostrum.sources import snapshots as S


def table(spark, n=1000, parts=16):
    path = new_path(spark, "table")
    rows = spark.range(n).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or the few rows would make one file
    S.write_snapshot(rows, path, "id")
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.enabled", before[1])
    return path


def content(spark, path, number=None):
    return {r.id: r.v for r in S.read_snapshot(spark, path, number).collect()}


def files(spark, path):
    return {r.file for r in S.manifest(spark, path, S.latest(spark, path)).collect()}


def test_clear_empties_every_file_and_keeps_schema_and_versions(spark):
    path = table(spark)
    assert len(files(spark, path)) > 8 and S.count_snapshot(spark, path).first().records == 1000
    S.clear_snapshot(spark, path)
    assert content(spark, path) == {} and S.count_snapshot(spark, path).first().records == 0
    assert S.read_snapshot(spark, path).columns == ["id", "v"]
    assert len(content(spark, path, 0)) == 1000
    S.upsert_snapshot(spark, path, spark.createDataFrame([(2, "y")], "id BIGINT, v STRING"), "id")
    assert content(spark, path) == {2: "y"}


def test_upsert_rewrites_only_files_that_own_a_key(spark):
    path = table(spark)
    old = files(spark, path)
    new = spark.createDataFrame([(5, "a"), (5, "b"), (7, "c"), (-3, "low"), (5000, "high"), (None, "x")], "id INT, v STRING")
    for _ in range(2):  # a second time changes nothing
        S.upsert_snapshot(spark, path, new, "id", order=["v"])
        got = content(spark, path)
        assert len(got) == 1002 and got[5] == "b" and got[7] == "c" and got[-3] == "low" and got[5000] == "high" and got[6] == "v6"
    assert len(old - files(spark, path)) <= 2
    bounds = [(r.low, r.least, r.greatest) for r in S.manifest(spark, path, S.latest(spark, path)).orderBy("owner").collect()]
    assert bounds[0][0] is None and all(a[2] < b[1] and b[0] <= b[1] for a, b in zip(bounds, bounds[1:], strict=False))
    some = S.read_snapshot(spark, path, least=100, greatest=110)
    assert {r.id for r in some.collect()} == set(range(100, 111)) and len(some.inputFiles()) <= 2


def test_update_changes_known_keys_only(spark):
    path = table(spark, 50, 4)
    S.update_snapshot(spark, path, spark.createDataFrame([(3, "new"), (99, "unknown")], "id BIGINT, v STRING"), "id", ["v"])
    got = content(spark, path)
    assert len(got) == 50 and got[3] == "new" and got[4] == "v4"


def test_a_failure_before_the_commit_leaves_the_table(spark, monkeypatch):
    path = table(spark, 50, 4)
    before, number = files(spark, path), S.latest(spark, path).number

    def fail(*_):
        raise OSError("lost")

    for step in ("_commit", "_with_low"):
        with monkeypatch.context() as patched:
            patched.setattr(S, step, fail)
            with pytest.raises(OSError):
                S.upsert_snapshot(spark, path, spark.createDataFrame([(3, "new")], "id BIGINT, v STRING"), "id")
    with monkeypatch.context() as patched:
        patched.setattr(S.Files, "put", fail)
        with pytest.raises(OSError):
            S.clear_snapshot(spark, path)
    assert files(spark, path) == before and S.latest(spark, path).number == number and len(content(spark, path)) == 50
    assert S.vacuum(spark, path, older_than=3600) == 0  # files of jobs under way stay
    assert S.vacuum(spark, path, older_than=-3600) == 2  # what the two failed jobs left
    assert len(content(spark, path)) == 50


def test_two_writers(spark, monkeypatch):
    path = table(spark, 50, 4)
    commit, meanwhile = S._commit, []

    def late(spark_, path_, number, *rest):
        if not meanwhile:
            meanwhile.append(number)
            S.upsert_snapshot(spark, path, spark.createDataFrame([(4, "other")], "id BIGINT, v STRING"), "id")
        commit(spark_, path_, number, *rest)

    monkeypatch.setattr(S, "_commit", late)
    S.upsert_snapshot(spark, path, spark.createDataFrame([(3, "mine"), (60, "mine")], "id BIGINT, v STRING"), "id")
    got = content(spark, path)
    assert (got[3], got[4], got[60], len(got)) == ("mine", "other", "mine", 51)
    with pytest.raises(S.Conflict):
        S.Files(spark, path).put(f"versions/{0:012d}", "{}")


def test_vacuum_keeps_the_newest_versions(spark):
    path = table(spark, 50, 4)
    for v in "abc":
        S.upsert_snapshot(spark, path, spark.createDataFrame([(3, v)], "id BIGINT, v STRING"), "id")
    assert S.vacuum(spark, path, keep=2, older_than=-3600) == 2
    assert content(spark, path)[3] == "c" and content(spark, path, 2)[3] == "b"
    with pytest.raises(Exception, match="versions"):
        content(spark, path, 0)


def test_string_keys_new_columns_and_empty_tables(spark):
    path = new_path(spark, "table")
    S.write_snapshot(spark.createDataFrame([], "k STRING, v INT"), path, "k")
    assert S.read_snapshot(spark, path).count() == 0
    S.upsert_snapshot(spark, path, spark.createDataFrame([("é", 1), ("z", 2), ("", 3)], "k STRING, v LONG"), "k")
    S.upsert_snapshot(spark, path, spark.createDataFrame([("z", 4, "new")], "k STRING, v INT, w STRING"), "k")
    assert {tuple(r) for r in S.read_snapshot(spark, path).collect()} == {("é", 1, None), ("", 3, None), ("z", 4, "new")}
    with pytest.raises(TypeError):
        S.write_snapshot(spark.createDataFrame([(1.0,)], "k DOUBLE"), new_path(spark, "t"), "k")
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, new_path(spark, "none"))
