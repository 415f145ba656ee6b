"""Stored search and place indexes against plain scans."""

import random

import pytest
from pyspark.sql import functions as F

from rostrum.operators import place_index, ranking, search_index
from rostrum.operators.windows import near_me
from rostrum.plans.storage import new_path


def test_indexed_search_equals_the_scan(spark, monkeypatch):
    monkeypatch.setattr(search_index, "FIRST", 16)
    monkeypatch.setattr(search_index, "GROWTH", 3)
    rng = random.Random(1)
    words = ["red", "Red-hot", "w", "west", "cé", "c", "café", "Über", "blue", "a1", "1a", "中文", "x_y", "😀"]
    said = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    rows = [(i, said(3), said(6) if i % 3 else None, [said(1) for _ in range(i % 3)], rng.choice([None, 3, 9])) for i in range(300)]
    calls = spark.createDataFrame(rows, "object_id BIGINT, name STRING, description STRING, topics ARRAY<STRING>, days_until_cfp_close INT")
    path = new_path(spark, "index")
    search_index.write_search_index(calls, "cfps", path)
    for query in ("red w", "RED", "c", "cé", "ü", "blue west ca", "1", "中", "x_", "nothing", "red-hot", "😀", "w w w"):
        for k in (4, 1000):
            want = [(r.object_id, r.attribute, r["rank"]) for r in ranking.keyword_search(calls, query, "cfps", k).orderBy("rank").collect()]
            got = [tuple(r) for r in search_index.search_index(spark, path, query, k).orderBy("rank").collect()]
            assert got == want, query
    assert search_index.search_index(spark, path, " ").count() == 0


def test_a_query_reads_its_words_and_the_best_tier(spark):
    calls = spark.range(20_000).select(F.col("id").alias("object_id"), F.concat(F.lit("common t"), F.col("id") % 100).alias("name"), F.col("id").alias("days_until_cfp_close"))
    path = new_path(spark, "index")
    search_index.write_search_index(calls, "cfps", path)
    index = spark.read.parquet(path)
    assert index.select("tier").distinct().count() == 2
    part = search_index.search_postings(index.filter("tier = 0"), ["common", "t7"])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(tier") == 2 and plan.count("(lead") >= 2 and "PushedFilters: [IsNotNull(word), EqualTo(word,common)" in plan
    got = search_index.search_index(spark, path, "common t7", 3).collect()
    assert [(r.object_id, r.attribute, r["rank"]) for r in got] == [(7, 0, 1), (70, 0, 2), (71, 0, 3)]


@pytest.mark.parametrize(("lat", "lng"), [(52.37, 4.89), (0.0, 179.99), (-89.9, 10.0), (90.0, 0.0), (61.0, -180.0), (-20.0, 540.0)])
def test_nearest_places_equal_the_scan(spark, lat, lng):
    rng = random.Random(2)
    rows = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(150)] + [(200 + i, rng.choice([-90.0, 90.0, 0.0]), rng.choice([-180.0, 180.0, 179.9])) for i in range(12)]
    rows += [(300, 52.37, 4.89), (301, 52.37, 4.89), (302, None, 1.0), (303, 1.0, None)]
    places = spark.createDataFrame(rows, "object_id INT, lat DOUBLE, lng DOUBLE")
    path = new_path(spark, "places")
    place_index.write_place_index(places, path)
    for k in (1, 6, 500):
        want = [(r.object_id, round(r.km, 6), r.distance) for r in near_me(places, lat, lng, k).orderBy("km", "object_id").collect()]
        got = [(r.object_id, round(r.km, 6), r.distance) for r in place_index.nearest(spark, path, lat, lng, k).orderBy("km", "object_id").collect()]
        assert got == want


def test_cells_are_partition_filters(spark):
    places = spark.range(2000).select(F.col("id").alias("object_id"), (F.col("id") % 180 - 90).cast("double").alias("lat"), (F.col("id") * 7 % 360 - 180).cast("double").alias("lng"))
    path = new_path(spark, "places")
    place_index.write_place_index(places, path)
    rows = spark.read.parquet(path)
    around = place_index.cells_around(rows, 52.0, 179.0, 1)
    plan = around._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "slice" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert {r.slice for r in around.select("slice").distinct().collect()} <= {70, 71, 0}
    # what lies outside is at least as far as the bound says
    here = place_index.haversine_km(F.lit(52.0), F.lit(179.0), F.col("lat"), F.col("lng"))
    outside = rows.join(around.select("object_id"), "object_id", "left_anti").select(F.min(here)).first()[0]
    assert outside >= place_index.ring_bound(52.0, 179.0, 1) > 100
