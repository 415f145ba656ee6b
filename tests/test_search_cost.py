"""Search over several indexes: shared tables are made once, words are cut only where they can stand."""

import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from rostrum.catalog.registry import Tables
from rostrum.catalog.speakers import talks
from rostrum.functions.text import slugify
from rostrum.operators import ranking
from rostrum.plans.storage import stored

SMALL = "/root/testdata/sf0.001"


def test_talks_of_two_indexes_are_put_together_once(spark):
    found = entry.queries()["multi_search"](spark, SMALL)
    assert not [f for f in found.inputFiles() if os.path.basename(f) in ("lineitem.parquet", "orders.parquet")]
    assert found.filter("index IN ('talks', 'speakers')").count() == 8


def test_topics_of_a_talk_take_one_shuffle(spark):
    t = Tables(spark, SMALL)
    plan = talks(t)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(talk_id#" in plan.replace("l_orderkey", "talk_id") and ", topic#" not in "".join(
        line for line in plan.splitlines() if "hashpartitioning" in line)
    want = t.view("v_topic").groupBy("talk_id").agg(F.array_sort(F.collect_list("topic")).alias("want"))
    both = talks(t).join(want, "talk_id", "left")
    assert both.filter(~F.col("topics").eqNullSafe(F.coalesce("want", F.array().cast("array<string>")))).count() == 0


def test_words_are_found_as_before(spark):
    rows = spark.createDataFrame([
        (1, "Red Widgets", None), (2, "the RED", "w in text"), (3, "bored w", "redw"), (4, "c++ red", "WIDE"), (5, None, None), (6, "red_w wx", "red"),
        (7, "ROT rÉd", "w"), (8, "", "red-w"),
    ], "object_id INT, name STRING, description STRING")
    hits = lambda query: {r.object_id: r.attribute for r in ranking.keyword_search(rows, query, "cfps", 9).collect()}
    assert hits("red w") == {1: 0, 2: 0, 4: 0, 6: 0, 8: 1}
    assert hits("réd") == {7: 0} and hits("c++") == {} and hits("red_") == {6: 0}


def test_slugs_keep_their_form(spark):
    rows = spark.createDataFrame([("--a--b--",), ("!",), ("",), (None,), ("x\n",), ("É-é",)], "v STRING")
    old = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("v", F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    assert rows.filter(~slugify(F.col("v")).eqNullSafe(old)).count() == 0


def test_stored_keeps_rows_and_types(spark):
    rows = spark.sql("SELECT id, array('a', NULL) AS l, struct(1L AS x) AS s FROM range(3)")
    back, empty = stored(rows, "t"), stored(rows.filter("id < 0"), "t")
    assert back.dtypes == rows.dtypes == empty.dtypes and sorted(back.collect()) == sorted(rows.collect()) and empty.count() == 0
