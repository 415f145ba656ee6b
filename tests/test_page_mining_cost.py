"""Page mining reads a text a fixed number of times, and cheaper patterns give the same results."""

import pytest
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions import arrays as A
from rostrum.functions import dates as D
from rostrum.functions import html as H
from rostrum.functions import places as P
from rostrum.functions import text as S
from rostrum.plans.storage import spread


@pytest.mark.parametrize("rule,most", [
    (A.topics_from_text, 2), (D.dates_near_keywords, 1), (D.all_dates_with_context, 4), (P.near_location, 1),
])
def test_lower_case_is_made_once_and_not_per_word(spark, rule, most):
    rows = spark.createDataFrame([("x",)], "v STRING")
    whole = rows.select(rule(F.col("v")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    # contexts and entries are lambda variables; only the text itself counts
    assert 1 <= whole.count("lower(v#") <= most


def test_strip_knows_all_unicode_blanks(spark):
    letters = spark.range(1, 0x3100).select(F.col("id").cast("int").alias("n"))
    texts = letters.select("n", F.decode(F.unhex(F.lpad(F.hex("n"), 8, "0")), "UTF-32").alias("c"))
    texts = texts.select("n", F.concat("c", F.lit(" a "), "c", F.lit("b"), "c", F.lit("\n"), "c").alias("v"))
    differs = texts.filter(~S.strip(F.col("v")).eqNullSafe(F.regexp_replace("v", r"(?U)^\s+|\s+$", "")))
    assert [r.n for r in differs.collect()] == [] and texts.filter(S.strip(F.col("v")) == F.col("v")).count() > 10000


def test_paragraph_ends(spark):
    pages = [
        "<p>One<p>Two</P ><p class='x'>a<b>c</b> < d <i>e</p>tail", "<div><p>open<br>line</div>after", "<p>last\n", "<p>x</pre>y</article >z",
        "<pre>no</pre><p>", "<p\n>a<p/>b</li>", "<P>big</BODY>", "<p>" + "<b>x</b>" * 20000 + "</p>", "", None,
    ]
    old = r"(?is)<p\b[^>]*>(.*?)(?=</p\s*>|<p\b|</(?:article|aside|blockquote|body|div|html|li|main|section|td)\b|$)"
    rows = spark.createDataFrame([(p,) for p in pages], "v STRING")
    parts = F.regexp_extract_all("v", F.lit(old), F.lit(1))
    want = F.transform(parts, lambda p: S.strip(H.decode_entities(F.regexp_replace(p, "<[^>]*>", ""))))
    assert rows.filter(~H.paragraphs(F.col("v")).eqNullSafe(want)).count() == 0


def test_dates_as_the_plain_patterns_find_them(spark):
    texts = ["x2026-01-02 2026-01-02x 2026-01-02", "june 3, 2026 JUNE 3 2026, xJune 3 2026", "3 march 2026 and 13 Mar 2026 1/2/2026 x1/2/2026"]
    rows = spark.createDataFrame([(t,) for t in texts], "v STRING")
    for pattern in L.DATE_PATTERNS:
        plain = F.regexp_extract_all("v", F.lit("(?i)" + pattern), F.lit(1))
        assert rows.filter(F.regexp_extract_all("v", F.lit(D._DATE_REGEX[pattern]), F.lit(1)) != plain).count() == 0


def test_long_runs_leave_search_text(spark):
    rows = spark.createDataFrame([("a " + "x" * 50 + " b",), ("a " + "x" * 49 + " b",), ("é" * 60 + "-c",), ("-".join(["word"] * 30),)], "v STRING")
    got = [r.x for r in rows.select(S.clean_search_text(F.col("v")).alias("x")).collect()]
    assert got == ["a  b", "a " + "x" * 49 + " b", "-c", "-".join(["word"] * 30)]


def test_some_more_files_than_cores_are_dealt_over_all(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).repartition(cores + 1).write.parquet(str(tmp_path / "few"))
    rows = spark.read.parquet(str(tmp_path / "few"))
    assert spread(rows, "id").rdd.getNumPartitions() == 4 * cores and spread(rows, "id").count() == 1000
