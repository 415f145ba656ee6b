"""How filters act together: one table of failing ids per filter, compared by semi and anti joins."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.llm.tools import BLANKS, partitions, stored, table

#: fixed values: the filters of the query, in the order of their letters
FILTERS = ("A", "B", "C", "D", "E")
# texts that more rows repeat than this share of a task's usual rows, and than this number, are joined apart; so they are few
HOT_SHARE, HOT_ROWS = 4, 1_000


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that one text alone decides; ``text`` isn't null."""
    words = F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")
    size, distinct, points = (c.cast("bigint") for c in (F.size(words), F.size(F.array_distinct(words)), F.length(text)))
    capitals = points - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": size < 50,
        "B": 100 * distinct < 65 * size,
        "C": 100 * capitals > 5 * points,
        "D": text.rlike("[#$%&*|]"),
    }


def later_copies(facts: DataFrame, row: str = "row", key: str = "doc_id", digest: str = "digest") -> DataFrame:
    """Rows whose text, by its digest, also belongs to a smaller key; null keys are no such rows and make none.

    Texts that many rows repeat, at most a number that the session's partitions bound, are joined by broadcast; of
    the others no group fills a task.
    """
    spark = facts.sparkSession
    with_key = facts.filter(F.col(key).isNotNull())
    groups = stored(with_key.groupBy(digest).agg(F.min(key).alias("__first"), F.max(key).alias("__last"), F.count(F.lit(1)).alias("__n"))
                    .filter("__first < __last").drop("__last"), "copied_texts")
    bound = max(HOT_ROWS, with_key.count() // (HOT_SHARE * partitions(spark)))  # at most HOT_SHARE * partitions texts are above
    hot = F.broadcast(groups.filter(F.col("__n") > bound))
    cold = groups.filter(F.col("__n") <= bound)
    late = F.col(key) > F.col("__first")
    apart = with_key.join(hot, digest).filter(late).select(row)
    return apart.union(with_key.join(hot, digest, "left_anti").join(cold, digest).filter(late).select(row))


def store_failing_ids(rows: DataFrame, names: Sequence[str], row: str = "row", failures: str = "failures") -> dict[str, DataFrame]:
    """One stored id table per filter, from rows with the array of filters that they fail."""
    listed = stored(rows.select(row, F.explode(failures).alias("__filter")), "failing_ids", by="__filter")
    return {name: listed.filter(F.col("__filter") == name).select(row) for name in names}


def split_by(ids: DataFrame, tables: dict[str, DataFrame], key: str, into: str) -> DataFrame:
    """Append to ``into`` (a string or an array) the name of each table that holds the row's key.

    Each table cuts the rows in two, a left-semi and a left-anti join; the cut rows are stored, so every table is
    joined with each row once, and a lost executor repeats one cut at most. Null keys are in no table.
    """
    text = ids.schema[into].dataType.simpleString() == "string"
    for name, table_ in tables.items():
        there = ids.join(table_, key, "left_semi").withColumn(into, F.concat(into, F.lit(name) if text else F.array(F.lit(name))))
        ids = stored(there.unionByName(ids.join(table_, key, "left_anti")), f"cut_{name}")
    return ids


def audit_filters(ids: DataFrame, failing: dict[str, DataFrame], row: str = "row", part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """What every filter does at every place of every order of the filters, for each part.

    ``ids`` has one row a document: ``row`` (unique), its part and whether its labels are good and toxic; ``failing``
    has for each filter, named by one letter, the table of failing ``row``s (distinct). The tables cut the documents
    into classes of equal membership by left-semi and left-anti joins on ids. A class is then all that counts: at
    most 2^filters * 4 a part, with its number of documents. Each prefix (set of filters already applied) keeps the
    classes that are left-anti to the filters' failing classes; of the survivors the next filter removes the
    left-semi ones; failing classes that don't survive are redundant. Columns: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley; zeros included. No documents, no parts.
    Filters number at most 8, as all orders are listed.
    """
    spark, letters = ids.sparkSession, sorted(failing)
    if not 0 < len(letters) <= 8 or any(len(c) != 1 for c in letters):
        raise ValueError("one to eight filters, each named by one letter")
    fails = split_by(ids.select(row, part, good, toxic, F.lit("").alias("fails")), {c: failing[c] for c in letters}, row, "fails")
    flag = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    classes = stored(fails.groupBy(F.col(part).alias("part"), "fails").agg(
        F.count(F.lit(1)).alias("n"), flag(good).alias("good"), flag(toxic).alias("toxic")), "classes")

    # relations over sets of filters, at most 2^filters * filters rows
    sets = [""]
    for c in letters:
        sets += [s + c for s in sets]
    fails_letter = F.broadcast(spark.createDataFrame([(s, c) for s in sets for c in s], "fails string, letter string"))
    dropped_by = F.broadcast(spark.createDataFrame([(s, p) for s in sets for p in sets if set(s) & set(p)], "fails string, prefix string"))
    moves = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(c).alias("letter")) for p in sets for c in letters if c not in p])

    steps = classes.withColumn("move", F.explode(moves)).select("part", "fails", "n", "good", "toxic", "move.prefix", "move.letter")
    alive = steps.join(dropped_by, ["fails", "prefix"], "left_anti")
    gone = steps.join(dropped_by, ["fails", "prefix"], "left_semi")
    zero = F.lit(0).cast("bigint")
    removed, redundant = (side.join(fails_letter, ["fails", "letter"], "left_semi") for side in (alive, gone))
    kept = alive.join(fails_letter, ["fails", "letter"], "left_anti")
    # every step of every part is there, with no documents
    nothing = classes.select("part").distinct().withColumn("move", F.explode(moves)).select(
        "part", "move.prefix", "move.letter", *[zero.alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])
    one = lambda side, **of: side.select(
        "part", "prefix", "letter", *[(F.col(of[c]) if c in of else zero).alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])
    counted = nothing.union(one(kept, kept="n")).union(one(removed, removed="n", good_lost="good", toxic_lost="toxic")).union(one(redundant, redundant="n"))
    counted = counted.groupBy("part", "prefix", "letter").agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])

    # what a filter removes behind all others fails it only
    others = {c: "".join(x for x in letters if x != c) for c in letters}
    behind_all = F.col("prefix") == F.create_map(*[F.lit(x) for c in letters for x in (c, others[c])])[F.col("letter")]
    counted = counted.withColumn("unique_fails", F.max(F.when(behind_all, F.col("removed"))).over(Window.partitionBy("part", "letter")))
    orders = F.broadcast(spark.createDataFrame(
        [("".join(o), i + 1, "".join(sorted(o[:i])), c) for o in permutations(letters) for i, c in enumerate(o)],
        "filter_order string, step int, prefix string, letter string"))
    # how often a prefix stands before a letter, over all orders
    out = counted.join(orders, ["prefix", "letter"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))
    return out.withColumn("shapley", shapley).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_text_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters A to E over all documents and their labels.

    Every row is a document, also where ids repeat or are null. A null text is the empty text, a null source the
    part of the empty string. A document is good (toxic) if some label row of its id has quality (toxic) 1; label
    rows of unknown ids don't count. Columns other than doc_id, text and source are not read. No documents, no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.array_compact(F.array(*[F.when(failed, F.lit(c)) for c, failed in text_failures(text).items()])).alias("failures"))
    facts = stored(facts, "facts")
    copies = later_copies(facts).select("row", F.array(F.lit("E")).alias("failures"))
    failing = store_failing_ids(facts.select("row", "failures").union(copies), FILTERS)
    marks = {c: labels.filter(F.col(c) == 1).select("doc_id").distinct() for c in ("quality", "toxic")}
    named = split_by(facts.select("row", "doc_id", "part", F.array().cast("array<string>").alias("marks")), marks, "doc_id", "marks")
    return audit_filters(named.select(
        "row", "part", F.array_contains("marks", "quality").alias("good"), F.array_contains("marks", "toxic").alias("toxic")), failing)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_text_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
cut AS (SELECT r, doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM docs),
failing AS (SELECT r, doc_id, part,
  CASE WHEN len(w) < 50 THEN 1 ELSE 0 END AS a,
  CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 1 ELSE 0 END AS b,
  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 1 ELSE 0 END AS c,
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
  CASE WHEN doc_id > first_id THEN 1 ELSE 0 END AS e FROM cut),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
classes AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing LEFT JOIN marks USING (doc_id) GROUP BY ALL),
letters(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
masks AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, n, good, toxic FROM classes),
orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (SELECT filter_order, s AS step, bit,
  (SELECT coalesce(sum(p.bit), 0)::BIGINT FROM letters p WHERE strpos(substr(filter_order, 1, s - 1), p.l) > 0) AS before
  FROM orders, range(1, 6) AS t(s), letters WHERE l = substr(filter_order, s, 1)),
counted AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM counted
"""
