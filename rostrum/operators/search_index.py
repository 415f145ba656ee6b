"""Keyword search over a stored inverted index: words to postings in ranking order, read tier by tier until k hits are certain.

The index is a parquet table partitioned by ``tier`` and ``lead``. A posting says that a word occurs in an attribute group
of a record, and at which place the record stands in the ranking of its index. Tiers hold the places below FIRST, below
FIRST * GROWTH and so on; the lead is the word's first letters, so a query reads the folders of its words, and of the best
tier first. Every file is sorted by word, so row groups of other words are skipped as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.operators.ranking import SEARCHABLE
from rostrum.operators.windows import RANKINGS, order_of
from rostrum.plans.skew import numbered

FIRST, GROWTH = 4096, 16
# letters of a lead; words that begin with other signs share hashed leads
LEAD, OTHER = 2, 64
SPLIT = r"(?U)[^\w]+"


def _lead(word: Column) -> Column:
    first = F.substring(word, 1, LEAD)
    return F.when(first.rlike("^[a-z0-9]+$"), first).otherwise(_hashed_lead(word))


def _hashed_lead(word: Column) -> Column:
    return F.concat(F.lit("~"), F.pmod(F.crc32(F.substring(word, 1, 1).cast("binary")), F.lit(OTHER)))


def _tier(place: Column) -> Column:
    """0 below FIRST, then one more for each factor GROWTH."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(GROWTH), (place + 1) / FIRST) - 1e-9)).cast("int")


def postings(df: DataFrame, index: str, key: str = "object_id") -> DataFrame:
    """(word, attribute, place, key): the distinct words of every searchable attribute group, groups in order of importance."""
    types = dict(df.dtypes)
    groups = [g for g in ([c for c in g if c in types] for g in SEARCHABLE[index]) if g]
    ranked = numbered(df, order_of([r for r in RANKINGS[index] if r[0] in types], key), "place")

    def words(column: str) -> Column:
        text = F.array_join(column, " ") if types[column].startswith("array") else F.col(column)
        return F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT)

    def said(rank: int, group: tuple[str, ...] | list[str]) -> Column:
        own = F.array_distinct(F.flatten(F.array(*[words(c) for c in group])))
        return F.transform(own, lambda w: F.struct(w.alias("word"), F.lit(rank).alias("attribute")))

    # of a word's attributes in one record only the most important counts
    every = F.flatten(F.array(*[said(rank, g) for rank, g in enumerate(groups)]))
    rows = ranked.select(F.col(key).alias("key"), "place", F.explode(every).alias("said")).select("key", "place", "said.*")
    return rows.filter("word <> ''").groupBy("key", "place", "word").agg(F.min("attribute").alias("attribute"))


def write_search_index(df: DataFrame, index: str, path: str, key: str = "object_id") -> None:
    """Build and store the index of a table; a word that very many records hold is spread over the shuffle by ranges of place."""
    rows = postings(df, index, key).withColumns({"tier": _tier(F.col("place")), "lead": _lead(F.col("word"))})
    rows.repartitionByRange("tier", "lead", "word", "place").sortWithinPartitions("tier", "lead", "word", "place").write.partitionBy("tier", "lead").parquet(path)


def _leads(word: str, prefix: bool) -> Column:
    """Where the postings of a word lie: one folder, but for a prefix shorter than a lead all that begin with it."""
    if prefix and len(word) < LEAD and word.isascii() and word.isalnum():
        return F.col("lead").startswith(word) | (F.col("lead") == _hashed_lead(F.lit(word)))
    return F.col("lead") == _lead(F.lit(word))


def search_postings(rows: DataFrame, words: list[str]) -> DataFrame:
    """Records that hold every word, the last one as a prefix: key, place, attribute (the best of all words)."""
    hits = []
    for number, word in enumerate(words):
        last = number == len(words) - 1
        own = rows.filter(_leads(word, last) & (F.col("word").startswith(word) if last else F.col("word") == word))
        hits.append(own.groupBy("key", "place").agg(F.min("attribute").alias(f"a{number}")) if last else own.select("key", "place", F.col("attribute").alias(f"a{number}")))
    met = reduce(lambda a, b: a.join(b, ["key", "place"]), hits)
    best = [F.col(f"a{n}") for n in range(len(words))]
    return met.select("key", "place", (F.least(*best) if len(best) > 1 else best[0]).alias("attribute"))


def search_index(spark: SparkSession, path: str, query: str, k: int = 4, key: str = "object_id") -> DataFrame:
    """The best ``k`` records in which every query word occurs: key, attribute, rank, as ``ranking.keyword_search`` gives them.

    Tiers are read best first. No record of a later tier can come before ``k`` hits in the most important attribute, so
    the search ends with them. A query without words finds nothing.
    """
    words = query.lower().split()
    index = spark.read.parquet(path)
    kind = index.schema["key"].dataType.simpleString()
    best: list = []
    tiers = sorted(int(r["tier"]) for r in index.select("tier").distinct().collect()) if words else []  # the logarithm of the rows
    for tier in tiers:
        found = search_postings(index.filter(F.col("tier") == tier), words).orderBy("attribute", "place").limit(k).collect()
        best = sorted([*best, *((r["attribute"], r["place"], r["key"]) for r in found)])[:k]
        if len(best) == k and best[-1][0] == 0:
            break
    return spark.createDataFrame([(i, a, n) for n, (a, _, i) in enumerate(best, 1)], f"`{key}` {kind}, attribute int, rank int")
