"""Plan helpers for hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.plans.storage import cut_lineage


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their rank.

    ``row_number() <= k`` is pushed below the shuffle as a window group limit, so each map task sends
    at most ``k`` rows per key and a hot key cannot fill one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def top_k_array(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, value: Column, name: str) -> DataFrame:
    """One array of the ``k`` best values per key, best first."""
    ranked = top_k_per_key(df, keys, order, k, "__rank").withColumn("__value", value)
    entries = F.array_sort(F.collect_list(F.struct("__rank", "__value")))
    return ranked.groupBy(*keys).agg(F.transform(entries, lambda e: e["__value"]).alias(name))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The whole first row of each key: a group limit of one, below the shuffle as well."""
    return top_k_per_key(df, keys, [F.col(c) if isinstance(c, str) else c for c in order], 1, "__rank").drop("__rank")


def top_k(df: DataFrame, order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """Global top ``k``; planned as TakeOrderedAndProject, with an optional rank over the ``k`` rows only."""
    top = df.orderBy(*order).limit(k)
    if rank is None:
        return top
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def salted_group_count(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Row count per key as BIGINT; the map-side partial count absorbs hot keys."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def numbered(df: DataFrame, order: Sequence[Column], name: str, weight: str | None = None) -> DataFrame:
    """The place of each row (from 0) in a total order, or the ``weight`` before it, without one task seeing all rows.

    Rows are dealt by range and written once; a row's number is its place in its part plus the sizes of the parts
    before, a table of one row per part.
    """
    size = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    ranged = cut_lineage(df.repartitionByRange(*order).withColumns({"__part": F.spark_partition_id(), "__size": size}))
    sizes = ranged.groupBy("__part").agg(F.sum("__size").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__place", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(bases, "__part")
    return placed.withColumn(name, F.col("__base") + F.col("__place")).drop("__part", "__place", "__base", "__size")
