"""Whole jobs composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions import places as P
from rostrum.functions.arrays import clean_tags
from rostrum.operators.dedup import dedup_cfps, url_store_add
from rostrum.operators.filters import open_only
from rostrum.operators.joins import tag_category_lookup
from rostrum.operators.pages import extract_cfps
from rostrum.operators.projections import favicon_fill
from rostrum.operators.state import extract_plan, url_apply_outcomes

FEED_ORDER = ("callingallpapers", "confs.tech", "developers.events")


def union_feeds(feeds: Sequence[DataFrame]) -> DataFrame:
    """Feeds one after the other; ``source_rank`` keeps their order. Missing columns become NULL."""
    ranked = [feed.withColumn("source_rank", F.lit(i)) for i, feed in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def with_categories(cfps: DataFrame, taxonomy: DataFrame | None) -> DataFrame:
    """Replace ``topics_normalized`` by the sorted categories of the tags."""
    tags = cfps.select("object_id", F.col("topics").alias("tags"))
    if taxonomy is None:
        known = F.filter(F.transform("topics", lambda t: F.lower(F.trim(t))), lambda t: t.isin(L.PRIMARY_CATEGORIES))
        return cfps.withColumn("topics_normalized", F.array_sort(F.array_distinct(known)))
    pairs = tag_category_lookup(tags, taxonomy, L.PRIMARY_CATEGORIES)
    # an item has at most as many categories as the taxonomy names
    grouped = pairs.groupBy("object_id").agg(F.array_sort(F.collect_set("category")).alias("topics_normalized"))
    return cfps.drop("topics_normalized").join(grouped, "object_id", "left").withColumn(
        "topics_normalized", F.coalesce("topics_normalized", F.array().cast("array<string>"))
    )


def sync_calls(feeds: Sequence[DataFrame], as_of: int, taxonomy: DataFrame | None = None, order: Sequence[str] = ("source_rank", "seq")) -> DataFrame:
    """Feeds to open, unified calls: union, de-duplication, places and tags, open filter, icons.

    De-duplication comes before the normalisation, so it compares the feeds' own values.
    """
    kept = dedup_cfps(union_feeds(feeds), order)
    placed = kept.withColumns({"location": P.normalize_location(F.col("location")), "topics": clean_tags(F.col("topics"))})
    return favicon_fill(open_only(with_categories(placed, taxonomy), as_of))


def collect_urls(store: DataFrame, providers: Sequence[DataFrame], as_of: float) -> tuple[DataFrame, DataFrame]:
    """Add the links of all providers to the store; also the number of new links per source.

    A provider has ``source, url, name, cfp_url, seq``; a missing event link is replaced by the call link.
    """
    columns = ["source", "url", "name", "cfp_url", "seq"]
    rows = reduce(lambda a, b: a.unionByName(b), [
        p.select(columns).withColumn("rank", F.lit(i)) for i, p in enumerate(providers)
    ])
    link = F.coalesce(F.nullif("url", F.lit("")), F.nullif("cfp_url", F.lit("")))
    batch = rows.withColumns({"url": link, "seq": F.struct("rank", "seq"), "added_at": F.lit(float(as_of))}).filter("url IS NOT NULL")
    merged = url_store_add(store, batch)
    counts = merged.filter("is_new").groupBy("source").agg(F.count("*").alias("new_urls"))
    return merged.drop("is_new"), counts


def extract_and_record(store: DataFrame, pages: DataFrame, as_of: float, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One extraction run: plan, mine the planned pages, write the outcomes into the store.

    ``limit`` is the run's budget of links; without it all links that are due are planned. ``pages`` has
    ``page_url, html`` and, where the fetch tells, ``error_reason`` and ``http_status``. A planned link that
    has no page, or a blank one, gets a failed outcome.
    """
    plan = extract_plan(store, as_of, limit).select("url", "cfp_url", "name", "phase")
    for name, kind in (("error_reason", "string"), ("http_status", "int")):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast(kind))
    fetched = pages.select(F.regexp_replace("page_url", "/+$", "").alias("url"), "html", "error_reason", "http_status")
    todo = plan.join(fetched, "url", "left")
    calls, found = extract_cfps(todo.select(F.col("url").alias("page_url"), "html", "cfp_url", F.col("name").alias("name_hint"), "error_reason"))
    told = todo.groupBy("url").agg(F.first(F.col("phase") == 1).alias("is_retry"), F.max("http_status").alias("http_status"))
    outcomes = found.join(told, "url").select(
        "url", "ok", F.lit(float(as_of)).alias("attempted_at"), F.lit("table").alias("fetch_method"), "is_spa",
        "http_status", "error_reason", "is_retry",
    )
    return calls, url_apply_outcomes(store, outcomes)
