"""Rankings, top-k reports and carousels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.arrays import distance_label, haversine_km
from rostrum.functions.text import blank_to_null
from rostrum.operators.filters import is_open
from rostrum.plans.skew import numbered, top_k, top_k_array, top_k_per_key
from rostrum.plans.storage import cut_lineage

# ranking of each index: (column, descending)
RANKINGS = {
    "cfps": [("days_until_cfp_close", False), ("cfp_end_date", False)],
    "talks": [("popularity_score", True), ("view_count", True), ("year", True)],
    "speakers": [("influence_score", True), ("total_views", True), ("talk_count", True), ("active_years", True)],
}
REPLICAS = {
    "popularity": ("popularity_score", True), "hn": ("hn_points", True), "github": ("github_stars", True),
    "deadline": ("days_until_cfp_close", False),
}


def order_of(ranking: Sequence[tuple[str, bool]], key: str) -> list[Column]:
    """Sort columns of a ranking, NULL last, the key as tie breaker."""
    columns = [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in ranking]
    return [*columns, F.col(key)]


def index_ranking(df: DataFrame, index: str, key: str = "object_id") -> DataFrame:
    """Whole table in the order of its index: a range sort, no single-task window."""
    return df.orderBy(*order_of(RANKINGS[index], key))


def sorted_replica(df: DataFrame, name: str, partitions: int | None = None, key: str = "object_id") -> DataFrame:
    """Range-partitioned copy in an alternative order, for writing as a sorted table."""
    order = order_of([REPLICAS[name]], key)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


# ---- carousels ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Carousel:
    """A stored top-k query over one index."""

    id: str
    index: str
    limit: int
    condition: Column | None = None
    mentions_end: bool = False
    title: str = ""
    ranking: list[tuple[str, bool]] | None = field(default=None)


def carousel_configs(as_of: int, topics: Sequence[str] = ()) -> list[Carousel]:
    """The standing carousels plus the personal ones when the profile has topics."""
    end, now = F.col("cfp_end_date"), F.lit(as_of)
    configs = [Carousel("hot-deadlines", "cfps", 20, (end > now) & (end < now + 7 * 86400), True, "Hot Deadlines")]
    if topics:
        liked = F.arrays_overlap(F.col("topics"), F.array(*[F.lit(t) for t in topics]))
        title = "Because you like " + " & ".join(topics[:2])
        configs.append(Carousel("for-you", "cfps", 15, liked & (end > now), True, title))
    configs += [
        Carousel("trending-hn", "cfps", 15, (F.col("hn_stories") > 0) & (end > now), True, "Trending on HN"),
        Carousel("github-buzz", "cfps", 15, (F.col("github_repos") > 0) & (end > now), True, "GitHub Buzz"),
        Carousel("viral-talks", "talks", 20, F.col("view_count") > 10000, False, "Talks That Went Viral"),
    ]
    if topics:
        name = "talks-" + "".join(c for c in topics[0].lower() if "a" <= c <= "z")
        own = F.array_contains(F.col("topics"), topics[0])
        configs.append(Carousel(name, "talks", 15, own, False, f"{topics[0]} Deep Dives"))
    return configs


def carousel(df: DataFrame, config: Carousel, as_of: int, key: str = "object_id") -> DataFrame:
    """Rows of one carousel with their rank; calls get the open filter unless the filter has its own."""
    rows = df if config.condition is None else df.filter(config.condition)
    if config.index == "cfps" and not config.mentions_end:
        rows = rows.filter(F.col("cfp_end_date") > as_of)
    order = order_of(config.ranking or RANKINGS[config.index], key)
    return top_k(rows, order, config.limit, "rank").withColumn("carousel", F.lit(config.id))


def carousels(df: DataFrame, configs: Sequence[Carousel], as_of: int, key: str = "object_id") -> DataFrame:
    """Rows of several carousels over one index and ranking, in one pass: each row names the carousels it fits."""
    index, ranking = configs[0].index, configs[0].ranking
    if any((c.index, c.ranking) != (index, ranking) for c in configs):
        raise ValueError("carousels of one pass share index and ranking")
    fits, limit = [], F.lit(0)
    for config in configs:
        rule = F.lit(True) if config.condition is None else config.condition
        if index == "cfps" and not config.mentions_end:
            rule = rule & (F.col("cfp_end_date") > as_of)
        fits.append(F.when(rule, F.lit(config.id)))
        limit = F.when(F.col("carousel") == config.id, F.lit(config.limit)).otherwise(limit)
    rows = df.withColumn("carousel", F.explode(F.array_compact(F.array(*fits))))
    ranked = top_k_per_key(rows, ["carousel"], order_of(ranking or RANKINGS[index], key), max(c.limit for c in configs), "rank")
    return ranked.filter(F.col("rank") <= limit)


def hero(cfps: DataFrame, as_of: int, key: str = "object_id") -> DataFrame:
    """Of the ten first calls that close within 14 days the most popular, else the earliest."""
    end = F.col("cfp_end_date")
    near = cfps.filter((end > as_of) & (end < as_of + 14 * 86400))
    ten = top_k(near, order_of(RANKINGS["cfps"], key), 10)
    popular = F.coalesce(F.col("popularity_score"), F.lit(0)) > 0
    order = [popular.desc(), F.when(popular, F.col("popularity_score")).desc_nulls_last(), end.asc(), F.col(key)]
    return top_k(ten, order, 1)


# ---- speakers -----------------------------------------------------------------------------------
LEADERBOARD_SORTS = {
    "influence": "influence_score", "talks": "talk_count", "views": "total_views", "years": "active_years",
}


def leaderboard(speakers: DataFrame, sort: str = "influence", k: int = 50, key: str = "slug") -> DataFrame:
    """The ``k`` most influential speakers, then re-sorted by the chosen figure."""
    first = top_k(speakers, order_of(RANKINGS["speakers"], key), k)
    by = [F.col(LEADERBOARD_SORTS[sort]).desc_nulls_last(), *order_of(RANKINGS["speakers"], key)]
    return top_k(first, by, k, "rank")


def rising_stars(speakers: DataFrame, k: int = 15, key: str = "slug") -> DataFrame:
    """Among the 100 most influential: active one to three years and influence above 10."""
    hundred = top_k(speakers, order_of(RANKINGS["speakers"], key), 100)
    young = hundred.filter(F.col("active_years").between(1, 3) & (F.col("influence_score") > 10))
    return top_k(young, [F.col("influence_score").desc(), F.col(key)], k)


def podium_grid(ranked: DataFrame) -> DataFrame:
    """Ranks 1-3 are the podium, 4-20 the grid."""
    place = F.when(F.col("rank") <= 3, F.lit("podium")).otherwise(F.lit("grid"))
    return ranked.filter(F.col("rank") <= 20).withColumn("place", place)


def top_speakers(speakers: DataFrame, topic: str | None, k: int, key: str = "slug") -> DataFrame:
    rows = speakers if topic is None else speakers.filter(F.array_contains("topics", topic))
    return top_k(rows, order_of(RANKINGS["speakers"], key), k)


def top_talks_per_speaker(appearances: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most viewed talk ids of each speaker, best first."""
    rows = appearances.select("slug", "object_id", F.coalesce("view_count", F.lit(0)).alias("v"))
    return top_k_array(rows, ["slug"], [F.col("v").desc(), F.col("object_id")], k, F.col("object_id"), "top_talk_ids")


def longest_name(names: DataFrame) -> DataFrame:
    """Display name of each slug: the longest spelling."""
    rank = F.struct(F.length("alias").alias("length"), F.col("alias"))
    return names.groupBy("slug").agg(F.max(rank)["alias"].alias("name"), F.count(F.lit(1)).alias("spellings"))


def top_by_talks(nodes: DataFrame, k: int, key: str, conference_only: bool = False) -> DataFrame:
    """Channels or discovered speakers with the most talks."""
    rows = nodes.filter("is_conference") if conference_only else nodes
    return top_k(rows, [F.col("talk_count").desc(), F.col(key)], k)


# ---- calls and talks ----------------------------------------------------------------------------
def closing_summary(cfps: DataFrame, k: int) -> DataFrame:
    """Calls by days left; unknown and 0 days count as 999."""
    days = F.coalesce(F.nullif("days_until_cfp_close", F.lit(0)), F.lit(999))
    return top_k(cfps, [days, F.col("object_id")], k)


def transcript_priority(talks: DataFrame) -> DataFrame:
    """Videos without transcript: known speakers first, then views and recent years."""
    queue = talks.filter(
        F.col("object_id").startswith("yt_") & ~F.coalesce(F.col("transcript_enriched"), F.lit(False))
    )
    recent = F.when(F.coalesce(F.col("year"), F.lit(0)) != 0, (F.col("year") - 2015) * 100).otherwise(F.lit(0))
    score = (
        F.when(F.col("is_known"), F.lit(100000)).otherwise(F.lit(0))
        + F.least(F.coalesce(F.col("view_count"), F.lit(0)), F.lit(100000))
        + recent
    )
    return queue.withColumn("priority", score.cast("bigint")).orderBy(F.col("priority").desc(), "object_id")


def budgeted_events(records: DataFrame, budget: int) -> DataFrame:
    """Spread ``budget`` events over records by weight, heaviest first, as one row per event.

    Weights are small whole numbers, so sums run over the classes of equal weight: heavier classes are taken
    whole, and only the class in which the budget ends is numbered by id.
    """
    positive = records.filter("weight > 0").select("object_id", "weight")
    before = Window.orderBy(F.col("weight").desc()).rowsBetween(Window.unboundedPreceding, -1)
    classes = positive.groupBy("weight").agg(F.count("*").alias("n")).withColumn(
        "base", F.coalesce(F.sum(F.col("weight") * F.col("n")).over(before), F.lit(0)))
    classes = cut_lineage(classes.filter(F.col("base") < budget).withColumn("whole", F.col("base") + F.col("weight") * F.col("n") <= budget))
    whole = positive.join(classes.filter("whole").select("weight"), "weight").withColumn("events", F.col("weight").cast("bigint"))
    last = positive.join(classes.filter("not whole").select("weight", "base"), "weight")
    left = F.lit(budget) - F.col("base") - F.col("weight") * F.col("number")
    part = numbered(last, [F.col("object_id")], "number").withColumn("events", F.least(F.col("weight"), left).cast("bigint")).filter("events > 0")
    taken = whole.select("object_id", "weight", "events").union(part.select("object_id", "weight", "events"))
    return taken.withColumn("event_no", F.explode(F.sequence(F.lit(0), F.col("events") - 1)))


def recent_distinct(events: DataFrame, n: int, user: str = "user_token", item: str = "object_id", ts: str = "ts") -> DataFrame:
    """The last ``n`` distinct items of each user with their place, most recent first."""
    last = events.groupBy(user, item).agg(F.max(ts).alias("last_seen"))
    return top_k_per_key(last, [user], [F.col("last_seen").desc(), F.col(item)], n)


def top_by_popularity(cfps: DataFrame, k: int) -> DataFrame:
    scored = cfps.filter(F.col("intel_enriched") & (F.coalesce(F.col("popularity_score"), F.lit(0)) != 0))
    return top_k(scored, [F.col("popularity_score").desc(), F.col("object_id")], k)


def top_quality(conferences: DataFrame, k: int = 5) -> DataFrame:
    return top_k(conferences, [F.col("quality").desc(), F.col("total_stars").desc(), F.col("conf_id")], k)


def near_me(places: DataFrame, lat: float, lng: float, k: int = 6) -> DataFrame:
    """The ``k`` nearest places with a rounded distance."""
    here = (F.lit(float(lat)), F.lit(float(lng)))
    km = haversine_km(*here, F.col("lat"), F.col("lng"))
    located = places.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    near = top_k(located.withColumn("km", km), [F.col("km"), F.col("object_id")], k)
    return near.withColumn("distance", distance_label(F.col("km")))


def best_thumbnail(direct: Column, thumbnails: Column) -> Column:
    """The direct link, else the highest of ``ARRAY<STRUCT<url, height>>``; the first wins a tie."""
    usable = F.filter(thumbnails, lambda t: blank_to_null(t["url"]).isNotNull())
    ranked = F.transform(
        usable, lambda t, i: F.struct(F.coalesce(t["height"], F.lit(0)).alias("h"), (-i).alias("i"), t["url"].alias("url"))
    )
    return F.coalesce(blank_to_null(direct), F.array_max(ranked)["url"])


def talks_by_year_budget(talks: DataFrame, max_results: int, years: Sequence[int]) -> DataFrame:
    """An equal share per year (at least ten), then the most viewed overall."""
    share = max(10, max_results // len(years))
    order = [F.coalesce(F.col("view_count"), F.lit(0)).desc(), F.col("object_id")]
    per_year = top_k_per_key(talks.filter(F.col("year").isin(list(years))), ["year"], order, share).drop("rank")
    return top_k(per_year, order, max_results)


def open_rows(cfps: DataFrame, as_of: int) -> DataFrame:
    return cfps.filter(is_open(F.col("cfp_end_date"), as_of))
