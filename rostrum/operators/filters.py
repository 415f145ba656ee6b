"""Row filters and boolean or label columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions.text import clean_name, contains_any, matches, or_else, slugify, strip, url_host
from rostrum.plans.skew import first_per_key, top_k_per_key


def _any_pattern(text: Column, patterns: list[str]) -> Column:
    """One alternation instead of one pass per pattern."""
    return matches(text, "(?i)" + "|".join(f"(?:{p})" for p in patterns))


# ---- calls --------------------------------------------------------------------------------------
def is_open(end: Column, as_of: int) -> Column:
    """No end date counts as open; the end second itself is closed."""
    return (F.coalesce(end, F.lit(0)) == 0) | (end > as_of)


def open_only(cfps: DataFrame, as_of: int) -> DataFrame:
    return cfps.filter(is_open(F.col("cfp_end_date"), as_of))


def not_closed(cfps: DataFrame, as_of: int) -> DataFrame:
    """Feed-level rule: drop an end before ``as_of``; the second itself is kept."""
    end = F.col("cfp_end_date")
    return cfps.filter((F.coalesce(end, F.lit(0)) == 0) | (end >= as_of))


def has_cfp_url(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("cfp_url") != "")


def has_geo(cfps: DataFrame) -> DataFrame:
    """Rows on the map: both coordinates known and not zero."""
    return cfps.filter((F.col("lat") != 0) & (F.col("lng") != 0))


def bounding_box(cfps: DataFrame) -> DataFrame:
    return has_geo(cfps).agg(
        F.count(F.lit(1)).alias("hits"),
        F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.min("lng").alias("west"), F.max("lng").alias("east"),
    )


def urgency(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit("unknown"))
        .when(days <= 7, F.lit("critical"))
        .when(days <= 30, F.lit("warning"))
        .otherwise(F.lit("ok"))
    )


def trending_level(score: Column, threshold: float = 30) -> Column:
    return (
        F.when(score.isNull() | (score == 0) | (score < threshold), F.lit("none"))
        .when(score >= 60, F.lit("hot"))
        .when(score >= 45, F.lit("warm"))
        .otherwise(F.lit("mild"))
    )


def platform_url(cfp_url: Column, url: Column, domain: str = "sessionize.com") -> Column:
    """The first of the two links that is on ``domain``, NULL when neither is."""

    def on(link: Column) -> Column:
        return F.contains(F.lower(url_host(link)), F.lit(domain))

    return F.when(on(cfp_url), cfp_url).when(on(url), url)


def sessionize_only(cfps: DataFrame) -> DataFrame:
    link = platform_url(F.col("cfp_url"), F.col("url"))
    return cfps.withColumn("sessionize_url", link).filter(F.col("sessionize_url").isNotNull())


# ---- enrichment queues --------------------------------------------------------------------------
def needs_enrichment(cfps: DataFrame, cache: DataFrame, force: bool = False, limit: int | None = None) -> DataFrame:
    """Calls that are neither cached nor enriched; ``force`` keeps all. ``limit`` takes the first by id."""
    rows = cfps
    if not force:
        rows = cfps.filter(~F.coalesce(F.col("enriched"), F.lit(False))).join(
            cache.select("object_id"), "object_id", "left_anti"
        )
    return rows if limit is None else rows.orderBy("object_id").limit(limit)


def needs_intel(cfps: DataFrame) -> DataFrame:
    return cfps.filter(~F.coalesce(F.col("intel_enriched"), F.lit(False)))


def missing_description(cfps: DataFrame) -> DataFrame:
    return cfps.filter(strip(F.coalesce(F.col("description"), F.lit(""))) == "")


# ---- talks --------------------------------------------------------------------------------------
def _long_enough(seconds: Column, minimum: int) -> Column:
    known = F.coalesce(seconds, F.lit(0))
    return (known <= 0) | (known >= minimum)


def filter_talks_by_conference(talks: DataFrame, order: list[str]) -> DataFrame:
    """Search hits that look like conference talks; a link counts once, first in ``order``."""
    once = first_per_key(talks, ["url"], [F.col(c) for c in order])
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    channel = F.lower(F.coalesce(F.col("channel"), F.lit("")))
    description = F.lower(F.coalesce(F.col("description"), F.lit("")))
    return once.filter(
        _long_enough(F.col("duration_seconds"), 600)
        & (F.coalesce(F.col("view_count"), F.lit(0)) <= 500000)
        & ~contains_any(title, [*L.TALK_BLOCKED_WORDS, *L.PROMO_WORDS, "shorts"])
        & ~contains_any(channel, L.CHANNEL_BLOCKED_WORDS)
        & (contains_any(title, L.TECH_WORDS) | contains_any(description, L.TECH_WORDS) | contains_any(channel, L.TECH_WORDS))
    )


def filter_talks_by_speaker(talks: DataFrame, speaker: str, order: list[str]) -> DataFrame:
    """Search hits for one person: distinct ids, no shorts or promos, the speaker filled in."""
    once = first_per_key(talks.filter(F.col("object_id") != ""), ["object_id"], [F.col(c) for c in order])
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    kept = once.filter(
        _long_enough(F.col("duration_seconds"), 300)
        & ~contains_any(title, [*L.PROMO_WORDS, "shorts", "interview"])
    )
    return kept.withColumn("speaker", or_else(F.col("speaker"), F.lit(speaker)))


def filter_example_talks(talks: DataFrame, k: int, key: str = "conference_id") -> DataFrame:
    """The ``k`` most viewed real talks of each conference."""
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    kept = talks.filter(_long_enough(F.col("duration_seconds"), 300) & ~contains_any(title, L.PROMO_WORDS))
    return top_k_per_key(kept, [key], [F.coalesce(F.col("view_count"), F.lit(0)).desc(), F.col("object_id")], k)


def min_duration(videos: DataFrame, minutes: int, existing: DataFrame | None = None) -> DataFrame:
    """Channel import: long enough and not indexed yet."""
    kept = videos.filter(F.coalesce(F.col("duration_seconds"), F.lit(0)) >= minutes * 60)
    return kept if existing is None else kept.join(existing.select("object_id"), "object_id", "left_anti")


# ---- names and channels -------------------------------------------------------------------------
def is_valid_speaker(name: Column) -> Column:
    """A name that may be a person's."""
    lowered = strip(F.lower(name))
    return F.coalesce(
        (F.length(name) >= 3)
        & ~_any_pattern(lowered, L.NOT_A_PERSON_PATTERNS)
        & ~matches(lowered, L.QUESTION_START_PATTERN)
        & ~contains_any(lowered, L.EVENT_WORDS),
        F.lit(False),
    )


def is_blocked_speaker(name: Column) -> Column:
    return strip(F.lower(name)).isin(L.BLOCKED_SPEAKERS)


def is_garbage_speaker(name: Column, slug: Column | None = None) -> Column:
    slug = slugify(name) if slug is None else slug
    return slug.isin(L.GARBAGE_SLUGS) | _any_pattern(F.lower(name), L.GARBAGE_PATTERNS)


def is_conference_channel(name: Column) -> Column:
    lowered = F.lower(name)
    return F.coalesce(
        ~contains_any(lowered, L.NOT_CONFERENCE_CHANNEL_WORDS)
        & (contains_any(lowered, L.CONFERENCE_CHANNEL_WORDS) | matches(lowered, r"\w+conf\b")),
        F.lit(False),
    )


def is_company_channel(name: Column) -> Column:
    return F.coalesce(contains_any(F.lower(name), L.COMPANY_CHANNEL_WORDS), F.lit(False))


# ---- community posts ----------------------------------------------------------------------------
def name_variants(conference: Column) -> Column:
    """Lower-case clean name as it is, without blanks and hyphenated."""
    clean = F.lower(clean_name(conference))
    return F.array(clean, F.replace(clean, F.lit(" "), F.lit("")), F.replace(clean, F.lit(" "), F.lit("-")))


def is_noise_title(title: Column, conference: Column) -> Column:
    """A post title that is not about the conference."""
    lowered = F.lower(title)
    mentioned = F.exists(name_variants(conference), lambda v: F.contains(lowered, v))
    return _any_pattern(lowered, L.NOISE_PATTERNS) | ~mentioned


def drop_noise_subreddits(posts: DataFrame) -> DataFrame:
    return posts.filter(~F.lower(F.coalesce(F.col("subreddit"), F.lit(""))).isin(L.NOISE_SUBREDDITS))


def devto_name_filter(articles: DataFrame, conference: str) -> DataFrame:
    """Articles tagged with the conference or naming it in title or description, each once."""
    name = re.sub(r"\s*\(.*\)$", "", re.sub(r"(?i)\s*-\s*CFP.*$", "", re.sub(r"\s*20\d{2}\s*", " ", conference))).strip()
    tag = re.sub(r"[^a-z0-9]", "", name.lower())

    def names(column: str) -> Column:
        return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(name.lower()))

    hit = F.array_contains(F.col("tags"), tag) | names("title") | names("description")
    return first_per_key(articles.filter(hit), ["url"], [F.col("article_id")])

