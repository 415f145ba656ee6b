"""Aggregations over talks, speakers, channels, calls and tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions.text import contains_any, normalize_tag
from rostrum.operators.filters import is_blocked_speaker, is_company_channel, is_conference_channel, is_open
from rostrum.operators.joins import resolve_alias
from rostrum.plans.storage import stored
from rostrum.plans.skew import top_k, top_k_array, top_k_per_key



def counter(df: DataFrame, keys: Sequence[str], value: str, name: str = "n") -> DataFrame:
    """How often each value occurs per key."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias(name))


def counter_topk(df: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values per key with count and rank; ties in value order.

    The counts are partial sums before the shuffle and the rank is cut before the second one.
    """
    return top_k_per_key(counter(df, keys, value), keys, [F.col("n").desc(), F.col(value)], k)


# ---- speakers -----------------------------------------------------------------------------------
def speaker_appearances(talks: DataFrame, aliases: DataFrame | None = None, dedupe_person: bool = False) -> DataFrame:
    """One row per talk and listed name: distinct names, blocked ones dropped, aliases resolved.

    Two spellings of one person in a talk count twice unless ``dedupe_person``.
    """
    names = F.array_distinct(
        F.filter(
            F.concat(F.array("speaker"), F.coalesce(F.col("speakers"), F.array().cast("array<string>"))),
            lambda n: n.isNotNull() & (F.length(n) >= 2),
        )
    )
    rows = talks.withColumn("name", F.explode(names)).drop("speaker", "speakers")
    rows = resolve_alias(rows.filter(~is_blocked_speaker(F.col("name"))), aliases).filter(F.col("slug") != "")
    return rows.dropDuplicates(["object_id", "slug"]) if dedupe_person else rows


def speaker_totals(appearances: DataFrame) -> DataFrame:
    """One row per slug: counts, views, years and the longest name."""
    views = F.coalesce(F.col("view_count"), F.lit(0)).cast("bigint")
    year = F.nullif(F.col("year"), F.lit(0))
    longest = F.greatest(_name_rank("name"), _name_rank("display_name"))
    # years are few per speaker once counted by year
    by_year = appearances.groupBy("slug", year.alias("year")).agg(
        F.max(longest).alias("longest"), F.count("*").alias("n"), F.sum(views).alias("views"), F.max(views).alias("most"))
    return by_year.groupBy("slug").agg(
        F.max("longest")["name"].alias("name"),
        F.sum("n").alias("talk_count"),
        F.sum("views").alias("total_views"),
        F.max("most").alias("max_views"),
        F.array_sort(F.collect_list("year")).alias("years_active"),
    ).withColumns({
        "first_talk_year": F.array_min("years_active"),
        "latest_talk_year": F.array_max("years_active"),
        "active_years": F.size("years_active").cast("bigint"),
    })


def _name_rank(column: str) -> Column:
    return F.struct(F.length(column).alias("length"), F.col(column).alias("name"))


def speaker_names(appearances: DataFrame) -> DataFrame:
    """All spellings of each speaker as rows."""
    return appearances.select("slug", F.explode(F.array("name", "display_name")).alias("alias")).distinct()


def speaker_topics(appearances: DataFrame) -> DataFrame:
    """Whole topic counter of each speaker as rows."""
    return counter(appearances.withColumn("topic", F.explode("topics")), ["slug"], "topic")


def speaker_conferences(appearances: DataFrame) -> DataFrame:
    """Whole conference counter of each speaker as rows."""
    return counter(appearances.filter(F.col("conference_name") != ""), ["slug"], "conference_name")


def speaker_talks(appearances: DataFrame) -> DataFrame:
    """All talks of each speaker as rows, most viewed first within a speaker.

    A range sort splits a prolific speaker over many tasks; no per-speaker array is built.
    """
    views = F.coalesce(F.col("view_count"), F.lit(0))
    rows = appearances.select("slug", "object_id", views.cast("bigint").alias("view_count"))
    return rows.orderBy("slug", F.col("view_count").desc(), "object_id")


def speaker_scores(speakers: DataFrame) -> DataFrame:
    """Average views, influence (views per active year) and consistency (talks per active year)."""

    def per(value: str, by: str) -> Column:
        return F.when(F.col(by) == 0, F.lit(0.0)).otherwise(F.col(value) / F.col(by))

    return speakers.withColumns({
        "avg_views": per("total_views", "talk_count"),
        "influence_score": per("total_views", "active_years"),
        "consistency_score": per("talk_count", "active_years"),
    })


def _conference_facts(conferences: DataFrame) -> DataFrame:
    """Per speaker: number of conferences and which keyword groups their names hit."""
    lowered = F.lower("conference_name")
    flags = {}
    for continent, words in L.CONTINENT_WORDS.items():
        flags[f"in_{continent}"] = F.max(contains_any(lowered, words))
        leading = [w.strip() for w in words if w.startswith(" ")]
        if leading:
            # in a blank-joined list of names a word with a leading blank also starts a later name
            starts = F.lit(False)
            for word in leading:
                starts = starts | lowered.startswith(word)
            flags[f"starting_{continent}"] = F.count_if(starts)
            flags[f"top_starting_{continent}"] = F.min_by(starts, F.struct((-F.col("n")).alias("n"), "conference_name"))
    flags["main_stage"] = F.max(contains_any(lowered, L.LARGE_CONFERENCES))
    facts = conferences.groupBy("slug").agg(
        F.count("*").alias("conference_count"), *[c.alias(n) for n, c in flags.items()]
    )
    for name in [n for n in flags if n.startswith("starting_")]:
        continent = name.removeprefix("starting_")
        later = F.col(name) - F.col(f"top_{name}").cast("int")
        facts = facts.withColumn(f"in_{continent}", F.col(f"in_{continent}") | (later > 0)).drop(name, f"top_{name}")
    return facts


def build_speakers(
    talks: DataFrame, as_of_year: int, aliases: DataFrame | None = None, dedupe_person: bool = False
) -> DataFrame:
    """Speaker profiles: totals, scores, top topics, top talks and badges.

    Lists that grow with the data (all talks, all conferences, all spellings) are the companion
    tables ``speaker_talks``, ``speaker_conferences`` and ``speaker_names``; the profile holds the
    bounded parts only. The narrow appearances are written once; every branch reads them.
    """
    narrow = [c for c in ("object_id", "speaker", "speakers", "conference_name", "view_count", "year", "topics") if c in talks.columns]
    rows = stored(speaker_appearances(talks.select(*narrow), aliases, dedupe_person), "appearances")
    topics = top_k_per_key(speaker_topics(rows), ["slug"], [F.col("n").desc(), F.col("topic")], 10)
    entry = F.array_sort(F.collect_list(F.struct("rank", "topic", "n")))
    topics = topics.groupBy("slug").agg(
        F.transform(entry, lambda e: e["topic"]).alias("topics"), F.max("n").alias("top_topic_count")
    )
    top_talks = top_k_array(
        rows.select("slug", "object_id", F.coalesce("view_count", F.lit(0)).alias("v")),
        ["slug"], [F.col("v").desc(), F.col("object_id")], 5, F.col("object_id"), "top_talk_ids",
    )
    profile = (
        speaker_scores(speaker_totals(rows))
        .join(topics, "slug", "left")
        .join(_conference_facts(speaker_conferences(rows)), "slug", "left")
        .join(top_talks, "slug", "left")
        .withColumns({
            "topics": F.coalesce("topics", F.array().cast("array<string>")),
            "conference_count": F.coalesce("conference_count", F.lit(0)),
        })
    )
    flags = [c for c in profile.columns if c.startswith("in_")] + ["main_stage", "top_topic_count"]
    return profile.withColumn("achievements", achievements(as_of_year)).drop(*flags)


def achievements(as_of_year: int) -> Column:
    """Badges of a speaker by threshold ladders, one expression over the profile columns."""

    def ladder(column: str, *steps: tuple[float, str]) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for bound, badge in steps:
            out = out.when(F.col(column) >= bound, F.lit(badge))
        return out

    continents = sum(
        (F.coalesce(F.col(f"in_{c}"), F.lit(False)).cast("int") for c in L.CONTINENT_WORDS), start=F.lit(0)
    )
    rising = (F.col("first_talk_year") >= as_of_year - 2) & (F.col("talk_count") >= 3)
    expert = F.concat(F.lit("Expert: "), F.get("topics", F.lit(0)))
    return F.array_compact(F.array(
        ladder("total_views", (1000000, "Million Club"), (100000, "100K Club"), (10000, "10K Club")),
        ladder("max_views", (100000, "Viral Sensation"), (50000, "Viral Hit")),
        ladder("talk_count", (50, "Legend"), (20, "Prolific"), (10, "Frequent Flyer")),
        ladder("active_years", (10, "Decade Veteran"), (5, "Veteran"), (3, "Established")),
        F.when(rising, F.lit("Rising Star")),
        ladder("conference_count", (10, "Globe Trotter"), (5, "Multi-Conference")),
        F.when(F.size("topics") >= 5, F.lit("Polymath")).when(F.size("topics") >= 3, F.lit("Multi-Domain")),
        F.when(F.col("top_topic_count") >= 5, expert),
        ladder("consistency_score", (3.0, "Consistent")),
        F.when(continents >= 3, F.lit("World Traveler")).when(continents >= 2, F.lit("International")),
        F.when(F.coalesce(F.col("main_stage"), F.lit(False)), F.lit("Main Stage")),
    ))


def achievement_counts(speakers: DataFrame, k: int = 5) -> DataFrame:
    counted = counter(speakers.select(F.explode("achievements").alias("badge")), [], "badge")
    return top_k(counted, [F.col("n").desc(), F.col("badge")], k)


# ---- channels -----------------------------------------------------------------------------------
def channels_for_speaker(talks: DataFrame) -> DataFrame:
    """Channels of one speaker's talks, most talks first."""
    views = F.sum(F.coalesce(F.col("view_count"), F.lit(0)).cast("bigint"))
    return talks.groupBy("channel").agg(
        F.count("*").alias("talk_count"), views.alias("total_views"),
        F.array_sort(F.collect_set(F.nullif("year", F.lit(0)))).alias("years"),
    ).withColumn("avg_views", F.expr("total_views div talk_count")).orderBy(F.col("talk_count").desc(), "channel")


def channel_profiles(talks: DataFrame) -> DataFrame:
    """Totals and class of each channel; its speakers are the rows of ``channel_speakers``."""
    known = talks.filter((F.col("channel") != "") & (F.col("channel") != "Unknown"))
    views = F.coalesce(F.col("view_count"), F.lit(0)).cast("bigint")
    by_year = known.groupBy("channel", "speaker", "year").agg(F.count("*").alias("n"), F.sum(views).alias("views"))
    years = by_year.groupBy("channel", "year").agg(F.sum("n").alias("n"), F.sum("views").alias("views")).groupBy("channel").agg(
        F.sum("n").alias("talk_count"), F.sum("views").alias("total_views"), F.array_sort(F.collect_list("year")).alias("years"))
    people = by_year.select("channel", "speaker").distinct().groupBy("channel").agg(F.count("speaker").alias("speaker_count"))
    return years.join(people, "channel").select(
        "channel", "talk_count", "total_views", "years", "speaker_count",
    ).withColumns({
        "is_conference": is_conference_channel(F.col("channel")),
        "is_company": is_company_channel(F.col("channel")),
    })


def channel_speakers(talks: DataFrame, order: str = "talk_id") -> DataFrame:
    """Distinct speakers per channel as rows with the place of their first talk."""
    known = talks.filter((F.col("channel") != "") & (F.col("channel") != "Unknown") & F.col("speaker").isNotNull())
    return known.groupBy("channel", "speaker").agg(F.min(order).alias("first_talk"), F.count("*").alias("talks"))


def channel_import_stats(videos: DataFrame, minutes: int) -> DataFrame:
    """Per channel: talks that are long enough and their number of named speakers."""
    kept = videos.filter(
        (F.coalesce(F.col("duration_seconds"), F.lit(0)) >= minutes * 60) & (F.col("object_id") != "")
    )
    per_speaker = kept.groupBy("channel", "speaker").agg(F.count("*").alias("n"))
    return per_speaker.groupBy("channel").agg(
        F.sum("n").alias("talk_count"), F.count("speaker").alias("speaker_count"),
        F.max(F.when(F.col("speaker").isNotNull(), F.col("n"))).alias("most_by_one_speaker"),
    )


# ---- calls --------------------------------------------------------------------------------------
def status_counts(cfps: DataFrame, as_of: int) -> DataFrame:
    now_open = is_open(F.col("cfp_end_date"), as_of)
    return cfps.agg(F.count_if(now_open).alias("open"), F.count_if(~now_open).alias("closed"))


def top_regions(cfps: DataFrame, k: int = 5) -> DataFrame:
    region = F.coalesce(F.nullif("region", F.lit("")), F.nullif("continent", F.lit("")), F.lit("Unknown"))
    counted = counter(cfps.select(region.alias("region")), [], "region")
    return top_k(counted, [F.col("n").desc(), F.col("region")], k)


def top_categories(cfps: DataFrame, k: int = 5) -> DataFrame:
    counted = counter(cfps.select(F.explode("topics").alias("category")), [], "category")
    return top_k(counted, [F.col("n").desc(), F.col("category")], k)


def dataset_stats(cfps: DataFrame, as_of: int, k: int = 5) -> DataFrame:
    """Status counts and the largest regions and categories as ``(kind, value, n)`` rows."""
    status = status_counts(cfps, as_of).select(F.expr("stack(2, 'open', open, 'closed', closed) AS (value, n)"))
    parts = [
        status.select(F.lit("status").alias("kind"), "value", "n"),
        top_regions(cfps, k).select(F.lit("region").alias("kind"), F.col("region").alias("value"), "n"),
        top_categories(cfps, k).select(F.lit("category").alias("kind"), F.col("category").alias("value"), "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def named_counts(df: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """One pass over the rows, one ``(category, n)`` row per predicate."""
    counted = df.agg(*[F.count_if(p).alias(f"c{i}") for i, p in enumerate(predicates.values())])
    pairs = F.array(*[
        F.struct(F.lit(name).alias("category"), F.col(f"c{i}").alias("n")) for i, name in enumerate(predicates)
    ])
    return counted.select(F.inline(pairs))


def intel_stats(cfps: DataFrame, talks: DataFrame, as_of: int) -> DataFrame:
    """How many calls and talks fall in each category used for planning."""
    days = F.floor((F.col("cfp_end_date") - as_of) / 86400)
    calls = named_counts(cfps, {
        "Total CFPs": F.lit(True),
        "Intel-enriched": F.col("intel_enriched"),
        "With popularity score": F.col("popularity_score") > 0,
        "With HN stories": F.col("hn_stories") > 0,
        "With GitHub repos": F.col("github_repos") > 0,
        "With Reddit posts": F.col("reddit_posts") > 0,
        "Hot deadlines (<=7d)": days.between(0, 7),
        "Warning deadlines (7-30d)": (days > 7) & (days <= 30),
    })
    return calls.unionByName(named_counts(talks, {
        "Total talks": F.lit(True), "Viral (>10K views)": F.col("view_count") > 10000,
    }))


def audit_coverage(cfps: DataFrame) -> DataFrame:
    """Count and percentage of calls with description, topics and the enriched flag."""
    total = F.count("*")

    def part(flag: Column, name: str) -> list[Column]:
        n = F.count_if(F.coalesce(flag, F.lit(False)))
        return [n.alias(name), F.round(F.lit(100.0) * n / F.nullif(total, F.lit(0)), 1).alias(f"{name}_pct")]

    return cfps.agg(
        total.alias("total"),
        *part(F.trim("description") != "", "with_description"),
        *part(F.size("topics") > 0, "with_topics"),
        *part(F.col("enriched"), "enriched"),
    )


def _facet_entries(name: str, values: Column) -> Column:
    known = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.transform(known, lambda v: F.struct(F.lit(name).alias("attribute"), v.alias("value")))


def facet_counts(
    df: DataFrame, attributes: Mapping[str, Column], k: int, refinements: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Value counts of every facet in one pass, top ``k`` each, as ``(attribute, value, n, rank)``.

    ``attributes`` maps a name to an array-typed column. Facets are disjunctive: the counts of one
    attribute ignore that attribute's own refinement, so each row feeds only the facets whose other
    refinements it meets.
    """
    refinements = refinements or {}
    meets = {
        name: F.arrays_overlap(attributes[name], F.array(*[F.lit(v) for v in values]))
        for name, values in refinements.items()
    }
    pairs = []
    for name, values in attributes.items():
        entries = _facet_entries(name, values)
        others = F.lit(True)
        for other, ok in meets.items():
            if other != name:
                others = others & F.coalesce(ok, F.lit(False))
        pairs.append(F.when(others, entries))
    empty = F.array().cast("array<struct<attribute:string,value:string>>")
    rows = df.select(F.inline(F.concat(*[F.coalesce(p, empty) for p in pairs])))
    return counter_topk(rows, ["attribute"], "value", k)


def city_counts(cfps: DataFrame) -> DataFrame:
    places = cfps.filter((F.col("city") != "") & (F.lower("city") != "online"))
    return counter(places, [], "city").orderBy(F.col("n").desc(), "city")


def geocode_coverage(rows: DataFrame) -> DataFrame:
    """Counts and whole percentages of located rows."""
    total = F.count("*")
    flags = {
        "with_location": F.col("location_raw") != "", "geocoded": F.col("lat").isNotNull() & F.col("lng").isNotNull(),
        "with_city": F.col("city") != "", "with_country": F.col("country") != "", "errors": F.col("error") != "",
    }
    parts = [total.alias("total")]
    for name, flag in flags.items():
        n = F.count_if(F.coalesce(flag, F.lit(False)))
        parts += [n.alias(name), F.floor(100 * n / F.nullif(total, F.lit(0))).cast("bigint").alias(f"{name}_pct")]
    return rows.agg(*parts)


# ---- tags ---------------------------------------------------------------------------------------
def tag_frequencies(talks: DataFrame) -> DataFrame:
    """How often each tag occurs over keywords and topics of enriched talks."""
    empty = F.array().cast("array<string>")
    tags = F.concat(F.coalesce(F.col("keywords"), empty), F.coalesce(F.col("topics"), empty))
    return counter(talks.filter("transcript_enriched").select(F.explode(tags).alias("tag")), [], "tag")


def tag_clusters(frequencies: DataFrame, extra: Mapping[str, str] | None = None, shown: int = 5) -> DataFrame:
    """Canonical tags with more than one spelling: total and the ``shown`` most frequent spellings."""
    named = frequencies.withColumn("canonical", normalize_tag(F.col("tag"), extra))
    totals = named.groupBy("canonical").agg(F.count("*").alias("variants"), F.sum("n").alias("total"))
    sample = top_k_array(named, ["canonical"], [F.col("n").desc(), F.col("tag")], shown, F.col("tag"), "sample")
    return totals.filter("variants > 1").join(sample, "canonical").orderBy(F.col("total").desc(), "canonical")


def enrichment_outcomes(outcomes: DataFrame) -> DataFrame:
    return counter(outcomes, [], "status")
