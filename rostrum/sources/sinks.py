"""Merges, index records and exports; stored tables are in ``rostrum.sources.snapshots``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.arrays import drop_empty, null_if_empty
from rostrum.functions.text import blank_to_null


# ---- merges (pure DataFrame forms) --------------------------------------------------------------
def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those with the same key as whole records; others are added."""
    return table.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def partial_update(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Replace the listed columns of existing keys; unknown keys are not added."""
    joined = table.join(changes.select(key, F.struct(*columns).alias("__new")), key, "left")
    hit = F.col("__new").isNotNull()
    return joined.withColumns({c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}).drop("__new")


# ---- records ------------------------------------------------------------------------------------
# camelCase name -> (column, cap of list columns or None)
INDEX_RECORD: Mapping[str, tuple[str, int | None]] = {
    "objectID": ("object_id", None), "name": ("name", None), "description": ("description", None), "url": ("url", None),
    "cfpUrl": ("cfp_url", None), "iconUrl": ("icon_url", None), "cfpStartDate": ("cfp_start_date", None),
    "cfpEndDate": ("cfp_end_date", None), "cfpStartDateISO": ("cfp_start_date_iso", None),
    "cfpEndDateISO": ("cfp_end_date_iso", None), "eventStartDate": ("event_start_date", None),
    "eventEndDate": ("event_end_date", None), "eventStartDateISO": ("event_start_date_iso", None),
    "eventEndDateISO": ("event_end_date_iso", None), "location": ("location", None), "topics": ("topics", None),
    "topicsNormalized": ("topics_normalized", None), "languages": ("languages", None),
    "audienceLevel": ("audience_level", None), "eventFormat": ("event_format", None), "talkTypes": ("talk_types", None),
    "industries": ("industries", None), "technologies": ("technologies", None), "fullText": ("full_text", None),
    "popularityScore": ("popularity_score", None), "hnStories": ("hn_stories", None), "hnPoints": ("hn_points", None),
    "hnStoryTitles": ("hn_story_titles", 10), "hnComments": ("hn_comments", 20), "githubRepos": ("github_repos", None),
    "githubStars": ("github_stars", None), "githubLanguages": ("github_languages", None),
    "githubTopics": ("github_topics", None), "githubDescriptions": ("github_descriptions", 10),
    "redditPosts": ("reddit_posts", None), "redditSubreddits": ("reddit_subreddits", None),
    "redditTitles": ("reddit_titles", 10), "redditComments": ("reddit_comments", 20),
    "devtoArticles": ("devto_articles", None), "devtoTags": ("devto_tags", None), "devtoTitles": ("devto_titles", 10),
    "intelTopics": ("intel_topics", None), "intelUrls": ("intel_urls", 20), "sessionizeUrl": ("sessionize_url", None),
    "attendance": ("attendance", None), "sessionFormats": ("session_formats", None),
    "speakerBenefits": ("speaker_benefits", None), "targetAudience": ("target_audience", None), "tracks": ("tracks", None),
    "source": ("source", None), "enriched": ("enriched", None), "intelEnriched": ("intel_enriched", None),
    "sessionizeEnriched": ("sessionize_enriched", None), "lastUpdated": ("last_updated", None), "_geoloc": ("geoloc", None),
}


def to_index_record(cfps: DataFrame) -> DataFrame:
    """``object_id`` and the camelCase record as JSON; empty values are left out, 0 and false stay."""
    types = dict(cfps.dtypes)
    fields = []
    for name, (column, cap) in INDEX_RECORD.items():
        if column not in types:
            continue
        value = F.col(column)
        if types[column].startswith("array"):
            value = null_if_empty(F.slice(value, 1, cap) if cap else value)
        elif types[column] == "string":
            value = blank_to_null(value)
        fields.append(value.alias(name))
    return cfps.select("object_id", drop_empty(F.struct(*fields)).alias("record"))


def explore_channels(channels: DataFrame, channel_speakers: DataFrame, k: int = 50, sample: int = 5) -> DataFrame:
    """Top channels with their first ``sample`` speakers, ready for a JSON export."""
    from rostrum.operators.windows import top_by_talks
    from rostrum.plans.skew import top_k_array

    top = top_by_talks(channels, k, "channel")
    first = channel_speakers.join(top.select("channel"), "channel", "left_semi")
    names = top_k_array(first, ["channel"], [F.col("first_talk"), F.col("speaker")], sample, F.col("speaker"), "sample_speakers")
    return top.join(names, "channel", "left")


def explore_speakers(speakers: DataFrame, speaker_channels: DataFrame, k: int = 50, sample: int = 5) -> DataFrame:
    """Top discovered speakers with their first ``sample`` channels."""
    from rostrum.operators.windows import top_by_talks
    from rostrum.plans.skew import top_k_array

    top = top_by_talks(speakers, k, "slug")
    first = speaker_channels.join(top.select("slug"), "slug", "left_semi")
    counted = first.groupBy("slug").agg(F.count("*").alias("channel_count"))
    names = top_k_array(first, ["slug"], [F.col("first_talk"), F.col("channel")], sample, F.col("channel"), "channels")
    return top.join(counted, "slug", "left").join(names, "slug", "left")


def write_events_csv(events: DataFrame, path: str) -> None:
    events.select("userToken", "timestamp", "objectID", "eventType", "eventName").write.mode("overwrite").option("header", True).csv(path)


def save_graph(path: str, nodes: Mapping[str, DataFrame], edges: DataFrame) -> None:
    """Node tables by kind and one edge table."""
    for kind, rows in nodes.items():
        rows.write.mode("overwrite").parquet(f"{path}/nodes/{kind}")
    edges.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str, kinds: Sequence[str]) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Nodes, edges and the new frontier: only seed speakers are queued again."""
    nodes = {kind: spark.read.parquet(f"{path}/nodes/{kind}") for kind in kinds}
    frontier = nodes["speakers"].filter("source = 'seed'").select("slug")
    return nodes, spark.read.parquet(f"{path}/edges"), frontier
