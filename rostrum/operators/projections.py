"""Projections of feed and listing rows to canonical calls and talks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions import dates as D
from rostrum.functions import places as P
from rostrum.functions.arrays import clean_tags
from rostrum.functions.cuts import RECORD, Cuts, cut_text
from rostrum.functions.text import (
    blank_to_null, channel_title_speaker, hash_id, literal_map, or_else, repair_text, slugify,
    speaker_from_title, strip, url_key,
)



def _strings() -> Column:
    return F.array().cast("array<string>")


# ---- feeds to calls -----------------------------------------------------------------------------
def transform_aggregator(raw: DataFrame) -> DataFrame:
    """Aggregator rows (camelCase feed columns) to calls."""
    c = F.col
    both = (c("latitude") != 0) & (c("longitude") != 0)
    dated = {}
    for name, source in (
        ("cfp_start_date", "dateCfpStart"), ("cfp_end_date", "dateCfpEnd"),
        ("event_start_date", "dateEventStart"), ("event_end_date", "dateEventEnd"),
    ):
        dated[name] = D.parse_iso(c(source))
        dated[f"{name}_iso"] = D.iso_day(c(source))
    return raw.select(
        hash_id("uri").alias("object_id"),
        F.coalesce(repair_text(c("name")), c("name")).alias("name"),
        repair_text(c("description")).alias("description"),
        c("eventUri").alias("url"), c("uri").alias("cfp_url"), c("iconUri").alias("icon_url"),
        *[column.alias(name) for name, column in dated.items()],
        P.location(raw=F.coalesce(c("location"), F.lit(""))).alias("location"),
        F.when(both, F.struct(c("latitude").alias("lat"), c("longitude").alias("lng"))).alias("geoloc"),
        F.filter("tags", lambda t: strip(t) != "").alias("topics"), _strings().alias("topics_normalized"),
        or_else(c("source"), F.lit(L.PREFERRED_SOURCE)).alias("source"),
    )


def transform_topic_file(raw: DataFrame) -> DataFrame:
    """Topic-file rows (with their ``topic``) to calls."""
    c = F.col
    online = F.coalesce(c("online"), F.lit(False))
    has_city = blank_to_null(c("city")).isNotNull()
    where = F.concat(F.coalesce("city", F.lit("")), F.lit(", "), F.coalesce("country", F.lit("")))
    return raw.select(
        hash_id("url", "name", prefix="confstech").alias("object_id"),
        "name", F.lit(None).cast("string").alias("description"), "url", c("cfpUrl").alias("cfp_url"),
        D.deadline_epoch(c("cfpEndDate")).alias("cfp_end_date"), c("cfpEndDate").alias("cfp_end_date_iso"),
        D.deadline_epoch(c("startDate")).alias("event_start_date"), c("startDate").alias("event_start_date_iso"),
        D.deadline_epoch(c("endDate")).alias("event_end_date"), c("endDate").alias("event_end_date_iso"),
        P.location(
            city=c("city"), country=c("country"), raw=F.regexp_replace(where, "^[, ]+|[, ]+$", "")
        ).alias("location"),
        F.array("topic").alias("topics"),
        F.array(F.coalesce(F.try_element_at(literal_map(L.FEED_TOPIC_TO_CATEGORY), c("topic")), c("topic"))).alias("topics_normalized"),
        F.when(online & has_city, F.lit("hybrid")).when(online, F.lit("virtual")).otherwise(F.lit("in-person")).alias("event_format"),
        F.lit("confs.tech").alias("source"),
    )


def transform_deadlines(raw: DataFrame) -> DataFrame:
    """Academic deadline rows to calls; ``sub`` is an array of subjects."""
    c = F.col
    short = F.concat_ws(" ", c("title"), c("year").cast("string"))
    subjects = F.coalesce("sub", _strings())
    table = literal_map(L.SUBJECT_TO_CATEGORY)
    categories = F.transform(subjects, lambda s: F.coalesce(F.try_element_at(table, s), F.lit("ai-ml")))
    iso = F.when((c("deadline") != "") & (c("deadline") != "TBA"), F.substring("deadline", 1, 10))

    def day(column: str) -> Column:
        return F.when(c(column).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & c(column).try_cast("date").isNotNull(), c(column))

    return raw.select(
        hash_id("id", "year", prefix="aideadlines").alias("object_id"),
        F.when(c("full_name") != "", F.concat(c("full_name"), F.lit(" ("), short, F.lit(")"))).otherwise(short).alias("name"),
        c("note").alias("description"), c("link").alias("url"), c("link").alias("cfp_url"),
        D.parse_deadline(c("deadline")).alias("cfp_end_date"), iso.alias("cfp_end_date_iso"),
        D.parse_deadline(c("start")).alias("event_start_date"), day("start").alias("event_start_date_iso"),
        D.parse_deadline(c("end")).alias("event_end_date"), day("end").alias("event_end_date_iso"),
        P.parse_place(c("place")).alias("location"), subjects.alias("topics"),
        F.array_sort(F.array_distinct(categories)).alias("topics_normalized"),
        F.lit("advanced").alias("audience_level"), c("timezone"), c("hindex"),
        F.lit("aideadlines").alias("source"),
    )


def transform_devevents(raw: DataFrame) -> DataFrame:
    """Developer-event rows (nested ``conf``, dates in milliseconds) to calls."""
    c = F.col
    start = D.ms_to_s(F.get("conf.date", F.lit(0)))
    end = F.when(F.size("conf.date") > 1, D.ms_to_s(F.get("conf.date", F.lit(1)))).otherwise(start)
    deadline = D.ms_to_s(c("untilDate"))
    return raw.select(
        hash_id("link", "conf.name", prefix="developerevents").alias("object_id"),
        c("conf.name").alias("name"), F.lit(None).cast("string").alias("description"),
        c("conf.hyperlink").alias("url"), c("link").alias("cfp_url"),
        deadline.alias("cfp_end_date"), D.epoch_day(deadline).alias("cfp_end_date_iso"),
        start.alias("event_start_date"), D.epoch_day(start).alias("event_start_date_iso"),
        end.alias("event_end_date"), D.epoch_day(end).alias("event_end_date_iso"),
        P.parse_city_country(c("conf.location")).alias("location"),
        _strings().alias("topics"), _strings().alias("topics_normalized"),
        F.lit("developers.events").alias("source"),
    )


def extracted_to_cfp(rows: DataFrame, source: str = "extracted") -> DataFrame:
    """Page extracts to calls; a row without a name or a name hint is dropped."""
    c = F.col
    name = or_else(c("name"), c("name_hint"))
    dated = []
    for field in ("cfp_end_date", "cfp_start_date", "event_start_date", "event_end_date"):
        dated += [D.iso_day_epoch(c(field)).alias(field), c(field).alias(f"{field}_iso")]
    return rows.filter(name.isNotNull()).select(
        hash_id(url_key(c("page_url")), kind="sha256").alias("object_id"),
        name.alias("name"), "description", c("page_url").alias("url"),
        or_else(c("cfp_url"), c("page_url")).alias("cfp_url"), *dated,
        P.location(
            city=c("city"), country=c("country"), raw=F.coalesce("location_raw", F.lit(""))
        ).alias("location"),
        "topics", _strings().alias("topics_normalized"), "full_text", F.lit(source).alias("source"),
        F.lit(True).alias("enriched"), F.when(c("is_online"), F.lit("virtual")).alias("event_format"),
    )


def favicon_fill(cfps: DataFrame) -> DataFrame:
    """Derive a missing icon link from the host of the event or call link."""
    link = or_else(F.col("url"), F.col("cfp_url"))
    host = F.regexp_extract(link, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_extract(link, r"^([^/?#]*)", 1)
    domain = F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), blank_to_null(host)).otherwise(blank_to_null(bare))
    derived = F.concat(F.lit(L.FAVICON_PREFIX), domain, F.lit(L.FAVICON_SUFFIX))
    return cfps.withColumn("icon_url", or_else(F.col("icon_url"), derived))


# ---- talks --------------------------------------------------------------------------------------
def to_talk(hits: DataFrame, conference_id: str, conference_name: str) -> DataFrame:
    """Video search hits to talks of one conference."""
    c = F.col
    listed = F.regexp_extract(c("url"), r"(?s)^.*v=(.*)$", 1)
    video = F.when(F.contains(c("url"), F.lit("v=")), F.regexp_extract(listed, "(?s)^[^&]*", 0)).otherwise(
        F.regexp_extract(c("url"), "(?s)^[^&]*", 0)
    )
    hashed = F.substring(F.sha2(c("url"), 256), 1, 12)
    key = F.when((video == "") | (video == c("url")), hashed).otherwise(video)
    return hits.select(
        F.concat(F.lit("yt_"), key).alias("object_id"),
        F.lit(conference_id).alias("conference_id"), F.lit(conference_name).alias("conference_name"),
        slugify(F.lit(conference_name)).alias("conference_slug"), "title", "speaker",
        F.when(c("speaker") != "", F.array("speaker")).otherwise(_strings()).alias("speakers"),
        *[x for x in ("description", "url", "thumbnail_url", "channel", "duration_seconds", "view_count", "year") if x in hits.columns],
    )


def derive_talk_fields(talks: DataFrame, as_of_year: int) -> DataFrame:
    """Minutes (floored, unless known) and views per year since upload."""
    known = F.nullif(F.col("duration_minutes"), F.lit(0)) if "duration_minutes" in talks.columns else F.lit(None).cast("bigint")
    minutes = F.when(F.col("duration_seconds") != 0, F.floor(F.col("duration_seconds") / 60))
    age = F.greatest(F.lit(1), F.lit(as_of_year) - F.col("year"))
    popular = F.when((F.col("view_count") != 0) & (F.col("year") != 0), F.col("view_count") / age)
    return talks.withColumns({
        "duration_minutes": F.coalesce(known, minutes).cast("bigint"), "popularity_score": popular,
    })


def playlist_talks(videos: DataFrame, channel: str, conference: str, skip: Sequence[str] = ("keynote", "dev build", "welcome to")) -> DataFrame:
    """Playlist videos of one channel to talks of its yearly conference."""
    c = F.col
    title = F.lower(F.coalesce("title", F.lit("")))
    kept = videos.filter(
        (F.lower("channel") == channel.lower()) & c("source").startswith("playlist:") & (c("video_id") != "")
    )
    for phrase in skip:
        kept = kept.filter(~F.contains(title, F.lit(phrase)))
    parts = channel_title_speaker(c("title"))
    year = F.nullif("year", F.lit(0)).cast("string")
    base = conference.lower().replace(" ", "-")
    return kept.withColumn("__p", parts).select(
        F.concat(F.lit("yt_"), c("video_id")).alias("object_id"),
        or_else(c("__p.title"), c("title")).alias("title"), c("__p.speaker").alias("speaker"),
        F.concat_ws(" ", F.lit(conference), year).alias("conference_name"),
        F.concat_ws("-", F.lit(base), year).alias("conference_id"), "year",
    )


def channel_entry_to_talk(entries: DataFrame, conference_id: str, conference_name: str, brands: Sequence[str] = (), cuts: Cuts = RECORD) -> DataFrame:
    """Channel listing rows to talks; minutes are rounded half to even here."""
    c = F.col
    parts = speaker_from_title(c("title"), brands)
    minutes = F.when(F.coalesce("duration_seconds", F.lit(0)) != 0, F.bround(c("duration_seconds") / 60, 0).cast("bigint"))
    watch = F.concat(F.lit("https://www.youtube.com/watch?v="), c("video_id"))
    return entries.withColumn("__p", parts).select(
        F.concat(F.lit("yt_"), c("video_id")).alias("object_id"),
        F.lit(conference_id).alias("conference_id"), F.lit(conference_name).alias("conference_name"),
        c("__p.title").alias("title"), c("title").alias("original_title"), c("__p.speaker").alias("speaker"),
        cut_text(F.coalesce("description", F.lit("")), cuts.description).alias("description"),
        or_else(c("url"), watch).alias("url"),
        F.year(F.timestamp_seconds(F.nullif("uploaded_at", F.lit(0)))).alias("year"),
        "duration_seconds", minutes.alias("duration_minutes"), "view_count",
    )


def apply_transcripts(talks: DataFrame, outcomes: DataFrame, cuts: Cuts = RECORD) -> DataFrame:
    """Add transcript fields to the talks that have a successful outcome; others stay as they are."""
    fields = ("text", "summary", "keywords", "topics", "takeaways")
    found = outcomes.filter(blank_to_null(F.col("text")).isNotNull() & blank_to_null(F.col("summary")).isNotNull())
    joined = talks.join(found.select("object_id", F.struct(*fields).alias("o")), "object_id", "left")
    hit = F.col("o").isNotNull()
    new = {
        "transcript_text": cut_text("o.text", cuts.transcript), "transcript_summary": F.col("o.summary"),
        "transcript_keywords": F.col("o.keywords"), "transcript_topics": F.col("o.topics"),
        "transcript_takeaways": F.col("o.takeaways"), "transcript_enriched": F.lit(True),
    }
    out = {}
    for name, value in new.items():
        out[name] = F.when(hit, value).otherwise(F.col(name)) if name in talks.columns else F.when(hit, value)
    return joined.withColumns(out).drop("o")


def normalized(cfps: DataFrame) -> DataFrame:
    """Unify location and tags of a call."""
    return cfps.withColumns({"location": P.normalize_location(F.col("location")), "topics": clean_tags(F.col("topics"))})


