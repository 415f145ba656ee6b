"""Feeds written from the tables as files, read back and projected; talk projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.catalog.registry import Tables, register
from rostrum.operators import joins as J
from rostrum.operators import projections as P
from rostrum.operators import filters as FL
from rostrum.plans import jobs
from rostrum.plans.proxies import AS_OF
from rostrum.plans.storage import new_path
from rostrum.sources import readers as R
from rostrum.sources import sinks as S


def landed(t: Tables, text: str, name: str) -> str:
    """Write the rows of a query as JSON lines and return the folder."""
    path = new_path(t.spark, name)
    t.sql(text).write.json(path)
    return path


# ---- aggregator ---------------------------------------------------------------------------------
AGGREGATOR = """
    SELECT CASE WHEN seq % 17 = 0 THEN NULL ELSE name || ' ' || CAST(seq AS STRING) END AS name, cfp_url || CAST(seq AS STRING) AS uri,
           CASE WHEN seq % 3 = 0 THEN '2024-01-05' END AS dateCfpStart,
           '2024-0' || CAST(1 + seq % 9 AS STRING) || '-' || LPAD(CAST(1 + seq % 28 AS STRING), 2, '0') || 'T10:00:00Z' AS dateCfpEnd,
           '2024-11-' || LPAD(CAST(1 + seq % 28 AS STRING), 2, '0') || 'T00:00:00+01:00' AS dateEventStart,
           CASE WHEN seq % 5 = 0 THEN 'not a date' ELSE '2024-12-01' END AS dateEventEnd,
           city || ', ' || country AS location, lat AS latitude, lng AS longitude, description, 'https://e.example/' || CAST(seq AS STRING) AS eventUri,
           array(' ', topic_a, '') AS tags, CASE WHEN seq % 3 = 0 THEN 'joindin' END AS source, 'x' AS unknownField
    FROM {v_cfp}"""


@register("aggregator_feed", "SRC-1", "PRJ-1", "FN-DT-1", "FN-DT-2", oracle="""
    SELECT substr(sha1(cfp_url || CAST(seq AS VARCHAR)), 1, 16) AS object_id, name || ' ' || CAST(seq AS VARCHAR) AS name, description,
           CASE WHEN seq % 3 = 0 THEN CAST(1704412800 AS BIGINT) END AS cfp_start_date,
           CAST(epoch(make_timestamp(2024, 1 + seq % 9, 1 + seq % 28, 10, 0, 0)) AS BIGINT) AS cfp_end_date,
           '2024-0' || CAST(1 + seq % 9 AS VARCHAR) || '-' || LPAD(CAST(1 + seq % 28 AS VARCHAR), 2, '0') AS cfp_end_date_iso,
           CAST(epoch(make_timestamp(2024, 11, 1 + seq % 28, 0, 0, 0)) AS BIGINT) - 3600 AS event_start_date,
           CASE WHEN seq % 5 <> 0 THEN CAST(epoch(make_timestamp(2024, 12, 1, 0, 0, 0)) AS BIGINT) END AS event_end_date,
           city || ', ' || country AS raw_location, CASE WHEN lat <> 0 AND lng <> 0 THEN lat END AS lat, topic_a AS topics,
           CASE WHEN seq % 3 = 0 THEN 'joindin' ELSE 'callingallpapers' END AS source
    FROM {v_cfp} WHERE seq % 17 <> 0""")
def _(t):
    rows = R.read_aggregator_feed(t.spark, landed(t, AGGREGATOR, "aggregator"), multi_line=False).rows
    return P.transform_aggregator(rows).select(
        "object_id", "name", "description", "cfp_start_date", "cfp_end_date", "cfp_end_date_iso", "event_start_date", "event_end_date",
        F.col("location.raw").alias("raw_location"), F.col("geoloc.lat").alias("lat"), F.array_join("topics", ",").alias("topics"), "source",
    )


@register("feed_quarantine", "SRC-1", oracle="""
    SELECT kind, CAST(SUM(n) AS BIGINT) AS n FROM (
      SELECT CASE WHEN seq % 17 = 0 THEN 'quarantined' ELSE 'good' END AS kind, COUNT(*) AS n FROM {v_cfp} GROUP BY 1
      UNION ALL SELECT 'quarantined', 2) GROUP BY kind""")
def _(t):
    """The feed as one document with an envelope per row, and two lines that are no JSON: every row is on one side."""
    path = new_path(t.spark, "aggregator")
    envelope = t.sql(AGGREGATOR).select(F.to_json(F.struct(F.array(F.struct("*")).alias("cfps"))).alias("value"))
    envelope.union(t.spark.createDataFrame([("{broken",), ("no json",)], "value string")).write.text(path)
    feed = R.read_aggregator_feed(t.spark, path, multi_line=False)
    return feed.rows.select(F.lit("good").alias("kind")).union(feed.quarantine.select(F.lit("quarantined"))).groupBy("kind").agg(F.count("*").alias("n"))


# ---- topic files --------------------------------------------------------------------------------
TOPICS = """
    SELECT name || ' ' || CAST(seq AS STRING) AS name, 'https://t.example/' || CAST(seq AS STRING) AS url,
           '2024-03-' || LPAD(CAST(1 + seq % 28 AS STRING), 2, '0') AS startDate, CASE WHEN seq % 4 = 0 THEN 'soon' ELSE '2024-04-01' END AS endDate,
           CASE WHEN seq % 3 <> 0 THEN city END AS city, CASE WHEN seq % 5 <> 0 THEN country END AS country, seq % 2 = 0 AS online,
           CASE WHEN seq % 7 <> 0 THEN cfp_url END AS cfpUrl, '2024-02-' || LPAD(CAST(1 + seq % 28 AS STRING), 2, '0') AS cfpEndDate,
           CASE seq % 4 WHEN 0 THEN 'ios' WHEN 1 THEN 'rust' WHEN 2 THEN 'tech-comm' ELSE 'accessibility' END AS topic FROM {v_cfp}"""


@register("topic_files", "SRC-2", "PRJ-2", "FLT-3", "FN-DT-3", oracle="""
    SELECT substr(sha1('confstech:https://t.example/' || CAST(seq AS VARCHAR) || ':' || name || ' ' || CAST(seq AS VARCHAR)), 1, 16) AS object_id,
           CAST(epoch(make_timestamp(2024, 2, 1 + seq % 28, 23, 59, 59)) AS BIGINT) AS cfp_end_date,
           CASE WHEN seq % 4 <> 0 THEN CAST(epoch(make_timestamp(2024, 4, 1, 23, 59, 59)) AS BIGINT) END AS event_end_date,
           trim(CASE WHEN seq % 3 <> 0 THEN city ELSE '' END || ', ' || CASE WHEN seq % 5 <> 0 THEN country ELSE '' END, ', ') AS raw_location,
           CASE seq % 4 WHEN 0 THEN 'ios' WHEN 1 THEN 'rust' WHEN 2 THEN 'tech-comm' ELSE 'accessibility' END AS topic,
           CASE seq % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'backend' WHEN 2 THEN 'career' ELSE 'accessibility' END AS category,
           CASE WHEN seq % 2 = 0 AND seq % 3 <> 0 THEN 'hybrid' WHEN seq % 2 = 0 THEN 'virtual' ELSE 'in-person' END AS event_format
    FROM {v_cfp} WHERE seq % 7 <> 0""")
def _(t):
    root = new_path(t.spark, "topics")
    rows = t.sql(TOPICS)
    for topic in ("ios", "rust", "tech-comm", "accessibility"):
        rows.filter(F.col("topic") == topic).drop("topic").write.json(f"{root}/{topic}.json")
    calls = P.transform_topic_file(R.read_topic_files(t.spark, f"{root}/*.json", multi_line=False).rows)
    return FL.has_cfp_url(calls).select(
        "object_id", "cfp_end_date", "event_end_date", F.col("location.raw").alias("raw_location"), F.col("topics")[0].alias("topic"),
        F.col("topics_normalized")[0].alias("category"), "event_format",
    )


# ---- academic deadlines -------------------------------------------------------------------------
DEADLINES = """
    SELECT topic_a AS title, CAST(2022 + seq % 5 AS INT) AS year, name || CAST(seq AS STRING) AS id, cfp_url AS link,
           CASE seq % 4 WHEN 0 THEN 'TBA' WHEN 1 THEN '2024-05-10 23:59:59' WHEN 2 THEN '2024-05-10 23:59' ELSE '2024-05-10' END AS deadline,
           city || ', ' || region || ', ' || country AS place,
           CASE seq % 4 WHEN 0 THEN 'RO' WHEN 1 THEN '["ML","HCI","DM"]' WHEN 2 THEN 'XX' ELSE '["CV","NLP"]' END AS sub,
           description AS note, CASE WHEN seq % 3 = 0 THEN 'Full ' || name END AS full_name, '2024-07-01' AS start, CASE WHEN seq % 2 = 0 THEN 'July 5' ELSE '2024-07-05' END AS end
    FROM {v_cfp}"""


@register("academic_deadlines", "SRC-3", "PRJ-3", "FN-DT-4", "FN-LOC-4", oracle="""
    SELECT substr(sha1('aideadlines:' || name || CAST(seq AS VARCHAR) || ':' || CAST(2022 + seq % 5 AS VARCHAR)), 1, 16) AS object_id,
           CASE WHEN seq % 3 = 0 THEN 'Full ' || name || ' (' || topic_a || ' ' || CAST(2022 + seq % 5 AS VARCHAR) || ')' ELSE topic_a || ' ' || CAST(2022 + seq % 5 AS VARCHAR) END AS name,
           CASE seq % 4 WHEN 1 THEN 1715385599 WHEN 2 THEN 1715385540 WHEN 3 THEN 1715299200 END AS cfp_end_date,
           CASE WHEN seq % 4 <> 0 THEN '2024-05-10' END AS cfp_end_date_iso, CASE WHEN seq % 2 <> 0 THEN '2024-07-05' END AS event_end_date_iso,
           CASE seq % 4 WHEN 0 THEN 'robotics' WHEN 1 THEN 'ai-ml,data,design' ELSE 'ai-ml' END AS categories,
           CASE WHEN region IS NOT NULL THEN city END AS city, CASE WHEN region IS NOT NULL THEN country END AS country, 'advanced' AS audience_level
    FROM {v_cfp} WHERE 2022 + seq % 5 >= 2024""")
def _(t):
    rows = R.read_deadlines_feed(t.spark, landed(t, DEADLINES, "deadlines"), 2024, multi_line=False).rows
    return P.transform_deadlines(rows).select(
        "object_id", "name", F.col("cfp_end_date").cast("int").alias("cfp_end_date"), "cfp_end_date_iso", "event_end_date_iso",
        F.array_join("topics_normalized", ",").alias("categories"), F.col("location.city").alias("city"), F.col("location.country").alias("country"), "audience_level",
    )


# ---- developer events ---------------------------------------------------------------------------
DEVEVENTS = """
    SELECT cfp_url || CAST(seq AS STRING) AS link, cfp_end_date * 1000 + 7 AS untilDate,
           named_struct('name', name, 'date', CASE seq % 3 WHEN 0 THEN array(cfp_end_date * 1000 + 86400000) WHEN 1 THEN array(cfp_end_date * 1000, cfp_end_date * 1000 + 172800000)
               ELSE CAST(array() AS ARRAY<BIGINT>) END, 'hyperlink', 'https://d.example/' || CAST(seq AS STRING), 'location', city || ' (' || country || ')') AS conf
    FROM {v_cfp}"""


@register("developer_events", "SRC-4", "PRJ-4", "FN-DT-5", "FN-LOC-5", oracle="""
    SELECT substr(sha1('developerevents:' || cfp_url || CAST(seq AS VARCHAR) || ':' || name), 1, 16) AS object_id, cfp_end_date,
           strftime(to_timestamp(cfp_end_date) AT TIME ZONE 'UTC', '%Y-%m-%d') AS cfp_end_date_iso,
           CASE seq % 3 WHEN 0 THEN cfp_end_date + 86400 WHEN 1 THEN cfp_end_date END AS event_start_date,
           CASE seq % 3 WHEN 0 THEN cfp_end_date + 86400 WHEN 1 THEN cfp_end_date + 172800 END AS event_end_date, city, country FROM {v_cfp}""")
def _(t):
    rows = R.read_devevents_feed(t.spark, landed(t, DEVEVENTS, "devevents"), multi_line=False).rows
    return P.transform_devevents(rows).select(
        "object_id", "cfp_end_date", "cfp_end_date_iso", "event_start_date", "event_end_date", F.col("location.city").alias("city"), F.col("location.country").alias("country"),
    )


# ---- link providers -----------------------------------------------------------------------------
CFPLIST = "SELECT name AS conferenceName, CASE WHEN seq % 3 <> 0 THEN cfp_url END AS link, 'https://l/' || CAST(seq AS STRING) AS cfpLink FROM {v_cfp}"


@register("cfplist_links", "SRC-5", oracle="SELECT cfp_url AS url, name, 'https://l/' || CAST(seq AS VARCHAR) AS cfp_url FROM {v_cfp} WHERE seq % 3 <> 0")
def _(t):
    return R.read_cfplist_feed(t.spark, landed(t, CFPLIST, "cfplist"), multi_line=False).rows


URL_LINES = """SELECT CASE seq % 5 WHEN 0 THEN '# ' || cfp_url WHEN 1 THEN cfp_url || '?i=' || CAST(seq AS STRING) || ' # note' WHEN 2 THEN '' WHEN 3 THEN '  ' ELSE ' ' || cfp_url END AS value FROM {v_cfp}"""


@register("url_list", "SRC-6", oracle="""
    SELECT CASE seq % 5 WHEN 1 THEN cfp_url || '?i=' || CAST(seq AS VARCHAR) ELSE cfp_url END AS url FROM {v_cfp} WHERE seq % 5 IN (1, 4)""")
def _(t):
    path = new_path(t.spark, "urls")
    t.sql(URL_LINES).write.text(path)
    return R.read_url_list(t.spark, path)


@register("events_csv", "SRC-7", oracle="""
    SELECT CAST(user_token AS VARCHAR) AS user_token, object_id, event_type, COUNT(*) AS n FROM {v_event} GROUP BY 1, 2, 3""")
def _(t):
    path = new_path(t.spark, "events")
    events = t.view("v_event").select(
        F.col("user_token").alias("userToken"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.col("object_id").alias("objectID"), F.col("event_type").alias("eventType"), F.lit('a "quoted, name"').alias("eventName"))
    S.write_events_csv(events, path)
    back = R.read_events_csv(t.spark, path)
    return back.groupBy(F.col("userToken").alias("user_token"), F.col("objectID").alias("object_id"), F.col("eventType").alias("event_type")).agg(F.count("*").alias("n"))


@register("alias_file", "SRC-8", oracle="""
    WITH s AS (SELECT c_name, 'customer-' || LPAD(CAST(c_custkey AS VARCHAR), 9, '0') AS slug, c_custkey AS k FROM {customer} WHERE c_custkey % 3 = 0)
    SELECT 'alias-' || CAST(k AS VARCHAR) AS alias_slug, slug AS canonical_slug, c_name AS display_name FROM s
    UNION ALL SELECT 'general-' || CAST(k AS VARCHAR), CASE WHEN k % 2 = 0 THEN slug ELSE 'nobody' END, CASE WHEN k % 2 = 0 THEN c_name END FROM s""")
def _(t):
    path = new_path(t.spark, "aliases")
    # one seed file per customer: an alias, the own slug (ignored), and file-level aliases that lose against it
    t.sql("""SELECT array(named_struct('name', c_name, 'aliases', array('alias-' || CAST(k AS STRING), slug))) AS speakers,
                    map('alias-' || CAST(k AS STRING), 'wrong', 'general-' || CAST(k AS STRING), CASE WHEN k % 2 = 0 THEN slug ELSE 'nobody' END) AS name_aliases
             FROM (SELECT c_name, 'customer-' || LPAD(CAST(c_custkey AS STRING), 9, '0') AS slug, c_custkey AS k FROM {customer} WHERE c_custkey % 3 = 0)""").write.json(path)
    return R.read_alias_file(t.spark, path, multi_line=False)


STORE = """SELECT cfp_url || CAST(seq % 300 AS STRING) AS url, MIN(source) AS source, CASE WHEN MIN(seq) % 2 = 0 THEN MIN(name) END AS name, CAST(NULL AS STRING) AS cfp_url,
    CAST(MIN(seq) AS DOUBLE) AS added_at FROM {v_cfp} WHERE seq % 4 = 0 GROUP BY 1"""
BATCH = """SELECT cfp_url || CAST(seq % 300 AS STRING) || CASE WHEN seq % 3 = 0 THEN '/' ELSE '' END AS url, 'batch' AS source, CASE WHEN seq % 5 <> 0 THEN name ELSE '' END AS name,
    CASE WHEN seq % 7 = 0 THEN 'call' || CAST(seq AS STRING) END AS cfp_url, seq, 5e9 AS added_at FROM {v_cfp} WHERE seq % 4 <> 0"""


@register("url_store_add", "DUP-4", oracle=f"""
    SELECT COALESCE(s.url, b.url) AS url, COALESCE(s.source, b.source) AS source, COALESCE(s.name, b.name) AS name, b.cfp_url, COALESCE(s.added_at, 5e9) AS added_at, s.url IS NULL AS is_new
    FROM ({STORE}) s FULL JOIN (SELECT rtrim(url, '/') AS url, 'batch' AS source, arg_min(NULLIF(name, ''), seq) FILTER (name <> '') AS name, arg_min(cfp_url, seq) FILTER (cfp_url <> '') AS cfp_url
      FROM ({BATCH}) GROUP BY 1) b ON rtrim(s.url, '/') = b.url""")
def _(t):
    from rostrum.operators.dedup import url_store_add

    store = t.sql(STORE).withColumn("url", F.regexp_replace("url", "/+$", ""))
    return url_store_add(store, t.sql(BATCH))


@register("collected_urls", "SET-4", "DUP-4", oracle="""
    SELECT source, COUNT(*) AS new_urls FROM (SELECT url, arg_min(source, r) AS source FROM (
      SELECT rtrim(COALESCE(url, cfp_url), '/') AS url, source, CASE source WHEN 'developers.events' THEN 0 WHEN 'callingallpapers' THEN 1 ELSE 2 END * 1000000000000 + seq AS r FROM (
        SELECT source, seq, cfp_url || CAST(seq % 600 AS VARCHAR) AS cfp_url, CASE WHEN seq % 2 = 0 THEN cfp_url || CAST(seq % 600 AS VARCHAR) || '/' END AS url FROM {v_cfp}))
      GROUP BY url) WHERE url NOT IN (SELECT cfp_url || CAST(seq % 600 AS VARCHAR) FROM {v_cfp} WHERE seq % 10 = 0) GROUP BY source""")
def _(t):
    store = t.sql("SELECT DISTINCT cfp_url || CAST(seq % 600 AS STRING) AS url, 'old' AS source, '' AS name, '' AS cfp_url, 0e0 AS added_at FROM {v_cfp} WHERE seq % 10 = 0")
    rows = t.sql("SELECT source, seq, name, cfp_url || CAST(seq % 600 AS STRING) AS cfp_url, CASE WHEN seq % 2 = 0 THEN cfp_url || CAST(seq % 600 AS STRING) || '/' END AS url FROM {v_cfp}")
    feeds = [rows.filter(F.col("source") == s) for s in ("developers.events", "callingallpapers", "confs.tech")]
    return jobs.collect_urls(store, feeds, AS_OF)[1]


@register("synced_calls", "SET-1", "DUP-1", "FN-LOC-2", "FLT-1", "PRJ-7")
def _(t):
    """Three feeds to open, unified calls: the whole feed job."""
    rows = t.view("v_cfp").withColumns({
        "location": F.struct(F.lit("").alias("city"), F.lit("").alias("state"), F.lit("").alias("country"), F.lit("").alias("region"),
                             F.lit("").alias("continent"), F.concat_ws(", ", "city", "country").alias("raw")),
        "topics": F.array("topic_a", "topic_b"), "cfp_url": F.concat("cfp_url", F.col("seq").cast("string")), "icon_url": F.lit(""), "url": F.lit(""),
        "name": F.concat("name", F.lit(" "), F.col("topic_b")),
    }).select("object_id", "seq", "name", "source", "url", "cfp_url", "icon_url", "cfp_end_date", "location", "topics")
    feeds = [rows.filter(F.col("source") == s) for s in jobs.FEED_ORDER]
    out = jobs.sync_calls(feeds, AS_OF, t.sql("SELECT DISTINCT LOWER(p_brand) AS tag, LOWER(p_type) AS category FROM {part} WHERE p_size > 45"))
    return out.select("object_id", "name", "source", "icon_url", F.col("location.city").alias("city"), F.array_join("topics_normalized", ",").alias("categories"))


# ---- talks --------------------------------------------------------------------------------------
@register("search_hits_to_talks", "PRJ-5", oracle="""
    SELECT id, 'yt_' || CASE WHEN id % 5 = 0 THEN substr(sha256('https://v.example/' || CAST(id AS VARCHAR)), 1, 12) ELSE substr(md5(CAST(id % 1500 AS VARCHAR)), 1, 11) END AS object_id,
           'rust-days-2024' AS conference_slug, CASE WHEN id % 3 <> 0 THEN person ELSE '' END AS speakers FROM {v_title}""")
def _(t):
    hits = t.view("v_title").withColumns({
        "url": F.when(F.col("id") % 5 == 0, F.concat(F.lit("https://v.example/"), F.col("id").cast("string"))).otherwise(F.col("url")),
        "speaker": F.when(F.col("id") % 3 != 0, F.col("person")),
    })
    talks = P.to_talk(hits.withColumn("year", F.col("id")), "c1", "Rust Days 2024")
    return talks.select(F.col("year").alias("id"), "object_id", "conference_slug", F.array_join("speakers", ",").alias("speakers"))


@register("channel_entries", "PRJ-10", "FN-STR-7", oracle="""
    SELECT 'yt_v' || CAST(id AS VARCHAR) AS object_id, CASE WHEN duration_seconds <> 0 THEN CAST(round_even(duration_seconds * 1.5 / 60, 0) AS BIGINT) END AS duration_minutes,
           CASE WHEN id % 3 = 0 THEN 2001 END AS year, length(COALESCE(description, '')) AS description_length FROM {v_title}""")
def _(t):
    entries = t.view("v_title").withColumns({
        "video_id": F.concat(F.lit("v"), F.col("id").cast("string")), "duration_seconds": F.col("duration_seconds") * 1.5,
        "uploaded_at": F.when(F.col("id") % 3 == 0, F.lit(1000000000)).otherwise(F.lit(0)),
    })
    talks = P.channel_entry_to_talk(entries, "c", "Conf")
    return talks.select("object_id", "duration_minutes", "year", F.length("description").cast("bigint").alias("description_length"))


@register("playlist_talks", "PRJ-9", "JN-2", oracle="""
    SELECT 'yt_v' || CAST(id AS VARCHAR) AS object_id, CASE WHEN id % 3 = 0 THEN person END AS speaker,
           CASE WHEN id % 2 = 0 THEN 'Dev Days 2020' ELSE 'Dev Days' END AS conference_name, CASE WHEN id % 2 = 0 THEN 'dev-days-2020' ELSE 'dev-days' END AS conference_id
    FROM {v_person} WHERE id % 4 <> 1 AND id % 5 <> 0 AND id % 7 <> 0""")
def _(t):
    videos = t.sql("""SELECT 'v' || CAST(id AS STRING) AS video_id, CASE WHEN id % 4 = 1 THEN 'Other' ELSE 'HOUSE' END AS channel,
        CASE WHEN id % 5 = 0 THEN 'search' ELSE 'playlist:x' END AS source, CASE WHEN id % 2 = 0 THEN 2020 END AS year,
        CASE WHEN id % 3 = 0 THEN 'A talk - ' || person || ', Corp' ELSE 'Talk of ' || raw_name END AS title FROM {v_person}""")
    talks = P.playlist_talks(videos, "house", "Dev Days")
    existing = t.sql("SELECT 'yt_v' || CAST(id AS STRING) AS object_id FROM {v_person} WHERE id % 7 = 0")
    return J.skip_existing(talks, existing, "object_id").select("object_id", "speaker", "conference_name", "conference_id")


@register("new_videos", "JN-2", "FLT-7", oracle="""
    SELECT 'v' || CAST(id AS VARCHAR) AS video_id FROM {v_title} WHERE duration_seconds >= 600 AND id % 3 <> 0""")
def _(t):
    videos = t.view("v_title").withColumn("video_id", F.concat(F.lit("v"), F.col("id").cast("string")))
    indexed = t.sql("SELECT CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN 'yt_v' ELSE 'v' END || CAST(CASE WHEN id % 3 = 0 THEN id ELSE -1 END AS STRING) AS object_id FROM {v_title}")
    return J.skip_existing_videos(FL.min_duration(videos, 10), indexed).select("video_id")


@register("conference_talk_filter", "FLT-4", oracle="""
    SELECT id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY url ORDER BY id) AS r, lower(title) AS t, lower(channel) AS c, lower(COALESCE(description, '')) AS d FROM {v_title})
    WHERE r = 1 AND (duration_seconds = 0 OR duration_seconds >= 600) AND view_count <= 500000 AND NOT contains(c, 'gaming') AND NOT contains(t, 'recap') AND NOT contains(t, 'promo')
      AND (contains(t, 'keynote') OR contains(t, 'kubecon') OR contains(t, 'python') OR contains(t, 'meetup') OR contains(d, 'session') OR contains(d, 'cloud') OR contains(c, 'pycon'))""")
def _(t):
    return FL.filter_talks_by_conference(t.view("v_title"), ["id"]).select("id")


@register("speaker_talk_filter", "FLT-5", oracle="""
    SELECT id, CASE WHEN id % 2 = 0 THEN person ELSE 'Ada Lovelace' END AS speaker FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY id % 1500 ORDER BY id) AS r FROM {v_title})
    WHERE r = 1 AND (duration_seconds = 0 OR duration_seconds >= 300) AND NOT contains(lower(title), 'recap') AND NOT contains(lower(title), 'promo')""")
def _(t):
    rows = t.view("v_title").withColumns({
        "object_id": (F.col("id") % 1500).cast("string"), "speaker": F.when(F.col("id") % 2 == 0, F.col("person")).otherwise(F.lit("")),
    })
    return FL.filter_talks_by_speaker(rows, "Ada Lovelace", ["id"]).select("id", "speaker")


@register("example_talks", "FLT-6", oracle="""
    SELECT conference_id, object_id, rank FROM (SELECT conference_id, object_id, ROW_NUMBER() OVER (PARTITION BY conference_id ORDER BY view_count DESC, object_id) AS rank
      FROM {v_talk} WHERE duration_seconds = 0 OR duration_seconds >= 300) WHERE rank <= 5""")
def _(t):
    rows = t.view("v_talk").withColumn("title", F.concat(F.lit("Talk "), "speaker"))
    return FL.filter_example_talks(rows, 5).select("conference_id", "object_id", F.col("rank").cast("bigint").alias("rank"))


@register("conference_talks", "JN-6", oracle="""
    SELECT object_id, view_count FROM {v_talk} WHERE conference_id = 7 ORDER BY view_count / CAST(GREATEST(1, 2024 - year) AS DOUBLE) DESC, view_count DESC, year DESC, object_id LIMIT 20""")
def _(t):
    return J.talks_for_conference(P.derive_talk_fields(t.view("v_talk"), 2024), 7).select("object_id", "view_count")


@register("video_details", "JN-14", oracle="""
    SELECT object_id, CASE WHEN talk_id % 2 = 0 AND talk_id % 3 <> 0 THEN 'CHX' ELSE channel END AS channel,
           CASE WHEN talk_id % 2 = 0 AND talk_id % 5 <> 0 THEN 77 ELSE view_count END AS view_count, CASE WHEN talk_id % 2 = 0 THEN 2011 ELSE year END AS year FROM {v_talk}""")
def _(t):
    talks = t.view("v_talk").withColumn("description", F.lit("d"))
    details = t.sql("""SELECT object_id, '' AS description, 0 AS duration_seconds, CASE WHEN talk_id % 5 = 0 THEN 0 ELSE 77 END AS view_count,
        CASE WHEN talk_id % 3 = 0 THEN '' ELSE 'CHX' END AS channel, '20110203' AS upload_date FROM {v_talk} WHERE talk_id % 2 = 0""")
    return J.merge_video_details(talks, details).select("object_id", "channel", "view_count", "year")


@register("talks_with_transcripts", "PRJ-11", oracle="""
    SELECT object_id, CASE WHEN talk_id % 3 = 0 THEN length(conference_name) END AS text_length, CASE WHEN talk_id % 3 = 0 THEN 'about ' || speaker END AS transcript_summary,
           talk_id % 3 = 0 OR talk_id % 7 = 0 AS transcript_enriched FROM {v_talk}""")
def _(t):
    talks = t.view("v_talk").withColumn("transcript_enriched", F.col("talk_id") % 7 == 0)
    outcomes = t.sql("""SELECT object_id, CASE WHEN talk_id % 2 = 0 OR talk_id % 3 = 0 THEN conference_name END AS text,
        CASE WHEN talk_id % 3 = 0 THEN 'about ' || speaker ELSE '' END AS summary, array(channel) AS keywords, array(channel) AS topics, array(channel) AS takeaways FROM {v_talk}""")
    return P.apply_transcripts(talks, outcomes).select(
        "object_id", F.length("transcript_text").cast("bigint").alias("text_length"), "transcript_summary", "transcript_enriched")


# ---- profiles -----------------------------------------------------------------------------------
@register("github_profiles", "JN-11", oracle="""
    SELECT id AS object_id, CASE WHEN id % 2 <> 0 THEN 'av' END AS image_url, CASE WHEN id % 3 = 0 THEN 'u' || raw_name END AS github, CASE WHEN id % 5 = 0 THEN kind END AS location,
           CASE WHEN id % 4 = 0 THEN brand END AS company, CAST(NULL AS VARCHAR) AS twitter, CASE WHEN id % 7 = 0 THEN 'https://b' END AS website
    FROM {v_person} WHERE id % 2 <> 0 OR id % 3 = 0 OR id % 5 = 0 OR id % 4 = 0 OR id % 7 = 0""")
def _(t):
    rows = t.sql("""SELECT id AS object_id, CASE WHEN id % 2 = 0 THEN 'x' END AS image_url, CASE WHEN id % 5 <> 0 THEN 'l' ELSE '' END AS location, '' AS company, 'tw' AS twitter FROM {v_person}""")
    profiles = t.sql("""SELECT id AS object_id, 'av' AS avatar_url, CASE WHEN id % 3 = 0 THEN 'u' || raw_name END AS username, kind AS location,
        CASE WHEN id % 4 = 0 THEN '@' || brand ELSE '@' END AS company, 'new' AS twitter_username, CASE WHEN id % 7 = 0 THEN ' https://b ' ELSE 'https://github.com/u' END AS blog FROM {v_person}""")
    return J.fill_github_profile(rows, profiles)


@register("directory_profiles", "JN-11", oracle="""
    SELECT id AS object_id, CASE WHEN id % 2 = 0 THEN 'https://p' END AS image_url, raw_name AS slug, CASE WHEN id % 3 = 0 THEN kind END AS tagline FROM {v_person}""")
def _(t):
    profiles = t.sql("""SELECT id AS object_id, CASE WHEN id % 2 = 0 THEN 'https://p' ELSE '/Assets/p' END AS photo_url, raw_name AS slug, CASE WHEN id % 3 = 0 THEN kind ELSE '' END AS tagline,
        '' AS location, '' AS twitter, '' AS linkedin, '' AS github, '' AS profile_url FROM {v_person}""")
    return J.fill_directory_profile(t.sql("SELECT id AS object_id FROM {v_person}"), profiles).select("object_id", "image_url", "slug", "tagline")


# ---- names --------------------------------------------------------------------------------------
NAMES = """SELECT id, CASE id % 16 WHEN 0 THEN person WHEN 1 THEN 'Main Stage' WHEN 2 THEN 'how to ' || raw_name WHEN 3 THEN 'Al' WHEN 4 THEN 'React Summit ' || brand
    WHEN 5 THEN 'Opening Keynote' WHEN 6 THEN 'Beyond ' || brand WHEN 7 THEN 'beyond pandas' WHEN 8 THEN 'Rust ' || person WHEN 9 THEN person || ' community'
    WHEN 10 THEN 'Which ' || kind WHEN 11 THEN ' Panel ' WHEN 12 THEN 'Google ' || kind WHEN 13 THEN kind || 'Conf' WHEN 14 THEN 'Many ' || kind ELSE 'Ana ' || person END AS name FROM {v_person}"""


@register("name_checks", "FLT-8", "FLT-9", "FLT-10", "FLT-14", oracle=f"""
    SELECT id, id % 16 IN (0, 7, 9, 11, 12, 13, 14, 15, 6) OR (id % 16 = 5) AS is_valid, id % 16 IN (1, 5, 7, 11) AS is_blocked,
           id % 16 IN (5, 7, 9, 14) AS is_garbage, id % 16 IN (13) OR (id % 16 = 4) AS is_conference, id % 16 = 12 AS is_company FROM ({NAMES})""")
def _(t):
    name = F.col("name")
    return t.sql(NAMES).select(
        "id", FL.is_valid_speaker(name).alias("is_valid"), FL.is_blocked_speaker(name).alias("is_blocked"), FL.is_garbage_speaker(name).alias("is_garbage"),
        FL.is_conference_channel(name).alias("is_conference"), FL.is_company_channel(name).alias("is_company"),
    )


VARIANT = """CASE LENGTH(person) % 4 WHEN 0 THEN REPLACE(person, 'e', 'é') WHEN 1 THEN UPPER(person) WHEN 2 THEN 'Dr ' || person ELSE person || ' Jr' END"""


@register("contained_people", "JN-10", "FN-STR-8", oracle=f"""
    SELECT DISTINCT person AS name, {VARIANT} AS match, CASE WHEN LENGTH(person) % 4 < 2 THEN 1.0 ELSE 0.95 END::DOUBLE AS score FROM {{v_person}}""")
def _(t):
    """Names against the same ones with diacritics, in capitals, with a title, and with a suffix."""
    right = t.sql(f"SELECT DISTINCT {VARIANT} AS name FROM {{v_person}}")
    return J.fuzzy_match_people(t.sql("SELECT person AS name FROM {v_person}"), right, 0.945).select("name", "match", "score")


@register("matched_people", "JN-10", "FN-STR-8")
def _(t):
    """Part-name people against the same names with typos."""
    right = t.sql("SELECT DISTINCT CASE WHEN id % 3 = 0 THEN REPLACE(person, 'e', 'é') WHEN id % 3 = 1 THEN person || 'x' ELSE 'Dr ' || person END AS name FROM {v_person}")
    return J.fuzzy_match_people(t.sql("SELECT person AS name FROM {v_person}"), right, 0.65).select("name", "match", F.round("score", 6).alias("score"))


