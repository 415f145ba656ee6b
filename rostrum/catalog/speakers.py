"""Speaker and channel queries over the talk proxy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.catalog.registry import Tables, register
from rostrum.operators import aggregates as A
from rostrum.operators import joins as J
from rostrum.operators import windows as W

YEAR = 2000


def talks(t: Tables) -> DataFrame:
    """Talks with the list of speakers and the topics of each talk."""
    # v_topic's rows dealt by talk: its distinct topics and the join then need no further shuffle; a talk has few lines
    lines = t.sql("SELECT l.l_orderkey AS talk_id, p.p_brand AS topic FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey")
    topics = lines.repartition("talk_id").groupBy("talk_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    rows = t.view("v_talk").join(topics, "talk_id", "left")
    speakers = F.array_compact(F.array("speaker", "co_speaker"))
    return rows.withColumns({
        "speakers": speakers, "topics": F.coalesce("topics", F.array().cast("array<string>")),
    }).drop("co_speaker")


def profiles(t: Tables, own: DataFrame | None = None) -> DataFrame:
    """Profiles of the speakers of ``own``, by default of the talks put together anew."""
    return A.build_speakers(talks(t) if own is None else own, YEAR)


# oracle building blocks
SLUG = "TRIM(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')"
TOTALS = f"""
    SELECT {SLUG} AS slug, MAX(name) AS name, COUNT(*) AS talk_count, CAST(SUM(view_count) AS BIGINT) AS total_views,
           MAX(view_count) AS max_views, MIN(year) AS first_talk_year, MAX(year) AS latest_talk_year,
           COUNT(DISTINCT year) AS active_years, COUNT(DISTINCT conference_name) AS conference_count
    FROM {{v_appearance}} GROUP BY 1"""
SCORES = f"""
    SELECT *, total_views / CAST(talk_count AS DOUBLE) AS avg_views,
           total_views / CAST(active_years AS DOUBLE) AS influence_score,
           talk_count / CAST(active_years AS DOUBLE) AS consistency_score FROM ({TOTALS})"""
TOPICS = f"""
    SELECT slug, topic, n, ROW_NUMBER() OVER (PARTITION BY slug ORDER BY n DESC, topic) AS rank FROM (
      SELECT {SLUG} AS slug, topic, COUNT(*) AS n FROM {{v_appearance}} a JOIN {{v_topic}} p ON p.talk_id = a.talk_id
      GROUP BY 1, 2)"""
INFLUENCE = "influence_score DESC, total_views DESC, talk_count DESC, active_years DESC, slug"
ROUNDED = "ROUND(avg_views, 6) AS avg_views, ROUND(influence_score, 6) AS influence_score, ROUND(consistency_score, 6) AS consistency_score"
BASE = ["slug", "name", "talk_count", "total_views", "max_views", "active_years", "first_talk_year", "latest_talk_year"]


def scored(df: DataFrame, *more: str) -> DataFrame:
    rounded = [F.round(c, 6).alias(c) for c in ("avg_views", "influence_score", "consistency_score")]
    return df.select(*BASE, *rounded, *more)


@register("speaker_leaderboard", "AGG-1", "AGG-2", "WIN-2", "WIN-6", oracle=f"""
    SELECT {', '.join(BASE)}, {ROUNDED}, ROW_NUMBER() OVER (ORDER BY {INFLUENCE}) AS rank
    FROM ({SCORES}) ORDER BY {INFLUENCE} LIMIT 50""")
def _(t):
    rows = A.speaker_scores(A.speaker_totals(A.speaker_appearances(talks(t))))
    return scored(W.leaderboard(rows), F.col("rank").cast("bigint"))


BADGES = f"""
    SELECT s.slug, s.name, s.talk_count, s.total_views, s.conference_count, COALESCE(k.topic_count, 0) AS topic_count,
           CONCAT_WS('; ',
             CASE WHEN total_views >= 1000000 THEN 'Million Club' WHEN total_views >= 100000 THEN '100K Club'
                  WHEN total_views >= 10000 THEN '10K Club' END,
             CASE WHEN max_views >= 100000 THEN 'Viral Sensation' WHEN max_views >= 50000 THEN 'Viral Hit' END,
             CASE WHEN talk_count >= 50 THEN 'Legend' WHEN talk_count >= 20 THEN 'Prolific'
                  WHEN talk_count >= 10 THEN 'Frequent Flyer' END,
             CASE WHEN active_years >= 10 THEN 'Decade Veteran' WHEN active_years >= 5 THEN 'Veteran'
                  WHEN active_years >= 3 THEN 'Established' END,
             CASE WHEN first_talk_year >= {YEAR} - 2 AND talk_count >= 3 THEN 'Rising Star' END,
             CASE WHEN conference_count >= 10 THEN 'Globe Trotter' WHEN conference_count >= 5 THEN 'Multi-Conference' END,
             CASE WHEN topic_count >= 5 THEN 'Polymath' WHEN topic_count >= 3 THEN 'Multi-Domain' END,
             CASE WHEN top_n >= 5 THEN 'Expert: ' || top_topic END,
             CASE WHEN consistency_score >= 3 THEN 'Consistent' END) AS badges
    FROM ({SCORES}) s LEFT JOIN (
      SELECT slug, COUNT(*) AS topic_count, MAX(n) AS top_n, MAX(CASE WHEN rank = 1 THEN topic END) AS top_topic
      FROM ({TOPICS}) WHERE rank <= 10 GROUP BY slug) k ON k.slug = s.slug"""


@register("speaker_profiles", "AGG-1", "AGG-2", "AGG-4", oracle=BADGES)
def _(t):
    return profiles(t).select(
        "slug", "name", "talk_count", "total_views", "conference_count", F.size("topics").cast("bigint").alias("topic_count"),
        F.array_join("achievements", "; ").alias("badges"),
    )


@register("achievement_counts", "AGG-22", oracle=f"""
    SELECT badge, COUNT(*) AS n FROM (SELECT UNNEST(string_split(badges, '; ')) AS badge FROM ({BADGES}))
    WHERE badge <> '' GROUP BY badge ORDER BY n DESC, badge LIMIT 5""")
def _(t):
    return A.achievement_counts(profiles(t))


@register("speaker_top_topics", "AGG-3", oracle=f"SELECT slug, topic, n, rank FROM ({TOPICS}) WHERE rank <= 10")
def _(t):
    rows = A.speaker_appearances(talks(t)).withColumn("topic", F.explode("topics"))
    return A.counter_topk(rows, ["slug"], "topic", 10).withColumn("rank", F.col("rank").cast("bigint"))


@register("speaker_conferences", "AGG-1", "AGG-3", oracle=f"""
    SELECT {SLUG} AS slug, conference_name, COUNT(*) AS n FROM {{v_appearance}} GROUP BY 1, 2""")
def _(t):
    return A.speaker_conferences(A.speaker_appearances(talks(t)))


@register("speaker_talk_list", "AGG-1", "WIN-1", oracle=f"""
    SELECT {SLUG} AS slug, object_id, view_count FROM {{v_appearance}}""")
def _(t):
    return A.speaker_talks(A.speaker_appearances(talks(t)))


@register("top_talks_per_speaker", "WIN-1", oracle=f"""
    SELECT slug, string_agg(object_id, ',' ORDER BY rank) AS top_talk_ids FROM (
      SELECT {SLUG} AS slug, object_id,
             ROW_NUMBER() OVER (PARTITION BY {SLUG} ORDER BY view_count DESC, object_id) AS rank FROM {{v_appearance}})
    WHERE rank <= 5 GROUP BY slug""")
def _(t):
    top = W.top_talks_per_speaker(A.speaker_appearances(talks(t)))
    return top.select("slug", F.array_join("top_talk_ids", ",").alias("top_talk_ids"))


@register("talk_index_ranking", "WIN-2", "PRJ-8", oracle=f"""
    SELECT object_id, view_count, year, CASE WHEN duration_seconds <> 0 THEN CAST(FLOOR(duration_seconds / 60) AS BIGINT) END AS duration_minutes,
           CASE WHEN view_count <> 0 AND year <> 0
                THEN ROUND(view_count / CAST(GREATEST(1, 2024 - year) AS DOUBLE), 6) END AS popularity_score
    FROM {{v_talk}}""")
def _(t):
    from rostrum.operators.projections import derive_talk_fields

    ranked = W.index_ranking(derive_talk_fields(t.view("v_talk"), 2024), "talks")
    return ranked.select(
        "object_id", "view_count", "year", "duration_minutes", F.round("popularity_score", 6).alias("popularity_score")
    )


for _sort, _column in W.LEADERBOARD_SORTS.items():
    if _sort == "influence":
        continue

    @register(f"leaderboard_by_{_sort}", "WIN-6", oracle=f"""
        SELECT slug, talk_count, total_views, active_years,
               ROW_NUMBER() OVER (ORDER BY {_column} DESC, {INFLUENCE}) AS rank
        FROM (SELECT * FROM ({SCORES}) ORDER BY {INFLUENCE} LIMIT 50)""")
    def _(t, sort=_sort):
        rows = A.speaker_scores(A.speaker_totals(A.speaker_appearances(talks(t))))
        board = W.leaderboard(rows, sort)
        return board.select("slug", "talk_count", "total_views", "active_years", F.col("rank").cast("bigint").alias("rank"))


@register("podium_and_grid", "WIN-8", oracle=f"""
    SELECT slug, rank, CASE WHEN rank <= 3 THEN 'podium' ELSE 'grid' END AS place FROM (
      SELECT slug, ROW_NUMBER() OVER (ORDER BY {INFLUENCE}) AS rank FROM ({SCORES})) WHERE rank <= 20""")
def _(t):
    rows = A.speaker_scores(A.speaker_totals(A.speaker_appearances(talks(t))))
    return W.podium_grid(W.leaderboard(rows)).select("slug", F.col("rank").cast("bigint").alias("rank"), "place")


@register("rising_stars", "WIN-7", oracle=f"""
    SELECT slug, active_years, ROUND(influence_score, 6) AS influence_score FROM (
      SELECT * FROM ({SCORES}) ORDER BY {INFLUENCE} LIMIT 100)
    WHERE active_years BETWEEN 1 AND 3 AND influence_score > 10
    ORDER BY influence_score DESC, slug LIMIT 15""")
def _(t):
    rows = A.speaker_scores(A.speaker_totals(A.speaker_appearances(talks(t))))
    return W.rising_stars(rows).select("slug", "active_years", F.round("influence_score", 6).alias("influence_score"))


@register("top_speakers_by_topic", "WIN-9", oracle=f"""
    SELECT slug, total_views, talk_count FROM ({SCORES}) WHERE slug IN (
      SELECT slug FROM ({TOPICS}) WHERE rank <= 10 AND topic = 'Brand#7')
    ORDER BY {INFLUENCE} LIMIT 25""")
def _(t):
    return W.top_speakers(profiles(t), "Brand#7", 25).select("slug", "total_views", "talk_count")


@register("speaker_display_names", "WIN-19", oracle="""
    SELECT slug, arg_max(alias, (length(alias), alias)) AS name, COUNT(*) AS spellings FROM (
      SELECT DISTINCT TRIM(regexp_replace(lower(alias), '[^a-z0-9]+', '-', 'g'), '-') AS slug, alias FROM (
        SELECT name AS alias FROM {v_appearance}
        UNION ALL SELECT UPPER(name) || '.' FROM {v_appearance}))
    GROUP BY slug""")
def _(t):
    rows = t.sql("SELECT name FROM {v_appearance} UNION ALL SELECT UPPER(name) || '.' FROM {v_appearance}")
    return W.longest_name(A.speaker_names(J.resolve_alias(rows, None)))


# every third customer publishes under the name of the customer before
ALIAS = """
    SELECT 'customer-' || LPAD(CAST(c_custkey AS STRING), 9, '0') AS alias_slug,
           'customer-' || LPAD(CAST(c_custkey - 1 AS STRING), 9, '0') AS canonical_slug,
           CASE WHEN c_custkey % 2 = 0 THEN 'Customer#' || LPAD(CAST(c_custkey - 1 AS STRING), 9, '0') END AS display_name
    FROM {customer} WHERE c_custkey % 3 = 1"""


@register("resolved_aliases", "JN-4", oracle=f"""
    SELECT a.object_id, COALESCE(m.canonical_slug, {SLUG}) AS slug, COALESCE(m.display_name, a.name) AS display_name
    FROM {{v_appearance}} a LEFT JOIN ({ALIAS}) m ON m.alias_slug = {SLUG}""")
def _(t):
    return J.resolve_alias(t.view("v_appearance"), t.sql(ALIAS)).select("object_id", "slug", "display_name")


@register("speakers_with_aliases", "AGG-1", "JN-4", oracle=f"""
    SELECT slug, COUNT(*) AS talk_count, CAST(SUM(view_count) AS BIGINT) AS total_views FROM (
      SELECT COALESCE(m.canonical_slug, {SLUG}) AS slug, a.view_count
      FROM {{v_appearance}} a LEFT JOIN ({ALIAS}) m ON m.alias_slug = {SLUG}) GROUP BY slug""")
def _(t):
    rows = A.speaker_appearances(talks(t), t.sql(ALIAS))
    return A.speaker_totals(rows).select("slug", "talk_count", "total_views")


@register("known_speaker_flags", "JN-12", oracle="""
    SELECT object_id, lower(speaker) IN (
      SELECT lower(c_name) FROM {customer} WHERE c_mktsegment = 'MACHINERY'
      UNION ALL SELECT 'customer#' || LPAD(CAST(c_custkey + 2 AS STRING), 9, '0') FROM {customer}
      WHERE c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0) AS is_known
    FROM {v_talk}""")
def _(t):
    seeds = t.sql("""
        SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0
               THEN array('Customer#' || LPAD(CAST(c_custkey + 2 AS STRING), 9, '0')) END AS aliases
        FROM {customer} WHERE c_mktsegment = 'MACHINERY'""")
    return J.flag_known_speakers(t.view("v_talk"), seeds).select("object_id", "is_known")


@register("transcript_priority", "WIN-12", "FN-STR-13", oracle="""
    SELECT object_id, substr(object_id, 4) AS video_id,
           CAST(CASE WHEN is_known THEN 100000 ELSE 0 END + LEAST(view_count, 100000) + (year - 2015) * 100 AS BIGINT) AS priority
    FROM (SELECT *, talk_id % 6 = 0 AS is_known, talk_id % 4 = 0 AS done FROM {v_talk}) WHERE NOT done""")
def _(t):
    from rostrum.functions.text import video_id

    rows = t.view("v_talk").withColumns({
        "is_known": F.col("talk_id") % 6 == 0, "transcript_enriched": F.col("talk_id") % 4 == 0,
    })
    return W.transcript_priority(rows).select("object_id", video_id(F.col("object_id")).alias("video_id"), "priority")


@register("channels_for_speaker", "AGG-17", oracle="""
    SELECT channel, COUNT(*) AS talk_count, CAST(SUM(view_count) AS BIGINT) AS total_views,
           array_to_string(list_sort(list_distinct(list(year))), ',') AS years,
           CAST(SUM(view_count) AS BIGINT) // COUNT(*) AS avg_views
    FROM {v_talk} WHERE speaker = 'Customer#000000007' GROUP BY channel""")
def _(t):
    mine = t.view("v_talk").filter("speaker = 'Customer#000000007'")
    return A.channels_for_speaker(mine).withColumn("years", F.array_join("years", ","))


@register("channel_profiles", "AGG-18", "FLT-14", oracle="""
    SELECT channel, COUNT(*) AS talk_count, CAST(SUM(view_count) AS BIGINT) AS total_views,
           array_to_string(list_sort(list_distinct(list(year))), ',') AS years, COUNT(DISTINCT speaker) AS speaker_count,
           channel LIKE 'PyConf%' AS is_conference, FALSE AS is_company
    FROM (SELECT CASE WHEN conference_id % 2 = 0 THEN 'PyConf ' || channel ELSE channel END AS channel,
                 view_count, year, speaker FROM {v_talk}) GROUP BY channel""")
def _(t):
    rows = t.view("v_talk").withColumn("channel", F.expr("CASE WHEN conference_id % 2 = 0 THEN 'PyConf ' || channel ELSE channel END"))
    return A.channel_profiles(rows).withColumn("years", F.array_join("years", ","))


@register("channel_import_stats", "AGG-19", oracle="""
    SELECT channel, CAST(SUM(n) AS BIGINT) AS talk_count, COUNT(*) AS speaker_count, MAX(n) AS most_by_one_speaker FROM (
      SELECT channel, speaker, COUNT(*) AS n FROM {v_talk} WHERE duration_seconds >= 1200 GROUP BY 1, 2) GROUP BY channel""")
def _(t):
    return A.channel_import_stats(t.view("v_talk"), 20)


@register("top_channels", "WIN-10", oracle="""
    SELECT channel, COUNT(*) AS talk_count FROM {v_talk} GROUP BY channel ORDER BY talk_count DESC, channel LIMIT 5""")
def _(t):
    return W.top_by_talks(A.channel_profiles(t.view("v_talk")), 5, "channel").select("channel", "talk_count")


@register("talks_by_year_budget", "WIN-20", oracle="""
    SELECT object_id, year, view_count FROM (
      SELECT object_id, year, view_count, ROW_NUMBER() OVER (PARTITION BY year ORDER BY view_count DESC, object_id) AS r
      FROM {v_talk} WHERE year IN (1996, 1997, 1998)) WHERE r <= 16
    ORDER BY view_count DESC, object_id LIMIT 50""")
def _(t):
    return W.talks_by_year_budget(t.view("v_talk"), 50, [1996, 1997, 1998]).select("object_id", "year", "view_count")


@register("distinct_speakers", "DUP-7", oracle="SELECT DISTINCT name AS speaker FROM {v_appearance}")
def _(t):
    from rostrum.operators.dedup import distinct_speakers

    return distinct_speakers(talks(t))
