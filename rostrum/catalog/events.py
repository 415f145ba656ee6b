"""Match scores, search, recommendations, event budgets and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.catalog.calls import cfps
from rostrum.catalog.registry import register
from rostrum.catalog.speakers import SCORES, profiles, talks
from rostrum.functions.arrays import cfp_weight
from rostrum.operators import matching as M
from rostrum.operators import ranking as R
from rostrum.operators import search_index as SI
from rostrum.operators import windows as W
from rostrum.plans.proxies import AS_OF
from rostrum.plans.storage import new_path, stored
from rostrum.streaming import trending as T

# ---- match scores -------------------------------------------------------------------------------
READER = R.Profile(
    topics=["Economy", "brand#1"], experience_level="advanced", preferred_formats=["virtual", "hybrid"], interests=["promo", "x"],
    tech_stack=["brand#2", "steel"], travel_wants=["city_7", "NATION_3"], travel_avoids=["nation_5"], speaking_experience="none",
)


def _topic(word: str) -> str:
    return f"(contains(a, '{word}') OR contains('{word}', a) OR contains(b, '{word}') OR contains('{word}', b))"


def _tech(word: str) -> str:
    return f"(contains(a, '{word}') OR contains(b, '{word}'))"


_HITS = [("Economy", "economy"), ("brand#1", "brand#1"), ("promo", "promo"), ("x", "x")]
_NT = " + ".join(f"CAST({_topic(low)} AS INT)" for _, low in _HITS)
_NTECH = " + ".join(f"CAST({_tech(w)} AS INT)" for w in ("brand#2", "steel"))
_WISH = "(contains(ci, 'city_7') OR contains(co, 'city_7') OR contains('city_7', ci) OR contains('city_7', co) OR contains(ci, 'nation_3') OR contains(co, 'nation_3') OR contains('nation_3', ci) OR contains('nation_3', co))"
_AVOID = "(contains(ci, 'nation_5') OR contains(co, 'nation_5'))"
MATCH = f"""
    SELECT object_id, CAST(FLOOR(GREATEST(0, LEAST(100, score)) + 0.5) AS BIGINT) AS score, array_to_string(list_filter(r, lambda x: x IS NOT NULL)[1:3], '; ') AS reasons FROM (
      SELECT *, 30e0 + LEAST(30e0, nt / 4e0 * 30) + LEAST(15, ntech * 5) + CASE WHEN wish THEN 10 ELSE 0 END - CASE WHEN avoid THEN 15 ELSE 0 END
             + CASE WHEN lv IS NULL THEN 5 WHEN contains(lv, 'advanced') OR contains(lv, 'expert') THEN 10 ELSE 0 END
             + CASE WHEN event_format IN ('virtual', 'hybrid') THEN 5 ELSE 0 END + CASE WHEN hn_stories > 0 THEN 3 ELSE 0 END
             + CASE WHEN github_stars > 100 THEN 3 ELSE 0 END + CASE WHEN popularity_score > 50 THEN 4 ELSE 0 END AS score,
             [CASE WHEN nt > 0 THEN 'Topics: ' || array_to_string(list_filter([{', '.join(f"CASE WHEN {_topic(low)} THEN '{own}' END" for own, low in _HITS)}], lambda x: x IS NOT NULL)[1:2], ', ') END,
              CASE WHEN ntech > 0 AND nt = 0 THEN 'Tech: ' || array_to_string(list_filter([{', '.join(f"CASE WHEN {_tech(w)} THEN '{w}' END" for w in ("brand#2", "steel"))}], lambda x: x IS NOT NULL)[1:2], ', ') END,
              CASE WHEN wish THEN 'Dream destination!' END, CASE WHEN avoid THEN 'Travel constraint' END,
              CASE WHEN contains(lv, 'advanced') THEN 'Level fit' END, CASE WHEN event_format IN ('virtual', 'hybrid') THEN event_format || ' event' END,
              CASE WHEN hn_stories > 0 THEN 'Trending on HN' END, CASE WHEN github_stars > 100 THEN 'GitHub buzz' END, CASE WHEN days <= 7 THEN 'Closing soon!' END] AS r
      FROM (SELECT *, {_NT} AS nt, {_NTECH} AS ntech, {_WISH} AS wish, {_AVOID} AS avoid FROM (
        SELECT *, lower(topic_a) AS a, lower(topic_b) AS b, lower(city) AS ci, lower(country) AS co, lower(audience_level) AS lv,
               CAST(FLOOR((cfp_end_date - {AS_OF}) / 86400) AS BIGINT) AS days FROM {{v_cfp}})))"""


@register("match_scores", "RK-1", oracle=MATCH)
def _(t):
    rows = cfps(t).withColumn("technologies", F.array().cast("array<string>"))
    return rows.select("object_id", R.match_score(READER).alias("m")).select("object_id", "m.score", F.array_join("m.reasons", "; ").alias("reasons"))


@register("top_matches", "RK-3", oracle=f"""
    SELECT object_id, score, ROW_NUMBER() OVER (ORDER BY score DESC, object_id) AS rank FROM ({MATCH}) ORDER BY rank LIMIT 20""")
def _(t):
    rows = cfps(t).withColumn("technologies", F.array().cast("array<string>"))
    return R.top_matches(rows, READER, 20).select("object_id", "score", F.col("rank").cast("bigint").alias("rank"))


# ---- match scores of many readers ---------------------------------------------------------------
READERS = """
    SELECT c_custkey AS user_id,
           CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'Economy' WHEN c_custkey % 5 = 1 THEN 'promo' WHEN c_custkey % 5 = 2 THEN 'LARGE cities' ELSE 'brand' END AS topic_a,
           CASE WHEN c_custkey % 31 <> 0 AND c_custkey % 7 <> 0 THEN 'brand#' || CAST(c_custkey % 25 AS STRING) END AS topic_b,
           CASE c_custkey % 4 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN 'x' WHEN 2 THEN 'Small' END AS interest,
           CASE WHEN c_custkey % 31 <> 0 AND c_custkey % 3 = 0 THEN 'Brand#' || CAST(c_custkey % 9 AS STRING) END AS tech_a,
           CASE WHEN c_custkey % 31 <> 0 AND c_custkey % 6 = 0 THEN 'o' END AS tech_b,
           CASE WHEN c_custkey % 2 = 0 THEN 'NATION_' || CAST(c_nationkey AS STRING) WHEN c_custkey % 3 = 0 THEN 'city_' || CAST(c_custkey % 50 AS STRING) END AS want,
           CASE WHEN c_custkey % 5 = 0 THEN 'nation_' || CAST(c_custkey % 25 AS STRING) WHEN c_custkey % 11 = 0 THEN 'n' END AS avoid,
           CASE c_custkey % 3 WHEN 0 THEN 'virtual' WHEN 1 THEN 'hybrid' END AS format,
           CASE c_custkey % 4 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced' END AS experience_level,
           CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE 'some' END AS speaking_experience
    FROM {customer}"""


def _either(word: str) -> str:
    return f"({word} IS NOT NULL AND (contains(a, lower({word})) OR contains(lower({word}), a) OR contains(b, lower({word})) OR contains(lower({word}), b)))"


def _known(word: str) -> str:
    return f"({word} IS NOT NULL AND (contains(a, lower({word})) OR contains(b, lower({word})) OR contains(source, lower({word}))))"


def _number(*tests: str) -> str:
    return "(" + " + ".join(f"CAST({t} AS INT)" for t in tests) + ")"


def _named(test, *words: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test(w)} THEN {w} END" for w in words) + "], lambda x: x IS NOT NULL)[1:2]"


_WORDS, _TECHS = ("topic_a", "topic_b", "interest"), ("tech_a", "tech_b")
READER_SCORES = f"""
    SELECT user_id, object_id, CASE WHEN silent THEN 50 ELSE CAST(FLOOR(GREATEST(0, LEAST(100, score)) + 0.5) AS BIGINT) END AS score,
           CASE WHEN silent THEN 'Set your interests for personalized matches' ELSE array_to_string(list_filter(r, lambda x: x IS NOT NULL)[1:3], '; ') END AS reasons FROM (
      SELECT *, 30e0 + CASE WHEN n > 0 THEN LEAST(30e0, nt / CAST(n AS DOUBLE) * 30) ELSE 0 END + LEAST(15, ntech * 5) + CASE WHEN wish THEN 10 ELSE 0 END - CASE WHEN avoided THEN 15 ELSE 0 END
             + CASE WHEN lv IS NULL THEN 5 WHEN fits THEN 10 ELSE 0 END + CASE WHEN event_format = format THEN 5 ELSE 0 END + CASE WHEN hn_stories > 0 THEN 3 ELSE 0 END
             + CASE WHEN github_stars > 100 THEN 3 ELSE 0 END + CASE WHEN popularity_score > 50 THEN 4 ELSE 0 END AS score,
             [CASE WHEN nt > 0 THEN 'Topics: ' || array_to_string({_named(_either, *_WORDS)}, ', ') END,
              CASE WHEN ntech > 0 AND nt = 0 THEN 'Tech: ' || array_to_string({_named(_known, *_TECHS)}, ', ') END,
              CASE WHEN wish THEN 'Dream destination!' END, CASE WHEN avoided THEN 'Travel constraint' END, CASE WHEN fits THEN 'Level fit' END,
              CASE WHEN event_format = format THEN event_format || ' event' END, CASE WHEN hn_stories > 0 THEN 'Trending on HN' END,
              CASE WHEN github_stars > 100 THEN 'GitHub buzz' END, CASE WHEN days <= 7 THEN 'Closing soon!' END] AS r
      FROM (SELECT *, {_number(*[_either(w) for w in _WORDS])} AS nt, {_number(*[f"{w} IS NOT NULL" for w in _WORDS])} AS n, {_number(*[_known(w) for w in _TECHS])} AS ntech,
                   topic_a IS NULL AND topic_b IS NULL AND tech_a IS NULL AND tech_b IS NULL AS silent,
                   want IS NOT NULL AND (contains(ci, lower(want)) OR contains(co, lower(want)) OR contains(lower(want), ci) OR contains(lower(want), co)) AS wish,
                   avoid IS NOT NULL AND (contains(ci, avoid) OR contains(co, avoid)) AS avoided,
                   lv IS NOT NULL AND CASE experience_level WHEN 'beginner' THEN contains(lv, 'beginner') OR contains(lv, 'all') WHEN 'intermediate' THEN NOT contains(lv, 'expert')
                     WHEN 'advanced' THEN contains(lv, 'advanced') OR contains(lv, 'expert') ELSE FALSE END AS fits
            FROM (SELECT object_id, lower(topic_a) AS a, lower(topic_b) AS b, source, lower(city) AS ci, lower(country) AS co, audience_level AS lv, event_format, hn_stories, github_stars, popularity_score,
                         CAST(FLOOR((cfp_end_date - {AS_OF}) / 86400) AS BIGINT) AS days FROM {{v_cfp}}), ({READERS})))"""


@register("top_matches_by_user", "RK-1", "RK-3", oracle=f"""
    SELECT * FROM (SELECT user_id, object_id, score, reasons, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY score DESC, object_id) AS rank FROM ({READER_SCORES})) WHERE rank <= 5""")
def _(t):
    listed = lambda *c: F.array_compact(F.array(*c))
    readers = t.sql(READERS).select(
        "user_id", "experience_level", "speaking_experience", listed("topic_a", "topic_b").alias("topics"), listed("interest").alias("interests"), listed("tech_a", "tech_b").alias("tech_stack"),
        listed("want").alias("travel_wants"), listed("avoid").alias("travel_avoids"), listed("format").alias("preferred_formats"))
    out = M.top_matches_by_user(readers, cfps(t).withColumn("technologies", F.array("source")), 5, user="user_id")
    return out.select("user_id", "object_id", "score", F.array_join("reasons", "; ").alias("reasons"), F.col("rank").cast("bigint").alias("rank"))


@register("quick_matches", "RK-2", oracle="""
    SELECT object_id, CAST(FLOOR(LEAST(100, s + CASE WHEN github_stars > 100 THEN 5 ELSE 0 END) + 0.5) AS BIGINT) AS score, CAST(FLOOR(LEAST(100, s) + 0.5) AS BIGINT) AS short_score FROM (
      SELECT object_id, github_stars, LEAST(100, 40 + (CAST(contains(a, 'economy') OR contains(b, 'economy') AS INT) + CAST(contains(a, '#1') OR contains(b, '#1') AS INT)
               + CAST(contains(a, 'zz') OR contains(b, 'zz') AS INT)) / 3e0 * 60) + CASE WHEN hn_stories > 0 THEN 5 ELSE 0 END + CASE WHEN popularity_score > 50 THEN 5 ELSE 0 END AS s
      FROM (SELECT *, lower(topic_a) AS a, lower(topic_b) AS b FROM {v_cfp}))""")
def _(t):
    wanted = ["Economy", "#1", "zz"]
    return cfps(t).select("object_id", R.quick_match(wanted).alias("score"), R.quick_match(wanted, with_stars=False).alias("short_score"))


# ---- search -------------------------------------------------------------------------------------
def _word(text: str, word: str, prefix: bool) -> str:
    end = "" if prefix else "($|[^a-z0-9_])"
    return f"regexp_matches(lower({text}), '(^|[^a-z0-9_]){word}{end}')"


SEARCH = f"""
    WITH c AS (SELECT object_id, LEAST(CASE WHEN {_word('name', 'red', False)} THEN 0 WHEN {_word('description', 'red', False)} THEN 1 ELSE 9 END,
                      CASE WHEN {_word('name', 'w', True)} THEN 0 WHEN {_word('description', 'w', True)} THEN 1 ELSE 9 END) AS attribute, cfp_end_date,
                      CAST(FLOOR((cfp_end_date - {AS_OF}) / 86400) AS BIGINT) AS days
               FROM {{v_cfp}} WHERE ({_word('name', 'red', False)}) AND ({_word('name', 'w', True)})),
         s AS (SELECT * FROM ({SCORES}))
    (SELECT 'cfps' AS index, CAST(object_id AS VARCHAR) AS object_id, attribute, ROW_NUMBER() OVER (ORDER BY attribute, days, cfp_end_date, object_id) AS rank FROM c ORDER BY rank LIMIT 4)"""


@register("keyword_search", "RK-4", oracle=SEARCH)
def _(t):
    out = R.multi_search({"cfps": cfps(t)}, "red w", 4)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register("indexed_search", "RK-4", oracle=SEARCH)
def _(t):
    """The same search over a stored inverted index."""
    path = new_path(t.spark, "index")
    SI.write_search_index(cfps(t), "cfps", path)
    out = SI.search_index(t.spark, path, "red w", 4)
    return out.select(F.lit("cfps").alias("index"), F.col("object_id").cast("string").alias("object_id"), "attribute", F.col("rank").cast("bigint").alias("rank"))


@register("multi_search", "RK-4", oracle=f"""
    (SELECT 'cfps' AS index, CAST(object_id AS VARCHAR) AS object_id, 2 AS attribute, ROW_NUMBER() OVER (ORDER BY CAST(FLOOR((cfp_end_date - {AS_OF}) / 86400) AS BIGINT), cfp_end_date, object_id) AS rank
     FROM {{v_cfp}} WHERE topic_b LIKE 'Brand#%' ORDER BY rank LIMIT 4)
    UNION ALL (SELECT 'talks', object_id, 2, ROW_NUMBER() OVER (ORDER BY view_count DESC, year DESC, object_id) AS rank FROM {{v_talk}}
     WHERE talk_id IN (SELECT talk_id FROM {{v_topic}}) ORDER BY rank LIMIT 4)
    UNION ALL (SELECT 'speakers', object_id, 1, ROW_NUMBER() OVER (ORDER BY influence_score DESC, total_views DESC, talk_count DESC, active_years DESC, object_id) AS rank
     FROM (SELECT *, slug AS object_id FROM ({SCORES})) WHERE slug IN (SELECT TRIM(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') FROM {{v_appearance}} a JOIN {{v_topic}} p USING (talk_id)) ORDER BY rank LIMIT 4)""")
def _(t):
    # two indexes are made from the talks, which are put together once
    own = stored(talks(t), "talks")
    tables = {
        "cfps": cfps(t),
        "talks": own.withColumn("title", F.lit("x")).drop("channel"),
        "speakers": profiles(t, own).withColumnRenamed("slug", "object_id").drop("conferences"),
    }
    tables["talks"] = tables["talks"].drop("popularity_score", "title")
    out = R.multi_search(tables, "brand", 4)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


# ---- recommendations ----------------------------------------------------------------------------
RECENT = f"ts <= to_timestamp({AS_OF}) AT TIME ZONE 'UTC' AND ts > to_timestamp({AS_OF} - 30 * 86400) AT TIME ZONE 'UTC'"


@register("trending_items", "RC-1", oracle=f"""
    SELECT object_id, COUNT(*) FILTER (event_type = 'conversion') AS conversions, COUNT(*) AS events FROM {{v_event}} WHERE {RECENT}
    GROUP BY object_id ORDER BY conversions DESC, events DESC, object_id LIMIT 10""")
def _(t):
    return R.trending_items(t.view("v_event"), AS_OF)


@register("trending_facets", "RC-2", oracle=f"""
    SELECT value, CAST(SUM(n) AS BIGINT) AS score FROM (SELECT object_id, COUNT(*) AS n FROM {{v_event}} WHERE {RECENT} GROUP BY 1) e
    JOIN (SELECT CAST(object_id AS VARCHAR) AS object_id, topic_a AS value FROM {{v_cfp}} UNION SELECT CAST(object_id AS VARCHAR), topic_b FROM {{v_cfp}}) i USING (object_id)
    GROUP BY value ORDER BY score DESC, value LIMIT 10""")
def _(t):
    items = cfps(t).withColumn("object_id", F.col("object_id").cast("string"))
    return R.trending_facets(t.view("v_event"), items, "topics", AS_OF)


@register("watched_together", "RC-3", oracle="""
    WITH p AS (SELECT DISTINCT user_token, object_id FROM {v_event})
    SELECT object_id, COUNT(*) AS users FROM p WHERE object_id <> '7' AND user_token IN (SELECT user_token FROM p WHERE object_id = '7')
    GROUP BY object_id ORDER BY users DESC, object_id LIMIT 10""")
def _(t):
    return R.watched_together(t.view("v_event"), "7")


@register("related_talks", "RC-4", oracle="""
    WITH n AS (SELECT talk_id, COUNT(*) AS n FROM {v_topic} GROUP BY 1), own AS (SELECT topic FROM {v_topic} WHERE talk_id = 1)
    SELECT 'yt_' || CAST(talk_id AS VARCHAR) AS object_id, ROUND(s / CAST(n + (SELECT COUNT(*) FROM own) - s AS DOUBLE), 6) AS score FROM (
      SELECT talk_id, COUNT(*) AS s FROM {v_topic} WHERE topic IN (SELECT topic FROM own) AND talk_id <> 1 GROUP BY 1) JOIN n USING (talk_id)
    ORDER BY s / CAST(n + (SELECT COUNT(*) FROM own) - s AS DOUBLE) DESC, object_id LIMIT 10""")
def _(t):
    return R.related_items(talks(t), "yt_1").withColumn("score", F.round("score", 6))


@register("related_calls", "RC-4", oracle="""
    WITH c AS (SELECT object_id, topic_a, topic_b FROM {v_cfp}),
    p AS (SELECT a.object_id, b.object_id AS related, CASE WHEN a.topic_a = b.topic_a AND a.topic_b = b.topic_b THEN 1e0 ELSE 1e0 / 3 END AS score
          FROM c a JOIN c b ON a.object_id <> b.object_id AND (a.topic_a = b.topic_a OR a.topic_b = b.topic_b))
    SELECT object_id, related, ROUND(score, 6) AS score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id ORDER BY score DESC, related) AS rank FROM p) WHERE rank <= 8""")
def _(t):
    out = R.related_for_all(cfps(t), 8)
    return out.select("object_id", "related", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@register("event_log", "RC-5", oracle="""
    SELECT event_id, CASE k WHEN 0 THEN 'Carousel Viewed: ' || CASE WHEN event_id % 2 = 0 THEN 'viral' ELSE 'hot' END WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'Talk Clicked' ELSE 'CFP Clicked' END
             ELSE CASE WHEN event_id % 2 = 0 THEN 'Talk Video Opened' ELSE 'CFP Submission Started' END END AS event_name,
           CASE WHEN event_id % 2 = 0 THEN 'talks' ELSE 'cfps' END AS index, CASE WHEN k = 1 AND event_id % 5 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 3 ELSE 1 END END AS position,
           COUNT(*) AS objects, MAX(object_id) AS last_object
    FROM (SELECT event_id, event_id % 3 AS k, UNNEST(range(0, CASE WHEN event_id % 3 = 0 THEN LEAST(20, event_id % 30) ELSE 1 END)) AS object_id FROM {events} WHERE event_id % 3 <> 0 OR event_id % 30 > 0)
    GROUP BY 1, 2, 3, 4""")
def _(t):
    actions = t.sql("""SELECT event_id, user_id AS user_token, ts, CASE event_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'conversion' END AS action,
        CASE WHEN event_id % 2 = 0 THEN 'talk' ELSE 'cfp' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'viral' ELSE 'hot' END AS carousel,
        CASE WHEN event_id % 3 <> 0 THEN array(CAST(0 AS BIGINT)) WHEN event_id % 30 = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE sequence(CAST(0 AS BIGINT), event_id % 30 - 1) END AS object_ids,
        CASE WHEN event_id % 4 = 0 THEN 3 END AS position, CASE WHEN event_id % 5 = 0 THEN 'q' END AS query_id FROM {events}""")
    log = R.event_log(actions.withColumn("user_token", F.col("event_id")))
    return log.groupBy(F.col("user_token").alias("event_id"), "event_name", "index", "position").agg(F.count("*").alias("objects"), F.max("object_id").alias("last_object"))


@register("recent_distinct_items", "WIN-14", oracle="""
    SELECT user_token, object_id, rank FROM (SELECT user_token, object_id, ROW_NUMBER() OVER (PARTITION BY user_token ORDER BY last DESC, object_id) AS rank
      FROM (SELECT user_token, object_id, MAX(ts) AS last FROM {v_event} GROUP BY 1, 2)) WHERE rank <= 20""")
def _(t):
    return W.recent_distinct(t.view("v_event"), 20).select("user_token", "object_id", F.col("rank").cast("bigint").alias("rank"))


@register("budgeted_events", "WIN-13", "FN-MTH-1", oracle="""
    SELECT object_id, weight, CAST(GREATEST(0, LEAST(weight, 800 - before)) AS BIGINT) AS events FROM (
      SELECT object_id, weight, COALESCE(SUM(weight) OVER (ORDER BY weight DESC, object_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
        SELECT object_id, LEAST(25, 2 + CASE WHEN hn_points > 100 THEN 8 WHEN hn_points > 50 THEN 5 WHEN hn_points > 10 THEN 3 WHEN hn_points > 0 THEN 2 ELSE 0 END
             + CASE WHEN github_stars > 100 THEN 3 WHEN github_stars > 0 THEN 1 ELSE 0 END + CASE WHEN popularity_score > 80 THEN 4 WHEN popularity_score > 50 THEN 2 WHEN popularity_score > 20 THEN 1 ELSE 0 END) AS weight
        FROM {v_cfp})) WHERE before < 800""")
def _(t):
    weight = cfp_weight(F.col("hn_points"), F.col("github_stars"), F.col("popularity_score"))
    spread = W.budgeted_events(t.view("v_cfp").withColumn("weight", weight), 800)
    return spread.groupBy("object_id", "weight").agg(F.count("*").alias("events"))


# ---- streams ------------------------------------------------------------------------------------
WINDOWS = """
    SELECT strftime(d, '%Y-%m-%d') AS window_start, object_id, COUNT(*) AS events, COUNT(*) FILTER (event_type = 'conversion') AS conversions
    FROM (SELECT object_id, event_type, UNNEST(list_transform(range(0, 7), lambda i: CAST(date_trunc('day', ts) AS DATE) - CAST(i AS INTEGER))) AS d, ts FROM {v_event})
    GROUP BY 1, 2"""


@register("trending_windows", "STR-1", oracle=WINDOWS)
def _(t):
    rows = T.trending_windows(t.view("v_event"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "object_id", "events", "conversions")


@register("streamed_trending_windows", "STR-1", oracle=f"SELECT * FROM ({WINDOWS})")
def _(t):
    """The stream over event files gives the windows of the batch, the open ones too."""
    source, sink = new_path(t.spark, "events"), new_path(t.spark, "trending")
    t.view("v_event").select("event_id", "ts", "user_token", "object_id", "event_type").write.parquet(source)
    T.write_trending(T.event_stream(t.spark, source), sink, new_path(t.spark, "stream")).awaitTermination()
    rows = T.read_trending(t.spark, sink)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "object_id", "events", "conversions")
