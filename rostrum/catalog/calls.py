"""Queries over calls: filters, de-duplication, aggregates, carousels and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.catalog.registry import Tables, register
from rostrum.operators import aggregates as A
from rostrum.operators import dedup as D
from rostrum.operators import filters as FL
from rostrum.operators import intel as I
from rostrum.operators import joins as J
from rostrum.operators import place_index as P
from rostrum.operators import windows as W
from rostrum.plans import jobs
from rostrum.plans.proxies import AS_OF
from rostrum.plans.storage import new_path
from rostrum.sources import sinks as S
from rostrum.sources import snapshots as T

DAYS = f"CAST(FLOOR((cfp_end_date - {AS_OF}) / 86400) AS BIGINT)"


def cfps(t: Tables) -> DataFrame:
    """The call proxy with topics, days left and enrichment flags."""
    return t.view("v_cfp").withColumns({
        "topics": F.array("topic_a", "topic_b"),
        "days_until_cfp_close": F.floor((F.col("cfp_end_date") - AS_OF) / 86400),
        "intel_enriched": F.col("seq") % 3 != 0, "enriched": F.col("seq") % 4 == 0,
    })


# ---- filters ------------------------------------------------------------------------------------
ENDS = "SELECT object_id, CASE WHEN seq % 10 = 0 THEN NULL WHEN seq % 11 = 0 THEN 0 ELSE cfp_end_date END AS cfp_end_date FROM {v_cfp}"


@register("open_calls", "FLT-1", oracle=f"SELECT * FROM ({ENDS}) WHERE cfp_end_date IS NULL OR cfp_end_date = 0 OR cfp_end_date > {AS_OF}")
def _(t):
    return FL.open_only(t.sql(ENDS), AS_OF)


@register("not_closed_calls", "FLT-2", oracle=f"SELECT * FROM ({ENDS}) WHERE NOT (cfp_end_date < {AS_OF} AND cfp_end_date <> 0) OR cfp_end_date IS NULL")
def _(t):
    return FL.not_closed(t.sql(ENDS), AS_OF)


LINKS = """SELECT object_id, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN '' ELSE cfp_url END AS cfp_url,
    CASE seq % 4 WHEN 0 THEN 'https://sessionize.com/' || name WHEN 1 THEN 'https://Sessionize.com/x' ELSE cfp_url END AS url,
    CASE seq % 5 WHEN 0 THEN 'https://icons/' || name WHEN 1 THEN '' END AS icon_url FROM {v_cfp}"""


@register("calls_with_link", "FLT-3", oracle=f"SELECT object_id, cfp_url FROM ({LINKS}) WHERE cfp_url IS NOT NULL AND cfp_url <> ''")
def _(t):
    return FL.has_cfp_url(t.sql(LINKS)).select("object_id", "cfp_url")


@register("platform_calls", "FLT-19", oracle=f"""
    SELECT object_id, url AS sessionize_url FROM ({LINKS}) WHERE contains(lower(split_part(split_part(url, '://', 2), '/', 1)), 'sessionize.com')""")
def _(t):
    return FL.sessionize_only(t.sql(LINKS)).select("object_id", "sessionize_url")


@register("favicons", "PRJ-7", oracle=f"""
    SELECT object_id, CASE WHEN icon_url <> '' THEN icon_url ELSE 'https://www.google.com/s2/favicons?domain=' || split_part(split_part(url, '://', 2), '/', 1) || '&sz=64' END AS icon_url
    FROM ({LINKS})""")
def _(t):
    from rostrum.operators.projections import favicon_fill

    return favicon_fill(t.sql(LINKS)).select("object_id", "icon_url")


@register("trending_levels", "FLT-17", oracle="""
    SELECT object_id, CASE WHEN p IS NULL OR p < 30 THEN 'none' WHEN p >= 60 THEN 'hot' WHEN p >= 45 THEN 'warm' ELSE 'mild' END AS level
    FROM (SELECT object_id, CASE WHEN seq % 7 <> 0 THEN popularity_score END AS p FROM {v_cfp})""")
def _(t):
    return t.view("v_cfp").select("object_id", FL.trending_level(F.when(F.col("seq") % 7 != 0, F.col("popularity_score"))).alias("level"))


@register("located_calls", "FLT-18", oracle="SELECT object_id, lat, lng FROM {v_cfp} WHERE lat <> 0 AND lng <> 0")
def _(t):
    return FL.has_geo(t.view("v_cfp")).select("object_id", "lat", "lng")


@register("map_bounds", "FLT-18", oracle="""
    SELECT COUNT(*) AS hits, MIN(lat) AS south, MAX(lat) AS north, MIN(lng) AS west, MAX(lng) AS east FROM {v_cfp} WHERE lat <> 0 AND lng <> 0""")
def _(t):
    return FL.bounding_box(t.view("v_cfp"))


CACHE = """SELECT object_id, 'cached ' || name AS description, 'advanced' AS audience_level,
    CASE WHEN seq % 2 = 0 THEN 'hybrid' END AS event_format FROM {v_cfp} WHERE seq % 5 = 1"""


@register("enrichment_queue", "FLT-15", oracle="SELECT object_id FROM {v_cfp} WHERE seq % 4 <> 0 AND seq % 5 <> 1")
def _(t):
    return FL.needs_enrichment(cfps(t), t.sql(CACHE)).select("object_id")


@register("intel_queue", "FLT-15", oracle="SELECT object_id FROM {v_cfp} WHERE seq % 3 = 0")
def _(t):
    return FL.needs_intel(cfps(t)).select("object_id")


@register("missing_descriptions", "FLT-15", oracle="SELECT object_id FROM {v_cfp} WHERE seq % 5 = 0")
def _(t):
    return FL.missing_description(cfps(t)).select("object_id")


@register("cached_enrichment", "JN-1", oracle="""
    SELECT object_id, CASE WHEN seq % 5 = 1 THEN 'cached ' || name ELSE description END AS description,
           CASE WHEN seq % 5 = 1 THEN 'advanced' ELSE audience_level END AS audience_level,
           CASE WHEN seq % 5 = 1 THEN CASE WHEN seq % 2 = 0 THEN 'hybrid' END ELSE event_format END AS event_format,
           seq % 5 = 1 OR seq % 4 = 0 AS enriched FROM {v_cfp}""")
def _(t):
    return J.apply_cache(cfps(t), t.sql(CACHE)).select("object_id", "description", "audience_level", "event_format", "enriched")


# ---- de-duplication -----------------------------------------------------------------------------
LISTED = """SELECT p_partkey AS object_id, p_partkey AS seq,
    CASE p_partkey % 3 WHEN 0 THEN 'confs.tech' WHEN 1 THEN 'callingallpapers' ELSE 'developers.events' END AS source,
    CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'HTTPS://Call-' || CAST(p_partkey * 7919 % 1500 AS STRING) || '/'
         ELSE 'https://call-' || CAST(p_partkey * 7919 % 1500 AS STRING) END AS cfp_url,
    CASE WHEN p_partkey % 4 = 0 THEN UPPER(p_name) || '-' || p_brand ELSE p_name || ' ' || p_brand END AS name,
    p_type AS topic_a, CASE WHEN p_size % 2 = 0 THEN p_brand END AS topic_b FROM {part}"""
KEYS = f"""SELECT *, CASE WHEN source = 'callingallpapers' THEN 0 ELSE 1 END AS pref, NULLIF(rtrim(lower(cfp_url), '/'), '') AS u,
    substr(replace(replace(lower(name), ' ', ''), '-', ''), 1, 30) AS n FROM ({LISTED})"""


@register("deduplicated_calls", "DUP-1", oracle=f"""
    WITH RECURSIVE k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY pref, seq, object_id) AS i FROM ({KEYS})),
    walk AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS object_id, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS names, FALSE AS keep
      UNION ALL
      SELECT k.i, k.object_id, CASE WHEN free AND u IS NOT NULL THEN list_append(urls, u) ELSE urls END,
             CASE WHEN free THEN list_append(names, n) ELSE names END, free
      FROM (SELECT w.urls, w.names, k.*, NOT (u IS NOT NULL AND list_contains(w.urls, u)) AND NOT list_contains(w.names, n) AS free
            FROM walk w JOIN k ON k.i = w.i + 1) k)
    SELECT object_id FROM walk WHERE keep""")
def _(t):
    return D.dedup_cfps(t.sql(LISTED), ["seq"]).select("object_id")


@register("merged_topics", "DUP-2", oracle=f"""
    WITH RECURSIVE k AS (
      SELECT n, topics, ROW_NUMBER() OVER (PARTITION BY n ORDER BY pref, seq, object_id) AS i
      FROM (SELECT *, list_sort(list_distinct(list_filter([topic_a, topic_b], lambda x: x IS NOT NULL))) AS topics FROM ({KEYS}))),
    walk AS (
      SELECT n, i, topics FROM k WHERE i = 1
      UNION ALL
      SELECT k.n, k.i, CASE WHEN len(k.topics) > len(w.topics) THEN list_sort(list_distinct(w.topics || k.topics)) ELSE w.topics END
      FROM walk w JOIN k ON k.n = w.n AND k.i = w.i + 1)
    SELECT n AS name_key, array_to_string(arg_max(topics, i), ',') AS topics FROM walk GROUP BY n""")
def _(t):
    rows = t.sql(LISTED).withColumn("topics_normalized", F.array_compact(F.array("topic_a", "topic_b")))
    merged = D.merge_topics_on_name_dup(rows, ["seq"])
    return merged.select("name_key", F.array_join("topics_normalized", ",").alias("topics"))


@register("first_seen_links", "DUP-3", oracle=f"""
    SELECT arg_min(object_id, seq) AS object_id, cfp_url FROM ({LISTED}) WHERE cfp_url IS NOT NULL GROUP BY cfp_url""")
def _(t):
    return D.first_seen_distinct(t.sql(LISTED), "cfp_url", ["seq"]).select("object_id", "cfp_url")


@register("feed_union", "SET-1", oracle="SELECT source, CASE source WHEN 'callingallpapers' THEN 0 WHEN 'confs.tech' THEN 1 ELSE 2 END AS source_rank, COUNT(*) AS n FROM {v_cfp} GROUP BY 1, 2")
def _(t):
    rows = t.view("v_cfp")
    feeds = [rows.filter(F.col("source") == name) for name in jobs.FEED_ORDER]
    return jobs.union_feeds(feeds).groupBy("source", "source_rank").agg(F.count("*").alias("n"))


@register("name_overlap", "SET-2", oracle="""
    SELECT COUNT(*) AS overlap FROM (SELECT name FROM {v_cfp} WHERE seq % 2 = 0 INTERSECT SELECT name FROM {v_cfp} WHERE seq % 5 = 1)""")
def _(t):
    rows = t.view("v_cfp")
    return I.set_overlap(rows.filter("seq % 2 = 0"), rows.filter("seq % 5 = 1"), "name")


# ---- aggregates ---------------------------------------------------------------------------------
@register("dataset_stats", "AGG-12", oracle=f"""
    SELECT 'status' AS kind, CASE WHEN cfp_end_date > {AS_OF} THEN 'open' ELSE 'closed' END AS value, COUNT(*) AS n FROM {{v_cfp}} GROUP BY 2
    UNION ALL (SELECT 'region', COALESCE(region, continent, 'Unknown') AS r, COUNT(*) AS n FROM {{v_cfp}} GROUP BY r ORDER BY n DESC, r LIMIT 5)
    UNION ALL (SELECT 'category', c, COUNT(*) AS n FROM (SELECT topic_a AS c FROM {{v_cfp}} UNION ALL SELECT topic_b FROM {{v_cfp}}) GROUP BY c ORDER BY n DESC, c LIMIT 5)""")
def _(t):
    return A.dataset_stats(cfps(t), AS_OF)


@register("intel_stats", "AGG-13", oracle=f"""
    SELECT UNNEST(['Total CFPs', 'Intel-enriched', 'With popularity score', 'With HN stories', 'With GitHub repos', 'With Reddit posts',
                   'Hot deadlines (<=7d)', 'Warning deadlines (7-30d)']) AS category,
           UNNEST([COUNT(*), COUNT(*) FILTER (seq % 3 <> 0), COUNT(*) FILTER (popularity_score > 0), COUNT(*) FILTER (hn_stories > 0),
                   COUNT(*) FILTER (github_repos > 0), COUNT(*) FILTER (reddit_posts > 0), COUNT(*) FILTER ({DAYS} BETWEEN 0 AND 7),
                   COUNT(*) FILTER ({DAYS} > 7 AND {DAYS} <= 30)]) AS n FROM {{v_cfp}}
    UNION ALL SELECT 'Total talks', COUNT(*) FROM {{v_talk}} UNION ALL SELECT 'Viral (>10K views)', COUNT(*) FROM {{v_talk}} WHERE view_count > 10000""")
def _(t):
    return A.intel_stats(cfps(t), t.view("v_talk"), AS_OF)


@register("coverage_audit", "AGG-15", oracle="""
    SELECT COUNT(*) AS total, COUNT(description) AS with_description, ROUND(100e0 * COUNT(description) / COUNT(*), 1) AS with_description_pct,
           COUNT(*) AS with_topics, 100e0 AS with_topics_pct, COUNT(*) FILTER (seq % 4 = 0) AS enriched,
           ROUND(100e0 * COUNT(*) FILTER (seq % 4 = 0) / COUNT(*), 1) AS enriched_pct FROM {v_cfp}""")
def _(t):
    return A.audit_coverage(cfps(t))


FACETS = {"topics": "topics", "country": "country", "event_format": "event_format", "audience_level": "audience_level"}
_REFINED = {"event_format": "event_format = 'virtual'", "country": "country IN ('NATION_3', 'NATION_4', 'NATION_5')"}


def _facet_sql() -> str:
    parts = []
    for name, value in (("topics", "topic_a"), ("topics", "topic_b"), ("country", "country"), ("event_format", "event_format"), ("audience_level", "audience_level")):
        others = [c for a, c in _REFINED.items() if a != name]
        parts.append(f"SELECT '{name}' AS attribute, {value} AS value FROM {{v_cfp}} WHERE {value} IS NOT NULL AND {' AND '.join(others)}")
    return f"""SELECT attribute, value, n, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY attribute ORDER BY n DESC, value) AS rank
        FROM (SELECT attribute, value, COUNT(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2)) WHERE rank <= 10"""


@register("facet_counts", "AGG-16", oracle=_facet_sql())
def _(t):
    attributes = {name: (F.col("topics") if name == "topics" else F.array(name)) for name in FACETS}
    refined = {"event_format": ["virtual"], "country": ["NATION_3", "NATION_4", "NATION_5"]}
    out = A.facet_counts(cfps(t), attributes, 10, refined)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@register("city_counts", "AGG-23", oracle="SELECT city, COUNT(*) AS n FROM {v_cfp} WHERE lower(city) <> 'online' GROUP BY city")
def _(t):
    return A.city_counts(t.view("v_cfp"))


GEO = """SELECT object_id, CASE WHEN seq % 6 <> 0 THEN city || ', ' || country END AS location_raw, CASE WHEN seq % 5 <> 0 THEN lat END AS lat, lng,
    CASE WHEN seq % 4 <> 0 THEN city END AS city, country, CASE WHEN seq % 9 = 0 THEN 'fetch_failed' END AS error FROM {v_cfp}"""


@register("geocode_coverage", "AGG-29", oracle=f"""
    SELECT COUNT(*) AS total, COUNT(location_raw) AS with_location, 100 * COUNT(location_raw) // COUNT(*) AS with_location_pct,
           COUNT(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL) AS geocoded, 100 * COUNT(*) FILTER (lat IS NOT NULL AND lng IS NOT NULL) // COUNT(*) AS geocoded_pct,
           COUNT(city) AS with_city, 100 * COUNT(city) // COUNT(*) AS with_city_pct, COUNT(country) AS with_country, 100 * COUNT(country) // COUNT(*) AS with_country_pct,
           COUNT(error) AS errors, 100 * COUNT(error) // COUNT(*) AS errors_pct FROM ({GEO})""")
def _(t):
    return A.geocode_coverage(t.sql(GEO))


TAGGED = """SELECT id, id % 5 <> 0 AS enriched_flag, CASE id % 4 WHEN 0 THEN 'ReactJS' WHEN 1 THEN 'react.js' WHEN 2 THEN 'K8s' ELSE brand END AS k1,
    kind AS k2, CASE WHEN id % 3 = 0 THEN 'Kubernetes' ELSE 'React' END AS t1 FROM {v_person}"""
TAG_FREQ = f"SELECT tag, COUNT(*) AS n FROM (SELECT UNNEST([k1, k2, t1]) AS tag FROM ({TAGGED}) WHERE enriched_flag) GROUP BY tag"


def _tag_frequencies(t: Tables) -> DataFrame:
    rows = t.sql(TAGGED).select(F.col("enriched_flag").alias("transcript_enriched"), F.array("k1", "k2").alias("keywords"), F.array("t1").alias("topics"))
    return A.tag_frequencies(rows)


@register("tag_frequencies", "AGG-20", oracle=TAG_FREQ)
def _(t):
    return _tag_frequencies(t)


@register("tag_clusters", "AGG-21", oracle=f"""
    SELECT canonical, COUNT(*) AS variants, CAST(SUM(n) AS BIGINT) AS total, array_to_string(list(tag ORDER BY n DESC, tag)[1:5], ',') AS sample FROM (
      SELECT tag, n, CASE WHEN lower(tag) IN ('reactjs', 'react.js') THEN 'React' WHEN lower(tag) = 'k8s' OR tag = 'Kubernetes' THEN 'Kubernetes' ELSE tag END AS canonical
      FROM ({TAG_FREQ})) GROUP BY canonical HAVING COUNT(*) > 1""")
def _(t):
    return A.tag_clusters(_tag_frequencies(t)).withColumn("sample", F.array_join("sample", ","))


@register("enrichment_outcomes", "AGG-30", oracle="""
    SELECT CASE seq % 7 WHEN 0 THEN 'no_transcript' WHEN 1 THEN 'error' ELSE 'success' END AS status, COUNT(*) AS n FROM {v_cfp} GROUP BY 1""")
def _(t):
    return A.enrichment_outcomes(t.sql("SELECT CASE seq % 7 WHEN 0 THEN 'no_transcript' WHEN 1 THEN 'error' ELSE 'success' END AS status FROM {v_cfp}"))


# ---- windows ------------------------------------------------------------------------------------
RANK = f"{DAYS}, cfp_end_date, object_id"


@register("call_index_ranking", "WIN-2", "FN-DT-7", oracle=f"SELECT object_id, {DAYS} AS days_until_cfp_close, cfp_end_date FROM {{v_cfp}}")
def _(t):
    return W.index_ranking(cfps(t), "cfps").select("object_id", "days_until_cfp_close", "cfp_end_date")


for _name, (_column, _desc) in W.REPLICAS.items():

    @register(f"replica_by_{_name}", "WIN-3", oracle=f"SELECT object_id, {DAYS if _column.startswith('days') else _column} AS figure FROM {{v_cfp}}")
    def _(t, name=_name, column=_column):
        return W.sorted_replica(cfps(t), name).select("object_id", F.col(column).alias("figure"))


@register("carousels", "WIN-4", oracle=f"""
    WITH c AS (SELECT * FROM {{v_cfp}} WHERE cfp_end_date > {AS_OF})
    (SELECT 'hot-deadlines' AS carousel, CAST(object_id AS VARCHAR) AS object_id, ROW_NUMBER() OVER (ORDER BY {RANK}) AS rank FROM c WHERE cfp_end_date < {AS_OF} + 7 * 86400 ORDER BY rank LIMIT 20)
    UNION ALL (SELECT 'for-you', CAST(object_id AS VARCHAR), ROW_NUMBER() OVER (ORDER BY {RANK}) AS rank FROM c WHERE topic_a IN ('ECONOMY', 'Brand#3') OR topic_b IN ('ECONOMY', 'Brand#3') ORDER BY rank LIMIT 15)
    UNION ALL (SELECT 'trending-hn', CAST(object_id AS VARCHAR), ROW_NUMBER() OVER (ORDER BY {RANK}) AS rank FROM c WHERE hn_stories > 0 ORDER BY rank LIMIT 15)
    UNION ALL (SELECT 'github-buzz', CAST(object_id AS VARCHAR), ROW_NUMBER() OVER (ORDER BY {RANK}) AS rank FROM c WHERE github_repos > 0 ORDER BY rank LIMIT 15)
    UNION ALL (SELECT 'viral-talks', object_id, ROW_NUMBER() OVER (ORDER BY p DESC, view_count DESC, year DESC, object_id) AS rank FROM
               (SELECT *, view_count / CAST(GREATEST(1, 2024 - year) AS DOUBLE) AS p FROM {{v_talk}} WHERE view_count > 10000) ORDER BY rank LIMIT 20)""")
def _(t):
    from rostrum.operators.projections import derive_talk_fields

    talks = derive_talk_fields(t.view("v_talk"), 2024)
    configs = [c for c in W.carousel_configs(AS_OF, ["ECONOMY", "Brand#3"]) if not c.id.startswith("talks-")]
    parts = [
        W.carousels(table, [c for c in configs if c.index == index], AS_OF).select(
            "carousel", F.col("object_id").cast("string").alias("object_id"), F.col("rank").cast("bigint").alias("rank"))
        for index, table in (("cfps", cfps(t)), ("talks", talks))
    ]
    return parts[0].unionByName(parts[1])


@register("topic_talk_carousel", "WIN-4", oracle="""
    SELECT object_id, p AS popularity FROM (SELECT talk_id, object_id, view_count, year, ROUND(view_count / CAST(GREATEST(1, 2024 - year) AS DOUBLE), 6) AS p FROM {v_talk})
    WHERE talk_id IN (SELECT talk_id FROM {v_topic} WHERE topic = 'Brand#3') ORDER BY p DESC, view_count DESC, year DESC, object_id LIMIT 15""")
def _(t):
    from rostrum.catalog.speakers import talks
    from rostrum.operators.projections import derive_talk_fields

    config = W.carousel_configs(AS_OF, ["Brand#3"])[-1]
    rows = W.carousel(derive_talk_fields(talks(t), 2024), config, AS_OF)
    return rows.select("object_id", F.round("popularity_score", 6).alias("popularity"))


@register("hero_call", "WIN-5", oracle=f"""
    SELECT object_id, popularity_score FROM (SELECT * FROM {{v_cfp}} WHERE cfp_end_date > {AS_OF} AND cfp_end_date < {AS_OF} + 14 * 86400 ORDER BY {RANK} LIMIT 10)
    ORDER BY popularity_score > 0 DESC, CASE WHEN popularity_score > 0 THEN popularity_score END DESC, cfp_end_date, object_id LIMIT 1""")
def _(t):
    return W.hero(cfps(t), AS_OF).select("object_id", "popularity_score")


@register("closing_summary", "WIN-11", oracle=f"""
    SELECT object_id, name, {DAYS} AS days FROM {{v_cfp}} ORDER BY COALESCE(NULLIF({DAYS}, 0), 999), object_id LIMIT 25""")
def _(t):
    return W.closing_summary(cfps(t), 25).select("object_id", "name", F.col("days_until_cfp_close").alias("days"))


@register("top_by_popularity", "WIN-15", oracle="""
    SELECT object_id, popularity_score FROM {v_cfp} WHERE seq % 3 <> 0 AND popularity_score <> 0 ORDER BY popularity_score DESC, object_id LIMIT 20""")
def _(t):
    return W.top_by_popularity(cfps(t), 20).select("object_id", "popularity_score")


NEAR = """
    SELECT object_id, ROUND(km, 6) AS km, CASE WHEN km < 100 THEN CAST(CAST(FLOOR(km + 0.5) AS BIGINT) AS VARCHAR) ELSE CAST(CAST(FLOOR(km / 10 + 0.5) * 10 AS BIGINT) AS VARCHAR) END || ' km' AS distance FROM (
      SELECT object_id, 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) AS km FROM (
        SELECT object_id, pow(sin(radians(lat - 52.37) / 2), 2) + cos(radians(52.37)) * cos(radians(lat)) * pow(sin(radians(lng - 4.89) / 2), 2) AS a
        FROM {v_cfp} WHERE lng IS NOT NULL)) ORDER BY km, object_id LIMIT 6"""


@register("near_me", "WIN-17", "FN-MTH-2", oracle=NEAR)
def _(t):
    return W.near_me(t.view("v_cfp"), 52.37, 4.89).select("object_id", F.round("km", 6).alias("km"), "distance")


@register("indexed_near_me", "WIN-17", oracle=NEAR)
def _(t):
    """The same places from a stored grid, of which the cells around the point are read."""
    path = new_path(t.spark, "places")
    P.write_place_index(t.view("v_cfp").select("object_id", "lat", "lng"), path)
    return P.nearest(t.spark, path, 52.37, 4.89).select("object_id", F.round("km", 6).alias("km"), "distance")


@register("best_thumbnails", "WIN-18", oracle="""
    SELECT object_id, CASE WHEN seq % 4 = 0 THEN 'direct' WHEN seq % 4 = 1 THEN 'big' || CAST(seq AS VARCHAR) WHEN seq % 4 = 2 THEN 'first' END AS thumbnail FROM {v_cfp}""")
def _(t):
    rows = t.sql("""SELECT object_id, CASE WHEN seq % 4 = 0 THEN 'direct' WHEN seq % 4 = 1 THEN '' END AS direct,
        CASE seq % 4 WHEN 1 THEN array(named_struct('url', 'small', 'height', 90), named_struct('url', 'big' || CAST(seq AS STRING), 'height', 720), named_struct('url', '', 'height', 1080))
          WHEN 2 THEN array(named_struct('url', 'first', 'height', CAST(NULL AS INT)), named_struct('url', 'second', 'height', 0)) END AS thumbs FROM {v_cfp}""")
    return rows.select("object_id", W.best_thumbnail(F.col("direct"), F.col("thumbs")).alias("thumbnail"))


# ---- lookups and joins --------------------------------------------------------------------------
@register("items_by_ids", "JN-8", oracle="""
    SELECT object_id, CASE object_id WHEN 77 THEN CAST(1 AS BIGINT) WHEN 3 THEN 2 WHEN 1500 THEN 4 ELSE 5 END AS pos, name
    FROM {v_cfp} WHERE object_id IN (77, 3, 1500, 12)""")
def _(t):
    return J.get_by_ids(t.view("v_cfp"), [77, 3, -5, 1500, 12, 40], 5).select("object_id", "pos", "name")


@register("city_images", "JN-9", oracle="""
    SELECT object_id, c.city, urls, thumbs FROM {v_cfp} c JOIN (
      SELECT 'CITY_' || CAST(n_nationkey AS VARCHAR) AS city, 'u' || n_name || ',v' || n_name AS urls, 't1,t2' AS thumbs FROM {nation}) i ON i.city = c.city WHERE seq % 6 <> 0""")
def _(t):
    images = t.sql("""SELECT 'CITY_' || CAST(n_nationkey AS STRING) AS city, 2 AS pos, 'v' || n_name AS url, 't2' AS thumb FROM {nation}
        UNION ALL SELECT 'CITY_' || CAST(n_nationkey AS STRING), 1, 'u' || n_name, 't1' FROM {nation}""")
    rows = t.view("v_cfp").withColumn("has_images", F.col("seq") % 6 == 0)
    out = J.city_images(rows, images)
    return out.select("object_id", "city", F.array_join("city_image_urls", ",").alias("urls"), F.array_join("city_image_thumbs", ",").alias("thumbs"))


# the brands of a part type are its sub-topics: a taxonomy read from the tables
TAXONOMY = "SELECT DISTINCT LOWER(p_brand) AS tag, LOWER(p_type) AS category FROM {part} WHERE p_size > 45"


@register("tag_categories", "JN-13", "FN-ARR-1", oracle=f"""
    SELECT DISTINCT object_id, COALESCE(category, CASE WHEN tag = 'economy' THEN tag END) AS category FROM (
      SELECT object_id, lower(topic_b) AS tag FROM {{v_cfp}} UNION ALL SELECT object_id, lower(topic_a) FROM {{v_cfp}}) LEFT JOIN ({TAXONOMY}) USING (tag)
    WHERE COALESCE(category, CASE WHEN tag = 'economy' THEN tag END) IS NOT NULL""")
def _(t):
    items = t.view("v_cfp").select("object_id", F.array(F.concat(F.lit(" "), "topic_b"), F.col("topic_a"), F.lit("")).alias("tags"))
    return J.tag_category_lookup(items, t.sql(TAXONOMY), ["economy"])


@register("normalized_topics", "FN-ARR-1", oracle=f"""
    SELECT object_id, topic_b || ',' || topic_a AS topics, COALESCE(cats, '') AS categories FROM {{v_cfp}} LEFT JOIN (
      SELECT object_id, string_agg(category, ',' ORDER BY category) AS cats FROM (
        SELECT DISTINCT object_id, category FROM (SELECT object_id, lower(topic_b) AS tag FROM {{v_cfp}} UNION ALL SELECT object_id, lower(topic_a) FROM {{v_cfp}}) JOIN ({TAXONOMY}) USING (tag))
      GROUP BY object_id) USING (object_id)""")
def _(t):
    from rostrum.functions.arrays import clean_tags

    rows = t.view("v_cfp").select("object_id", clean_tags(F.array(F.concat(F.lit(" "), "topic_b"), F.col("topic_a"), F.lit(" "))).alias("topics"))
    out = jobs.with_categories(rows, t.sql(TAXONOMY))
    return out.select("object_id", F.array_join("topics", ",").alias("topics"), F.array_join("topics_normalized", ",").alias("categories"))


# ---- sinks --------------------------------------------------------------------------------------
STORED = "SELECT object_id, name, source, popularity_score FROM {v_cfp} WHERE seq % 3 <> 0"
INCOMING = "SELECT object_id, 'new ' || name AS name, source, popularity_score + 1 AS popularity_score FROM {v_cfp} WHERE seq % 4 = 0"
UPSERTED = f"SELECT * FROM ({INCOMING}) UNION ALL SELECT * FROM ({STORED}) WHERE object_id NOT IN (SELECT object_id FROM ({INCOMING}))"


@register("upserted_rows", "SNK-1", oracle=UPSERTED)
def _(t):
    return S.upsert(t.sql(STORED), t.sql(INCOMING), "object_id")


@register("upserted_table", "SNK-1", oracle=UPSERTED)
def _(t):
    path = new_path(t.spark, "calls")
    T.write_snapshot(t.sql(STORED), path, "object_id")
    T.upsert_snapshot(t.spark, path, t.sql(INCOMING), "object_id")
    return T.read_snapshot(t.spark, path)


@register("partially_updated_table", "SNK-2", oracle=f"""
    SELECT s.object_id, COALESCE(i.name, s.name) AS name, s.source, s.popularity_score FROM ({STORED}) s LEFT JOIN ({INCOMING}) i USING (object_id)""")
def _(t):
    path = new_path(t.spark, "calls")
    T.write_snapshot(t.sql(STORED), path, "object_id")
    T.update_snapshot(t.spark, path, t.sql(INCOMING), "object_id", ["name"])
    return T.read_snapshot(t.spark, path)


@register("cleared_table", "SNK-5", oracle="SELECT COUNT(*) AS before, CAST(0 AS BIGINT) AS after FROM {v_cfp}")
def _(t):
    path = new_path(t.spark, "calls")
    T.write_snapshot(t.view("v_cfp"), path, "object_id")
    before = T.count_snapshot(t.spark, path).select(F.col("records").alias("before"))
    T.clear_snapshot(t.spark, path)
    after = T.read_snapshot(t.spark, path).agg(F.count("*").alias("after"))
    return I.side_by_side(before.withColumn("total", F.lit(0)), after)


@register("index_records", "SNK-3", "FN-ARR-4", oracle="""
    SELECT object_id, '{"objectID":' || CAST(object_id AS VARCHAR) || ',"name":"' || name || '"' ||
        CASE WHEN description IS NOT NULL THEN ',"description":"' || description || '"' ELSE '' END || ',"cfpUrl":"' || cfp_url || '","cfpEndDate":' || CAST(cfp_end_date AS VARCHAR)
        || ',"topics":["' || topic_a || '","' || topic_b || '"]' || CASE WHEN audience_level IS NOT NULL THEN ',"audienceLevel":"' || audience_level || '"' ELSE '' END
        || ',"eventFormat":"' || event_format || '","popularityScore":' || CAST(popularity_score AS VARCHAR) || ',"hnStories":' || CAST(hn_stories AS VARCHAR)
        || ',"hnPoints":' || CAST(hn_points AS VARCHAR) || ',"hnStoryTitles":[' || titles || ']'
        || ',"githubRepos":' || CAST(github_repos AS VARCHAR) || ',"githubStars":' || CAST(github_stars AS VARCHAR) || ',"redditPosts":' || CAST(reddit_posts AS VARCHAR)
        || ',"source":"' || source || '","enriched":' || CASE WHEN seq % 4 = 0 THEN 'true' ELSE 'false' END || ',"intelEnriched":' || CASE WHEN seq % 3 <> 0 THEN 'true' ELSE 'false' END || '}' AS record
    FROM (SELECT *, array_to_string(list_transform(range(1, 11), lambda i: '"t' || CAST(i AS VARCHAR) || '"'), ',') AS titles FROM {v_cfp})""")
def _(t):
    titles = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("t"), i.cast("string")))
    rows = cfps(t).withColumns({"hn_story_titles": titles, "hn_comments": F.array().cast("array<string>"), "url": F.lit("")})
    return S.to_index_record(rows)

