"""Discovery graph queries over the talk proxy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.catalog.registry import Tables, register
from rostrum.catalog.speakers import SLUG, talks
from rostrum.operators import aggregates as A
from rostrum.operators import dedup as D
from rostrum.operators import graph as G
from rostrum.plans.storage import new_path
from rostrum.sources import sinks as S

NAMED = f"SELECT *, TRIM(regexp_replace(lower(speaker), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM {{v_talk}}"
EDGES = f"""SELECT DISTINCT kind, src, dst FROM (
    SELECT UNNEST(['talk_conference', 'talk_speaker', 'speaker_conference', 'conference_speaker']) AS kind, UNNEST([object_id, object_id, slug, CAST(conference_id AS VARCHAR)]) AS src,
           UNNEST([CAST(conference_id AS VARCHAR), slug, CAST(conference_id AS VARCHAR), slug]) AS dst FROM ({NAMED}))"""


def edges(t: Tables) -> DataFrame:
    return G.build_edges(t.view("v_talk"))


@register("graph_edges", "GR-3", oracle=EDGES)
def _(t):
    return edges(t)


@register("conference_speakers", "JN-7", oracle=f"SELECT dst AS slug FROM ({EDGES}) WHERE kind = 'conference_speaker' AND src = '7'")
def _(t):
    return G.speakers_of_conference(edges(t), 7)


@register("speaker_conference_list", "JN-7", oracle=f"SELECT dst AS conference_id FROM ({EDGES}) WHERE kind = 'speaker_conference' AND src = 'customer-000000007'")
def _(t):
    return G.conferences_of_speaker(edges(t), "customer-000000007")


@register("speaker_talks_by_slug", "JN-7", oracle=f"SELECT object_id FROM ({NAMED}) WHERE slug = 'customer-000000007'")
def _(t):
    return G.talks_of_speaker(t.view("v_talk"), "customer-000000007").select("object_id")


@register("related_conferences", "JN-7", oracle=f"""
    WITH e AS (SELECT DISTINCT slug, CAST(conference_id AS VARCHAR) AS c FROM ({NAMED}))
    SELECT c AS conference_id, COUNT(*) AS shared_speakers FROM e WHERE c <> '7' AND slug IN (SELECT slug FROM e WHERE c = '7') GROUP BY c""")
def _(t):
    return G.related_conferences(edges(t), 7)


@register("co_speakers", "JN-7", oracle=f"""
    WITH p AS (SELECT DISTINCT object_id, {SLUG} AS slug FROM {{v_appearance}})
    SELECT slug, COUNT(*) AS talks FROM p WHERE slug <> 'customer-000000008' AND object_id IN (SELECT object_id FROM p WHERE slug = 'customer-000000008') GROUP BY slug""")
def _(t):
    return G.co_speakers(A.speaker_appearances(talks(t)), "customer-000000008")


@register("graph_summary", "AGG-28", oracle=f"""
    SELECT kind AS part, COUNT(*) AS n FROM ({EDGES}) WHERE kind IN ('speaker_conference', 'conference_speaker') GROUP BY kind
    UNION ALL SELECT 'talks', COUNT(*) FROM {{v_talk}} UNION ALL SELECT 'speakers', COUNT(DISTINCT slug) FROM ({NAMED}) UNION ALL SELECT 'conferences', COUNT(DISTINCT conference_id) FROM {{v_talk}}""")
def _(t):
    rows = edges(t)
    speakers = rows.filter("kind = 'talk_speaker'").select("dst").distinct()
    return G.graph_summary(t.view("v_talk").select("conference_id").distinct(), speakers, t.view("v_talk"), rows)


# ---- nodes --------------------------------------------------------------------------------------
@register("merged_conference_nodes", "DUP-6", oracle="""
    SELECT CAST(conference_id AS VARCHAR) AS conference_id, arg_min(conference_name, talk_id) AS name, MAX(duration_seconds) AS talk_count, arg_min('url' || CAST(talk_id AS VARCHAR), talk_id) FILTER (talk_id % 3 = 1) AS channel_url
    FROM {v_talk} GROUP BY 1""")
def _(t):
    nodes = t.view("v_talk").select(
        F.col("conference_id").cast("string").alias("conference_id"), F.col("conference_name").alias("name"), F.col("duration_seconds").alias("talk_count"), F.col("talk_id").alias("seq"),
        F.when(F.col("talk_id") % 3 == 1, F.concat(F.lit("url"), F.col("talk_id").cast("string"))).otherwise(F.lit("")).alias("channel_url"))
    return D.merge_conference_nodes(nodes)


def speaker_nodes(t: Tables) -> DataFrame:
    from rostrum.functions.text import slugify

    return t.view("v_talk").select(
        slugify(F.col("speaker")).alias("slug"), F.col("speaker").alias("name"), F.col("duration_seconds").alias("talk_count"), F.col("view_count").alias("total_views"),
        F.col("talk_id").alias("seq"), F.array("conference_name", "channel").alias("conferences"))


@register("merged_speaker_nodes", "DUP-6", oracle=f"SELECT slug, MIN(speaker) AS name, MAX(duration_seconds) AS talk_count, MAX(view_count) AS total_views FROM ({NAMED}) GROUP BY slug")
def _(t):
    return D.merge_speaker_nodes(speaker_nodes(t))


@register("speaker_node_conferences", "DUP-6", oracle=f"""
    SELECT slug, conference, MIN(seq) AS seq, CASE WHEN conference LIKE 'CH%' THEN 1 ELSE 0 END AS pos FROM (
      SELECT slug, talk_id AS seq, UNNEST([conference_name, channel]) AS conference FROM ({NAMED})) GROUP BY slug, conference""")
def _(t):
    return D.speaker_node_conferences(speaker_nodes(t))


@register("explore_channels", "SNK-6", "AGG-18", oracle="""
    SELECT channel, talk_count, speaker_count, sample_speakers FROM (SELECT channel, COUNT(*) AS talk_count, COUNT(DISTINCT speaker) AS speaker_count FROM {v_talk} GROUP BY 1 ORDER BY talk_count DESC, channel LIMIT 5)
    JOIN (SELECT channel, string_agg(speaker, ',' ORDER BY r) AS sample_speakers FROM (SELECT channel, speaker, ROW_NUMBER() OVER (PARTITION BY channel ORDER BY f, speaker) AS r FROM (
      SELECT channel, speaker, MIN(talk_id) AS f FROM {v_talk} GROUP BY 1, 2)) WHERE r <= 5 GROUP BY channel) USING (channel)""")
def _(t):
    rows = t.view("v_talk")
    path = new_path(t.spark, "explore")
    S.explore_channels(A.channel_profiles(rows), A.channel_speakers(rows), 5).write.json(path)
    back = t.spark.read.schema("channel STRING, talk_count BIGINT, speaker_count BIGINT, sample_speakers ARRAY<STRING>").json(path)
    return back.withColumn("sample_speakers", F.array_join("sample_speakers", ","))


@register("explore_speakers", "SNK-6", "WIN-10", oracle=f"""
    SELECT slug, talk_count, channel_count, channels FROM (SELECT slug, COUNT(*) AS talk_count FROM ({NAMED}) GROUP BY 1 ORDER BY talk_count DESC, slug LIMIT 50)
    JOIN (SELECT slug, COUNT(*) AS channel_count, string_agg(channel, ',' ORDER BY f) AS channels FROM (SELECT slug, channel, MIN(talk_id) AS f FROM ({NAMED}) GROUP BY 1, 2) GROUP BY slug) USING (slug)""")
def _(t):
    from rostrum.functions.text import slugify

    rows = t.view("v_talk").withColumn("slug", slugify(F.col("speaker")))
    nodes = rows.groupBy("slug").agg(F.count("*").alias("talk_count"))
    channels = rows.groupBy("slug", "channel").agg(F.min("talk_id").alias("first_talk"))
    out = S.explore_speakers(nodes, channels, 50)
    return out.select("slug", "talk_count", "channel_count", F.array_join("channels", ",").alias("channels"))


@register("reloaded_graph", "SNK-7", oracle=f"""
    SELECT 'edges ' || kind AS part, COUNT(*) AS n FROM ({EDGES}) GROUP BY 1 UNION ALL SELECT 'speakers', COUNT(DISTINCT slug) FROM ({NAMED})
    UNION ALL SELECT 'frontier', COUNT(DISTINCT slug) FROM ({NAMED}) WHERE CAST(substr(slug, -1) AS INT) % 2 = 0""")
def _(t):
    path = new_path(t.spark, "graph")
    nodes = D.merge_speaker_nodes(speaker_nodes(t))
    seed = F.when(F.substring("slug", -1, 1).cast("int") % 2 == 0, F.lit("seed")).otherwise(F.lit("speaker_search"))
    S.save_graph(path, {"speakers": nodes.withColumn("source", seed)}, edges(t))
    saved, linked, frontier = S.load_graph(t.spark, path, ["speakers"])
    counted = linked.groupBy(F.concat(F.lit("edges "), "kind").alias("part")).agg(F.count("*").alias("n"))
    for name, rows in (("speakers", saved["speakers"]), ("frontier", frontier)):
        counted = counted.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n"))
    return counted


# ---- discovery ----------------------------------------------------------------------------------
def listed(t: Tables) -> DataFrame:
    """Talks as a search by person finds them; every fifth names the co-speaker instead."""
    return t.view("v_talk").select(
        "object_id", F.col("speaker").alias("listed_under"), F.coalesce("co_speaker", "speaker").alias("speaker"), "channel", "view_count", "year")


_HOP = "SELECT listed, other, object_id FROM (SELECT speaker AS listed, co_speaker AS other, object_id, ROW_NUMBER() OVER (PARTITION BY speaker ORDER BY view_count DESC, object_id) AS r FROM {v_talk}) WHERE r <= 30"


@register("discovered_speakers", "GR-1", oracle=f"""
    WITH RECURSIVE hop AS ({_HOP}), seeds AS (SELECT c_name AS name FROM {{customer}} WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000),
    walk AS (SELECT name FROM seeds UNION SELECT h.other FROM walk w JOIN hop h ON h.listed = w.name AND h.other IS NOT NULL AND h.other <> h.listed)
    SELECT TRIM(regexp_replace(lower(w.name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, COUNT(h.object_id) AS talk_count,
           CASE WHEN w.name IN (SELECT name FROM seeds) THEN 'seed' ELSE 'talk_extraction' END AS source
    FROM walk w LEFT JOIN hop h ON h.listed = w.name GROUP BY w.name""")
def _(t):
    """Breadth-first from the rich customers of one segment until nobody new is named."""
    seeds = t.sql("SELECT c_name AS name FROM {customer} WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000")
    found = G.bfs_discover(seeds, listed(t), max_speakers=10**9, max_talks=30)
    return found["speakers"].select("slug", "talk_count", "source")


@register("channel_newcomers", "GR-2", oracle="""
    WITH q AS (SELECT channel, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, channel) AS place FROM {v_talk} GROUP BY channel),
    f AS (SELECT * FROM (SELECT t.*, q.place, ROW_NUMBER() OVER (PARTITION BY t.channel ORDER BY view_count DESC, object_id) AS r FROM {v_talk} t JOIN q ON q.channel = t.channel) WHERE r <= 20)
    SELECT slug, talk_count, channel FROM (
      SELECT TRIM(regexp_replace(lower(speaker), '[^a-z0-9]+', '-', 'g'), '-') AS slug, COUNT(*) AS talk_count, arg_min(channel, place * 1000 + r) AS channel, MIN(place * 1000 + r) AS o FROM f
      WHERE speaker NOT IN (SELECT c_name FROM {customer} WHERE c_mktsegment = 'MACHINERY') GROUP BY 1) ORDER BY o LIMIT 60""")
def _(t):
    from rostrum.functions.text import slugify

    # the place in the queue is a sort key: no numbering of all channels in one task
    counts = t.view("v_talk").groupBy("channel").agg(F.count("*").alias("n"))
    queue = counts.select("channel", F.struct((-F.col("n")).alias("n"), "channel").alias("place"))
    known = t.sql("SELECT c_name AS name FROM {customer} WHERE c_mktsegment = 'MACHINERY'").select(slugify(F.col("name")).alias("slug"))
    return G.speakers_from_channels(queue, t.view("v_talk"), known, 60).select("slug", "talk_count", "channel")
