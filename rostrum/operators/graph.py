"""Discovery graph: edges, neighbours, breadth-first expansion and channel exploration."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import slugify
from rostrum.operators.filters import is_valid_speaker
from rostrum.plans.skew import first_per_key, top_k, top_k_per_key
from rostrum.plans.storage import cut_lineage


def build_edges(talks: DataFrame) -> DataFrame:
    """Distinct ``(kind, src, dst)`` edges; speakers are named by slug everywhere."""
    slug = F.when(F.col("speaker") != "", slugify(F.col("speaker")))
    conf, talk = F.col("conference_id").cast("string"), F.col("object_id")

    def edge(kind: str, src, dst):
        found = src.isNotNull() & dst.isNotNull()
        return F.when(found, F.struct(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst")))

    edges = F.array_compact(F.array(
        edge("talk_conference", talk, conf), edge("talk_speaker", talk, slug),
        edge("speaker_conference", slug, conf), edge("conference_speaker", conf, slug),
    ))
    return talks.select(F.inline(edges)).distinct()


def speakers_of_conference(edges: DataFrame, conference_id) -> DataFrame:
    return edges.filter((F.col("kind") == "conference_speaker") & (F.col("src") == str(conference_id))).select(F.col("dst").alias("slug"))


def conferences_of_speaker(edges: DataFrame, slug: str) -> DataFrame:
    return edges.filter((F.col("kind") == "speaker_conference") & (F.col("src") == slug)).select(F.col("dst").alias("conference_id"))


def talks_of_speaker(talks: DataFrame, slug: str) -> DataFrame:
    return talks.filter(slugify(F.col("speaker")) == slug)


def related_conferences(edges: DataFrame, conference_id) -> DataFrame:
    """Conferences that share speakers with one conference and how many; built from that conference outwards."""
    spoken = edges.filter("kind = 'speaker_conference'")
    own = speakers_of_conference(edges, conference_id).select(F.col("slug").alias("src"))
    others = spoken.filter(F.col("dst") != str(conference_id)).join(own, "src", "left_semi")
    return others.groupBy(F.col("dst").alias("conference_id")).agg(F.count("*").alias("shared_speakers"))


def co_speakers(appearances: DataFrame, slug: str) -> DataFrame:
    """People on the same talks as one speaker and on how many."""
    pairs = appearances.select("object_id", "slug").distinct()
    own = pairs.filter(F.col("slug") == slug).select("object_id")
    others = pairs.filter(F.col("slug") != slug).join(own, "object_id", "left_semi")
    return others.groupBy("slug").agg(F.count("*").alias("talks"))


def graph_summary(conferences: DataFrame, speakers: DataFrame, talks: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts as ``(part, n)`` rows."""
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        for name, df in (("conferences", conferences), ("speakers", speakers), ("talks", talks))
    ]
    counted = edges.filter(F.col("kind").isin("speaker_conference", "conference_speaker")).groupBy(F.col("kind").alias("part"))
    out = counted.agg(F.count("*").alias("n"))
    for part in parts:
        out = out.unionByName(part)
    return out


def bfs_discover(seeds: DataFrame, talks: DataFrame, max_speakers: int = 50, max_talks: int = 30) -> dict[str, DataFrame]:
    """Expand from seed speakers over their talks to the other people named on them.

    ``seeds``: ``name``; ``talks``: ``object_id, title, speaker, channel, view_count, year`` and
    ``listed_under`` (the person a search finds the talk for). Each level takes the ``max_talks`` most
    viewed talks of every speaker of the frontier, keeps talks not seen before, and queues the valid,
    unseen names on talks with a known channel. Speakers are expanded in (level, slug) order until
    ``max_speakers`` have been or nobody is left. Returns ``speakers``, ``talks`` and ``channels``.

    The talks of each person are ranked and cut once, before the loop, and written once as well as distinct links between
    people. A level reads these links only: it joins them with its frontier and takes out whom earlier levels found. Who
    is reached does not depend on who a talk of several people belongs to, as the first of them has queued its speaker
    already; talks are given to their first owner in (level, slug) order once, after the loop.
    """
    views = F.coalesce("view_count", F.lit(0))
    owned = talks.withColumn("owner", slugify(F.col("listed_under")))
    owned = top_k_per_key(owned, ["owner"], [views.desc(), F.col("object_id")], max_talks).drop("rank")
    known_channel = (F.col("channel") != "") & (F.col("channel") != "Unknown")
    usable = known_channel & is_valid_speaker(F.col("speaker"))
    found = cut_lineage(owned.withColumn("named_slug", F.when(usable, slugify(F.col("speaker")))))
    links = found.filter(F.col("named_slug") != F.col("owner")).groupBy("owner", F.col("named_slug").alias("slug")).agg(F.min("speaker").alias("name"))
    links = cut_lineage(links)
    named = seeds.filter(F.trim("name") != "").select(F.trim("name").alias("name")).withColumn("slug", slugify(F.col("name")))
    frontier = cut_lineage(
        named.groupBy("slug").agg(F.min("name").alias("name")).withColumns({"level": F.lit(0), "source": F.lit("seed")})
    )
    speakers, batches, expanded = [frontier], [], 0
    for level in count():
        room, waiting = max_speakers - expanded, frontier.count()
        if waiting == 0:
            break
        # cut only when the frontier is larger than what may still be expanded
        batch = frontier if waiting <= room else cut_lineage(frontier.orderBy("slug").limit(room))
        expanded += min(waiting, room)
        batches = _parts([*batches, batch.select(F.col("slug").alias("owner"), "level")])
        fresh = links.join(batch.select(F.col("slug").alias("owner")), "owner").groupBy("slug").agg(F.min("name").alias("name"))
        for part in speakers:
            fresh = fresh.join(part.select("slug"), "slug", "left_anti")
        fresh = cut_lineage(fresh.select("slug", "name", F.lit(level + 1).alias("level"), F.lit("talk_extraction").alias("source")))
        speakers = _parts([*speakers, fresh])
        if expanded >= max_speakers:
            break
        frontier = fresh
    people = reduce(DataFrame.unionByName, speakers)
    if not batches:
        batches = [people.select(F.col("slug").alias("owner"), "level").limit(0)]
    reached = reduce(DataFrame.unionByName, batches)
    own = found.join(reached, "owner").join(people.select(F.col("slug").alias("owner"), F.col("name").alias("found_by")), "owner")
    # a talk of several people belongs to the first
    own = first_per_key(own, ["object_id"], ["level", "owner"])
    return _discovered(people, cut_lineage(own))


def _parts(parts: list[DataFrame], most: int = 6) -> list[DataFrame]:
    """Merge the parts into one checkpointed table once there are more than ``most``, in as many tasks as its size asks for."""
    return [cut_lineage(reduce(DataFrame.unionByName, parts).hint("rebalance"))] if len(parts) > most else parts


def _discovered(speakers: DataFrame, talks: DataFrame) -> dict[str, DataFrame]:
    views = F.coalesce("view_count", F.lit(0)).cast("bigint")
    per_speaker = talks.groupBy(F.col("owner").alias("slug")).agg(F.count("*").alias("talk_count"), F.sum(views).alias("total_views"))
    known = talks.filter((F.col("channel") != "") & (F.col("channel") != "Unknown"))
    per_owner = known.groupBy("channel", "owner").agg(F.count("*").alias("n"), F.sum(views).alias("views"))
    channels = per_owner.groupBy("channel").agg(
        F.sum("n").alias("talk_count"), F.sum("views").alias("total_views"), F.count("*").alias("speaker_count")
    )
    nodes = speakers.join(per_speaker, "slug", "left").fillna(0, ["talk_count", "total_views"])
    return {"speakers": nodes, "talks": talks, "channels": channels}


def speakers_from_channels(channels: DataFrame, talks: DataFrame, known: DataFrame, k: int = 100, per_channel: int = 20) -> DataFrame:
    """Unseen speakers on the first talks of discovered channels, with talk count and first channel.

    ``channels``: ``channel, place`` (queue order). At most ``per_channel`` talks are read per channel and
    the first ``k`` people in queue order are returned.
    """
    listed = talks.filter("speaker <> ''").join(channels.select("channel", "place"), "channel")
    first = top_k_per_key(listed, ["channel"], [F.coalesce("view_count", F.lit(0)).desc(), F.col("object_id")], per_channel)
    people = first.withColumn("slug", slugify(F.col("speaker"))).join(known.select("slug"), "slug", "left_anti")
    entry = F.struct("place", F.col("rank"), "channel", "speaker")
    found = people.groupBy("slug").agg(F.count("*").alias("talk_count"), F.min(entry).alias("e"))
    rows = found.select("slug", F.col("e.speaker").alias("name"), F.col("e.channel").alias("channel"), "talk_count", F.col("e.place").alias("place"), F.col("e.rank").alias("found_at"))
    return top_k(rows, [F.col("place"), F.col("found_at"), F.col("slug")], k)
