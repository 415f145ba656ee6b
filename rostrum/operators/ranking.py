"""Match scores, keyword search and recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import contains_any, let
from rostrum.operators.windows import RANKINGS, order_of
from rostrum.plans.skew import top_k, top_k_per_key
from rostrum.plans.storage import cut_lineage, staged


def _has(text: Column, part: Column | str) -> Column:
    return F.contains(text, F.lit(part) if isinstance(part, str) else part)


def _js_round(value: Column) -> Column:
    """Half up, also below zero."""
    return F.floor(value + 0.5).cast("bigint")


@dataclass(frozen=True)
class Profile:
    """What one reader has said about themselves."""

    topics: Sequence[str] = ()
    experience_level: str = "intermediate"
    preferred_formats: Sequence[str] = ()
    interests: Sequence[str] = ()
    tech_stack: Sequence[str] = ()
    travel_wants: Sequence[str] = ()
    travel_avoids: Sequence[str] = ()
    speaking_experience: str | None = None
    interviewed: bool = field(default=False)


def match_score(profile: Profile, as_of: int | None = None, strict: bool = False) -> Column:
    """Struct ``(score, reasons)`` of a call for one profile, as one expression over the call columns.

    Columns used: ``topics, technologies`` (arrays), ``city, country, audience_level, event_format,
    hn_stories, github_stars, popularity_score, days_until_cfp_close``. A call without city or country
    matches any travel wish unless ``strict``.
    """
    if not profile.topics and not profile.tech_stack:
        reasons = F.array(F.lit("Set your interests for personalized matches"))
        return F.struct(F.lit(50).cast("bigint").alias("score"), reasons.alias("reasons"))

    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    topics = F.transform(F.coalesce("topics", empty), F.lower)
    tech = F.concat(topics, F.transform(F.coalesce("technologies", empty), F.lower))
    parts: list[Column] = [F.lit(30.0)]
    reasons: list[Column] = []

    wanted = [*profile.topics, *profile.interests]
    topic_hits = _hits(wanted, lambda w: F.exists(topics, lambda t: _has(t, w) | _has(F.lit(w), t)))
    n_topics = F.size(topic_hits)
    if wanted:
        parts.append(F.least(F.lit(30.0), n_topics / min(len(wanted), 5) * 30))
        reasons.append(F.when(n_topics > 0, F.concat(F.lit("Topics: "), F.array_join(F.slice(F.array_distinct(topic_hits), 1, 2), ", "))))

    if profile.tech_stack:
        tech_hits = _hits(profile.tech_stack, lambda w: F.exists(tech, lambda t: _has(t, w)))
        parts.append(F.least(F.lit(15), F.size(tech_hits) * 5))
        named = F.concat(F.lit("Tech: "), F.array_join(F.slice(tech_hits, 1, 2), ", "))
        reasons.append(F.when((F.size(tech_hits) > 0) & (n_topics == 0), named))

    city, country = (F.lower(F.coalesce(c, F.lit(""))) for c in ("city", "country"))

    def place_hit(places: Sequence[str], both_ways: bool) -> Column:
        hit = F.lit(False)
        for place in (p.lower() for p in places):
            hit = hit | _has(city, place) | _has(country, place)
            if both_ways:
                for have in (city, country):
                    within = _has(F.lit(place), have)
                    hit = hit | (within & (have != "") if strict else within)
        return hit

    if profile.travel_wants:
        wish = place_hit(profile.travel_wants, True)
        parts.append(F.when(wish, F.lit(10)).otherwise(F.lit(0)))
        reasons.append(F.when(wish, F.lit("Dream destination!")))
    if profile.travel_avoids:
        avoid = place_hit(profile.travel_avoids, False)
        parts.append(F.when(avoid, F.lit(-15)).otherwise(F.lit(0)))
        reasons.append(F.when(avoid, F.lit("Travel constraint")))
    if profile.speaking_experience == "none":
        easy = F.exists(topics, lambda t: _has(t, "beginner") | _has(t, "first"))
        parts.append(F.when(easy, F.lit(5)).otherwise(F.lit(0)))
        reasons.append(F.when(easy, F.lit("First-timer friendly")))

    level = F.lower(F.nullif("audience_level", F.lit("")))
    fits = {
        "beginner": _has(level, "beginner") | _has(level, "all"),
        "intermediate": ~_has(level, "expert"),
        "advanced": _has(level, "advanced") | _has(level, "expert"),
    }[profile.experience_level]
    parts.append(F.when(level.isNull(), F.lit(5)).when(fits, F.lit(10)).otherwise(F.lit(0)))
    reasons.append(F.when(fits, F.lit("Level fit")))

    if profile.preferred_formats:
        liked = F.col("event_format").isin(list(profile.preferred_formats))
        parts.append(F.when(liked, F.lit(5)).otherwise(F.lit(0)))
        reasons.append(F.when(liked, F.concat("event_format", F.lit(" event"))))

    hn, stars, popular = F.col("hn_stories") > 0, F.col("github_stars") > 100, F.col("popularity_score") > 50
    for flag, points in ((hn, 3), (stars, 3), (popular, 4)):
        parts.append(F.when(flag, F.lit(points)).otherwise(F.lit(0)))
    reasons += [F.when(hn, F.lit("Trending on HN")), F.when(stars, F.lit("GitHub buzz"))]
    reasons.append(F.when(F.col("days_until_cfp_close") <= 7, F.lit("Closing soon!")))

    total = parts[0]
    for part in parts[1:]:
        total = total + part
    score = _js_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    listed = F.slice(F.array_compact(F.array(*reasons, none)), 1, 3)
    return F.struct(score.alias("score"), listed.alias("reasons"))


def _hits(words: Sequence[str], test) -> Column:
    """The words that pass ``test`` (given lower-case), in order, in their own spelling."""
    return F.array_compact(F.array(*[F.when(test(w.lower()), F.lit(w)) for w in words]))


def quick_match(topics: Sequence[str], with_stars: bool = True) -> Column:
    """Short score of a call for a topic list; the variant without stars ignores repository stars."""
    if not topics:
        return F.lit(50).cast("bigint")
    own = F.transform("topics", F.lower)
    overlap = F.size(_hits(topics, lambda w: F.exists(own, lambda t: _has(t, w))))
    score = F.least(F.lit(100.0), F.lit(40) + overlap / len(topics) * 60)
    boosts = [F.col("hn_stories") > 0, F.col("popularity_score") > 50]
    if with_stars:
        boosts.append(F.col("github_stars") > 100)
    for flag in boosts:
        score = score + F.when(flag, F.lit(5)).otherwise(F.lit(0))
    return _js_round(F.least(F.lit(100.0), score))


def top_matches(cfps: DataFrame, profile: Profile, k: int, key: str = "object_id") -> DataFrame:
    """Best calls for one profile."""
    scored = cfps.withColumn("match", match_score(profile)).select("*", "match.score", "match.reasons").drop("match")
    return top_k(scored, [F.col("score").desc(), F.col(key)], k, "rank")


# ---- search -------------------------------------------------------------------------------------
# attributes in order of importance; attributes of one group weigh the same
SEARCHABLE = {
    "cfps": [("name",), ("description",), ("topics",), ("technologies",), ("city", "region", "country")],
    "talks": [("title",), ("speaker", "speakers"), ("conference_name",), ("description",), ("topics",), ("channel",)],
    "speakers": [("name",), ("aliases",), ("company",), ("topics",), ("conferences",)],
}


def _any_starts(tokens: Column, prefix: str) -> Column:
    return F.exists(tokens, lambda t: t.startswith(prefix))


def keyword_search(df: DataFrame, query: str, index: str, k: int = 4, key: str = "object_id") -> DataFrame:
    """Rows in which every query word occurs (the last one as a prefix), best attribute first.

    Matching is by lower-case words of the searchable attributes; ties follow the index ranking.
    """
    words = query.lower().split()
    types = dict(df.dtypes)
    groups = [g for g in ([c for c in g if c in types] for g in SEARCHABLE[index]) if g]

    def tokens(column: str) -> Column:
        text = F.array_join(column, " ") if types[column].startswith("array") else F.col(column)
        # looking for the letters of a query word is cheap; only where they stand is the text cut
        cut_words = lambda lowered: F.when(contains_any(lowered, words), F.split(lowered, r"(?U)[^\w]+")).otherwise(none)
        return let(F.lower(F.coalesce(text, F.lit(""))), cut_words)

    # the words of each attribute are cut once, whatever the number of query words
    none = F.array().cast("array<string>")
    cut = staged(df, __words=F.struct(*[tokens(c).alias(c) for g in groups for c in g]))
    positions = []
    for number, word in enumerate(words):
        place = F.lit(None).cast("int")
        for rank, group in reversed(list(enumerate(groups))):
            hit = F.lit(False)
            for column in group:
                own = F.col("__words").getField(column)
                hit = hit | (_any_starts(own, word) if number == len(words) - 1 else F.array_contains(own, word))
            place = F.when(hit, F.lit(rank)).otherwise(place)
        positions.append(place)
    cut = staged(cut, __places=F.array(*positions))
    matched = cut.withColumn("attribute", F.array_min("__places")).filter(~F.exists("__places", lambda p: p.isNull())).drop("__words", "__places")
    return top_k(matched, [F.col("attribute"), *order_of([r for r in RANKINGS[index] if r[0] in types], key)], k, "rank")


def multi_search(tables: Mapping[str, DataFrame], query: str, k: int = 4) -> DataFrame:
    """The first ``k`` hits of each index as ``(index, object_id, attribute, rank)``."""
    parts = [
        keyword_search(df, query, index, k).select(
            F.lit(index).alias("index"), F.col("object_id").cast("string").alias("object_id"), "attribute", "rank"
        )
        for index, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- recommendations ----------------------------------------------------------------------------
def recent(events: DataFrame, as_of, days: int) -> DataFrame:
    """Events of the last ``days`` days before ``as_of`` (epoch seconds)."""
    end = F.timestamp_seconds(F.lit(as_of))
    return events.filter((F.col("ts") <= end) & (F.col("ts") > end - F.expr(f"INTERVAL {int(days)} DAYS")))


def trending_items(events: DataFrame, as_of, days: int = 30, k: int = 10) -> DataFrame:
    """Most converted, then most seen objects of the recent window."""
    counted = recent(events, as_of, days).groupBy("object_id").agg(
        F.count_if(F.col("event_type") == "conversion").alias("conversions"), F.count("*").alias("events")
    )
    return top_k(counted, [F.col("conversions").desc(), F.col("events").desc(), F.col("object_id")], k)


def trending_facets(events: DataFrame, items: DataFrame, facet: str, as_of, days: int = 30, k: int = 10) -> DataFrame:
    """Values of an array facet by the events of their items.

    Events are counted per item before the join, so a hot item is one row there.
    """
    per_item = recent(events, as_of, days).groupBy("object_id").agg(F.count("*").alias("n"))
    rows = per_item.join(items.select("object_id", F.explode(F.array_distinct(facet)).alias("value")), "object_id")
    counted = rows.groupBy("value").agg(F.sum("n").alias("score"))
    return top_k(counted, [F.col("score").desc(), F.col("value")], k)


def watched_together(events: DataFrame, object_id, k: int = 10) -> DataFrame:
    """Objects seen by the users of one object, by number of common users.

    Only that object's users are kept (a semi-join of distinct pairs), so no pairs of items are built.
    """
    pairs = events.select("user_token", "object_id").distinct()
    users = pairs.filter(F.col("object_id") == object_id).select("user_token")
    others = pairs.filter(F.col("object_id") != object_id).join(users, "user_token", "left_semi")
    counted = others.groupBy("object_id").agg(F.count("*").alias("users"))
    return top_k(counted, [F.col("users").desc(), F.col("object_id")], k)


def related_items(items: DataFrame, object_id, k: int = 10) -> DataFrame:
    """Items by Jaccard similarity of their topic arrays to one item's topics.

    The topics of the one item reach every row as a one-row broadcast; all other rows are scored in
    place without a shuffle.
    """
    own = items.filter(F.col("object_id") == object_id).select(F.array_distinct("topics").alias("own")).limit(1)
    mine = F.array_distinct("topics")
    others = items.filter(F.col("object_id") != object_id)
    scored = others.join(F.broadcast(own), F.arrays_overlap(F.col("topics"), F.col("own")))
    shared = F.size(F.array_intersect(mine, F.col("own")))
    score = shared / (F.size(mine) + F.size("own") - shared)
    return top_k(scored.select("object_id", score.alias("score")), [F.col("score").desc(), F.col("object_id")], k)


# least similarities of the rounds; in the last one any common topic will do
RELATED_ROUNDS = (0.8, 0.5, 0.3, 0.0)


def _topic_prefixes(sets: DataFrame, least: float, side: str) -> DataFrame:
    """The topics by which a set can meet sets of similarity ``least`` or more: its rarest ones, as many as these leave room for."""
    kept = F.size("topics") - F.ceil(F.round(F.size("topics") * least, 9)).cast("int") + 1 if least else F.size("topics")
    first = F.explode(F.slice("topics", F.lit(1), F.least(kept, F.size("topics"))))
    return sets.select(F.col("face").alias(side), F.col("topics").alias(f"topics_{side}"), first.alias("topic"))


def related_for_all(items: DataFrame, k: int = 10, key: str = "object_id", topics: str = "topics") -> DataFrame:
    """For every item the ``k`` others most alike by Jaccard similarity of their topics, ties to the smaller key: key, related, score, rank.

    Items with the same topics are one face, which carries its ``k + 1`` smallest keys; similarities are those of
    faces. Faces meet on their rarest topics in rounds of falling similarity (prefix and length filter), and a face
    leaves once ``k`` other items are at least as similar as the round asks, so common topics bring only those
    together that have too few better partners. Without a common topic there is no row; null and repeated topics
    don't count, null keys are left out.
    """
    clean = items.select(F.col(key).alias("key"), F.array_distinct(F.array_compact(topics)).alias("own")).filter(F.col("key").isNotNull() & (F.size("own") > 0))
    clean = cut_lineage(clean.withColumn("own", F.sort_array("own")))
    counts = clean.groupBy("own").agg(F.count(F.lit(1)).alias("n"))
    faces = counts.withColumn("face", F.monotonically_increasing_id())
    faces = cut_lineage(faces)
    often = faces.select(F.explode("own").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("often"))
    spelt = faces.select("face", F.explode("own").alias("topic")).join(often, "topic")
    sets = spelt.groupBy("face").agg(F.transform(F.sort_array(F.collect_list(F.struct("often", "topic"))), lambda e: e["topic"]).alias("topics"))  # bounded by an item's topics
    sets = cut_lineage(sets)
    members = faces.select("face", "n")
    waiting, found = sets, None
    for least in RELATED_ROUNDS:
        met = _topic_prefixes(waiting, least, "a").join(_topic_prefixes(sets, least, "b"), "topic")
        if least:
            met = met.filter((F.size("topics_b") >= F.size("topics_a") * least - 1e-9) & (F.size("topics_a") >= F.size("topics_b") * least - 1e-9))
        common = F.size(F.array_intersect("topics_a", "topics_b"))
        pairs = met.select("a", "b", (common / (F.size("topics_a") + F.size("topics_b") - common)).alias("score")).filter(F.col("score") >= least - 1e-9).distinct()
        pairs = cut_lineage(pairs)
        enough = pairs.join(members.withColumnRenamed("face", "b"), "b").groupBy(F.col("a").alias("face")).agg(F.sum("n").alias("reached")).filter(F.col("reached") > k)
        done = cut_lineage(waiting.select("face").join(enough, "face", "left_semi" if least else "left").select("face"))
        some = pairs.join(done.withColumnRenamed("face", "a"), "a", "left_semi")
        found = some if found is None else found.union(some)
        waiting = cut_lineage(waiting.join(done, "face", "left_anti"))
        if waiting.isEmpty():
            break
    first = top_k_per_key(clean.join(faces.select("own", "face"), "own").select("face", "key"), ["face"], [F.col("key")], k + 1)
    lists = found.join(first.select(F.col("face").alias("b"), F.col("key").alias("related")), "b")
    lists = top_k_per_key(lists, ["a"], [F.col("score").desc(), F.col("related")], k + 1).select(F.col("a").alias("face"), "related", "score")
    own = clean.join(faces.select("own", "face"), "own").select("key", "face")
    others = own.join(lists, "face").filter(F.col("related") != F.col("key"))
    return top_k_per_key(others, ["key"], [F.col("score").desc(), F.col("related")], k).select(F.col("key").alias(key), "related", "score", "rank")


EVENT_NAMES = {
    ("click", "cfp"): "CFP Clicked", ("click", "talk"): "Talk Clicked",
    ("conversion", "cfp"): "CFP Submission Started", ("conversion", "talk"): "Talk Video Opened",
}


def event_log(actions: DataFrame) -> DataFrame:
    """Normalise user actions to one event row per object.

    ``actions``: ``user_token, ts, action, kind, carousel, object_ids, position, query_id``. A view lists
    at most 20 objects; a click after a search defaults to position 1.
    """
    view = F.col("action") == "view"
    carousel = F.coalesce("carousel", F.lit(""))
    talks = F.when(view, _has(carousel, "talk") | _has(carousel, "viral")).otherwise(F.col("kind") == "talk")
    name = F.when(view, F.concat(F.lit("Carousel Viewed: "), carousel))
    for (action, kind), text in EVENT_NAMES.items():
        name = name.when((F.col("action") == action) & (F.col("kind") == kind), F.lit(text))
    searched = (F.col("action") == "click") & F.col("query_id").isNotNull()
    ids = F.when(view, F.slice("object_ids", 1, 20)).otherwise(F.slice("object_ids", 1, 1))
    return actions.select(
        "user_token", "ts", F.col("action").alias("event_type"), name.alias("event_name"),
        F.when(talks, F.lit("talks")).otherwise(F.lit("cfps")).alias("index"),
        F.when(searched, F.coalesce("position", F.lit(1))).alias("position"), "query_id",
        F.explode(ids).alias("object_id"),
    )
