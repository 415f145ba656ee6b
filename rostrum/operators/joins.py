"""Joins. Small sides are not hinted: Catalyst and AQE broadcast them when their size allows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.fuzzy import block_ratio, name_tokens, normal_form, part_score
from rostrum.functions.text import blank_to_null, clean_name, or_else, slugify, strip
from rostrum.operators.filters import is_noise_title, name_variants
from rostrum.plans.storage import cut_lineage
from rostrum.plans.skew import first_per_key, top_k, top_k_per_key


def matched(column: str) -> Column:
    return F.col(column).isNotNull()


# ---- enrichment cache and intel -----------------------------------------------------------------
CACHE_COLUMNS = (
    "description", "topics_normalized", "languages", "audience_level", "event_format", "talk_types",
    "industries", "technologies",
)


def apply_cache(cfps: DataFrame, cache: DataFrame, columns: Sequence[str] = CACHE_COLUMNS) -> DataFrame:
    """Overwrite ``columns`` of calls found in the cache, also with NULL, and flag them enriched."""
    known = [c for c in columns if c in cache.columns]
    values = cache.select("object_id", F.struct(*known).alias("__cached"))
    joined = cfps.join(values, "object_id", "left")
    hit = matched("__cached")
    for name in known:
        old = F.col(name) if name in cfps.columns else F.lit(None)
        joined = joined.withColumn(name, F.when(hit, F.col(f"__cached.{name}")).otherwise(old))
    flag = F.col("enriched") if "enriched" in cfps.columns else F.lit(False)
    return joined.withColumn("enriched", F.when(hit, F.lit(True)).otherwise(flag)).drop("__cached")


INTEL_CAPS = {
    "hn_story_titles": 10, "hn_comments": 20, "github_languages": 10, "github_topics": 20,
    "github_descriptions": 10, "reddit_subreddits": 10, "reddit_titles": 10, "reddit_comments": 20,
    "devto_tags": 15, "devto_titles": 10, "intel_topics": 30, "intel_urls": 20,
}
INTEL_NUMBERS = (
    "popularity_score", "hn_stories", "hn_points", "github_repos", "github_stars", "reddit_posts",
    "devto_articles",
)


def apply_intel(cfps: DataFrame, intel: DataFrame, key: str = "name") -> DataFrame:
    """Copy community figures to the calls of the same name, lists cut to their caps, and flag them."""
    have = [c for c in (*INTEL_NUMBERS, *INTEL_CAPS) if c in intel.columns]
    joined = cfps.join(intel.select(key, F.struct(*have).alias("__intel")), key, "left")
    hit = matched("__intel")
    for name in have:
        new = F.col(f"__intel.{name}")
        if name in INTEL_CAPS:
            new = F.slice(F.filter(new, lambda v: v.isNotNull()), 1, INTEL_CAPS[name])
        old = F.col(name) if name in cfps.columns else F.lit(None)
        joined = joined.withColumn(name, F.when(hit, new).otherwise(old))
    flag = F.col("intel_enriched") if "intel_enriched" in cfps.columns else F.lit(False)
    return joined.withColumn("intel_enriched", F.when(hit, F.lit(True)).otherwise(flag)).drop("__intel")


# ---- existence ----------------------------------------------------------------------------------
def skip_existing(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``existing`` yet."""
    return new.join(existing.select(key), key, "left_anti")


def skip_existing_videos(videos: DataFrame, indexed: DataFrame) -> DataFrame:
    """Videos whose ``yt_`` object is not indexed yet."""
    known = indexed.filter(F.col("object_id").startswith("yt_")).select(
        F.substring("object_id", 4, 1000000).alias("video_id")
    )
    return videos.join(known, "video_id", "left_anti")


def flag_known_speakers(talks: DataFrame, seeds: DataFrame) -> DataFrame:
    """``is_known``: the lower-case speaker is a seed name or alias."""
    names = seeds.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n"))
    names = names.select(F.lower("n").alias("__name")).filter("__name IS NOT NULL").distinct()
    marked = talks.join(names, F.lower("speaker") == F.col("__name"), "left")
    return marked.withColumn("is_known", matched("__name")).drop("__name")


# ---- names --------------------------------------------------------------------------------------
def resolve_alias(names: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Add ``slug`` and ``display_name`` of the person behind ``name``.

    ``aliases`` has ``alias_slug, canonical_slug, display_name``; names without an alias keep their own.
    """
    own = names.withColumn("__slug", slugify(F.col("name")))
    if aliases is None:
        return own.withColumn("display_name", F.col("name")).withColumnRenamed("__slug", "slug")
    table = aliases.select(
        F.col("alias_slug").alias("__slug"), F.col("canonical_slug").alias("__to"),
        F.col("display_name").alias("__display"),
    )
    return (
        own.join(table, "__slug", "left")
        .withColumn("slug", F.coalesce("__to", "__slug"))
        .withColumn("display_name", F.when(matched("__to"), or_else(F.col("__display"), F.col("name"))).otherwise(F.col("name")))
        .drop("__slug", "__to", "__display")
    )


def similar_strings(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, ratio) of distinct strings ``a`` of ``left`` and ``b`` of ``right`` with block ratio ``least`` or more.

    Matching blocks can't hold more letters than both strings have in common, so the letters, numbered by
    occurrence, must overlap in at least ``least`` times half of all letters. Strings meet on the first letters of
    a common order, rarest first, as many as that overlap leaves room for; so no pair is missed. The whole overlap
    is then checked, and only what passes is compared block by block.
    """
    share = least / (2 - least)  # of its own letters a string has in common with any partner, at least

    def letters(df: DataFrame, name: str) -> DataFrame:
        chars = F.sort_array(F.split(name, ""))
        numbered = F.transform(chars, lambda c, i: F.concat(c, (i - F.array_position(chars, c)).cast("string")))
        return df.select(name).distinct().filter(F.length(name) > 0).withColumns({"letters": numbered, "size": F.length(name)})

    one, two = letters(left.toDF("a"), "a"), letters(right.toDF("b"), "b")
    exploded = two.select("b", "size", "letters", F.explode("letters").alias("letter"))
    often = exploded.groupBy("letter").agg(F.count(F.lit(1)).alias("often"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        kept = F.col("size") - F.ceil(F.round(F.col("size") * share, 9)) + 1
        ranked = df.select(name, "size", "letters", F.explode("letters").alias("letter")).join(often, "letter", "left")
        order = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "letter")))
        rows = ranked.groupBy(name, "size", "letters").agg(order.alias("o")).withColumn("e", F.explode(F.slice("o", F.lit(1), kept.cast("int"))))
        return rows.select(name, F.col("size").alias(f"size_{name}"), F.col("letters").alias(f"letters_{name}"), F.col("e.letter").alias("letter"))

    both = F.col("size_a") + F.col("size_b")
    met = prefix(one, "a").join(prefix(two, "b"), "letter").filter(
        F.size(F.array_intersect("letters_a", "letters_b")) >= both * (least / 2) - 1e-9)
    pairs = met.select("a", "b").distinct()
    return pairs.withColumn("ratio", block_ratio("a", "b")).filter(F.col("ratio") >= least)


def _rarest(names: DataFrame, name: str, others: DataFrame) -> DataFrame:
    """Each name with its word that the fewest of ``others`` hold: whoever holds all its words holds this one."""
    often = others.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    words = names.select(name, F.explode(F.array_distinct("words")).alias("word")).join(often, "word", "left")
    return words.groupBy(name).agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), "word")).alias("word"))


def fuzzy_match_people(left: DataFrame, right: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Best partner on the right for each left name, kept at ``threshold`` (0.4 to 1) or more, ties to the first name.

    Names are compared in normal form: equal 1, all words of the left in the right 0.95, of the right in the left
    0.90; two names of several words by first and last word; others by the whole string. Every pair that reaches
    the threshold is a candidate: equal forms join; contained ones meet on the rarest word of the smaller; of two
    names of several words either the first or the last words alone must reach the threshold, since the score is
    their mean; the rest meet as whole strings. All of this runs over distinct forms, words and word pairs.
    """
    def forms(df: DataFrame, name: str, form: str) -> DataFrame:
        named = df.select(F.col("name").alias(name)).filter(F.col(name) != "").distinct()
        return named.withColumn(form, normal_form(name))

    def parts(df: DataFrame, form: str) -> DataFrame:
        words = df.select(form).distinct().withColumn("words", name_tokens(F.col(form)))
        return words.withColumns({"n": F.size("words"), "first": F.get("words", F.lit(0)), "last": F.element_at(F.when(F.size("words") > 0, F.col("words")), -1)})

    own, other = cut_lineage(forms(left, "name", "a")), cut_lineage(forms(right, "match", "b"))
    one, two = cut_lineage(parts(own, "a")), cut_lineage(parts(other, "b"))
    equal = one.select("a").join(two.select(F.col("b")), F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("score"))
    some_a, some_b = one.filter("n > 0"), two.filter("n > 0")
    words_a, words_b = some_a.select("a", F.col("words").alias("wa")), some_b.select("b", F.col("words").alias("wb"))

    def contained(small: DataFrame, inner: str, large: DataFrame, outer: str, score: float) -> DataFrame:
        holders = large.select(outer, F.explode(F.array_distinct("words")).alias("word"))
        met = _rarest(small, inner, large).join(holders, "word").select("a", "b").join(words_a, "a").join(words_b, "b")
        smaller, larger = ("wa", "wb") if inner == "a" else ("wb", "wa")
        return met.filter(F.size(F.array_except(smaller, larger)) == 0).select("a", "b", F.lit(score).alias("score"))

    inside = contained(some_a, "a", some_b, "b", 0.95)
    around = contained(some_b, "b", some_a, "a", 0.90)

    many_a, many_b = some_a.filter("n > 1"), some_b.filter("n > 1")
    people_a = many_a.select("a", F.col("first").alias("first_a"), F.col("last").alias("last_a"))
    people_b = many_b.select("b", F.col("first").alias("first_b"), F.col("last").alias("last_b"))

    def by_word(word: str) -> DataFrame:
        alike = similar_strings(many_a.select(word), many_b.select(word), threshold).toDF(f"{word}_a", f"{word}_b", "ratio")
        if word == "first" and threshold <= 0.7:
            # beside an all but equal first name the last names must reach 0.7, so the other side finds the pair
            alike = alike.filter("ratio <= 0.9")
        return alike.join(people_a, f"{word}_a").join(people_b, f"{word}_b").select("a", "b", "first_a", "last_a", "first_b", "last_b")

    people = cut_lineage(by_word("last").union(by_word("first")).distinct())

    def ratios(word: str) -> DataFrame:
        pairs = people.select(f"{word}_a", f"{word}_b").distinct()
        return pairs.withColumn(f"{word}_ratio", block_ratio(f"{word}_a", f"{word}_b"))

    scored = people.join(ratios("first"), ["first_a", "first_b"]).join(ratios("last"), ["last_a", "last_b"])
    scored = scored.select("a", "b", part_score(F.col("first_ratio"), F.col("last_ratio")).alias("score"))

    single_a, single_b = some_a.filter("n = 1").select("a"), some_b.filter("n = 1").select("b")
    whole = similar_strings(single_a, some_b.select("b"), threshold).union(similar_strings(many_a.select("a"), single_b, threshold))
    # the rules come in this order: an equal pair is also contained, a contained one may also be alike
    rule = equal.select("a", "b", F.lit(0).alias("rule"), "score").union(inside.select("a", "b", F.lit(1), "score")).union(
        around.select("a", "b", F.lit(2), "score")).union(scored.select("a", "b", F.lit(3), "score")).union(whole.select("a", "b", F.lit(3), "ratio"))
    best = rule.groupBy("a", "b").agg(F.min_by("score", "rule").alias("score")).filter(F.col("score") >= threshold)
    named = best.join(own, "a").join(other, "b").select("name", "match", "score")
    return top_k_per_key(named, ["name"], [F.col("score").desc(), F.col("match")], 1).drop("rank")


# ---- mentions -----------------------------------------------------------------------------------
GRAM = 6
# letters of name variants that one automaton may hold (about 100 bytes each in a task), and passes over the titles at most
AUTOMATON_LETTERS, AUTOMATON_PASSES = 500_000, 8


def _scanned(variants: DataFrame, posts: DataFrame, passes: int) -> DataFrame:
    """(variant, post_id) of every variant in a title, by one Aho-Corasick automaton a pass; only hits leave the scan."""
    spark, found = posts.sparkSession, None
    for number in range(passes):
        part = variants if passes == 1 else variants.filter(F.pmod(F.xxhash64("variant"), F.lit(passes)) == number)
        shared = spark.sparkContext.broadcast([r["variant"] for r in part.collect()])  # a checked number of letters

        def scan(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in shared.value:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                rows, hits = [], []
                for row, title in enumerate(batch.column(1).to_pylist()) if len(automaton) else ():
                    own = {word for _, word in automaton.iter(title)}
                    rows += [row] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays([pa.array(hits, pa.string()), batch.column(0).take(pa.array(rows, pa.int64()))], ["variant", "post_id"])

        kind = posts.schema["post_id"].dataType.simpleString()
        some = posts.select("post_id", F.lower("title").alias("title")).mapInArrow(scan, f"variant string, post_id {kind}")
        found = some if found is None else found.union(some)
    return found


def _by_grams(variants: DataFrame, posts: DataFrame) -> DataFrame:
    """The same through an equi-join, for name sets too large for automata.

    Every variant is represented by one of its grams (``GRAM`` letters, the whole variant when shorter) and every title
    by all its grams of the lengths in use. The gram of a variant is the one that is rarest among the variants. Sharing
    it is necessary for containment, so nothing is lost, and the residual check removes the rest.
    """
    length = F.least(F.length("variant"), F.lit(GRAM))
    grams = variants.withColumn("place", F.explode(F.sequence(F.lit(1), F.length("variant") - length + 1)))
    grams = grams.withColumn("gram", F.substring(F.col("variant"), F.col("place"), length)).drop("place")
    weight = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("uses"))
    anchors = grams.join(weight, "gram").groupBy("variant").agg(F.min(F.struct("uses", "gram"))["gram"].alias("gram"))
    lowered = F.lower("title")
    # at most GRAM different numbers, whatever the data size
    lengths = [row.n for row in variants.select(length.alias("n")).distinct().collect()]
    cut = F.transform(
        F.array(*[F.lit(n) for n in sorted(lengths)]),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(lowered) - n + 1, F.lit(1))),
            lambda at: F.substring(lowered, at, n),
        ),
    )
    spread = posts.select("post_id", "title", F.explode(F.array_distinct(F.flatten(cut))).alias("gram"))
    return anchors.join(spread, "gram").filter(F.contains(lowered, F.col("variant"))).select("variant", "post_id")


def mention_join(conferences: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts about each conference: the title holds one of its name variants and is not noise.

    Every title is read once for all distinct variants by an Aho-Corasick automaton, in a few passes if the variants
    have more letters than one may hold; beyond that they meet in an equi-join on groups of letters.
    """
    confs = conferences.select("conf_id", "conf_name").filter(clean_name(F.col("conf_name")) != "")
    variants = cut_lineage(confs.select(
        "conf_id", "conf_name", F.explode(F.array_distinct(name_variants(F.col("conf_name")))).alias("variant")))
    distinct = variants.select("variant").filter("variant <> ''").distinct()
    letters = distinct.agg(F.sum(F.length("variant"))).first()[0] or 0
    passes = max(1, -(-letters // AUTOMATON_LETTERS))
    titled = posts.filter(F.col("title").isNotNull())
    hits = _scanned(distinct, titled, passes) if passes <= AUTOMATON_PASSES else _by_grams(distinct, titled)
    # posts are dealt by the hits they have: a variant that very many titles hold is left to the AQE skew join
    named = hits.join(variants, "variant").select("conf_id", "conf_name", "post_id").distinct()
    found = named.join(posts, "post_id")
    return found.filter(~is_noise_title(F.col("title"), F.col("conf_name")))


# ---- lookups ------------------------------------------------------------------------------------
def talks_for_conference(talks: DataFrame, conference_id, k: int = 20) -> DataFrame:
    order = [F.col("popularity_score").desc_nulls_last(), F.col("view_count").desc(), F.col("year").desc(), F.col("object_id")]
    return top_k(talks.filter(F.col("conference_id") == F.lit(conference_id)), order, k)


def get_by_ids(items: DataFrame, ids: Sequence[str], k: int, key: str = "object_id") -> DataFrame:
    """Items of the first ``k`` requested ids with their place in the request; unknown ids are left out."""
    wanted = list(ids)[:k]
    place = F.array_position(F.array(*[F.lit(i) for i in wanted]), F.col(key)).cast("bigint")
    return items.filter(F.col(key).isin(wanted)).withColumn("pos", place).orderBy("pos")


def city_images(cfps: DataFrame, images: DataFrame, k: int = 30) -> DataFrame:
    """Image and thumbnail links for calls that have none yet; ``images`` is ``city, pos, url, thumb``."""
    ranked = top_k_per_key(images, ["city"], [F.col("pos")], k)
    entries = F.array_sort(F.collect_list(F.struct("rank", "url", "thumb")))
    per_city = ranked.groupBy("city").agg(entries.alias("e")).select(
        "city", F.transform("e", lambda e: e["url"]).alias("city_image_urls"),
        F.transform("e", lambda e: e["thumb"]).alias("city_image_thumbs"),
    )
    open_rows = cfps.filter((F.col("city") != "") & (F.lower("city") != "online") & ~F.col("has_images"))
    return open_rows.select("object_id", "city").join(per_city, "city")


def tag_category_lookup(items: DataFrame, taxonomy: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    """Categories of each item's tags as distinct ``(object_id, category)`` rows.

    ``taxonomy`` is a table ``tag, category`` with lower-case tags. A tag that is not in it but names one
    of ``categories`` maps to itself.
    """
    tags = items.select("object_id", F.explode("tags").alias("raw")).select("object_id", strip(F.lower("raw")).alias("tag"))
    joined = tags.filter("tag <> ''").join(taxonomy.select("tag", "category"), "tag", "left")
    own = F.when(F.col("tag").isin(*categories), F.col("tag")) if categories else F.lit(None).cast("string")
    return joined.select("object_id", F.coalesce("category", own).alias("category")).filter("category IS NOT NULL").distinct()


# ---- profiles -----------------------------------------------------------------------------------
def fill_github_profile(speakers: DataFrame, profiles: DataFrame) -> DataFrame:
    """What a code-hosting profile adds to a speaker; rows with nothing new are left out."""
    joined = speakers.join(profiles.select("object_id", F.struct(*[c for c in profiles.columns if c != "object_id"]).alias("p")), "object_id")

    def missing(have: str, value: Column) -> Column:
        return F.when(blank_to_null(F.col(have)).isNull(), blank_to_null(value))

    company = strip(F.regexp_replace(F.col("p.company"), "^@+", ""))
    blog = strip(F.col("p.blog"))
    out = joined.select(
        "object_id",
        missing("image_url", F.col("p.avatar_url")).alias("image_url"),
        blank_to_null(F.col("p.username")).alias("github"),
        missing("location", F.col("p.location")).alias("location"),
        missing("company", company).alias("company"),
        missing("twitter", F.col("p.twitter_username")).alias("twitter"),
        F.when(~blog.startswith("https://github.com"), blank_to_null(blog)).alias("website"),
    )
    return out.filter(F.coalesce("image_url", "github", "location", "company", "twitter", "website").isNotNull())


def fill_directory_profile(speakers: DataFrame, profiles: DataFrame) -> DataFrame:
    """What a speaker-directory profile adds: any non-empty value, images only over https."""
    fields = ["slug", "tagline", "location", "twitter", "linkedin", "github", "profile_url"]
    columns = [blank_to_null(F.col(f"p.{f}")).alias(f) for f in fields]
    joined = speakers.select("object_id").join(
        profiles.select("object_id", F.struct("photo_url", *fields).alias("p")), "object_id"
    )
    image = F.when(F.col("p.photo_url").startswith("https://"), F.col("p.photo_url")).alias("image_url")
    return joined.select("object_id", image, *columns)


def merge_video_details(talks: DataFrame, details: DataFrame) -> DataFrame:
    """Detail values win where they are not empty or zero; the year follows the upload date."""
    fields = ("description", "duration_seconds", "view_count", "channel")
    joined = talks.join(
        details.select("object_id", F.struct(*fields, "upload_date").alias("d")), "object_id", "left"
    )
    for name in fields:
        empty = F.lit("") if dict(talks.dtypes)[name] == "string" else F.lit(0)
        joined = joined.withColumn(name, F.coalesce(F.nullif(F.col(f"d.{name}"), empty), F.col(name)))
    uploaded = F.when(F.length("d.upload_date") >= 4, F.substring("d.upload_date", 1, 4).try_cast("int"))
    return joined.withColumn("year", F.coalesce(uploaded, F.col("year"))).drop("d")


def distinct_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return first_per_key(df, [key], [F.col(c) for c in order])
