"""Community signals: posts, repositories and articles about conferences, and scores from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions.cuts import RECORD, Cuts, cut_list, cut_text
from rostrum.functions.text import contains_any
from rostrum.operators.aggregates import counter
from rostrum.operators.filters import drop_noise_subreddits, is_noise_title
from rostrum.plans.skew import numbered, top_k_array, top_k_per_key
from rostrum.plans.storage import cut_lineage

KEY = "conf_id"


def _top_values(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """The ``k`` most frequent values per conference as an array."""
    return top_k_array(counter(rows, [KEY], value), [KEY], [F.col("n").desc(), F.col(value)], k, F.col(value), name)


def _first_values(rows: DataFrame, value: Column, k: int, name: str) -> DataFrame:
    """The first ``k`` values per conference in ``post_id`` order."""
    kept = rows.select(KEY, "post_id", value.alias("__v")).filter("__v IS NOT NULL")
    return top_k_array(kept, [KEY], [F.col("post_id")], k, F.col("__v"), name)


def _all(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Join one-row-per-conference tables; all are partitioned by the key already."""
    for part in parts:
        base = base.join(part, KEY, "left")
    arrays = [c for c, t in base.dtypes if t == "array<string>"]
    return base.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in arrays})


def hn_intel(posts: DataFrame, comments: DataFrame | None = None, cuts: Cuts = RECORD) -> DataFrame:
    """Per conference: stories, points, comments, title words and the comments of its first five stories.

    ``posts``: ``conf_id, conf_name, post_id, title, points, num_comments``; ``comments``: ``post_id,
    comment_id, text``.
    """
    # titles are judged once; all parts read the result
    posts = cut_lineage(posts.select(KEY, "post_id", "title", "points", "num_comments", is_noise_title(F.col("title"), F.col("conf_name")).alias("noise")))
    about = posts.filter(~F.col("noise"))
    totals = posts.groupBy(KEY).agg(F.count("*").alias("hn_stories"))
    kept = about.groupBy(KEY).agg(
        F.count("*").alias("hn_kept"), F.sum(F.coalesce("points", F.lit(0))).alias("hn_points"),
        F.sum(F.coalesce("num_comments", F.lit(0))).alias("hn_num_comments"),
    )
    words = about.select(KEY, F.explode(F.regexp_extract_all("title", F.lit(L.TITLE_WORD_PATTERN), F.lit(0))).alias("word"))
    parts = [
        kept, _first_values(about, F.col("title"), 10, "hn_story_titles"), _top_values(words, "word", 10, "hn_topics"),
    ]
    if comments is not None:
        first = top_k_per_key(about.select(KEY, "post_id"), [KEY], [F.col("post_id")], 5).drop("rank")
        text = cut_text(F.regexp_replace("text", "<[^>]+>", ""), cuts.comment)
        said = first.join(comments.filter(F.length("text") > 50), "post_id").select(KEY, "post_id", "comment_id", text.alias("t"))
        parts.append(top_k_array(said, [KEY], [F.col("post_id"), F.col("comment_id")], 20, F.col("t"), "hn_comments"))
    out = _all(totals, *parts)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("hn_kept", "hn_points", "hn_num_comments")})


def github_intel(repos: DataFrame, cuts: Cuts = RECORD) -> DataFrame:
    """Per conference: repositories, stars, languages, topics and short descriptions."""
    repos = cut_lineage(repos.select(KEY, "post_id", "stars", "language", "topics", "description"))
    totals = repos.groupBy(KEY).agg(
        F.count("*").alias("github_repos"), F.sum(F.coalesce("stars", F.lit(0))).alias("github_stars")
    )
    described = F.when(F.col("description") != "", cut_text("description", cuts.repository))
    return _all(
        totals,
        _top_values(repos.filter("language <> ''"), "language", 10, "github_languages"),
        _top_values(repos.select(KEY, F.explode("topics").alias("topic")), "topic", 20, "github_topics"),
        _first_values(repos, described, 10, "github_descriptions"),
    )


def reddit_intel(posts: DataFrame, cuts: Cuts = RECORD) -> DataFrame:
    """Per conference: posts outside noise groups, subreddits, flairs, titles and long self texts."""
    kept = cut_lineage(drop_noise_subreddits(posts).select(KEY, "post_id", "subreddit", "flair", "title", "selftext"))
    long_text = F.when(F.length("selftext") > 50, cut_text("selftext", cuts.comment))
    return _all(
        kept.groupBy(KEY).agg(F.count("*").alias("reddit_posts")),
        _top_values(kept, "subreddit", 10, "reddit_subreddits"),
        _top_values(kept.filter("flair <> ''"), "flair", 10, "reddit_flairs"),
        _first_values(kept, F.col("title"), 10, "reddit_titles"),
        _first_values(kept, long_text, 20, "reddit_comments"),
    )


def devto_intel(articles: DataFrame) -> DataFrame:
    """Per conference: articles, tags and authors."""
    articles = cut_lineage(articles.select(KEY, "post_id", "tags", "author", "title"))
    return _all(
        articles.groupBy(KEY).agg(F.count("*").alias("devto_articles")),
        _top_values(articles.select(KEY, F.explode("tags").alias("tag")), "tag", 15, "devto_tags"),
        _top_values(articles, "author", 10, "devto_authors"),
        _first_values(articles, F.col("title"), 10, "devto_titles"),
    )


def _number(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def popularity_score() -> Column:
    """0..100 from the weighted signals of all sources, on a logarithmic scale."""
    raw = (
        _number("hn_stories") * 5 + _number("hn_points") * 0.01 + _number("github_repos") * 2
        + _number("github_stars") * 0.01 + _number("reddit_posts") + _number("devto_articles") * 3
        + _number("web_results") * 0.5
    )
    return F.least(F.lit(100.0), F.log1p(raw.cast("double")) * 10)


def compact_intel(intel: DataFrame, cuts: Cuts = RECORD) -> DataFrame:
    """Four source scores, the combined popularity and lists of five."""
    hn = _number("hn_points") + _number("hn_stories") * 10
    github = _number("github_stars") + _number("github_repos") * 5
    reddit, devto = _number("reddit_posts") * 3, _number("devto_articles") * 5
    raw = hn * 0.4 + github * 0.3 + reddit * 0.2 + devto * 0.1
    lists = [c for c in ("hn_story_titles", "github_languages", "reddit_subreddits", "devto_tags") if c in intel.columns]
    return intel.select(
        KEY, "hn_stories", "hn_points", "github_repos", "github_stars", "reddit_posts", "devto_articles",
        hn.alias("hn_score"), github.alias("github_score"), reddit.alias("reddit_score"), devto.alias("devto_score"),
        F.round(F.least(F.lit(100.0), F.log1p(raw.cast("double")) * 8), 1).alias("popularity_score"),
        *[cut_list(c, cuts.compact).alias(c) for c in lists],
    )


def intel_topics(intel: DataFrame, columns: Sequence[str], k: int = 30) -> DataFrame:
    """Distinct topics of all sources per conference, sorted, at most ``k``."""
    empty = F.array().cast("array<string>")
    merged = F.array_distinct(F.concat(*[F.coalesce(F.col(c), empty) for c in columns]))
    return intel.withColumn("intel_topics", F.slice(F.array_sort(F.filter(merged, lambda t: t != "")), 1, k))


def intel_urls(urls: DataFrame, k: int = 50) -> DataFrame:
    """Distinct links of all sources per conference, sorted, at most ``k``; ``urls`` is ``conf_id, url``."""
    distinct = urls.filter("url <> ''").select(KEY, "url").distinct()
    return top_k_array(distinct, [KEY], [F.col("url")], k, F.col("url"), "intel_urls")


# ---- per-source records -------------------------------------------------------------------------
SOURCE_CHILDREN = {"hn": "stories", "github": "repos", "reddit": "posts", "devto": "articles"}


def split_intel_records(bundles: DataFrame, cuts: Cuts = RECORD) -> dict[str, DataFrame]:
    """One table per source from nested bundles; a source with no children and no total is skipped.

    ``bundles``: ``conf_id, conf_name`` and per source a struct with its child array, ``total`` and lists.
    """
    tables = {}
    for source, children in SOURCE_CHILDREN.items():
        s = lambda field, source=source: F.col(f"{source}.{field}")
        columns = [cut_list(s(children), getattr(cuts, children)).alias(children), F.coalesce(s("total"), F.lit(0)).alias("total")]
        if source == "hn":
            columns += [
                cut_list(s("titles"), cuts.titles).alias("titles"), cut_list(s("comments"), cuts.comments).alias("comments"),
                cut_list(s("authors"), cuts.authors).alias("authors"),
            ]
        elif source == "reddit":
            columns.append(cut_list(s("comments"), cuts.reddit_comments).alias("comments"))
        present = (F.coalesce(F.size(s(children)), F.lit(0)) > 0) | (F.coalesce(s("total"), F.lit(0)) != 0)
        tables[source] = bundles.filter(present).select(KEY, "conf_name", *columns)
    return tables


# ---- repository audit ---------------------------------------------------------------------------
def name_parts(name: Column) -> Column:
    """Distinct lower-case words of a conference name without years and filler words."""
    spaced = F.replace(F.replace(F.lower(name), F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))
    words = F.filter(F.split(spaced, r"(?U)\s+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in L.REPO_STOPWORDS]))


def name_key(name: Column) -> Column:
    """The longest name word (the first in the alphabet of equals), empty text when none is left."""
    ranked = F.array_sort(F.transform(name_parts(name), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.coalesce(F.get(ranked, F.lit(0))["w"], F.lit(""))


def repo_class(conf_name: Column, repo: Column, full_name: Column, description: Column, stars: Column, topics: Column) -> Column:
    """Struct ``(category, reason)`` of a repository for a conference; the first rule that fits counts."""
    key = name_key(conf_name)
    name, full = F.lower(F.coalesce(repo, F.lit(""))), F.lower(F.coalesce(full_name, F.lit("")))
    text = F.lower(F.coalesce(description, F.lit("")))
    tags = F.transform(F.coalesce(topics, F.array().cast("array<string>")), F.lower)
    owner = F.get(F.split(full, "/"), F.lit(0))
    long_key = F.length(key) >= 4
    near = long_key & (F.contains(name, key) | F.contains(key, name))
    official_word = contains_any(name, L.REPO_OFFICIAL_WORDS) | contains_any(text, L.REPO_OFFICIAL_WORDS)
    tag = F.get(F.filter(tags, lambda t: F.contains(t, key)), F.lit(0))
    mentioned = F.contains(name, key) | F.contains(text, key)

    def made(category: str, reason: Column | str) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(category).alias("category"), reason.alias("reason"))

    rule = (
        F.when(near & official_word, made("official", "Official conference repo/site"))
        .when(near & (F.contains(owner, F.lit("org")) | F.contains(owner, key)), made("official", F.concat(F.lit("Org repo: "), owner)))
        .when(long_key & tag.isNotNull() & official_word, made("official", F.concat(F.lit("Tagged with "), tag)))
    )
    for word in L.REPO_RELATED_WORDS:
        hit = F.contains(name, F.lit(word)) | F.contains(text, F.lit(word))
        rule = rule.when(hit & mentioned, made("related", f"Conference {word}"))
    for year in L.REPO_YEARS:
        hit = F.contains(name, F.lit(year)) & F.contains(name, key)
        rule = rule.when(hit, made("related", f"Year-specific repo ({year})"))
    awesome = F.contains(name, F.lit("awesome")) | F.contains(F.substring(text, 1, 50), F.lit("awesome"))
    generic = contains_any(name, L.REPO_NOISE_WORDS) | contains_any(text, L.REPO_NOISE_WORDS)
    unknown = (F.coalesce(stars, F.lit(0)) < 10) & ~mentioned & tag.isNull()
    return (
        rule.when(tag.isNotNull(), made("related", "Related by topic"))
        .when(awesome, made("noise", "Awesome list"))
        .when(generic, made("noise", "Generic learning/collection repo"))
        .when(unknown, made("noise", "Low relevance signals"))
        .when((key != "") & long_key & mentioned, made("related", "Mentions conference name"))
        .otherwise(made("noise", "No clear connection"))
    )


def classify_repos(repos: DataFrame) -> DataFrame:
    c = F.col
    kind = repo_class(c("conf_name"), c("name"), c("full_name"), c("description"), c("stars"), c("topics"))
    return repos.withColumn("__k", kind).select("*", "__k.category", "__k.reason").drop("__k")


def repo_precision(classified: DataFrame) -> DataFrame:
    """Per conference: class counts and quality (official 1, related one half)."""
    n = F.count("*")
    official, related = F.count_if(F.col("category") == "official"), F.count_if(F.col("category") == "related")
    return classified.groupBy(KEY).agg(
        n.alias("repos"), F.sum(F.coalesce("stars", F.lit(0))).alias("total_stars"),
        official.alias("official"), related.alias("related"), F.count_if(F.col("category") == "noise").alias("noise"),
        ((official + related * 0.5) / n).alias("quality"),
    )


def precision_summary(per_conference: DataFrame) -> DataFrame:
    """Overall shares, mean quality and the verdict on the source."""
    total = F.sum("official") + F.sum("related") + F.sum("noise")
    signal = (F.sum("official") + F.sum("related")) / F.nullif(total, F.lit(0))
    verdict = F.when(signal >= 0.6, F.lit("KEEP")).when(signal >= 0.3, F.lit("FILTER")).otherwise(F.lit("DROP or MAJOR FILTER"))

    def share(column: str) -> Column:
        return F.round(100 * F.sum(column) / F.nullif(total, F.lit(0)), 1)

    return per_conference.agg(
        share("official").alias("official_pct"), share("related").alias("related_pct"), share("noise").alias("noise_pct"),
        F.round(F.avg("quality"), 6).alias("avg_quality"), verdict.alias("verdict"),
    )


def noise_reasons(classified: DataFrame) -> DataFrame:
    counted = counter(classified.filter(F.col("category") == "noise"), [], "reason")
    return counted.orderBy(F.col("n").desc(), "reason")


def star_distribution(repos: DataFrame) -> DataFrame:
    """Largest value, element ``n div 2`` and element ``int(n / 10)`` of the descending list, and counts.

    Equal values are one row with their number, and a running sum finds the value that holds a position: no
    task sees the whole list.
    """
    values = repos.select(F.coalesce("stars", F.lit(0)).cast("bigint").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    totals = repos.agg(
        F.count("*").alias("total"), F.max(F.coalesce("stars", F.lit(0))).cast("bigint").alias("max"),
        F.count_if(F.col("stars") >= 1000).alias("at_least_1000"), F.count_if(F.col("stars") >= 100).alias("at_least_100"),
        F.count_if(F.coalesce("stars", F.lit(0)) < 10).alias("below_10"),
    )
    found = positions_descending(values, {"median": lambda n: F.floor(n / 2), "p90": lambda n: F.floor(n * 0.1)})
    return side_by_side(totals, found)


def side_by_side(totals: DataFrame, found: DataFrame) -> DataFrame:
    """Put two one-row tables side by side."""
    one = F.lit(1)
    return totals.withColumn("__k", one).join(found.withColumn("__k", one), "__k").drop("__k", "total")


def positions_descending(values: DataFrame, wanted: dict) -> DataFrame:
    """Values at given places of the descending list described by ``(v, n)`` rows, as one row.

    The number of elements before each value is a running sum over parts dealt by range, so no task sees more
    than its part, however the values are distributed.
    """
    total = F.lit(values.agg(F.sum("n").alias("n")).first()["n"] or 0)
    placed = numbered(values, [F.col("v").desc()], "start", "n")
    held = lambda place: (place >= F.col("start")) & (place < F.col("start") + F.col("n"))
    return placed.agg(*[F.max(F.when(held(rule(total).cast("bigint")), F.col("v"))).alias(name) for name, rule in wanted.items()])


def set_overlap(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Number of distinct values both tables have."""
    return left.select(column).intersect(right.select(column)).agg(F.count("*").alias("overlap"))

