"""Community signals: mentions, per-source figures, scores and the repository audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.catalog.functions import duck_any
from rostrum.catalog.registry import Tables, register
from rostrum.operators import filters as FL
from rostrum.operators import intel as I
from rostrum.operators import joins as J
from rostrum.operators import windows as W

# ---- oracle building blocks ---------------------------------------------------------------------
NOISE = "|".join(p.replace("'", "''") for p in L.NOISE_PATTERNS)


def is_noise(title: str, thing: str) -> str:
    """SQL of the noise rule for a conference whose clean lower-case name is ``thing``."""
    found = f"(contains(lower({title}), {thing}) OR contains(lower({title}), replace({thing}, ' ', '')) OR contains(lower({title}), replace({thing}, ' ', '-')))"
    return f"(regexp_matches(lower({title}), '(?i){NOISE}') OR NOT {found})"


OWN = is_noise("title", "replace(conf_name, ' 2024', '')")


def top_list(source: str, value: str, k: int, name: str, where: str = "TRUE") -> str:
    """SQL: conf_id and the k most frequent values as comma text."""
    return f"""SELECT conf_id, string_agg(v, ',' ORDER BY n DESC, v) AS {name} FROM (
        SELECT conf_id, v, n, ROW_NUMBER() OVER (PARTITION BY conf_id ORDER BY n DESC, v) AS r FROM (
          SELECT conf_id, {value} AS v, COUNT(*) AS n FROM {source} WHERE {where} GROUP BY 1, 2) WHERE v IS NOT NULL) WHERE r <= {k} GROUP BY conf_id"""


def first_list(source: str, value: str, k: int, name: str, where: str = "TRUE") -> str:
    return f"""SELECT conf_id, string_agg(v, '|' ORDER BY post_id) AS {name} FROM (
        SELECT conf_id, post_id, {value} AS v, ROW_NUMBER() OVER (PARTITION BY conf_id ORDER BY post_id) AS r FROM {source} WHERE ({where}) AND {value} IS NOT NULL)
        WHERE r <= {k} GROUP BY conf_id"""


def joined(df: DataFrame, comma: list[str], bar: list[str]) -> DataFrame:
    """Arrays as text, empty ones as NULL, for comparison."""
    for name, sep in [(c, ",") for c in comma] + [(c, "|") for c in bar]:
        df = df.withColumn(name, F.when(F.size(name) > 0, F.array_join(name, sep)))
    return df


# ---- noise and mentions -------------------------------------------------------------------------
@register("noise_titles", "FLT-11", oracle=f"SELECT post_id, {OWN} AS is_noise FROM {{v_post}}")
def _(t):
    return t.view("v_post").select("post_id", FL.is_noise_title(F.col("title"), F.col("conf_name")).alias("is_noise"))


@register("mentions", "JN-5", "FLT-11", oracle=f"""
    SELECT c.conf_id, p.post_id FROM {{v_conf}} c, (SELECT post_id, title FROM {{v_post}}) p WHERE NOT {is_noise('p.title', "replace(c.conf_name, ' 2024', '')")}""")
def _(t):
    posts = t.view("v_post").select("post_id", "title")
    return J.mention_join(t.view("v_conf"), posts).select("conf_id", "post_id")


@register("clean_subreddits", "FLT-12", oracle="SELECT post_id, subreddit FROM {v_post} WHERE lower(subreddit) NOT IN ('kpop', 'music')")
def _(t):
    return FL.drop_noise_subreddits(t.view("v_post")).select("post_id", "subreddit")


@register("named_articles", "FLT-13", oracle="""
    SELECT MIN(post_id) AS article_id, url FROM {v_post} WHERE contains(lower(title), 'red widget') OR contains(lower(COALESCE(selftext, '')), 'red widget') OR lower(kind) = 'redwidget' GROUP BY url""")
def _(t):
    articles = t.view("v_post").select(F.col("post_id").alias("article_id"), "title", F.col("selftext").alias("description"), "url", F.array("kind").alias("tags"))
    return FL.devto_name_filter(articles, "Red Widget 2024 - CFP").select("article_id", "url")


# ---- per source ---------------------------------------------------------------------------------
ABOUT = f"(SELECT * FROM {{v_post}} WHERE NOT {OWN})"
COMMENTS = """SELECT o_orderkey - o_orderkey % 3 AS post_id, o_orderkey AS comment_id,
    CASE WHEN o_orderkey % 2 = 0 THEN '<p>' || o_orderpriority || '</p> a comment that is long enough to be kept in the list' ELSE 'too short' END AS text FROM {orders}"""


def hn(t: Tables) -> DataFrame:
    return I.hn_intel(t.view("v_post"), t.sql(COMMENTS))


@register("hn_intel", "AGG-5", oracle=f"""
    SELECT t.conf_id, hn_stories, COALESCE(hn_kept, 0) AS hn_kept, COALESCE(hn_points, 0) AS hn_points, COALESCE(hn_num_comments, 0) AS hn_num_comments, hn_story_titles, hn_topics, hn_comments
    FROM (SELECT conf_id, COUNT(*) AS hn_stories FROM {{v_post}} GROUP BY 1) t
    LEFT JOIN (SELECT conf_id, COUNT(*) AS hn_kept, CAST(SUM(points) AS BIGINT) AS hn_points, CAST(SUM(num_comments) AS BIGINT) AS hn_num_comments FROM {ABOUT} GROUP BY 1) k USING (conf_id)
    LEFT JOIN ({first_list(ABOUT, 'title', 10, 'hn_story_titles')}) a USING (conf_id)
    LEFT JOIN ({top_list(f"(SELECT conf_id, UNNEST(regexp_extract_all(title, '{L.TITLE_WORD_PATTERN}')) AS w FROM {ABOUT})", 'w', 10, 'hn_topics')}) b USING (conf_id)
    LEFT JOIN (SELECT conf_id, string_agg(v, '|' ORDER BY post_id, comment_id) AS hn_comments FROM (
      SELECT conf_id, post_id, comment_id, regexp_replace(text, '<[^>]+>', '', 'g') AS v, ROW_NUMBER() OVER (PARTITION BY conf_id ORDER BY post_id, comment_id) AS r FROM (
        SELECT conf_id, post_id FROM (SELECT conf_id, post_id, ROW_NUMBER() OVER (PARTITION BY conf_id ORDER BY post_id) AS r FROM {ABOUT}) WHERE r <= 5)
      JOIN ({COMMENTS}) USING (post_id) WHERE length(text) > 50) WHERE r <= 20 GROUP BY conf_id) c USING (conf_id)""")
def _(t):
    return joined(hn(t), ["hn_topics"], ["hn_story_titles", "hn_comments"])


def github(t: Tables) -> DataFrame:
    return I.github_intel(t.view("v_repo").withColumn("topics", F.array("topic", "language")).withColumn("topics", F.array_compact("topics")))


@register("github_intel", "AGG-6", oracle=f"""
    SELECT conf_id, COUNT(*) AS github_repos, CAST(SUM(stars) AS BIGINT) AS github_stars, ANY_VALUE(github_languages) AS github_languages,
           ANY_VALUE(github_topics) AS github_topics, ANY_VALUE(github_descriptions) AS github_descriptions FROM {{v_repo}}
    LEFT JOIN ({top_list('{v_repo}', 'language', 10, 'github_languages')}) USING (conf_id)
    LEFT JOIN ({top_list('(SELECT conf_id, topic FROM {v_repo} UNION ALL SELECT conf_id, language FROM {v_repo} WHERE language IS NOT NULL)', 'topic', 20, 'github_topics')}) USING (conf_id)
    LEFT JOIN ({first_list('{v_repo}', "NULLIF(description, '')", 10, 'github_descriptions')}) USING (conf_id) GROUP BY conf_id""")
def _(t):
    return joined(github(t), ["github_languages", "github_topics"], ["github_descriptions"])


CLEAN = "(SELECT * FROM {v_post} WHERE lower(subreddit) NOT IN ('kpop', 'music'))"


def reddit(t: Tables) -> DataFrame:
    return I.reddit_intel(t.view("v_post"))


@register("reddit_intel", "AGG-7", oracle=f"""
    SELECT * FROM (SELECT conf_id, COUNT(*) AS reddit_posts FROM {CLEAN} GROUP BY 1)
    LEFT JOIN ({top_list(CLEAN, 'subreddit', 10, 'reddit_subreddits')}) USING (conf_id) LEFT JOIN ({top_list(CLEAN, 'flair', 10, 'reddit_flairs')}) USING (conf_id)
    LEFT JOIN ({first_list(CLEAN, 'title', 10, 'reddit_titles')}) USING (conf_id) LEFT JOIN ({first_list(CLEAN, 'selftext', 20, 'reddit_comments', 'length(selftext) > 50')}) USING (conf_id)""")
def _(t):
    return joined(reddit(t), ["reddit_subreddits", "reddit_flairs"], ["reddit_titles", "reddit_comments"])


def devto(t: Tables) -> DataFrame:
    return I.devto_intel(t.view("v_post").withColumn("tags", F.array("kind", "brand")))


@register("devto_intel", "AGG-8", oracle=f"""
    WITH a AS (SELECT * FROM {{v_post}})
    SELECT * FROM (SELECT conf_id, COUNT(*) AS devto_articles FROM a GROUP BY 1)
    LEFT JOIN ({top_list('(SELECT conf_id, kind AS tag FROM a UNION ALL SELECT conf_id, brand FROM a)', 'tag', 15, 'devto_tags')}) USING (conf_id)
    LEFT JOIN ({top_list('a', 'author', 10, 'devto_authors')}) USING (conf_id) LEFT JOIN ({first_list('a', 'title', 10, 'devto_titles')}) USING (conf_id)""")
def _(t):
    return joined(devto(t), ["devto_tags", "devto_authors"], ["devto_titles"])


def all_intel(t: Tables) -> DataFrame:
    out = t.view("v_conf")
    for part in (hn(t), github(t), reddit(t), devto(t)):
        out = out.join(part, "conf_id", "left")
    return out.withColumn("web_results", F.lit(0).cast("bigint"))


NUMBERS = f"""
    SELECT conf_id, conf_name, hn_stories, COALESCE(hn_points, 0) AS hn_points, github_repos, github_stars, reddit_posts, devto_articles FROM {{v_conf}}
    LEFT JOIN (SELECT conf_id, COUNT(*) AS hn_stories FROM {{v_post}} GROUP BY 1) USING (conf_id) LEFT JOIN (SELECT conf_id, CAST(SUM(points) AS BIGINT) AS hn_points FROM {ABOUT} GROUP BY 1) USING (conf_id)
    LEFT JOIN (SELECT conf_id, COUNT(*) AS github_repos, CAST(SUM(stars) AS BIGINT) AS github_stars FROM {{v_repo}} GROUP BY 1) USING (conf_id)
    LEFT JOIN (SELECT conf_id, COUNT(*) AS reddit_posts FROM {CLEAN} GROUP BY 1) USING (conf_id) LEFT JOIN (SELECT conf_id, COUNT(*) AS devto_articles FROM {{v_post}} GROUP BY 1) USING (conf_id)"""
SCORE = """ROUND(LEAST(100e0, 10e0 * ln(1 + 5e0 * COALESCE(hn_stories, 0) + 0.01e0 * COALESCE(hn_points, 0) + 2e0 * COALESCE(github_repos, 0) + 0.01e0 * COALESCE(github_stars, 0)
    + 1e0 * COALESCE(reddit_posts, 0) + 3e0 * COALESCE(devto_articles, 0))), 6)"""


@register("popularity_scores", "AGG-9", oracle=f"SELECT conf_id, {SCORE} AS popularity_score FROM ({NUMBERS})")
def _(t):
    return all_intel(t).select("conf_id", F.round(I.popularity_score(), 6).alias("popularity_score"))


@register("compact_intel", "AGG-10", oracle=f"""
    SELECT *, ROUND(LEAST(100e0, 8e0 * ln(1 + 0.4e0 * hn_score + 0.3e0 * github_score + 0.2e0 * reddit_score + 0.1e0 * devto_score)), 1) AS popularity_score FROM (
      SELECT conf_id, hn_points + hn_stories * 10 AS hn_score, github_stars + github_repos * 5 AS github_score, reddit_posts * 3 AS reddit_score, devto_articles * 5 AS devto_score FROM (
        SELECT conf_id, COALESCE(hn_points, 0) AS hn_points, COALESCE(hn_stories, 0) AS hn_stories, COALESCE(github_stars, 0) AS github_stars, COALESCE(github_repos, 0) AS github_repos,
               COALESCE(reddit_posts, 0) AS reddit_posts, COALESCE(devto_articles, 0) AS devto_articles FROM ({NUMBERS})))""")
def _(t):
    return I.compact_intel(all_intel(t)).select("conf_id", "hn_score", "github_score", "reddit_score", "devto_score", "popularity_score")


TOPIC_COLUMNS = ["hn_topics", "github_topics", "github_languages", "devto_tags", "reddit_subreddits"]


@register("intel_topics", "AGG-11", oracle=f"""
    WITH a AS (SELECT * FROM {{v_post}}), all_topics AS (
      SELECT conf_id, UNNEST(string_split(x, ',')) AS topic FROM (
        SELECT conf_id, x FROM ({top_list(f"(SELECT conf_id, UNNEST(regexp_extract_all(title, '{L.TITLE_WORD_PATTERN}')) AS w FROM {ABOUT})", 'w', 10, 'x')})
        UNION ALL SELECT conf_id, x FROM ({top_list('{v_repo}', 'language', 10, 'x')})
        UNION ALL SELECT conf_id, x FROM ({top_list('(SELECT conf_id, topic FROM {v_repo} UNION ALL SELECT conf_id, language FROM {v_repo} WHERE language IS NOT NULL)', 'topic', 20, 'x')})
        UNION ALL SELECT conf_id, x FROM ({top_list('(SELECT conf_id, kind AS tag FROM a UNION ALL SELECT conf_id, brand FROM a)', 'tag', 15, 'x')})
        UNION ALL SELECT conf_id, x FROM ({top_list(CLEAN, 'subreddit', 10, 'x')})))
    SELECT conf_id, array_to_string(list_sort(list(DISTINCT topic))[1:30], ',') AS intel_topics FROM all_topics GROUP BY conf_id""")
def _(t):
    return joined(I.intel_topics(all_intel(t), TOPIC_COLUMNS).select("conf_id", "intel_topics"), ["intel_topics"], []).filter("intel_topics IS NOT NULL")


@register("intel_urls", "AGG-11", oracle="""
    SELECT conf_id, array_to_string(list_sort(list(DISTINCT url))[1:50], ',') AS intel_urls FROM (
      SELECT conf_id, url FROM {v_post} UNION ALL SELECT conf_id, 'https://g.example/' || name FROM {v_repo}) GROUP BY conf_id""")
def _(t):
    urls = t.sql("SELECT conf_id, url FROM {v_post} UNION ALL SELECT conf_id, 'https://g.example/' || name FROM {v_repo}")
    return joined(I.intel_urls(urls), ["intel_urls"], [])


@register("calls_with_intel", "JN-3", oracle=f"""
    SELECT c.object_id, CASE WHEN n.conf_id IS NOT NULL THEN n.score ELSE CAST(c.popularity_score AS DOUBLE) END AS popularity_score,
           CASE WHEN n.conf_id IS NOT NULL THEN n.hn_stories ELSE c.hn_stories END AS hn_stories, CASE WHEN n.conf_id IS NOT NULL THEN n.reddit_posts ELSE c.reddit_posts END AS reddit_posts,
           l.github_languages, n.conf_id IS NOT NULL AS intel_enriched
    FROM {{v_cfp}} c LEFT JOIN (SELECT *, {SCORE} AS score FROM ({NUMBERS}) WHERE conf_id % 2 = 0) n ON n.conf_name = c.name || ' 2024'
    LEFT JOIN ({top_list('{v_repo}', 'language', 10, 'github_languages')}) l ON l.conf_id = n.conf_id""")
def _(t):
    intel = all_intel(t).filter("conf_id % 2 = 0").withColumn("popularity_score", F.round(I.popularity_score(), 6)).withColumn("name", F.regexp_replace("conf_name", " 2024$", ""))
    calls = t.view("v_cfp").withColumn("popularity_score", F.col("popularity_score").cast("double"))
    out = J.apply_intel(calls, intel).select("object_id", "popularity_score", "hn_stories", "reddit_posts", "github_languages", "intel_enriched")
    return joined(out, ["github_languages"], [])


@register("calls_with_all_intel", "JN-3", oracle=f"""
    SELECT c.object_id, CASE WHEN n.conf_id IS NOT NULL THEN n.score ELSE CAST(c.popularity_score AS DOUBLE) END AS popularity_score,
           CASE WHEN n.conf_id IS NOT NULL THEN n.hn_stories ELSE c.hn_stories END AS hn_stories, CASE WHEN n.conf_id IS NOT NULL THEN n.reddit_posts ELSE c.reddit_posts END AS reddit_posts,
           l.github_languages, n.conf_id IS NOT NULL AS intel_enriched
    FROM {{v_cfp}} c LEFT JOIN (SELECT *, {SCORE} AS score FROM ({NUMBERS})) n ON n.conf_name = c.name || ' 2024'
    LEFT JOIN ({top_list('{v_repo}', 'language', 10, 'github_languages')}) l ON l.conf_id = n.conf_id""")
def _(t):
    """The intel of every conference; names that no conference has stay without."""
    intel = all_intel(t).withColumn("popularity_score", F.round(I.popularity_score(), 6)).withColumn("name", F.regexp_replace("conf_name", " 2024$", ""))
    calls = t.view("v_cfp").withColumn("popularity_score", F.col("popularity_score").cast("double"))
    out = J.apply_intel(calls, intel).select("object_id", "popularity_score", "hn_stories", "reddit_posts", "github_languages", "intel_enriched")
    return joined(out, ["github_languages"], [])


# ---- split records ------------------------------------------------------------------------------
@register("split_intel_records", "SNK-4", oracle="""
    SELECT source, conf_id, total, LEAST(n, CASE source WHEN 'hn' THEN 50 ELSE 30 END) AS children FROM (
      SELECT 'hn' AS source, conf_id, COUNT(*) AS total, COUNT(*) AS n FROM {v_post} GROUP BY 2 UNION ALL SELECT 'github', conf_id, COUNT(*), COUNT(*) FROM {v_repo} WHERE post_id % 2 = 0 GROUP BY 2
      UNION ALL SELECT 'reddit', conf_id, CAST(5 AS BIGINT), CAST(0 AS BIGINT) FROM {v_conf} WHERE conf_id % 3 = 0)""")
def _(t):
    return split_bundles(t, t.view("v_repo").filter("post_id % 2 = 0"))


@register("split_all_intel_records", "SNK-4", oracle="""
    SELECT source, conf_id, total, LEAST(n, CASE source WHEN 'hn' THEN 50 ELSE 30 END) AS children FROM (
      SELECT 'hn' AS source, conf_id, COUNT(*) AS total, COUNT(*) AS n FROM {v_post} GROUP BY 2 UNION ALL SELECT 'github', conf_id, COUNT(*), COUNT(*) FROM {v_repo} GROUP BY 2
      UNION ALL SELECT 'reddit', conf_id, CAST(5 AS BIGINT), CAST(0 AS BIGINT) FROM {v_conf} WHERE conf_id % 3 = 0)""")
def _(t):
    return split_bundles(t, t.view("v_repo"))


def split_bundles(t: Tables, repositories: DataFrame) -> DataFrame:
    """Records per source from nested bundles, whose children are cut to the largest cap before they are grouped."""
    from rostrum.plans.skew import top_k_array

    posts = t.view("v_post").select("conf_id", "post_id", F.struct("title", "url").alias("item"))
    stories = top_k_array(posts, ["conf_id"], [F.col("post_id")], 50, F.col("item"), "stories")
    counts = posts.groupBy("conf_id").agg(F.count("*").alias("n_stories"))
    repos = repositories.select("conf_id", "post_id", F.struct("name", "stars").alias("item"))
    listed = top_k_array(repos, ["conf_id"], [F.col("post_id")], 50, F.col("item"), "repos")
    repo_counts = repos.groupBy("conf_id").agg(F.count("*").alias("n_repos"))
    none = F.array().cast("array<string>")
    bundles = t.view("v_conf").join(stories, "conf_id", "left").join(counts, "conf_id", "left").join(listed, "conf_id", "left").join(repo_counts, "conf_id", "left").select(
        "conf_id", "conf_name",
        F.struct("stories", F.col("n_stories").alias("total"), none.alias("titles"), none.alias("comments"), none.alias("authors")).alias("hn"),
        F.struct("repos", F.col("n_repos").alias("total")).alias("github"),
        F.struct(none.alias("posts"), F.when(F.col("conf_id") % 3 == 0, F.lit(5)).otherwise(F.lit(0)).cast("bigint").alias("total"), none.alias("comments")).alias("reddit"),
        F.struct(none.alias("articles"), F.lit(None).cast("bigint").alias("total")).alias("devto"),
    )
    out = None
    for source, rows in I.split_intel_records(bundles).items():
        part = rows.select(F.lit(source).alias("source"), "conf_id", "total", F.size(I.SOURCE_CHILDREN[source]).cast("bigint").alias("children"))
        out = part if out is None else out.unionByName(part)
    return out


# ---- repository audit ---------------------------------------------------------------------------
def _any(words: list[str]) -> str:
    return f"({duck_any('nm', words)} OR {duck_any('ds', words)})"


CLASSIFIED = f"""
    SELECT conf_id, post_id, stars, CASE
        WHEN near AND official THEN 'official|Official conference repo/site' WHEN near AND (contains(ow, 'org') OR contains(ow, k)) THEN 'official|Org repo: ' || ow
        WHEN lk AND tag IS NOT NULL AND official THEN 'official|Tagged with ' || tag
        {' '.join(f"WHEN {_any([w])} AND said THEN 'related|Conference {w}'" for w in L.REPO_RELATED_WORDS)}
        {' '.join(f"WHEN contains(nm, '{y}') AND contains(nm, k) THEN 'related|Year-specific repo ({y})'" for y in L.REPO_YEARS)}
        WHEN tag IS NOT NULL THEN 'related|Related by topic' WHEN contains(nm, 'awesome') OR contains(substr(ds, 1, 50), 'awesome') THEN 'noise|Awesome list'
        WHEN {_any(L.REPO_NOISE_WORDS)} THEN 'noise|Generic learning/collection repo' WHEN stars < 10 AND NOT said AND tag IS NULL THEN 'noise|Low relevance signals'
        WHEN lk AND said THEN 'related|Mentions conference name' ELSE 'noise|No clear connection' END AS c
    FROM (SELECT *, length(k) >= 4 AS lk, length(k) >= 4 AND (contains(nm, k) OR contains(k, nm)) AS near, {_any(L.REPO_OFFICIAL_WORDS)} AS official,
                 contains(nm, k) OR contains(ds, k) AS said, CASE WHEN contains(tp, k) THEN tp END AS tag
          FROM (SELECT conf_id, post_id, stars, lower(name) AS nm, lower(owner) AS ow, lower(COALESCE(description, '')) AS ds, lower(topic) AS tp,
                       CASE WHEN length(split_part(conf_name, ' ', 1)) > length(split_part(conf_name, ' ', 2)) THEN split_part(conf_name, ' ', 1)
                            WHEN length(split_part(conf_name, ' ', 1)) < length(split_part(conf_name, ' ', 2)) THEN split_part(conf_name, ' ', 2)
                            ELSE LEAST(split_part(conf_name, ' ', 1), split_part(conf_name, ' ', 2)) END AS k FROM {{v_repo}}))"""
SPLIT = f"SELECT conf_id, post_id, stars, split_part(c, '|', 1) AS category, split_part(c, '|', 2) AS reason FROM ({CLASSIFIED})"


def classified(t: Tables) -> DataFrame:
    rows = t.view("v_repo").withColumns({"full_name": F.concat_ws("/", "owner", "name"), "topics": F.array("topic")})
    return I.classify_repos(rows)


@register("repo_classes", "PG-16", "SET-3", oracle=f"SELECT post_id, category, reason FROM ({SPLIT})")
def _(t):
    return classified(t).select("post_id", "category", "reason")


@register("name_words", "SET-3", oracle="""
    SELECT conf_id, array_to_string(list_sort(list_filter(string_split(replace(conf_name, '-', ' ') , ' '), lambda x: x NOT IN ('2024', 'the', 'day'))), ',') AS words FROM {v_conf}""")
def _(t):
    rows = t.view("v_conf").withColumn("name", F.concat(F.lit("The "), "conf_name", F.lit("_Day")))
    return rows.select("conf_id", F.array_join(F.array_sort(I.name_parts(F.col("name"))), ",").alias("words"))


PRECISION = f"""SELECT conf_id, COUNT(*) AS repos, CAST(SUM(stars) AS BIGINT) AS total_stars, COUNT(*) FILTER (category = 'official') AS official, COUNT(*) FILTER (category = 'related') AS related,
    COUNT(*) FILTER (category = 'noise') AS noise, (COUNT(*) FILTER (category = 'official') + 0.5e0 * COUNT(*) FILTER (category = 'related')) / COUNT(*) AS quality FROM ({SPLIT}) GROUP BY conf_id"""


@register("repo_precision", "AGG-24", oracle=f"SELECT * REPLACE (ROUND(quality, 6) AS quality) FROM ({PRECISION})")
def _(t):
    return I.repo_precision(classified(t)).withColumn("quality", F.round("quality", 6))


@register("repo_verdict", "AGG-24", oracle=f"""
    SELECT ROUND(100e0 * o / n, 1) AS official_pct, ROUND(100e0 * r / n, 1) AS related_pct, ROUND(100e0 * x / n, 1) AS noise_pct, ROUND(q, 6) AS avg_quality,
           CASE WHEN (o + r) / n >= 0.6 THEN 'KEEP' WHEN (o + r) / n >= 0.3 THEN 'FILTER' ELSE 'DROP or MAJOR FILTER' END AS verdict
    FROM (SELECT SUM(official) AS o, SUM(related) AS r, SUM(noise) AS x, CAST(SUM(official) + SUM(related) + SUM(noise) AS DOUBLE) AS n, AVG(quality) AS q FROM ({PRECISION}))""")
def _(t):
    return I.precision_summary(I.repo_precision(classified(t)))


@register("star_distribution", "AGG-25", oracle="""
    SELECT MAX(stars) AS max, COUNT(*) FILTER (stars >= 1000) AS at_least_1000, COUNT(*) FILTER (stars >= 100) AS at_least_100, COUNT(*) FILTER (stars < 10) AS below_10,
           MAX(CASE WHEN i = n // 2 THEN stars END) AS median, MAX(CASE WHEN i = CAST(FLOOR(n * 0.1) AS BIGINT) THEN stars END) AS p90
    FROM (SELECT stars, ROW_NUMBER() OVER (ORDER BY stars DESC) - 1 AS i, COUNT(*) OVER () AS n FROM {v_repo})""")
def _(t):
    return I.star_distribution(t.view("v_repo"))


@register("noise_reasons", "AGG-26", oracle=f"SELECT reason, COUNT(*) AS n FROM ({SPLIT}) WHERE category = 'noise' GROUP BY reason")
def _(t):
    return I.noise_reasons(classified(t))


@register("top_quality_conferences", "WIN-16", oracle=f"SELECT conf_id, ROUND(quality, 6) AS quality FROM ({PRECISION}) ORDER BY quality DESC, total_stars DESC, conf_id LIMIT 5")
def _(t):
    return W.top_quality(I.repo_precision(classified(t))).select("conf_id", F.round("quality", 6).alias("quality"))
