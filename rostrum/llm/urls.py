"""URL filters: host-suffix and path-prefix expressions joined with a rule table by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.tools import partitions, table

#: fixed values: the rules of the query, (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# hexadecimal digits of the digest that the join uses; the whole digest confirms
PREFIX_DIGITS = 8
# rule tables up to this many rows are sent to every executor (about 200 bytes a row)
BROADCAST_RULES = 50_000
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), CAPITALS, SMALLS), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # no host holds a slash, and a path is empty or begins with one, so the concatenation is unambiguous
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    ``rules`` has ``verdict`` (allow or block), ``host`` and ``path``; a rule fits its host and all subdomains
    where the url's path begins with the rule's. Each url is expanded into the host suffixes and path prefixes
    whose label counts and lengths some rule has (so their number is bounded by the rules, whatever the url);
    expressions meet rules on a short prefix of their SHA-256, the whole digest confirms a hit, and of several
    hits the longest rule wins (then the longer host, then block before allow). Without a hit the verdict is
    ``default``.

    Small rule tables (a counted bound) are broadcast; larger ones are replicated over ``salts`` and joined by
    shuffle, so an expression that a third of all urls share is split. Null urls and urls without ``://`` have
    empty host and path and no rule. Rows that repeat stay repeated; columns of ``pages`` keep their values, a
    column named like one of the four results is replaced. Rules with null host or path never fit.
    """
    spark = pages.sparkSession
    known = (
        rules.select("verdict", F.translate("host", CAPITALS, SMALLS).alias("host"), "path").dropna().distinct()
        .withColumn("digest", _digest(F.col("host"), F.col("path")))
        .groupBy("digest").agg(
            F.max("verdict").alias("verdict"), F.first("host").alias("rule_host"), F.first("path").alias("rule_path"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    # lengths are properties of the rule table: at most as many as a host has labels and a path characters
    shape = known.agg(
        F.sort_array(F.collect_set(F.size(F.split("rule_host", "[.]")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    labels, lengths = list(shape["labels"]), list(shape["lengths"])

    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    base = pages.select(*[F.col(f"`{c}`") for c in kept], url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    # a number per row keeps repeated rows apart; only it and the hit travel through the join
    if not labels:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    host, path = F.col("host"), F.col("path")
    count = F.size(F.split(host, "[.]"))
    suffixes = F.array(*[F.when(count >= n, F.substring_index(host, ".", -n)) for n in labels])
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    pairs = F.flatten(F.transform(
        F.array_compact(suffixes), lambda h: F.transform(F.array_compact(prefixes), lambda p: F.struct(h.alias("h"), p.alias("p")))))
    # an empty host suffix never names a host
    pairs = F.filter(pairs, lambda e: e["h"] != "")
    # hits are looked up once for each distinct pair of host and path lead, and joined back to the rows
    lead = F.struct(host.alias("host"), F.substring(path, 1, max(lengths)).alias("lead"))
    located = base.withColumn("__lead", lead)
    expressions = (
        located.select("__lead", "host", F.substring("path", 1, max(lengths)).alias("path")).distinct()
        .withColumn("__e", F.explode(pairs))
        .select("__lead", _digest(F.col("__e.h"), F.col("__e.p")).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    if shape["n"] <= BROADCAST_RULES:
        hits = expressions.join(F.broadcast(known), ["prefix", "digest"])
    else:
        salts = salts or partitions(spark)
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = expressions.withColumn("salt", F.pmod(F.xxhash64("__lead"), F.lit(salts)).cast("int"))
        hits = salted.join(spread, ["prefix", "digest", "salt"])
    longest = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"), "verdict",
        F.concat("rule_host", "rule_path").alias("rule"))
    best = hits.groupBy("__lead").agg(F.max(longest).alias("__hit"))
    # few leads have many urls and most have one: AQE splits the hot ones
    joined = located.join(best, "__lead", "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("__hit.rule").alias("rule"),
        F.coalesce("__hit.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH rules(rule_verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT row_number() OVER () AS n, page_id,
  CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT n, page_id,
  translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (SELECT n, page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
  row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM hits WHERE place = 1
"""
