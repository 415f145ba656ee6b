"""Feed and file readers. Rows that do not fit the schema go to a quarantine table, not to an error.

Feed readers return ``Feed(rows, quarantine)``; the quarantine keeps the raw text and what could be parsed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions.text import slugify
from rostrum.sources import schemas as S

BAD = "_corrupt_record"


class Feed(NamedTuple):
    """The usable rows of a feed, and the rest."""

    rows: DataFrame
    quarantine: DataFrame


def _json(spark: SparkSession, path: str | Sequence[str], schema: str, multi_line: bool) -> DataFrame:
    return (
        spark.read.schema(f"{schema}, {BAD} STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
        .option("multiLine", multi_line)
        .json(path)
    )


def split_quarantine(rows: DataFrame, required: Sequence[str]) -> Feed:
    """Good rows (all ``required`` columns known) and the rest with its raw text."""
    known = F.lit(True)
    for name in required:
        known = known & F.col(name).isNotNull()
    good = known & F.col(BAD).isNull() if BAD in rows.columns else known
    good = F.coalesce(good, F.lit(False))
    return Feed(rows.filter(good).drop(BAD), rows.filter(~good))


def read_aggregator_feed(spark: SparkSession, path: str, multi_line: bool = True) -> Feed:
    """JSON with the payload ``{"cfps": […]}`` or a bare array (or lines) of rows."""
    wrapped = _json(spark, path, f"cfps ARRAY<STRUCT<{_as_struct(S.AGGREGATOR)}>>, {S.AGGREGATOR}", multi_line)
    fields = [n for n in wrapped.columns if n not in ("cfps", BAD)]
    own = F.array(F.struct(*fields, BAD))
    listed = F.transform("cfps", lambda r: F.struct(*[r[f].alias(f) for f in fields], F.lit(None).cast("string").alias(BAD)))
    rows = wrapped.select(F.inline(F.when(F.col("cfps").isNotNull(), listed).otherwise(own)))
    return split_quarantine(rows, ["name", "uri"])


def _as_struct(schema: str) -> str:
    return ", ".join(": ".join(f.strip().split(" ", 1)) for f in schema.split(","))


def read_topic_files(spark: SparkSession, glob: str, multi_line: bool = True) -> Feed:
    """One JSON array per topic; the topic is the file (or folder) name without ``.json``."""
    rows = _json(spark, glob, S.TOPIC_FILE, multi_line)
    topic = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json(?:/[^/]*)?$", 1)
    return split_quarantine(rows.withColumn("topic", F.url_decode(topic)), ["name", "url"])


def read_deadlines_feed(spark: SparkSession, path: str, as_of_year: int, multi_line: bool = True) -> Feed:
    """Academic deadlines of this year and later; ``sub`` may be one subject or a list."""
    rows, bad = split_quarantine(_json(spark, path, S.DEADLINES, multi_line), ["title", "year", "id"])
    listed = F.from_json("sub", "array<string>")
    one = F.when(F.col("sub").isNotNull(), F.array("sub"))
    subjects = F.when(F.col("sub").startswith("["), listed).otherwise(one)
    return Feed(rows.filter(F.col("year") >= as_of_year).withColumn("sub", subjects), bad)


def read_devevents_feed(spark: SparkSession, path: str, multi_line: bool = True) -> Feed:
    return split_quarantine(_json(spark, path, S.DEV_EVENTS, multi_line), ["link", "conf"])


def read_cfplist_feed(spark: SparkSession, path: str, multi_line: bool = True) -> Feed:
    """Link provider rows ``url, name, cfp_url``; rows without a link are quarantined."""
    rows = _json(spark, path, S.CFP_LIST, multi_line)
    good, bad = split_quarantine(rows.withColumn("link", F.nullif("link", F.lit(""))), ["link"])
    return Feed(good.select(F.col("link").alias("url"), F.col("conferenceName").alias("name"), F.col("cfpLink").alias("cfp_url")), bad)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One link per line; ``#`` starts a comment, blank lines do not count."""
    url = F.trim(F.get(F.split("value", "#"), F.lit(0)))
    return spark.read.text(path).select(url.alias("url")).filter("url <> ''")


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EVENTS_CSV).option("header", True).csv(path)


def read_alias_file(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """``alias_slug, canonical_slug, display_name`` from a speaker seed file.

    Aliases listed with a speaker override the file-level ``name_aliases``.
    """
    data = spark.read.schema(S.ALIAS_FILE).option("multiLine", multi_line).json(path)
    speakers = data.select(F.inline("speakers")).filter(F.col("name").isNotNull())
    people = speakers.select(slugify(F.col("name")).alias("canonical_slug"), "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    listed = people.select(F.explode("aliases").alias("alias_slug"), "canonical_slug", F.lit(0).alias("priority"))
    general = data.select(F.explode("name_aliases").alias("alias_slug", "canonical_slug")).withColumn("priority", F.lit(1))
    pairs = listed.filter("alias_slug <> canonical_slug").unionByName(general)
    chosen = pairs.groupBy("alias_slug").agg(F.min_by("canonical_slug", F.struct("priority", "canonical_slug")).alias("canonical_slug"))
    names = people.groupBy("canonical_slug").agg(F.min("name").alias("display_name"))
    return chosen.join(names, "canonical_slug", "left").select("alias_slug", "canonical_slug", "display_name")


def seed_slugs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Slugs of the seed speakers themselves."""
    data = spark.read.schema(S.ALIAS_FILE).option("multiLine", multi_line).json(path)
    return data.select(F.inline("speakers")).select(slugify(F.col("name")).alias("slug")).distinct()


def sequence_of(*columns: str) -> Column:
    """A sortable place for rows that come in no order of their own."""
    return F.struct(*[F.col(c) for c in columns])
