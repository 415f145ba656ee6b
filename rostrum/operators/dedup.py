"""De-duplication and record merging."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions.text import blank_to_null, or_else, url_key
from rostrum.plans.skew import first_per_key
from rostrum.plans.storage import cut_lineage, new_path, staged


def with_dedup_keys(cfps: DataFrame, order: Sequence[str] = ("source_rank", "seq"), preferred: str = L.PREFERRED_SOURCE, name_letters: int = 30) -> DataFrame:
    """Add ``url_key``, ``name_key`` (``name_letters`` letters) and the sortable ``place`` of each call (preferred source first)."""
    own = F.when(F.col("source") == preferred, F.lit(0)).otherwise(F.lit(1))
    order = [c for c in order if c in cfps.columns]
    links = [F.col(c) for c in ("cfp_url", "url") if c in cfps.columns]
    name = F.replace(F.replace(F.lower("name"), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    return cfps.withColumns({
        "url_key": blank_to_null(url_key(or_else(*links))),
        "name_key": F.substring(name, 1, name_letters),
        "place": F.struct(own.alias("preferred"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("object_id").alias("id")),
    })


def dedup_cfps(cfps: DataFrame, order: Sequence[str] = ("source_rank", "seq")) -> DataFrame:
    """Greedy two-key de-duplication, as if rows came one by one in ``place`` order.

    A row is dropped when its link or its name equals that of an earlier *kept* row, so a dropped row
    blocks nothing. Rounds find all rows that are first for both their keys, keep them and remove
    every row that shares a key with them. Whole rows stay out of the rounds: they run over distinct
    (link, name) pairs only, of which the first row alone can win. Minima are combined on the map
    side, winners are found by joining the two minimum tables on the row place, and each round's
    winners are added to one stored table. The rounds end when no row is left, however long a chain is.
    """
    keyed = with_dedup_keys(cfps, order)
    edges = keyed.groupBy("url_key", "name_key").agg(F.min("place").alias("place"))
    left = cut_lineage(edges)
    path = new_path(cfps.sparkSession, "winners")
    for number in count():
        by_url = left.filter("url_key IS NOT NULL").groupBy("url_key").agg(F.min(F.struct("place", "name_key")).alias("m"))
        by_name = left.groupBy("name_key").agg(F.min(F.struct("place", "url_key")).alias("m"))
        first_url = by_url.select(F.col("m.place").alias("place"), "url_key")
        first_name = by_name.select(F.col("m.place").alias("place"), "name_key", F.col("m.url_key").alias("own_url"))
        winners = first_name.join(first_url, "place", "left").filter("url_key IS NOT NULL OR own_url IS NULL")
        winners = winners.select("place", F.col("own_url").alias("url_key"), "name_key")
        winners.write.parquet(f"{path}/round={number}")
        winners = cfps.sparkSession.read.schema(winners.schema).parquet(f"{path}/round={number}")
        left = cut_lineage(
            left.join(winners.select("name_key"), "name_key", "left_anti").join(
                winners.filter("url_key IS NOT NULL").select("url_key"), "url_key", "left_anti"
            )
        )
        if left.isEmpty():
            break
    kept = cfps.sparkSession.read.schema(winners.schema).parquet(path)
    return keyed.join(kept.select("place"), "place", "left_semi").drop("url_key", "name_key", "place")


def merge_topics_on_name_dup(cfps: DataFrame, order: Sequence[str] = ("source_rank", "seq")) -> DataFrame:
    """Normalised topics of kept calls after name duplicates have added theirs.

    Of the rows with one name the first is the base; a later one with more topics than collected so
    far adds its topics. After a set of some size at least so many are collected, so of equal sizes only
    the first set can add anything (but for lists that repeat a topic): a name keeps a few entries,
    however many rows it has.
    """
    keyed = with_dedup_keys(cfps, order)
    topics = F.array_sort(F.array_distinct("topics_normalized"))
    sets = keyed.select("name_key", "place", topics.alias("topics"), F.size("topics_normalized").alias("size"))
    repeating = F.when(F.size("topics") < F.col("size"), F.col("topics"))
    firsts = sets.groupBy("name_key", "size", repeating.alias("repeating")).agg(F.min(F.struct("place", "topics")).alias("f"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("f.place").alias("place"), "size", F.col("f.topics").alias("topics"))))
    grow = lambda acc, e: F.when(
        e["size"] > F.size(acc), F.array_sort(F.array_union(acc, e["topics"]))
    ).otherwise(acc)
    return firsts.groupBy("name_key").agg(entries.alias("e")).select(
        "name_key", F.aggregate("e", F.array().cast("array<string>"), grow).alias("topics_normalized")
    )


def first_seen_distinct(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each non-empty key."""
    return first_per_key(df.filter(F.col(key) != ""), [key], [F.col(c) for c in order])


def distinct_speakers(talks: DataFrame) -> DataFrame:
    names = F.array_union(F.array("speaker"), F.coalesce("speakers", F.array().cast("array<string>")))
    rows = talks.select(F.explode(names).alias("speaker")).filter("speaker <> ''")
    return rows.distinct().orderBy("speaker")


# ---- crawl store --------------------------------------------------------------------------------
def url_store_add(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Store with a batch of ``url, source, name, cfp_url, seq`` added; ``is_new`` marks new rows.

    Links are compared without trailing ``/``. The first entry of a new link gives its source; the first
    non-empty name and call link fill empty ones, in the store too.
    """
    key = F.regexp_replace("url", "/+$", "")
    filled = batch.filter(F.col("url").isNotNull()).select(
        key.alias("url"), "source", blank_to_null(F.col("name")).alias("name"), blank_to_null(F.col("cfp_url")).alias("cfp_url"), "seq", "added_at"
    )

    def first_known(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("seq")))

    new = filled.groupBy("url").agg(
        F.min_by("source", "seq").alias("n_source"), first_known("name").alias("n_name"),
        first_known("cfp_url").alias("n_cfp_url"), F.min("added_at").alias("n_added_at"),
    )
    merged = store.withColumn("__known", F.lit(True)).join(new, "url", "full")
    is_new = F.col("__known").isNull()
    merged = merged.withColumns({
        "name": F.coalesce(blank_to_null(F.col("name")), F.col("n_name")),
        "cfp_url": F.coalesce(blank_to_null(F.col("cfp_url")), F.col("n_cfp_url")),
        "source": F.coalesce("source", "n_source"), "added_at": F.coalesce("added_at", "n_added_at"),
        "is_new": is_new,
    })
    defaults = {"extracted": False, "extraction_failed": False, "retry_count": 0, "max_retries_reached": False, "is_spa": False}
    for name, value in defaults.items():
        if name in store.columns:
            merged = merged.withColumn(name, F.when(is_new, F.lit(value)).otherwise(F.col(name)))
    return merged.drop("__known", "n_source", "n_name", "n_cfp_url", "n_added_at")


# ---- extracts -----------------------------------------------------------------------------------
EXTRACT_FIELDS = {
    "name": "string", "description": "string", "url": "string", "cfp_end_date": "string",
    "cfp_start_date": "string", "event_start_date": "string", "event_end_date": "string", "city": "string",
    "country": "string", "location_raw": "string", "is_online": "boolean", "topics": "array<string>",
    "full_text": "string",
}
EXTRACT_TYPE = (
    "struct<" + ",".join(f"{n}:{t}" for n, t in EXTRACT_FIELDS.items()) + ",extraction_method:string,confidence:double>"
)


def extract_record(method: Column | str, confidence: Column | float, **fields: Column) -> Column:
    """One page extract; fields that are not given are empty."""
    method = F.lit(method) if isinstance(method, str) else method
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    columns = []
    for name, kind in EXTRACT_FIELDS.items():
        value = fields.get(name)
        if value is None:
            value = F.lit(False) if kind == "boolean" else F.lit(None)
            if kind.startswith("array"):
                value = F.array()
        columns.append(value.cast(kind).alias(name))
    return F.struct(*columns, method.alias("extraction_method"), confidence.cast("double").alias("confidence"))


def _field(records: Column, name: str) -> Column:
    return F.transform(records, lambda r: r[name])


def merge_extracts(
    df: DataFrame, records: Sequence[str], out: str, distinct_methods: bool = True, positive_only: bool = True
) -> DataFrame:
    """Merge the extract columns ``records`` into the column ``out``.

    The surest record is the base, the others fill its empty text and lists. ``is_online`` is never
    empty, so it always comes from the base. NULL records are skipped. The ranked list is a column of
    its own, so it is built once per row and not once per field.
    """
    listed = F.filter(
        F.array(*[F.col(r) for r in records]),
        lambda r: r.isNotNull() & ((r["confidence"] > 0) if positive_only else F.lit(True)),
    )
    ranked = F.array_sort(
        F.transform(listed, lambda r, i: F.struct((-r["confidence"]).alias("c"), i.alias("i"), r.alias("r")))
    )
    ordered = F.col("__ordered")
    base = F.get(ordered, F.lit(0))
    columns = []
    for name, kind in EXTRACT_FIELDS.items():
        if kind == "boolean":
            value = F.coalesce(base[name], F.lit(False))
        elif kind.startswith("array"):
            full = F.filter(_field(ordered, name), lambda v: F.size(v) > 0)
            value = F.coalesce(F.get(full, F.lit(0)), F.array().cast(kind))
        else:
            full = F.filter(_field(ordered, name), lambda v: v != "")
            value = F.coalesce(F.get(full, F.lit(0)), base[name])
        columns.append(value.alias(name))
    methods = F.filter(F.transform(ordered, lambda r: r["extraction_method"]), lambda m: m != "")
    methods = F.array_distinct(methods) if distinct_methods else methods
    method = F.when(F.size(ordered) > 0, F.array_join(methods, "+")).otherwise(F.lit("none"))
    merged = F.struct(
        *columns, method.alias("extraction_method"), F.coalesce(base["confidence"], F.lit(0.0)).alias("confidence")
    )
    rows = staged(df, __ordered=F.transform(ranked, lambda e: e["r"]))
    return staged(rows, **{out: merged}).drop("__ordered")


# ---- graph nodes --------------------------------------------------------------------------------
def merge_conference_nodes(nodes: DataFrame) -> DataFrame:
    """Most talks and the first channel link of each conference; the rest from its first row."""
    return nodes.groupBy("conference_id").agg(
        F.min_by("name", "seq").alias("name"), F.max("talk_count").alias("talk_count"),
        F.min_by("channel_url", F.when(F.col("channel_url") != "", F.col("seq"))).alias("channel_url"),
    )


def merge_speaker_nodes(nodes: DataFrame) -> DataFrame:
    """Largest counts of each speaker; conferences are the rows of ``speaker_node_conferences``."""
    return nodes.groupBy("slug").agg(
        F.min_by("name", "seq").alias("name"), F.max("talk_count").alias("talk_count"), F.max("total_views").alias("total_views"),
    )


def speaker_node_conferences(nodes: DataFrame) -> DataFrame:
    """Distinct conferences of each speaker with the place of their first mention."""
    rows = nodes.select("slug", "seq", F.posexplode("conferences").alias("pos", "conference"))
    return rows.groupBy("slug", "conference").agg(F.min(F.struct("seq", "pos")).alias("first")).select("slug", "conference", "first.*")

