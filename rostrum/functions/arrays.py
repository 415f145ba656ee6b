"""Array, JSON and number columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum import lookups as L
from rostrum.functions.text import collapse, let, normalize_tag, strip


def clean_tags(tags: Column) -> Column:
    """Trimmed tags without blanks."""
    return F.filter(F.transform(tags, strip), lambda t: t != "")


def title_case(text: Column) -> Column:
    """First letter of every letter run upper, the rest lower."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def canonical_tags(tags: Column, extra: Mapping[str, str] | None = None) -> Column:
    """Canonical tags in order of first occurrence."""
    return F.array_distinct(F.transform(tags, lambda t: normalize_tag(t, extra)))


def tags_changed(tags: Column, extra: Mapping[str, str] | None = None) -> Column:
    return ~tags.eqNullSafe(canonical_tags(tags, extra))


def topics_from_text(text: Column, limit: int = 15) -> Column:
    """Listed topics and known technology words in a page text, sorted, at most ``limit``."""
    section = F.nullif(F.regexp_extract(text, L.TOPICS_INCLUDE_PATTERN, 1), F.lit(""))
    section = F.when(F.contains(F.lower(text), F.lit("topic")), section)
    listed = F.transform(F.split(section, r"[,;]|\band\b"), strip)
    listed = F.filter(listed, lambda t: (F.length(t) > 3) & (F.length(t) < 50))
    known = let(F.lower(text), lambda lowered: F.array_compact(
        F.array(*[F.when(F.contains(lowered, F.lit(w)), F.lit(w.title())) for w in L.TOPIC_WORDS])
    ))
    return F.slice(F.array_sort(F.array_union(F.coalesce(listed, F.array().cast("array<string>")), known)), 1, limit)


def drop_empty(record: Column) -> Column:
    """JSON text of a struct; NULL fields are left out. Empty text and arrays must be NULL already."""
    return F.to_json(record, {"ignoreNullFields": "true"})


def null_if_empty(values: Column) -> Column:
    return F.when(F.size(values) > 0, values)


def _valid_json(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), text)


def rescue_json(text: Column) -> Column:
    """JSON text in a free answer: the whole, a fenced block or the first flat object."""
    fenced = F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1)
    plain = F.regexp_extract(text, r"(?s)```\s*(.*?)```", 1)
    flat = F.regexp_extract(text, r"(?s)\{[^{}]*\}", 0)
    return F.coalesce(
        *[_valid_json(F.nullif(strip(part), F.lit(""))) for part in (text, fenced, plain, flat)]
    )


def rescue_json_array(text: Column, schema: str = "array<string>") -> Column:
    """The outermost ``[…]`` of a free answer as an array; empty when there is none."""
    part = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    parsed = F.from_json(part, schema, {"mode": "PERMISSIVE"})
    return F.coalesce(F.when(part != "", parsed), F.array().cast(schema))


ENRICHMENT_LISTS = ("keywords", "topics", "quotes")


def parsed_enrichment(answers: DataFrame) -> DataFrame:
    """Lists of keywords, topics and quotes from the free answers in columns of these names, kept whole."""
    return answers.withColumns({c: rescue_json_array(F.col(c)) for c in ENRICHMENT_LISTS if c in answers.columns})


def bounded_enrichment(enriched: DataFrame, keywords: int = 20, topics: int = 10, quotes: int = 10) -> DataFrame:
    """The lists cut to what an exported record holds; the table itself keeps them whole."""
    most = dict(zip(ENRICHMENT_LISTS, (keywords, topics, quotes), strict=True))
    return enriched.withColumns({c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n) for c, n in most.items() if c in enriched.columns})


CAPTIONS = T.StructType().add(
    "events", T.ArrayType(T.StructType().add("segs", T.ArrayType(T.StructType().add("utf8", T.StringType()))))
)


def flatten_captions(json_text: Column) -> Column:
    """Caption JSON to running text; NULL when nothing is said."""
    segments = F.flatten(
        F.transform(
            F.from_json(json_text, CAPTIONS)["events"],
            lambda e: F.coalesce(
                F.transform(e["segs"], lambda s: s["utf8"]), F.array().cast("array<string>")
            ),
        )
    )
    said = F.filter(
        segments, lambda s: s.isNotNull() & (strip(s) != "") & ~s.isin(L.CAPTION_NOISE)
    )
    return F.nullif(collapse(F.array_join(F.transform(said, strip), " ")), F.lit(""))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371 km."""
    d_lat, d_lng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(d_lng / 2), 2)
    return F.lit(2.0) * 6371 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def distance_label(km: Column) -> Column:
    """Whole kilometres below 100 km, tens above."""
    near = F.floor(km + 0.5).cast("string")
    far = (F.floor(km / 10 + 0.5) * 10).cast("string")
    return F.concat(F.when(km < 100, near).otherwise(far), F.lit(" km"))


def _steps(value: Column, ladder: list[tuple[int, int]], default: int) -> Column:
    first, *rest = ladder
    out = F.when(value > first[0], F.lit(first[1]))
    for bound, weight in rest:
        out = out.when(value > bound, F.lit(weight))
    return out.otherwise(F.lit(default))


def talk_weight(views: Column, popularity: Column) -> Column:
    """How many events a talk stands for."""
    views, popularity = F.coalesce(views, F.lit(0)), F.coalesce(popularity, F.lit(0.0))
    few = F.when(popularity > 50, F.lit(2)).otherwise(F.lit(1))
    return F.when(views > 1000, _steps(views, [(100000, 15), (50000, 10), (10000, 7), (1000, 4)], 0)).otherwise(few)


def cfp_weight(hn_points: Column, github_stars: Column, popularity: Column) -> Column:
    """How many events a call stands for, at most 25."""
    zero = F.lit(0)
    return F.least(
        F.lit(25),
        F.lit(2)
        + _steps(F.coalesce(hn_points, zero), [(100, 8), (50, 5), (10, 3), (0, 2)], 0)
        + _steps(F.coalesce(github_stars, zero), [(1000, 6), (100, 3), (0, 1)], 0)
        + _steps(F.coalesce(popularity, zero), [(80, 4), (50, 2), (20, 1)], 0),
    )
