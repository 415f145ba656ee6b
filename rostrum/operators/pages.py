"""Mining of raw web pages: structured data, platform rules, heuristics and call extraction.

A page table has ``page_url`` and ``html``. All is one narrow pass of column expressions. Values that
several rules read (visible text, parsed blocks, dates) are columns of their own, so that each is
computed once per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rostrum import lookups as L
from rostrum.functions import dates as D
from rostrum.functions import html as H
from rostrum.functions.arrays import topics_from_text
from rostrum.functions.cuts import RECORD, Cuts, cut_list, cut_text
from rostrum.functions.places import near_location
from rostrum.functions.text import blank_to_null, clean_search_text, contains_any, extract, let, matches, or_else, strip
from rostrum.operators.dedup import extract_record, merge_extracts
from rostrum.operators.projections import extracted_to_cfp
from rostrum.plans.storage import cut_lineage, spread, staged


def _strings() -> Column:
    return F.array().cast("array<string>")


# ---- JSON-LD ------------------------------------------------------------------------------------
# any field may hold text, an object or a list: read as text first, then again by its shape
_BLOCK = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("@type", "name", "description", "url", "startDate", "endDate", "location", "eventAttendanceMode", "keywords")
])
_PLACE = T.StructType([T.StructField(n, T.StringType()) for n in ("@type", "name", "address")])
_ADDRESS = T.StructType([T.StructField(n, T.StringType()) for n in ("addressLocality", "addressCountry")])
_SCRIPT = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""


def _is_object(text: Column) -> Column:
    return F.ltrim(text).startswith("{")


def _is_list(text: Column) -> Column:
    return F.ltrim(text).startswith("[")


def jsonld_events(pages: DataFrame, out: str = "jsonld", cuts: Cuts = RECORD) -> DataFrame:
    """Add the extract of the first event in the page's JSON-LD blocks, NULL when there is none."""
    none = F.array().cast(T.ArrayType(_BLOCK))
    scripts = F.regexp_extract_all("html", F.lit(_SCRIPT), F.lit(1))
    blocks = F.flatten(F.transform(scripts, lambda s: F.when(
        _is_list(s), F.coalesce(F.from_json(s, T.ArrayType(_BLOCK)), none)
    ).otherwise(F.array(F.from_json(s, _BLOCK)))))

    def is_event(block: Column) -> Column:
        kind = block["@type"]
        kinds = F.when(_is_list(kind), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
        return F.arrays_overlap(kinds, F.array(*[F.lit(t) for t in L.JSONLD_EVENT_TYPES]))

    found = F.when(F.contains("html", F.lit("ld+json")), F.get(F.filter(blocks, is_event), F.lit(0)))
    block, place = F.col("__block"), F.col("__place")
    where = block["location"]
    virtual = F.coalesce(place["@type"] == "VirtualLocation", F.lit(False))
    address = F.when(_is_object(place["address"]), F.from_json(place["address"], _ADDRESS))
    plain = F.when(~_is_object(where) & ~_is_list(where), where)
    plain_address = F.when(~_is_object(place["address"]) & ~_is_list(place["address"]), place["address"])
    raw = F.when(_is_object(where), F.when(~virtual, F.coalesce(blank_to_null(plain_address), place["name"]))).otherwise(plain)
    online = virtual | F.coalesce(contains_any(F.lower(plain), ["online", "virtual"]), F.lit(False))
    online = online | F.coalesce(F.contains(block["eventAttendanceMode"], F.lit("Online")), F.lit(False))
    words = block["keywords"]
    topics = F.when(_is_list(words), F.from_json(words, "array<string>")).otherwise(F.transform(F.split(words, ","), strip))
    record = extract_record(
        "schema.org", 0.8, name=block["name"], description=block["description"], url=block["url"],
        event_start_date=D.parse_any_date(block["startDate"]), event_end_date=D.parse_any_date(block["endDate"]),
        city=F.when(~virtual, address["addressLocality"]), country=F.when(~virtual, address["addressCountry"]),
        location_raw=raw, is_online=online, topics=cut_list(F.coalesce(topics, _strings()), cuts.topics),
    )
    rows = staged(pages, __block=found)
    rows = staged(rows, __place=F.when(_is_object(where), F.from_json(where, _PLACE)))
    return staged(rows, **{out: F.when(block.isNotNull(), record)}).drop("__block", "__place")


def _with_metas(pages: DataFrame) -> tuple[DataFrame, list[str]]:
    """The page rows with their meta tags staged, and the columns to drop again afterwards."""
    if "__metas" in pages.columns:
        return pages, []
    return staged(pages, __metas=H.meta_records(F.col("html"))), ["__metas"]


def opengraph(pages: DataFrame, out: str = "og") -> DataFrame:
    """Add the extract from ``og:`` tags (the last of a name counts), NULL when there is none."""
    rows, own = _with_metas(pages)
    tags = F.filter("__metas", lambda t: t["property"].startswith("og:") & (t["content"] != ""))

    def value(name: str) -> Column:
        hits = F.filter("__og", lambda t: t["property"] == f"og:{name}")
        return F.get(F.reverse(hits), F.lit(0))["content"]

    record = extract_record(
        "opengraph", 0.5, name=value("title"), description=value("description"), url=value("url"),
        event_start_date=D.parse_any_date(value("event:start_time")),
        event_end_date=D.parse_any_date(value("event:end_time")), location_raw=value("locale"),
    )
    rows = staged(rows, __og=tags)
    return staged(rows, **{out: F.when(F.size("__og") > 0, record)}).drop("__og", *own)


def meta_tags(pages: DataFrame, out: str = "meta", cuts: Cuts = RECORD) -> DataFrame:
    """Add the extract from title, description and keywords, NULL without title and description."""
    rows, own = _with_metas(pages)
    topics = cut_list(F.transform(F.split(H.meta_content(F.col("__metas"), "keywords"), ","), strip), cuts.topics)
    record = extract_record(
        "meta", 0.3, name=H.inner_text(F.col("html"), "title"), description=H.meta_content(F.col("__metas"), "description"),
        topics=F.coalesce(topics, _strings()),
    )
    known = blank_to_null(F.col("__meta.name")).isNotNull() | blank_to_null(F.col("__meta.description")).isNotNull()
    return staged(rows, __meta=record).withColumn(out, F.when(known, F.col("__meta"))).drop("__meta", *own)


def structured(pages: DataFrame, out: str = "structured", cuts: Cuts = RECORD) -> DataFrame:
    """Add the three structured extracts merged; repeated method names stay."""
    rows, _ = _with_metas(jsonld_events(pages, cuts=cuts))
    rows = meta_tags(opengraph(rows), cuts=cuts).drop("__metas")
    return merge_extracts(rows, ["jsonld", "og", "meta"], out, distinct_methods=False).drop("jsonld", "og", "meta")


# ---- platforms ----------------------------------------------------------------------------------
def _first_text(text: Column, patterns: list[str]) -> Column:
    """Date text of the first pattern that matches at all."""
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern in patterns:
        rule = rule.when(matches(text, pattern), extract(text, pattern))
    return rule


def _cut(text: Column, most: int | None) -> Column:
    return strip(cut_text(text, most))


def _short_tags(html: Column, words: str, most: int | None) -> Column:
    tags = F.filter(H.classed_text(html, words), lambda t: (t != "") & (F.length(t) < 50))
    return cut_list(tags, most)


def platform(pages: DataFrame, out: str = "platform", cuts: Cuts = RECORD) -> DataFrame:
    """Add the extract by the rules of the platform the link belongs to.

    NULL on other sites or without a name. Each field is a choice by site, so pages of other sites
    skip all rules, and every date text is parsed in one place.
    """
    html, text, site = F.col("html"), F.col("__flat"), F.col("__site")

    def by_site(**rules: Column) -> Column:
        chosen = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, rule in rules.items():
            chosen = chosen.when(site == name, rule)
        return chosen

    def first(words: str, tags: str) -> Column:
        return F.get(H.classed_text(html, words, tags), F.lit(0))

    h1 = H.inner_text(html, "h1")
    any_tag = r"[a-z][a-z0-9]*"
    main = or_else(
        F.regexp_extract(html, r"(?is)<main\b[^>]*>(.*?)</main\s*>", 1), F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article\s*>", 1)
    )
    section = F.coalesce(first("description|about", "section"), first("description|about|content", "div"))
    raw = {
        "__name": by_site(sessionize=h1, papercall=h1, pretalx=h1, eventbrite=first("event-title", "h1")),
        "__about": by_site(
            sessionize=_cut(first("description|about", "div"), cuts.description), papercall=_cut(section, cuts.description),
            pretalx=blank_to_null(cut_text(F.array_join(F.slice(H.paragraphs(main), 1, 2), " "), cuts.description)),
            eventbrite=_cut(first("structured-content|description", "div"), cuts.description),
        ),
        "__end": by_site(**{name: _first_text(text, patterns) for name, patterns in L.PLATFORM_DEADLINES.items() if patterns}),
        "__start_day": by_site(
            sessionize=extract(text, L.SESSIONIZE_EVENT_DATES, 1), papercall=extract(text, L.PAPERCALL_EVENT_DATE),
            eventbrite=extract(first("date-info|event-date", any_tag), L.EVENTBRITE_DATE),
        ),
        "__end_day": by_site(sessionize=extract(text, L.SESSIONIZE_EVENT_DATES, 2)),
        "__where": by_site(
            sessionize=_cut(_text_node_parent(html), cuts.place), papercall=strip(extract(text, L.PAPERCALL_LOCATION)),
            eventbrite=_cut(first("location-info|venue", any_tag), cuts.place),
        ),
        "__online": site.isin("sessionize", "papercall", "pretalx") & matches(text, L.ONLINE_PATTERN),
        "__tags": F.when(site == "sessionize", _short_tags(html, "tag|category|topic", cuts.topics)).when(
            site == "papercall", _short_tags(html, "tag|topic|track", cuts.topics)
        ).otherwise(_strings()),
    }
    lowered = F.lower("page_url")
    which = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, part in L.PLATFORM_URL_PART.items():
        which = which.when(F.contains(lowered, F.lit(part)), F.lit(name))
    sure = F.when(F.lit(False), F.lit(0.0))
    for name, confidence in L.PLATFORM_CONFIDENCE.items():
        sure = sure.when(site == name, F.lit(confidence))
    record = extract_record(
        site, sure, name=F.col("__name"), description=F.col("__about"), cfp_end_date=D.parse_any_date(F.col("__end")),
        event_start_date=D.parse_any_date(F.col("__start_day")), event_end_date=D.parse_any_date(F.col("__end_day")),
        location_raw=F.col("__where"), is_online=F.coalesce("__online", F.lit(False)), topics=F.col("__tags"),
    )
    rows = staged(pages, __site=which)
    rows = staged(rows, __flat=F.when(site.isNotNull(), H.visible_text(html, separator="")))
    rows = staged(rows, __raw=F.struct(*[value.alias(name) for name, value in raw.items()])).select("*", "__raw.*")
    named = F.when(blank_to_null(F.col("__name")).isNotNull(), record)
    return staged(rows, **{out: named}).drop("__site", "__flat", "__raw", *raw)


def _text_node_parent(html: Column) -> Column:
    """Text of the innermost element around the first text that says location or venue."""
    clean = H.drop_elements(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), ("script", "style"))
    inner = F.regexp_extract(clean, r"(?is)<([a-z][a-z0-9]*)\b[^>]*>([^<]*(?:location|venue)[^<]*(?:<(?!/\1)[^<]*)*)</\1", 2)
    return blank_to_null(strip(F.regexp_replace(inner, "<[^>]*>", "")))


# ---- heuristics ---------------------------------------------------------------------------------
CHROME = ("script", "style", "nav", "footer", "header", "aside")


def heuristics(pages: DataFrame, out: str = "heuristic", cuts: Cuts = RECORD) -> DataFrame:
    """Add the extract by wording alone: call phrases, dates and their context, headings, paragraphs."""
    body, text = F.col("__body"), F.col("__text")
    rows = staged(pages, __body=H.drop_elements(F.col("html"), CHROME))
    rows = staged(rows, __text=H.visible_text(body, ()))
    dated = F.transform(D.all_dates_with_context(text), lambda d, i: F.struct(
        d["day"].alias("day"), D.classify_date(d["context"]).alias("role"), i.alias("i")))
    rows = staged(rows, __dated=dated, __near=F.get(D.dates_near_keywords(text), F.lit(0)), __where=near_location(text))
    near, places = F.col("__near"), F.col("__dated")
    first_deadline = F.get(F.filter(places, lambda d: d["role"] == "cfp_deadline"), F.lit(0))
    # a date equal to the deadline is skipped from the moment the deadline is known
    rows = staged(
        rows, __deadline=F.coalesce(near, first_deadline["day"]),
        __known=F.when(near.isNotNull(), F.lit(-1)).otherwise(F.coalesce(first_deadline["i"], F.lit(1000000000))),
    )
    deadline, known = F.col("__deadline"), F.col("__known")

    def event_date(role: str) -> Column:
        hits = F.filter(
            places, lambda d: (d["role"] == role) & ~((d["i"] > known) & (d["day"] == F.coalesce(deadline, F.lit(""))))
        )
        return F.get(hits, F.lit(0))["day"]

    def bonus(flag: Column) -> Column:
        return F.when(flag, F.lit(0.2)).otherwise(F.lit(0.0))

    name = F.coalesce(H.inner_text(body, "h1"), H.inner_text(body, "title"))
    paragraphs = F.filter(H.paragraphs(body), lambda p: F.length(p) > 100)
    called = let(F.lower(text), lambda lowered: contains_any(lowered, L.CFP_PHRASES))
    base = F.when(called, F.lit(0.4)).otherwise(F.lit(0.1))
    sure = F.least(base + bonus(near.isNotNull()) + bonus(deadline.isNotNull()), F.lit(1.0))
    record = extract_record(
        "heuristics", F.round(sure, 6), name=cut_text(name, cuts.name),
        description=cut_text(F.get(paragraphs, F.lit(0)), cuts.description), cfp_end_date=deadline,
        event_start_date=event_date("event_start"), event_end_date=event_date("event_end"),
        location_raw=F.col("__where.location"), is_online=F.col("__where.is_online"), topics=topics_from_text(text),
        full_text=clean_search_text(text),
    )
    return staged(rows, **{out: record}).drop("__body", "__text", "__dated", "__near", "__where", "__deadline", "__known")


# ---- the whole extraction -----------------------------------------------------------------------
def extract_pages(pages: DataFrame, cuts: Cuts = RECORD) -> DataFrame:
    """Add the merged extract ``e`` of every page."""
    parts = ["platform", "structured", "heuristic"]
    return merge_extracts(heuristics(structured(platform(spread(pages, "page_url"), cuts=cuts), cuts=cuts), cuts=cuts), parts, "e").drop(*parts)


def extract_cfps(pages: DataFrame, minimum: float = 0.2, source: str = "extracted", cuts: Cuts = RECORD) -> tuple[DataFrame, DataFrame]:
    """Calls found on pages, and one outcome per page.

    ``pages``: ``page_url, html`` and optionally ``cfp_url, name_hint`` and the fetch's ``error_reason``.
    Outcomes carry ``ok``, ``error_reason`` and ``is_spa`` for the crawl store; a page without html has
    failed for the fetch's reason, NULL if that is unknown. The mined rows are stored once, without the pages, for both.
    """
    for name in ("cfp_url", "name_hint", "error_reason"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast("string"))
    has_html = F.coalesce(blank_to_null(F.col("html")).isNotNull(), F.lit(False))
    mined = extract_pages(pages.filter(has_html).drop("error_reason"), cuts)
    rows = cut_lineage(mined.select("page_url", "cfp_url", "name_hint", "e", H.is_spa_shell(F.col("html")).alias("is_spa")))
    named = or_else(F.col("e.name"), F.col("name_hint")).isNotNull()
    sure = F.col("e.confidence") >= minimum
    fields = [F.col(f"e.{f}").alias(f) for f in (
        "name", "description", "cfp_end_date", "cfp_start_date", "event_start_date", "event_end_date", "city", "country",
        "location_raw", "topics", "full_text", "is_online",
    )]
    calls = extracted_to_cfp(rows.filter(sure).select("page_url", "cfp_url", "name_hint", *fields), source)
    outcomes = rows.select(
        F.col("page_url").alias("url"), (sure & named).alias("ok"),
        F.when(~sure, F.lit("low_confidence")).alias("error_reason"), "is_spa",
        F.round("e.confidence", 6).alias("confidence"), F.col("e.extraction_method").alias("method"),
    )
    blank = pages.filter(~has_html).select(
        F.col("page_url").alias("url"), F.lit(False).alias("ok"), "error_reason", F.lit(False).alias("is_spa"),
        F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("method"),
    )
    return calls, outcomes.unionByName(blank)


# ---- relevant lines -----------------------------------------------------------------------------
def relevant_lines(pages: DataFrame, key: str = "page_id", context: int = 2, limit: int = 100) -> DataFrame:
    """Lines near call vocabulary, distinct in order of first use, at most ``limit`` per page.

    ``(key, line_no, line)`` rows. A line counts when one of the lines up to ``context`` away is a hit.
    The work stays inside each row (arrays), so no page is shuffled.
    """
    html = F.regexp_replace(F.regexp_replace("html", r"(?s)<!--.*?-->", ""), r"(?i)<!doctype[^>]*>", "")
    clean = H.drop_elements(html, ("script", "style", "nav", "footer", "header"))
    main = or_else(*[F.regexp_extract(clean, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1) for tag in ("main", "article")])
    text = H.decode_entities(F.regexp_replace(F.coalesce(main, clean), "<[^>]*>", "\n"))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    rows = pages.select(key, lines.alias("lines"))
    hits = F.transform("lines", lambda s: contains_any(F.lower(s), L.RELEVANT_LINE_WORDS))
    rows = rows.withColumn("hits", hits)
    near = F.filter(
        F.transform("lines", lambda s, i: F.struct(
            s.alias("line"),
            F.exists(F.slice("hits", F.greatest(i + 1 - context, F.lit(1)), F.least(i, F.lit(context)) + context + 1), lambda h: h).alias("near"),
        )),
        lambda e: e["near"],
    )
    distinct = F.slice(F.array_distinct(F.transform(near, lambda e: e["line"])), 1, limit)
    return rows.select(key, F.posexplode(distinct).alias("line_no", "line"))

