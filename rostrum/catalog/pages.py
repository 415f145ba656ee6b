"""Page mining, speaker-call mining and the crawl store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.catalog.functions import duck_any
from rostrum.catalog.registry import Tables, register
from rostrum.operators import dedup as D
from rostrum.operators import pages as P
from rostrum.operators import speaker_calls as C
from rostrum.operators import state as S
from rostrum.plans import jobs
from rostrum.plans.proxies import AS_OF
from rostrum.plans.storage import new_path, spread, staged
from rostrum.streaming import crawl


def fields(df: DataFrame, record: str, *names: str) -> DataFrame:
    """Key and chosen fields of one extract column; lists as text."""
    out = []
    for name in names:
        value = F.col(f"{record}.{name}")
        out.append((F.array_join(value, "|") if name == "topics" else value).alias(name))
    return df.filter(F.col(record).isNotNull()).select("page_id", *out)


# ---- structured data ----------------------------------------------------------------------------
@register("jsonld_events", "PG-1", oracle="""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Ev ' || CAST(page_id AS VARCHAR) WHEN 1 THEN 'Fest ' || CAST(page_id AS VARCHAR) END AS name, CASE page_id % 4 WHEN 2 THEN 'Meet' END AS description,
           CASE page_id % 4 WHEN 0 THEN '2026-05-01' END AS event_start_date, CASE page_id % 4 WHEN 0 THEN '2026-05-03' END AS event_end_date, CASE page_id % 4 WHEN 0 THEN 'Lyon' END AS city,
           CASE page_id % 4 WHEN 0 THEN 'France' END AS country, CASE page_id % 4 WHEN 0 THEN 'Hall' WHEN 2 THEN 'Online via web' END AS location_raw, page_id % 4 <> 0 AS is_online,
           CASE page_id % 4 WHEN 0 THEN 'rust|data' WHEN 1 THEN 'k1|k2' ELSE '' END AS topics FROM {pages} WHERE page_id % 4 < 3""")
def _(t):
    names = ("name", "description", "event_start_date", "event_end_date", "city", "country", "location_raw", "is_online", "topics")
    return fields(P.jsonld_events(t.view("v_page")), "jsonld", *names)


@register("opengraph_tags", "PG-2", oracle="""
    SELECT page_id, 'Og ' || CAST(page_id AS VARCHAR) AS name, 'About & more' AS description, '2026-06-0' || CAST(1 + page_id % 9 AS VARCHAR) AS event_start_date FROM {pages} WHERE page_id % 3 = 0""")
def _(t):
    return fields(P.opengraph(t.view("v_page")), "og", "name", "description", "event_start_date")


TITLE = "trim(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))"


@register("meta_tags", "PG-3", oracle=f"""
    SELECT page_id, {TITLE} AS name, CASE WHEN page_id % 5 = 0 THEN 'A page' END AS description, CASE WHEN page_id % 5 = 0 THEN 'x|y|z' ELSE '' END AS topics FROM {{pages}} WHERE {TITLE} <> '' OR page_id % 5 = 0""")
def _(t):
    return fields(P.meta_tags(t.view("v_page")), "meta", "name", "description", "topics")


@register("platform_extracts", "PG-4", oracle="""
    SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'sessionize' WHEN 1 THEN 'papercall' WHEN 2 THEN 'pretalx' ELSE 'eventbrite' END AS extraction_method,
           CASE page_id % 7 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.85e0 ELSE 0.6e0 END AS confidence, 'Title ' || CAST(page_id AS VARCHAR) AS name,
           CASE page_id % 7 WHEN 0 THEN CASE page_id % 6 WHEN 0 THEN '2026-03-05' END WHEN 1 THEN CASE page_id % 6 WHEN 1 THEN '2026-04-02' END WHEN 2 THEN CASE page_id % 6 WHEN 2 THEN '2026-04-30' END END AS cfp_end_date,
           CASE WHEN page_id % 7 = 0 AND page_id % 6 = 0 THEN '2026-05-01' WHEN page_id % 7 = 3 AND page_id % 6 = 3 THEN '2026-07-04' END AS event_start_date,
           CASE WHEN page_id % 7 IN (0, 1) THEN 'rust|data' ELSE '' END AS topics FROM {pages} WHERE page_id % 7 < 4""")
def _(t):
    return fields(P.platform(t.view("v_page")), "platform", "extraction_method", "confidence", "name", "cfp_end_date", "event_start_date", "topics")


@register("merged_extracts", "DUP-5", oracle="""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'mid' WHEN doc_id % 3 = 1 THEN 'top' ELSE 'low' END AS name, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS description,
           CASE WHEN doc_id % 5 = 0 THEN 'a|b' ELSE 'c' END AS topics, FALSE AS is_online,
           CASE WHEN doc_id % 3 = 1 THEN 'top+mid+low' WHEN doc_id % 3 = 0 THEN 'mid+low' ELSE 'low' END AS extraction_method, CASE WHEN doc_id % 3 = 1 THEN 0.9e0 WHEN doc_id % 3 = 0 THEN 0.5e0 ELSE 0.2e0 END AS confidence
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 2 OR doc_id % 2 = 1 THEN 'x' ELSE lang END AS lang0, lang, source FROM {documents}) WHERE doc_id % 3 <> 2
    UNION ALL SELECT doc_id, 'low', source, 'c', TRUE, 'low', 0.2e0 FROM {documents} WHERE doc_id % 3 = 2""")
def _(t):
    rows = t.table("documents").select("doc_id", "lang", "source")
    i = F.col("doc_id")
    none = F.lit(None).cast(D.EXTRACT_TYPE)
    top = F.when(i % 3 == 1, D.extract_record("top", 0.9, name=F.lit("top"), description=F.lit("")))
    mid_topics = F.when(i % 5 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    mid = F.when(i % 3 != 2, D.extract_record("mid", 0.5, name=F.lit("mid"), description=F.when(i % 2 == 0, F.col("lang")), topics=mid_topics))
    low = D.extract_record("low", 0.2, name=F.lit("low"), description=F.col("source"), topics=F.array(F.lit("c")), is_online=F.lit(True))
    out = D.extract_record("none", 0.0, name=F.lit("zero"))
    rows = rows.withColumns({"r1": low, "r2": F.coalesce(mid, none), "r3": out, "r4": F.coalesce(top, none)})
    merged = D.merge_extracts(rows, ["r1", "r2", "r3", "r4"], "e")
    return merged.select("doc_id", "e.name", "e.description", F.array_join("e.topics", "|").alias("topics"), "e.is_online", "e.extraction_method", F.col("e.confidence").alias("confidence"))


# ---- heuristics and calls -----------------------------------------------------------------------
CLOSED = "regexp_replace(regexp_replace(html, '(?is)<(script)[^>]*>.*?</script>|<(style)[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>', '', 'g'), '<p>', '</p><p>', 'g')"
PARAS = f"""list_filter(list_transform(regexp_extract_all({CLOSED}, '(?is)<p>(.*?)</(?:p|article|div|body)>', 1),
    lambda x: trim(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))), lambda x: length(x) > 100)[1]"""


@register("heuristic_extracts", "PG-5", "FN-DT-11", "FN-DT-12", "FN-STR-6", oracle=f"""
    SELECT page_id, 'Title ' || CAST(page_id AS VARCHAR) AS name, substr({PARAS}, 1, 500) AS description,
           CASE page_id % 6 WHEN 0 THEN '2026-03-05' WHEN 1 THEN '2026-04-02' WHEN 2 THEN '2026-04-30' END AS cfp_end_date,
           CASE page_id % 6 WHEN 0 THEN 0.8e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.8e0 ELSE 0.1e0 END AS confidence FROM {{v_page}}""")
def _(t):
    return fields(P.heuristics(spread(t.view("v_page"), "page_id")), "heuristic", "name", "description", "cfp_end_date", "confidence")


CALL_ID = "substr(sha256(CASE page_id % 7 WHEN 0 THEN 'https://sessionize.com/ev' WHEN 1 THEN 'https://www.papercall.io/ev' WHEN 2 THEN 'https://pretalx.com/ev' WHEN 3 THEN 'https://www.eventbrite.com/e/' ELSE 'https://ev.example/' END || CAST(page_id AS VARCHAR)), 1, 16)"


@register("extracted_calls", "PG-6", "PRJ-6", "DUP-5", oracle=f"""
    SELECT {CALL_ID} AS object_id, CASE WHEN page_id % 7 < 3 THEN 0 WHEN page_id % 4 < 3 THEN page_id % 4 + 1 WHEN page_id % 7 = 3 OR page_id % 6 < 3 THEN 0 ELSE 3 END AS name_kind,
           CASE page_id % 6 WHEN 0 THEN CAST(epoch(TIMESTAMP '2026-03-05') AS BIGINT) WHEN 1 THEN CAST(epoch(TIMESTAMP '2026-04-02') AS BIGINT) WHEN 2 THEN CAST(epoch(TIMESTAMP '2026-04-30') AS BIGINT) END AS cfp_end_date
    FROM {{pages}}""")
def _(t):
    calls, _ = P.extract_cfps(t.view("v_page").select("page_url", "html"))
    name = F.col("name")
    kind = F.when(name.startswith("Title "), 0).when(name.rlike(r"^Ev \d"), 1).when(name.startswith("Fest "), 2).otherwise(3)
    return calls.select("object_id", kind.cast("bigint").alias("name_kind"), "cfp_end_date")


@register("extraction_outcomes", "PG-6", "ST-3", oracle="""
    SELECT page_id, TRUE AS ok, CAST(NULL AS VARCHAR) AS error_reason, FALSE AS is_spa FROM {pages}""")
def _(t):
    _, outcomes = P.extract_cfps(t.view("v_page").select("page_url", "html"))
    return outcomes.select(F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("page_id"), "ok", "error_reason", "is_spa")


@register("plain_page_outcomes", "PG-6", oracle=f"""
    SELECT page_id, {TITLE} <> '' OR {TITLE.replace('title', 'h1')} <> '' AS ok FROM {{pages}} WHERE {TITLE} <> '' UNION ALL SELECT page_id, FALSE FROM {{pages}} WHERE {TITLE} = ''""")
def _(t):
    _, outcomes = P.extract_cfps(t.table("pages").select(F.col("page_id").cast("string").alias("page_url"), "html"))
    return outcomes.select(F.col("url").cast("bigint").alias("page_id"), "ok")


@register("relevant_lines", "PG-18", oracle=f"""
    WITH x AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(regexp_replace(COALESCE(NULLIF(regexp_extract(h, '(?is)<article[^>]*>(.*?)</article>', 1), ''), h),
                 '<[^>]*>', '\n', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&', 'g') AS txt
               FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>', '', 'g') AS h FROM {{v_page}})),
    l AS (SELECT page_id, i, line FROM (SELECT page_id, UNNEST(s) AS line, generate_subscripts(s, 1) AS i FROM (
            SELECT page_id, list_filter(list_transform(string_split(txt, chr(10)), lambda v: trim(v)), lambda v: v <> '') AS s FROM x))),
    h AS (SELECT page_id, i, line, bool_or({duck_any('lower(line)', L.RELEVANT_LINE_WORDS)}) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l),
    d AS (SELECT page_id, line, MIN(i) AS i FROM h WHERE near GROUP BY 1, 2)
    SELECT page_id, CAST(r - 1 AS INTEGER) AS line_no, line FROM (SELECT page_id, line, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY i) AS r FROM d) WHERE r <= 100""")
def _(t):
    return P.relevant_lines(t.view("v_page"))


# ---- speaker calls ------------------------------------------------------------------------------
# the text of one call page, put together from parts that depend on the key
CALL_TEXT = """
    SELECT id, 'Rust ' || CAST(size AS STRING) || ': Call for Speakers @ Sessionize.com Call for Speakers in 12 days Call opens at 12:00 AM 0' || CAST(1 + id % 9 AS STRING) || ' Jan 2026 ' ||
      CASE id % 3 WHEN 0 THEN 'event date 12 May 2026 ' WHEN 1 THEN 'event starts 10 May 2026 event ends 11 May 2026 ' ELSE '' END ||
      CASE id % 4 WHEN 0 THEN 'location Convention Hall ' || CAST(size AS STRING) || ', Lyon, France website ev' || CAST(id AS STRING) || '.example/x ' WHEN 1 THEN 'location Online website a.example ' ELSE '' END ||
      CASE id % 5 WHEN 0 THEN 'Lightning talks: 10 minutes. ' WHEN 1 THEN 'Workshop: 3 hours and a keynote. ' WHEN 2 THEN 'We run 45 min talks. ' WHEN 3 THEN 'all sessions are 30 minutes long. ' ELSE '' END ||
      CASE id % 7 WHEN 0 THEN 'We expect over 1200 attendees. ' WHEN 1 THEN '2,500+ developers joined. ' WHEN 2 THEN 'capacity of 350. ' ELSE '' END ||
      CASE id % 6 WHEN 0 THEN 'travel covered and 2 hotel nights. ' WHEN 1 THEN 'we are not covering any travel but accommodation covered. ' WHEN 2 THEN 'up to $800 for travel, free admission. '
        WHEN 3 THEN 'hotel not covered; speakers will be paid. ' ELSE '' END ||
      CASE id % 8 WHEN 0 THEN 'Target audience: senior devs, leads. ' WHEN 1 THEN 'Call for papers is closed ' ELSE '' END ||
      CASE WHEN id % 9 = 0 THEN 'This is a hybrid show. ' WHEN id % 9 = 1 THEN 'A fully online gathering. ' ELSE '' END || 'mail me' || CAST(id AS STRING) || '@ev.example now Add to calendar ' || kind || ' days' AS text
    FROM {v_person}"""


@register("session_formats", "PG-7", oracle=f"""
    SELECT id, name, duration FROM (SELECT id, UNNEST(CASE id % 5 WHEN 0 THEN ['Lightning Talk'] WHEN 1 THEN ['Keynote', 'Workshop'] WHEN 2 THEN ['Talk'] WHEN 3 THEN ['Session'] ELSE CAST([] AS VARCHAR[]) END) AS name,
             UNNEST(CASE id % 5 WHEN 0 THEN ['10 minutes'] WHEN 1 THEN [NULL, '3 hours'] WHEN 2 THEN ['45 min'] WHEN 3 THEN ['30 min'] ELSE CAST([] AS VARCHAR[]) END) AS duration FROM ({CALL_TEXT}))
    UNION ALL SELECT id, 'Session', '10 min' FROM ({CALL_TEXT}) WHERE id % 5 = 0 UNION ALL SELECT id, 'Session', '45 min' FROM ({CALL_TEXT}) WHERE id % 5 = 2""")
def _(t):
    rows = staged(spread(t.sql(CALL_TEXT), "id"), placed=C.session_formats(F.col("text")))
    return rows.select("id", F.inline(C.one_per_name(F.col("placed"))))


BENEFITS = """CASE id % 6 WHEN 0 THEN 'covered' WHEN 2 THEN '$800' END AS travel, CASE id % 6 WHEN 0 THEN '2 nights' WHEN 1 THEN 'covered' END AS hotel,
    id % 6 = 2 AS ticket, CASE id % 6 WHEN 3 THEN 'paid' END AS payment"""


@register("call_benefits", "PG-8", "PG-9", "PG-10", oracle=f"""
    SELECT id, CASE id % 7 WHEN 0 THEN '1200' WHEN 1 THEN '2,500+' WHEN 2 THEN '350' END AS attendance, {BENEFITS}, CASE WHEN id % 8 = 0 THEN 'senior devs, leads' END AS target_audience, id % 8 <> 1 AS is_open
    FROM {{v_person}}""")
def _(t):
    text = F.col("text")
    rows = staged(spread(t.sql(CALL_TEXT), "id"), b=C.speaker_benefits(text))
    return rows.select("id", C.attendance(text).alias("attendance"), "b.*", C.target_audience(text).alias("target_audience"), C.is_call_open(text).alias("is_open"))


META = """'0' || CAST(1 + id % 9 AS VARCHAR) || ' Jan 2026' AS cfp_opens, CASE id % 3 WHEN 0 THEN '12 May 2026' WHEN 1 THEN '10 May 2026' END AS event_start, CASE id % 3 WHEN 1 THEN '11 May 2026' END AS event_end,
    CASE id % 4 WHEN 0 THEN 'Convention Hall ' || CAST(size AS VARCHAR) || ', Lyon, France' WHEN 1 THEN 'Online' END AS location_raw,
    CASE id % 4 WHEN 0 THEN 'ev' || CAST(id AS VARCHAR) || '.example/x' WHEN 1 THEN 'a.example' END AS website, 'me' || CAST(id AS VARCHAR) || '@ev.example' AS contact_email"""


@register("call_metadata", "PG-10", oracle=f"SELECT id, {META} FROM {{v_person}}")
def _(t):
    rows = staged(spread(t.sql(CALL_TEXT), "id"), m=C.call_metadata(F.col("text")))
    return rows.select("id", "m.cfp_opens", "m.event_start", "m.event_end", "m.location_raw", "m.website", "m.contact_email")


CLEAN = """trim(regexp_replace(
      CASE id % 4 WHEN 0 THEN 'ev' || CAST(id AS VARCHAR) || '.example/x ' WHEN 1 THEN 'a.example ' ELSE '' END ||
      CASE id % 5 WHEN 0 THEN 'Lightning talks: 10 minutes. ' WHEN 1 THEN 'Workshop: 3 hours and a keynote. ' WHEN 2 THEN 'We run 45 min talks. ' WHEN 3 THEN 'all sessions are 30 minutes long. ' ELSE '' END ||
      CASE id % 7 WHEN 0 THEN 'We expect over 1200 attendees. ' WHEN 1 THEN '2,500+ developers joined. ' WHEN 2 THEN 'capacity of 350. ' ELSE '' END ||
      CASE id % 6 WHEN 0 THEN 'travel covered and 2 hotel nights. ' WHEN 1 THEN 'we are not covering any travel but accommodation covered. ' WHEN 2 THEN 'up to $800 for travel, free admission. '
        WHEN 3 THEN 'hotel not covered; speakers will be paid. ' ELSE '' END ||
      CASE id % 8 WHEN 0 THEN 'Target audience: senior devs, leads. ' WHEN 1 THEN 'Call for papers is closed ' ELSE '' END ||
      CASE WHEN id % 9 = 0 THEN 'This is a hybrid show. ' WHEN id % 9 = 1 THEN 'A fully online gathering. ' ELSE '' END || 'mail now ' || kind || ' days', '\\s+', ' ', 'g'))"""


@register("clean_call_texts", "PG-11", "PG-12", oracle=f"""
    SELECT id, clean_text, CASE WHEN id % 4 = 1 THEN 'virtual' WHEN contains(clean_text, 'hybrid') THEN 'hybrid' WHEN id % 6 IN (0, 1, 2) OR id % 4 = 0 THEN 'in-person'
             WHEN contains(clean_text, 'fully online') THEN 'virtual' ELSE 'in-person' END AS event_format
    FROM (SELECT id, {CLEAN} AS clean_text FROM {{v_person}})""")
def _(t):
    text = F.col("text")
    rows = staged(spread(t.sql(CALL_TEXT), "id"), clean_text=C.clean_call_text(text), b=C.speaker_benefits(text), m=C.call_metadata(text))
    return rows.select("id", "clean_text", C.event_format(F.col("m.location_raw"), F.col("clean_text"), F.col("b")).alias("event_format"))


TRACKED = """SELECT id, '<html><h2>Our Tracks</h2><ul><li>' || kind || '</li><li>Web</li><li>Web</li></ul>' || CASE WHEN id % 2 = 0 THEN '<select name="trackId"><option>Select</option><option>' || brand ||
    '</option><option>Web</option></select>' ELSE '<p>maximum ' || CAST(id % 5 AS STRING) || ' submissions</p>' END || '</html>' AS html FROM {v_person}"""


@register("call_tracks", "PG-13", oracle="""
    SELECT id, CASE WHEN id % 2 = 0 THEN brand || '|Web|' || kind ELSE kind || '|Web' END AS tracks, CASE WHEN id % 2 = 1 THEN CAST(id % 5 AS INTEGER) END AS max_submissions FROM {v_person}""")
def _(t):
    html = F.col("html")
    return t.sql(TRACKED).select("id", F.array_join(C.tracks(html), "|").alias("tracks"), C.max_submissions(html).alias("max_submissions"))


def mined(t: Tables) -> DataFrame:
    rows = t.sql("SELECT id, text FROM (" + CALL_TEXT + ")")
    pages = rows.select(
        "id", F.concat(F.lit("https://sessionize.com/e"), F.col("id").cast("string")).alias("page_url"),
        F.concat(F.lit('<html><head><meta name="description" content="About it"><script>x</script></head><body><nav>skip</nav><div>'), "text", F.lit("</div></body></html>")).alias("html"),
    )
    return C.mine_calls(pages)


@register("mined_calls", "PG-7", "PG-8", "PG-9", "PG-10", "PG-11", "PG-12", oracle=f"""
    SELECT id, {META}, {BENEFITS}, CASE id % 7 WHEN 0 THEN '1200' WHEN 1 THEN '2,500+' WHEN 2 THEN '350' END AS attendance, {CLEAN} AS clean_text, 'About it' AS description,
           CASE id % 5 WHEN 4 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS formats FROM {{v_person}}""")
def _(t):
    return mined(t).select(
        "id", "cfp_opens", "event_start", "event_end", "location_raw", "website", "contact_email", "benefits.*", "attendance", "clean_text", "description", F.size("session_formats").alias("formats"))


@register("calls_with_mined_pages", "PG-14", oracle="""
    SELECT object_id, CASE WHEN m AND seq % 7 IN (0, 1, 2) THEN CASE seq % 7 WHEN 0 THEN '1200' WHEN 1 THEN '2,500+' ELSE '350' END ELSE 'old' END AS attendance,
           CASE WHEN description IS NULL AND m THEN 'About it' ELSE description END AS description, CASE WHEN m AND seq % 6 IN (0, 2) THEN CASE WHEN seq % 6 = 0 THEN 'covered' ELSE '$800' END END AS travel,
           CASE WHEN m AND seq % 4 = 0 THEN 'Convention Hall ' || CAST(size AS VARCHAR) || ', Lyon, France' ELSE '' END AS raw, m OR seq % 10 = 0 AS sessionize_enriched
    FROM (SELECT object_id, seq, description, seq % 3 = 0 AND seq % 10 <> 0 AS m, p_size AS size FROM {v_cfp} JOIN {part} ON p_partkey = object_id)""")
def _(t):
    rows = mined(t).withColumnRenamed("id", "mined_id")
    link = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("https://sessionize.com/e"), F.col("object_id").cast("string")))
    empty = F.lit("").cast("string")
    calls = t.view("v_cfp").withColumns({
        "sessionize_url": link, "sessionize_enriched": F.col("seq") % 10 == 0, "attendance": F.lit("old"), "full_text": empty,
        "location": F.struct(F.lit("").alias("city"), F.lit(None).cast("string").alias("state"), F.lit("").alias("country"), F.lit("").alias("raw")),
    })
    out = C.apply_sessionize(calls, rows)
    return out.select("object_id", "attendance", "description", F.col("speaker_benefits.travel").alias("travel"), F.col("location.raw").alias("raw"), "sessionize_enriched")


ISSUE_TEXT = """SELECT id, CASE id % 4 WHEN 0 THEN 'talk of ' || CAST(size AS STRING) || ' minutes' WHEN 1 THEN CAST(size AS STRING) || ' hours left to submit' ELSE kind END ||
    CASE id % 3 WHEN 0 THEN ' travel support for all' WHEN 1 THEN ' hotel nights but no hotel paid' ELSE ' free ticket' END || CASE id % 5 WHEN 0 THEN ' and 300 people' ELSE '' END AS text FROM {v_person}"""


def checked(t: Tables) -> DataFrame:
    i = F.col("id")
    benefits = F.struct(
        F.when(i % 2 == 0, F.lit("covered")).alias("travel"), F.lit(None).cast("string").alias("hotel"), (i % 7 == 0).alias("ticket"), F.lit(None).cast("string").alias("payment"))
    rows = t.sql(ISSUE_TEXT).withColumns({
        "n_formats": F.when(i % 6 == 0, 1).otherwise(0), "benefits": benefits, "attendance": F.when(i % 10 == 0, F.lit("300")), "html_fetched": i % 11 != 0,
    })
    return rows.withColumn("issues", C.extraction_issues(F.col("text"), F.col("n_formats"), F.col("benefits"), F.col("attendance")))


ISSUES = """SELECT id, list_filter([
      CASE WHEN id % 4 = 0 AND id % 6 <> 0 THEN 'MISSED_DURATION: found "' || CAST(size AS VARCHAR) || ' min" but no formats extracted' END,
      CASE WHEN id % 3 = 0 AND id % 2 <> 0 THEN 'MISSED_TRAVEL: travel benefit pattern in text but not extracted' END,
      CASE WHEN id % 3 = 2 AND id % 7 <> 0 THEN 'MISSED_FREE_TICKET: free ticket pattern in text but ticket not True' END,
      CASE WHEN id % 5 = 0 AND id % 10 <> 0 THEN 'MISSED_ATTENDANCE: found "300 people" but not extracted' END], lambda x: x IS NOT NULL) AS issues, id % 6 = 0 AS f, id % 2 = 0 OR id % 7 = 0 AS b, id % 10 = 0 AS a, id % 11 <> 0 AS h
    FROM {v_person}"""


@register("extraction_issues", "PG-15", oracle=f"SELECT id, array_to_string(issues, '|') AS issues FROM ({ISSUES})")
def _(t):
    return checked(t).select("id", F.array_join("issues", "|").alias("issues"))


@register("validation_report", "AGG-27", oracle=f"""
    WITH i AS ({ISSUES}), c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (h) AS h, COUNT(*) FILTER (f) AS f, COUNT(*) FILTER (b) AS b, COUNT(*) FILTER (a) AS a, COUNT(*) FILTER (len(issues) > 0) AS s FROM i)
    SELECT 'coverage' AS kind, UNNEST(['total', 'html_fetched', 'with_formats', 'with_benefits', 'with_attendance', 'with_issues']) AS value, UNNEST([n, h, f, b, a, s]) AS n,
           UNNEST([100 * n // n, 100 * h // n, 100 * f // n, 100 * b // n, 100 * a // n, 100 * s // n]) AS pct FROM c
    UNION ALL SELECT 'issue', split_part(x, ':', 1), COUNT(*), NULL FROM (SELECT UNNEST(issues) AS x FROM i) GROUP BY 2""")
def _(t):
    return C.validation_report(checked(t))


# ---- crawl store --------------------------------------------------------------------------------
STORE = f"""SELECT 'https://u.example/' || CAST(seq AS STRING) AS url, source, name, cfp_url, seq % 3 = 0 AS extracted, seq % 3 = 1 AS extraction_failed,
    CASE WHEN seq % 3 <> 2 AND seq % 8 <> 0 THEN CAST({AS_OF} - (seq % 30) * 3600 AS DOUBLE) END AS last_attempt, CAST(seq % 5 AS INT) AS retry_count, seq % 7 = 0 AS max_retries_reached,
    CASE WHEN seq % 2 = 0 THEN 'httpx' END AS fetch_method, seq % 4 = 0 AS is_spa, CAST(CASE seq % 5 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 0 END AS INT) AS http_status,
    CASE seq % 6 WHEN 0 THEN '404' WHEN 1 THEN 'Timeout' WHEN 2 THEN '503' WHEN 3 THEN '' END AS error_reason, CAST(seq * 7919 % 100003 AS DOUBLE) AS added_at FROM {{v_cfp}}"""
PENDING = f"SELECT * FROM ({STORE}) WHERE NOT extracted AND NOT extraction_failed"
RETRY = f"""SELECT * FROM ({STORE}) WHERE extraction_failed AND NOT max_retries_reached AND (COALESCE(error_reason, '') = '' OR lower(error_reason) IN ('timeout', '503'))"""
READY = f"""SELECT * FROM ({RETRY}) WHERE last_attempt IS NULL OR {AS_OF} - last_attempt >= CASE LEAST(retry_count, 2) WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 24 END * 3600"""


@register("url_pending", "ST-1", oracle=f"SELECT url, added_at FROM ({PENDING}) ORDER BY added_at, url LIMIT 50")
def _(t):
    return S.url_pending(t.sql(STORE), 50).select("url", "added_at")


@register("url_retryable", "ST-2", oracle=f"SELECT url, retry_count FROM ({READY}) ORDER BY COALESCE(last_attempt, 0), url LIMIT 40")
def _(t):
    return S.url_retryable(t.sql(STORE), AS_OF, 40).select("url", "retry_count")


@register("url_retryable_now", "ST-2", oracle=f"SELECT url FROM ({RETRY})")
def _(t):
    return S.url_retryable(t.sql(STORE), AS_OF, ignore_backoff=True).select("url")


@register("extract_plan", "ST-5", oracle=f"""
    WITH n AS (SELECT COUNT(*) + 30 AS k FROM ({PENDING})), p AS (
      SELECT url, 0 AS phase, added_at AS since FROM ({PENDING}) UNION ALL SELECT url, 1, COALESCE(last_attempt, 0) FROM ({READY}))
    SELECT url, phase FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY phase, since, url) AS r FROM p) WHERE r <= 700""")
def _(t):
    return S.extract_plan(t.sql(STORE), AS_OF, 700).select("url", "phase")


OUTCOME = f"""SELECT 'https://u.example/' || CAST(seq AS STRING) || '/' AS url, seq % 2 = 0 AS ok, CAST({AS_OF} + 60 AS DOUBLE) AS attempted_at, CASE WHEN seq % 3 = 0 THEN 'browser' ELSE '' END AS fetch_method,
    seq % 5 = 0 AS is_spa, CAST(CASE WHEN seq % 7 = 0 THEN 500 END AS INT) AS http_status, CASE seq % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'low_confidence' END AS error_reason, seq % 11 = 0 AS is_retry
    FROM {{v_cfp}} WHERE seq % 4 <> 0"""
APPLIED = f"""SELECT s.url, CASE WHEN ok THEN TRUE ELSE extracted END AS extracted, CASE WHEN ok THEN FALSE WHEN NOT ok THEN TRUE ELSE extraction_failed END AS extraction_failed,
    CASE WHEN o.url IS NOT NULL THEN CAST({AS_OF} + 60 AS DOUBLE) ELSE last_attempt END AS last_attempt, CASE WHEN ok AND o.fetch_method <> '' THEN o.fetch_method ELSE s.fetch_method END AS fetch_method,
    CASE WHEN ok THEN o.is_spa ELSE s.is_spa END AS is_spa, CASE WHEN NOT ok AND o.http_status IS NOT NULL THEN o.http_status ELSE s.http_status END AS http_status,
    CASE WHEN NOT ok AND o.error_reason IS NOT NULL THEN o.error_reason ELSE s.error_reason END AS error_reason,
    CAST(retry_count + CASE WHEN NOT ok AND is_retry THEN 1 ELSE 0 END AS INT) AS retry_count,
    CASE WHEN NOT ok AND (o.error_reason = 'low_confidence' OR retry_count + CASE WHEN is_retry THEN 1 ELSE 0 END >= 3) THEN TRUE ELSE max_retries_reached END AS max_retries_reached
    FROM ({STORE}) s LEFT JOIN ({OUTCOME}) o ON rtrim(o.url, '/') = s.url"""
APPLIED_COLUMNS = ["url", "extracted", "extraction_failed", "last_attempt", "fetch_method", "is_spa", "http_status", "error_reason", "retry_count", "max_retries_reached"]


@register("url_outcomes_applied", "ST-3", oracle=APPLIED)
def _(t):
    return S.url_apply_outcomes(t.sql(STORE), t.sql(OUTCOME)).select(APPLIED_COLUMNS)


@register("url_failures_reset", "ST-4", oracle=f"SELECT url, extracted, FALSE AS extraction_failed, CASE WHEN NOT extraction_failed THEN last_attempt END AS last_attempt FROM ({STORE})")
def _(t):
    return S.url_reset_failed(t.sql(STORE)).select("url", "extracted", "extraction_failed", "last_attempt")


@register("url_store_totals", "AGG-14", oracle=f"""
    SELECT UNNEST(['total', 'extracted', 'failed', 'pending', 'spa', 'classic', 'retryable', 'ready_for_retry', 'permanently_failed']) AS category,
           UNNEST([COUNT(*), COUNT(*) FILTER (extracted), COUNT(*) FILTER (extraction_failed), COUNT(*) FILTER (NOT extracted AND NOT extraction_failed), COUNT(*) FILTER (extracted AND is_spa),
                   COUNT(*) FILTER (extracted AND NOT is_spa), (SELECT COUNT(*) FROM ({RETRY})), (SELECT COUNT(*) FROM ({READY})), COUNT(*) FILTER (extraction_failed AND max_retries_reached)]) AS n FROM ({STORE})""")
def _(t):
    return S.url_store_totals(t.sql(STORE), AS_OF)


@register("url_store_spa_share", "AGG-14", oracle=f"SELECT ROUND(100e0 * COUNT(*) FILTER (is_spa) / COUNT(*), 1) AS spa_percentage FROM ({STORE}) WHERE extracted")
def _(t):
    return S.spa_percentage(t.sql(STORE))


@register("url_store_breakdown", "AGG-14", oracle=f"""
    SELECT 'source' AS dimension, source AS value, COUNT(*) AS n FROM ({STORE}) GROUP BY 2 UNION ALL SELECT 'fetch_method', COALESCE(fetch_method, 'unknown'), COUNT(*) FROM ({STORE}) WHERE extracted GROUP BY 2
    UNION ALL SELECT 'error_reason', COALESCE(NULLIF(error_reason, ''), 'unknown'), COUNT(*) FROM ({STORE}) WHERE extraction_failed GROUP BY 2
    UNION ALL SELECT 'http_status', CAST(http_status AS VARCHAR), COUNT(*) FROM ({STORE}) WHERE extraction_failed AND http_status <> 0 GROUP BY 2
    UNION ALL SELECT 'retry_count', CAST(retry_count AS VARCHAR), COUNT(*) FROM ({STORE}) WHERE extraction_failed GROUP BY 2""")
def _(t):
    return S.url_store_breakdown(t.sql(STORE))


CHECKS = "SELECT DISTINCT cfp_url AS url, CAST(CASE WHEN LENGTH(cfp_url) % 2 = 0 THEN 200 ELSE 404 END AS INT) AS status FROM {v_cfp} WHERE cfp_url <> 'https://c7.example/'"


@register("reachable_calls", "PG-17", oracle="""
    SELECT object_id, CASE WHEN cfp_url = 'https://c7.example/' THEN 0 WHEN length(cfp_url) % 2 = 0 THEN 200 ELSE 404 END AS status,
           cfp_url <> 'https://c7.example/' AND length(cfp_url) % 2 = 0 AS is_valid FROM {v_cfp}""")
def _(t):
    calls = t.view("v_cfp").withColumns({"url": F.col("cfp_url"), "cfp_url": F.when(F.col("seq") % 2 == 0, F.col("cfp_url")).otherwise(F.lit(""))})
    return S.url_reachability_split(calls, t.sql(CHECKS)).select("object_id", "status", "is_valid")


@register("extraction_run", "PG-6", "ST-3", "ST-5", oracle="""
    SELECT CASE page_id % 7 WHEN 0 THEN 'https://sessionize.com/ev' WHEN 1 THEN 'https://www.papercall.io/ev' WHEN 2 THEN 'https://pretalx.com/ev'
             WHEN 3 THEN 'https://www.eventbrite.com/e/' ELSE 'https://Ev.example/' END || CAST(page_id AS VARCHAR) AS url, page_id % 5 > 1 AS extracted, page_id % 5 <= 1 AS extraction_failed,
           CASE WHEN page_id % 5 = 0 THEN 'connection' ELSE '' END AS error_reason FROM {pages}""")
def _(t):
    """Plan, mine and record one run over the platform pages; some pages came back blank, others not at all."""
    pages = t.view("v_page").withColumn("id", F.col("page_id"))
    store = pages.select(
        F.col("page_url").alias("url"), F.lit("x").alias("source"), F.lit("").alias("name"), F.lit("").alias("cfp_url"), F.lit(False).alias("extracted"), F.lit(False).alias("extraction_failed"),
        F.lit(None).cast("double").alias("last_attempt"), F.lit(0).alias("retry_count"), F.lit(False).alias("max_retries_reached"), F.lit("").alias("fetch_method"), F.lit(False).alias("is_spa"),
        F.lit(0).alias("http_status"), F.lit("").alias("error_reason"), F.length("page_url").cast("double").alias("added_at"))
    blank = F.col("id") % 5 == 0
    fetched = pages.filter("id % 5 <> 1").select(
        "page_url", F.when(blank, F.lit("")).otherwise(F.col("html")).alias("html"), F.when(blank, F.lit("connection")).alias("error_reason"))
    _, after = jobs.extract_and_record(store, fetched, AS_OF)
    return after.select("url", "extracted", "extraction_failed", "error_reason")


@register("streamed_url_store", "STR-2", "DUP-4", "ST-3", oracle=APPLIED + " UNION ALL SELECT 'https://new.example/' || CAST(seq AS VARCHAR), FALSE, FALSE, NULL, NULL, FALSE, NULL, NULL, 0, FALSE FROM {v_cfp} WHERE seq % 50 = 0")
def _(t):
    """Links, then outcomes, streamed into a stored table; the outcome files are streamed twice."""
    table = new_path(t.spark, "store")
    crawl.create_store(t.spark, table, t.sql(STORE))
    links = t.sql("""SELECT CASE WHEN seq % 50 = 0 THEN 'https://new.example/' ELSE 'https://u.example/' END || CAST(seq AS STRING) || '/' AS url, 'stream' AS source, name, '' AS cfp_url, seq, 1e9 AS added_at
        FROM {v_cfp}""")
    source, outcomes = new_path(t.spark, "links"), new_path(t.spark, "outcomes")
    links.write.parquet(source)
    t.sql(OUTCOME).write.parquet(outcomes)
    crawl.run_links(t.spark, source, table, new_path(t.spark, "cp")).awaitTermination()
    for _ in range(2):
        crawl.run_outcomes(t.spark, outcomes, table, new_path(t.spark, "cp")).awaitTermination()
    return crawl.read_store(t.spark, table).select(APPLIED_COLUMNS)
