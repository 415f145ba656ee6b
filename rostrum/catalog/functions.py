"""Column functions over texts, names, dates and places derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.plans.storage import spread
from rostrum.catalog.registry import register
from rostrum.functions import arrays as A
from rostrum.functions import dates as D
from rostrum.functions import html as H
from rostrum.functions import places as P
from rostrum.functions import text as S
from rostrum.plans.proxies import AS_OF


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def duck_map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in table.items()) + "}"


def duck_any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def duck_strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


# ---- strings ------------------------------------------------------------------------------------
@register("title_slugs", "FN-STR-1", oracle="""
    SELECT id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM {v_title}""")
def _(t):
    return t.view("v_title").select("id", S.slugify(F.col("title")).alias("slug"))


BROKEN = "REPLACE(REPLACE(text, 'é', 'Ã©'), 'ñ', 'Ã±')"


@register("repaired_texts", "FN-STR-2", oracle=f"""
    SELECT doc_id, md5(fixed) AS digest, length(fixed) AS n FROM (
      SELECT doc_id, trim(regexp_replace(regexp_replace(REPLACE(REPLACE({BROKEN}, 'Ã©', 'e'), 'Ã±', 'n'),
        '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\s+', ' ', 'g')) AS fixed FROM {{documents}})""")
def _(t):
    rows = t.table("documents").select("doc_id", S.repair_text(F.expr(BROKEN)).alias("fixed"))
    return rows.select("doc_id", F.md5("fixed").alias("digest"), F.length("fixed").cast("bigint").alias("n"))


CONF_NAME = """person || CASE id % 5 WHEN 0 THEN ' 2024' WHEN 1 THEN ' 20' || CAST(10 + size AS STRING) || ' Summit'
    WHEN 2 THEN ' - cfp open' WHEN 3 THEN ' (Virtual)' ELSE ' Conf 2025 - CFP (late)' END"""


@register("clean_conference_names", "FN-STR-3", oracle=f"""
    SELECT id, {duck_strip("regexp_replace(regexp_replace(regexp_replace(" + CONF_NAME + ", '\\s*20\\d{2}\\s*', ' ', 'g'), '(?i)\\s*-\\s*CFP.*$', '', 'g'), '\\s*\\(.*\\)$', '', 'g')")} AS name
    FROM {{v_person}}""")
def _(t):
    return t.view("v_person").select("id", S.clean_name(F.expr(CONF_NAME)).alias("name"))


TAGLESS = "regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g')"
PLAIN = f"trim(regexp_replace(regexp_replace({TAGLESS}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@register("page_plain_text", "FN-STR-4", oracle=f"""
    SELECT page_id, md5(txt) AS digest, length(txt) AS n FROM (
      SELECT page_id, replace(replace(replace(replace(replace({PLAIN}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'),
                              '&quot;', '"'), '&#39;', '''') AS txt FROM {{pages}})""")
def _(t):
    rows = t.table("pages").select("page_id", H.strip_html(F.col("html")).alias("txt"))
    return rows.select("page_id", F.md5("txt").alias("digest"), F.length("txt").cast("bigint").alias("n"))


SHELL = """CASE WHEN page_id % 3 = 0 THEN '<html><body><div id="root"></div><script src="/react.js"></script>' || url || '</body></html>'
           WHEN page_id % 3 = 1 THEN REPLACE(html, '<body>', '<body ng-app>') ELSE html END"""


@register("spa_shells", "FN-STR-5", oracle=f"""
    SELECT page_id, regexp_matches(html, '(?i)<div\\s+id=["''](?:root|app|__next|__nuxt)["'']|<script[^>]*(?:react|vue|angular|svelte)|window\\.__INITIAL_STATE__|data-reactroot|ng-app|data-v-[a-f0-9]+')
           AND length({PLAIN}) < 500 AS is_spa
    FROM (SELECT page_id, {SHELL} AS html FROM {{pages}})""")
def _(t):
    return t.table("pages").select("page_id", H.is_spa_shell(F.expr(SHELL)).alias("is_spa"))


@register("search_texts", "FN-STR-6", oracle="""
    SELECT doc_id, md5(txt) AS digest, length(txt) AS n FROM (
      SELECT doc_id, trim(substr(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'),
             '(^|[^\\pL\\pN_])[\\pL\\pN_]{50,}', '\\1', 'g'), 1, 10000)) AS txt FROM {documents})""")
def _(t):
    rows = t.table("documents").select("doc_id", S.clean_search_text(F.col("text")).alias("txt"))
    return rows.select("doc_id", F.md5("txt").alias("digest"), F.length("txt").cast("bigint").alias("n"))


_NAME = L.NAME_PATTERN.replace("'", "''")
_CONF = "|".join(L.TITLE_CONFERENCES)
_SHAPES = [
    (f"(?i)^(.+?)\\s*[-–]\\s*({_NAME})\\s*[-–]\\s*(?:{_CONF})", 1, 2),
    (f"^(.+?)\\s*[-–]\\s*({_NAME})\\s*[-–]\\s*.+\\s+20\\d{{2}}", 1, 2),
    (f"^(.+?)\\s*[-–|]\\s*({_NAME})\\s*$", 1, 2),
    (f"^({_NAME})\\s*:\\s*(.+)$", 2, 1),
    (f"(?i)^(.+?)\\s+by\\s+({_NAME})\\s*$", 1, 2),
]


def _title_case(group: int) -> str:
    arms = " ".join(f"WHEN regexp_matches(title, '{p}') THEN trim(regexp_extract(title, '{p}', {(a, b)[group]}))" for p, a, b in _SHAPES)
    return arms


_PIPED = f"list_filter(list_transform(string_split(title, '|')[2:], lambda x: trim(x)), lambda x: regexp_full_match(x, '{_NAME}'))[1]"


@register("title_speakers", "FN-STR-7", oracle=(f"""
    SELECT id, CASE {_title_case(0)} WHEN {_PIPED} IS NOT NULL THEN trim(string_split(title, '|')[1]) ELSE title END AS title,
           CASE {_title_case(1)} ELSE {_PIPED} END AS speaker FROM """) + "{v_title}")
def _(t):
    return t.view("v_title").select("id", S.speaker_from_title(F.col("title")).alias("p")).select("id", "p.title", "p.speaker")


TAG = """CASE id % 8 WHEN 0 THEN ' K8s ' WHEN 1 THEN 'reactjs' WHEN 2 THEN 'React.js' WHEN 3 THEN 'CI/CD' WHEN 4 THEN brand
         WHEN 5 THEN 'no-SQL' WHEN 6 THEN kind || ' ' ELSE 'ml' END"""


@register("canonical_tags", "FN-STR-9", oracle=
    "SELECT id, COALESCE(m.canonical, trim(p.tag)) AS tag FROM (SELECT id, " + TAG + " AS tag FROM {v_person}) p LEFT JOIN (VALUES "
    + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in L.CANONICAL_TAGS.items())
    + ") m(variant, canonical) ON m.variant = trim(lower(p.tag))")
def _(t):
    return t.view("v_person").select("id", S.normalize_tag(F.expr(TAG)).alias("tag"))


@register("hash_ids", "FN-STR-10", oracle="""
    SELECT object_id, substr(sha1(cfp_url), 1, 16) AS sha1_id,
           substr(sha1('confstech:' || cfp_url || ':' || name), 1, 16) AS composed_id,
           substr(sha256(cfp_url), 1, 12) AS sha256_id,
           'user_' || substr(md5(CAST(object_id AS STRING) || '_' || CAST(seq AS STRING)), 1, 12) AS token
    FROM {v_cfp}""")
def _(t):
    token = S.hash_id(F.concat_ws("_", F.col("object_id").cast("string"), F.col("seq").cast("string")), kind="md5", length=12)
    return t.view("v_cfp").select(
        "object_id", S.hash_id("cfp_url").alias("sha1_id"), S.hash_id("cfp_url", "name", prefix="confstech").alias("composed_id"),
        S.hash_id("cfp_url", kind="sha256", length=12).alias("sha256_id"), F.concat(F.lit("user_"), token).alias("token"),
    )


GITHUB = """CASE id % 7 WHEN 0 THEN 'https://github.com/' || REPLACE(raw_name, ' ', '-') WHEN 1 THEN 'https://GitHub.com/orgs/' || kind
    WHEN 2 THEN 'https://github.com/search' WHEN 3 THEN 'https://' || kind || '.github.io' WHEN 4 THEN 'https://github.com/u' || CAST(size AS STRING) || '/repo'
    WHEN 5 THEN 'https://example.com/' || kind END"""


@register("github_users", "FN-STR-11", oracle=f"""
    SELECT id, CASE WHEN id % 7 = 0 THEN REPLACE(raw_name, ' ', '-') WHEN id % 7 = 4 THEN 'u' || CAST(size AS STRING) END AS username
    FROM {{v_person}}""")
def _(t):
    return t.view("v_person").select("id", S.github_user(F.expr(GITHUB)).alias("username"))


@register("url_parts", "FN-STR-12", oracle="""
    SELECT page_id, rtrim(lower(url || '/'), '/') AS url_key, regexp_extract(url, '://([^/?#]+)', 1) AS host,
           CASE WHEN path <> '' AND NOT contains(path, '/') THEN path END AS slug
    FROM (SELECT page_id, url, trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/') AS path FROM
          (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://host.example/Event-' || CAST(page_id AS STRING) || '/' END AS url FROM {pages}))""")
def _(t):
    rows = t.sql("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'https://host.example/Event-' || CAST(page_id AS STRING) || '/' END AS url FROM {pages}")
    url = F.col("url")
    return rows.select("page_id", S.url_key(F.concat(url, F.lit("/"))).alias("url_key"), S.url_host(url).alias("host"), S.url_path_slug(url).alias("slug"))


@register("number_labels", "FN-STR-14", "FN-STR-15", oracle="""
    SELECT talk_id,
           CASE WHEN s <> 0 THEN CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60)
                ELSE printf('%d:%02d', s // 60, s % 60) END END AS duration,
           CASE WHEN v >= 1000000 THEN CAST(CAST(ROUND(CAST(v AS DECIMAL(18,1)) / 1000000, 1) AS DECIMAL(18,1)) AS STRING) || 'M'
                WHEN v >= 1000 THEN CAST((v + 500) // 1000 AS STRING) || 'K' WHEN v <> 0 THEN CAST(v AS STRING) END AS views,
           CASE WHEN v >= 1000 THEN CAST((v + 500) // 1000 AS STRING) || 'K' ELSE CAST(v AS STRING) END AS rounded,
           CASE WHEN v >= 1000 THEN CAST((v + 50) // 1000 AS STRING) || '.' || CAST((v + 50) % 1000 // 100 AS STRING) || 'K' ELSE CAST(v AS STRING) END AS one_digit,
           CASE WHEN v >= 1000 THEN CAST(v // 1000 AS STRING) || 'K' ELSE CAST(v AS STRING) END AS floored
    FROM (SELECT talk_id, CAST(duration_seconds * 3 AS INT) AS s, view_count * (talk_id % 9) // 1000 * CASE WHEN talk_id % 2 = 0 THEN 1 ELSE 1007 END AS v FROM {v_talk})""")
def _(t):
    rows = t.sql("""SELECT talk_id, CAST(duration_seconds * 3 AS INT) AS s,
        view_count * (talk_id % 9) div 1000 * CASE WHEN talk_id % 2 = 0 THEN 1 ELSE 1007 END AS v FROM {v_talk}""")
    s, v = F.col("s"), F.col("v")
    return rows.select(
        "talk_id", S.duration_label(s).alias("duration"), S.views_label(v).alias("views"), S.compact_number(v).alias("rounded"),
        S.compact_number(v, "one").alias("one_digit"), S.compact_number(v, "floor").alias("floored"),
    )


@register("why_submit", "FN-STR-16", oracle="""
    SELECT object_id, CASE WHEN why = '' THEN 'Great opportunity to share your perspective' ELSE 'Perfect fit: ' || why END AS why FROM (
      SELECT object_id, CONCAT_WS(', ', CASE WHEN contains(lower(topic_a), 'eco') OR contains(lower(topic_b), 'eco') THEN 'covers Eco'
               WHEN contains(lower(topic_a), '#1') OR contains(lower(topic_b), '#1') THEN 'covers #1' END,
             CASE WHEN hn_stories > 0 THEN 'trending on HN' END,
             CASE WHEN event_format IN ('virtual', 'hybrid') THEN 'remote-friendly' END) AS why FROM {v_cfp})""")
def _(t):
    talk_topics = F.array(F.lit("Eco"), F.lit("#1"))
    return t.view("v_cfp").select("object_id", S.why_submit(
        F.array("topic_a", "topic_b"), talk_topics, F.col("hn_stories"), F.col("event_format")).alias("why"))


@register("best_comments", "FN-STR-17", oracle="""
    SELECT conv_id, turn, CASE WHEN length(c) > 200 THEN substr(c, 1, 200) || '...' ELSE c END AS comment FROM (
      SELECT conv_id, turn, CASE WHEN role = 'user' THEN text WHEN turn % 3 = 0 THEN text END AS c FROM {conversations})""")
def _(t):
    empty = F.array().cast("array<string>")
    user = F.when(F.col("role") == "user", F.array("text")).otherwise(empty)
    other = F.when(F.col("turn") % 3 == 0, F.array("text"))
    return t.table("conversations").select("conv_id", "turn", S.best_comment(user, other).alias("comment"))


# ---- dates --------------------------------------------------------------------------------------
@register("parsed_timestamps", "FN-DT-1", "FN-DT-2", "FN-DT-3", "FN-DT-4", "FN-DT-5", oracle="""
    SELECT id, CASE id % 8 WHEN 0 THEN days * 86400 + 37230 WHEN 1 THEN days * 86400 + 3723 - 7200 WHEN 2 THEN days * 86400 + 3723
                    WHEN 3 THEN days * 86400 + 86399 WHEN 4 THEN days * 86400 WHEN 5 THEN days * 86400 + 45000 END AS iso_epoch,
           substr(iso, 1, 10) AS day, days * 86400 + 86399 AS end_of_day,
           CASE id % 6 WHEN 0 THEN days * 86400 + 86399 WHEN 1 THEN days * 86400 + 86340 WHEN 2 THEN days * 86400 END AS deadline_epoch,
           epoch AS seconds, d AS epoch_day
    FROM {v_when}""")
def _(t):
    c = F.col
    return t.view("v_when").select(
        "id", D.parse_iso(c("iso")).alias("iso_epoch"), D.iso_day(c("iso")).alias("day"), D.deadline_epoch(c("d")).alias("end_of_day"),
        D.parse_deadline(c("deadline")).alias("deadline_epoch"), D.ms_to_s(c("epoch") * 1000 + 999).alias("seconds"), D.epoch_day(c("epoch")).alias("epoch_day"),
    )


@register("loose_dates", "FN-DT-6", oracle="""
    SELECT id, CASE WHEN regexp_matches(loose, '^\\d{4}-\\d{2}-\\d{2}') THEN substr(loose, 1, 10)
        ELSE CAST(CAST(COALESCE(try_strptime(loose, '%B %d, %Y'), try_strptime(loose, '%b %d, %Y'), try_strptime(loose, '%d %B %Y'),
             try_strptime(loose, '%d %b %Y'), try_strptime(loose, '%m/%d/%Y'), try_strptime(loose, '%d/%m/%Y'),
             try_strptime(loose, '%Y/%m/%d')) AS DATE) AS STRING) END AS day
    FROM {v_when}""")
def _(t):
    return t.view("v_when").select("id", D.parse_any_date(F.col("loose")).alias("day"))


@register("deadline_countdown", "FN-DT-7", "FN-DT-10", "FN-DT-13", "FLT-16", oracle=f"""
    SELECT object_id, CAST(FLOOR((e - {AS_OF}) / 86400) AS BIGINT) AS days_left,
           CASE WHEN e IS NULL THEN 'unknown' WHEN FLOOR((e - {AS_OF}) / 86400) <= 7 THEN 'critical'
                WHEN FLOOR((e - {AS_OF}) / 86400) <= 30 THEN 'warning' ELSE 'ok' END AS urgency,
           GREATEST(e - {AS_OF}, 0) // 86400 AS days, GREATEST(e - {AS_OF}, 0) % 86400 // 3600 AS hours,
           GREATEST(e - {AS_OF}, 0) % 3600 // 60 AS minutes, GREATEST(e - {AS_OF}, 0) % 60 AS seconds,
           CASE WHEN n < 0 THEN 'Closed' WHEN n = 0 THEN 'Today!' WHEN n = 1 THEN 'Tomorrow' WHEN n <= 7 THEN 'in ' || CAST(n AS STRING) || ' days'
                ELSE strftime(d, '%b ') || CAST(day(d) AS STRING) END AS label
    FROM (SELECT object_id, e, CAST(to_timestamp(e) AT TIME ZONE 'UTC' AS DATE) AS d,
                 CAST(CEIL((FLOOR(e / 86400) * 86400 - {AS_OF}) / 86400) AS BIGINT) AS n
          FROM (SELECT object_id, CASE WHEN seq % 10 <> 0 THEN cfp_end_date + seq * 97 % 86400 END AS e FROM {{v_cfp}}))""")
def _(t):
    from rostrum.operators.filters import urgency

    rows = t.sql("SELECT object_id, CASE WHEN seq % 10 <> 0 THEN cfp_end_date + seq * 97 % 86400 END AS e FROM {v_cfp}")
    e = F.col("e")
    rows = rows.select("object_id", "e", D.days_until(e, AS_OF).alias("days_left"), D.countdown(e, AS_OF).alias("c"),
                       F.when(e.isNotNull(), D.deadline_label(D.epoch_day(e), AS_OF)).alias("label"))
    return rows.select("object_id", "days_left", urgency(F.col("days_left")).alias("urgency"), "c.days", "c.hours", "c.minutes", "c.seconds", "label")


_CONF_YEAR = L.CONFERENCE_YEAR_PATTERN.replace("'", "''")


@register("title_years", "FN-DT-8", "FN-DT-9", oracle=("""
    SELECT id, COALESCE(CASE WHEN a BETWEEN 2010 AND 2030 THEN a END, CASE WHEN b BETWEEN 2010 AND 2025 THEN b END) AS title_year,
           COALESCE(CASE WHEN id % 3 = 0 THEN 2000 + size END, CASE WHEN id % 3 = 1 THEN 2001 END,
                    CASE WHEN a BETWEEN 2010 AND 2030 THEN a END, CASE WHEN b BETWEEN 2010 AND 2025 THEN b END) AS video_year
    FROM (SELECT id, size, TRY_CAST(regexp_extract(title, '@CONF', 1) AS INT) AS a,
                 TRY_CAST(regexp_extract(title, '(20[12]\\d{2})', 1) AS INT) AS b FROM {v_title})""").replace("@CONF", _CONF_YEAR))
def _(t):
    title = F.col("title")
    uploaded = F.when(F.col("id") % 3 == 0, F.concat((F.col("size") + 2000).cast("string"), F.lit("0131")))
    stamp = F.when(F.col("id") % 3 == 1, F.lit(1000000000))
    return t.view("v_title").select("id", D.year_from_title(title).alias("title_year"), D.video_year(uploaded, stamp, title).alias("video_year"))


_NEAR = " || ".join(
    f"CASE WHEN strpos(lower(note), {quote(k)}) > 0 THEN [substr(note, strpos(lower(note), {quote(k)}), 150)] ELSE CAST([] AS VARCHAR[]) END"
    for k in L.DEADLINE_PHRASES
)
_PARSE = """CASE WHEN regexp_matches(m, '^\\d{4}-\\d{2}-\\d{2}') THEN substr(m, 1, 10)
        ELSE CAST(CAST(COALESCE(try_strptime(m, '%B %d, %Y'), try_strptime(m, '%b %d, %Y'), try_strptime(m, '%d %B %Y'),
             try_strptime(m, '%d %b %Y'), try_strptime(m, '%m/%d/%Y'), try_strptime(m, '%d/%m/%Y')) AS DATE) AS STRING) END"""
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, k, {i} AS p, generate_subscripts(f, 1) AS idx, UNNEST(f) AS m FROM (SELECT doc_id, k, regexp_extract_all(ctx, '(?i){p}', 1) AS f FROM c)"
    for i, p in enumerate(L.DATE_PATTERNS)
)


@register("dates_near_deadline_words", "FN-DT-11", oracle=(
    "WITH c AS (SELECT doc_id, generate_subscripts(l, 1) AS k, UNNEST(l) AS ctx FROM (SELECT doc_id, " + _NEAR + " AS l FROM {v_note})), f AS ("
    + _FOUND + ") SELECT doc_id, string_agg(day, ',' ORDER BY k, p, idx) AS days FROM (SELECT doc_id, k, p, idx, " + _PARSE
    + " AS day FROM f) WHERE day IS NOT NULL GROUP BY doc_id"))
def _(t):
    rows = t.view("v_note").select("doc_id", D.dates_near_keywords(F.col("note")).alias("d"))
    return rows.filter(F.size("d") > 0).select("doc_id", F.array_join("d", ",").alias("days"))


_CTX = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS p, generate_subscripts(m, 1) AS idx, UNNEST(m) AS m, UNNEST(list_transform(range(1, len(m) + 1), lambda j:
        lower(substr(note, CAST(GREATEST(1, len(array_to_string(g[:j], '')) + len(array_to_string(m[:j-1], '')) - 49) AS BIGINT),
                     CAST(LEAST(50, len(array_to_string(g[:j], '')) + len(array_to_string(m[:j-1], ''))) + len(m[j]) + 50 AS BIGINT))))) AS ctx
        FROM (SELECT doc_id, note, regexp_extract_all(note, '(?i){p}', 1) AS m, string_split_regex(note, '(?i){p}') AS g FROM {{v_note}})"""
    for i, p in enumerate(L.DATE_PATTERNS)
)
_CLASS = "CASE " + " ".join(f"WHEN {duck_any('ctx', words)} THEN '{role}'" for role, words in L.DATE_CLASS_WORDS.items()) + " END"


@register("classified_dates", "FN-DT-12", oracle=(
    "SELECT doc_id, day, ctx AS context, " + _CLASS + " AS role FROM (SELECT doc_id, ctx, " + _PARSE + " AS day FROM (" + _CTX + ")) WHERE day IS NOT NULL"))
def _(t):
    rows = spread(t.view("v_note"), "doc_id").select("doc_id", F.explode(D.all_dates_with_context(F.col("note"))).alias("d"))
    return rows.select("doc_id", "d.day", "d.context", D.classify_date(F.col("d.context")).alias("role"))


# ---- places -------------------------------------------------------------------------------------
def _values(table: dict[str, str]) -> str:
    return "(VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in table.items()) + ")"


_STATES = _values({**{k.lower(): v for k, v in L.US_STATES.items()}, **{v.lower(): v for v in L.US_STATES.values()}})
_ALIAS = _values(L.COUNTRY_ALIASES)
_CONTINENT = _values(L.COUNTRY_CONTINENT)
_EUROPE = _values(P._EUROPE)
_US = _values(P._US)


@register("parsed_locations", "FN-LOC-1", "FN-LOC-3", oracle=f"""
    SELECT id, city, state, b.country, COALESCE(CASE WHEN state IS NOT NULL AND b.country = 'USA' THEN u.r END,
             CASE WHEN NOT (state IS NOT NULL AND b.country = 'USA') AND c.continent = 'Europe' THEN e.r END) AS region, c.continent, raw FROM (
      SELECT id, raw, CASE WHEN raw = '' THEN NULL WHEN online THEN 'Online' WHEN n = 1 AND k.continent IS NOT NULL THEN NULL ELSE first END AS city,
             CASE WHEN raw = '' OR online THEN NULL WHEN n >= 3 THEN COALESCE(m.name, middle) WHEN n = 2 THEN s.name END AS state,
             CASE WHEN raw = '' OR online THEN NULL WHEN n = 2 AND s.name IS NOT NULL THEN 'USA' WHEN n >= 2 THEN COALESCE(al.name, last)
                  WHEN k.continent IS NOT NULL THEN COALESCE(af.name, first) END AS country
      FROM (SELECT id, raw, lower(raw) IN ('online', 'virtual', 'remote', 'worldwide') AS online, len(p) AS n, trim(p[1]) AS first,
                   trim(p[len(p)]) AS last, trim(p[len(p) - 1]) AS middle
            FROM (SELECT id, trim(place) AS raw, string_split(trim(place), ',') AS p FROM {{v_place}}))
      LEFT JOIN {_STATES} m(key, name) ON m.key = lower(middle) LEFT JOIN {_STATES} s(key, name) ON s.key = lower(last)
      LEFT JOIN {_ALIAS} al(key, name) ON al.key = last LEFT JOIN {_ALIAS} af(key, name) ON af.key = first
      LEFT JOIN {_CONTINENT} k(key, continent) ON k.key = first) b
    LEFT JOIN {_CONTINENT} c(key, continent) ON c.key = b.country LEFT JOIN {_EUROPE} e(key, r) ON e.key = b.country
    LEFT JOIN {_US} u(key, r) ON u.key = b.state""")
def _(t):
    return t.view("v_place").select("id", P.parse_location(F.col("place")).alias("l")).select("id", "l.*")


@register("normalized_locations", "FN-LOC-2", "FN-LOC-3", oracle=f"""
    SELECT id, city, state, b.country, COALESCE(c.continent, CASE WHEN b.country = '' THEN NULL END) AS continent,
           COALESCE(b.region, CASE WHEN b.country = 'USA' AND state <> '' THEN u.r END, CASE WHEN c.continent = 'Europe' THEN e.r END) AS region
    FROM (SELECT id, person AS city, state, region, CASE WHEN p.country = '' THEN '' ELSE COALESCE(a.name, trim(p.country)) END AS country
          FROM (SELECT v.*, 'C' || CAST(id AS STRING) AS person FROM {{v_place}} v) p LEFT JOIN {_ALIAS} a(key, name) ON a.key = trim(p.country)) b
    LEFT JOIN {_CONTINENT} c(key, continent) ON c.key = b.country LEFT JOIN {_EUROPE} e(key, r) ON e.key = b.country
    LEFT JOIN {_US} u(key, r) ON u.key = b.state""")
def _(t):
    place = P.location(city=F.concat(F.lit("C"), F.col("id").cast("string")), state=F.col("state"), country=F.col("country"), region=F.col("region"), raw=F.col("place"))
    rows = t.view("v_place").select("id", P.normalize_location(place).alias("l"))
    return rows.select("id", "l.city", "l.state", "l.country", "l.continent", "l.region")


@register("place_cities", "FN-LOC-4", oracle="""
    SELECT id, CASE WHEN place <> '' THEN trim(string_split(place, ',')[1]) END AS city,
           CASE WHEN len(string_split(place, ',')) >= 2 THEN trim(string_split(place, ',')[-1]) END AS country, place AS raw FROM {v_place}""")
def _(t):
    rows = t.view("v_place").select("id", P.parse_place(F.col("place")).alias("l"))
    return rows.select("id", "l.city", "l.country", "l.raw")


@register("city_country_texts", "FN-LOC-5", oracle="""
    SELECT id, CASE id % 7 WHEN 0 THEN regexp_extract(city_country, '^(\\w+)', 1) WHEN 1 THEN 'Austin' WHEN 3 THEN 'Lisbon'
                  WHEN 4 THEN regexp_extract(city_country, '^([^,]+),', 1) WHEN 5 THEN 'Rome' END AS city,
           CASE id % 7 WHEN 1 THEN 'TX' END AS state,
           CASE id % 7 WHEN 0 THEN 'France' WHEN 1 THEN 'USA' WHEN 4 THEN 'Spain' END AS country_raw,
           city_country AS raw FROM {v_place}""")
def _(t):
    rows = t.view("v_place").select("id", P.parse_city_country(F.col("city_country")).alias("l"))
    return rows.select("id", "l.city", "l.state", F.col("l.country").alias("country_raw"), "l.raw")


@register("text_locations", "FN-LOC-6", oracle="""
    SELECT doc_id, COALESCE(NULLIF(trim(regexp_extract(note, '""" + L.LABELLED_LOCATION_PATTERN + """', 1)), ''),
                            NULLIF(trim(regexp_extract(note, '""" + L.CITY_PATTERN + """', 1)), '')) AS location,
           regexp_matches(note, '(?i)(^|[^\\pL\\pN_])(online|virtual|remote|hybrid)($|[^\\pL\\pN_])') AS is_online FROM {v_note}""")
def _(t):
    rows = t.view("v_note").select("doc_id", P.near_location(F.col("note")).alias("l"))
    return rows.select("doc_id", "l.location", "l.is_online")


# ---- arrays, JSON, numbers ----------------------------------------------------------------------
@register("standardized_tags", "FN-ARR-2", "SNK-2", oracle=(
    "WITH m(variant, canonical) AS (VALUES " + ", ".join(f"({quote(k)}, {quote(v)})" for k, v in L.CANONICAL_TAGS.items()) + """),
    x AS (SELECT id, pos, raw, COALESCE(canonical, trim(raw)) AS tag FROM (
            SELECT id, generate_subscripts(l, 1) AS pos, UNNEST(l) AS raw FROM (SELECT id, ['ReactJS', kind, 'react js', brand, ' ' || kind, 'TDD'] AS l FROM {v_person}))
          LEFT JOIN m ON variant = trim(lower(raw)))
    SELECT id, string_agg(tag, '|' ORDER BY pos) AS tags, TRUE AS changed
    FROM (SELECT id, tag, MIN(pos) AS pos FROM x GROUP BY 1, 2) GROUP BY id"""))
def _(t):
    tags = F.expr("array('ReactJS', kind, 'react js', brand, ' ' || kind, 'TDD')")
    return t.view("v_person").select("id", F.array_join(A.canonical_tags(tags), "|").alias("tags"), A.tags_changed(tags).alias("changed"))


_WORDS = ", ".join(f"CASE WHEN contains(lower(note), {quote(w)}) THEN {quote(w.title())} END" for w in L.TOPIC_WORDS)


@register("text_topics", "FN-ARR-3", oracle=f"""
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{_WORDS}] || COALESCE(listed, CAST([] AS VARCHAR[])), lambda x: x IS NOT NULL)))[1:15], '|') AS topics
    FROM (SELECT doc_id, note, list_filter(list_transform(string_split_regex(NULLIF(regexp_extract(note, '(?i)topics?\\s*(?:include|:)\\s*([^.]+)', 1), ''), '[,;]|\\band\\b'),
            lambda x: trim(x)), lambda x: length(x) > 3 AND length(x) < 50) AS listed FROM {{v_note}})""")
def _(t):
    return t.view("v_note").select("doc_id", F.array_join(A.topics_from_text(F.col("note")), "|").alias("topics"))


@register("event_weights", "FN-MTH-1", oracle="""
    SELECT object_id, LEAST(25, 2 + CASE WHEN hn_points > 100 THEN 8 WHEN hn_points > 50 THEN 5 WHEN hn_points > 10 THEN 3 WHEN hn_points > 0 THEN 2 ELSE 0 END
             + CASE WHEN s > 1000 THEN 6 WHEN s > 100 THEN 3 WHEN s > 0 THEN 1 ELSE 0 END
             + CASE WHEN popularity_score > 80 THEN 4 WHEN popularity_score > 50 THEN 2 WHEN popularity_score > 20 THEN 1 ELSE 0 END) AS cfp_weight,
           CASE WHEN v > 100000 THEN 15 WHEN v > 50000 THEN 10 WHEN v > 10000 THEN 7 WHEN v > 1000 THEN 4 WHEN popularity_score > 50 THEN 2 ELSE 1 END AS talk_weight
    FROM (SELECT *, github_stars * 5 AS s, seq * seq % 200000 AS v FROM {v_cfp})""")
def _(t):
    rows = t.sql("SELECT *, github_stars * 5 AS s, seq * seq % 200000 AS v FROM {v_cfp}")
    return rows.select("object_id", A.cfp_weight(F.col("hn_points"), F.col("s"), F.col("popularity_score")).alias("cfp_weight"),
                       A.talk_weight(F.col("v"), F.col("popularity_score")).alias("talk_weight"))


ANSWER = """CASE doc_id % 6 WHEN 0 THEN '{"id": ' || CAST(doc_id AS STRING) || '}' WHEN 1 THEN 'Sure: ```json {"id": ' || CAST(doc_id AS STRING) || '} ``` done'
    WHEN 2 THEN 'x ``` {"a": [1, {"b": 2}]} ``` y' WHEN 3 THEN 'text {"lang": "' || lang || '"} tail' WHEN 4 THEN 'none' ELSE '' END"""
LISTS = """CASE doc_id % 3 WHEN 0 THEN 'Here: ["' || lang || '", "' || source || '"] ok' WHEN 1 THEN 'nothing' ELSE '["k1", "k2", "k3"]' END"""


@register("rescued_json", "FN-JSN-1", oracle=f"""
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{{"id": ' || CAST(doc_id AS STRING) || '}}' WHEN 1 THEN '{{"id": ' || CAST(doc_id AS STRING) || '}}'
             WHEN 2 THEN '{{"a": [1, {{"b": 2}}]}}' WHEN 3 THEN '{{"lang": "' || lang || '"}}' END AS json,
           CASE doc_id % 3 WHEN 0 THEN lang || ',' || source WHEN 1 THEN '' ELSE 'k1,k2,k3' END AS items FROM {{documents}}""".replace("{{", "{").replace("}}", "}"))
def _(t):
    rows = t.table("documents")
    items = A.rescue_json_array(F.expr(LISTS))
    return rows.select("doc_id", A.rescue_json(F.expr(ANSWER)).alias("json"), F.array_join(items, ",").alias("items"))


@register("bounded_enrichment", "FN-JSN-3", oracle="""
    SELECT doc_id, n AS n_all, array_to_string([CAST(i AS VARCHAR) for i in range(n)][1:20], ',') AS keywords,
           array_to_string([lang || CAST(i AS VARCHAR) for i in range(n)][1:10], ',') AS topics, CASE WHEN n > 0 THEN LEAST(n, 10) ELSE 0 END AS n_quotes
    FROM (SELECT doc_id, lang, CAST(doc_id % 31 AS INTEGER) AS n FROM {documents})""")
def _(t):
    """Answers with lists of 0 to 30 entries: parsed whole, cut for the record."""
    n = "sequence(0, CAST(doc_id % 31 AS INT))"
    listed = lambda value: f"'Here: ' || to_json(slice(transform({n}, i -> {value}), 1, CAST(doc_id % 31 AS INT))) || ' done'"
    answers = t.sql(f"SELECT doc_id, {listed('CAST(i AS STRING)')} AS keywords, {listed('lang || CAST(i AS STRING)')} AS topics, {listed('source')} AS quotes FROM {{documents}}")
    whole = A.parsed_enrichment(answers).withColumn("n_all", F.size("keywords"))
    cut = A.bounded_enrichment(whole)
    return cut.select("doc_id", "n_all", F.array_join("keywords", ",").alias("keywords"), F.array_join("topics", ",").alias("topics"), F.size("quotes").alias("n_quotes"))


@register("caption_texts", "FN-JSN-2", oracle="""
    SELECT conv_id, trim(regexp_replace(string_agg(said, ' ' ORDER BY turn), '\\s+', ' ', 'g')) AS transcript FROM (
      SELECT conv_id, turn, role || ' says ' || CAST(turn AS STRING) AS said FROM {conversations}) GROUP BY conv_id""")
def _(t):
    # one caption event per turn, built as JSON, with noise events between the spoken ones
    segs = "array(named_struct('utf8', role || '  says ' || CAST(turn AS STRING)), named_struct('utf8', '[Music]'), named_struct('utf8', ' '))"
    events = t.sql(f"SELECT conv_id, turn, {segs} AS segs FROM {{conversations}}")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "segs")))
    doc = F.to_json(F.struct(F.transform(ordered, lambda e: F.struct(e["segs"].alias("segs"))).alias("events")))
    return events.groupBy("conv_id").agg(A.flatten_captions(doc).alias("transcript"))


@register("index_json", "FN-ARR-4", oracle="""
    SELECT object_id, '{"name":"' || name || '"' || CASE WHEN description IS NOT NULL THEN ',"description":"' || description || '"' ELSE '' END
        || CASE WHEN region IS NOT NULL THEN ',"region":"' || region || '"' ELSE '' END || ',"stories":' || CAST(hn_stories AS STRING) || '}' AS json FROM {v_cfp}""")
def _(t):
    record = F.struct(F.col("name"), F.col("description"), F.col("region"), A.null_if_empty(F.array().cast("array<string>")).alias("tags"), F.col("hn_stories").alias("stories"))
    return t.view("v_cfp").select("object_id", A.drop_empty(record).alias("json"))
