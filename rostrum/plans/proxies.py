"""SQL views that present the driver's tables as conference data.

Each text is plain SQL that Spark and DuckDB both accept; ``{name}`` stands for a base table or for
another view. ``render`` fills in the table references of the chosen engine.
"""

from __future__ import annotations

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC, just after the last event

VIEWS = {
    "v_topic": """
        SELECT DISTINCT l.l_orderkey AS talk_id, p.p_brand AS topic
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "v_talk": """
        SELECT o.o_orderkey AS talk_id, 'yt_' || CAST(o.o_orderkey AS STRING) AS object_id,
               c.c_name AS speaker,
               CASE WHEN o.o_orderkey % 5 = 0 THEN 'Customer#' || LPAD(CAST(o.o_custkey + 1 AS STRING), 9, '0') END
                 AS co_speaker,
               n.n_name AS conference_name, CAST(n.n_nationkey AS BIGINT) AS conference_id,
               CAST(FLOOR(o.o_totalprice) AS BIGINT) AS view_count, CAST(YEAR(o.o_orderdate) AS INT) AS year,
               'CH' || CAST(o.o_custkey % 7 AS STRING) AS channel,
               CAST(o.o_orderkey % 4000 AS INT) AS duration_seconds
        FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
        JOIN {nation} n ON n.n_nationkey = o.o_orderkey % 25""",
    "v_appearance": """
        SELECT talk_id, object_id, speaker AS name, conference_name, view_count, year, channel FROM {v_talk}
        UNION ALL
        SELECT talk_id, object_id, co_speaker, conference_name, view_count, year, channel
        FROM {v_talk} WHERE co_speaker IS NOT NULL""",
    "v_cfp": """
        SELECT p_partkey AS object_id, p_name AS name,
               'https://c' || CAST(p_size AS STRING) || '.example/' AS cfp_url,
               CASE p_partkey % 3 WHEN 0 THEN 'callingallpapers' WHEN 1 THEN 'confs.tech' ELSE 'developers.events' END
                 AS source,
               p_type AS topic_a, p_brand AS topic_b, p_partkey AS seq,
               CAST(1706659200 + (p_size - 20) * 86400 AS BIGINT) AS cfp_end_date,
               CAST(FLOOR(p_retailprice) AS BIGINT) % 100 AS popularity_score,
               CAST(p_size % 6 AS BIGINT) AS hn_stories, CAST(p_size % 6 * 37 AS BIGINT) AS hn_points,
               CAST(p_partkey % 9 AS BIGINT) AS github_repos, CAST(p_partkey % 300 AS BIGINT) AS github_stars,
               CAST(p_partkey % 4 AS BIGINT) AS reddit_posts,
               CASE WHEN p_size % 4 = 0 THEN 'Online' ELSE 'CITY_' || CAST(p_size AS STRING) END AS city,
               n_name AS country, r_name AS continent,
               CASE WHEN p_partkey % 2 = 0 THEN r_name || ' area' END AS region,
               CASE p_size % 3 WHEN 0 THEN 'virtual' WHEN 1 THEN 'in-person' ELSE 'hybrid' END AS event_format,
               CASE p_size % 4 WHEN 0 THEN 'beginner' WHEN 1 THEN 'all-levels' WHEN 2 THEN 'advanced' END
                 AS audience_level,
               CASE WHEN p_partkey % 5 <> 0 THEN 'About ' || p_name END AS description,
               CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size * 3 - 75 AS DOUBLE) ELSE 0e0 END AS lat,
               CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 360 - 180 AS DOUBLE) END AS lng
        FROM {part} JOIN {nation} ON n_nationkey = p_partkey % 25 JOIN {region} ON r_regionkey = n_regionkey""",
    "v_event": """
        SELECT event_id, ts, user_id AS user_token, {json:props:k} AS object_id,
               CASE event_type WHEN 'purchase' THEN 'conversion' ELSE event_type END AS event_type
        FROM {events} WHERE event_type IN ('view', 'click', 'purchase')""",
    # two-word part names read like people: 'red widget' -> 'Red Widget'
    "v_person": """
        SELECT p_partkey AS id, p_brand AS brand, LOWER(p_type) AS kind, p_size AS size, p_name AS raw_name,
               UPPER(SUBSTRING(p_name, 1, 1)) || SUBSTRING(SPLIT_PART(p_name, ' ', 1), 2) || ' ' ||
               UPPER(SUBSTRING(SPLIT_PART(p_name, ' ', 2), 1, 1)) || SUBSTRING(SPLIT_PART(p_name, ' ', 2), 2) AS person
        FROM {part}""",
    "v_title": """
        SELECT id, person, size,
               CASE id % 9
                 WHEN 0 THEN 'Scaling ' || brand || ' - ' || person || ' - NDC London 2024'
                 WHEN 1 THEN 'Inside ' || kind || ' - ' || person || ' - Some Event 20' || LPAD(CAST(size % 30 AS STRING), 2, '0')
                 WHEN 2 THEN 'Notes on ' || kind || ' | ' || person
                 WHEN 3 THEN person || ': the ' || kind || ' story'
                 WHEN 4 THEN 'A tour of ' || brand || ' by ' || person
                 WHEN 5 THEN 'Part one | ' || person || ' | DevDays 2016'
                 WHEN 6 THEN 'KubeCon ' || CAST(2000 + size AS STRING) || ' keynote recap'
                 WHEN 7 THEN 'python meetup #2019 ' || raw_name
                 ELSE 'Show HN: ' || raw_name END AS title,
               CASE WHEN id % 11 = 0 THEN 'Gaming Hub' WHEN id % 3 = 0 THEN 'PyConf ' || brand
                    WHEN id % 13 = 0 THEN 'Google ' || kind ELSE 'Channel ' || CAST(size % 7 AS STRING) END AS channel,
               CASE WHEN id % 4 = 0 THEN 'A session about cloud ' || kind WHEN id % 4 = 1 THEN '' END AS description,
               CAST(id % 29 * 60 AS INT) AS duration_seconds,
               CAST(id * 7919 % 700000 AS BIGINT) AS view_count,
               'https://www.youtube.com/watch?v=' || SUBSTRING(MD5(CAST(id % 1500 AS STRING)), 1, 11) ||
                 CASE WHEN id % 2 = 0 THEN '&t=10' ELSE '' END AS url
        FROM {v_person}""",
    # place texts of every shape the location rules know
    "v_place": """
        SELECT id, CASE id % 12
                 WHEN 0 THEN 'Chicago ' || CAST(size AS STRING) || ', Illinois, USA'
                 WHEN 1 THEN 'San Jose, CA'
                 WHEN 2 THEN 'Berlin' || CAST(size % 5 AS STRING) || ', Germany'
                 WHEN 3 THEN CASE size % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'worldwide' WHEN 2 THEN 'Virtual' ELSE ' remote ' END
                 WHEN 4 THEN CASE size % 5 WHEN 0 THEN 'UK' WHEN 1 THEN 'Japan' WHEN 2 THEN 'Czechia' WHEN 3 THEN 'Korea' ELSE 'Brazil' END
                 WHEN 5 THEN person || ', ' || CASE size % 6 WHEN 0 THEN 'Holland' WHEN 1 THEN 'England' WHEN 2 THEN 'Poland'
                      WHEN 3 THEN 'Kenya' WHEN 4 THEN 'Peru' ELSE 'Nowhere' END
                 WHEN 6 THEN 'Austin, texas'
                 WHEN 7 THEN 'Toronto , Ontario,  Canada'
                 WHEN 8 THEN 'Hall ' || CAST(size AS STRING) || ', Lyon, Rhone, France'
                 WHEN 9 THEN 'Portland, or, United States'
                 WHEN 10 THEN person ELSE '' END AS place,
               CASE id % 7
                 WHEN 0 THEN 'Paris' || CAST(size AS STRING) || ' (France)'
                 WHEN 1 THEN 'Austin, TX (USA) & Online'
                 WHEN 2 THEN 'Online' WHEN 3 THEN 'Lisbon & Online' WHEN 4 THEN person || ', (Spain)'
                 WHEN 5 THEN 'Rome &amp; Online' ELSE '' END AS city_country,
               CASE WHEN size % 3 = 0 THEN 'Texas' WHEN size % 3 = 1 THEN '' END AS state,
               CASE size % 7 WHEN 0 THEN 'US' WHEN 1 THEN ' Scotland ' WHEN 2 THEN 'Italy' WHEN 3 THEN 'Chile'
                    WHEN 4 THEN 'Atlantis' WHEN 5 THEN '' END AS country,
               CASE WHEN size % 11 = 0 THEN 'Given' END AS region
        FROM {v_person}""",
    # one timestamp written in many ways
    "v_when": """
        SELECT o_orderkey AS id, d, CASE o_orderkey % 8
                 WHEN 0 THEN d || 'T10:20:30Z' WHEN 1 THEN d || 'T01:02:03+02:00' WHEN 2 THEN d || 'T01:02:03.250+00:00'
                 WHEN 3 THEN d || 'T23:59:59' WHEN 4 THEN d WHEN 5 THEN d || ' 12:30' WHEN 6 THEN 'TBA' ELSE 'soon' END AS iso,
               CASE o_orderkey % 6 WHEN 0 THEN d || ' 23:59:59' WHEN 1 THEN ' ' || d || ' 23:59 ' WHEN 2 THEN d
                 WHEN 3 THEN 'tba' WHEN 4 THEN d || 'x' END AS deadline,
               CASE o_orderkey % 9
                 WHEN 0 THEN mon || ' ' || dd || ', ' || yy WHEN 1 THEN SUBSTRING(mon, 1, 3) || ' ' || dd || ', ' || yy
                 WHEN 2 THEN dd || ' ' || mon || ' ' || yy WHEN 3 THEN dd || ' ' || SUBSTRING(mon, 1, 3) || ' ' || yy
                 WHEN 4 THEN mm || '/' || dd || '/' || yy WHEN 5 THEN dd || '/' || mm || '/' || yy
                 WHEN 6 THEN yy || '/' || mm || '/' || dd WHEN 7 THEN d || ' and later' ELSE mon || ' ' || dd || ' ' || yy END AS loose,
               days, days * 86400 + o_orderkey % 86400 AS epoch
        FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
                     SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4) AS yy,
                     SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) AS mm,
                     SUBSTRING(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) AS dd,
                     CASE MONTH(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March'
                       WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August'
                       WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS mon,
                     CAST({days:o_orderdate} AS BIGINT) AS days
              FROM {orders})""",
    # document texts with call-like sentences around them
    "v_note": """
        SELECT doc_id, CASE doc_id % 4
                 WHEN 0 THEN text || ' Submission deadline: January 15, 2026. The conference starts on 2026-03-0' ||
                      CAST(1 + doc_id % 9 AS STRING) || ' and ends 5 March 2026.'
                 WHEN 1 THEN 'Call closes 02/1' || CAST(doc_id % 10 AS STRING) || '/2025 for all. ' || text ||
                      ' Topics include: Rust, data lakes and streaming, API design. Location: Lisbon, Portugal'
                 WHEN 2 THEN 'Papers due 2025-13-40 or 3 Feb 2025; event date 2025-06-01 through 2025-06-0' ||
                      CAST(1 + doc_id % 9 AS STRING) || ' held at New York, United States. ' || text
                 ELSE text END AS note
        FROM {documents}""",
    # conferences named after parts, and posts and repositories about them
    "v_conf": """
        SELECT MIN(p_partkey) AS conf_id, p_name || ' 2024' AS conf_name FROM {part} GROUP BY p_name""",
    "v_subject": """
        SELECT o.l_orderkey AS post_id, o.qty, p.p_name AS thing, p.p_brand AS brand, LOWER(p.p_type) AS kind, c.conf_id, c.conf_name
        FROM (SELECT l_orderkey, MIN(l_partkey) AS pk, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM {lineitem} GROUP BY l_orderkey) o
        JOIN {part} p ON p.p_partkey = o.pk JOIN {v_conf} c ON c.conf_name = p.p_name || ' 2024'""",
    "v_post": """
        SELECT post_id, conf_id, conf_name, qty AS points, post_id % 13 AS num_comments,
               CASE post_id % 9 WHEN 0 THEN 'Show HN: ' || thing || ' tool' WHEN 1 THEN 'Talks from ' || UPPER(thing) || ' 2023 Online'
                 WHEN 2 THEN REPLACE(thing, ' ', '-') || ' schedule ' || brand WHEN 3 THEN REPLACE(thing, ' ', '') || 's Notes by SpeakerTeam'
                 WHEN 4 THEN 'Weekly digest: ' || thing WHEN 5 THEN 'I built something in Rust' WHEN 6 THEN 'All ' || thing || 's are Great'
                 WHEN 7 THEN 'Drama about nothing' ELSE 'Old' || thing || ' Recap' END AS title,
               CASE post_id % 6 WHEN 0 THEN 'Kpop' WHEN 1 THEN 'programming' WHEN 2 THEN 'Rust' WHEN 3 THEN brand ELSE 'music' END AS subreddit,
               CASE post_id % 5 WHEN 0 THEN 'News' WHEN 1 THEN kind END AS flair,
               CASE WHEN post_id % 4 = 0 THEN 'We went to ' || thing || ' and it was a very good time for everyone there' WHEN post_id % 4 = 1 THEN 'short' END AS selftext,
               'user' || CAST(post_id % 37 AS STRING) AS author, 'https://p.example/' || CAST(post_id % 5000 AS STRING) AS url, brand, kind
        FROM {v_subject}""",
    "v_repo": """
        SELECT post_id, conf_id, conf_name, qty * (post_id % 11) AS stars,
               CASE post_id % 8 WHEN 0 THEN REPLACE(thing, ' ', '-') || '-website' WHEN 1 THEN SPLIT_PART(thing, ' ', 1) || '-demo' WHEN 2 THEN 'awesome-' || kind
                 WHEN 3 THEN SPLIT_PART(thing, ' ', 2) || '-2025' WHEN 4 THEN 'interview-prep' WHEN 5 THEN 'misc' WHEN 6 THEN SPLIT_PART(thing, ' ', 2) ELSE kind END AS name,
               CASE WHEN post_id % 3 = 0 THEN REPLACE(thing, ' ', '') || 'Org' ELSE 'dev' || CAST(post_id % 7 AS STRING) END AS owner,
               CASE post_id % 5 WHEN 0 THEN 'The official ' || thing || ' site' WHEN 1 THEN 'Slides about ' || thing WHEN 2 THEN 'An Awesome list' WHEN 3 THEN '' END AS description,
               CASE post_id % 4 WHEN 0 THEN 'Rust' WHEN 1 THEN 'Go' WHEN 2 THEN brand END AS language,
               CASE WHEN post_id % 7 = 0 THEN REPLACE(thing, ' ', '-') ELSE kind END AS topic
        FROM {v_subject}""",
    # the pages with structured data and call wording added
    "v_page": """
        SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://sessionize.com/ev' WHEN 1 THEN 'https://www.papercall.io/ev' WHEN 2 THEN 'https://pretalx.com/ev'
                 WHEN 3 THEN 'https://www.eventbrite.com/e/' ELSE 'https://Ev.example/' END || CAST(page_id AS STRING) AS page_url,
               REPLACE(REPLACE(REPLACE(html, '</head>', CASE page_id % 4
                   WHEN 0 THEN '<script type="application/ld+json">{"@type": "Thing", "name": "no"}</script><script type="application/ld+json">{"@context": "x", "@type": "Event", "name": "Ev ' ||
                     CAST(page_id AS STRING) || '", "startDate": "2026-05-01T09:00", "endDate": "May 3, 2026", "location": {"@type": "Place", "name": "Hall", "address": {"addressLocality": "Lyon", "addressCountry": "France"}}, "keywords": "rust, data"}</script>'
                   WHEN 1 THEN '<script type="application/ld+json">[{"@type": ["Thing", "Festival"], "name": "Fest ' || CAST(page_id AS STRING) || '", "location": {"@type": "VirtualLocation", "name": "Net"}, "keywords": ["k1", "k2"]}]</script>'
                   WHEN 2 THEN '<script type="application/ld+json">{"@type": "SocialEvent", "description": "Meet", "location": "Online via web", "url": "https://s.example/"}</script>'
                   ELSE '<script type="application/ld+json">{broken</script>' END ||
                 CASE WHEN page_id % 3 = 0 THEN '<meta property="og:title" content="Og ' || CAST(page_id AS STRING) || '"><meta property="og:event:start_time" content="2026-06-0' || CAST(1 + page_id % 9 AS STRING) ||
                     'T10:00"/><meta content="About &amp; more" property="og:description">' ELSE '' END ||
                 CASE WHEN page_id % 5 = 0 THEN '<meta name="description" content=" A page "><meta name="keywords" content="x, y ,z">' ELSE '' END || '</head>'),
                 '</article>', CASE page_id % 6 WHEN 0 THEN '<p>Call for papers. Submissions close: March 5, 2026. Event: May 1, 2026 - May 3, 2026</p>'
                   WHEN 1 THEN '<p>Call for speakers, CFP closes April 2, 2026. Event date: June 7 2026</p><p>Location: Lyon, France</p>'
                   WHEN 2 THEN '<p>Submit a talk, deadline: 2026-04-30. The conference starts 2026-09-01 and ends 2026-09-03</p>'
                   WHEN 3 THEN '<div class="date-info">On July 4, 2026</div><div class="venue">Big Hall</div>' ELSE '' END || '</article>'),
                 '<article>', '<article><h1 class="event-title">Title ' || CAST(page_id AS STRING) || '</h1><div class="description">Come to number ' || CAST(page_id AS STRING) || '</div><span class="tag">rust</span><span class="topic-tag">data</span>') AS html
        FROM {pages}""",
}


def _json_field(engine: str, column: str, key: str) -> str:
    if engine == "spark":
        return f"get_json_object({column}, '$.{key}')"
    return f"json_extract_string({column}, '$.{key}')"


def render(text: str, engine: str, sf_dir: str | None = None) -> str:
    """Fill ``{table}``, ``{view}`` and ``{json:column:key}`` or ``{days:column}`` marks for ``engine`` ('spark' or 'duckdb')."""

    def replace(match: re.Match) -> str:
        name = match.group(1)
        if name.startswith("days:"):
            column = name.removeprefix("days:")
            return f"unix_date(CAST({column} AS DATE))" if engine == "spark" else f"FLOOR(epoch({column}) / 86400)"
        if name.startswith("json:"):
            _, column, key = name.split(":")
            return _json_field(engine, column, key)
        if name in VIEWS:
            return f"({render(VIEWS[name], engine, sf_dir)})"
        if name in TABLES:
            return f"parquet.`{sf_dir}/{name}.parquet`" if engine == "spark" else name
        raise KeyError(name)

    return re.sub(r"\{([a-z_]+(?::[a-z_]+){0,2})\}", replace, text)
