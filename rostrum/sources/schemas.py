"""Explicit schemas of feeds and tables; readers never infer."""

from __future__ import annotations

AGGREGATOR = """name STRING, uri STRING, dateCfpStart STRING, dateCfpEnd STRING, dateEventStart STRING,
    dateEventEnd STRING, location STRING, latitude DOUBLE, longitude DOUBLE, timezone STRING,
    description STRING, eventUri STRING, iconUri STRING, tags ARRAY<STRING>, source STRING, lastChange STRING"""

TOPIC_FILE = """name STRING, url STRING, startDate STRING, endDate STRING, city STRING, country STRING,
    online BOOLEAN, cfpUrl STRING, cfpEndDate STRING, twitter STRING, bluesky STRING, locales STRING,
    cocUrl STRING, offersSignLanguageOrCC BOOLEAN"""

DEADLINES = """title STRING, year INT, id STRING, link STRING, deadline STRING, timezone STRING, date STRING,
    place STRING, sub STRING, abstract_deadline STRING, note STRING, hindex INT, full_name STRING,
    start STRING, end STRING, paperslink STRING, pwclink STRING"""

DEV_EVENTS = """link STRING, until STRING, untilDate BIGINT,
    conf STRUCT<name: STRING, date: ARRAY<BIGINT>, hyperlink: STRING, status: STRING, location: STRING>"""

CFP_LIST = """conferenceName STRING, link STRING, cfpLink STRING, cfpDeadline STRING, eventDate STRING, location STRING"""

EVENTS_CSV = "userToken STRING, timestamp STRING, objectID STRING, eventType STRING, eventName STRING"

ALIAS_FILE = """speakers ARRAY<STRUCT<name: STRING, aliases: ARRAY<STRING>, titles: ARRAY<STRING>>>,
    name_aliases MAP<STRING, STRING>"""

URL_STORE = """url STRING, source STRING, name STRING, cfp_url STRING, extracted BOOLEAN,
    extraction_failed BOOLEAN, last_attempt DOUBLE, retry_count INT, max_retries_reached BOOLEAN,
    fetch_method STRING, is_spa BOOLEAN, http_status INT, error_reason STRING, added_at DOUBLE"""

OUTCOMES = """url STRING, ok BOOLEAN, attempted_at DOUBLE, fetch_method STRING, is_spa BOOLEAN,
    http_status INT, error_reason STRING, is_retry BOOLEAN"""

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_token BIGINT, object_id STRING, event_type STRING"
