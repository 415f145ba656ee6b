"""Mining of speaker-call pages: session formats, benefits, attendance, dates and clean text."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions import html as H
from rostrum.functions.arrays import title_case
from rostrum.functions.cuts import RECORD, Cuts, cut_list, cut_text
from rostrum.functions.text import blank_to_null, collapse, contains_any, literal_map, or_else, strip
from rostrum.plans.storage import spread, staged


def page_text(html: Column) -> Column:
    """Visible one-line text of a call page."""
    return collapse(H.visible_text(html, ("script", "style", "nav", "footer")))


# ---- session formats ----------------------------------------------------------------------------
def format_name(name: Column) -> Column:
    key = F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("")), F.lit("-"), F.lit(""))
    return F.coalesce(F.try_element_at(literal_map(L.FORMAT_ALIASES), key), title_case(name))


# a rule can only match where one of its words occurs; the test is far cheaper than the rule
NAME_FIRST_WORDS = [
    ["talk", "presentation", "session"], ["lightning"], ["keynote"], ["workshop"], ["panel"], ["ignite"], ["deep"], ["tech"],
]
MIXED_WORDS = {5: ["workshop"]}  # the other mixed rules all need "min"


def _where(text: Column, words: list[str], pattern: str) -> Column:
    """All matches of a rule as short texts, none when its words do not occur."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(contains_any(F.lower(text), words), found).otherwise(F.array().cast("array<string>"))


def session_formats(text: Column) -> Column:
    """All format mentions as ``(name, duration, i)`` in rule order; ``text`` has plain blanks only.

    Each rule passes over the text once; its groups are read from the short matches.
    """

    def entry(name: Column, duration: Column) -> Column:
        return F.struct(format_name(name).alias("name"), duration.alias("duration"))

    def named(pattern: str):
        return lambda m: entry(strip(F.regexp_extract(m, pattern, 1)), blank_to_null(strip(F.regexp_extract(m, pattern, 2))))

    def mixed(pattern: str, second: bool):
        def read(m: Column) -> Column:
            a = strip(F.regexp_extract(m, pattern, 1))
            b = strip(F.regexp_extract(m, pattern, 2)) if second else F.lit("")
            numeric = a.rlike(r"^\d")
            raw = F.when(numeric, F.when((b != "") & (F.lower(b) != "long"), b).otherwise(F.lit("Session"))).otherwise(a)
            name = F.when((raw == "") | (F.lower(raw) == "long"), F.lit("Session")).otherwise(raw)
            return entry(name, F.when(numeric, F.concat(a, F.lit(" min"))).otherwise(F.when(b != "", F.concat(b, F.lit(" min")))))

        return read

    found = [F.transform(_where(text, words, p), named(p)) for words, p in zip(NAME_FIRST_WORDS, L.FORMAT_NAME_FIRST)]
    for i, pattern in enumerate(L.FORMAT_MIXED_ORDER):
        rule = "(?iu)" + pattern.removeprefix("(?i)") if not pattern.isascii() else pattern
        mentions = _where(text, MIXED_WORDS.get(i, ["min"]), rule)
        found.append(F.transform(mentions, mixed(rule, i not in L.FORMATS_WITHOUT_SECOND_GROUP)))
    return F.transform(
        F.concat(*found), lambda e, i: F.struct(e["name"].alias("name"), e["duration"].alias("duration"), i.alias("i"))
    )


def one_per_name(placed: Column) -> Column:
    """Keep the first entry of each name, or its first with a duration, in order of first use."""
    names = F.array_distinct(F.transform(placed, lambda e: e["name"]))

    def best(name: Column) -> Column:
        own = F.filter(placed, lambda e: e["name"] == name)
        timed = F.filter(own, lambda e: e["duration"].isNotNull())
        return F.struct(name.alias("name"), F.get(timed, F.lit(0))["duration"].alias("duration"))

    return F.transform(names, best)


# ---- single values ------------------------------------------------------------------------------
def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def _first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern in patterns:
        rule = rule.when(_has(text, pattern), F.regexp_extract(text, pattern, group))
    return rule


def attendance(text: Column) -> Column:
    return _first_match(text, L.ATTENDANCE_PATTERNS)


def target_audience(text: Column, cuts: Cuts = RECORD) -> Column:
    return cut_text(strip(_first_match(text, L.AUDIENCE_PATTERNS)), cuts.audience)


def is_call_open(text: Column) -> Column:
    return ~_has(text, L.CALL_CLOSED_PATTERN)


def speaker_benefits(text: Column) -> Column:
    """Struct ``travel, hotel, ticket, payment``; a stated refusal vetoes travel or hotel."""

    def vetoed(kind: str) -> Column:
        out = F.lit(False)
        for pattern in L.BENEFIT_VETOES.get(kind, []):
            out = out | _has(text, pattern)
        return out

    def value(kind: str) -> Column:
        rule = F.when(vetoed(kind), F.lit(None).cast("string")) if kind in L.BENEFIT_VETOES else F.when(F.lit(False), F.lit(None).cast("string"))
        for i, pattern in enumerate(L.BENEFIT_PATTERNS[kind]):
            if i in L.BENEFIT_CAPTURES.get(kind, []):
                amount = F.regexp_extract(text, pattern, 1)
                if kind == "travel":
                    said = F.when(amount.rlike(r"^\d+$"), F.concat(F.lit("$"), amount)).otherwise(F.lit("covered"))
                else:
                    said = F.when(amount.rlike(r"^\d"), F.concat(amount, F.lit(" nights"))).otherwise(F.lit("covered"))
            else:
                said = F.lit({"ticket": "yes", "payment": "paid"}.get(kind, "covered"))
            rule = rule.when(_has(text, pattern), said)
        return rule

    return F.struct(
        value("travel").alias("travel"), value("hotel").alias("hotel"),
        value("ticket").isNotNull().alias("ticket"), value("payment").alias("payment"),
    )


def call_metadata(text: Column) -> Column:
    """Struct of call and event dates, location, website and e-mail as written."""
    d = L.CALL_DATE_PATTERNS
    return F.struct(
        strip(_first(text, d["cfp_opens"])).alias("cfp_opens"), strip(_first(text, d["cfp_closes"])).alias("cfp_closes"),
        F.coalesce(strip(_first(text, d["event_date"])), strip(_first(text, d["event_starts"]))).alias("event_start"),
        strip(_first(text, d["event_ends"])).alias("event_end"),
        strip(_first(text, L.CALL_LOCATION_PATTERN)).alias("location_raw"),
        strip(_first(text, L.CALL_WEBSITE_PATTERN)).alias("website"), strip(_first(text, L.EMAIL_PATTERN, 0)).alias("contact_email"),
    )


# a word each boilerplate pattern needs; without the time zone mark its pattern would scan to the end from everywhere
BOILERPLATE_WORDS = ["sessionize.com", "call for", "timezone.", "closing time", "(utc", " left", "login with", "classic login", "404"]


def clean_call_text(text: Column, limit: int = 4000) -> Column:
    """Text without mined metadata and boilerplate.

    A metadata pattern is removed everywhere when it was used; a start pattern only when there is no
    event date.
    """
    d = L.CALL_DATE_PATTERNS
    lowered = F.lower(text)

    def used(pattern: str, *words: str) -> Column:
        return F.when(contains_any(lowered, words), F.lit(pattern))

    patterns = [
        used(d["cfp_opens"], "call opens"), used(d["cfp_closes"], "call closes"), used(d["event_date"], "event date"),
        F.when(F.contains(lowered, F.lit("event starts")) & ~_has(text, d["event_date"]), F.lit(d["event_starts"])),
        used(d["event_ends"], "event ends"),
    ]
    # these count as used only when they match the untouched text
    for pattern, word in ((L.CALL_LOCATION_PATTERN, "location"), (L.CALL_WEBSITE_PATTERN, "website"), (L.EMAIL_PATTERN, "@")):
        patterns.append(F.when(F.contains(lowered, F.lit(word)) & _has(text, pattern), F.lit(pattern)))
    patterns += [used(pattern, word) for word, pattern in zip(BOILERPLATE_WORDS, L.BOILERPLATE_PATTERNS)]
    # a fold mentions the text once per step, however many patterns apply
    out = F.aggregate(
        F.array_compact(F.array(*patterns)), text, lambda acc, p: F.regexp_replace(acc, p, F.lit(""))
    )
    for phrase in L.BOILERPLATE_STRINGS:
        out = F.replace(out, F.lit(phrase), F.lit(""))
    return F.substring(collapse(out), 1, limit)


def event_format(location_raw: Column, clean_text: Column, benefits: Column) -> Column:
    """virtual, hybrid or in-person by ordered evidence; unknown counts as in-person."""
    place, text = F.lower(strip(F.coalesce(location_raw, F.lit("")))), F.lower(F.coalesce(clean_text, F.lit("")))
    hybrid = F.contains(place, F.lit("hybrid")) | F.contains(F.substring(text, 1, 500), F.lit("hybrid"))
    return (
        F.when(place.isin(L.VIRTUAL_LOCATIONS), F.lit("virtual"))
        .when(hybrid, F.lit("hybrid"))
        .when(benefits["travel"].isNotNull() | benefits["hotel"].isNotNull(), F.lit("in-person"))
        .when((F.length(place) > 20) & F.contains(place, F.lit(",")), F.lit("in-person"))
        .when(contains_any(text, L.PHYSICAL_WORDS), F.lit("in-person"))
        .when(contains_any(text, L.VIRTUAL_WORDS), F.lit("virtual"))
        .otherwise(F.lit("in-person"))
    )


def tracks(html: Column, limit: int = 20) -> Column:
    """Track names: options of track selects, then items of the list after a track heading."""
    selects = F.regexp_extract_all(
        html, F.lit(r"""(?is)<select\b[^>]*\bname\s*=\s*["'][^"']*(?:track|category|topic)[^"']*["'][^>]*>(.*?)</select\s*>"""), F.lit(1)
    )
    options = F.flatten(F.transform(selects, lambda s: H.all_inner_text(s, "option")))
    options = F.filter(options, lambda o: (o != "") & ~o.isin(L.TRACK_PLACEHOLDERS))
    lists = F.regexp_extract_all(
        html, F.lit(r"(?is)<(h2|h3|h4|strong)\b[^>]*>[^<]*(?:track|topic|categor)[^<]*</\1\s*>\s*<(ul|ol)\b[^>]*>(.*?)</\2\s*>"), F.lit(3)
    )
    items = F.filter(F.flatten(F.transform(lists, lambda s: H.all_inner_text(s, "li"))), lambda i: (i != "") & (F.length(i) < 100))
    return F.slice(F.concat(options, F.array_except(items, options)), 1, limit)


def max_submissions(html: Column) -> Column:
    return _first(html, L.MAX_SUBMISSIONS_PATTERN).try_cast("int")


# ---- whole page ---------------------------------------------------------------------------------
def mine_calls(pages: DataFrame, cuts: Cuts = RECORD) -> DataFrame:
    """All mined columns of call pages (``page_url, html``); texts and structs are staged once."""
    html, text = F.col("html"), F.col("text")
    rows = staged(spread(pages, "page_url"), text=page_text(html))
    rows = staged(
        rows, placed=session_formats(text), benefits=speaker_benefits(text), meta=call_metadata(text), clean_text=clean_call_text(text)
    )
    return rows.select(
        *pages.columns, "text", one_per_name(F.col("placed")).alias("session_formats"), "benefits", attendance(text).alias("attendance"),
        target_audience(text, cuts).alias("target_audience"), tracks(html).alias("tracks"), max_submissions(html).alias("max_submissions"),
        is_call_open(text).alias("is_open"), "meta.*", "clean_text",
        cut_text(H.meta_content(H.meta_records(html), "description"), cuts.description).alias("description"),
        event_format(F.col("meta.location_raw"), F.col("clean_text"), F.col("benefits")).alias("event_format"),
    )


def apply_sessionize(cfps: DataFrame, mined: DataFrame, cuts: Cuts = RECORD) -> DataFrame:
    """Put mined values into the calls of the same platform link (``sessionize_url``).

    Mined columns overwrite when known; description and full text are filled only when empty, as are
    city, country and raw location (not for virtual events). Calls already enriched stay as they are.
    """
    fields = [
        "attendance", "session_formats", "benefits", "target_audience", "tracks", "event_format", "description", "clean_text",
        "location_raw", "city", "country",
    ]
    have = [f for f in fields if f in mined.columns]
    pages = mined.select(F.col("page_url").alias("sessionize_url"), F.struct(*have).alias("m"))
    # calls without a link match nothing; in the join their empty key would bring them all to one task
    linked = cfps.filter(F.col("sessionize_url").isNotNull()).join(pages, "sessionize_url", "left")
    joined = linked.unionByName(cfps.filter(F.col("sessionize_url").isNull()).withColumn("m", F.lit(None).cast(pages.schema["m"].dataType)))
    hit = F.col("m").isNotNull() & ~F.coalesce(F.col("sessionize_enriched"), F.lit(False))
    on_site = hit & (F.col("m.event_format") != "virtual") & blank_to_null(F.col("m.location_raw")).isNotNull()

    def over(name: str, value: Column, known: Column) -> Column:
        old = F.col(name) if name in cfps.columns else F.lit(None)
        return F.when(hit & known, value).otherwise(old)

    def fill(name: str, value: Column, when: Column) -> Column:
        return F.when(when & blank_to_null(F.col(name)).isNull(), value).otherwise(F.col(name))

    b = F.col("m.benefits")
    some = b["travel"].isNotNull() | b["hotel"].isNotNull() | b["ticket"] | b["payment"].isNotNull()
    out = {
        "attendance": over("attendance", F.col("m.attendance"), blank_to_null(F.col("m.attendance")).isNotNull()),
        "session_formats": over("session_formats", F.col("m.session_formats"), F.size("m.session_formats") > 0),
        "speaker_benefits": over("speaker_benefits", b, some),
        "target_audience": over("target_audience", F.col("m.target_audience"), blank_to_null(F.col("m.target_audience")).isNotNull()),
        "tracks": over("tracks", cut_list("m.tracks", cuts.tracks), F.size("m.tracks") > 0),
        "event_format": over("event_format", F.col("m.event_format"), F.col("m.event_format").isNotNull()),
        "description": fill("description", F.col("m.description"), hit),
        "full_text": fill("full_text", F.col("m.clean_text"), hit),
        "sessionize_enriched": F.when(hit, F.lit(True)).otherwise(F.coalesce("sessionize_enriched", F.lit(False))),
    }
    place = F.col("location")
    if "city" in have:
        place = place.withField("city", or_else(F.col("location.city"), F.col("m.city")))
    if "country" in have:
        place = place.withField("country", or_else(F.col("location.country"), F.col("m.country")))
    place = place.withField("raw", or_else(F.col("location.raw"), F.col("m.location_raw")))
    out["location"] = F.when(on_site, place).otherwise(F.col("location"))
    return joined.withColumns(out).drop("m")


# ---- checks -------------------------------------------------------------------------------------
def extraction_issues(relevant_text: Column, n_formats: Column, benefits: Column, found_attendance: Column) -> Column:
    """Array of values that the text seems to hold but mining missed."""
    text = F.lower(F.coalesce(relevant_text, F.lit("")))
    duration = r"(\d+)\s*(?:min|minute|hour)"
    said = F.regexp_extract(text, duration, 0)
    at = F.regexp_instr(text, F.lit(duration))
    around = F.substring(text, F.greatest(at - 20, F.lit(1)), F.least(at - 1, F.lit(20)) + F.length(said) + 20)
    missed_duration = _has(text, duration) & (n_formats == 0) & ~contains_any(around, L.COUNTDOWN_PHRASES)
    people = r"(\d{3,})\s*(?:attendee|participant|people)"

    def missed(phrases: list[str], known: Column, negatives: list[str]) -> Column:
        out = contains_any(text, phrases) & ~known
        return out & ~contains_any(text, negatives) if negatives else out

    return F.array_compact(F.array(
        F.when(missed_duration, F.concat(F.lit('MISSED_DURATION: found "'), said, F.lit('" but no formats extracted'))),
        F.when(missed(L.TRAVEL_PHRASES, benefits["travel"].isNotNull(), L.TRAVEL_NEGATIVES),
               F.lit("MISSED_TRAVEL: travel benefit pattern in text but not extracted")),
        F.when(missed(L.HOTEL_PHRASES, benefits["hotel"].isNotNull(), L.HOTEL_NEGATIVES),
               F.lit("MISSED_HOTEL: hotel benefit pattern in text but not extracted")),
        F.when(missed(L.FREE_TICKET_PHRASES, benefits["ticket"], []),
               F.lit("MISSED_FREE_TICKET: free ticket pattern in text but ticket not True")),
        F.when(_has(text, people) & (F.coalesce(found_attendance, F.lit("")) == ""),
               F.concat(F.lit('MISSED_ATTENDANCE: found "'), F.regexp_extract(text, people, 0), F.lit('" but not extracted'))),
    ))


def validation_report(rows: DataFrame) -> DataFrame:
    """Coverage counts with whole percentages and issue types as ``(kind, value, n, pct)`` rows.

    ``rows``: ``html_fetched, n_formats, benefits, attendance, issues``.
    """
    b = F.col("benefits")
    flags = {
        "total": F.lit(True), "html_fetched": F.col("html_fetched"), "with_formats": F.col("n_formats") > 0,
        "with_benefits": b["travel"].isNotNull() | b["hotel"].isNotNull() | b["ticket"] | b["payment"].isNotNull(),
        "with_attendance": F.coalesce(F.col("attendance"), F.lit("")) != "", "with_issues": F.size("issues") > 0,
    }
    counted = rows.agg(*[F.count_if(F.coalesce(f, F.lit(False))).alias(n) for n, f in flags.items()])
    pairs = F.array(*[
        F.struct(
            F.lit("coverage").alias("kind"), F.lit(n).alias("value"), F.col(n).alias("n"),
            F.floor(100 * F.col(n) / F.nullif(F.col("total"), F.lit(0))).cast("bigint").alias("pct"),
        ) for n in flags
    ])
    issues = rows.select(F.explode("issues").alias("issue")).groupBy(F.split("issue", ":")[0].alias("value")).agg(F.count("*").alias("n"))
    kinds = issues.select(F.lit("issue").alias("kind"), "value", "n", F.lit(None).cast("bigint").alias("pct"))
    return counted.select(F.inline(pairs)).unionByName(kinds)


