"""Location columns. A location is ``STRUCT<city, state, country, region, continent, raw>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions.text import blank_to_null, contains_any, let, literal_map, or_else, strip

FIELDS = ("city", "state", "country", "region", "continent", "raw")
_EUROPE = {c: region for region, names in L.EUROPE_REGIONS.items() for c in names}
_US = {s: region for region, names in L.US_REGIONS.items() for s in names}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def location(**fields: Column) -> Column:
    """A full location struct; fields that are not given are NULL."""
    return F.struct(*[fields.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])


def normalize_country(country: Column) -> Column:
    name = strip(country)
    return F.coalesce(_lookup(L.COUNTRY_ALIASES, name), name)


def continent_of(country: Column) -> Column:
    return _lookup(L.COUNTRY_CONTINENT, country)


def us_region(state: Column) -> Column:
    return _lookup(_US, state)


def europe_region(country: Column) -> Column:
    return _lookup(_EUROPE, country)


def us_state(text: Column) -> Column:
    """Full state name of an abbreviation or a name in any case, NULL for other text."""
    return F.coalesce(
        _lookup(L.US_STATES, F.upper(text)), _lookup({v.lower(): v for v in L.US_STATES.values()}, F.lower(text))
    )


def _with_region(city: Column, state: Column, country: Column, raw: Column) -> Column:
    continent = continent_of(country)
    region = F.when(state.isNotNull() & (state != "") & (country == "USA"), us_region(state)).when(
        continent == "Europe", europe_region(country)
    )
    return location(city=city, state=state, country=country, region=region, continent=continent, raw=raw)


def parse_location(text: Column) -> Column:
    """Free text such as ``Chicago, Illinois, USA`` to a location."""
    raw = strip(text)
    parts = F.transform(F.split(raw, ","), strip)
    n = F.size(parts)
    first, last, middle = F.get(parts, F.lit(0)), F.get(parts, n - 1), F.get(parts, n - 2)
    null = F.lit(None).cast("string")
    online = F.lower(raw).isin(L.ONLINE_WORDS)
    known_country = continent_of(first).isNotNull()
    city = F.when(online, F.lit("Online")).when((n == 1) & known_country, null).otherwise(first)
    state = F.when(online, null).when(n >= 3, F.coalesce(us_state(middle), middle)).when(n == 2, us_state(last))
    country = (
        F.when(online, null)
        .when(n >= 3, normalize_country(last))
        .when(n == 2, F.when(us_state(last).isNotNull(), F.lit("USA")).otherwise(normalize_country(last)))
        .when(known_country, normalize_country(first))
    )
    return F.when(text != "", _with_region(city, state, country, raw)).otherwise(location(raw=text))


def normalize_location(place: Column) -> Column:
    """Parse a location that has only ``raw``; otherwise unify the country and fill empty regions."""
    only_raw = (
        blank_to_null(place["raw"]).isNotNull()
        & blank_to_null(place["city"]).isNull()
        & blank_to_null(place["country"]).isNull()
    )
    has_country = blank_to_null(place["country"]).isNotNull()
    country = F.when(has_country, normalize_country(place["country"])).otherwise(place["country"])
    continent = F.when(has_country, or_else(place["continent"], continent_of(country))).otherwise(place["continent"])
    has_state = blank_to_null(place["state"]).isNotNull()
    region = F.when(has_state & (country == "USA"), or_else(place["region"], us_region(place["state"]))).otherwise(
        place["region"]
    )
    europe = has_country & (continent == "Europe") & blank_to_null(region).isNull()
    region = F.when(europe, europe_region(country)).otherwise(region)
    filled = location(
        city=place["city"], state=place["state"], country=country, region=region, continent=continent,
        raw=place["raw"],
    )
    return F.when(only_raw, parse_location(place["raw"])).otherwise(filled)


def parse_place(text: Column) -> Column:
    """First and last comma part as city and country."""
    parts = F.transform(F.split(text, ","), strip)
    n = F.size(parts)
    full = location(
        city=F.get(parts, F.lit(0)), country=F.when(n >= 2, F.get(parts, n - 1)), raw=text
    )
    return F.when(text != "", full).otherwise(location(raw=F.lit("")))


def parse_city_country(text: Column) -> Column:
    """``City (Country)`` and ``City, State (Country)``, with an optional ``& Online``."""
    plain = strip(F.replace(F.replace(text, F.lit("& Online"), F.lit("")), F.lit("&amp; Online"), F.lit("")))
    has_parens = F.contains(plain, F.lit("(")) & F.contains(plain, F.lit(")"))
    pieces = F.split(plain, r"\(")
    head = F.regexp_replace(strip(F.get(pieces, F.lit(0))), ",+$", "")
    country = strip(F.regexp_replace(F.get(pieces, F.lit(1)), r"\)+$", ""))
    head_parts = F.transform(F.split(head, ","), strip)
    with_state = location(
        city=F.get(head_parts, F.lit(0)), state=F.get(head_parts, F.lit(1)), country=country, raw=text
    )
    return (
        F.when(F.coalesce(text, F.lit("")) == "", location(raw=F.lit("")))
        .when(has_parens & F.contains(head, F.lit(",")), with_state)
        .when(has_parens, location(city=head, country=country, raw=text))
        .when(F.lower(plain) == "online", location(raw=F.lit("Online")))
        .otherwise(location(city=plain, raw=text))
    )


def near_location(text: Column) -> Column:
    """Struct ``(location, is_online)`` mined from page text."""
    labelled, city = L.LABELLED_LOCATION_PATTERN, L.CITY_PATTERN
    first, second = (F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (labelled, city))

    def rule(lowered: Column) -> Column:
        # looking for the words is cheap, the patterns run only where one stands
        label = F.when(contains_any(lowered, ["location", "venue", "where", "place"]), first)
        online = contains_any(lowered, ["online", "virtual", "remote", "hybrid"]) & text.rlike(L.ONLINE_OR_HYBRID_PATTERN)
        return F.struct(strip(F.coalesce(label, second)).alias("location"), online.alias("is_online"))

    return let(F.lower(text), rule)
