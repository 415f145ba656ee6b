"""String columns: cleaning, slugs, ids, labels and the title-to-speaker rule."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum import lookups as L


def py(pattern: str) -> str:
    """``pattern`` with Unicode word, space and case classes, as the fixed patterns were written for."""
    flags = re.match(r"\(\?([is]+)\)", pattern)
    if flags:
        return f"(?{flags.group(1)}U)" + pattern[flags.end():]
    return "(?U)" + pattern


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, py(pattern), group), F.lit(""))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(py(pattern))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when ``text`` holds one of ``words`` as a substring; stays in generated code."""
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    Long rules over a computed text would otherwise repeat its whole expression at each mention.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


# what ``\\s`` stands for in a Unicode pattern
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks; reads the ends only, not every blank of a long text."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def or_else(*values: Column) -> Column:
    """First value that is neither NULL nor empty text."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def slugify(text: Column) -> Column:
    """Lower case, other runs to ``-``, ends trimmed; NULL gives the empty slug."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def repair_text(text: Column) -> Column:
    """Undo the known mojibake, drop control characters and collapse white space; empty gives NULL."""
    fixed = F.replace(text, F.lit("\x00"), F.lit(""))
    for bad, good in L.MOJIBAKE.items():
        fixed = F.replace(fixed, F.lit(bad), F.lit(good))
    fixed = F.regexp_replace(fixed, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return blank_to_null(collapse(fixed))


def clean_name(name: Column) -> Column:
    """Conference name without its year, a ``- CFP`` suffix and a trailing parenthesis."""
    out = F.regexp_replace(name, py(r"\s*20\d{2}\s*"), " ")
    out = F.regexp_replace(out, py(r"(?i)\s*-\s*CFP.*$"), "")
    out = F.regexp_replace(out, py(r"\s*\(.*\)$"), "")
    return strip(out)


def clean_search_text(text: Column, limit: int = 10000) -> Column:
    """One-line text without unbroken runs of 50 or more word characters."""
    def without_runs(line: Column) -> Column:
        # most texts have no such run; word ends are looked for only where 50 characters stand together
        long = line.rlike("[^ ]{50}")
        return F.when(long, F.regexp_replace(line, py(r"\b\w{50,}\b"), "")).otherwise(line)

    return F.trim(F.substring(let(F.regexp_replace(text, py(r"\s+"), " "), without_runs), 1, limit))


def speaker_from_title(title: Column, brands: Sequence[str] = ()) -> Column:
    """Struct ``(title, speaker)`` mined from a talk title; ``speaker`` is NULL when no shape fits.

    ``brands`` adds house conference names to the fixed list of the first shape.
    """
    name, dash = L.NAME_PATTERN, r"\s*[-–]\s*"
    conferences = "|".join(re.escape(c) for c in [*L.TITLE_CONFERENCES, *brands])
    shapes = [  # pattern, group of the title, group of the speaker
        (rf"(?i)^(.+?){dash}({name}){dash}(?:{conferences})", 1, 2),
        (rf"^(.+?){dash}({name}){dash}.+\s+20\d{{2}}", 1, 2),
        (rf"^(.+?)\s*[-–|]\s*({name})\s*$", 1, 2),
        (rf"^({name})\s*:\s*(.+)$", 2, 1),
        (rf"(?i)^(.+?)\s+by\s+({name})\s*$", 1, 2),
    ]
    segments = F.transform(F.split(title, py(r"\s*\|\s*")), strip)
    piped = F.get(F.filter(F.slice(segments, 2, 1000000), lambda s: matches(s, f"^{name}$")), F.lit(0))
    result = F.when(piped.isNotNull(), F.struct(F.get(segments, F.lit(0)).alias("title"), piped.alias("speaker")))
    result = result.otherwise(F.struct(title.alias("title"), F.lit(None).cast("string").alias("speaker")))
    for pattern, title_group, speaker_group in reversed(shapes):
        found = F.struct(
            strip(F.regexp_extract(title, py(pattern), title_group)).alias("title"),
            strip(F.regexp_extract(title, py(pattern), speaker_group)).alias("speaker"),
        )
        result = F.when(matches(title, pattern), found).otherwise(result)
    return F.when(title.isNotNull(), result)


def channel_title_speaker(title: Column) -> Column:
    """Struct ``(title, speaker)`` for ``Title - First Last, Company`` listings of one channel."""
    pattern = r"^(.+?)\s*-\s*([A-Z][a-z]+(?: [A-Z][a-z]+)+)(?:,\s*\w+)?$"
    found = F.struct(
        strip(F.regexp_extract(title, py(pattern), 1)).alias("title"),
        strip(F.regexp_extract(title, py(pattern), 2)).alias("speaker"),
    )
    none = F.struct(title.alias("title"), F.lit(None).cast("string").alias("speaker"))
    return F.when(matches(title, pattern), found).otherwise(none)


def normalize_tag(tag: Column, extra: Mapping[str, str] | None = None) -> Column:
    """Canonical spelling of a tag, or the trimmed tag itself; ``extra`` adds house spellings."""
    table = literal_map({**L.CANONICAL_TAGS, **(extra or {})})
    return F.coalesce(F.try_element_at(table, strip(F.lower(tag))), strip(tag))


def hash_id(*parts: Column | str, prefix: str | None = None, kind: str = "sha1", length: int = 16) -> Column:
    """Leading hex digits of a hash over ``prefix:part:part…``."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    if prefix is not None:
        columns = [F.lit(prefix), *columns]
    key = F.concat_ws(":", *[c.cast("string") for c in columns])
    digest = {"sha1": F.sha1, "md5": F.md5, "sha256": lambda c: F.sha2(c, 256)}[kind](key)
    return F.substring(digest, 1, length)


def github_user(url: Column) -> Column:
    """User name of a profile link; NULL for pages that are no profile."""
    lowered = F.lower(url)
    user = extract(url, r"github\.com/([a-zA-Z0-9_-]+)")
    usable = F.contains(lowered, F.lit("github")) & ~contains_any(lowered, L.GITHUB_NOT_PROFILE)
    return F.when(usable & ~F.lower(user).isin(L.GITHUB_GENERIC_PATHS), user)


def url_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), "/+$", "")


def url_host(url: Column) -> Column:
    """Host with port, NULL when the text has none."""
    return extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)")


def url_path_slug(url: Column) -> Column:
    """The path when it is one segment, else NULL."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    slug = F.regexp_replace(path, "^/+|/+$", "")
    return F.when((slug != "") & ~F.contains(slug, F.lit("/")), slug)


def video_id(object_id: Column) -> Column:
    return F.when(object_id.startswith("yt_"), F.substring(object_id, 4, 1000000))


def duration_label(seconds: Column) -> Column:
    """``h:mm:ss`` or ``m:ss``; NULL for none or zero."""
    minutes, secs = F.floor(seconds / 60), F.lpad((seconds % 60).cast("string"), 2, "0")
    long = F.concat_ws(
        ":", F.floor(minutes / 60).cast("string"), F.lpad((minutes % 60).cast("string"), 2, "0"), secs
    )
    short = F.concat_ws(":", minutes.cast("string"), secs)
    return F.when(seconds != 0, F.when(minutes >= 60, long).otherwise(short))


def _fixed(value: Column, digits: int) -> Column:
    """Plain decimal text with a fixed number of digits and no grouping."""
    return F.round(value.cast("decimal(30,6)"), digits).cast(f"decimal(30,{digits})").cast("string")


def views_label(views: Column) -> Column:
    """``1.2M``, ``12K`` or the number; NULL for none or zero."""
    label = (
        F.when(views >= 1000000, F.concat(_fixed(views / 1000000, 1), F.lit("M")))
        .when(views >= 1000, F.concat(_fixed(views / 1000, 0), F.lit("K")))
        .otherwise(views.cast("string"))
    )
    return F.when(views != 0, label)


def compact_number(value: Column, style: str = "round") -> Column:
    """Thousands as ``K``: ``round`` (no digit), ``one`` (one digit) or ``floor``."""
    thousands = {
        "round": _fixed(value / 1000, 0),
        "one": _fixed(value / 1000, 1),
        "floor": F.floor(value / 1000).cast("string"),
    }[style]
    return F.when(value >= 1000, F.concat(thousands, F.lit("K"))).otherwise(value.cast("string"))


def why_submit(cfp_topics: Column, talk_topics: Column, hn_stories: Column, event_format: Column) -> Column:
    """One sentence on why a call fits a talk."""
    shared = F.filter(
        talk_topics, lambda t: F.exists(cfp_topics, lambda c: F.contains(F.lower(c), F.lower(t)))
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.size(shared) > 0, F.concat(F.lit("covers "), F.get(shared, F.lit(0)))),
            F.when(hn_stories > 0, F.lit("trending on HN")),
            F.when(event_format.isin("virtual", "hybrid"), F.lit("remote-friendly")),
        )
    )
    return F.when(F.size(reasons) > 0, F.concat(F.lit("Perfect fit: "), F.array_join(reasons, ", "))).otherwise(
        F.lit("Great opportunity to share your perspective")
    )


def best_comment(hn_comments: Column, reddit_comments: Column, limit: int = 200) -> Column:
    """First Hacker News comment, else first Reddit comment, cut with an ellipsis."""
    text = or_else(F.get(hn_comments, F.lit(0)), F.get(reddit_comments, F.lit(0)))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
