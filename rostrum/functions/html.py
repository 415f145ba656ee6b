"""HTML columns: visible text, tags and attributes by regular expression, all on the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rostrum import lookups as L
from rostrum.functions.text import collapse, let, strip


def decode_entities(text: Column) -> Column:
    """Decode the common named entities; a text without ``&`` is left alone at once."""

    def decoded(raw: Column) -> Column:
        out = raw
        for entity, char in L.TEXT_ENTITIES.items():
            out = F.replace(out, F.lit(entity), F.lit(char))
        return F.when(F.contains(raw, F.lit("&")), out).otherwise(raw)

    return let(text, decoded)


# blanks of other scripts and no-break blanks, which ``\\s`` of a plain pattern does not know
WIDE_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def drop_elements(html: Column, tags: Sequence[str]) -> Column:
    """Remove whole elements with their content, in one pass for all tags."""
    if not tags:
        return html
    return F.regexp_replace(html, rf"(?is)<({'|'.join(tags)})\b[^>]*>.*?</\1\s*>", "")


def strip_html(html: Column) -> Column:
    """Readable text: scripts and styles dropped, tags to blanks, five entities decoded at the end."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", "")
    text = collapse(F.regexp_replace(text, "<[^>]+>", " "))
    for entity, char in L.HTML_ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def is_spa_shell(html: Column) -> Column:
    """A page that needs a browser: a framework marker and little text of its own."""
    marker = reduce(or_, [html.rlike("(?i)" + p) for p in L.SPA_MARKERS])
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", "")
    return marker & (F.length(collapse(F.regexp_replace(text, "<[^>]+>", " "))) < L.SPA_MIN_TEXT)


def visible_text(html: Column, drop: Sequence[str] = ("script", "style"), separator: str = " ") -> Column:
    """Text nodes of a page joined by ``separator``; line breaks inside a node are kept, wide blanks become plain."""
    text = drop_elements(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), drop)
    text = F.regexp_replace(text, r"(?i)<!doctype[^>]*>", "")
    if separator:
        text = F.regexp_replace(text, r"\s*(?:<[^>]*>\s*)+", separator)
    else:
        text = F.regexp_replace(text, "<[^>]*>", "")
    # the look ahead passes over plain letters quicker than the list of blanks
    return strip(F.regexp_replace(decode_entities(text), rf"(?=[^\x00-\x9f])[{WIDE_BLANKS}]", " "))


def inner_text(html: Column, tag: str, attributes: str = "[^>]*") -> Column:
    """Text of the first ``tag`` element, NULL when the page has none."""
    element = F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b{attributes}>.*?</{tag}\s*>", 0), F.lit(""))
    return strip(decode_entities(F.regexp_replace(element, "<[^>]*>", "")))


def all_inner_text(html: Column, tag: str, attributes: str = "[^>]*") -> Column:
    """Texts of all ``tag`` elements in page order."""
    parts = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b{attributes}>(.*?)</{tag}\s*>"), F.lit(1))
    return F.transform(parts, lambda p: strip(decode_entities(F.regexp_replace(p, "<[^>]*>", ""))))


def paragraphs(html: Column) -> Column:
    """Texts of all paragraphs; one that is not closed ends at the next one or with its container."""
    # whole runs up to the next tag, so that only tags are compared with the ends of a paragraph
    end = r"/p\s*>|p\b|/(?:article|aside|blockquote|body|div|html|li|main|section|td)\b"
    pattern = rf"(?is)<p\b[^>]*>([^<]*+(?:<(?!{end})[^<]*+)*+)"
    parts = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    return F.transform(parts, lambda p: strip(decode_entities(F.regexp_replace(p, "<[^>]*>", ""))))


def classed_text(html: Column, class_words: str, tags: str = r"[a-z][a-z0-9]*") -> Column:
    """Texts of all elements whose class attribute holds one of ``class_words`` (a regex)."""
    pattern = rf"""(?is)<({tags})\b[^>]*\bclass\s*=\s*["'][^"']*(?:{class_words})[^"']*["'][^>]*>(.*?)</\1\s*>"""
    parts = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.transform(parts, lambda p: strip(decode_entities(F.regexp_replace(p, "<[^>]*>", ""))))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the text of one tag."""
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return decode_entities(F.substring(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0))))


def meta_tags(html: Column) -> Column:
    """The text of all ``<meta …>`` tags in page order."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))


def meta_records(html: Column) -> Column:
    """All ``<meta …>`` tags as structs ``name, property, content``, to be staged and read several times."""
    return F.transform(meta_tags(html), lambda t: F.struct(
        attribute(t, "name").alias("name"), attribute(t, "property").alias("property"), attribute(t, "content").alias("content")))


def meta_content(records: Column, name: str) -> Column:
    """``content`` of the first record of a name, NULL when the page has none."""
    return strip(F.get(F.filter(records, lambda t: t["name"] == name), F.lit(0))["content"])
