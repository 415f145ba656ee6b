"""How much of a text or list a record carries. The default is what exported records hold; WHOLE keeps everything.

Operators that build records take ``cuts``, so a table can keep whole values and be cut when it is exported.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cuts:
    """Characters of texts and entries of lists; None keeps the whole value."""

    #: texts
    name: int | None = 200
    description: int | None = 500
    place: int | None = 100
    audience: int | None = 200
    comment: int | None = 500
    repository: int | None = 300
    transcript: int | None = 10_000
    #: lists
    topics: int | None = 10
    tracks: int | None = 20
    compact: int | None = 5
    titles: int | None = 30
    comments: int | None = 50
    authors: int | None = 20
    reddit_comments: int | None = 30
    #: child records per source
    stories: int | None = 50
    repos: int | None = 30
    posts: int | None = 30
    articles: int | None = 30


RECORD = Cuts()
WHOLE = Cuts(**{f.name: None for f in fields(Cuts)})


def cut_text(text: Column | str, most: int | None) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return column if most is None else F.substring(column, 1, most)


def cut_list(items: Column | str, most: int | None) -> Column:
    column = F.col(items) if isinstance(items, str) else items
    return column if most is None else F.slice(column, 1, most)
