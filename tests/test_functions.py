"""Column functions on small literal tables."""

import pytest
from pyspark.sql import functions as F

from rostrum.functions import arrays as A
from rostrum.functions import dates as D
from rostrum.functions import html as H
from rostrum.functions import places as P
from rostrum.functions import text as S


def values(spark, items, rule):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i INT, v STRING")
    return [r.x for r in rows.select("i", rule(F.col("v")).alias("x")).orderBy("i").collect()]


def test_slugs_and_names(spark):
    assert values(spark, ["Ada Lovelace!", "  ", None, "É-b"], S.slugify) == ["ada-lovelace", "", "", "b"]
    assert values(spark, ["KubeCon 2026", "RustConf - CFP open", "Py (EU)"], S.clean_name) == ["KubeCon", "RustConf", "Py"]
    assert values(spark, ["a  b\x00", "caf\xc3\xa9", " "], S.repair_text) == ["a b", "cafe", None]


def test_title_shapes(spark):
    titles = [
        "You Don't Know Git - Edward Thomson - NDC London 2024", "Fast Data - Ada Lovelace - Some Event 2023", "Notes | Ada Lovelace",
        "Ada Lovelace: the engine", "A tour by Ada Lovelace", "Part | Ada Lovelace | DevDays", "just a title",
    ]
    got = values(spark, titles, S.speaker_from_title)
    assert [g.speaker for g in got] == ["Edward Thomson"] + ["Ada Lovelace"] * 5 + [None]
    assert got[0].title == "You Don't Know Git" and got[3].title == "the engine" and got[6].title == "just a title"


def test_links(spark):
    links = ["https://github.com/ada/repo", "https://github.com/orgs/x", "https://ada.github.io", "https://github.com/search"]
    assert values(spark, links, S.github_user) == ["ada", None, None, None]
    assert values(spark, ["https://sessionize.com/ev/", "https://x.y/a/b"], S.url_path_slug) == ["ev", None]


@pytest.mark.parametrize("text,day", [
    ("January 5, 2026", "2026-01-05"), ("JAN 5, 2026", "2026-01-05"), ("5 March 2026", "2026-03-05"), ("01/15/2026", "2026-01-15"),
    ("15/01/2026", "2026-01-15"), ("03/04/2026", "2026-03-04"), ("2026/1/5", "2026-01-05"), ("2026-01-05T10:00", "2026-01-05"),
    ("February 30, 2026", None), ("January 5 2026", None), ("soon", None),
])
def test_loose_dates(spark, text, day):
    assert values(spark, [text], D.parse_any_date) == [day]


def test_epochs(spark):
    texts = ["1970-01-02", "1970-01-01T00:00:10Z", "1970-01-01T02:00:00+02:00", "1970-01-01T00:00:01.9", "x", ""]
    assert values(spark, texts, D.parse_iso) == [86400, 10, 0, 1, None, None]
    assert values(spark, ["1970-01-01", "1970-1-1", "bad"], D.deadline_epoch) == [86399, 86399, None]
    assert values(spark, ["tba", "1970-01-01 00:01", " 1970-01-01 "], D.parse_deadline) == [None, 60, 0]


def test_dates_in_text(spark):
    text = "x" * 200 + " Deadline: January 15, 2026. The conference starts 2026-03-01 and ends 5 March 2026"
    near = values(spark, [text], D.dates_near_keywords)[0]
    assert near == ["2026-03-01", "2026-01-15", "2026-03-05"]
    found = values(spark, [text], D.all_dates_with_context)[0]
    assert [d.day for d in found] == ["2026-03-01", "2026-01-15", "2026-03-05"]
    assert all(len(d.context) <= 117 for d in found)


@pytest.mark.parametrize("raw,city,state,country,region,continent", [
    ("Chicago, Illinois, USA", "Chicago", "Illinois", "USA", "Midwest", "North America"),
    ("San Francisco, CA", "San Francisco", "California", "USA", "West", "North America"),
    ("London, UK", "London", None, "United Kingdom", "Northern Europe", "Europe"),
    ("Online", "Online", None, None, None, None), ("Japan", None, None, "Japan", None, "Asia"),
    ("Atlantis", "Atlantis", None, None, None, None),
])
def test_locations(spark, raw, city, state, country, region, continent):
    got = values(spark, [raw], P.parse_location)[0]
    assert (got.city, got.state, got.country, got.region, got.continent) == (city, state, country, region, continent)


def test_city_country(spark):
    got = values(spark, ["Paris (France)", "Austin, TX (USA)", "Online", "Lisbon & Online", None], P.parse_city_country)
    assert [(g.city, g.state, g.country) for g in got] == [
        ("Paris", None, "France"), ("Austin", "TX", "USA"), (None, None, None), ("Lisbon", None, None), (None, None, None)]


def test_json_and_captions(spark):
    answers = ['{"a":1}', 'x ```json {"a":2} ``` y', 'is {"a":3} ok', "none"]
    assert values(spark, answers, A.rescue_json) == ['{"a":1}', '{"a":2}', '{"a":3}', None]
    assert values(spark, ['see ["a","b"]', "no"], A.rescue_json_array) == [["a", "b"], []]
    captions = '{"events":[{"segs":[{"utf8":"hello "},{"utf8":"[Music]"}]},{},{"segs":[{"utf8":"\\n"},{"utf8":"big  world"}]}]}'
    assert values(spark, [captions, '{"events":[]}'], A.flatten_captions) == ["hello big world", None]


def test_html(spark):
    page = "<html><!-- x --><script>var a='<p>';</script><nav>skip</nav><p>One<p>Two &amp; three</p><div>x</div></html>"
    assert values(spark, [page], lambda c: H.visible_text(c, ("script", "nav"))) == ["One Two & three x"]
    assert values(spark, [page], lambda c: H.paragraphs(H.drop_elements(c, ("script", "nav")))) == [["One", "Two & three"]]
    assert values(spark, ['<div id="root"></div>', "<div ng-app>" + "word " * 200], H.is_spa_shell) == [True, False]
    assert values(spark, ["peer-to-peer talk"], A.title_case) == ["Peer-To-Peer Talk"]


def test_cuts_are_parameters(spark):
    """Whole values on demand; the default is what records hold."""
    from rostrum.functions.cuts import WHOLE, Cuts
    from rostrum.operators import intel, pages, projections

    long_ = "word " * 400
    html = f'<html><head><title>{"T" * 300}</title><meta name="keywords" content="{",".join(f"k{i}" for i in range(30))}"></head><body><p>{long_}</p></body></html>'
    rows = spark.createDataFrame([("https://x.example", html)], "page_url STRING, html STRING")
    sizes = lambda cuts: pages.extract_pages(rows, cuts).select("e.name", "e.description", "e.topics").first()
    whole, cut, short = sizes(WHOLE), sizes(Cuts()), sizes(Cuts(topics=3))
    assert len(whole.topics) == 30 and len(cut.topics) == 10 and len(short.topics) == 3
    assert len(whole.description) >= 1999 and len(cut.description) == 500 and len(whole.name) == 300
    talks = spark.createDataFrame([("a",)], "object_id STRING")
    said = spark.createDataFrame([("a", "x" * 20_000, "s", ["k"], ["t"], ["w"])], "object_id STRING, text STRING, summary STRING, keywords ARRAY<STRING>, topics ARRAY<STRING>, takeaways ARRAY<STRING>")
    for cuts, size in ((WHOLE, 20_000), (Cuts(), 10_000)):
        assert len(projections.apply_transcripts(talks, said, cuts).first().transcript_text) == size
    bundle = spark.sql("SELECT 1 AS conf_id, 'c' AS conf_name, named_struct('stories', sequence(1, 90), 'total', 90L, 'titles', array('a'), 'comments', array('b'), 'authors', array('c')) AS hn, named_struct('repos', sequence(1, 40), 'total', 40L) AS github, named_struct('posts', array(1), 'total', 1L, 'comments', array('x')) AS reddit, named_struct('articles', array(1), 'total', 1L) AS devto")
    for cuts, n in ((WHOLE, 90), (Cuts(), 50)):
        assert len(intel.split_intel_records(bundle, cuts)["hn"].first().stories) == n
