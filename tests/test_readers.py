"""Feed readers on whole documents: arrays, envelopes and what goes to quarantine."""

import json

from pyspark.sql import functions as F

from rostrum.functions import arrays
from rostrum.plans.storage import new_path
from rostrum.sources import readers


def document(spark, text):
    path = new_path(spark, "doc")
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.text(path)
    return path


def test_aggregator_documents(spark):
    rows = [{"name": "A", "uri": "u1", "tags": ["x"]}, {"name": None, "uri": "u2"}, {"name": "C", "uri": "u3", "latitude": 1.5}]
    for shape in ({"cfps": rows}, rows):
        feed = readers.read_aggregator_feed(spark, document(spark, json.dumps(shape, indent=1)))
        assert sorted(r.name for r in feed.rows.collect()) == ["A", "C"]
        assert [r.uri for r in feed.quarantine.collect()] == ["u2"]


def test_broken_document(spark):
    feed = readers.read_aggregator_feed(spark, document(spark, '{"cfps": [ {"name": '))
    assert feed.rows.count() == 0 and feed.quarantine.count() == 1


def test_other_feeds(spark):
    dated = [{"title": "T", "year": 2026, "id": "t26", "sub": "ML"}, {"title": "Old", "year": 2020, "id": "o", "sub": ["A", "B"]}, {"title": "No id", "year": 2026}]
    feed = readers.read_deadlines_feed(spark, document(spark, json.dumps(dated)), 2024)
    assert [(r.id, r.sub) for r in feed.rows.collect()] == [("t26", ["ML"])] and feed.quarantine.count() == 1
    links = [{"link": "https://a", "conferenceName": "A", "cfpLink": "https://c"}, {"link": "", "conferenceName": "B"}, {"conferenceName": "C"}]
    feed = readers.read_cfplist_feed(spark, document(spark, json.dumps(links)))
    assert [tuple(r) for r in feed.rows.collect()] == [("https://a", "A", "https://c")] and feed.quarantine.count() == 2


def test_enrichment_lists(spark):
    answers = spark.createDataFrame([(1, "Sure: " + json.dumps([str(i) for i in range(30)]), "none", '["q"]')], "id INT, keywords STRING, topics STRING, quotes STRING")
    whole = arrays.parsed_enrichment(answers)
    assert [(len(r.keywords), r.topics, r.quotes) for r in whole.collect()] == [(30, [], ["q"])]
    cut = arrays.bounded_enrichment(whole, keywords=7)
    assert [len(r.keywords) for r in cut.collect()] == [7] and cut.filter(F.size("quotes") == 1).count() == 1
