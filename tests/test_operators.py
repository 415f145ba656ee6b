"""Operators against plain sequential versions on small fixtures."""

import random
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rostrum.operators import dedup, graph, intel, joins, ranking, state, windows
from rostrum.operators import aggregates as A
from rostrum.plans.storage import new_path
from rostrum.streaming import crawl, trending


def greedy(rows):
    """One-by-one de-duplication: preferred source first, then input order."""
    urls, names, kept = set(), set(), []
    for row in sorted(rows, key=lambda r: (r["source"] != "callingallpapers", r["seq"])):
        url = (row["cfp_url"] or "").lower().rstrip("/")
        name = row["name"].lower().replace(" ", "").replace("-", "")[:30]
        if (url and url in urls) or name in names:
            continue
        if url:
            urls.add(url)
        names.add(name)
        kept.append(row["object_id"])
    return set(kept)


@pytest.mark.parametrize("seed", range(4))
def test_dedup_equals_sequential(spark, seed):
    rng = random.Random(seed)
    # seed 3: one name holds a third of the rows
    rows = [{
        "object_id": i, "seq": i, "source": rng.choice(["callingallpapers", "a", "b"]),
        "cfp_url": rng.choice([None, "", f"https://c{rng.randrange(25)}/", f"HTTPS://C{rng.randrange(25)}"]),
        "name": "Hot Name" if seed == 3 and i % 3 == 0 else f"Conf-{rng.randrange(30)} x",
    } for i in range(120)]
    df = spark.createDataFrame(rows, "object_id INT, seq INT, source STRING, cfp_url STRING, name STRING")
    assert {r.object_id for r in dedup.dedup_cfps(df, ["seq"]).collect()} == greedy(rows)


def test_dedup_chain(spark):
    # A blocks B by link; B is dropped, so it does not block C by name
    rows = [(1, 1, "a", "u1", "n1"), (2, 2, "a", "u1", "n2"), (3, 3, "a", "u2", "n2")]
    df = spark.createDataFrame(rows, "object_id INT, seq INT, source STRING, cfp_url STRING, name STRING")
    assert sorted(r.object_id for r in dedup.dedup_cfps(df, ["seq"]).collect()) == [1, 3]


@pytest.mark.parametrize(("letters", "passes"), [(500_000, 8), (9, 99), (9, 1)])  # one automaton, several, groups of letters
def test_mentions_equal_brute_force(spark, monkeypatch, letters, passes):
    monkeypatch.setattr(joins, "AUTOMATON_LETTERS", letters)
    monkeypatch.setattr(joins, "AUTOMATON_PASSES", passes)
    from rostrum.operators.filters import is_noise_title

    confs = spark.createDataFrame([(1, "Go"), (2, "Rust Days 2024"), (3, "x"), (4, "PyCon (EU)"), (5, "")], "conf_id INT, conf_name STRING")
    titles = ["Go is fun", "ergo sum", "rustdays notes", "Rust-Days talk", "weekly rust days", "xylophone", "pycon", "", "a"]
    posts = spark.createDataFrame(list(enumerate(titles)), "post_id INT, title STRING")
    got = {(r.conf_id, r.post_id) for r in joins.mention_join(confs, posts).collect()}
    every = confs.filter("conf_name <> ''").crossJoin(posts).filter(~is_noise_title(F.col("title"), F.col("conf_name")))
    assert got == {(r.conf_id, r.post_id) for r in every.collect()} and len(got) >= 6


def test_related_items_of_all_equal_one_by_one(spark):
    rng = random.Random(12)
    names = [f"t{i}" for i in range(12)]
    rows = [(i, [rng.choice(names[: rng.choice([2, 12])]) for _ in range(rng.randint(0, 5))]) for i in range(150)] + [(200, None), (201, [None, "t1"]), (None, ["t1"]), (202, ["alone"])]
    items = spark.createDataFrame(rows, "object_id INT, topics ARRAY<STRING>")
    sets = {i: {x for x in t or [] if x} for i, t in rows if i is not None}
    for k in (1, 6, 500):
        out = ranking.related_for_all(items, k)
        got = {(r.object_id, r["rank"], r.related, round(r.score, 9)) for r in out.collect()}
        want = set()
        for i, a in sets.items():
            alike = sorted((-round(len(a & b) / len(a | b), 9), j) for j, b in sets.items() if j != i and a & b)
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(alike[:k])}
        assert got == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert ranking.related_for_all(items.limit(0)).count() == 0


def similarity(left, right):
    """Score of two names by the rules, one pair at a time."""
    plain = lambda n: "".join(c for c in unicodedata.normalize("NFKD", n.lower().strip()) if unicodedata.category(c) != "Mn")
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    x, y = plain(left), plain(right)
    (p, q) = (x.split(), y.split())
    rules = [(x == y, 1.0), (not p or not q, 0.0), (not set(p) - set(q), 0.95), (not set(q) - set(p), 0.9)]
    for holds, score in rules:
        if holds:
            return score
    if 1 in (len(p), len(q)):
        return ratio(x, y)
    first, last = ratio(p[0], q[0]), ratio(p[-1], q[-1])
    return last / 2 if last < 0.7 and first > 0.9 else 0.4 * first + 0.6 * last


@pytest.mark.parametrize("threshold", [0.6, 0.65, 0.8])
def test_fuzzy_match_equals_brute_force(spark, threshold):
    rng = random.Random(threshold)
    firsts = ["Ada", "Éric", "Ørjan", "Xavier", "John", "Jon", "Zoë", "Andrew", "Daniel", "Anna Maria", "Åsa", "Li"]
    lasts = ["Lovelace", "Ünal", "Åberg", "Nkomo", "Black", "Leong", "Ångström", "Phiri", "Turing", "Hopper", "Smith"]

    def typo(name):
        at = rng.randrange(len(name))
        return rng.choice([name, name[:at] + rng.choice("aexz") + name[at + 1 :], name[:at] + name[at + 1 :], unicodedata.normalize("NFD", name), name.upper(), "Dr " + name])

    left = [f"{rng.choice(firsts)} {rng.choice(lasts)}" for _ in range(60)] + ["Prince", "Éric Ünal", "Ørjan Åberg", "Xavier Nkomo", "  ", "a b\tc", "Li"]
    right = [typo(f"{rng.choice(firsts)} {rng.choice(lasts)}") for _ in range(60)] + ["Prynce", "Eric Unal", "Orjan Aberg", "Havier Mkomo", "Princ Es", "x", "Madonna"]
    a, b = (spark.createDataFrame([(n,) for n in names + names[:3] + [None]], "name STRING") for names in (left, right))
    got = {r.name: (r.match, round(r.score, 9)) for r in joins.fuzzy_match_people(a, b, threshold).collect()}
    best = {n: min((-round(similarity(n, m), 9), m) for m in set(right) if m) for n in left}
    assert got == {n: (m, -s) for n, (s, m) in best.items() if -s >= threshold}


def test_repeated_one_letter_words(spark):
    rows = spark.createDataFrame([("1", "ab x ac"), ("2", "a x ab"), ("3", "x a")], "object_id STRING, name STRING")
    hits = [r.object_id for r in ranking.keyword_search(rows, "a x a", "cfps", k=9).collect()]
    assert sorted(hits) == ["2", "3"]


def test_tied_conferences(spark):
    rows = spark.createDataFrame([("s", "UK two", 1), ("s", "Uz one", 1), ("s", "US three", 1)], "slug STRING, conference_name STRING, n BIGINT")
    for order in ("conference_name", "n"):
        first = A._conference_facts(rows.orderBy(order)).collect()
        assert first == A._conference_facts(rows.orderBy(F.desc("conference_name"))).collect()


def test_discovery_of_a_long_chain(spark):
    rows = [(f"t{i}", f"P{i} Doe", f"P{i + 1} Doe", "C", i, 2020) for i in range(60)]
    talks = spark.createDataFrame(rows, "object_id STRING, listed_under STRING, speaker STRING, channel STRING, view_count INT, year INT").coalesce(1)
    found = graph.bfs_discover(spark.createDataFrame([("P0 Doe",)], "name STRING"), talks, max_speakers=1000)
    assert found["speakers"].count() == 61 and found["talks"].count() == 60


def test_star_positions(spark):
    rng = random.Random(5)
    stars = [rng.choice([0, 7, 7, 7, rng.randrange(100000)]) for _ in range(501)]
    row = intel.star_distribution(spark.createDataFrame([(s,) for s in stars], "stars BIGINT")).collect()[0]
    ordered = sorted(stars, reverse=True)
    assert (row.max, row.median, row.p90) == (ordered[0], ordered[250], ordered[50])


def test_budget(spark):
    weights = [(f"o{i}", w) for i, w in enumerate([5, 1, 3, 3, 0, 2])]
    df = spark.createDataFrame(weights, "object_id STRING, weight INT")
    spread = windows.budgeted_events(df, 10).groupBy("object_id").count()
    assert {r["object_id"]: r["count"] for r in spread.collect()} == {"o0": 5, "o2": 3, "o3": 2}
    assert windows.budgeted_events(df, 100).count() == 14 and windows.budgeted_events(df, 8).count() == 8
    many = spark.range(5000).selectExpr("lpad(id, 5, '0') AS object_id", "3 AS weight")
    got = windows.budgeted_events(many, 3001).groupBy("object_id").count().collect()
    assert sum(r["count"] for r in got) == 3001 and max(r["object_id"] for r in got) == "01000" and len(got) == 1001


@pytest.mark.parametrize("retries,hours,ready", [(0, 0.99, False), (0, 1, True), (1, 5.9, False), (1, 6, True), (2, 23, False), (9, 24, True)])
def test_backoff(spark, retries, hours, ready):
    row = (True, False, "Timeout", retries, 1e6 - hours * 3600)
    df = spark.createDataFrame([row], "extraction_failed BOOLEAN, max_retries_reached BOOLEAN, error_reason STRING, retry_count INT, last_attempt DOUBLE")
    assert df.select(state.may_retry(1e6)).collect()[0][0] is ready


def test_match_score_bounds(spark):
    schema = """topics ARRAY<STRING>, technologies ARRAY<STRING>, city STRING, country STRING, audience_level STRING, event_format STRING,
        hn_stories INT, github_stars INT, popularity_score DOUBLE, days_until_cfp_close INT"""
    df = spark.createDataFrame([
        (["frontend", "ai-ml"], [], "Lyon", "France", "all-levels", "virtual", 3, 500, 80.0, 3), (["data"], [], None, None, None, None, None, None, None, None)], schema)
    profile = ranking.Profile(topics=["frontend", "ai-ml"], preferred_formats=["virtual"])
    first, second = [r.m for r in df.select(ranking.match_score(profile).alias("m")).collect()]
    assert first.score == 85 and first.reasons == ["Topics: frontend, ai-ml", "Level fit", "virtual event"]
    assert second.score == 35 and second.reasons == []
    assert df.select(ranking.match_score(ranking.Profile()).alias("m")).collect()[0].m.score == 50
    # an unknown place meets any wish unless strict
    wish = ranking.Profile(topics=["zz"], travel_wants=["japan"])
    loose, strict = (df.select(ranking.match_score(wish, strict=s).alias("m")).collect()[1].m.score for s in (False, True))
    assert loose - strict == 10


def test_badges(spark):
    talks = [(f"t{i}", "Ada", [], f"Conf {i} Europe" if i else "KubeCon NA", 60000, 2023 + i % 2, ["ai"]) for i in range(6)]
    df = spark.createDataFrame(talks, "object_id STRING, speaker STRING, speakers ARRAY<STRING>, conference_name STRING, view_count INT, year INT, topics ARRAY<STRING>")
    row = A.build_speakers(df, 2024).collect()[0]
    assert row.achievements == ["100K Club", "Viral Hit", "Rising Star", "Multi-Conference", "Expert: ai", "Consistent", "International", "Main Stage"]
    assert row.top_talk_ids == ["t0", "t1", "t2", "t3", "t4"] and row.talk_count == 6


def test_speakers_of_one_talk(spark):
    df = spark.createDataFrame([("t", "Ada", ["Ada", "ada.", "Keynote", "B"], "c", 1, 2020, [])],
                               "object_id STRING, speaker STRING, speakers ARRAY<STRING>, conference_name STRING, view_count INT, year INT, topics ARRAY<STRING>")
    assert A.speaker_totals(A.speaker_appearances(df)).collect()[0].talk_count == 2
    assert A.speaker_totals(A.speaker_appearances(df, dedupe_person=True)).collect()[0].talk_count == 1


def test_discovery_stops_at_limit(spark):
    rows = [(f"t{i}", f"P{i} Doe", f"P{i + 1} Doe", "C", i, 2020) for i in range(8)]
    talks = spark.createDataFrame(rows, "object_id STRING, listed_under STRING, speaker STRING, channel STRING, view_count INT, year INT")
    seeds = spark.createDataFrame([("P0 Doe",)], "name STRING")
    found = graph.bfs_discover(seeds, talks, max_speakers=3)
    assert found["talks"].count() == 3 and found["speakers"].count() == 4
    assert [r.talk_count for r in found["channels"].collect()] == [3]


def test_outcome_replay_and_late_outcomes(spark):
    path, source = new_path(spark, "store"), new_path(spark, "out")
    from rostrum.sources.schemas import OUTCOMES, URL_STORE

    row = ("u", "s", None, None, False, False, None, 0, False, None, False, None, None, 1.0)
    crawl.create_store(spark, path, spark.createDataFrame([row, ("v", *row[1:])], URL_STORE))
    tries = [("u/", False, float(t), None, False, 503, "503", True) for t in (10, 20)]
    spark.createDataFrame(tries, OUTCOMES).write.parquet(source)
    for _ in range(2):  # a second run from the start changes nothing
        crawl.run_outcomes(spark, source, path, new_path(spark, "cp")).awaitTermination()
    state = lambda: [(r.url, r.retry_count, r.last_attempt, r.extraction_failed, r.extracted, r.error_reason) for r in crawl.read_store(spark, path).orderBy("url").collect()]
    assert state() == [("u", 2, 20.0, True, False, "503"), ("v", 0, None, False, False, None)]
    # a file that comes late, with an earlier failure and a success in between
    late = [("u", False, 5.0, None, False, 429, "429", True), ("u", True, 15.0, "http", True, None, None, True), ("v", True, 30.0, "http", False, None, None, False)]
    spark.createDataFrame(late, OUTCOMES).write.mode("append").parquet(source)
    crawl.run_outcomes(spark, source, path, new_path(spark, "cp")).awaitTermination()
    assert state() == [("u", 3, 20.0, True, True, "503"), ("v", 0, 30.0, False, True, None)]
    folded = crawl.read_store(spark, path).filter("url = 'u'").collect()[0]
    assert (folded.fetch_method, folded.is_spa, folded.max_retries_reached, folded.http_status) == ("http", True, True, 503)


def test_stream_equals_batch(spark):
    source, sink = new_path(spark, "ev"), new_path(spark, "tr")
    rows = spark.range(400).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 7200) AS ts", "id % 5 AS user_token", "CAST(id % 3 AS STRING) AS object_id", "'view' AS event_type")
    checkpoint = new_path(spark, "cp")
    for part in ("event_id < 250", "event_id >= 250"):  # two runs of one stream
        rows.filter(part).write.mode("append").parquet(source)
        trending.write_trending(trending.event_stream(spark, source), sink, checkpoint).awaitTermination()
    assert {tuple(r) for r in trending.read_trending(spark, sink).collect()} == {tuple(r) for r in trending.trending_windows(rows).collect()}


def test_state_holds_panes_and_late_events_are_counted(spark):
    source, sink, checkpoint = new_path(spark, "ev"), new_path(spark, "tr"), new_path(spark, "cp")
    rows = spark.range(300).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 7200) AS ts", "id % 5 AS user_token", "CAST(id % 100 AS STRING) AS object_id", "IF(id % 2 = 0, 'view', 'conversion') AS event_type")
    late = rows.filter("event_id = 0").withColumn("event_id", F.lit(999).cast("bigint"))
    dropped, state = 0, 0
    for part in (rows, late):
        part.coalesce(1).write.mode("append").parquet(source)
        query = trending.write_trending(trending.event_stream(spark, source), sink, checkpoint)
        query.awaitTermination()
        dropped += trending.dropped_late(query)
        state = max([state, *(int(o["numRowsTotal"]) for p in query.recentProgress for o in p["stateOperators"])])
    got = {tuple(r) for r in trending.read_trending(spark, sink).collect()}
    sliding = rows.groupBy(F.window("ts", "7 days", "1 day"), "object_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "conversion").alias("c"))
    want = {(r.window.start, r.window.end, r.object_id, r.n, r.c) for r in sliding.collect()}
    assert got == want and dropped == 1
    assert 0 < 6 * state < len(want)  # one row a pane, not one a window


def test_compacted_outcomes_equal_the_fold(spark):
    """20 batches of shuffled, doubled outcomes: the same state as one fold, a short log, and what is too late kept apart."""
    from rostrum.sources.schemas import OUTCOMES, URL_STORE

    rng = random.Random(3)
    row = ("s", None, None, False, False, None, 0, False, None, False, None, None, 1.0)
    store = spark.createDataFrame([(f"u{i}", *row) for i in range(6)], URL_STORE)
    outcomes = [
        (f"u{rng.randrange(7)}" + rng.choice(["", "/"]), rng.random() < 0.3, 100.0 * t + rng.randrange(90), rng.choice([None, "", "http"]), rng.random() < 0.5, rng.choice([None, 0, 503]), rng.choice([None, "timeout", "503", "404"]), rng.random() < 0.6)
        for t in range(20) for _ in range(3)]
    doubled = outcomes + rng.sample(outcomes, 20)
    doubled.sort(key=lambda o: o[2] + rng.uniform(-150, 150))  # out of order by less than the log waits
    source, path, checkpoint = new_path(spark, "out"), new_path(spark, "store"), new_path(spark, "cp")
    crawl.create_store(spark, path, store)
    longest = 0
    for k in range(0, len(doubled), 4):
        spark.createDataFrame(doubled[k : k + 4], OUTCOMES).coalesce(1).write.mode("append").parquet(source)
        crawl.run_outcomes(spark, source, path, checkpoint, wait=400.0).awaitTermination()
        longest = max(longest, crawl.logged_outcomes(spark, path).count())
    want = {tuple(r) for r in state.fold_outcomes(store, spark.createDataFrame(outcomes, OUTCOMES)).collect()}
    assert {tuple(r) for r in crawl.read_store(spark, path).collect()} == want
    assert longest <= 30 < len(doubled) and crawl.read_late(spark, path).count() == 0
    assert len(crawl.Files(spark, crawl.outcome_log(path)).names("")) < 15
    # a second stream over the same files: what the table holds is not counted again
    crawl.run_outcomes(spark, source, path, new_path(spark, "cp"), wait=400.0).awaitTermination()
    assert {tuple(r) for r in crawl.read_store(spark, path).collect()} == want
    assert 0 < crawl.read_late(spark, path).count() < len(doubled)


def test_blank_and_missing_pages_get_outcomes(spark):
    from rostrum.plans import jobs
    from rostrum.sources.schemas import URL_STORE

    row = ("s", "", "", False, False, None, 0, False, "", False, 0, "", 1.0)
    store = spark.createDataFrame([(u, *row) for u in ("https://a.example", "https://b.example", "https://c.example")], URL_STORE)
    html = '<html><head><title>Conf</title><script type="application/ld+json">{"@type": "Event", "name": "Conf 1"}</script></head><body><p>Call for papers</p></body></html>'
    pages = spark.createDataFrame([("https://a.example/", html, None), ("https://b.example", "", "timeout")], "page_url STRING, html STRING, error_reason STRING")
    _, after = jobs.extract_and_record(store, pages, 100.0)
    got = {r.url[8]: (r.extracted, r.extraction_failed, r.error_reason, r.max_retries_reached) for r in after.collect()}
    assert got == {"a": (True, False, "", False), "b": (False, True, "timeout", False), "c": (False, True, "", False)}


def test_a_level_of_discovery_reads_links_only(spark, monkeypatch):
    """Talks are matched with their owners once, after the loop, however many levels there are."""
    rows = [(f"t{i}", "x", f"P{chr(97 + i)} Doe", "c", 5, 2020, f"P{chr(97 + i - 1)} Doe" if i else "Pz Doe") for i in range(1, 8)]
    talks = spark.createDataFrame(rows, "object_id STRING, title STRING, speaker STRING, channel STRING, view_count INT, year INT, listed_under STRING")
    calls, whole = [], graph.first_per_key
    monkeypatch.setattr(graph, "first_per_key", lambda *a: calls.append(1) or whole(*a))
    found = graph.bfs_discover(spark.createDataFrame([("Pa Doe",)], "name STRING"), talks, max_speakers=100)
    assert {(r.slug, r.level, r.talk_count) for r in found["speakers"].collect()} == {(f"p{chr(97 + i)}-doe", i, int(i < 7)) for i in range(8)}
    assert len(calls) == 1


def test_calls_without_link_stay_out_of_the_page_join(spark):
    from rostrum.operators import speaker_calls

    location = "struct('' AS city, CAST(NULL AS STRING) AS state, '' AS country, '' AS raw) AS location"
    calls = spark.range(20).selectExpr("id", "CASE WHEN id < 2 THEN concat('u', id) END AS sessionize_url", "false AS sessionize_enriched", "'old' AS attendance", "'' AS description", "'' AS full_text", location)
    mined = spark.sql("""SELECT 'u1' AS page_url, '99' AS attendance, CAST(array() AS array<string>) AS session_formats, CAST(array() AS array<string>) AS tracks, CAST(NULL AS STRING) AS target_audience,
        named_struct('travel', 'covered', 'hotel', CAST(NULL AS STRING), 'ticket', false, 'payment', CAST(NULL AS STRING)) AS benefits, 'virtual' AS event_format, 'd' AS description, 'c' AS clean_text, '' AS location_raw""")
    out = speaker_calls.apply_sessionize(calls, mined)
    assert {(r.id, r.attendance, r.sessionize_enriched) for r in out.collect()} == {(i, "99" if i == 1 else "old", i == 1) for i in range(20)}
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
