"""Vectors, near duplicates, language model and URL filter against brute force on small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rostrum.llm import language_model, near_duplicates, urls, vectors
from rostrum.llm.elias_fano import EliasFano
from rostrum.llm.tools import remainder, words

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, score int"


def embeddings():
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6).astype(np.float32)], 1) for i in range(400)]
    rows += [(1000 + i, rows[100][1], 1) for i in range(60)]  # equal vectors: ties
    rows += [(2000, None, 1), (2100, [float("nan")] * 6, 1), (2200, [0.0] * 6, 1), (2300, [0.5, None, 0.5], 1), (2400, [1.0, 2.0], 1), (2500, [], 1), (None, [1.0] * 6, 1)]
    return rows + [rows[0]]


def brute(rows, every, k, exact):
    clean = {i: tuple(math.floor(1024 * x) for x in v) if exact else tuple(v) for i, v, _ in rows
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (exact or any(v))}
    out = set()
    for q in clean:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(clean[q], v, strict=True)), i) for i, v in clean.items() if i != q and len(v) == len(clean[q]))
            out |= {(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(found[:k])}
    return out


def test_vector_search(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 100)
    monkeypatch.setattr(vectors, "CELL_QUERIES", 10)
    rows = embeddings()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.exact_top_k(df, "id % 10 = 0", 7).collect()}
    assert got == brute(rows, 10, 7, True)
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vectors.nearest_neighbours(df, "id % 20 = 0", 9).collect()}
    assert got == brute(rows, 20, 9, False)
    empty = spark.createDataFrame([], VECTORS)
    assert vectors.exact_top_k(empty, "id % 10 = 0").count() == 0 and vectors.nearest_neighbours(empty, "id % 20 = 0").count() == 0


def test_quantised_bounds_hold():
    rng = np.random.default_rng(2)
    ask, rows = rng.normal(size=(20, 8)), rng.normal(size=(300, 8))
    q, score, ids = vectors.bounded_tile(ask, np.arange(-20, 0), rows, np.arange(300), 5)
    truth = ask @ rows.T
    for i in range(20):
        assert set(np.argsort(-truth[i])[:5]) <= set(ids[q == i])
    assert len(q) < 20 * 300 / 4


def components(rows):
    sets = {}
    for i, t in rows:
        own = words(t)
        sets[i] = frozenset(zip(*[own[k:] for k in range(5)], strict=False)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def similar_texts():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(6, 90))]
        for _ in range(rng.choice([1, 2, 6, 30])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
            base = own if group % 3 == 0 else base  # chains: the ends are no longer similar
    rows += ["", None, " \n", "one two", "One  two", "two one", "x " * 30000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "GROUP", 5)
    rows = similar_texts()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows] + [(None, "no id", 0), (3, rows[3][1], 0)], "doc_id long, text string, n_shingles int").repartition(4)
    got = near_duplicates.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    want = components(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_near_duplicates_of_an_id_with_two_texts(spark, turned):
    rng = random.Random(8)
    a, b, c, d, e = ([f"{x}{rng.randrange(999)}" for _ in range(60)] for x in "abcde")
    near = lambda own: " ".join([*own[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (5, " ".join(c)), (5, " ".join(d)), (6, near(d)), (7, " ".join(e))]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7)}


def test_circulant_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1500], rng.integers(0, 1 << 63, 500, dtype=np.uint64)])
    same = (near_duplicates.signature(a, 1024) == near_duplicates.signature(b, 1024)).mean()
    assert abs(same - 0.6) < 0.06


def test_elias_fano():
    rng = np.random.default_rng(4)
    for n, top in ((0, 10), (1, 1), (700, 1 << 40), (3000, 3100), (4000, 1 << 62)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64)) if n else np.empty(0, np.uint64)
        own = EliasFano(v, top)
        assert (own.values() == v).all()
        asked = np.concatenate([v, rng.integers(0, top + 1, 300, dtype=np.uint64)])
        at, found = own.successor(asked)
        assert (found == np.isin(asked, v)).all() and (v[at[found]] == asked[found]).all()


@pytest.mark.parametrize("sizes", [(100, 60), (1_000_000, 1_000_000)])
def test_language_model(spark, sizes):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("the of and x y z q".split() + [f"r{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(500, None), (501, "A b\x0bC\xa0d"), (502, "new words only here"), (None, "the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    docs = docs.select("doc_id", "text", (remainder("doc_id", 5) == 1).alias("held"))
    got = language_model.score_documents(docs, "held", batch_tokens=sizes[0], shard_tokens=sizes[1]).collect()
    assert len(got) == len(rows)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    one, two = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            own = [*words(t), "</s>"]
            one.update(own)
            two.update(zip(["<s>", *own[:-1]], own, strict=True))
    n, v = sum(one.values()), len(one)
    p = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))
    texts = dict(rows)
    for r in got:
        own = [*words(texts[r.doc_id]), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(one[w] > 0 for w in own), n)
        assert r.held_out == (r.doc_id is not None and held(r.doc_id))
        assert abs(r.base_score - sum(math.log10(p(w)) for w in own)) < 1e-9
        assert math.isfinite(r.score) and r.score < 0
    if sizes[0] > 1000 and language_model.SHARD_TOKENS:
        # one context's probabilities add up to 1 over all words and one unseen word
        totals = defaultdict(int)
        for (a, _), c in two.items():
            totals[a] += c
        assert totals["<s>"] == one["</s>"]
    assert language_model.score_documents(docs.limit(0), "held").count() == 0


def test_hot_words_are_split(spark):
    rows = [(i, " ".join(["the", f"w{j}"][k % 2] for j in range(40) for k in range(2))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", (remainder("doc_id", 5) == 1).alias("held"))
    a = {r.doc_id: r.score for r in language_model.score_documents(docs, "held", batch_tokens=300, shard_tokens=100).collect()}
    assert len(a) == 30 and all(math.isfinite(s) for s in a.values())


def test_url_filter(spark, monkeypatch):
    texts = [
        "http://a.b.Example.ORG/es/x?q", "https://example.org/en/1", "https://example.org/en/2#x", "https://xexample.org/es/", "http://org", "http://org/", "http://x.com/de/",
        "http://x.com/fr/a/../de/", "nothing", "", None, "://", "http://a.com?b/de/", "x://y.com/de/ http://z", "http://example.org:80/es/", "http://" + "a." * 3000 + "com/de/" + "x" * 90000]
    rows = [(i, t, "kept") for i, t in enumerate(texts * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    want = sorted(con.execute(urls.ORACLE).fetchall(), key=lambda r: r[0])
    rules = urls.rule_table(spark)
    for limit in (urls.BROADCAST_RULES, 0):  # broadcast, and salted shuffle
        monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
        out = urls.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
        assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]) == want
    assert urls.filter_urls(pages, rules.limit(0)).filter("rule is not null or verdict <> 'allow'").count() == 0
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "pii", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    kept = corpus_pipeline.distinct_documents(spark, docs.union(docs.limit(5)), SMALL).collect()
    want = components([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in kept) == sorted({i for i, (_, c) in want.items() if i == c})
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and 0.5 * len(rows) <= out.count() <= len(rows), name
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 2048").count() == 0
    assert corpus_pipeline.packed_documents(spark, docs.limit(0), SMALL).count() == 0


CLASHING = ["score", "predicted", "rejected", "lang_pred", "pii", "id", "place", "named", "held", "kept", "rep", "cls", "count", "row", "toxic", "part", "piece", "length"]


def test_stages_keep_columns_of_clashing_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for n, name in enumerate(CLASHING):
        docs = docs.withColumn(name, F.concat(F.lit(f"{n}:"), "doc_id"))
    docs = docs.union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**9).cast("long")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        rows = out.filter("doc_id is not null and doc_id < 1000000").collect()
        assert rows and all(r[c] == f"{n}:{r.doc_id}" for r in rows for n, c in enumerate(CLASHING)), name
    packed = corpus_pipeline.packed_documents(spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns), name
