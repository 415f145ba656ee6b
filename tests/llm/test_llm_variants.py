"""Filter audit, spelling variants and SentencePiece against brute force, SQL and the library."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostrum.llm import filter_audit, spelling_variants
from rostrum.llm import sentence_pieces as pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "▁", " ▁ x", "a" * 3000, "<s> </s><unk>", "<0x0A>", "x \n\n" * 50, "中文字" * 700, "\x00\x85\xa0　", "no" + "blanks" * 400 + "!", "é 😀 İ"]
signs = st.text(alphabet="aAbßÉé  \n\t'stdre123²½中Σς▁\x00　😀.,!?<>", max_size=40)


@cache
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@cache
def own_model():
    return pieces.PieceModel(PIECES)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_odd_texts_equal_the_library():
    want = library().encode(ODD, add_bos=True, add_eos=True, num_threads=1)
    found = own_model().encode(ODD)
    assert [ids_of(f) for f in found] == want and [own_model().decode(f) for f in found] == library().decode(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(signs, min_size=1, max_size=8))
def test_pieces_equal_the_library(texts):
    want = library().encode(texts, add_bos=True, add_eos=True, num_threads=1)
    found = own_model().encode(texts)
    assert [ids_of(f) for f in found] == want
    assert [own_model().decode(f) for f in found] == library().decode(want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([0, 1, 2, 259, 28705, 198, 172, 229]), st.integers(3, 31999)), max_size=9))
def test_any_ids_are_decoded_as_by_the_library(ids):
    assert own_model().decode(np.array(ids, "<u4").tobytes()) == library().decode(ids)


def test_long_and_short_agendas_agree():
    rng = random.Random(3)
    chunks = ["".join(rng.choice("etaoin shrdlu".replace(" ", "▁")) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    model = own_model()
    short = model.merged(chunks)
    for chunk, ids in zip(chunks, short, strict=True):
        letters = model.letter[np.frombuffer(chunk.encode("utf-32-le"), "<u4")]
        assert model._ids(model.agenda(letters), chunk) == ids


def test_remembered_bytes_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_BYTES", 20_000)
    model, rng = pieces.PieceModel(PIECES), random.Random(4)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([5, 90]))) for _ in range(10)) for _ in range(30)]
        assert [ids_of(f) for f in model.encode(texts)] == library().encode(texts, add_bos=True, add_eos=True)
        assert model.used < 20_000 + 30 * 10 * 600 and all(len(c) <= pieces.REMEMBERED for c in model.memory)


def test_piece_digests(spark):
    rows = [(1, None, "n", 1), (2, "Hello world", None, 2), (2, "Hello world", None, 2), (None, "é" * 3000, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, piece int")
    out = pieces.piece_digests(docs.repartition(2), PIECES)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 4
    assert {(1, 2), (2, 4)} <= {(r.doc_id, r.n_tokens) for r in out.collect()}
    assert sorted(r.text for r in pieces.decode_ids(pieces.encode_texts(docs, PIECES), PIECES).collect()) == sorted(r[1] or "" for r in rows)
    assert pieces.piece_digests(docs.limit(0), PIECES).count() == 0


def counted(rows):
    out = Counter()
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                out[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    return {w: n for w, n in out.items() if len(w) >= 5}


def edits(word, alphabet):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in alphabet}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in alphabet}
    return out - {word}


def variants(counts):
    alphabet = {c for w in counts for c in w}
    near = {w: sorted((-counts[e], e) for e in edits(w, alphabet) if e in counts) for w in counts}
    form = {w: (n[0][1] if n and -n[0][0] >= 2 * counts[w] else None) for w, n in near.items()}
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def variant_texts():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdéß÷") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["x" * 60, "aaaaa", "aaaaaa"]
    words = []
    for stem in stems:
        for _ in range(rng.randint(1, 60)):
            word = list(stem)
            if rng.random() < 0.4:
                at = rng.randrange(len(word))
                word[at : at + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é", "É"])
            words.append("".join(word).upper() if rng.random() < 0.1 else "".join(word))
    rng.shuffle(words)
    return [(i, rng.choice([" ", "-", "1"]).join(words[k : k + 9])) for i, k in enumerate(range(0, len(words), 9))] + [(None, "aaaaa bbbbb"), (7, None), (8, ""), (3, "ÿÿÿÿÿ " * 4)]


@pytest.mark.parametrize("room", [spelling_variants.ROUND_BYTES, 96])
def test_spelling_variants(spark, monkeypatch, room):
    monkeypatch.setattr(spelling_variants, "PROBED", 50)
    monkeypatch.setattr(spelling_variants, "STEP", 700)
    rows = variant_texts()
    docs = spark.createDataFrame([(i, t, "kept") for i, t in rows], "doc_id long, text string, word string").repartition(3)
    counts = spelling_variants.word_counts(docs)
    want = counted(rows)
    assert {r.word: r.n for r in counts.collect()} == want
    assert len(spelling_variants.filter_rounds(Counter(min(len(w), 40) for w in want), 96)) > 3
    got = spelling_variants.spelling_variants(counts.withColumn("form", F.lit(1)), room=room).collect()
    assert {tuple(r) for r in got} == variants(want) and len(got) == len(want)
    assert any(r.root != r.form and r.form for r in got)
    assert spelling_variants.spelling_variants(spelling_variants.word_counts(docs.limit(0))).count() == 0


def test_false_positives_are_few_and_removed(spark):
    rng = random.Random(6)
    rows = list({("".join(rng.choice("abcdefghij") for _ in range(9)), 5) for _ in range(3000)})
    words = spark.createDataFrame(rows, "word string, n long")
    sizes = Counter(min(len(w), spelling_variants.TAIL) for w, _ in rows)
    (plan,) = spelling_variants.filter_rounds(sizes, spelling_variants.ROUND_BYTES)
    filters = spelling_variants.build_filters(words, plan)
    (_, points), = spelling_variants.by_length([w for w, _ in rows])
    passed = sum(len(r) for r, *_ in filters.probed(points, np.array([ord(c) for c in "abcdefghij"], np.uint32)))
    tried = int(sum((points < ord(c)).sum() for c in "abcdefghij"))
    assert passed < 0.02 * tried
    known = dict(rows)
    pairs = {(r.word, r.near) for r in spelling_variants.near_pairs(words).collect()}
    assert pairs == {(w, e) for w in known for e in edits(w, "abcdefghij") if e in known and w < e}


def test_long_chains_of_forms(spark):
    # each word has the double count of the next one: a chain of 30 forms
    rows = [("a" * (5 + i), 2 ** (31 - i)) for i in range(30)] + [("b" * 50_000, 3), (None, 5)]
    got = {r.word: r for r in spelling_variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert len(got) == 31 and all(got[w].root == "aaaaa" for w, _ in rows[:30])
    assert got["a" * 9].form == "a" * 8 and got["b" * 50_000].n_near == 0


def audit_documents():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([30, 400])]) for _ in range(rng.choice([10, 49, 50, 60, 200]))) for _ in range(60)]
    texts = [t.upper() if rng.random() < 0.3 else t + rng.choice(["", " 5%", "#"]) for t in texts]
    texts += ["", None, " \n", "one\x0btwo\x0cthree", "\xa0", "x " * 20_000, "É" * 30]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""]), 1) for i in range(250)]
    return rows + [(None, texts[0], "a", 1), (3, texts[1], "c", 1), (9, rows[9][1], rows[9][2], 1)]


@pytest.mark.parametrize("hot", [1, 1000])
def test_filter_audit(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT_ROWS", hot)
    rows = audit_documents()
    labels = [(i, i % 3 % 2, i % 5 % 2) for i in range(0, 300, 2)] + [(4, 1, 0), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part int").repartition(3)
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels(doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    result = con.execute(filter_audit.ORACLE)
    names = [d[0] for d in result.description]
    out = filter_audit.audit_text_filters(docs, label_rows)
    assert out.columns == names
    got = [tuple(r) for r in out.collect()]
    assert len(got) == 4 * 600 - (0 if any(r[2] == "c" for r in rows) else 600) and sorted(got) == sorted(result.fetchall())
    assert filter_audit.audit_text_filters(docs.limit(0), label_rows).count() == 0


def test_filter_audit_by_hand(spark):
    """The audit of given id tables, by sets and all orders."""
    rng = random.Random(2)
    failing = {c: {i for i in range(90) if rng.random() < p} for c, p in (("x", 0.5), ("y", 0.1), ("z", 0.0))}
    ids = spark.createDataFrame([(i, i % 2 == 0, i % 3 == 0, None if i == 4 else False) for i in range(90)], "row long, part boolean, good boolean, toxic boolean")
    tables = {c: spark.createDataFrame([(i,) for i in s], "row long") for c, s in failing.items()}
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit_filters(ids, tables).collect()}
    assert len(got) == 2 * 18
    shapley = defaultdict(int)
    for part in (True, False):
        members = {i for i in range(90) if (i % 2 == 0) == part}
        for order in permutations("xyz"):
            alive = set(members)
            for step, c in enumerate(order, 1):
                gone, r = alive & failing[c], got[part, "".join(order), step]
                assert r.redundant == len((members & failing[c]) - gone) and r.removed == len(gone)
                assert r.unique_fails == len((members & failing[c]) - set().union(*(failing[o] for o in "xyz" if o != c)))
                assert r.good_lost == sum(i % 3 == 0 for i in gone) and r.toxic_lost == 0
                alive -= gone
                assert r.kept == len(alive)
                shapley[part, c] += len(gone)
        for order in permutations("xyz"):
            for step, c in enumerate(order, 1):
                assert got[part, "".join(order), step].shapley == shapley[part, c]
