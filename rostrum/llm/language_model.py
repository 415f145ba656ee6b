"""Language-model scoring: word bigrams in sharded Elias-Fano tries, learned from all training documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.elias_fano import EliasFano, mapped
from rostrum.llm.tools import remainder, stored, table, texts_of, words

# tokens of a document batch and of a shard of the trie, about; blocks that go between them number
# tokens^2 / (batch * shard), so larger corpora take larger values of both (and executors with more memory)
BATCH_TOKENS, SHARD_TOKENS = 1_500_000, 1_500_000
# a word with more than this share of all tokens has its successors dealt over several shards; at most 1 / share words
HOT_SHARE = 1 / 1000
# bits of a successor's fingerprint inside its context
PRINT = 40
# counts of their own up to here in the quantiser, log-spaced levels above
EXACT_LEVELS, LEVELS = 160, 256
# names of the end of a text and of the context before its first word; words hold no blanks
END, START = " end", " start"
U64 = np.uint64


def _squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _unsqueeze(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


def document_batches(docs: DataFrame, held: str, key: str = "doc_id", text: str = "text", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The corpus as batches of numbered words: one row holds many documents and the hashes of their distinct words."""

    def run(batches):
        ids, tokens, keys, flags, sizes, count, number = _Ids(), [], [], [], [], 0, 0

        def row():
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), U64, len(ids))
            return pa.RecordBatch.from_pydict({
                "batch": [f"{TaskContext.get().partitionId()}-{number}"], "tokens": [int(sum(sizes))],
                "trained": [int(sum(n for n, f in zip(sizes, flags, strict=True) if f == 0))],
                "ids": [_squeeze(np.concatenate(tokens))], "hashes": [hashes.tobytes()],
                "keys": pa.array([keys], pa.list_(pa.int64())), "flags": pa.array([flags], pa.list_(pa.int8())), "sizes": pa.array([sizes], pa.list_(pa.int32())),
            }, schema=SCHEMA)

        for batch in batches:
            for doc, flag, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                own = words(one)
                own.append(END)
                tokens.append(np.fromiter(map(ids.__getitem__, own), np.uint32, len(own)))
                keys.append(doc)
                flags.append(2 if flag is None else int(flag))
                sizes.append(len(own))
                count += len(own)
                if count >= batch_tokens:
                    yield row()
                    ids, tokens, keys, flags, sizes, count, number = _Ids(), [], [], [], [], 0, number + 1
        if keys:
            yield row()

    kind = "batch string, tokens long, trained long, ids binary, hashes binary, keys array<long>, flags array<tinyint>, sizes array<int>"
    return docs.select(F.col(key).cast("long"), held, text).mapInArrow(run, kind)


SCHEMA = pa.schema([
    ("batch", pa.string()), ("tokens", pa.int64()), ("trained", pa.int64()), ("ids", pa.binary()), ("hashes", pa.binary()),
    ("keys", pa.list_(pa.int64())), ("flags", pa.list_(pa.int8())), ("sizes", pa.list_(pa.int32()))])


class Batch:
    """A row of ``document_batches`` with its distinct bigrams in the order of their shards."""

    def __init__(self, row: dict):
        self.keys, self.flags = row["keys"], np.array(row["flags"], np.int8)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ids = _unsqueeze(row["ids"], np.uint32).astype(np.int64)
        self.hashes = np.append(np.frombuffer(row["hashes"], U64), U64(xxhash.xxh3_64_intdigest(START)))
        self.first = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.first] = len(self.hashes) - 1
        self.before = before

    def counts(self) -> np.ndarray:
        """Training count of each distinct word; the start counts nothing."""
        return np.bincount(self.ids[np.repeat(self.flags == 0, self.sizes)], minlength=len(self.hashes))

    def arrange(self, shards: int, hot: dict[int, int]) -> None:
        """Number the distinct bigrams by (shard, context, successor's print), and list the contexts each shard is asked about."""
        width = len(self.hashes)
        pairs, of_token = np.unique(self.before * width + self.ids, return_inverse=True)
        context, word = pairs // width, pairs % width
        prints = self.hashes[word] >> U64(64 - PRINT)
        home = (self.hashes % U64(shards)).astype(np.int64)
        shard = home[context]
        asked_context, asked_shard = [np.arange(width)], [home]
        for name, pieces in hot.items():
            for local in np.flatnonzero(self.hashes == U64(name)).tolist():
                rows = np.flatnonzero(context == local)
                shard[rows] = (home[local] + (prints[rows] % U64(pieces)).astype(np.int64)) % shards
                asked_context.append(np.full(pieces - 1, local))
                asked_shard.append((home[local] + np.arange(1, pieces)) % shards)
        asked_context, asked_shard = np.concatenate(asked_context), np.concatenate(asked_shard)
        order = np.lexsort((self.hashes[asked_context], asked_shard))
        self.asked_context, self.asked_shard = asked_context[order], asked_shard[order]
        self.asked_home = self.asked_shard == home[self.asked_context]
        order = np.lexsort((prints, self.hashes[context], shard))
        self.context, self.word, self.prints, self.shard = context[order], word[order], prints[order], shard[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of_token = place[of_token]

    def requests(self, shards: int):
        """For each shard: context hashes, their training counts, successors per context, prints and training counts."""
        counts = self.counts()
        learned = np.bincount(self.of_token[np.repeat(self.flags == 0, self.sizes)], minlength=len(self.context))
        for s in np.unique(self.asked_shard).tolist():
            a = slice(*np.searchsorted(self.asked_shard, [s, s + 1]))
            b = slice(*np.searchsorted(self.shard, [s, s + 1]))
            names = self.hashes[self.asked_context[a]]
            own = np.where(self.asked_home[a], counts[self.asked_context[a]], 0)
            successors = np.bincount(np.searchsorted(names, self.hashes[self.context[b]]), minlength=len(names))
            prints = self.prints[b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : PRINT // 8]
            yield s, [names.tobytes(), _squeeze(own.astype(np.uint32)), _squeeze(successors.astype(np.uint32)), prints.tobytes(), _squeeze(learned[b].astype(np.uint32))]


def _levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts: 0 unseen, small counts their own level, larger ones log-spaced."""
    above = EXACT_LEVELS + np.round(np.log(np.maximum(counts, EXACT_LEVELS) / EXACT_LEVELS) / STEP).astype(np.int64)
    return np.where(counts <= EXACT_LEVELS, counts, np.minimum(above, LEVELS - 1)).astype(np.uint8)


STEP = np.log(1e13 / EXACT_LEVELS) / (LEVELS - 1 - EXACT_LEVELS)
LEVEL_COUNTS = np.concatenate([np.arange(EXACT_LEVELS + 1.0), EXACT_LEVELS * np.exp(STEP * np.arange(1, LEVELS - EXACT_LEVELS))])


class TrieShard:
    """Contexts, pointers, successors and their quantised discounted counts, in memory-mapped Elias-Fano levels."""

    def __init__(self, names: np.ndarray, context: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        """``names``: sorted context hashes; the rest: distinct bigrams by (context index, print) with their counts."""
        self.contexts = EliasFano(names, 1 << 64)
        keys = (context.astype(U64) << U64(PRINT)) | prints  # the print relative to the context's place: monotone
        self.successors = EliasFano(keys, len(names) << PRINT)
        pointers = np.searchsorted(context, np.arange(len(names) + 1))
        self.pointers = EliasFano(pointers, len(keys) + 1)
        levels = _levels(counts)
        kinds = [np.sum(counts == k) for k in (1, 2, 3, 4)]
        y = kinds[0] / max(kinds[0] + 2 * kinds[1], 1)
        # modified Kneser-Ney discounts of counts 1, 2 and more
        raw = [k + 1 - (k + 2) * y * kinds[k + 1] / kinds[k] if kinds[k] else 0.5 for k in range(3)]
        self.discounts = np.array([0.0, *[min(max(d, 0.1 * (k + 1)), 0.95 * (k + 1)) for k, d in enumerate(raw)]])
        cut = self.discounts[np.minimum(counts, 3)]
        mass = np.bincount(context, cut, minlength=len(names)).astype(np.float32)
        parts = [*self.contexts.levels(), *self.successors.levels(), *self.pointers.levels(), levels, mass]
        own = mapped(parts)
        self.contexts.attach(own[0:3])
        self.successors.attach(own[3:6])
        self.pointers.attach(own[6:9])
        self.levels, self.mass = own[9:]

    def find(self, names: np.ndarray) -> np.ndarray:
        return self.contexts.successor(names)[0]

    def discounted(self, context: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Quantised level of each bigram, 0 if unseen: successor search relative to the context."""
        at, seen = self.successors.successor((context.astype(U64) << U64(PRINT)) | prints)
        return np.where(seen, self.levels[np.minimum(at, max(len(self.levels) - 1, 0))] if len(self.levels) else 0, 0).astype(np.uint8)


def _prints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, PRINT // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : PRINT // 8] = raw
    return wide.view("<u8").ravel()


def answer_shard(group: pa.Table) -> pa.Table:
    """Build a shard's trie from all requests' training counts, then answer each request from it.

    An answer holds, in the request's order, the exact training count and the back-off mass of each context, the
    quantised level of each bigram and the shard's discounts. One more row has the shard's total and distinct words.
    """
    asked = []
    for row in group.column("block").to_pylist():
        names, own, successors, prints, learned = row
        asked.append((np.frombuffer(names, U64), _unsqueeze(own, np.uint32), _unsqueeze(successors, np.uint32), _prints(prints), _unsqueeze(learned, np.uint32)))
    names, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([a[1] for a in asked])).astype(np.int64)
    context = np.repeat(place, np.concatenate([a[2] for a in asked]))
    learned = np.concatenate([a[4] for a in asked])
    rows = np.flatnonzero(learned)
    keys = (context[rows].astype(U64) << U64(PRINT)) | np.concatenate([a[3] for a in asked])[rows]
    distinct, which = np.unique(keys, return_inverse=True)
    sums = np.bincount(which, learned[rows]).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    del context, learned, rows, keys, which, place
    trie = TrieShard(names, (distinct >> U64(PRINT)).astype(np.int64), distinct & U64((1 << PRINT) - 1), sums)
    batches, answers = [None], [[np.array([counts.sum(), (counts > 0).sum()], np.int64).tobytes()]]
    for batch, (own, _, successors, prints, _) in zip(group.column("batch").to_pylist(), asked, strict=True):
        at = trie.find(own)
        levels = trie.discounted(np.repeat(at, successors), prints)
        batches.append(batch)
        answers.append([_squeeze(counts[at]), _squeeze(trie.mass[at]), _squeeze(levels), trie.discounts.tobytes()])
    shard = group.column("shard")[0].as_py()
    return pa.table({"batch": pa.array(batches, pa.string()), "shard": pa.array([shard] * len(batches), pa.int32()), "answer": pa.array(answers, pa.list_(pa.binary()))})


def score_documents(docs: DataFrame, held: str, key: str = "doc_id", text: str = "text", batch_tokens: int = BATCH_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Score every whole text with a word bigram model learned from the rows whose ``held`` is false.

    Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10). The model
    interpolates discounted bigram counts with the smoothed word distribution of ``base_score``:
    p(w|v) = (c(vw) - D) / c(v) + mass(v) / c(v) * p(w), and p(w) where v was never seen.

    Documents are packed into batches of numbered words; a batch asks each shard of the trie about its distinct
    words and bigrams, with their training counts. A shard (all contexts with one hash remainder) adds up the
    counts, builds its trie and answers in the order asked, one byte a bigram. So what moves is the distinct
    bigrams of batches, not tokens; contexts with more than HOT_SHARE of all tokens are dealt over several
    shards. Words are told apart by 64-bit hashes, successors of a context by 40 bits.

    Null and empty texts have one token, the end. Rows with a null ``held`` (no id) are scored, not learned from.
    Repeated rows are scored and counted each. Other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    batches = stored(document_batches(docs, held, key, text, batch_tokens), "batches")
    total = batches.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    shards = max(4, -(-total // shard_tokens))

    def frequent(rows):
        for batch in rows:
            names, counts = [], []
            for row in batch.to_pylist():
                own = Batch(row)
                n = np.bincount(own.ids, minlength=len(own.hashes))
                often = np.flatnonzero(n >= max(2, HOT_SHARE / 2 * len(own.ids)))
                names += own.hashes[often].view(np.int64).tolist()
                counts += n[often].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(counts, pa.int64())], ["name", "n"])

    hot = {}
    for row in batches.mapInArrow(frequent, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).filter(F.col("n") > HOT_SHARE * total).collect():
        pieces = min(shards, int(-(-row["n"] * shards // max(total, 1))))
        if pieces > 1:
            hot[row["name"] % (1 << 64)] = pieces
    shared = spark.sparkContext.broadcast((shards, hot))

    def ask(rows):
        shards, hot = shared.value
        for batch in rows:
            for row in batch.to_pylist():
                own = Batch(row)
                own.arrange(shards, hot)
                for s, block in own.requests(shards):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), pa.array([row["batch"]]), pa.array([block], pa.list_(pa.binary()))], ["shard", "batch", "block"])

    blocks = batches.mapInArrow(ask, "shard int, batch string, block array<binary>")
    answers = stored(blocks.groupBy("shard").applyInArrow(answer_shard, "batch string, shard int, answer array<binary>"), "answers")

    sums = answers.filter("batch is null").select(F.col("answer")[0].alias("a"))

    def add(rows):
        pairs = [np.frombuffer(a, np.int64) for batch in rows for a in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([int(p[0]) for p in pairs], pa.int64()), pa.array([int(p[1]) for p in pairs], pa.int64())], ["n", "v"])

    row = sums.mapInArrow(add, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, n_words = row["n"] or 0, row["v"] or 0
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        shards, hot = shared.value
        columns: list[list] = [[] for _ in names]
        for row in left.to_pylist():
            own = Batch(row)
            own.arrange(shards, hot)
            width = len(own.hashes)
            counts, mass = np.zeros(width, np.int64), np.zeros(width)
            discounted = np.zeros(len(own.context))
            for s, (c, m, levels, discounts) in zip(right.column("shard").to_pylist(), right.column("answer").to_pylist(), strict=True):
                a = slice(*np.searchsorted(own.asked_shard, [s, s + 1]))
                b = slice(*np.searchsorted(own.shard, [s, s + 1]))
                who = own.asked_context[a]
                counts[who] += np.where(own.asked_home[a], _unsqueeze(c, np.int64), 0)
                mass[who] += _unsqueeze(m, np.float32)
                n = LEVEL_COUNTS[_unsqueeze(levels, np.uint8)]
                discounted[b] = n - np.frombuffer(discounts)[np.minimum(n, 3).astype(np.int64)]
            p_word = (counts + 0.5) / (n_all + 0.5 * (n_words + 1))
            context_count = counts.copy()
            context_count[-1] = counts[int(own.ids[own.first[0] + own.sizes[0] - 1])]  # starts are as many as ends
            c = context_count[own.context]
            p = np.where(c > 0, (discounted + mass[own.context] * p_word[own.word]) / np.maximum(c, 1), p_word[own.word])
            base = np.add.reduceat(np.log10(p_word)[own.ids], own.first)
            model = np.add.reduceat(np.log10(p)[own.of_token], own.first)
            known = np.add.reduceat((counts > 0)[own.ids].astype(np.int64), own.first)
            new = [own.keys, (own.flags == 1).tolist(), own.sizes.tolist(), known.tolist(), [n_all] * len(own.keys), base.tolist(), model.tolist()]
            for column, values in zip(columns, new, strict=True):
                column += values
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return batches.groupBy("batch").cogroup(answers.filter("batch is not null").groupBy("batch")).applyInArrow(score, kind)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) == 1).alias("held"))
    return score_documents(docs, "held")
