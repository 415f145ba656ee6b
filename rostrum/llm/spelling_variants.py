"""Spelling variants: words one edit apart, found through length-sharded blocked Bloom filters and confirmed by an exact join."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.tools import letters_lowered, stored, table, texts_of

#: fixed values: the query's runs of letters (A-Z already lower-cased), the divisor of damaged ones, least length and count of a word, ratio to a form
LETTERS = "a-zÀ-ÿ"
DAMAGED, LEAST_LENGTH, LEAST_COUNT, RATIO = 97, 5, 3, 2
# distinct words a task counts before it sends them on
COUNTED = 300_000
# words of this length and longer share one shard; filter bits a word, blocks of 64 bits a segment, bytes of filters that are broadcast at once
TAIL, BITS, SEGMENT, ROUND_BYTES = 40, 20, 4096, 64 << 20
# words a task probes together, and edits looked at in one step
PROBED, STEP = 20_000, 2_000_000
U64 = np.uint64


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """``word`` and ``n`` of all runs of letters in whole texts: A-Z lower-cased, each DAMAGED-th run of a document lacking a letter.

    A run is damaged where DAMAGED divides the crc32 of ``<id>:<run>``; it loses the letter at that number modulo its
    length. Results shorter than ``least`` are left out. A null text has no runs; a null id is written as nothing.
    Tasks count before the shuffle, in bounded memory.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for id_, text_ in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                runs = run_of.findall(letters_lowered(text_))
                seen.update(runs)
                start = crc32(f"{'' if id_ is None else id_}:".encode())
                damaged = [r for r in set(runs) if not crc32(r.encode(), start) % DAMAGED]
                own = Counter(runs) if len(damaged) > 8 else None
                for run in damaged:
                    n, at = own[run] if own else runs.count(run), crc32(run.encode(), start) % len(run)
                    seen[run] -= n
                    if len(run) > least:
                        seen[run[:at] + run[at + 1 :]] += n
            if len(seen) > COUNTED:
                yield listed(seen)
                seen.clear()
        yield listed(seen)

    def listed(seen: Counter[str]) -> pa.RecordBatch:
        kept = {w: n for w, n in seen.items() if n}
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

    return docs.select(key, text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def letter_hashes(points: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of each letter at its place. A word's hash is their sum, so that of an edited word follows from the word's."""
    return _mixed(points.astype(U64) + (places.astype(U64) << U64(32)) + U64(0x9E3779B97F4A7C15))


def finished(sums: np.ndarray, length: int) -> np.ndarray:
    return _mixed(sums ^ U64(length * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))


def piece_of(hashes: np.ndarray, pieces: int) -> np.ndarray:
    return (_mixed(hashes + U64(1)) % U64(pieces)).astype(np.int64)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)


def mask_of(hashes: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(hashes), U64)
    for shift in (0, 6, 12, 18):
        mask |= U64(1) << (hashes >> U64(shift) & U64(63))
    return mask


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their code points, a row a word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        size = int(sizes[group[0]]) if len(group) else 0
        if size:
            points = np.frombuffer("".join([words[i] for i in group.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
            yield group, points.reshape(len(group), size)


class Filters:
    """Blocked Bloom filters of some lengths: for each shard the pieces at hand, their number, and their blocks."""

    def __init__(self, shards: dict[int, tuple[int, dict[int, np.ndarray]]]):
        self.shards = shards

    def hit(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Which of the words of a length, given by the sums of their letters' hashes, may be in the vocabulary."""
        pieces, at_hand = self.shards[min(length, TAIL)]
        hashes = finished(sums, length)
        out, piece, mask = np.zeros(len(hashes), bool), piece_of(hashes, pieces) if pieces > 1 else None, mask_of(hashes)
        for number, blocks in at_hand.items():
            rows = slice(None) if piece is None else np.flatnonzero(piece == number)
            out[rows] = blocks[block_of(hashes[rows], len(blocks))] & mask[rows] == mask[rows]
        return out

    def probed(self, points: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edits of words of one length that may be words: row, place, and the new code point or -1 for a deletion.

        Each pair of near words is one deletion in the longer word, or one replacement by a greater code point; so these
        edits alone find all pairs once.
        """
        n, size = points.shape
        places = np.arange(size)
        own = letter_hashes(points, places)
        sums = own.sum(1, dtype=U64)
        if min(size - 1, TAIL) in self.shards and size > 1:
            moved = letter_hashes(points, places - 1 & 0xFFFFFFFF)
            ahead = np.cumsum(own, 1, dtype=U64) - own
            behind = moved.sum(1, dtype=U64)[:, None] - np.cumsum(moved, 1, dtype=U64)
            # of equal neighbours any one may go, with one result
            distinct = np.ones(points.shape, bool)
            distinct[:, 1:] = points[:, 1:] != points[:, :-1]
            rows, at = np.nonzero(distinct)
            hit = self.hit((ahead + behind)[rows, at], size - 1)
            yield rows[hit], at[hit], np.full(int(hit.sum()), -1, np.int64)
        if min(size, TAIL) in self.shards:
            width = max(1, STEP // (n * len(alphabet)))
            for start in range(0, size, width):
                some = places[start : start + width]
                rows, at, letter = np.nonzero(points[:, some, None] < alphabet[None, None, :])
                at += start
                new = letter_hashes(alphabet[None, :], some[:, None])
                hit = self.hit(sums[rows] - own[rows, at] + new[at - start, letter], size)
                yield rows[hit], at[hit], alphabet[letter[hit]].astype(np.int64)


def build_filters(words: DataFrame, plan: dict[tuple[int, int], tuple[int, int]]) -> Filters:
    """Filters of the planned (shard, piece), each with the number of pieces and of blocks; at most ROUND_BYTES reach the driver.

    A segment of a filter is made from the words that fall into it, about SEGMENT * 64 / BITS of them.
    """

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            out = []
            for _, points in by_length(own):
                size = points.shape[1]
                shard = min(size, TAIL)
                hashes = finished(letter_hashes(points, np.arange(size)).sum(1, dtype=U64), size)
                pieces = next((p for (s, _), (p, _) in plan.items() if s == shard), 0)
                if not pieces:
                    continue
                piece = piece_of(hashes, pieces) if pieces > 1 else np.zeros(len(hashes), np.int64)
                for number in np.unique(piece).tolist():
                    if (shard, number) in plan:
                        some = hashes[piece == number]
                        out.append((shard, number, block_of(some, plan[shard, number][1]), mask_of(some)))
            block = np.concatenate([b for *_, b, _ in out] or [np.empty(0, np.int64)])
            sizes = [len(b) for *_, b, _ in out]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([s for s, *_ in out], sizes).astype(np.int32)), pa.array(np.repeat([p for _, p, *_ in out], sizes).astype(np.int32)),
                pa.array((block // SEGMENT).astype(np.int32)), pa.array((block % SEGMENT).astype(np.int32)),
                pa.array(np.concatenate([m for *_, m in out] or [np.empty(0, U64)]).view(np.int64))], ["shard", "piece", "segment", "block", "mask"])

    def segment(rows: pa.Table) -> pa.Table:
        blocks = np.zeros(SEGMENT, U64)
        np.bitwise_or.at(blocks, rows.column("block").to_numpy(), rows.column("mask").to_numpy().view(U64))
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in ("shard", "piece", "segment")}, "bits": pa.array([blocks.tobytes()], pa.binary())})

    placed = words.select("word").mapInArrow(place, "shard int, piece int, segment int, block int, mask long")
    made = placed.groupBy("shard", "piece", "segment").applyInArrow(segment, "shard int, piece int, segment int, bits binary")
    shards: dict[int, tuple[int, dict[int, np.ndarray]]] = {}
    for (shard, piece), (pieces, blocks) in plan.items():
        shards.setdefault(shard, (pieces, {}))[1][piece] = np.zeros(-(-blocks // SEGMENT) * SEGMENT, U64)
    for r in made.toLocalIterator():
        at = r["segment"] * SEGMENT
        shards[r["shard"]][1][r["piece"]][at : at + SEGMENT] = np.frombuffer(r["bits"], U64)
    return Filters({s: (n, {p: b[: plan[s, p][1]] for p, b in parts.items()}) for s, (n, parts) in shards.items()})


def filter_rounds(sizes: dict[int, int], room: int) -> list[dict[tuple[int, int], tuple[int, int]]]:
    """Shards cut in pieces of at most ``room`` bytes and gathered in rounds of at most so many."""
    rounds: list[dict[tuple[int, int], tuple[int, int]]] = []
    used = room
    for shard in sorted(sizes):
        bytes_ = 8 * (sizes[shard] * BITS // 64 + 1)
        pieces = -(-bytes_ // room)
        blocks = -(-bytes_ // (8 * pieces))
        for piece in range(pieces):
            if used + 8 * blocks > room:
                rounds.append({})
                used = 0
            rounds[-1][shard, piece] = pieces, blocks
            used += 8 * blocks
    return rounds


def near_pairs(words: DataFrame, room: int = ROUND_BYTES) -> DataFrame:
    """All pairs of distinct words that differ by one inserted, deleted or replaced code point, each once: word, n, near, near_n.

    ``words`` has distinct non-null ``word`` and ``n`` and should be stored. Filters of the vocabulary, sharded by
    length, are broadcast, at most ``room`` bytes at a time; a larger vocabulary takes several rounds. Every word's edits
    are probed as hashes, and only those that a filter passes are written out and joined with the vocabulary, which
    removes the filters' false positives. Work grows with words * length * distinct code points.
    """
    spark = words.sparkSession
    shard = F.least(F.length("word"), F.lit(TAIL))
    sizes = {r["shard"]: r["n"] for r in words.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")).filter("shard > 0").collect()}

    def points(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            seen.update("".join(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in seen], pa.int32())], ["point"])

    # at most as many as Unicode has
    alphabet = np.array(sorted(r["point"] for r in words.select("word").mapInArrow(points, "point int").distinct().collect()), np.uint32)
    found = None
    for plan in filter_rounds(sizes, room):
        shared = spark.sparkContext.broadcast(build_filters(words, plan))
        some = stored(words.mapInArrow(_prober(shared, alphabet), "word string, n long, edit string"), "probed")
        shared.unpersist()
        found = some if found is None else found.union(some)
    if found is None:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    return found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("near_n")), "edit").select("word", "n", F.col("edit").alias("near"), "near_n")


def _prober(shared, alphabet: np.ndarray):
    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[str], list[int]]]:
        words, counts = [], []
        for batch in batches:
            words += batch.column("word").to_pylist()
            counts += batch.column("n").to_pylist()
            if len(words) >= PROBED:
                yield words, counts
                words, counts = [], []
        yield words, counts

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for words, counts in gathered(batches):
            for group, points in by_length(words):
                for rows, at, new in filters.probed(points, alphabet):
                    source, edits = group[rows].tolist(), []
                    for i, k, c in zip(source, at.tolist(), new.tolist(), strict=True):
                        word = words[i]
                        edits.append(word[:k] + (chr(c) if c >= 0 else "") + word[k + 1 :])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([words[i] for i in source], pa.string()), pa.array([counts[i] for i in source], pa.int64()), pa.array(edits, pa.string())],
                        ["word", "n", "edit"])

    return probe


def chain_ends(links: DataFrame) -> DataFrame:
    """``word`` and the last word (``root``) that its links lead to; ``links`` (word, form) hold no cycles.

    Every round doubles the way that a link spans, so the rounds are the logarithm of the longest chain's length.
    """
    ends = stored(links.select("word", F.col("form").alias("root")), "ends")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        jumped = stored(ends.join(ahead, "root", "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("__moved")), "ends")
        if jumped.filter("__moved").isEmpty():
            return jumped.select("word", "root")
        ends = jumped.drop("__moved")


def spelling_variants(counts: DataFrame, ratio: int = RATIO, room: int = ROUND_BYTES) -> DataFrame:
    """Group the spelling variants of words: word, form, root, n, n_near, form_n.

    ``counts`` has ``word`` and its number ``n``; rows of one word are added up, null words left out. A word's form is its
    near word (``near_pairs``) of largest count, ties to the smaller in code-point order, if that count is at least
    ``ratio`` (2 or more) times the word's own; its root is where the forms lead, or the word itself. Forms grow in
    count, so they never lead in a circle. Words of count 0 or less are left out. Other columns are not read. No words, no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or forms could lead in a circle")
    words = stored(counts.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("bigint").alias("n")).filter("n > 0"), "vocabulary")
    pairs = near_pairs(words, room)
    sides = F.explode(F.array(
        F.struct("word", "n", F.col("near").alias("near"), F.col("near_n").alias("near_n")),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    both = pairs.select(sides.alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    every = words.join(near, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    every = stored(every.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "variants")
    roots = chain_ends(every.filter("form is not null"))
    return every.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")).filter(F.col("n") >= LEAST_COUNT))
