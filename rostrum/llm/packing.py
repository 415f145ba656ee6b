"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rostrum.llm.bpe import byte_letters
from rostrum.llm.tools import partitions, single_threaded, stored, table, texts_of

CAPACITY = 2048
# bytes, about, that a task's memory of finished words may hold, of words up to a length; it then starts anew, with equal results
MEMORY_BYTES, REMEMBERED = 80_000_000, 64
# no tokenizer piece crosses these blanks
CHUNK = re.compile(r"[^ \t\n\r]+")
#: fixed values: the pre-tokenizer's pieces over lower-cased Latin-1 text (runs of digits are cut by the tokenizer itself)
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]+|[^\s\x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
WORD = re.compile(r"[a-zªµºß-öø-ÿ]+")


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _cut(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes independently: lower-case words where that is safe, else parts between blanks."""
    if "<|" not in text and _latin(text) and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return PIECE.findall(text.lower())
    return CHUNK.findall(text)


class TaskTokenizer:
    """The library's tokenizer with a memory of finished words, bounded in bytes; its task owns both."""

    def __init__(self, path: str):
        single_threaded()
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.letters = {b: c for c, b in byte_letters().items()}
        self.known: dict[str, bytes] = {}
        self.used = 0

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers; for lower-casing tokenizers whose words end at blanks.

        Words repeat, so each distinct one is given to the tokenizer once while it is remembered. Long parts, such as
        texts without blanks, are not remembered.
        """
        cut = [_cut(t) for t in texts]
        if self.used > MEMORY_BYTES:
            self.known, self.used = {}, 0
        known, letters, model = self.known, self.letters, self.own.model
        found: dict[str, bytes] = {}
        new = []
        for chunk in [c for c in set().union(*cut) if c not in known]:
            if WORD.fullmatch(chunk):  # nothing left to normalise or cut: straight to the tokenizer's model
                spelt = chunk if chunk.isascii() else "".join([letters[b] for b in chunk.encode()])
                found[chunk] = np.array([t.id for t in model.tokenize(spelt)], "<u4").tobytes()
            else:
                new.append(chunk)
        for at in range(0, len(new), 2_000):
            part = new[at : at + 2_000]
            for chunk, encoded in zip(part, self.own.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[chunk] = np.array(encoded.ids, "<u4").tobytes()
        long_ = {c: i for c, i in found.items() if len(c) > REMEMBERED} if max(map(len, found), default=0) > REMEMBERED else {}
        for chunk in long_:
            del found[chunk]
        known.update(found)
        self.used += 240 * len(found) + sum(map(len, found)) + sum(map(len, found.values()))
        ids_of = known.__getitem__
        if long_:
            return [b"".join([long_[c] if c in long_ else ids_of(c) for c in chunks]) for chunks in cut]
        return [b"".join(map(ids_of, chunks)) for chunks in cut]


def token_ids(texts: list[str], path: str) -> list[bytes]:
    return TaskTokenizer(path).ids(texts)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """The token ids of every whole text, then ``end_id``, cut after each ``capacity`` ids: key, piece, start, length and ids.

    A null text is the empty text: one piece that holds ``end_id`` alone. With ``digest`` the crc32 of the
    little-endian ids (``ids_crc32``) stands for the ids.
    """
    ending = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokenizer = TaskTokenizer(path)
        for batch in batches:
            keys, place, start, length, ids = [], [], [], [], []
            for row, tokens in enumerate(tokenizer.ids(list(texts_of(batch.column(1))))):
                tokens += ending
                for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[at : at + 4 * capacity]
                    keys.append(row)
                    place.append(piece)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    ids.append(zlib.crc32(part) if digest else np.frombuffer(part, "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(keys, pa.int64())), pa.array(place, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(ids, pa.int64() if digest else pa.list_(pa.int32())),
            ], ["key", "piece", "start", "length", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids {'long' if digest else 'array<int>'}")
    return out.withColumnsRenamed({"key": key, "ids": "ids_crc32" if digest else "ids"})


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats within ``counts``) whose sum is the largest possible one up to ``room``, long ones preferred.

    Subset sums are the bits of one integer; a step shifts it by a length. ``lengths`` descend.
    """
    sums, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            grown = (sums | sums << length) & mask
            if grown == sums:
                break
            steps.append((length, sums))
            sums = grown
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen[::-1]


def bin_patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Minimum bin slack over a histogram of lengths: (lengths of a bin, number of such bins).

    Each bin takes the longest piece left and the fullest combination of other lengths beside it. The choice
    depends only on which lengths are left in what multiples, so it is repeated as often as the counts allow.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    order, out = sorted(left, reverse=True), []
    while order:
        top = order[0]
        left[top] -= 1
        bin_ = [top, *fullest(order, left, capacity - top)]
        left[top] += 1
        need: dict[int, int] = {}
        for length in bin_:
            need[length] = need.get(length, 0) + 1
        times = min(left[length] // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
        out.append((bin_, times))
        if any(not left[length] for length in need):
            order = [length for length in order if left[length]]
    return out


def best_fit_packing(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` tokens, in few sequences of at most ``capacity``.

    The plan is made over the histogram of lengths, at most ``capacity`` counts whatever the data, by minimum
    bin slack (``bin_patterns``). Pieces of a length are numbered in two steps, inside a hashed part of the
    length and by the parts' running counts, so a length that holds any share of the rows is spread over all
    tasks; number and length give sequence and offset. Sequences are gapless from offset 0. Equal rows are
    packed each; null or non-positive lengths and lengths over ``capacity`` are refused; no rows, no sequences.
    Columns of ``pieces`` keep their values; ``pieces`` should be stored, as it is read three times.
    """
    spark, parts = pieces.sparkSession, partitions(pieces.sparkSession)
    n = F.col(length)
    bad = F.count_if(n.isNull() | (n < 1) | (n > capacity))
    part = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    marked = pieces.withColumn("__part", part)
    counted = marked.groupBy(length, "__part").agg(F.count(F.lit(1)).alias("n"), bad.alias("bad"))
    totals = counted.groupBy(length).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    faulty = totals.filter("bad > 0").limit(1).collect()
    if faulty:
        raise ValueError(f"a piece has length {faulty[0][length]}; 1 to {capacity} are allowed")
    counts = {int(r[length]): int(r["n"]) for r in totals.select(length, "n").collect()}  # at most capacity rows

    # slots: for each length, runs of piece numbers that fall into the same place of successive sequences
    starts: dict[int, list[tuple[int, int, int]]] = {k: [] for k in counts}
    used, sequence = dict.fromkeys(counts, 0), 0
    for bin_, times in bin_patterns(counts, capacity):
        at = 0
        for size in bin_:
            starts[size].append((used[size], sequence - used[size], at))
            used[size] += times
            at += size
        sequence += times
    plan = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in starts.items()})

    before = Window.partitionBy(length).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select(length, "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    rest = [c for c in pieces.columns if c not in order]
    inside = Window.partitionBy(length, "__part").orderBy(*order, *[F.hash(c) for c in rest if c != length])
    numbered = (
        marked.withColumn("__number", F.row_number().over(inside).cast("long") - 1)
        .join(bases, [length, "__part"])
        .withColumn("__number", F.col("__number") + F.col("__base"))
        .select(*pieces.columns, "__number")
    )

    def place(batches):
        slots = plan.value
        for batch in batches:
            sizes, numbers = batch.column(length).to_numpy(zero_copy_only=False), batch.column("__number").to_numpy(zero_copy_only=False)
            sequence_id, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                first, shift, at = slots[size]
                slot = np.searchsorted(first, numbers[rows], "right") - 1
                sequence_id[rows], offset[rows] = numbers[rows] + shift[slot], at[slot]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence_id), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids`` and, for each piece in it, key and offset (``documents``).

    A sequence has at most ``capacity`` pieces, so the group is bounded.
    """
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("__r")).select(
        "sequence_id", F.flatten(F.transform("__r", lambda r: r["ids"])).alias("ids"),
        F.transform("__r", lambda r: F.struct(r["doc_id"].alias("doc_id"), r["piece"].alias("piece"), r["offset"].alias("offset"))).alias("documents"))


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Digest form of packing all documents: a stored piece table, packed."""
    return best_fit_packing(stored(token_pieces(docs, path, digest=True), "pieces"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
