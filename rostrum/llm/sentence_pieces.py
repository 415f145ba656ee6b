"""SentencePiece encoding and decoding for merge-type vocabularies by a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rostrum.llm.tools import table, texts_of

#: fixed values: the sign that stands for a blank, and the kinds of pieces and models in a model file
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
# blanks and what follows them
CHUNK = re.compile(f"{BLANK}+[^{BLANK}]*")
# chunks up to this length are remembered, up to about so many bytes; the memory then starts anew, with equal results
REMEMBERED, MEMORY_BYTES = 64, 96_000_000
# chunks the library is given at once, and characters of chunks worked on together
CHECKED, ROOM = 5_000, 200_000


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("rostrum-each-byte", _each_byte)


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one protocol-buffer message: number, and integer or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Encoder and decoder over a model file; owned by a task, with everything it remembers.

    Merge-type vocabularies of normal, control, unknown and byte pieces; others are refused. With ``check``, every
    chunk that is encoded for the first time is also encoded and decoded by the library, and a difference is an error.
    """

    def __init__(self, path: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        trainer: dict = {}
        normaliser: dict = {}
        kinds = []
        for number, value in message_fields(self.library.serialized_model_proto()):
            if number == 1:
                kinds.append(dict(message_fields(value)).get(3, NORMAL))
            elif number in (2, 3):
                (trainer if number == 2 else normaliser).update(message_fields(value))
        if trainer.get(3, 1) != MERGES or trainer.get(24) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} isn't a merge-type vocabulary of normal, control, unknown and byte pieces")
        names = [self.library.id_to_piece(i) for i in range(len(kinds))]
        self.score = {n: -self.library.get_score(i) for i, n in enumerate(names) if kinds[i] == NORMAL}
        self.ids = {n: i for i, n in enumerate(names) if kinds[i] == NORMAL}
        self.byte_ids = {int(n[1:-1], 16): i for i, n in enumerate(names) if kinds[i] == BYTE}
        self.fallback = bool(trainer.get(35)) and len(self.byte_ids) == 256
        self._index_pairs()
        # blanks begin a piece or stand alone, and texts aren't rewritten: a text can be cut before its blanks
        cuts = not any(BLANK in n.lstrip(BLANK) for n in self.score)
        self.plain = cuts and not normaliser.get(2) and normaliser.get(3, 1) == 1 and normaliser.get(4, 1) == 0 and normaliser.get(5, 1) == 1
        self.begin, self.end = (b"" if i < 0 else np.array([i], "<u4").tobytes() for i in (self.library.bos_id(), self.library.eos_id()))
        # without a dummy blank at the start, none is taken away
        self.dummy = normaliser.get(3, 1) == 1 or normaliser.get(4, 1) == 1
        self.trims = normaliser.get(4, 1) == 1
        surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.decoded = [
            b"" if k == CONTROL else surface if k == UNKNOWN else bytes([int(n[1:-1], 16)]) if k == BYTE else n.replace(BLANK, " ").encode()
            for n, k in zip(names, kinds, strict=True)]
        self.kinds, self.controls, self.leads = kinds, np.array([k == CONTROL for k in kinds]), [k == NORMAL and n.startswith(BLANK) for n, k in zip(names, kinds, strict=True)]
        self.check, self.memory, self.used = check, {}, 0

    def _index_pairs(self) -> None:
        """Symbols are pieces and the characters in them; a hash table gives the piece that two symbols form."""
        letters = sorted(({c for n in self.score for c in n} | {chr(b) for b in range(128)}) - self.score.keys())
        symbols = [*self.score, *letters]
        number = {n: i for i, n in enumerate(symbols)}
        # place 0 of the cost is that of no piece
        self.cost = np.array([np.inf, *self.score.values()])
        self.other = len(symbols)
        self.letter = np.full(0x110000, self.other, np.int32)
        for name, i in number.items():
            if len(name) == 1:
                self.letter[ord(name)] = i
        # characters of one byte that are no piece have that byte's id; what has no single id gets a negative number
        self.size_of = [*map(len, symbols), 1]
        self.id_of = np.array([*self.ids.values(), *[self.byte_ids[ord(c)] if self.fallback and c < "\x80" else -1 for c in letters], -1], np.int64)
        pairs = {}
        for name, whole in list(number.items())[: len(self.score)]:
            for i in range(1, len(name)):
                left, right = number.get(name[:i]), number.get(name[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = whole
        keys, wholes = np.array(list(pairs), np.int64).reshape(-1), np.array(list(pairs.values()), np.int32)
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.slots, self.whole = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        waiting, at = np.arange(len(keys)), self._slot(keys)
        self.steps = 0
        while len(waiting):
            free = self.slots[at] < 0
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slots[at[put]], self.whole[at[put]] = keys[waiting[put]], wholes[waiting[put]]
            waiting, at = waiting[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def formed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each two symbols form, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        out, rows, at = np.full(keys.shape, -1, np.int32), None, self._slot(keys)
        for _ in range(self.steps):
            found = self.slots[at]
            if rows is None:
                hit = found == keys
                out[hit] = self.whole[at[hit]]
                rows = np.nonzero(~hit & (found >= 0))
                keys, at = keys[rows], at[rows]
            else:
                hit = found == keys
                out[tuple(r[hit] for r in rows)] = self.whole[at[hit]]
                left_over = ~hit & (found >= 0)
                rows, keys, at = tuple(r[left_over] for r in rows), keys[left_over], at[left_over]
            if not len(keys):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
        return out

    def agendas(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of many chunks, one a row and padded, after all merges; and how many each row has left.

        Each row has its own agenda, the costs of its adjacent pairs: in every round all rows merge their best
        pair, the leftmost of equal ones, and look up the two pairs it becomes part of.
        """
        n, width = symbols.shape
        out, size = symbols.copy(), np.full(n, width)
        rows = np.arange(n)
        piece = self.formed(symbols[:, :-1], symbols[:, 1:])
        cost = self.cost[piece + 1].astype(np.float32)
        while True:
            best = cost.argmin(1) if cost.shape[1] else np.zeros(len(rows), np.int64)
            going = cost[np.arange(len(rows)), best] < np.inf if cost.shape[1] else np.zeros(len(rows), bool)
            if not going.all():
                done = ~going
                out[rows[done], : symbols.shape[1]], size[rows[done]] = symbols[done], symbols.shape[1]
                rows, symbols, piece, cost, best = rows[going], symbols[going], piece[going], cost[going], best[going]
            if not len(rows):
                return out, size
            every, last = np.arange(len(rows)), symbols.shape[1] - 2
            made = piece[every, best]
            shift = np.arange(last + 1)
            symbols = np.take_along_axis(symbols, shift + (shift > best[:, None]), 1)
            symbols[every, best] = made
            if not last:
                piece, cost = piece[:, :0], cost[:, :0]
                continue
            shift = shift[:-1]
            moved = shift + (shift >= best[:, None])
            piece, cost = np.take_along_axis(piece, moved, 1), np.take_along_axis(cost, moved, 1)
            for at in (best - 1, best):
                inside = np.flatnonzero((at >= 0) & (at < last))
                at = at[inside]
                new = self.formed(symbols[inside, at], symbols[inside, at + 1])
                piece[inside, at], cost[inside, at] = new, self.cost[new + 1]

    def agenda(self, letters: np.ndarray) -> np.ndarray:
        """The symbols of one long chunk after all merges: a heap of adjacent pairs, best cost first, leftmost of equal ones."""
        symbols = letters.tolist()
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue: list[tuple[float, int, int, int, int, int]] = []
        pairs = self.formed(letters[:-1], letters[1:])
        for i in np.flatnonzero(pairs >= 0).tolist():
            queue.append((self.cost[pairs[i] + 1], i, i + 1, symbols[i], symbols[i + 1], int(pairs[i])))
        heapq.heapify(queue)
        while queue:
            _, i, j, left, right, made = heapq.heappop(queue)
            if symbols[i] != left or symbols[j] != right or after[i] != j:  # one side has grown or gone
                continue
            symbols[i], symbols[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0:
                    new = int(self.formed(np.array([symbols[a]]), np.array([symbols[b]]))[0])
                    if new >= 0:
                        heapq.heappush(queue, (self.cost[new + 1], a, b, symbols[a], symbols[b], new))
        return np.array([s for s in symbols if s >= 0], np.int64)

    def merged(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, each by its own agenda; chunks of a length are worked on together."""
        out = [b""] * len(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for group in np.split(order, cuts):
            size = int(sizes[group[0]]) if len(group) else 0
            if not size:
                continue
            for part in np.array_split(group, len(group) * size // ROOM + 1):
                points = np.frombuffer("".join([chunks[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), size)
                letters = self.letter[points]
                if size > REMEMBERED:
                    for i, row in zip(part.tolist(), letters, strict=True):
                        out[i] = self._ids(self.agenda(row), chunks[i])
                    continue
                symbols, left = self.agendas(letters)
                found = self.id_of[symbols]
                ids, width = found.astype("<u4").tobytes(), 4 * size
                for place, (i, n) in enumerate(zip(part.tolist(), left.tolist(), strict=True)):
                    out[i] = ids[place * width : place * width + 4 * n]
                for row in np.flatnonzero(((found < 0) & (np.arange(size) < left[:, None])).any(1)).tolist():
                    out[part[row]] = self._ids(symbols[row, : left[row]], chunks[part[row]])
        return out

    def _ids(self, symbols: np.ndarray, chunk: str) -> bytes:
        """The ids of symbols; a character that is no piece becomes its bytes, or unknown."""
        ids = self.id_of[symbols]
        if (ids >= 0).all():
            return ids.astype("<u4").tobytes()
        out, at = [], 0
        for symbol, found in zip(symbols.tolist(), ids.tolist(), strict=True):
            if found >= 0:
                out.append(found)
                at += self.size_of[symbol]
            else:
                out += [self.byte_ids[b] for b in chunk[at].encode()] if self.fallback else [self.library.unk_id()]
                at += 1
        return np.array(out, "<u4").tobytes()

    def _compared(self, chunks: list[str], found: list[bytes]) -> None:
        lists = [np.frombuffer(b, "<u4").tolist() for b in found]
        for at in range(0, len(chunks), CHECKED):
            part, own = chunks[at : at + CHECKED], lists[at : at + CHECKED]
            if self.library.encode(part, num_threads=1) != own:
                raise RuntimeError("the agenda's pieces differ from the library's")
            if self.fallback and self.library.decode(own, num_threads=1) != [c.replace(BLANK, " ") for c in part]:
                raise RuntimeError("the library decodes the agenda's pieces to another text")

    def _chunks(self, text: str) -> list[str]:
        """The chunks of a text without the blank that begins each."""
        if BLANK in text:
            text = text.replace(BLANK, " ")
        parts = text.split(" ")
        if "" in parts:  # several blanks in a row, or at an end
            return [c[1:] for c in CHUNK.findall(BLANK + text.replace(" ", BLANK))] if text else []
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, with begin and end ids, as little-endian unsigned 32-bit integers."""
        if not self.plain:
            found = [self._unknown_joined(ids) for ids in self.merged(self.library.normalize(texts))]
            if self.check:
                self._compared(texts, found)
            return [self.begin + ids + self.end for ids in found]
        cut = [self._chunks(t) for t in texts]
        if self.used > MEMORY_BYTES:
            self.memory, self.used = {}, 0
        new = list(set().union(*cut) - self.memory.keys())
        found = self.merged([BLANK + c for c in new])
        if self.check:
            # an empty chunk is a blank at the end of a text; the library gives an empty text no blank
            self._compared([c for c in new if c], [ids for c, ids in zip(new, found, strict=True) if c])
        here = {}
        for chunk, ids in zip(new, found, strict=True):
            if len(chunk) <= REMEMBERED:
                self.memory[chunk] = ids
                self.used += 240 + 4 * len(chunk) + len(ids)
            else:
                here[chunk] = ids
        ids_of = self.memory.__getitem__
        if not here:
            return [b"".join([self.begin, *map(ids_of, chunks), self.end]) for chunks in cut]
        return [b"".join([self.begin, *[here.get(c) or ids_of(c) for c in chunks], self.end]) for chunks in cut]

    def _unknown_joined(self, found: bytes) -> bytes:
        """Neighbouring unknown pieces are one where bytes don't stand for them."""
        ids = np.frombuffer(found, "<u4")
        if self.fallback or not len(ids):
            return ids.tobytes()
        unknown = ids == self.library.unk_id()
        return ids[~(unknown & np.concatenate([[False], unknown[:-1]]))].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids; control pieces give nothing, bytes that aren't UTF-8 become U+FFFD each."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and numbers.max() >= len(self.kinds):
            raise ValueError("an id isn't in the vocabulary")
        # bytes on the two sides of a control piece don't belong together
        inner = np.flatnonzero(self.controls[numbers[1:-1]]) + 1
        numbers = numbers.tolist()
        cuts = [0, *inner.tolist(), len(numbers)]
        parts = [b"".join(map(self.decoded.__getitem__, numbers[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]
        text, lead = "".join([p.decode("utf-8", "rostrum-each-byte") for p in parts]), 0
        for number in numbers if self.dummy else []:
            if self.kinds[number] == CONTROL:
                continue
            if self.leads[number]:
                lead += 1
                if self.trims and self.decoded[number] == b" ":
                    continue
            break
        return text[lead:]


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """``key`` and the ids of every whole text with begin and end ids (array of int); null is the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path, check)
        for batch in batches:
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in model.encode(list(texts_of(batch.column(1))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the text of every id list; null lists give the empty text, null ids nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path, False)
        for batch in batches:
            texts = [model.decode(np.array([i for i in v.as_py() or [] if i is not None], "<u4").tobytes()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def piece_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """Encode and decode every whole text and return digests of both: key, n_tokens, ids_sha256, decoded_sha256.

    Row by row and narrow: no shuffle, one row per input row, repeated rows stay repeated. A null text is the empty
    text (begin and end id only). Columns other than the two named are not read. What a task remembers is bounded in
    bytes and ends with it; long chunks, such as texts without blanks, are encoded each time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path, check)
        for batch in batches:
            texts = list(texts_of(batch.column(1)))
            ids = model.encode(texts)
            decoded = [model.decode(b) for b in ids]
            if check and model.plain and model.fallback and decoded != [t.replace(BLANK, " ") for t in texts]:
                raise RuntimeError("a text doesn't survive encoding and decoding")
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([sha256(b).hexdigest() for b in ids]),
                pa.array([sha256(t.encode()).hexdigest() for t in decoded]),
            ], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
