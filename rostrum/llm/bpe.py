"""Byte-level BPE: longest matches are proposed, adjacent pairs verified, and only failing words merged exactly."""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rostrum.llm.tools import table, texts_of

#: fixed values: white space of the pre-tokenizer (Unicode White_Space)
SPACE = "\t-\r \x85\xa0  -     　"
# runs that no word of the pre-tokenizer crosses: one blank and what follows it, or white space
RUN = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: fixed values: the pre-tokenizer's pattern
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# entries a worker's memories of finished runs, and of words and pair verdicts, may hold; they then start anew, with equal results
MEMORY_RUNS, MEMORY = 1_000_000, 300_000
NEVER = np.int64(1) << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder over a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters, model = byte_letters(), data["model"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        names = {s: i for s, i in model["vocab"].items() if s not in self.special}
        self.bytes_of = {i: as_bytes(s) for s, i in names.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.decoded = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        self.size = max(self.decoded) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for place, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[names[left], names[right]] = place, names[left + right]
        self._index_pairs()
        # a token that its own bytes don't encode to can't be proposed
        self.proposed = {b: i for b, i in self.id_of.items() if len(b) == 1 or self.merged(b) == [i]}
        self.longest = max(map(len, self.proposed))
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.checked = np.empty(0, np.int64)
        self.fits = np.empty(0, bool)
        self.exact = 0

    def _index_pairs(self) -> None:
        """Merges as sorted keys, and of each token the pieces along its two edges with the rank that ends each."""
        keys = np.array([a * self.size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.merge_keys = keys[order]
        self.merge_ranks = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        made = {}
        for (left, right), (place, token) in self.rank.items():
            if token not in made:
                made[token] = (left, right, place)
        self.edges = []
        for side in (1, 0):  # the right edge of a left neighbour, the left edge of a right neighbour
            chains = {}
            for token in sorted(self.bytes_of, key=lambda t: len(self.bytes_of[t])):
                part = made.get(token)
                inner = [] if part is None else [(part[side], part[2]), *chains[part[side]][1:]]
                chains[token] = [(token, int(NEVER)), *inner]
            depth = max(map(len, chains.values()))
            piece, end = np.full((self.size, depth), -1, np.int64), np.full((self.size, depth), -1, np.int64)
            for token, chain in chains.items():
                piece[token, : len(chain)], end[token, : len(chain)] = zip(*chain, strict=True)
            self.edges.append((piece, end))

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the merge of lowest rank, leftmost first."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        queue = [(*self.rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(queue)
        while queue:
            _, token, i, pair = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = token, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (p := (ids[a], ids[after[a]])) in self.rank:
                    heapq.heappush(queue, (*self.rank[p], a, p))
        return [i for i in ids if i >= 0]

    def proposal(self, word: bytes) -> list[int]:
        """Greedy longest matches."""
        out, at, end, known, longest = [], 0, len(word), self.proposed, self.longest
        while at < end:
            for to in range(min(end, at + longest), at, -1):
                token = known.get(word[at:to])
                if token is not None:
                    out.append(token)
                    at = to
                    break
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two neighbours stay apart when their bytes are merged together.

        They don't if some piece on the right edge of the left token and some piece on the left edge of the
        right one have a merge that comes before either is used up inside its own token (on equal rank the
        leftmost merge comes first).
        """
        (a_piece, a_end), (b_piece, b_end) = ((p[x], e[x]) for (p, e), x in zip(self.edges, (left, right), strict=True))
        apart = np.ones(len(left), bool)
        for i in range(a_piece.shape[1]):
            rows = np.flatnonzero(a_piece[:, i] >= 0)
            if not len(rows):
                break
            for j in range(b_piece.shape[1]):
                rows = rows[b_piece[rows, j] >= 0]
                if not len(rows):
                    break
                key = a_piece[rows, i] * self.size + b_piece[rows, j]
                at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
                hit = self.merge_keys[at] == key
                place = self.merge_ranks[at]
                apart[rows[hit & (place < a_end[rows, i]) & (place <= b_end[rows, j])]] = False
        return apart

    def _verdicts(self, keys: np.ndarray) -> np.ndarray:
        """``compatible`` for pair keys, each distinct pair looked at once."""
        distinct, place = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.checked, distinct)
        known = at < len(self.checked)
        known[known] = self.checked[at[known]] == distinct[known]
        new = distinct[~known]
        if len(new):
            if len(self.checked) > MEMORY:
                self.checked, self.fits, new = np.empty(0, np.int64), np.empty(0, bool), distinct
            fits = np.concatenate([self.compatible(part // self.size, part % self.size) for part in np.array_split(new, len(new) // 50_000 + 1)])
            order = np.argsort(np.concatenate([self.checked, new]), kind="stable")
            self.checked, self.fits = np.concatenate([self.checked, new])[order], np.concatenate([self.fits, fits])[order]
            at = np.searchsorted(self.checked, distinct)
        return self.fits[at][place]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Propose for all words, check every adjacent pair at once, merge the failing words exactly."""
        found = [self.proposal(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for ids in found for t in ids), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(found)), sizes)
        same = owner[1:] == owner[:-1]
        if same.any():
            bad = ~self._verdicts(flat[:-1][same] * self.size + flat[1:][same])
            for w in np.unique(owner[1:][same][bad]).tolist():
                found[w] = self.merged(words[w])
                self.exact += 1
        return found

    def _learn(self, runs: set[str]) -> None:
        parts = {r: PIECE.findall(r) for r in runs}
        new = list({p for ps in parts.values() for p in ps if p not in self.words})
        for word, ids in zip(new, self.encode_words([w.encode() for w in new]), strict=True):
            self.words[word] = np.array(ids, "<u4").tobytes()
        for run, ps in parts.items():
            self.runs[run] = b"".join([self.words[p] for p in ps])
        if len(self.words) > MEMORY:
            self.words = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            parts = self.splitter.split(text) if self.splitter and any(s in text for s in self.special) else [text]
            cut.append([part if part in self.special and i % 2 else RUN.findall(part) for i, part in enumerate(parts)])
        if len(self.runs) > MEMORY_RUNS:
            self.runs = {}
        new = {r for parts in cut for part in parts if isinstance(part, list) for r in part if r not in self.runs}
        if new:
            self._learn(new)
        ids_of = self.runs.__getitem__
        return [b"".join(np.array([self.special[p]], "<u4").tobytes() if isinstance(p, str) else b"".join(map(ids_of, p)) for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD, unknown ids are left out."""
        known = self.decoded.get
        return b"".join([known(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the ids of every whole text (array of int); null is the empty text, without ids."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in bpe.encode(list(texts_of(batch.column(1))))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and the text of every id list; null lists give the empty text."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(v.as_py() or [], "<u4").tobytes()) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text and return digests of both: key, n_tokens, ids_sha256, decoded_sha256.

    Row by row and narrow: no shuffle, one row per input row, repeated rows stay repeated. A null text is the
    empty text (0 tokens). Columns other than the two named are not read.
    """

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            ids = bpe.encode(list(texts_of(batch.column(1))))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([sha256(b).hexdigest() for b in ids]),
                pa.array([sha256(bpe.decode(b).encode()).hexdigest() for b in ids]),
            ], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
