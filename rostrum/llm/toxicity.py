"""Toxicity: noisy-channel restoration of disguised words, then a classifier over the restored text."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from itertools import compress
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.tools import remainder, stored, table, texts_of

# two thirds of the labelled documents, by a hash of the id, find the lexicon, one third fits the score
LEXICON_PARTS, PARTS = 2, 3
# a lexicon entry is in so many toxic documents and so much likelier (natural log) there; at most so many entries
LEAST_DOCS, LEAST_WEIGHT, MOST_ENTRIES = 5, 2.0, 20_000
# lengths of the word beginnings that are features beside whole words
BEGINNINGS = (4, 5, 6)
# candidates for the lexicon, up to this number, go to the tasks that count them in documents that aren't toxic
BROADCAST_NAMES = 300_000
# labels, up to this number, are broadcast (about 16 bytes each)
BROADCAST_LABELS = 5_000_000
# names a task counts before it passes them on
COUNTED = 200_000
# distinct words of the labelled documents that the character model is fitted on, most frequent first
MODEL_WORDS = 50_000
THRESHOLD = 0.7
LONGEST = 32
MEMORY = 150_000
#: fixed values: letters that a disguise writes with other signs
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c",
}
WORD = re.compile(r"[^\W\d_]+")
LETTER = r"[^\W\d_]"
SIGN = re.compile(r"[013456789@$!|+€(]")
LETTER_OR_SIGN = re.compile(rf"{LETTER}|{SIGN.pattern}")
DOUBLED = re.compile(rf"({LETTER})\1")
REPEATED = re.compile(rf"({LETTER})\1+")
# a word of more spellings than these, by its doubled letters, is decoded in the lattice
SPELLINGS = 16
# digits and their punctuation, with a sign of currency or order
NUMBER = re.compile(r"[$€+(|]*\d[\d.,:/()+|-]*[%€$!|+(]*")
# letters and signs set apart one by one
APART = re.compile(rf"(?<![^\W_])(?:{LETTER}|{SIGN.pattern})(?:(?:[^\w@$!|+€(]|_){{1,4}}(?:{LETTER}|{SIGN.pattern})(?![^\W_])){{2,}}")
# a letter or sign on its own, and the tokens that may be part of letters set apart: with one of these, or of separators only
ALONE = re.compile(rf"(?<![^\W_])(?:{LETTER}|{SIGN.pattern})(?![^\W_])")
GAP = re.compile(r"(?:[^\w@$!|+€(]|_)+")
RUN = re.compile(r"(.)\1*", re.S)
# punctuation at the ends of a token
EDGE = ".,;:!?\"'()[]{}<>*_-/\\#~=&%|+"
PUNCTUATION = "".join(c for c in EDGE if c not in SIGNS)
# log costs of a word boundary and of none: where single letters are set apart (usual gap, wider gap), at a separator inside a token, between two tokens
NARROW, WIDE, INSIDE, BETWEEN = (-2.0, 0.0), (0.0, -6.0), (0.0, -1.0), (0.0, -4.0)
# where boundaries are free, each letter inside a known word is worth so much more
INSIDE_KNOWN = 1.0
# decoded parts are remembered up to this length; longer ones are decoded each time
REMEMBERED = 64
# a number counts as a word only if it reads as a known one of so many letters
NUMBER_WORD = 5


def letter_model(counts: dict[str, int]) -> tuple[dict, dict, dict]:
    """Shares of the characters, and of those after one and after two others, in words weighted by the log of their counts."""
    one: dict[str, float] = {}
    two: dict[str, dict[str, float]] = {}
    three: dict[str, dict[str, float]] = {}
    for word, count in counts.items():
        weight, chain = 1 + math.log(count), f"^^{word}$"
        for i in range(2, len(chain)):
            c = chain[i]
            one[c] = one.get(c, 0) + weight
            for table_, context in ((two, chain[i - 1]), (three, chain[i - 2 : i])):
                row = table_.setdefault(context, {})
                row[c] = row.get(c, 0) + weight
    total = sum(one.values()) or 1.0
    return {c: n / total for c, n in one.items()}, *({k: (sum(r.values()), r) for k, r in t.items()} for t in (two, three))


class Restorer:
    """Viterbi decoding of disguised words, with word boundaries, under a character trigram model and the words it was fitted on."""

    def __init__(self, counts: dict[str, int], letters: tuple[dict, dict, dict] | None = None):
        self.one, self.two, self.three = letters or letter_model(counts)
        self.counts, self.total = counts, sum(counts.values())
        self.beginnings = {w[:i] for w in counts for i in range(1, len(w) + 1)}
        self.steps: dict[str, tuple[str, float]] = {}
        self.ends: dict[str, tuple[float, int]] = {}
        self.logs: dict[str, float] = {}
        self.values: dict[str, float] = {}
        self.joins: dict[tuple[str, str], bool] = {}
        self.listed = frozenset(counts)
        self.known: dict[tuple, frozenset[str]] = {}
        self.tokens: dict[str, tuple[frozenset[str], bool, bool]] = {}
        self.doubles: dict[str, frozenset[str]] = {}
        self.singles = {w for w in counts if len(w) == 1}

    def log_p(self, context: str, c: str) -> float:
        if (found := self.logs.get(context + c)) is None:
            if len(self.logs) > MEMORY:
                self.logs.clear()
            p = 0.04 * self.one.get(c, 0) + 1e-5
            if row := self.two.get(context[1]):
                p += 0.26 * row[1].get(c, 0) / row[0]
            if row := self.three.get(context):
                p += 0.7 * row[1].get(c, 0) / row[0]
            found = self.logs[context + c] = math.log(p)
        return found

    def spelt(self, word: str) -> float:
        """Log probability of a whole word: by its letters, or as a known word if that is more."""
        if (found := self.values.get(word)) is None:
            chain = f"^^{word}$"
            parts = [chain[i : i + 3] for i in range(len(chain) - 2)]
            try:
                found = sum(map(self.logs.__getitem__, parts))
            except KeyError:
                found = sum([self.log_p(p[:2], p[2]) for p in parts])
            if n := self.counts.get(word):
                found = max(found, math.log(n / self.total))
            if len(word) <= REMEMBERED:
                if len(self.values) > MEMORY:
                    self.values.clear()
                self.values[word] = found
        return found

    def _step(self, path: str) -> tuple[str, float]:
        """The state after the last character of ``path`` and its log probability.

        A state is ^^ with the letters of the word so far while a known word begins so, then the last two characters.
        """
        if len(self.steps) > MEMORY:
            self.steps.clear()
        state = path if path.startswith("^^") and path[2:] in self.beginnings else path[-2:]
        found = self.steps[path] = state, self.log_p(path[-3:-1], path[-1])
        return found

    def _end(self, state: str) -> tuple[float, int]:
        """Log probability that the word ends, a known one being worth its own if that is more, and the letters of a known word."""
        if (found := self.ends.get(state)) is None:
            if len(self.ends) > MEMORY:
                self.ends.clear()
            value, letters = self.log_p(state[-2:], "$"), 0
            if state.startswith("^^") and state[2:] in self.counts:
                by_letters = sum([self.log_p(state[i - 2 : i], state[i]) for i in range(2, len(state))])
                value, letters = self.spelt(state[2:]) - by_letters, len(state) - 2
            found = self.ends[state] = value, letters
        return found

    @staticmethod
    @cache
    def run_of(sign: str, size: int, edge: bool = False) -> list[tuple[str, float]]:
        """The letters that a run of one sign may stand for, with channel costs; at the edge of a token it may be punctuation."""
        if sign.isalpha():
            letters, options = sign, []
        elif sign in SIGNS:
            letters = SIGNS[sign]
            options = [("", (-0.5 if sign in "!|(+" else -3.0) if edge else -8.0)]
            if not edge and not sign.isdigit():
                options.append((" ", -3.0))
        else:
            return [(" ", INSIDE[0]), ("", INSIDE[1])] if not sign.isdigit() else [("", -0.5)]
        for c in letters:
            if size == 1:
                options.append((c, 0.0 if sign == c else -0.7))
            else:
                options += [(c, -0.7 if size == 2 else -0.2), (c + c, 0.0 if size == 2 else -1.0)]
        return options

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each run of one sign what it may stand for."""
        return [self.run_of(m[1], min(len(m[0]), 3), m.start() == 0 or m.end() == len(token)) for m in RUN.finditer(token)]

    def apart_lattice(self, part: str) -> list[list[tuple[str, float]]]:
        """The same for letters set apart: a blank is possible in each gap and likely in those wider than usual."""
        gaps = GAP.findall(part)
        usual = min(gaps, key=lambda g: (len(g), -gaps.count(g))) if len(gaps) < 1000 else min(set(gaps), key=lambda g: (len(g), g))
        out: list[list[tuple[str, float]]] = []
        sign, size = "", 0
        pieces = [p for p in GAP.split(part) if p]
        for place, piece in enumerate(pieces):
            gap = gaps[place - 1] if place else usual
            wide = len(gap) > len(usual) or (any(map(str.isspace, gap)) and not any(map(str.isspace, usual)))
            if place and not wide and piece == sign:
                size += 1
                continue
            if place:
                out.append(self._repeated(sign, size))
                blank, none = WIDE if wide else NARROW
                out.append([(" ", blank), ("", none if wide else 0.0)])
            sign, size = piece, 1
        out.append(self._repeated(sign, size))
        return out

    def _repeated(self, sign: str, size: int) -> list[tuple[str, float]]:
        options = self.run_of(sign, min(size, 3))
        return options + [(f"{c} {c}", cost + NARROW[0]) for c, cost in self.run_of(sign, 1) if size == 2 and c.strip()]

    def restored(self, part: str, kind: str = "token") -> frozenset[str]:
        """The words of the best reading of a part: a ``token``, letters set ``apart``, or a ``pair`` of tokens with a blank between."""
        if (found := self.known.get((kind, part))) is None:
            if kind == "pair":
                first, second = part.split(" ")
                places = [*self.lattice(first), [(" ", BETWEEN[0]), ("", BETWEEN[1])], *self.lattice(second)]
            else:
                places = self.lattice(part) if kind == "token" else self.apart_lattice(part)
            found = frozenset(WORD.findall(self._decode(places, INSIDE_KNOWN if kind == "apart" else 0.0)))
            if len(part) <= REMEMBERED:
                if len(self.known) > MEMORY:
                    self.known.clear()
                self.known[kind, part] = found
        return found

    def undoubled(self, word: str) -> frozenset[str]:
        """The best reading of an unknown word of letters with a doubled one, as ``restored`` gives it.

        Its lattice leaves only few spellings, as every doubled letter is written once or twice; so they are weighed
        whole, or by the letters around the doubled one alone where both are unknown words. Words with many doubled
        letters go through the lattice.
        """
        runs = REPEATED.findall(word)
        if len(runs) == 1 and runs[0] * 3 not in word and word not in self.counts:
            c = runs[0]
            at = word.index(c + c)
            once = word[:at] + word[at + 1 :]
            if once not in self.counts:
                before, after = word[at - 1] if at else "^", word[at + 2] if at + 2 < len(word) else "$"
                more = self.log_p(before + c, after) - self.log_p(before + c, c) - self.log_p(c + c, after)
                return frozenset((once if more + self.run_of(c, 2)[0][1] >= 0 else word,))
        spellings = [("", 0.0)]
        start = 0
        for m in REPEATED.finditer(word):
            plain, options = word[start : m.start()], self.run_of(m[1], min(len(m[0]), 3))
            start = m.end()
            spellings = [(s + plain + letters, cost + more) for s, cost in spellings for letters, more in options]
            if len(spellings) > SPELLINGS:
                return self.restored(word)
        rest = word[start:]
        best, found = -math.inf, word
        for spelling, cost in spellings:
            value = self.spelt(spelling + rest) + cost
            if value > best:
                best, found = value, spelling + rest
        return frozenset((found,))

    def _decode(self, places: list[list[tuple[str, float]]], inside: float = 0.0) -> str:
        steps, paths = self.steps.get, {"^^": (0.0, None)}
        for options in places:
            following: dict[str, tuple[float, tuple | None]] = {}
            for start, (score, link) in paths.items():
                for letters, cost in options:
                    state, value = start, score + cost
                    for c in letters:
                        if c != " ":
                            state, p = steps(state + c) or self._step(state + c)
                            value += p
                        elif state != "^^":
                            p, n = self._end(state)
                            state, value = "^^", value + p + inside * n
                    if state not in following or value > following[state][0]:
                        following[state] = (value, (link, letters) if letters else link)
            paths = following
        best, last = -math.inf, None
        for state, (score, link) in paths.items():
            p, n = self._end(state) if state != "^^" else (0.0, 0)
            if score + p + inside * n > best:
                best, last = score + p + inside * n, link
        out = []
        while last is not None:
            last, letters = last
            out.append(letters)
        return "".join(reversed(out))

    def of_token(self, token: str) -> tuple[frozenset[str], bool, bool]:
        """The words in a token between blanks, other than one word and punctuation, and its restored words; whether it is or
        holds a letter on its own or separates such, and whether it may be a part of a disguised word.

        Decoded are a token with signs or separators inside, from its first to its last letter or sign, and words with
        a doubled letter that aren't known.
        """
        if (found := self.tokens.get(token)) is None:
            words = set(WORD.findall(token))
            for word in [w for w in words if w not in self.counts and DOUBLED.search(w)]:
                words |= self.undoubled(word)
            alone, odd = len(token) == 1 or bool(ALONE.search(token) or GAP.fullmatch(token)), False
            if not token.isalpha():
                words |= self._of_core(token)
                bare = token.strip(EDGE).strip("$@€" + EDGE)
                odd = bool(SIGN.search(bare)) and not NUMBER.fullmatch(bare)
            found = frozenset(words), alone, odd
            if len(token) <= REMEMBERED:
                if len(self.tokens) > MEMORY:
                    self.tokens.clear()
                self.tokens[token] = found
        return found

    def of_doubled(self, word: str) -> frozenset[str]:
        """An unknown word of letters with a doubled one and its best reading."""
        if (found := self.doubles.get(word)) is None:
            found = frozenset((word,)) | self.undoubled(word)
            if len(word) <= REMEMBERED:
                if len(self.doubles) > MEMORY // 3:
                    self.doubles.clear()
                self.doubles[word] = found
        return found

    def _of_core(self, token: str) -> frozenset[str]:
        first = LETTER_OR_SIGN.search(token)
        core = token[first.start() : len(token) - LETTER_OR_SIGN.search(token[::-1]).start()] if first else ""
        if len(core) < 2 or core.isalpha():
            return frozenset()
        if NUMBER.fullmatch(core):
            digits = "".join(c for c in core if c in SIGNS)
            if len(digits) < NUMBER_WORD:
                return frozenset()
            return frozenset(w for w in self.restored(digits) if len(w) >= NUMBER_WORD and w in self.counts)
        return self.restored(core)

    def is_split(self, a: str, b: str) -> bool:
        """Whether two neighbouring tokens that make a known word are likelier that word than two."""
        if (found := self.joins.get((a, b))) is None:
            if len(self.joins) > MEMORY // 3:
                self.joins.clear()
            found = self.joins[a, b] = self.spelt(a + b) + BETWEEN[1] > self.spelt(a) + self.spelt(b)
        return found

    @staticmethod
    def _set_apart(tokens: list[str], alone: set[str]) -> bool:
        """Whether letters may be set apart: inside one token, or over neighbouring tokens with a letter on its own."""
        if any(len(t) > 2 for t in alone):
            return True
        places = list(map(alone.__contains__, tokens))
        return any(map(and_, places, places[1:]))

    def all_words(self, low: str) -> set[str]:
        """The words of a lower-cased text and the restored ones; each distinct token is looked at once."""
        tokens, listed, doubled = low.split(), self.listed, DOUBLED.search
        distinct = set(tokens)
        found = set(distinct & listed)
        rest = distinct - found
        alone, odd, bare = found & self.singles, set(), {}
        for t in rest:
            core = t
            if not t.isalpha():
                bare[t], core = t.strip(EDGE), t.strip(PUNCTUATION)
                if not core.isalpha():
                    core = ""
            if len(core) < 2:
                words, is_alone, is_odd = self.of_token(t)
                found |= words
                if is_alone:
                    alone.add(t)
                if is_odd:
                    odd.add(t)
            elif core in listed or not doubled(core):  # one word and punctuation
                found.add(core)
            else:
                found |= self.of_doubled(core)
        if alone and self._set_apart(tokens, alone):
            for m in APART.finditer(low):
                found |= self.restored(m.group(), "apart")
        # words split in two: both halves make a known word, or one is disguised
        plain = list(map(bare.get, tokens, tokens)) if bare else tokens
        joined = list(map(add, plain, plain[1:]))
        if hits := listed.intersection(joined):
            places = compress(range(len(joined)), map(hits.__contains__, joined))
            found.update([a + b for a, b in {(plain[i], plain[i + 1]) for i in places} if a and b and self.is_split(a, b)])
        if odd:
            for i in [i for i, t in enumerate(tokens) if t in odd]:
                for a, b in {(plain[k], plain[k + 1]) for k in (i - 1, i) if 0 <= k < len(plain) - 1}:
                    if a and b:
                        found |= self.restored(f"{a} {b}", "pair")
        return found


def plain_words(low: str) -> set[str]:
    """The words of a lower-cased text."""
    tokens = set(low.split())
    found = set(filter(str.isalpha, tokens))
    found.update(WORD.findall(" ".join(tokens - found)))
    return found


def features(word: str) -> tuple[str, ...]:
    return word, *[word[:n] + "*" for n in BEGINNINGS if len(word) >= n]


def evidence(found: set[str] | list[str], weights: Weights) -> list[float]:
    """What the score looks at: the strongest entries and their number, against the length of the text."""
    strong = sorted(weights.of(found), reverse=True)
    return [strong[0] if strong else 0.0, sum(strong[1:4]), float(min(len(strong), 10)), math.log1p(len(found))]


class Weights(dict):
    """Weight of a word: that of its strongest lexicon entry; remembers words that start as an entry does."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.starts = {f.rstrip("*")[: BEGINNINGS[0]] for f in lexicon}

    def __missing__(self, word: str) -> float:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = max([0.0, *[self.lexicon.get(f, 0.0) for f in features(word)]])
        return found

    def of(self, words: set[str] | list[str]) -> list[float]:
        """The weights above 0 among words."""
        starts, first = self.starts, BEGINNINGS[0]
        return list(filter(None, [self[w] for w in words if w[:first] in starts]))


def logistic(points: DataFrame) -> list[float]:
    """Ridge logistic regression of ``toxic`` on ``seen`` by Newton steps; the last coefficient is the constant.

    Each step sums gradient and curvature in the tasks; one short row a task reaches the driver.
    """
    beta = np.zeros(5)
    ridge = np.array([0.05] * 4 + [1e-4])
    for _ in range(50):
        def sums(batches, beta=beta):
            total = np.zeros(30)
            for batch in batches:
                x = np.column_stack([np.array(batch.column("seen").to_pylist(), float).reshape(-1, 4), np.ones(batch.num_rows)])
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                gradient = x.T @ (batch.column("toxic").to_numpy(zero_copy_only=False) - p)
                total += np.concatenate([gradient, ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        rows = [r["sums"] for r in points.mapInArrow(sums, "sums array<double>").collect()]
        total = np.array([math.fsum(column) for column in zip(*rows, strict=True)])
        step = np.linalg.solve(total[5:].reshape(5, 5) + np.diag(ridge), total[:5] - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta.tolist()


def known_labels(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """``id`` and ``toxic`` of labelled documents, stored; labels that are null, or contradict each other for one id, are not used.

    Up to BROADCAST_LABELS of them meet texts and words without a shuffle of those.
    """
    known = stored(labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(
        F.min(label).cast("int").alias("toxic"), F.max(label).alias("other")).filter("toxic = other").drop("other"), "known")
    return F.broadcast(known) if known.count() <= BROADCAST_LABELS else known


def _flushed(counted: Counter[str], name: str):
    """What a task has counted as a batch; the counter is empty afterwards."""
    yield pa.RecordBatch.from_arrays([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], [name, "n"])
    counted.clear()


def word_model(rows: DataFrame) -> dict:
    """The most frequent words of the texts of ``rows``, by number of documents, with the character model over them."""

    def spell(batches):
        counted: Counter[str] = Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                counted.update(plain_words(text.lower()))
                if len(counted) > COUNTED:
                    yield from _flushed(counted, "word")
        yield from _flushed(counted, "word")

    spelt = rows.select("text").mapInArrow(spell, "word string, n long").filter(F.length("word") <= LONGEST)
    common = spelt.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(MODEL_WORDS)
    counts = {r["word"]: r["n"] for r in common.collect()}
    return {"words": counts, "letters": letter_model(counts)}


def with_words(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of every row and ``__words``: the distinct words and restored words of its text, set apart by blanks."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast((model["words"], model["letters"]))

    def tell(batches):
        restorer = Restorer(*shared.value)
        for batch in batches:
            found = [" ".join(restorer.all_words(t.lower())) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], [*batch.schema.names[1:], "__words"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in keep]).schema)
    return docs.select(F.col(f"`{text}`").alias("__text"), *[f"`{c}`" for c in keep]).mapInArrow(tell, f"{schema}, __words string")


def _names(told: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """In how many documents each name, a word or a beginning of words, occurs: sums of a part of them as ``(name, n)``.

    With ``wanted``, only these names are counted.
    """
    shared = told.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        own, counted, known = shared.value, Counter(), {}
        for batch in batches:
            for text in texts_of(batch.column(0)):
                found = set()
                for word in text.split():
                    if (names := known.get(word)) is None:
                        names = features(word) if len(word) <= LONGEST else ()
                        if own is not None:
                            names = tuple(filter(own.__contains__, names))
                            known[word] = names
                    found.update(names)
                counted.update(found)
                if len(counted) > COUNTED:
                    yield from _flushed(counted, "name")
                if len(known) > MEMORY:
                    known.clear()
        yield from _flushed(counted, "name")

    return told.select("__words").mapInArrow(run, "name string, n long")


def fit_on_words(told: DataFrame, known: DataFrame, model: dict) -> dict:
    """The model with lexicon and coefficients from all rows of ``told`` (``id``, ``__words``) that have a known label.

    What reaches the driver is bounded: the lexicon, two counts and one short row a task and Newton step.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(PARTS))
    finders = told.filter(part < LEXICON_PARTS).join(known, "id")
    taken = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in finders.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    names = _names(finders.filter("toxic = 1")).groupBy("name").agg(F.sum("n").alias("t")).filter(F.col("t") >= LEAST_DOCS)
    names = stored(names, "names")
    few = names.count() <= BROADCAST_NAMES
    wanted = frozenset(r["name"] for r in names.select("name").collect()) if few else None
    clean = _names(finders.filter("toxic = 0"), wanted).groupBy("name").agg(F.sum("n").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (taken[1] + 1)) - F.log((F.coalesce("n", F.lit(0)) + 0.5) / (taken[0] + 1))
    entries = (
        names.join(clean, "name", "left").withColumn("weight", odds).filter(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc(F.col("t") * F.col("weight")), "name").limit(MOST_ENTRIES).collect())
    model = model | {"lexicon": {r["name"]: float(r["weight"]) for r in entries}}
    shared = told.sparkSession.sparkContext.broadcast(model["lexicon"])

    def measure(batches):
        weights = Weights(shared.value)
        for batch in batches:
            seen = [evidence(t.split(), weights) for t in texts_of(batch.column("__words"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(seen, pa.list_(pa.float64()))], ["toxic", "seen"])

    rest = told.filter(part >= LEXICON_PARTS).join(known, "id").select("__words", "toxic")
    points = stored(rest.mapInArrow(measure, "toxic int, seen array<double>"), "points")
    classes = sorted(r["toxic"] for r in points.select("toxic").distinct().collect())
    model["beta"] = logistic(points) if len(classes) == 2 else [0.0] * 4 + [6.0 if classes == [1] else -6.0]
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """A model from all labelled documents: character model, lexicon, coefficients.

    The words of the labelled texts are restored once and stored. What reaches the driver is bounded: the most
    frequent words, the lexicon and short sums.
    """
    known = known_labels(labels, key, label)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(known.select("id"), "id", "left_semi")
    model = word_model(rows)
    return fit_on_words(stored(with_words(rows, model, keep=["id"]), "words", compression="zstd"), known, model)


def _scored(docs: DataFrame, model: dict, kept: list[str], at: str, restore: bool) -> DataFrame:
    """``kept`` columns with score and prediction from column ``at``: texts to ``restore``, or their words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        weights, beta = Weights(own["lexicon"]), np.array(own["beta"])
        restorer = Restorer(own["words"], own["letters"]) if restore else None
        for batch in batches:
            texts = texts_of(batch.column(0))
            found = (restorer.all_words(t.lower()) if restorer else t.split() for t in texts)
            seen = np.array([[*evidence(words, weights), 1.0] for words in found]).reshape(-1, 5)
            score = 1 / (1 + np.exp(-np.clip(seen @ beta, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*batch.schema.names[1:], "score", "predicted"])

    narrow = docs.select(F.col(f"`{at}`").alias("__read"), *[f"`{c}`" for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.drop("__read").schema)
    return narrow.mapInArrow(run, f"{schema}, score double, predicted int")


def score_toxicity(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on) to every row; columns of these names are replaced.

    The whole text and its restored words are scored; null is the empty text, which gets the score of no
    evidence. One narrow pass, one row per row.
    """
    return _scored(docs, model, [c for c in docs.columns if c.lower() not in {"score", "predicted"}], text, True)


def judged(docs: DataFrame, labels: DataFrame, learns: Column | None = None, keep: list[str] | None = None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The columns ``keep`` (all) of every row with ``score`` and ``predicted`` by a model fitted on all labelled rows among them for which ``learns`` holds.

    The same as ``fit_toxicity`` and ``score_toxicity``, but every text is restored once: its words are stored beside the row.
    """
    known, learners = known_labels(labels, key, label), docs if learns is None else docs.filter(learns)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"score", "predicted"}]
    rows = learners.select(F.col(key).alias("id"), F.col(text).alias("text")).join(known.select("id"), "id", "left_semi")
    model = word_model(rows)
    told = stored(with_words(docs, model, text, keep), "words", compression="zstd")
    own = told if learns is None else told.filter(learns)
    model = fit_on_words(own.select(F.col(key).alias("id"), "__words"), known, model)
    return _scored(told, model, keep, "__words", False)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), remainder("doc_id", 3)
    labels = table(spark, sf_dir, "labels").filter(fold != 1)
    out = judged(docs.select("doc_id", "text"), labels, fold != 1, ["doc_id"])
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", "predicted")
