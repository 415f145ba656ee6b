"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.tools import hash_sample, remainder, table, texts_of

ORDER = 5
# labelled documents a language's model is fitted on, and others it is calibrated on: at most so many, chosen by a hash of the id
SAMPLE, CALIBRATION = 800, 200
# rejection: cross-entropy beyond this part of the way from the language's usual value to that of uniform letters,
# plus so many standard errors at the text's length
REJECT_WAY, REJECT_ERRORS = 0.8, 8.0
# letters worked on at once, and scored n-grams a worker remembers
CHUNK, MEMORY = 200_000, 1_000_000
NO_LANGUAGE = "und"
U64 = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_of(text: str, order: int = ORDER) -> np.ndarray:
    """Code points of the lower-cased text: runs of other characters become one blank; ``order`` - 1 blanks lead, one ends.

    Without any letter the result is empty.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, np.uint32)
    points = np.where(is_letter, points, 32).astype(np.uint32)
    blank = ~is_letter
    points = points[~(blank & np.concatenate([[True], blank[:-1]]))]
    if points[-1] != 32:
        points = np.append(points, np.uint32(32))
    return np.concatenate([np.full(order - 1, 32, np.uint32), points])


def _hashed(points: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0..order: the hash of the n characters that end at each place."""
    own = points.astype(U64) + U64(1)
    out = [np.zeros(len(points), U64)]
    for n in range(1, order + 1):
        h = np.zeros(len(points), U64)
        for back in range(n - 1, -1, -1):  # oldest first
            h[n - 1 :] = h[n - 1 :] * U64(0x9E3779B97F4A7C15) + own[n - 1 - back : len(own) - back]
            h[n - 1 :] ^= h[n - 1 :] >> U64(29)
        out.append(h)
    return out


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def fit(texts: list[str], order: int = ORDER) -> dict:
    """Interpolated Kneser-Ney over the texts: for each order sorted n-gram hashes with log probabilities, and
    sorted context hashes with the log weight of the lower order."""
    chars = [p for p in (letters_of(t, order) for t in texts) if len(p)]
    if not chars:
        chars = [np.full(order, 32, np.uint32)]
    points = np.concatenate(chars)
    scored = np.concatenate([np.arange(len(p)) >= order - 1 for p in chars])
    h = _hashed(points, order)
    ends = np.flatnonzero(scored)
    grams = []
    for n in range(1, order + 1):
        keys, first, counts = np.unique(h[n][ends], return_index=True, return_counts=True)
        grams.append((keys, ends[first], counts))
    levels, lower = [], None
    for n in range(1, order + 1):
        keys, first, counts = grams[n - 1]
        if n < order:  # number of different characters seen before the n-gram
            longer = grams[n]
            counts = np.bincount(np.searchsorted(keys, h[n][longer[1]]), minlength=len(keys))
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)
        contexts, owner = np.unique(h[n - 1][first - 1], return_inverse=True)
        total = np.bincount(owner, counts)
        weight = discount * np.bincount(owner) / total
        if n == 1:
            below = np.full(len(keys), 1 / (len(keys) + 1))
            floor = np.log(weight[0] / (len(keys) + 1))
        else:
            below = np.exp(lower[1][_at(lower[0], h[n - 1][first])[0]].astype(np.float64))
        p = np.maximum(counts - discount, 0) / total[owner] + weight[owner] * below
        levels.append((keys, np.log(p).astype(np.float32), contexts, np.log(weight).astype(np.float32)))
        lower = levels[-1]
    return {"levels": levels, "floor": float(floor)}


def log_probabilities(model: dict, h: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
    """Natural log of p(last character | characters before) for n-grams given by the hashes of their ends and contexts."""
    out = np.full(len(h[1]), model["floor"], np.float32)
    for n, (keys, logs, contexts, weights) in enumerate(model["levels"], 1):
        place, seen = _at(keys, h[n])
        if n > 1:
            at, known = _at(contexts, before[n - 1])
            out += np.where(known, weights[at], np.float32(0))
        out[seen] = logs[place[seen]]
    return out


class Scorer:
    """Scores texts under all models; remembers the n-grams it has seen."""

    def __init__(self, models: dict[str, dict], order: int = ORDER):
        self.langs = sorted(models)
        self.models = [models[lang] for lang in self.langs]
        self.order = order
        self._forget()

    def _forget(self) -> None:
        self.keys, self.logs = np.empty(0, U64), np.empty((0, len(self.langs)), np.float32)

    def _lookup(self, keys: np.ndarray, h: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """Rows of log probabilities for distinct n-gram hashes; ``place`` is where each first ends."""
        if len(self.keys):
            at, known = _at(self.keys, keys)
        else:
            at, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.keys) > MEMORY:
                self._forget()
                return self._lookup(keys, h, place)
            ends = place[new]
            own, before = [x[ends] for x in h], [x[ends - 1] for x in h]
            logs = np.stack([log_probabilities(m, own, before) for m in self.models], axis=1)
            order = np.argsort(np.concatenate([self.keys, keys[new]]))
            self.keys, self.logs = np.concatenate([self.keys, keys[new]])[order], np.concatenate([self.logs, logs])[order]
            at, _ = _at(self.keys, keys)
        return self.logs[at]

    def means(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the number of scored characters, and per language the mean and mean square of -log p."""
        size = np.zeros(len(texts), np.int64)
        mean, square = np.zeros((len(texts), len(self.langs))), np.zeros((len(texts), len(self.langs)))
        part, held = [], 0
        for i, text in enumerate(texts):
            points = letters_of(text, self.order)
            if len(points):
                part.append((i, points))
                held += len(points)
            if part and (held >= CHUNK or i == len(texts) - 1):
                self._add(part, size, mean, square)
                part, held = [], 0
        if part:
            self._add(part, size, mean, square)
        return size, mean, square

    def _add(self, part, size, mean, square) -> None:
        points = np.concatenate([p for _, p in part])
        lead = self.order - 1
        rows = np.array([i for i, _ in part])
        lengths = np.array([len(p) for _, p in part])
        first = np.cumsum(lengths) - lengths
        h = _hashed(points, self.order)
        ends = np.ones(len(points), bool)
        for k in range(lead):
            ends[first + k] = False
        ends = np.flatnonzero(ends)
        codes, keys = pd.factorize(h[self.order][ends])
        place = np.empty(len(keys), np.int64)
        place[codes[::-1]] = ends[::-1]
        logs = self._lookup(np.asarray(keys, U64), h, place)
        starts = np.cumsum(lengths - lead) - (lengths - lead)
        size[rows] = lengths - lead
        for k in range(len(self.langs)):
            cost = -logs[codes, k].astype(np.float64)
            mean[rows, k] = np.add.reduceat(cost, starts) / size[rows]
            square[rows, k] = np.add.reduceat(cost * cost, starts) / size[rows]


def calibrated(models: dict[str, dict], labelled: list[tuple[str, str]]) -> dict:
    """Per language the usual cross-entropy, the limit for long texts and the spread per character, and the sharpness that turns differences of cross-entropy into probabilities; from texts the models weren't fitted on."""
    scorer = Scorer(models)
    size, mean, square = scorer.means([t for _, t in labelled])
    langs = np.array([lang for lang, _ in labelled])
    usual, within = np.full(len(scorer.langs), 3.0), np.full(len(scorer.langs), 4.0)
    for k, lang in enumerate(scorer.langs):
        own = (langs == lang) & (size > 0)
        if own.sum() >= 5:
            usual[k] = np.average(mean[own, k], weights=size[own])
            within[k] = np.average(square[own, k] - mean[own, k] ** 2, weights=size[own])
    sharp, best = 10.0, -np.inf
    truth = np.searchsorted(scorer.langs, langs)
    rows = np.flatnonzero(size > 0)
    for trial in (1.0, 2.0, 5.0, 10.0, 20.0, 40.0) if len(rows) else ():
        z = -trial * mean[rows]
        z -= z.max(1, keepdims=True)
        likely = (z[np.arange(len(rows)), truth[rows]] - np.log(np.exp(z).sum(1))).sum()
        if likely > best + 1e-9:
            sharp, best = trial, likely
    uniform = np.array([np.log(len(m["levels"][0][0]) + 1) for m in scorer.models])
    limit = usual + REJECT_WAY * np.maximum(uniform - usual, 0.5)
    return {"limit": limit, "within": within, "sharp": sharp}


def language_models(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[dict[str, dict], dict]:
    """Models of all languages in ``docs`` and their calibration, from at most SAMPLE + CALIBRATION documents each.

    The sample is a top-k by hash over narrow columns; models are fitted one language to a task, and what
    reaches the driver is bounded by the sample.
    """
    narrow = docs.select(key, lang).filter(F.col(lang).isNotNull() & F.col(key).isNotNull()).distinct()
    chosen = hash_sample(narrow, lang, key, SAMPLE + CALIBRATION)
    chosen = chosen.select(F.col(key).alias("id"), F.col(lang).alias("named"), "place")
    sample = docs.join(F.broadcast(chosen), (F.col(key) == F.col("id")) & (F.col(lang) == F.col("named")))
    # of a small sample every fifth text is kept for calibration
    held = (F.col("place") > SAMPLE) | (F.col("place") % 5 == 0)
    sample = sample.select("named", F.coalesce(text, F.lit("")).alias("text"), held.alias("held"), "place")

    def train(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[group.column(c).to_pylist() for c in ("held", "place", "text")], strict=True))
        named = group.column("named")[0].as_py()
        model = fit([t for held, _, t in rows if not held] or [t for _, _, t in rows])
        parts = [a.tobytes() for level in model["levels"] for a in level]
        kept = [t for held, _, t in rows if held] or [t for _, _, t in rows]
        return pa.table({"lang": [named], "floor": [model["floor"]], "parts": pa.array([parts], pa.list_(pa.binary())), "kept": pa.array([kept], pa.list_(pa.string()))})

    trained = sample.groupBy("named").applyInArrow(train, "lang string, floor double, parts array<binary>, kept array<string>").collect()
    models, labelled = {}, []
    for row in sorted(trained, key=lambda r: r["lang"]):
        kinds = [U64, np.float32, U64, np.float32]
        arrays = [np.frombuffer(b, kinds[i % 4]) for i, b in enumerate(row["parts"])]
        models[row["lang"]] = {"levels": [tuple(arrays[i : i + 4]) for i in range(0, len(arrays), 4)], "floor": row["floor"]}
        labelled += [(row["lang"], t) for t in row["kept"]]
    return models, calibrated(models, labelled)


def identify_languages(docs: DataFrame, models: dict[str, dict], calibration: dict, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row of ``docs`` (columns of these names are replaced).

    The language of lowest length-normalised cross-entropy wins, ties to the first by name. ``score`` is its
    calibrated probability among the languages. Null texts and texts without a letter are ``und``, score 0 and
    rejected. ``rejected`` also marks texts whose cross-entropy is far above what the language's texts have at
    that length. Without any model every row is ``und``. One narrow pass, one row per row.
    """
    kept = [c for c in docs.columns if c.lower() not in {"lang_pred", "score", "rejected"}]
    shared = docs.sparkSession.sparkContext.broadcast((models, calibration))
    at = kept.index(text)
    state: list[Scorer] = []

    def run(batches):
        models, own = shared.value
        if not state and models:
            state.append(Scorer(models))
        for batch in batches:
            texts = list(texts_of(batch.column(at)))
            pred, score, rejected = [NO_LANGUAGE] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if models:
                scorer = state[0]
                size, mean, _ = scorer.means(texts)
                rows = np.flatnonzero(size > 0)
                best = mean.argmin(1)
                z = np.exp(-own["sharp"] * (mean - mean.min(1, keepdims=True)))
                score[rows] = (1 / z.sum(1))[rows]
                limit = own["limit"][best] + REJECT_ERRORS * np.sqrt(own["within"][best] / np.maximum(size, 1))
                rejected[rows] = (mean.min(1) > limit)[rows]
                for i in rows.tolist():
                    pred[i] = scorer.langs[best[i]]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema)
    return docs.select(*[f"`{c}`" for c in kept]).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models, calibration = language_models(docs.filter(remainder("doc_id", 5) != 0))
    out = identify_languages(docs.select("doc_id", "text"), models, calibration)
    return out.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
