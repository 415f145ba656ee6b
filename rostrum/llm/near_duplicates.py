"""Near-duplicate documents: circulant MinHash, banding, and exact Jaccard verification on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.tools import partitions, stored, table, texts_of, words

SHINGLE = 5
# 100 * intersection >= 75 * union
SIMILARITY = 75
# 32 bands of 4 coordinates: a pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6
BANDS, ROWS = 32, 4
# of 128 coordinates (one byte each), a pair at the threshold agrees on fewer than 70 with probability 1e-7
LEAST_AGREEING = 70
# members of a verification group; documents of a block and shingles of a matrix where blocks are compared
GROUP = 128
BLOCK, COLUMNS = 512, 4096
# ids up to this number may be broadcast (16 bytes each)
BROADCAST_IDS = 300_000
# a task's memory of word hashes, in words, of words up to a length; it then starts anew
MEMORY, REMEMBERED = 250_000, 64
U32, U64 = np.uint32, np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers."""
    h = (h ^ (h >> U64(31))) * U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(29))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


class Shingler:
    """The shingles of texts, with a bounded memory of word hashes that its task owns."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def _word_hashes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), U64, len(tokens))
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            long_ = {}
            for word in tokens:
                if word not in known:
                    (known if len(word) <= REMEMBERED else long_)[word] = xxhash.xxh3_64_intdigest(word)
            if long_:
                return np.array([long_[w] if w in long_ else known[w] for w in tokens], U64)
            return np.fromiter(map(known.__getitem__, tokens), U64, len(tokens))

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles of a whole text as sorted 64-bit hashes; fewer words than a shingle has count as one."""
        tokens = words(text)
        if not tokens:
            return np.empty(0, U64)
        h = self._word_hashes(tokens)
        width = min(SHINGLE, len(h))
        mixed = np.full(len(h) - width + 1, width, U64)
        for i in range(width):
            mixed = _mixed(mixed + h[i : len(h) - width + 1 + i])
        return np.unique(mixed)


def _arranged(x: np.ndarray) -> np.ndarray:
    """One fixed permutation of 32-bit numbers."""
    x = (x ^ (x >> U32(16))) * U32(0x7FEB352D)
    x = (x ^ (x >> U32(15))) * U32(0x846CA68B)
    return x ^ (x >> U32(16))


def signature(hashes: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: a first permutation places the shingles, a second one shifted by 1, 2, ... gives each coordinate's minimum."""
    placed = (_mixed(hashes ^ U64(0xA0761D6478BD642F)) >> U64(32)).astype(U32)
    out, shifts = np.empty(size, U32), np.arange(1, size + 1, dtype=U32)[:, None]
    out[:] = np.iinfo(U32).max
    for at in range(0, len(placed), 4096):  # bounded memory for long texts
        np.minimum(out, _arranged(placed[at : at + 4096][None, :] + shifts).min(axis=1), out=out)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)
    for column in coordinates.reshape(BANDS, ROWS).T:
        key = _mixed(key + column.astype(U64))
    return key


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: doc_id, n_shingles, class (digest of the whole set), band keys, coordinates (one byte each)."""

    def run(batches):
        shingles = Shingler().shingles
        for batch in batches:
            size, cls, bands, coordinates = [], [], [], []
            for one in texts_of(batch.column(1)):
                found = shingles(one)
                size.append(len(found))
                if len(found):
                    own = signature(found)
                    cls.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bands.append(band_keys(own).view(np.int64))
                    coordinates.append((own & U32(255)).astype(np.uint8).tobytes())
                else:
                    cls.append(None)
                    bands.append(None)
                    coordinates.append(None)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(coordinates, pa.binary()),
            ], ["doc_id", "n_shingles", "cls", "bands", "coordinates"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_shingles long, cls binary, bands array<long>, coordinates binary")


def contracted(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``: for every end of an edge (a, b) the smallest node it can reach.

    Rounds of contraction: each node moves to its smallest neighbour, edges follow, until none is left.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.filter("a <> b").distinct(), "edges")
    labels = stored(both(edges).select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    while not edges.isEmpty():
        step = stored(both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        labels = stored(labels.join(step, labels["label"] == step["a"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        to_a, to_b = step.select("a", F.col("to").alias("x")), step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        moved = edges.join(to_a, "a").join(to_b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = stored(moved.filter("a <> b").distinct(), "edges")
    return labels


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose coordinates agree often enough to be similar."""
    own = reps.select("rep", "coordinates")
    wide = (
        pairs.join(own.withColumnsRenamed({"rep": "hub", "coordinates": "x"}), "hub")
        .join(own.withColumnsRenamed({"rep": "member", "coordinates": "y"}), "member").select("hub", "member", "x", "y"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                mask = pa.array((x == y).sum(1) >= LEAST_AGREEING)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in (0, 1)], ["hub", "member"])

    return wide.mapInArrow(run, "hub long, member long")


def _named_texts(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """The texts of documents named by ``wanted`` (column rep)."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(wanted, "rep")


def _by_rare_shingles(rows: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The documents of ``rows`` dealt anew into buckets by their rare shingles.

    Two sets of similarity t share one of the n - ceil(t n) + 1 first shingles of each in any common order; the
    order here is from rare to frequent among these documents. A passage that many otherwise different documents
    share fills buckets of band keys but is never rare, so it brings nobody together here.
    """
    wanted = stored(rows.select("rep").distinct().join(reps.select("rep", "cls", "n_shingles"), "rep"), "open")

    def spread(batches):
        shingles = Shingler().shingles
        for batch in batches:
            ids, sizes, classes, found = [], [], [], []
            for rep, one, cls, n in zip(*[batch.column(c).to_pylist() for c in ("rep", "text", "cls", "n_shingles")], strict=True):
                own = shingles(one)
                if xxhash.xxh3_128_digest(own.tobytes()) == cls:
                    ids.append(rep)
                    sizes.append(n)
                    classes += [cls] * len(own)
                    found.append(own.view(np.int64))
            counts = np.fromiter(map(len, found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array(ids, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int64), counts)),
                pa.array(classes, pa.binary()), pa.array(np.concatenate([*found, np.empty(0, np.int64)]))], ["rep", "n", "cls", "shingle"])

    single = stored(_named_texts(docs, wanted, key, text).select("rep", "text", "cls", "n_shingles").mapInArrow(spread, "rep long, n long, cls binary, shingle long"), "shingles")
    shared = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ordered = single.join(shared, "shingle").groupBy("rep", "n", "cls").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    # shingles of one document only come first in the order and meet nobody
    room = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1 - (F.col("n") - F.size("s"))
    dealt = ordered.filter(room > 0).select("rep", "n", F.explode(F.slice("s", F.lit(1), room.cast("int"))).alias("e"))
    return dealt.select(F.col("e.shingle").alias("bucket"), "rep", "n")


def _linked_in_blocks(rows: DataFrame, reps: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Links (hub, member) between documents of ``rows`` that share a bucket, directly or over others, and are in
    different components; decided on full sets, at most one link from a document to a component.

    Documents connected over buckets form a neighbourhood; a large one is dealt into blocks, and each two blocks
    meet in one task of bounded size, where intersections are products of 0/1 matrices. Only links come out.
    """
    stars = rows.groupBy("bucket").agg(F.min("rep").alias("a")).join(rows.select("bucket", F.col("rep").alias("b")), "bucket").select("a", "b")
    around = contracted(stars).select(F.col("node").alias("rep"), F.col("label").alias("around"))
    members = stored(rows.select("rep", "label").distinct().join(around, "rep"), "members")
    sizes = members.groupBy("around").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    wanted = stored(members.join(sizes, "around").join(reps.select("rep", "cls"), "rep").withColumn("own", own), "wanted")

    def sets(batches):
        shingles = Shingler().shingles
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for rep, one, label, around_, blocks, cls, mine in zip(*[batch.column(c).to_pylist() for c in ("rep", "text", "label", "around", "blocks", "cls", "own")], strict=True):
                found = shingles(one)
                if xxhash.xxh3_128_digest(found.tobytes()) == cls:
                    for other in range(blocks):
                        for column, value in zip(out, (around_, min(mine, other), max(mine, other), mine, rep, label, found.view(np.int64)), strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["around", "i", "j", "own", "rep", "label", "hashes"])

    def compare(group: pa.Table) -> pa.Table:
        # repeated rows once; an id may have several sets
        once = dict(zip(zip(group.column("rep").to_pylist(), (xxhash.xxh3_128_digest(h.values.to_numpy().tobytes()) for h in group.column("hashes")), strict=True), range(group.num_rows), strict=True))
        first = np.array([once[k] for k in sorted(once)], np.int64)
        rep = group.column("rep").to_numpy()[first]
        label, mine = (group.column(c).to_numpy()[first] for c in ("label", "own"))
        found = [group.column("hashes")[k].values.to_numpy() for k in first.tolist()]
        n = np.fromiter(map(len, found), np.int64, len(found))
        _, column, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(found)), n), counts > 1
        place = np.cumsum(shared) - 1
        row, column = row[shared[column]], place[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(found), len(found)), np.float32)
        for at in range(0, int(shared.sum()), COLUMNS):
            part = slice(*np.searchsorted(column, [at, at + COLUMNS]))
            x = np.zeros((len(found), COLUMNS), np.float32)
            x[row[part], column[part] - at] = 1
            common += x @ x.T
        linked = 100 * common >= SIMILARITY * (n[:, None] + n[None, :] - common)
        linked &= label[:, None] != label[None, :]
        if group.column("i")[0].as_py() != group.column("j")[0].as_py():
            linked &= mine[:, None] != mine[None, :]
        hubs, members_ = [], []
        for k in np.flatnonzero(linked.any(1)).tolist():
            others = np.flatnonzero(linked[k])
            others = others[np.unique(label[others], return_index=True)[1]]
            hubs.append(np.minimum(rep[others], rep[k]))
            members_.append(np.maximum(rep[others], rep[k]))
        empty = [np.empty(0, np.int64)]
        return pa.table({"hub": np.concatenate(hubs or empty), "member": np.concatenate(members_ or empty)})

    sent = _named_texts(docs, wanted, key, text).select("rep", "text", "label", "around", "blocks", "cls", "own").mapInArrow(
        sets, "around long, i int, j int, own int, rep long, label long, hashes array<long>")
    return sent.groupBy("around", "i", "j").applyInArrow(compare, "hub long, member long")


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pairs (hub, member) whose full shingle sets are similar enough.

    Every document named by a pair is shingled once more from its whole text and its set sent to the groups that
    need it; a hub with very many members has several groups, each of bounded size.
    """
    pairs = stored(pairs, "pairs")
    spread = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(spread, "hub").withColumn("part", F.pmod(F.xxhash64("member"), F.col("groups")).cast("int"))
    places = dealt.select(F.col("member").alias("rep"), "hub", "part").union(
        spread.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part")))
    wanted = stored(
        places.groupBy("rep").agg(F.collect_list(F.struct("hub", "part")).alias("places")).join(reps.select("rep", "cls"), "rep"), "wanted")
    named = _named_texts(docs, wanted, key, text) if pairs.count() <= 4 * BROADCAST_IDS else docs.select(
        F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).join(wanted, "rep")

    def sets(batches):
        shingles = Shingler().shingles
        for batch in batches:
            hubs, parts, ids, found = [], [], [], []
            for rep, one, cls, places in zip(*[batch.column(c).to_pylist() for c in ("rep", "text", "cls", "places")], strict=True):
                own = shingles(one)
                if xxhash.xxh3_128_digest(own.tobytes()) != cls:
                    continue  # a row that shares an id with the class's first document
                for place in places:
                    hubs.append(place["hub"])
                    parts.append(place["part"])
                    ids.append(rep)
                    found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(hubs, pa.int64()), pa.array(parts, pa.int32()), pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                ["hub", "part", "member", "hashes"])

    def compare(group: pa.Table) -> pa.Table:
        hub, out, owns, rest = group.column("hub")[0].as_py(), set(), [], []
        for member, hashes in zip(group.column("member").to_pylist(), group.column("hashes"), strict=True):
            values = hashes.values.to_numpy()
            if member == hub:
                owns.append(values)
            else:
                rest.append((member, values))
        for member, values in rest:
            # sets are sorted as unsigned numbers; only equality matters here; any set of an id may link it
            for own in owns:
                common = len(own) + len(values) - len(np.unique(np.concatenate([own, values])))
                if 100 * common >= SIMILARITY * (len(own) + len(values) - common):
                    out.add(member)
                    break
        return pa.table({"hub": pa.array([hub] * len(out), pa.int64()), "member": pa.array(sorted(out), pa.int64())})

    sent = named.select("rep", "text", "cls", "places").mapInArrow(sets, "hub long, part int, member long, hashes array<long>")
    return sent.groupBy("hub", "part").applyInArrow(compare, "hub long, member long")


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets whose members are in more than one component."""
    named = rows.select("bucket", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).filter("x <> y")
    return stored(named.join(mixed.select("bucket", "size"), "bucket"), "buckets")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Documents with equal sets form a class with one representative. Representatives that share a band key form a
    bucket. First the members of each bucket are paired with its first document, the hub: a group of copies
    becomes one component at one pair per document. Documents in buckets whose members are then in several
    components are dealt anew by rare shingles, and what still shares a bucket across components is decided on full
    sets in blocks. So no link between components is lost, though not every pair inside one is listed, and every
    link is confirmed on full sets.

    Null and empty texts have no shingles, their own id as component, and are kept. Rows without an id are not
    linked: component_id null, kept true. Rows that repeat an id count as one document. Other columns are not read.
    """
    sketch = stored(sketches(docs, key, text), "sketches")
    linkable = sketch.filter("cls is not null and doc_id is not null")
    reps = stored(linkable.groupBy("cls", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("coordinates").alias("coordinates")), "representatives")
    rows = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).filter("x <> y").select("bucket")
    rows = stored(rows.join(crowded, "bucket"), "buckets")
    # an id with several texts connects their classes
    several = linkable.groupBy("doc_id").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).filter("x <> y").select("doc_id")
    held = linkable.join(several, "doc_id", "left_semi").select("doc_id", "cls").distinct().join(reps.select("cls", "rep"), "cls")
    same = stored(held.groupBy("doc_id").agg(F.min("rep").alias("a")).join(held, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct(), "same")
    labels = None if same.isEmpty() else contracted(same)
    if not rows.isEmpty():
        first = rows.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("h")).select("bucket", F.col("h.rep").alias("hub"), F.col("h.n").alias("m"))
        pairs = rows.join(first, "bucket").filter("rep <> hub and 100 * least(n, m) >= 75 * greatest(n, m)").select("hub", F.col("rep").alias("member"))
        ends = ["hub as a", "member as b"]
        links = stored(verified(_likely(pairs.distinct(), reps), docs, reps, key, text).selectExpr(*ends).union(same), "links")
        labels = contracted(links)
        rows = _open(rows, labels)
        rows = _open(_by_rare_shingles(rows, reps, docs, key, text), labels)
        if not rows.isEmpty():
            more = _linked_in_blocks(rows, reps, docs, key, text).selectExpr(*ends)
            labels = contracted(links.union(more))

    members = reps.select("cls", "rep")
    if labels is None:
        members = members.withColumn("label", F.col("rep"))
    else:
        members = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # copies of one text can be a third of the rows: the class is salted on both sides of the join
    salts = partitions(docs.sparkSession)
    spread = members.select("cls", "label", F.explode(F.sequence(F.lit(0), F.lit(min(salts, 32) - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(min(salts, 32))).cast("int")
    out = sketch.select("doc_id", "n_shingles", "cls", salt.alias("salt")).join(spread, ["cls", "salt"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
