"""Vector search of a query set against all rows: a grid of bounded cells, tiles inside a cell, merged top lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.tools import partitions, table
from rostrum.plans.skew import top_k_per_key

# a cell holds about so many candidates and queries; a tile is a block of the product inside it
CELL_ROWS, CELL_QUERIES = 32_768, 8_192
TILE_ROWS, TILE_QUERIES = 4_096, 512
# pairs recomputed at once
PAIRS = 200_000

Selector = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def usable(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """``id`` and ``v`` of the vectors that take part: not null, not empty, only finite components, all zero only if ``zero``.

    Rows without an id take no part; rows that repeat an id count once, with the smallest vector.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite
    if not zero:
        ok &= F.exists(vector, lambda x: x != 0)
    return df.filter(ok).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def merged_best(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, q))
    q, score, ids = q[order], score[order], ids[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], score[keep], ids[keep]


def first_of_equals(rows: np.ndarray, k: int) -> np.ndarray:
    """Marks the first ``k`` of equal rows."""
    _, group = np.unique(rows, axis=0, return_inverse=True)
    order = np.argsort(group, kind="stable")
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows)) - np.searchsorted(group[order], group[order])
    return place < k


def grid_search(queries: DataFrame, candidates: DataFrame, k: int, select: Selector, score_type: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` best candidates other than its own id.

    Both sides (``id`` long, ``v`` array<double>) are dealt by hash over a grid whose cells hold a bounded number
    of rows: every query meets every candidate of its dimension in exactly one cell. Of equal vectors in a cell
    only the first k + 1 by id can be in a list, so the rest isn't multiplied. A cell returns at most
    ``k`` rows per query; the lists of the cells are merged by a top-k whose limit also holds before the shuffle.
    """
    spark = queries.sparkSession
    n, m = candidates.count(), queries.count()
    across = max(-(-n // CELL_ROWS), min(partitions(spark), -(-n // (TILE_ROWS // 2))), 1)
    down = max(-(-m // CELL_QUERIES), 1)
    spot = lambda seed, count: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("id", "v", F.size("v").alias("dim"), spot(1, down).alias("down"), every(across).alias("across"))
    right = candidates.select("id", "v", F.size("v").alias("dim"), spot(2, across).alias("across"), every(down).alias("down"))

    def cell(ask: pa.Table, rows: pa.Table) -> pa.Table:
        names, found = ["query_id", "vec_id", "score"], []
        if ask.num_rows and rows.num_rows:
            dim = ask.column("dim")[0].as_py()
            ask_ids, row_ids = (np.asarray(t.column("id").to_numpy(), np.int64) for t in (ask, rows))
            order = np.argsort(row_ids)  # ties go to smaller ids: the first columns
            ask_v, row_v, row_ids = _matrix(ask.column("v"), dim), _matrix(rows.column("v"), dim)[order], row_ids[order]
            matters = first_of_equals(row_v, k + 1)
            row_v, row_ids = row_v[matters], row_ids[matters]
            for at in range(0, len(ask_ids), TILE_QUERIES):
                best = (np.empty(0, np.int64), np.empty(0, score_type), np.empty(0, np.int64))
                part = slice(at, at + TILE_QUERIES)
                for to in range(0, len(row_ids), TILE_ROWS):
                    tile = slice(to, to + TILE_ROWS)
                    new = select(ask_v[part], ask_ids[part], row_v[tile], row_ids[tile], k)
                    best = merged_best(*[np.concatenate(x) for x in zip(best, new, strict=True)], k)
                found.append((ask_ids[part][best[0]], best[2], best[1]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, score_type)]
        return pa.table(dict(zip(names, columns, strict=True)))

    kind = {"int64": "long", "float64": "double"}[score_type]
    keys = ["dim", "across", "down"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, f"query_id long, vec_id long, score {kind}")
    best = top_k_per_key(lists, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact_tile(ask: np.ndarray, ask_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """Integer products of a tile and each query's ``k`` best columns.

    Whole numbers below 2^53 are exact in double precision, where the product runs as one matrix
    multiplication; vectors too large for that are multiplied as 64-bit integers (which wrap like SQL's).
    """
    if np.abs(ask).max() * np.abs(rows).max() * ask.shape[1] < 2.0**53:
        score = (ask @ rows.T).astype(np.int64)
    else:
        score = ask.astype(np.int64) @ rows.astype(np.int64).T
    least = np.iinfo(np.int64).min
    own = ask_ids[:, None] == row_ids[None, :]
    score[own] = least
    if score.shape[1] > k:
        cut = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
        above = score > cut
        level = score == cut
        keep = (above | level & (level.cumsum(1) <= k - above.sum(1)[:, None])) & ~own
    else:
        keep = ~own
    q, c = np.nonzero(keep)
    return q, score[q, c], row_ids[c]


def exact_top_k(df: DataFrame, is_query: str, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """The ``k`` largest integer inner products of every query (``is_query``: SQL condition on ``id``) over all other rows.

    Components become floor(``scale`` * x), x as double. Tiled matrix products, partial selection per tile and
    merging of the lists of tiles, cells and tasks. Vectors of different dimension don't meet. An empty table
    gives no rows; other columns are not read.
    """
    whole = usable(df, key, vector, zero=True).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    return grid_search(whole.filter(is_query), whole, k, exact_tile, "int64")


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scales, the lengths of the decoded vectors and of what they miss."""
    scale = np.abs(rows).max(1) / 127
    scale[scale == 0] = 1
    codes = np.rint(rows / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.sqrt((decoded**2).sum(1)), np.sqrt(((rows - decoded) ** 2).sum(1))


def bounded_tile(ask: np.ndarray, ask_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """Products of int8 codes with their error bounds; pairs that may be among the ``k`` best are recomputed in double.

    |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'| for decoded x', y'. A pair survives if its upper bound reaches
    the k-th largest lower bound of its query.
    """
    a, a_scale, a_size, a_miss = quantised(ask)
    b, b_scale, b_size, b_miss = quantised(rows)
    # sums of products of codes are whole numbers below 2^24 up to 1040 components: exact in single precision
    kind = np.float32 if ask.shape[1] <= 1040 else np.float64
    near = (a.astype(kind) @ b.astype(kind).T).astype(np.float64) * a_scale[:, None] * b_scale[None, :]
    slack = a_miss[:, None] * (b_size + b_miss)[None, :] + a_size[:, None] * b_miss[None, :]
    slack += 1e-12 * (a_size + a_miss)[:, None] * (b_size + b_miss)[None, :]  # rounding of the products themselves
    low, high = near - slack, near + slack
    own = ask_ids[:, None] == row_ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    survives = ~own
    if low.shape[1] > k:
        survives &= high >= np.partition(low, low.shape[1] - k, axis=1)[:, -k][:, None]
    q, c = np.nonzero(survives)
    score = np.empty(len(q))
    for at in range(0, len(q), PAIRS):
        part = slice(at, at + PAIRS)
        score[part] = np.einsum("ij,ij->i", ask[q[part]], rows[c[part]])
    return q, score, row_ids[c]


def nearest_neighbours(df: DataFrame, is_query: str, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows by inner product of every query (``is_query``: SQL condition on ``id``).

    A block matrix join over int8 codes; the error bounds keep it complete, so recall is 1. Zero vectors take
    no part. The rest as in ``exact_top_k``.
    """
    whole = usable(df, key, vector, zero=False)
    return grid_search(whole.filter(is_query), whole, k, bounded_tile, "float64")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), "id % 100 = 0", 10)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), "id % 20 = 0", 20)


ORACLE_EXACT = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 10
"""
