"""Exact top-k search by no-random-access aggregation (NRA) over sorted lists.

Queries and candidates are dealt into blocks by a hash of their ids and meet once a pair of blocks, so a task holds one block of each whatever
the tables' size. Within a pair, every dimension is a list of the candidates sorted by component. A query reads the list of each dimension in
sequence from its end that scores higher, all lists to the same depth, a ``STEPS``-th of a list a step; bounds are taken after the steps ``CHECKED``, for
all queries of the block by matrix products. What has been read of a candidate plus, for the rest, the list's far end is a lower bound of its score; with
the last value read it is an upper bound. The bar of a query is its k-th best lower bound; an outsider cannot qualify once its upper bound is under the
bar. A query stops reading when ``FEW`` times k candidates, or one of ``RESOLVED`` of the block, at most can qualify; of these the final scores are
resolved exactly. A query first meets one block, its home; the k-th score there is its least bar in all other blocks.
The best k of each pair of blocks merge by query. How much of the lists a query reads before it stops is told by ``reads``.

Components become floor(256 * x). Bounds are doubles, widened by more than their rounding; final scores are 64-bit integers. Ties go to the
smaller vec_id. Vectors that are null, or hold a null, NaN or infinite component, and rows with a null vec_id take no part. Vectors meet those
of their own length. A query has no own row among its candidates (all rows of that id); a repeated row is a candidate for each time it stands.
Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

QUERY_BLOCK, CANDIDATE_BLOCK, FEW, RESOLVED, STEPS = 512, 4096, 8, 12, 16
#: Steps after which bounds are taken: doubling to a half, then by eighths.
CHECKED = (1, 2, 4, 8, 10, 12, 14, 16)
FOUND = "query_id long, vec_id long, score long, share double"


def nra(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, bars: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """For each query the positions in x that can hold its k best scores, ties to the smaller id, its own id left out, and the share of the lists
    that it read. Scores under a query's bar (NaN: none) need not be named."""
    n, dims = x.shape
    lists = np.argsort(-x, axis=0, kind="stable")
    rank = np.empty_like(lists)
    np.put_along_axis(rank, lists, np.arange(n)[:, None], axis=0)
    x, queries = x.astype(float), queries.astype(float)
    slack = 2.0**-44 * (1 + np.abs(queries) @ np.abs(x).max(axis=0))
    bars = np.full(len(queries), -np.inf) if bars is None else np.where(np.isnan(bars), -np.inf, bars)
    own_query, own_row = np.nonzero(query_ids[:, None] == ids[None, :])
    kept, share = [np.zeros(0, np.int64)] * len(queries), np.ones(len(queries))
    todo, enough = np.arange(len(queries)), max(FEW * k, n // RESOLVED)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    worst_up, worst_down = up * x.min(axis=0), down * x.max(axis=0)  # by query and dimension
    for step in CHECKED if n > enough else (0,):
        # bounds of all that is read down to this depth, by query and candidate: sums over the lists read from the top and from the bottom
        depth = -(-n * step // STEPS)
        top, bottom = (rank < depth).astype(float), (rank >= n - depth).astype(float)
        front_high, front_low = (x[lists[depth - 1], np.arange(dims)], x[lists[n - depth], np.arange(dims)]) if depth else (x.max(axis=0), x.min(axis=0))
        low_up, low_down = worst_up[todo], worst_down[todo]
        read = np.hstack([top * x, bottom * x, top, bottom])
        lower = np.hstack([up[todo], down[todo], -low_up, -low_down]) @ read.T
        lower += (low_up + low_down).sum(axis=1)[:, None]
        gap_up, gap_down = up[todo] * front_high - low_up, down[todo] * front_low - low_down
        upper = np.hstack([gap_up, gap_down]) @ -read[:, 2 * dims :].T
        upper += lower
        upper += (gap_up + gap_down).sum(axis=1)[:, None]
        place = np.searchsorted(todo, own_query)
        mine = (place < len(todo)) & (todo[np.minimum(place, len(todo) - 1)] == own_query)
        lower[place[mine], own_row[mine]] = upper[place[mine], own_row[mine]] = -np.inf
        bar = bars[todo]
        if n > k:
            bar = np.maximum(bar, np.partition(lower, n - k, axis=1)[:, n - k])
        qualify = upper >= (bar - 2 * slack[todo])[:, None]
        qualify[place[mine], own_row[mine]] = False
        done = (qualify.sum(axis=1) <= enough) | (depth >= n)
        for at in np.flatnonzero(done):
            kept[todo[at]], share[todo[at]] = np.flatnonzero(qualify[at]), depth / n
        todo = todo[~done]
        if not len(todo):
            break
    return kept, share


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def _search(k: int):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if queries.num_rows and rows.num_rows:
            q, x = _matrix(queries["v"], queries.num_rows), _matrix(rows["x_v"], rows.num_rows)
            q_ids, ids = queries["vec_id"].to_numpy(), rows["x_id"].to_numpy()
            kept, share = nra(q, q_ids, x, ids, k, queries["bar"].cast(pa.float64()).to_numpy()) if x.shape[1] else ([np.flatnonzero(ids != i) for i in q_ids], np.zeros(len(q)))
            for i, at in enumerate(kept):
                score = x[at] @ q[i]
                best = np.lexsort((ids[at], -score))[:k]
                out[0].append(np.full(len(best), q_ids[i]))
                out[1].append(ids[at][best])
                out[2].append(score[best])
                out[3].append(np.full(len(best), share[i]))
        cols = [np.concatenate(c).astype(t) if c else np.array([], t) for c, t in zip(out, ("int64", "int64", "int64", "float64"))]
        return pa.table(dict(zip(("query_id", "vec_id", "score", "share"), cols)))

    return search


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = F.col("embedding")
    sound = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return df.filter(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * 256.0)).alias("v"))


def found_by_block(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, share): the best k of each query in each block, and the share of the block's lists that the query read."""
    n_q, n_x = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-rows.count() // CANDIDATE_BLOCK))
    dim, own = F.size("v").alias("dim"), lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair = ["dim", "qb", "xb"]
    q = queries.select("vec_id", "v", dim, own(n_q).alias("qb"), own(n_x).alias("home"))
    # both sides may come of one frame: new names of its columns keep them apart
    x = rows.select(F.col("vec_id").alias("x_id"), F.col("v").alias("x_v"), dim, own(n_x).alias("xb"), all_of(n_q).alias("qb")).groupBy(*pair)
    meet = lambda some: some.groupBy(*pair).cogroup(x).applyInArrow(_search(k), FOUND)
    at_home = meet(q.select("vec_id", "v", "dim", "qb", F.col("home").alias("xb"), F.lit(None).cast("long").alias("bar")))
    if n_x == 1:
        return at_home
    at_home = C.cut(at_home)
    bars = at_home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("bar")).alias("bar"))
    away = q.join(bars, "vec_id", "left").select("vec_id", "v", "dim", "qb", "bar", "home", all_of(n_x).alias("xb")).filter("xb <> home").drop("home")
    return at_home.unionByName(meet(away))


def reads(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """One row: the mean share of the lists that queries read before they stopped, and the share of pairs of query and block that stopped early."""
    each = found_by_block(queries, rows, k).groupBy("query_id", "share").count()
    return each.agg(F.avg("share").alias("share"), F.avg((F.col("share") < 1).cast("int")).alias("stopped"))


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of two frames (vec_id, v)."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found_by_block(queries, rows, k)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = vectors(C.table(spark, sf_dir, "embeddings"))
    return top_k(rows.filter(F.col("vec_id") % 50 == 0).dropDuplicates(["vec_id", "v"]), rows)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
