"""Nearest neighbours by a block matrix join.

Rows and queries are dealt into a grid of tiles; in a tile, one product of two int8 matrices
gives every dot product of the quantised unit vectors. The quantisation error of a pair is
bounded by the two vectors' own rounding errors, so a pair survives only if its upper bound
reaches the k-th best lower bound of its query; survivors are computed again in double from
the original vectors, kept in a heap of k a query, and the tiles' heaps are merged.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take
no part, neither as query nor as candidate, nor do rows with a null id; vectors of another length
than their query's are never its candidates; rows that repeat a vec_id are rows of their own, each
asked for itself and a candidate of the others; ties go to the smaller vec_id; fewer candidates than k give fewer
rows; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a tile's two sides; both bound what one task holds (at 64 dimensions under 10 MB).
TILE_ROWS, TILE_QUERIES = 8192, 1024


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, embedding array<double>, row (a number of each row) of the rows that take part, as a written table, so that numbers stay."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"), good.alias("_good"))
    return written(rows.filter(F.coalesce("_good", F.lit(False))).select("vec_id", "embedding", F.monotonically_increasing_id().alias("row")), "vectors")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, the codes' lengths and the rounding errors' lengths."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    error = np.sqrt(((unit - back) ** 2).sum(axis=1))
    return codes, scale, np.sqrt((back * back).sum(axis=1)), error


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine in double, summed from the first component to the last."""
    dot = float(np.cumsum(a * b)[-1])
    return dot / (float(np.sqrt(np.cumsum(a * a)[-1])) * float(np.sqrt(np.cumsum(b * b)[-1])))


def tile_best(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple[int, int, float, int]]:
    """(query's row, query, score, vec_id) of each query's k best in one tile, all vectors of one length."""
    q, r = np.stack(queries["embedding"]), np.stack(rows["embedding"])
    q_ids, r_ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
    q_rows, r_rows = queries["row"].to_numpy(), rows["row"].to_numpy()
    qc, qs, _, qe = quantised(q)
    rc, rs, rl, re = quantised(r)
    # int8 products are whole numbers far below 2**24 a chunk of dimensions, so float32 holds them exactly
    product = np.zeros((len(q), len(r)), np.float64)
    for d in range(0, q.shape[1], 1024):
        product += qc[:, d : d + 1024].astype(np.float32) @ rc[:, d : d + 1024].astype(np.float32).T
    product *= qs[:, None]
    product *= rs[None, :]
    out = []
    for i, row in enumerate(product):
        # |u.v - u'.v'| <= |u - u'| |v'| + |u| |v - v'| with |u| = 1; a little more for the doubles' own rounding
        slack = qe[i] * rl + re + 1e-9
        own = r_rows == q_rows[i]
        low = np.where(own, -np.inf, row - slack)
        most = min(k, len(low))
        floor = np.partition(low, len(low) - most)[len(low) - most]
        heap: list[tuple[float, int]] = []
        for j in np.flatnonzero((row + slack >= floor) & ~own):
            item = (exact_cosine(q[i], r[j]), -int(r_ids[j]))
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item > heap[0]:
                heapq.heapreplace(heap, item)
        out += [(int(q_rows[i]), int(q_ids[i]), score, -negative) for score, negative in heap]
    return out


def nearest(queries: DataFrame, rows: DataFrame, k: int = 5, tile_rows: int = TILE_ROWS, tile_queries: int = TILE_QUERIES) -> DataFrame:
    """query_id, rank from 1, vec_id, score (cosine) of the k nearest rows of each query but itself, and query_row, which tells rows of one id apart.

    Both sides: vec_id long, embedding array<double>, row long, as `usable` returns them. The grid has about
    rows/tile_rows by queries/tile_queries tiles, so a tile's size doesn't grow with the input; each
    row is sent once for each block of queries.
    """
    n_rows, n_queries = rows.count(), queries.count()
    across, down = max(1, -(-n_rows // tile_rows)), max(1, -(-n_queries // tile_queries))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")
    r = rows.select("*", place(across).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("q"))
    q = queries.select("*", place(down).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("r"))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(across * down, 20_000))
    tile = F.concat_ws("-", "q", "r")
    r, q = (x.withColumn("tile", tile).drop("q", "r") for x in (r, q))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right_size = right["embedding"].map(len)
            for size, same in left.groupby(left["embedding"].map(len)):
                own = right[right_size == size]
                if len(own):
                    out += tile_best(same, own, k)
        return pd.DataFrame(out, columns=["query_row", "query_id", "score", "vec_id"]).astype({"query_row": "int64", "query_id": "int64", "score": "float64", "vec_id": "int64"})

    found = (
        q.repartition(parts, "tile").groupBy("tile").cogroup(r.repartition(parts, "tile").groupBy("tile")).applyInPandas(best, "query_row long, query_id long, score double, vec_id long")
    )
    # the tiles' heaps, k rows a query each: the window keeps k of them in each task before the shuffle
    best_first = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "query_row")
