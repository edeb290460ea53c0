"""Exact top-k search by inner product over vectors of whole numbers.

Queries and candidates are dealt out by hash over a grid whose cells hold a bounded number of either. Each cell
multiplies tiles of its queries with shards of its candidates and keeps the best k ids per query and tile by
partial selection; the lists of the cells are merged as a tree. Repeated rows are folded before they are dealt
out, several vectors of an id before each cut. Nothing is broadcast, and no pair of rows
leaves a cell unless it is among the best k there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Expected rows of a cell of the grid.
CELL_QUERIES, CELL_CANDIDATES = 4096, 8192
#: Rows of a tile: the product of one tile has 512 x 4096 scores.
TILE_QUERIES, TILE_CANDIDATES = 512, 4096
#: Lists that one step of the tree merges.
FAN_IN = 16
LONG = np.iinfo(np.int64)


def _matrix(rows: pa.Table, dim: int) -> np.ndarray:
    values = rows.column("vector").combine_chunks()
    return np.asarray(values.flatten()).reshape(rows.num_rows, dim)


def _scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products as int64; what does not fit is held at the ends of its range."""
    dim = max(queries.shape[1], 1)
    largest = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * dim
    if largest < 2.0**53:
        return (queries @ shard.T).astype(np.int64)
    as_int = np.frompyfunc(int, 1, 1)
    exact = as_int(queries).dot(as_int(shard).T)
    return np.clip(exact, int(LONG.min), int(LONG.max)).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the k best (score, then smaller id), after a partial selection that keeps all ties of the k-th."""
    if scores.shape[1] > k:
        kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= kth[:, None])
    else:
        row, col = np.nonzero(np.ones(scores.shape, bool))
    value, found = scores[row, col], ids[col]
    order = np.lexsort((found, -value.astype(object) if (value == LONG.min).any() else -value, row))
    row, value, found = row[order], value[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    return row[keep], np.stack([value[keep], found[keep]])


def _once(scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of equal ids, which stand side by side, as one with the best score of each row."""
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    if len(first) == len(ids):
        return scores, ids
    return np.maximum.reduceat(scores, first, axis=1), ids[first]


def _search_cell(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and candidates.num_rows:
            dim = len(queries.column("vector")[0])
            left, right = _matrix(queries, dim), _matrix(candidates, dim)
            left_ids, right_ids = (np.asarray(t.column("vec_id")) for t in (queries, candidates))
            by_id = np.argsort(right_ids, kind="stable")
            right, right_ids = right[by_id], right_ids[by_id]
            for q in range(0, len(left), TILE_QUERIES):
                own = left_ids[q : q + TILE_QUERIES]
                lists = []
                for c in range(0, len(right), TILE_CANDIDATES):
                    scores = _scores(left[q : q + TILE_QUERIES], right[c : c + TILE_CANDIDATES])
                    scores, ids = _once(scores, right_ids[c : c + TILE_CANDIDATES])
                    same = own[:, None] == ids[None, :]
                    if same.any():  # a query is no candidate of its own: k + its own rows, less these
                        row, best = _best(np.where(same, LONG.min, scores), ids, k + int(same.sum(axis=1).max()))
                        other = own[row] != best[1]
                        row, best = row[other], best[:, other]
                    else:
                        row, best = _best(scores, ids, k)
                    lists.append(np.vstack([row, best]))
                row, value, ids = np.hstack(lists)
                order = np.lexsort((-np.maximum(value, LONG.min + 1), ids, row))
                row, value, ids = row[order], value[order], ids[order]
                again = (row[1:] == row[:-1]) & (ids[1:] == ids[:-1])  # an id with vectors in two tiles
                first = np.concatenate([[True], ~again])[: len(row)]
                row, value, ids = row[first], value[first], ids[first]
                order = np.lexsort((ids, -np.maximum(value, LONG.min + 1), row))
                row, value, ids = row[order], value[order], ids[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                found.append(np.stack([own[row[keep]], ids[keep], value[keep]]))
        query, ids, value = np.hstack(found) if found else np.empty((3, 0), np.int64)
        cell = (candidates if candidates.num_rows else queries).column("column")[0].as_py()
        return pa.table(
            {"query_id": query, "vec_id": ids, "score": value, "part": pa.array([cell] * len(query), pa.int32())}
        )

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "vector") -> DataFrame:
    """`query_id, rank, vec_id, score`: the k candidates of the highest inner product, ties to smaller ids.

    Vectors are arrays of doubles with whole numbers. Rows with a NULL id or vector, or with a NULL, infinite or
    NaN component, take no part; only vectors of equal length meet. Candidates with the query's id are no
    candidates of it. Identical rows count once; an id with several vectors is searched with each, and of
    equal (query, candidate) pairs the best score counts. Empty tables give an empty result.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~bad)

    left, right = usable(queries), usable(candidates)
    rows, columns = (
        max(1, math.ceil(df.count() / cell)) for df, cell in ((left, CELL_QUERIES), (right, CELL_CANDIDATES))
    )

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
        spread = df.distinct().withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return spread.withColumn("dim", F.size("vector"))

    cell = ["dim", "row", "column"]
    grid = dealt(left, "row", rows, "column", columns).groupBy(*cell)
    shards = dealt(right, "column", columns, "row", rows).groupBy(*cell)
    lists = grid.cogroup(shards).applyInArrow(_search_cell(k), "query_id long, vec_id long, score long, part int")
    lists = lists.groupBy("query_id", "part", "vec_id").agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), F.col("vec_id")]
    while columns > FAN_IN:
        columns = math.ceil(columns / FAN_IN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        place = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))
        lists = lists.withColumn("rank", place).filter(F.col("rank") <= k).drop("rank")
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """`vec_id` and `vector`: floor(scale * x) of every component, as doubles."""
    cells = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.lit(float(scale)) * x)
    finite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.transform(cells, lambda x: F.when(finite(x) | (F.abs(x) >= 2.0**52), x).otherwise(F.floor(x).cast("double")))
    return vectors.select("vec_id", whole.alias("vector"))


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors.filter(F.col("vec_id") % 20 == 0), vectors, k=20)
