"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Vectors go to the list of their nearest coarse centroid; the residual is coded by
``subspaces`` small codebooks.  A query visits the lists whose centroids have the
largest inner product with it.  In a list, its table of inner products with all
codewords (asymmetric: the query itself is not quantised) ranks the coded vectors.  The
``rerank`` best get the exact inner product of the original vectors, in double
precision; so does every vector whose approximate product, plus ``SLACK`` standard
deviations of its coding error along a random direction, reaches the k-th best of these.

Centroids and codebooks are fitted on at most ``max_fit`` vectors, those with the least
hash of their id; every vector is indexed.  The share of lists to visit is the least at
which sample queries against the sample reach ``target`` recall.

The work is dealt out in cells of one list, a part of its vectors and a part of the
queries that visit it, so a crowded list is many cells; a cell returns at most k rows
for each query.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do
those without an id or of another length than most.  Rows that repeat an id are each a
candidate (a query is never its own); as queries they count once, with the least vector.
Ties go to the smaller id.  Extra columns are ignored; an empty table has no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written
from .textkit import lean

K, MAX_FIT, SUBSPACES, RERANK, TARGET, CELL = 20, 16_384, 16, 32, 0.96, 4096
SLACK = 2.0
#: Vectors that codebooks are fitted on, of those that centroids are.
CODEBOOK_FIT = 4096


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; a centroid that loses all its points moves to a random one."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        count = np.bincount(near, minlength=len(centre))
        total = np.stack([np.bincount(near, weights=x[:, j], minlength=len(centre)) for j in range(x.shape[1])], axis=1)
        centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), len(centre))])
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centre.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """Coarse centroids, codebooks of the residuals, and the number of lists to visit."""

    def __init__(self, sample: np.ndarray, total: int, subspaces: int = SUBSPACES, target: float = TARGET, k: int = K, seed: int = 3):
        dim = sample.shape[1]
        self.centre = kmeans(sample, int(np.clip(round(0.6 * total**0.5), 1, 1024)), 10, seed)
        near = nearest(sample, self.centre)
        self.cuts = np.linspace(0, dim, min(subspaces, dim) + 1).astype(int)
        rest = (sample - self.centre[near])[:CODEBOOK_FIT]
        self.books = [kmeans(rest[:, a:b], 256, 8, seed + 1) for a, b in zip(self.cuts[:-1], self.cuts[1:])]
        # how many lists sample queries need
        queries = sample[np.random.default_rng(seed + 2).choice(len(sample), min(len(sample), 256), replace=False)]
        best = np.argsort(-(queries @ sample.T), axis=1)[:, : k + 1]
        order = np.argsort(-(queries @ self.centre.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(len(self.centre)), order.shape), axis=1)
        needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
        self.visits = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the coding error) of each vector."""
        near = nearest(x, self.centre)
        rest = x - self.centre[near]
        code = [nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)]
        coded = np.concatenate([book[c] for book, c in zip(self.books, code)], axis=1)
        return near, np.stack(code, axis=1).astype(np.uint8), np.sqrt(((rest - coded) ** 2).sum(axis=1)).astype(np.float32)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Inner products of each query's parts with the codewords."""
        return [(q[:, a:b] @ book.T).astype(np.float32) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)]

    def lists(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists to visit for each query: the best, and more while they hold too few vectors."""
        order = np.argsort(-(q @ self.centre.T), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
        return [row[: max(self.visits, n)] for row, n in zip(order, enough)]


def search_cell(index: Index, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, error: np.ndarray, near: int, query_ids: np.ndarray, q: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, exact score) of the best k of a cell for each of its queries."""
    order = np.argsort(ids, kind="stable")
    ids, x, codes, error = ids[order], x[order], codes[order], error[order]
    out = []
    for lo in range(0, len(q), 128):
        part, own = q[lo : lo + 128], query_ids[lo : lo + 128]
        rough = np.repeat((part @ index.centre[near]).astype(np.float32)[:, None], len(ids), axis=1)
        for j, table in enumerate(index.tables(part)):
            rough += table[:, codes[:, j]]
        self_row = own[:, None] == ids
        rough[self_row] = -np.inf
        depth = min(max(rerank, k), len(ids))
        take = np.argsort(-rough, axis=1, kind="stable")[:, :depth]
        exact = np.stack([(x[t] * v).sum(axis=1) for t, v in zip(take, part)])
        bar = np.partition(exact, max(depth - k, 0), axis=1)[:, max(depth - k, 0)] if depth >= k else np.full(len(part), -np.inf)
        slack = (SLACK * np.sqrt((part * part).sum(axis=1) / x.shape[1])).astype(np.float32)[:, None] * error
        more = rough + slack >= bar[:, None]
        np.put_along_axis(more, take, True, axis=1)
        more &= ~self_row
        row, at = np.nonzero(more)
        score = np.concatenate([(x[at[i : i + 65536]] * part[row[i : i + 65536]]).sum(axis=1) for i in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
        best = np.lexsort((at, -score, row))
        row, at, score = row[best], at[best], score[best]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        out.append((own[row[keep]], ids[at[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (ids[:0], ids[:0], np.zeros(0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    v = v.filter(finite & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return v.filter(F.size("v") == (sizes[0]["n"] if sizes else 0))


def search(vectors: DataFrame, is_query, k: int = K, max_fit: int = MAX_FIT, rerank: int = RERANK, target: float = TARGET, subspaces: int = SUBSPACES, cell: int = CELL) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query row (is_query: a condition on vec_id)."""
    spark = vectors.sparkSession
    shape = "query_id bigint, rank int, vec_id bigint, score double"
    v = valid(vectors)
    total = v.count()
    if not total:
        return spark.createDataFrame([], shape)
    h = F.pmod(F.xxhash64(F.lit("ann"), F.col("vec_id")), F.lit(1 << 30))
    sample = v.filter(h <= int(min(1.0, 1.3 * max_fit / total) * (1 << 30))).select("v", h.alias("h"), "vec_id").orderBy("h", "vec_id", "v").limit(max_fit).toArrow()
    x = np.array(sample.column("v").to_pylist(), np.float64)
    dim = x.shape[1]
    index = Index(x, total, subspaces, target, k)
    held = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            near, codes, error = held.value.codes(x)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(error)], ["list", "vec_id", "v", "codes", "error"])

    coded = written(v.mapInArrow(lean(assign), "list int, vec_id bigint, v binary, codes binary, error float"), "ann-lists")

    def per_list(df: DataFrame) -> np.ndarray:
        out = np.zeros(len(index.centre), np.int64)
        for row in df.groupBy("list").count().collect():  # one row for each list
            out[row["list"]] = row["count"]
        return out

    sizes = per_list(coded)

    def visit(batches):
        own = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = own.lists(_matrix(batch.column("v"), dim), sizes, k + 1)
            times = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), batch.column("query_id").take(times), batch.column("v").take(times)], ["list", "query_id", "v"])

    queries = coded.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    visits = queries.mapInArrow(lean(visit), "list int, query_id bigint, v binary")
    parts, blocks = (-(-np.maximum(n, 1) // cell) for n in (sizes, per_list(visits)))

    def of_list(n: np.ndarray):
        return F.element_at(F.array(*[F.lit(int(i)) for i in n]), F.col("list") + 1)

    def each(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    left = coded.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), of_list(parts)).cast("int")).select("*", each(of_list(blocks)).alias("block"))
    right = visits.withColumn("block", F.pmod(F.xxhash64("query_id"), of_list(blocks)).cast("int")).select("*", each(of_list(parts)).alias("part"))

    def run(vectors: pa.Table, asks: pa.Table) -> pa.Table:
        if vectors.num_rows and asks.num_rows:
            codes = np.frombuffer(b"".join(vectors.column("codes").to_pylist()), np.uint8).reshape(vectors.num_rows, -1)
            found = search_cell(held.value, vectors.column("vec_id").to_numpy(), _matrix(vectors.column("v"), dim), codes, vectors.column("error").to_numpy(), vectors.column("list")[0].as_py(), asks.column("query_id").to_numpy(), _matrix(asks.column("v"), dim), k, rerank)
        else:
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    found = left.groupBy("list", "part", "block").cogroup(right.groupBy("list", "part", "block")).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ivf_pq_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
