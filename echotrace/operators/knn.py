"""Exact nearest neighbours by blocked matrix products, and the relations built on them.

Rows are dealt into blocks of bounded size by a hash of their id; every pair of blocks is
one cell, in which one matrix product and a partial selection leave at most k rows for
each query.  Only those rows are shuffled again; the global top k is their merge, so the
result is exact.  Similarities are compared at six decimals, ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings


def matrix(column) -> np.ndarray:
    """A column of equally long lists as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


#: Columns of a product whose largest value stands for them all in the first selection.
GROUP = 16


def best(y: np.ndarray, x: np.ndarray, k: int, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, similarity) of the k rows of x with the largest rounded inner product for each row of y.

    Earlier rows of x win ties.  One single-precision product finds all that could be among
    the best, by the error bound of such a product; those are multiplied again in double.
    The k-th largest of the largest values of groups of columns is a bar that no neighbour is under.
    barred marks pairs that do not count.
    """
    n, n_groups = len(x), -(-len(x) // GROUP)
    rough = np.empty((len(y), GROUP * n_groups), np.float32)
    np.matmul(y.astype(np.float32), x.astype(np.float32).T, out=rough[:, :n])
    rough[:, n:] = -np.inf
    if barred is not None:
        rough[:, :n][barred] = -np.inf
    length = lambda v: np.sqrt((v * v).sum(axis=1))
    slack = (x.shape[1] * 2.0**-22 * length(y) * length(x).max(initial=0) + 2e-6).astype(np.float32)
    # k groups reach the bar, so k rows do; only groups that come near it are looked into
    tops = np.fmax.reduce(rough.reshape(len(y), GROUP, n_groups), axis=1)
    bar = (np.partition(tops, n_groups - k, axis=1)[:, n_groups - k] if n_groups > k else np.full(len(y), -np.inf, np.float32)) - slack
    row, group = np.nonzero((tops >= bar[:, None]) & (tops > -np.inf))
    col = group[:, None] + n_groups * np.arange(GROUP)
    found = rough[row[:, None], col]
    at, nth = np.nonzero((found >= bar[row, None]) & (found > -np.inf))
    row, col = row[at], col[at, nth]
    sims = np.concatenate([np.einsum("ij,ij->i", y[row[i : i + 65536]], x[col[i : i + 65536]]) for i in range(0, len(row), 65536)]) if len(row) else np.zeros(0)
    sims = np.round(sims, 6) + 0.0
    order = np.lexsort((col, -sims, row))
    row, col, sims = row[order], col[order], sims[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep], sims[keep]


#: Bytes of one side of a cell as doubles.
BLOCK_BYTES = 64 << 20


def block_count(rows: int, dim: int, cores: int, block_rows: int | None) -> int:
    """Into how many blocks to deal rows: each side is sent once for every block of the other, so few and large ones.

    Tables too small to fill the cores with such blocks are dealt into smaller ones.
    """
    if block_rows is not None:
        return max(1, -(-rows // block_rows))
    large = -(-rows * dim * 8 // BLOCK_BYTES)
    return max(1, large, min(math.ceil(math.sqrt(2 * cores)), -(-rows // 1024)))


def topk(queries: DataFrame, corpus: DataFrame, k: int, block_rows: int | None = None, exclude_same_video: bool = False) -> DataFrame:
    """(src, tgt, sim, rank): the k corpus rows with the largest inner product of every query row.

    Both need frame_id and embedding (and video_id for exclude_same_video); a frame that is
    in both finds itself.  With fewer than k corpus rows there are fewer neighbours.
    """
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    shapes = [df.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first() for df in (queries, corpus)]
    n_q, n_c = (block_count(n, dim, cores, block_rows) for n, dim in shapes)
    cols = ["frame_id", "embedding", *["video_id"] * exclude_same_video]
    block = lambda n: F.pmod(F.xxhash64("frame_id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(*cols, block(n_q).alias("qb"), spread(n_c).alias("cb"))
    right = corpus.select(*[F.col(c).alias(c) for c in cols], block(n_c).alias("cb"), spread(n_q).alias("qb"))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        empty = {"src": pa.array([], pa.int64()), "tgt": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())}
        if not q.num_rows or not c.num_rows:
            return pa.table(empty)
        order = np.argsort(c.column("frame_id").to_numpy(), kind="stable")
        ids, x, src, y = c.column("frame_id").to_numpy()[order], matrix(c.column("embedding"))[order], q.column("frame_id").to_numpy(), matrix(q.column("embedding"))
        own, other = (q.column("video_id").to_numpy(), c.column("video_id").to_numpy()[order]) if exclude_same_video else (None, None)
        out, step = [], max(1, min(1024, (1 << 23) // len(x)))
        for lo in range(0, len(y), step):
            row, col, sims = best(y[lo : lo + step], x, k, own[lo : lo + step, None] == other if exclude_same_video else None)
            out.append((src[lo + row], ids[col], sims))
        a, b, s = (np.concatenate(z) for z in zip(*out))
        return pa.table({"src": pa.array(a, pa.int64()), "tgt": pa.array(b, pa.int64()), "sim": pa.array(s)})

    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(cell, "src bigint, tgt bigint, sim double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "tgt"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "tgt", "sim", "rank")


def self_topk(frames: DataFrame, s: Settings) -> DataFrame:
    """The knn + 1 neighbours of every frame, itself included."""
    return topk(frames, frames, s.knn + 1, s.block_rows, s.exclude_same_video)


def located(knn: DataFrame, frames: DataFrame) -> DataFrame:
    """knn with the video, time and mirror flag of both ends (sv, sts, sm, tv, tts, tm)."""
    end = lambda p, key: frames.select(F.col("frame_id").alias(key), F.col("video_id").alias(f"{p}v"), F.col("ts").cast("double").alias(f"{p}ts"), F.col("mirrored").cast("int").alias(f"{p}m"))
    return knn.join(end("s", "src"), "src").join(end("t", "tgt"), "tgt")


def foreign(located_knn: DataFrame) -> DataFrame:
    """Neighbours other than the frame itself, in another video."""
    return located_knn.filter("src <> tgt AND sv <> tv")


def mutual(knn: DataFrame) -> DataFrame:
    """Rows (i, j) for which (j, i) is there too; a frame is no neighbour of its own."""
    back = knn.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    return knn.filter("src <> tgt").join(back, ["src", "tgt"], "left_semi")


def generic_frames(foreign_knn: DataFrame, max_videos: int) -> DataFrame:
    """(src, n_videos) of frames that resemble more than max_videos other videos: logos, intros. None if max_videos <= 0."""
    seen = foreign_knn.groupBy("src").agg(F.countDistinct("tv").alias("n_videos"))
    return seen.filter(F.col("n_videos") > max_videos) if max_videos > 0 else seen.filter("false")


def without_generic(knn: DataFrame, generic: DataFrame) -> DataFrame:
    """knn without rows of which either end is generic."""
    bad = generic.select("src")
    return knn.join(bad, "src", "left_anti").join(bad.withColumnRenamed("src", "tgt"), "tgt", "left_anti")


def candidate_pairs(foreign_knn: DataFrame, min_matches: int) -> DataFrame:
    """(a, b, n_matches), a < b: pairs of videos with at least that many directed neighbour matches."""
    return foreign_knn.groupBy(F.least("sv", "tv").alias("a"), F.greatest("sv", "tv").alias("b")).agg(F.count("*").alias("n_matches")).filter(F.col("n_matches") >= min_matches)


def match_cloud(foreign_knn: DataFrame, min_sim: float) -> DataFrame:
    """(a, b, ta, tb, sim, mirror) of every match of at least that similarity, oriented to a < b."""
    ordered = F.col("sv") < F.col("tv")
    return foreign_knn.filter(F.col("sim") >= min_sim).select(
        F.least("sv", "tv").alias("a"),
        F.greatest("sv", "tv").alias("b"),
        F.when(ordered, F.col("sts")).otherwise(F.col("tts")).alias("ta"),
        F.when(ordered, F.col("tts")).otherwise(F.col("sts")).alias("tb"),
        "sim",
        F.col("sm").bitwiseXOR(F.col("tm")).alias("mirror"),
        "src",
        "tgt",
    )


def crowded(cloud: DataFrame, least: int, keys: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """(keys, n_points) of pairs with at least that many points."""
    return cloud.groupBy(*keys).agg(F.count("*").alias("n_points")).filter(F.col("n_points") >= least)
