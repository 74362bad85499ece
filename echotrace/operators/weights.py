"""Frame weights: redundancy within the own video, and rarity across the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip_power
from .knn import matrix


def self_redundancy(frames: DataFrame, p: float, block_rows: int | None = None) -> DataFrame:
    """(frame_id, rho): the sum of max(0, sim)**p over all frames of the own video, itself included.

    A video of more than block_rows frames (8,192 if None) is split into blocks, and each pair
    of blocks is a cell that sends one partial sum for each of its frames.
    """
    block_rows = block_rows or 8192
    blocks = frames.groupBy("video_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))
    rows = frames.join(blocks, "video_id").select("video_id", "frame_id", "embedding", "n", F.pmod(F.xxhash64("frame_id"), "n").cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    left = rows.select("video_id", "frame_id", "embedding", F.col("own").alias("i"), other.alias("j"))
    right = rows.select(F.col("video_id").alias("video_id"), F.col("embedding").alias("embedding"), F.col("own").alias("j"), other.alias("i"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"frame_id": pa.array([], pa.int64()), "part": pa.array([], pa.float64())})
        x, y = matrix(a.column("embedding")), matrix(b.column("embedding"))
        total = np.concatenate([(np.clip(x[i : i + 512] @ y.T, 0, 1) ** p).sum(axis=1) for i in range(0, len(x), 512)])
        return pa.table({"frame_id": a.column("frame_id").cast(pa.int64()), "part": pa.array(total)})

    parts = left.groupBy("video_id", "i", "j").cogroup(right.groupBy("video_id", "i", "j")).applyInArrow(cell, "frame_id bigint, part double")
    return parts.groupBy("frame_id").agg(F.sum("part").alias("rho"))


def document_frequency(frames: DataFrame, located_knn: DataFrame, p: float) -> DataFrame:
    """(frame_id, df): over other videos among the neighbours, the sum of each video's best max(0, sim)**p; 0 without any."""
    best = located_knn.filter("sv <> tv").groupBy("src", "tv").agg(F.max(clip_power("sim", p)).alias("best"))
    found = best.groupBy("src").agg(F.sum("best").alias("df"))
    return frames.select("frame_id").join(found.withColumnRenamed("src", "frame_id"), "frame_id", "left").select("frame_id", F.coalesce("df", F.lit(0.0)).alias("df"))


def inverse_frequency(df: DataFrame, n_videos: int) -> DataFrame:
    """(frame_id, idf): ln((videos + 1) / (df + 1))."""
    return df.select("frame_id", F.log((n_videos + 1.0) / (F.col("df") + 1.0)).alias("idf"))


def weight_summary(weights: DataFrame) -> DataFrame:
    """One row: frames, medians and maxima of rho and idf."""
    return weights.agg(F.count("*").alias("frames"), F.percentile("rho", 0.5).alias("rho_median"), F.max("rho").alias("rho_max"), F.percentile("idf", 0.5).alias("idf_median"), F.max("idf").alias("idf_max"))
