"""Frame sources: a Python data source of drawn test footage, frame embedding, and text windows as frames.

A decoder for real files plugs in where ``drawn`` stands: one input partition for each
file, rows (video_id, ts, pixels).  Frames of too little contrast are left out inside the
source, before they become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import unit

#: Channel means and deviations that image models expect.
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


class DrawnVideos(DataSource):
    """Footage drawn from seeds, one partition for each video.

    Options: videos, seconds, fps, size, min_std, and mode: uniform (every frame; ts = n /
    fps, counted before the contrast filter) or keyframes (every keyevery-th frame at its
    true time, at most max_frames).
    """

    @classmethod
    def name(cls) -> str:
        return "drawnvideos"

    def schema(self) -> str:
        return "video_id int, ts double, pixels binary"

    def reader(self, schema) -> DataSourceReader:
        return _DrawnReader(self.options)


class _Video(InputPartition):
    def __init__(self, video_id: int):
        self.video_id = video_id


class _DrawnReader(DataSourceReader):
    def __init__(self, options):
        get = lambda k, d: type(d)(options.get(k, d))
        self.videos, self.seconds, self.fps, self.size = get("videos", 2), get("seconds", 10.0), get("fps", 2.0), get("size", 16)
        self.min_std, self.mode, self.every, self.most = get("min_std", 18.0), get("mode", "uniform"), get("keyevery", 4), get("max_frames", 648_000)

    def partitions(self):
        return [_Video(i) for i in range(self.videos)]

    def read(self, partition) -> Iterator[tuple]:
        rng, kept = np.random.default_rng(partition.video_id), 0
        for n in range(int(self.seconds * self.fps)):
            image = rng.integers(0, 256, (self.size, self.size, 3), np.uint8) if n % 10 else np.full((self.size, self.size, 3), 7, np.uint8)
            if self.mode == "keyframes" and n % self.every:
                continue
            if image.std() >= self.min_std:
                kept += 1
                if kept > self.most:
                    raise ValueError("too many keyframes")
                yield partition.video_id, n / self.fps, image.tobytes()


def drawn(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(DrawnVideos)
    reader = spark.read.format("drawnvideos")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


class Extractor(Protocol):
    """What turns images (n, size, size, 3) of bytes into n vectors."""

    name: str
    dim: int

    def encode(self, images: np.ndarray) -> np.ndarray: ...


def normalised(images: np.ndarray) -> np.ndarray:
    """Bytes (n, h, w, 3) to floats (n, 3, h, w), less the channel means, over the channel deviations."""
    return ((images.astype(np.float32) / 255 - np.float32(CHANNEL_MEAN)) / np.float32(CHANNEL_STD)).transpose(0, 3, 1, 2)


class ProjectionExtractor:
    """A fixed random projection of the pixels: no trained weights, but equal images get equal vectors."""

    def __init__(self, size: int, dim: int = 64, seed: int = 0):
        self.name, self.dim = f"projection-{dim}", dim
        self._w = np.random.default_rng(seed).standard_normal((size * size * 3, dim)).astype(np.float32)

    def encode(self, images: np.ndarray) -> np.ndarray:
        x = normalised(images).reshape(len(images), -1) @ self._w
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def embedded(frames: DataFrame, make: Callable[[], Extractor], size: int, batch: int = 64, mirror: bool = True) -> DataFrame:
    """(video_id, ts, mirrored, embedding) of every frame, and of its mirror image.

    One extractor serves a task; frames go through it in batches.
    """

    def run(batches):
        extractor = make()
        for rows in batches:
            for lo in range(0, rows.num_rows, batch):
                part = rows.slice(lo, batch)
                images = np.stack([np.frombuffer(x, np.uint8).reshape(size, size, 3) for x in part.column("pixels").to_pylist()])
                for flag, seen in ((0, images), (1, images[:, :, ::-1]))[: 1 + mirror]:
                    vectors = extractor.encode(np.ascontiguousarray(seen)).astype(np.float32)
                    if vectors.shape != (len(images), extractor.dim):
                        raise ValueError(f"{extractor.name} gave vectors of shape {vectors.shape}")
                    column = pa.ListArray.from_arrays(pa.array(np.arange(len(images) + 1, dtype=np.int32) * extractor.dim), pa.array(vectors.ravel()))
                    yield pa.RecordBatch.from_arrays([part.column("video_id"), part.column("ts"), pa.array([flag] * len(images), pa.int8()), column], ["video_id", "ts", "mirrored", "embedding"])

    return frames.select("video_id", "ts", "pixels").mapInArrow(run, "video_id int, ts double, mirrored tinyint, embedding array<float>")


def text_frames(docs: DataFrame, size: int = 16, stride: int = 8, dim: int = 256) -> DataFrame:
    """Windows of words as frames: (frame_id, video_id, ts, mirrored, embedding) with hashed bigram counts of unit length.

    video_id is the doc_id, ts the window's number; frame_id = doc_id * 2**24 + ts.
    """
    words = F.split(F.lower(F.trim("text")), r"\s+")
    rows = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", words.alias("w")).filter(F.size("w") >= 2)
    last = F.greatest(F.size("w") - size, F.lit(0))
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), last, F.lit(stride))).alias("at"))
    window = F.slice("w", F.col("at") + 1, F.lit(size))
    rows = rows.select("doc_id", (F.col("at") / stride).cast("bigint").alias("ts"), window.alias("win"))
    bucket = F.transform(F.sequence(F.lit(1), F.size("win") - 1), lambda i: F.xxhash64(F.element_at("win", i), F.element_at("win", i + 1)))
    rows = rows.filter(F.size("win") >= 2).select("doc_id", "ts", F.explode(bucket).alias("h"))
    counts = rows.groupBy("doc_id", "ts", F.pmod("h", F.lit(dim)).cast("int").alias("k")).agg(F.sum(F.when(F.col("h") >= 0, 1.0).otherwise(-1.0)).alias("c"))
    maps = counts.groupBy("doc_id", "ts").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    vectors = maps.select("doc_id", "ts", dense.alias("v")).filter(F.exists("v", lambda x: x != 0))
    return vectors.select((F.col("doc_id") * (1 << 24) + F.col("ts")).alias("frame_id"), F.col("doc_id").cast("int").alias("video_id"), F.col("ts").cast("double").alias("ts"), F.lit(0).alias("mirrored"), unit("v").cast("array<float>").alias("embedding"))
