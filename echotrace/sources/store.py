"""The persistent store: Parquet tables of videos' status and of frames with their vectors.

The catalog is an append-only log (one row for each change; the last one of a path
counts, so a retry replaces what failed), frames are partitioned by a bucket of video_id, and vectors live in the frames'
rows, so there are no two files to keep in step.  Searches see frames of complete videos.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import ingest
from ..schemas import FRAMES, STATUSES, VIDEOS

BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, root: str, dim: int | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        known = self.meta("dim")
        if dim is not None and known is not None and int(known) != dim:
            raise ValueError(f"the store holds vectors of {known} components, not {dim}")
        if dim is not None and known is None:
            self.put_meta("dim", str(dim))

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    # key and value pairs: the last value counts
    def meta(self, key: str) -> str | None:
        row = self._read("meta", "key string, value string, seq bigint").filter(F.col("key") == key).agg(F.max_by("value", "seq").alias("v")).first()
        return row["v"]

    def put_meta(self, key: str, value: str) -> None:
        self.spark.createDataFrame([(key, value, time.time_ns())], "key string, value string, seq bigint").write.mode("append").parquet(f"{self.root}/meta")

    @property
    def dim(self) -> int | None:
        found = self.meta("dim")
        return None if found is None else int(found)

    # catalog
    def log(self) -> DataFrame:
        return self._read("log", f"{VIDEOS}, seq bigint")

    def videos(self) -> DataFrame:
        """The current row of every path, ordered by id."""
        rows = self.log()
        last = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), F.struct("seq", "video_id")).alias("r"))
        return last.select("path", "r.*").select(*[c for c in rows.columns if c != "seq"]).orderBy("video_id")

    def known_hashes(self) -> DataFrame:
        """(sha1) of all videos in the catalog, once each."""
        return self.videos().filter("sha1 IS NOT NULL").select("sha1").distinct()

    def add_videos(self, incoming: DataFrame) -> DataFrame:
        """Gives ids to incoming (path, sha1, duration, width, height) rows and logs them as pending; complete ones keep id and status."""
        current = self.videos()
        rows = ingest.with_ids(incoming, current)
        done = current.filter("status = 'complete'").select("video_id")
        fresh = rows.join(done, "video_id", "left_anti").select("video_id", "path", "sha1", "duration", "width", "height", F.lit(0).alias("n_frames"), F.lit("pending").alias("status"), F.current_timestamp().alias("added_at"), F.lit(time.time_ns()).alias("seq"))
        fresh.write.mode("append").parquet(f"{self.root}/log")
        return self.videos().join(incoming.select("path").distinct(), "path", "left_semi")

    def mark(self, ids: DataFrame, status: str) -> None:
        """Logs a new status for the given video_ids."""
        if status not in STATUSES:
            raise ValueError(f"unknown status {status}")
        rows = self.videos().join(ids.select("video_id").distinct(), "video_id", "left_semi")
        if status == "complete":
            rows = rows.drop("n_frames").join(ingest.frame_counts(self.frames(complete=False)), "video_id", "left").withColumn("n_frames", F.coalesce("n_frames", F.lit(0)).cast("int"))
        names = [f.split()[0] for f in VIDEOS.split(", ")]
        rows.withColumn("status", F.lit(status)).select(*names, F.lit(time.time_ns()).alias("seq")).write.mode("append").parquet(f"{self.root}/log")

    # frames
    def add_frames(self, frames: DataFrame) -> None:
        """Appends (video_id, ts, mirrored, embedding) rows; the first write fixes the width of vectors, and others fail."""
        dim = self.dim
        if dim is None:
            row = frames.select(F.size("embedding").alias("n")).first()
            if row is None:
                return
            dim = row["n"]
            self.put_meta("dim", str(dim))
        checked = frames.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors must have {dim} components")).cast("array<float>")))
        # unique by video, time and mirror flag: independent of how rows are dealt out
        frame_id = F.col("video_id").cast("bigint") * F.lit(1 << 32) + F.floor(F.col("ts").cast("double") * 1000).cast("bigint") * 2 + F.col("mirrored").cast("bigint")
        out = checked.select(frame_id.alias("frame_id"), F.col("video_id").cast("int"), F.col("ts").cast("float"), F.col("mirrored").cast("tinyint"), F.col("embedding").cast("array<float>"), F.pmod("video_id", F.lit(self.buckets)).alias("bucket"))
        out.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.root}/frames")

    def frames(self, complete: bool = True) -> DataFrame:
        rows = self._read("frames", f"{FRAMES}, bucket int")
        if complete:  # by bucket too, so that buckets without a complete video are not read
            done = self.videos().filter("status = 'complete'").select("video_id", F.pmod("video_id", F.lit(self.buckets)).alias("bucket"))
            rows = rows.join(done, ["bucket", "video_id"], "left_semi")
        return rows.drop("bucket")

    def frames_in(self, buckets: list[int]) -> DataFrame:
        """The frames of some buckets, complete or not; other buckets' files are not read."""
        return self._read("frames", f"{FRAMES}, bucket int").filter(F.col("bucket").isin(buckets)).drop("bucket")

    def vectors(self, ids: DataFrame) -> DataFrame:
        """(frame_id, embedding) of the given frame_ids."""
        return self.frames(complete=False).join(ids.select("frame_id"), "frame_id", "left_semi").select("frame_id", "embedding")

    def n_vectors(self) -> int:
        return self.frames(complete=False).count()

    # derived weights, kept for one exponent, neighbour count and state of the store
    def weights(self, p: float, k: int, make, force: bool = False) -> DataFrame:
        shape = self.frames().agg(F.count("*"), F.sum(F.hash("frame_id").cast("bigint"))).first()
        key = f"weights p={round(p, 6)} k={k} {shape[0]} {shape[1]}"
        path = self.meta(key)
        if force or path is None:
            path = f"{self.root}/weights/{uuid.uuid4().hex}"
            make(self.frames()).write.parquet(path)
            self.put_meta(key, path)
        return self.spark.read.parquet(path)

    def reset(self) -> None:
        """Deletes all tables."""
        jvm = self.spark.sparkContext._jvm
        for table in ("meta", "log", "frames", "weights"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
