"""The engine: index, scan, find, status and reset over one store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import ingest
from .plans import report, search
from .sources import decoder as decoding
from .sources import files
from .sources.decoder import Decoder
from .sources.frames import Extractor, embedded
from .sources.store import Store


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.settings, self.store = spark, settings or Settings(), Store(spark, root)

    def index(self, incoming: DataFrame, frames_of) -> DataFrame:
        """Adds videos (path, sha1, duration, width, height) that are not settled yet; returns their rows.

        frames_of(rows of the catalog) gives (video_id, ts, mirrored, embedding) and, where a
        video cannot be used, a row with a null embedding; such videos are marked failed, or
        rejected (and not tried again) if the row has a column problem that says so.  The
        others are complete, even without a frame.
        """
        new = ingest.unsettled(incoming, self.store.videos()).persist()
        rows = self.store.add_videos(new).persist()
        frames = frames_of(rows).persist()
        problem = F.col("problem") if "problem" in frames.columns else F.lit("failed")
        bad = frames.filter("embedding IS NULL").groupBy("video_id").agg(F.max(F.coalesce(problem, F.lit("failed"))).alias("problem"))
        self.store.add_frames(frames.filter("embedding IS NOT NULL").join(bad, "video_id", "left_anti").drop("problem"))
        for status in ("failed", "rejected"):
            self.store.mark(bad.filter(F.col("problem") == status).select("video_id"), status)
        self.store.mark(rows.filter("status = 'pending'").select("video_id").join(bad, "video_id", "left_anti"), "complete")
        out = self.store.videos().join(rows.select("video_id"), "video_id", "left_semi")
        for df in (new, rows, frames):
            df.unpersist()
        return out

    def index_paths(self, paths: list[str], decoder: Decoder, make: Callable[[], Extractor]) -> DataFrame:
        """Finds, fingerprints, probes, decodes and indexes the videos under the paths that are not settled yet; returns their rows.

        Known paths are left out before anything of a file is read; files without a video
        stream, or that cannot be read, are left out of the catalog.
        """
        fresh = ingest.unsettled_by_path(files.discover(self.spark, paths).select("path"), self.store.videos())
        hashed = files.fingerprints(fresh).filter("error IS NULL").drop("error")
        seen = decoding.probe(ingest.unsettled(hashed, self.store.videos()), decoder).filter("error IS NULL").select("path", "duration", "width", "height")
        s = self.settings

        def frames_of(rows: DataFrame) -> DataFrame:
            made = decoding.decoded(rows.filter("status = 'pending'"), decoder).persist()
            good = embedded(made.filter("pixels IS NOT NULL"), make, decoder.size, s.batch_size, s.mirror).withColumn("problem", F.lit(None).cast("string"))
            bad = made.filter("pixels IS NULL").select("video_id", "ts", F.lit(0).cast("tinyint").alias("mirrored"), F.lit(None).cast("array<float>").alias("embedding"), "problem")
            return good.unionByName(bad)

        return self.index(hashed.join(seen, "path").select("path", "sha1", "duration", "width", "height"), frames_of)

    def query_frames(self, path: str, decoder: Decoder, make: Callable[[], Extractor]) -> DataFrame:
        """(frame_id, ts, mirrored, embedding) of one file, as ``find`` takes them."""
        one = decoding.probe(self.spark.createDataFrame([(path,)], "path string"), decoder).select(F.lit(-1).alias("video_id"), "path", "duration", "width", "height")
        rows = embedded(decoding.decoded(one, decoder).filter("pixels IS NOT NULL"), make, decoder.size, self.settings.batch_size, self.settings.mirror)
        return rows.withColumn("frame_id", -1 - (F.floor(F.col("ts") * 1000) * 2 + F.col("mirrored")).cast("bigint"))

    def scan(self, robust: bool = False) -> DataFrame:
        """Ranked segments of all pairs of indexed videos; robust takes sampled-consensus lines instead of line votes."""
        frames = self.store.frames()
        found = search.robust_segments(frames, self.settings) if robust else search.smooth_segments(frames, self.settings)
        return report.with_paths(report.ranked(found), self.store.videos()).orderBy("rank", F.desc(F.col("score") * report.duration()))

    def find(self, query: DataFrame, path: str) -> DataFrame:
        """Ranked segments of one query video's frames (frame_id, ts, mirrored, embedding) in the indexed videos."""
        if self.store.n_vectors() == 0:
            raise LookupError("the index is empty")
        found = search.find_segments(query, self.store.frames(), self.settings)
        return report.with_paths(report.ranked(found), self.store.videos(), path).orderBy("rank", "nth")

    def weights(self, force: bool = False) -> DataFrame:
        s = self.settings
        return self.store.weights(s.smooth_p, s.idf_k, lambda frames: search.frame_weights(frames, s), force)

    def status(self) -> DataFrame:
        return report.status(self.store.videos(), self.store.frames(complete=False))

    def reset(self) -> None:
        self.store.reset()
