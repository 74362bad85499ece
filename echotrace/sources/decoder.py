"""Footage of real files by the ffmpeg tools on the workers: probe reports, crops, and frames.

Each step is one map over a table of videos, one file at a time in a task, so retries and
placement are Spark's: probe, then crop detection (relations over the tool's log), then
frames.  A file that cannot be used gives one row that says why, in place of frames.
"""

from __future__ import annotations

import re
import subprocess
import threading
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import ingest
from .files import local_path, probed

DECODED = "video_id int, ts double, pixels binary, problem string"
_TIME = re.compile(rb"pts_time:\s*([\-\d.eE+]+)")
#: Seconds between two frames that have no time of their own.
NO_TIME_STEP = 2.0


@dataclass(frozen=True)
class Decoder:
    """What to run, and how frames are taken: at fps, or keyframes at their own times."""

    size: int = 224
    fps: float = 2.0
    keyframes: bool = False
    min_std: float = 18.0
    crop: bool = True
    crop_seconds: float = 30.0
    ffprobe: tuple[str, ...] = ("ffprobe",)
    ffmpeg: tuple[str, ...] = ("ffmpeg",)

    def probe_command(self, path: str) -> list[str]:
        return [*self.ffprobe, "-v", "error", "-print_format", "json", "-show_streams", "-show_format", "-select_streams", "v:0", path]

    def crop_command(self, path: str) -> list[str]:
        within = [] if self.keyframes else ["-t", str(self.crop_seconds)]
        return [*self.ffmpeg, "-hide_banner", "-nostats", "-skip_frame", "nokey", *within, "-i", path, "-vf", "cropdetect=24:16:0", "-f", "null", "-"]

    def frame_command(self, path: str, crop: str | None) -> list[str]:
        fit = [f"scale={self.size}:{self.size}:force_original_aspect_ratio=decrease", f"pad={self.size}:{self.size}:(ow-iw)/2:(oh-ih)/2:color=black"]
        # decoders that ignore -skip_frame are filtered again by the type of the picture; showinfo logs each frame's time
        rate = ["select=eq(pict_type\\,I)", "showinfo"] if self.keyframes else [f"fps={self.fps}"]
        chain = ",".join([*([crop] if crop else []), *rate, *fit])
        head = ["-skip_frame", "nokey", "-i", path, "-vsync", "0"] if self.keyframes else ["-i", path]
        return [*self.ffmpeg, "-hide_banner", "-nostats", *head, "-vf", chain, "-f", "rawvideo", "-pix_fmt", "rgb24", "-"]


def probe(paths: DataFrame, decoder: Decoder) -> DataFrame:
    """(path, duration, width, height, fps, error) of each path; where the prober fails, the error is that there is no video stream."""

    def report(path: str) -> str:
        try:
            done = subprocess.run(decoder.probe_command(local_path(path)), capture_output=True, check=True)
            return done.stdout.decode(errors="replace")
        except (OSError, subprocess.CalledProcessError):
            return "{}"

    def run(batches):
        for batch in batches:
            found = [report(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.string())], ["path", "report"])

    return probed(paths.select("path").mapInArrow(run, "path string, report string"))


def crops(videos: DataFrame, decoder: Decoder) -> DataFrame:
    """(video_id, crop) of videos (video_id, path, width, height) whose picture has a border.

    Keyframes: the median of all detections over half the picture, if it is smaller by more
    than the tolerance.  Frames at a rate: the last detection of the first seconds.
    """

    def log(path: str) -> str:
        try:
            return subprocess.run(decoder.crop_command(local_path(path)), capture_output=True, timeout=None if decoder.keyframes else 60).stderr.decode(errors="replace")
        except (OSError, subprocess.TimeoutExpired):
            return ""

    def run(batches):
        for batch in batches:
            logs = pa.array([log(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("video_id", "width", "height")), logs], ["video_id", "src_w", "src_h", "log"])

    logs = videos.select(F.col("video_id").cast("int").alias("video_id"), "path", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).mapInArrow(run, "video_id int, src_w int, src_h int, log string")
    found = logs.select("video_id", "src_w", "src_h", F.posexplode(scalar.crops_of("log")).alias("seq", "c")).select("video_id", "src_w", "src_h", "seq", F.lit(0.0).alias("ts"), "c.*")
    if decoder.keyframes:
        sizes = found.select("video_id", "src_w", "src_h").distinct()
        best = ingest.robust_crop(found).join(sizes, "video_id").filter(scalar.significant_crop("w", "h", "src_w", "src_h"))
    else:
        best = ingest.last_crop(found)
    return best.select("video_id", F.format_string("crop=%d:%d:%d:%d", "w", "h", "x", "y").alias("crop"))


def frames_of_file(path: str, crop: str | None, budget: int, decoder: Decoder) -> Iterator[tuple[float, bytes]]:
    """(ts, pixels) of the frames with enough contrast; times count all frames. Raises OverflowError beyond the budget of keyframes, OSError if nothing can be read."""
    times: list[float] = []
    told = threading.Condition()
    log: list[bytes] = []

    def listen(stream) -> None:
        for line in stream:
            found = _TIME.search(line)
            with told:
                if found:
                    times.append(float(found[1]))
                else:
                    log[:] = [*log[-20:], line]
                told.notify()
        with told:
            times.append(float("nan"))  # no more will come
            told.notify()

    size, n = decoder.size * decoder.size * 3, 0
    with subprocess.Popen(decoder.frame_command(local_path(path), crop), stdout=subprocess.PIPE, stderr=subprocess.PIPE) as tool:
        listener = threading.Thread(target=listen, args=(tool.stderr,), daemon=True)
        listener.start()
        try:
            while len(pixels := tool.stdout.read(size)) == size:
                if decoder.keyframes:
                    if n >= budget:
                        raise OverflowError(f"more than {budget} keyframes")
                    with told:  # a frame's time is logged before the frame is scaled and written
                        told.wait_for(lambda: len(times) > n or (times and times[-1] != times[-1]), timeout=5)
                        own = times[n] if len(times) > n and times[n] == times[n] else None
                    ts = n * NO_TIME_STEP if own is None else own
                else:
                    ts = n / decoder.fps
                n += 1
                if np.frombuffer(pixels, np.uint8).std() >= decoder.min_std:
                    yield ts, pixels
        finally:
            tool.kill() if tool.poll() is None and n > budget - 1 else None
            tool.stdout.close()
        listener.join(timeout=5)
        if tool.wait() and not n:
            raise OSError(b"".join(log).decode(errors="replace").strip() or "nothing decoded")


def decoded(videos: DataFrame, decoder: Decoder) -> DataFrame:
    """DECODED of videos (video_id, path, duration, width, height): frames, or a row with a problem ("failed", "rejected") and no pixels.

    Crops are decided before any frame is decoded, so no frame is made twice.
    """
    rows = videos.select(F.col("video_id").cast("int").alias("video_id"), "path", scalar.keyframe_budget("duration").alias("budget"), "width", "height")
    if decoder.crop:
        rows = rows.join(crops(videos, decoder), "video_id", "left")
    else:
        rows = rows.withColumn("crop", F.lit(None).cast("string"))

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.float64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["video_id", "ts", "pixels", "problem"])

    def run(batches):
        for batch in batches:
            for video, path, budget, crop in zip(*(batch.column(c).to_pylist() for c in ("video_id", "path", "budget", "crop"))):
                out = []
                try:
                    for ts, pixels in frames_of_file(path, crop, budget, decoder):
                        out.append((video, ts, pixels, None))
                        if len(out) == 64:
                            yield batch_of(out)
                            out = []
                except OverflowError:
                    out.append((video, None, None, "rejected"))
                except OSError:
                    out.append((video, None, None, "failed"))
                if out:
                    yield batch_of(out)

    # one file is minutes of work: a file to a task, not a block of rows
    return rows.select("video_id", "path", "budget", "crop").repartition("video_id").mapInArrow(run, DECODED)
