"""File discovery, fingerprints and probe results."""

from __future__ import annotations

import hashlib
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import VIDEO_SUFFIXES

#: Fixed value: how much of a file is hashed.
FINGERPRINT_BYTES = 64 << 20


def discover(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> DataFrame:
    """(path, length, modificationTime) of files with one of the suffixes, in any case, once each and in order. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots).select("path", "length", "modificationTime")
    return found.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).dropDuplicates(["path"]).orderBy("path")


def small_fingerprints(files: DataFrame) -> DataFrame:
    """(path, sha1) from the content column, for files that fit in a cell."""
    return files.select("path", F.sha1(F.substring("content", 1, FINGERPRINT_BYTES)).alias("sha1"))


def local_path(path: str) -> str:
    """The path as the worker's file system has it; file: URLs are unpacked."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def file_digest(path: str, most: int = FINGERPRINT_BYTES, step: int = 1 << 20) -> str:
    """SHA-1 of at most the first bytes of a file that the worker can open."""
    digest, left = hashlib.sha1(), most
    with open(local_path(path), "rb") as f:
        while left > 0 and (part := f.read(min(step, left))):
            digest.update(part)
            left -= len(part)
    return digest.hexdigest()


def fingerprints(paths: DataFrame) -> DataFrame:
    """(path, sha1, error): one row for each path; a file that cannot be read has an error instead of a digest."""

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column("path").to_pylist():
                try:
                    out.append((path, file_digest(path), None))
                except OSError as e:
                    out.append((path, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 3, ["path", "sha1", "error"])

    return paths.select("path").mapInArrow(run, "path string, sha1 string, error string")


_PROBE = "streams array<struct<codec_type: string, width: int, height: int, duration: string, avg_frame_rate: string>>, format struct<duration: string>"


def probed(reports: DataFrame) -> DataFrame:
    """(path, duration, width, height, fps, error) from a prober's JSON reports (path, report).

    Duration is the stream's, else the container's, else 0; a rate over 0 counts as 0; a
    report without a video stream is an error.
    """
    rows = reports.select("path", F.from_json("report", _PROBE).alias("r")).withColumn("v", F.get(F.filter("r.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    rate = F.split("v.avg_frame_rate", "/")
    num, den = F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))
    ok = F.col("v").isNotNull()
    return rows.select(
        "path",
        F.when(ok, F.coalesce(F.col("v.duration").try_cast("double"), F.col("r.format.duration").try_cast("double"), F.lit(0.0))).alias("duration"),
        F.col("v.width").alias("width"),
        F.col("v.height").alias("height"),
        F.when(ok, F.when(den == 0, 0.0).otherwise(F.coalesce(num, F.lit(0.0)) / den)).alias("fps"),
        F.when(~ok, "no video stream").alias("error"),
    )
