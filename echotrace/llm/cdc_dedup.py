"""Substring dedup by content-defined chunking with a gear rolling hash.

A text's UTF-8 bytes are cut where the gear hash of the last 32 bytes has ``bits``
zero top bits, at least ``least`` and at most ``most`` bytes after the last cut.
Cuts depend on nearby bytes only, so an insertion shifts the chunks around it and no
others.  Of chunks with one 128-bit digest, the earliest in (doc_id, start) stays;
every later one is removed.  A chunk shorter than ``least`` (the tail of a text)
never counts as a copy.

Defined results: null text is empty; an empty text has no chunk; repeated rows are
one document; texts of any length are chunked whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import FLAG, SPAN, cut, earliest_in_batch, keyed, pack
from .store import release, written
from .textkit import blocks, lean, mix, prefix_hash, span_hash

LEAST, MOST, BITS = 40, 256, 5
#: One 32-bit gear value for each byte.
GEAR = (mix(np.arange(256, dtype=np.uint64), 77) >> np.uint64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j over j < 32, modulo 2**32: what a rolling gear hash holds after byte i."""
    h = GEAR[data]
    step = 1
    with np.errstate(over="ignore"):
        while step < 32:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
            step *= 2
    return h


def cuts(size: int, marks: np.ndarray, least: int = LEAST, most: int = MOST) -> list[int]:
    """Chunk ends in a text of size bytes, given the sorted ends that the hash allows."""
    out, last, k, n = [], 0, 0, len(marks)
    marks = marks.tolist()
    while size - last > least:
        while k < n and marks[k] < last + least:
            k += 1
        end = min(marks[k] if k < n else size, last + most, size)
        out.append(end)
        last = end
    if last < size:
        out.append(size)
    return out


def chunks(data: np.ndarray, off: np.ndarray, least: int = LEAST, most: int = MOST, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all chunks of a block; starts and ends count in the block."""
    h = gear_hash(data)
    mark = np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1
    doc, ends, starts = [], [], []
    # a hash that reaches over the text's first byte is not the text's own: no cut before its 32nd byte, as least >= 32
    for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        if a == b:
            continue
        own = mark[np.searchsorted(mark, a + 32) : np.searchsorted(mark, b, "right")] - a
        c = cuts(b - a, own, least, most)
        doc += [d] * len(c)
        starts.append(a)
        starts += [a + x for x in c[:-1]]
        ends += [a + x for x in c]
    return np.array(doc, np.int64), np.array(starts, np.int64), np.array(ends, np.int64)


def chunk_rows(docs: DataFrame, least: int, most: int, bits: int) -> DataFrame:
    """(h1, h2, __id, at) of every chunk; copies known within an Arrow batch are flagged in at."""

    def run(batches):
        for batch in batches:
            ids = batch.column("__id").to_numpy()
            h1, h2, who, at = [], [], [], []
            for lo, _, data, off in blocks(batch.column("text")):
                doc, start, end = chunks(data, off, least, most, bits)
                if not len(doc):
                    continue
                whole = end - start >= least
                s = prefix_hash(data)
                h = span_hash(s, start, end)
                s2 = prefix_hash(data ^ np.uint8(0x5A))
                a, b = mix(h, 1), mix(span_hash(s2, start, end) ^ (end - start).astype(np.uint64), 2)
                h1.append(a[whole])
                h2.append(b[whole])
                who.append(ids[lo + doc[whole]])
                at.append(pack((start - off[doc])[whole], (end - start)[whole]))
            if not h1:
                continue
            h1, h2, who, at = map(np.concatenate, (h1, h2, who, at))
            h1, at = earliest_in_batch(h1, h2, who, at)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(who), pa.array(at)], ["h1", "h2", "__id", "at"])

    return docs.select("__id", "text").mapInArrow(lean(run), "h1 bigint, h2 bigint, __id bigint, at bigint")


def copies(docs: DataFrame, least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """(__id, at) of every chunk that has an earlier equal."""
    if not 32 <= least <= most <= SPAN:
        raise ValueError(f"32 <= least <= most <= {SPAN} must hold")
    rows = chunk_rows(docs, least, most, bits)
    # any row of a digest's group after the first is a copy; flagged rows stand alone under a key of their own
    before = F.lag("at").over(Window.partitionBy("h1", "h2").orderBy("__id", "at"))
    flagged = F.col("at").bitwiseAND(FLAG) != 0
    return rows.withColumn("__copy", flagged | before.isNotNull()).filter("__copy").select("__id", F.col("at").bitwiseAND(~FLAG).alias("at"))


def dedup(docs: DataFrame, least: int = LEAST, most: int = MOST, bits: int = BITS, text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (with text also spans and kept) of each row of docs."""
    docs = keyed(docs.select("doc_id", "text"))
    found = written(copies(docs, least, most, bits), "cdc-copies")
    release(docs.sparkSession)
    return cut(docs, found, text)


def op10_cdc_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
