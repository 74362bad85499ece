"""Byte spans of documents: their keys and packed form, and cutting them out of the texts.

A document is known by ``__id``: its doc_id where no doc_id repeats (null counts as the
smallest).  Where one repeats, different texts under one doc_id are different documents,
and ``__id`` numbers the distinct (doc_id, hash of the text) in their order, so that it
still sorts as doc_id does.  Rows that repeat both are one document and get the same
result.  A span is packed into one long: start (41 bits), two flags, length (10).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written
from .textkit import lean, mix

FLAG, SELF = 1 << 11, 1 << 10
SPAN = SELF - 1
_NULL_ID = -(2**63)


def repeats(docs: DataFrame) -> bool:
    """Whether a doc_id stands in more than one row of docs."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def keyed(docs: DataFrame, repeated: bool | None = None) -> DataFrame:
    """docs with __id; repeated says whether a doc_id repeats, if that is known.

    Only where one does, this costs a sort of the distinct documents' hashes and a join.
    Both go by doc_id and text, so many texts under one doc_id, or none, are dealt out.
    """
    docs = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)))
    if not (repeats(docs) if repeated is None else repeated):
        return docs
    text = F.coalesce("text", F.lit(""))
    docs = docs.withColumn("__h", F.xxhash64(text)).withColumn("__g", F.xxhash64(F.lit("second"), text, F.col("text").isNull()))
    by = ("__id", "__h", "__g")
    keys = docs.select(*by).distinct().repartitionByRange(*by).sortWithinPartitions(*by)
    keys = written(keys.withColumn("__key", F.monotonically_increasing_id()), "document-keys")
    return docs.join(keys.hint("merge"), list(by)).drop(*by).withColumnRenamed("__key", "__id")


def pack(start, size):
    return (np.asarray(start, np.int64) << 12) | np.asarray(size, np.int64)


def start_of(at: np.ndarray) -> np.ndarray:
    return at >> 12


def earliest_in_batch(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(h1, at) after map-side aggregation of a batch's pieces by digest.

    Of equal pieces the earliest keeps its digest; the others are certain copies
    already, so they are flagged and take a hash of their own place as key.  However
    many copies a piece has, a batch sends one row of it to the piece's reducer.
    """
    with np.errstate(over="ignore"):
        both = mix(h1 ^ (h2 * np.uint64(0xD6E8FEB86659FD93)))
        place = mix(ids.view(np.uint64) * np.uint64(0xA0761D6478BD642F) + at.view(np.uint64))
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = np.concatenate(([False], s[1:] == s[:-1]))
    if not same.any():
        return h1, at
    group = np.cumsum(~same)
    multiple = np.flatnonzero(same | np.concatenate((same[1:], [False])))
    sub = order[multiple]
    ranked = np.lexsort((at[sub], ids[sub], group[multiple]))
    sub, g = sub[ranked], group[multiple][ranked]
    later = sub[np.concatenate(([False], g[1:] == g[:-1]))]
    h1, at = h1.copy(), at.copy()
    h1[later] = place[later]
    at[later] |= FLAG
    return h1, at


def cut(docs: DataFrame, spans: DataFrame, text: bool = False) -> DataFrame:
    """What is left of each document without its spans (__id, at: packed).

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; with
    text also __spans and kept (the remaining bytes; invalid UTF-8 at a cut is replaced).
    """
    lists = spans.groupBy("__id").agg(F.collect_list("at").alias("__at"))
    both = docs.join(lists, "__id", "left")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<start: bigint, end: bigint>>, kept string" * text

    def apply(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            lists = batch.column("__at")
            out = []
            for i in range(batch.num_rows):
                raw = texts[i].as_py() or b""
                at = lists[i]
                ends, starts = [0], []
                if at.is_valid:
                    at = np.sort(at.values.to_numpy())
                    a, b = start_of(at), start_of(at) + (at & SPAN)
                    if len(a):
                        b = np.maximum.accumulate(b)
                        new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
                        starts = a[new].tolist()
                        ends += b[np.concatenate((new[1:] - 1, [len(a) - 1]))].tolist()
                kept = b"".join(raw[x:y] for x, y in zip(ends, [*starts, len(raw)])) if starts else raw
                out.append((len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), [{"start": x, "end": y} for x, y in zip(starts, ends[1:])], kept.decode(errors="replace")) if text else (len(raw), len(raw) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
            cols = list(zip(*out)) if out else [()] * (6 if text else 4)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(cols) + 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return both.select("doc_id", "text", "__at").mapInArrow(lean(apply), schema)
