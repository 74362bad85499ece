"""Benchmark decontamination: n-gram scan against a broadcast hash set of test windows.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing
A-Z.  A window is ``n`` consecutive words of a test item, or all words of an item
that has fewer.  The windows' 64-bit hashes form a sorted array behind a bit table;
workers scan every word window of a text once per window length, and each hit is
verified word by word, against the item's own words, before it counts.

The test set is read in blocks of at most ``max_block_bytes`` bytes of text; a larger item
is split into parts that overlap by n - 1 words.  Windows are held as arrays: what is
broadcast is about four times the block (``WindowSet.nbytes``).  Beyond one block, every
pass but the last writes its marks to the shared folder; texts are cut, and shares of hit
words judged, once, on the marks of all blocks, so results do not depend on the blocks.

Defined results: null or empty text has no words; null item text has no window; an item
without an id marks words and counts as one item that has no name; repeated items and
repeated rows are each reported; extra columns are ignored by ``scan`` and kept by
``remove``, except ``__bits`` and ``__items``, which are its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import forget, written
from .textkit import Words, blocks, lean

WINDOW = 10
MAX_BLOCK_BYTES = 32 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class WindowSet:
    """Test windows by length: sorted hashes, a bit table before them, and where the windows' words stand."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.names = [i for i, _ in items]
        hashes: dict[int, list[np.ndarray]] = {}
        firsts: dict[int, list[np.ndarray]] = {}
        starts, texts, owners, n_words, n_bytes = [], [], [], 0, 0
        for lo, hi, data, off in blocks(pa.array([t for _, t in items], pa.large_string())):
            w = Words(data, off)
            for size in range(1, n + 1):
                fits = w.count >= n if size == n else w.count == size
                at, h = w.windows(size) if fits.any() else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                mine = fits[w.doc[at]]
                if mine.any():
                    hashes.setdefault(size, []).append(h[mine])
                    firsts.setdefault(size, []).append((at[mine] + n_words).astype(np.uint32))
            # the words, each with a space after it
            long = w.end - w.start + 1
            ends = np.cumsum(long)
            take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - long - w.start, long)
            own = w.low[np.minimum(take, max(len(data) - 1, 0))] if len(take) else np.zeros(0, np.uint8)
            own[ends - 1] = 32
            texts.append(own)
            starts.append((ends - long + n_bytes).astype(np.uint32))
            owners.append((w.doc + lo).astype(np.uint32))
            n_words += len(long)
            n_bytes += len(own)
        empty = lambda kind: np.zeros(0, kind)
        self.text = np.concatenate([*texts, empty(np.uint8)])
        self.start = np.append(np.concatenate([*starts, empty(np.uint32)]), np.uint32(n_bytes))
        self.owner = np.concatenate([*owners, empty(np.uint32)])
        self.by_len: dict[int, tuple[np.ndarray, np.ndarray, int, np.ndarray]] = {}
        for size in sorted(hashes):
            h, first = np.concatenate(hashes.pop(size)), np.concatenate(firsts.pop(size))
            order = np.lexsort((self.owner[first], h))
            h, first = h[order], first[order]
            own = self.owner[first]
            once = np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))
            if not once.all():  # of a window that an item repeats, the first; but other words with the same hash stay
                alike = [self.key(int(a), size) == self.key(int(b), size) for a, b in zip(first[1:][~once[1:]], first[:-1][~once[1:]])]
                once[np.flatnonzero(~once)[~np.array(alike)]] = True
            h, first = h[once], first[once]
            bits = int(np.clip(np.ceil(np.log2(12 * len(h))), 10, 28))
            table = np.zeros(1 << bits - 3, np.uint8)
            place = h >> np.uint64(64 - bits)
            np.bitwise_or.at(table, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
            self.by_len[size] = (h, first, bits, table)

    @property
    def nbytes(self) -> int:
        """Bytes of what is broadcast, but for the items' names."""
        return self.text.nbytes + self.start.nbytes + self.owner.nbytes + sum(h.nbytes + first.nbytes + table.nbytes for h, first, _, table in self.by_len.values())

    def key(self, first: int, size: int) -> bytes:
        """The words of the window that starts there."""
        return self.text[self.start[first] : int(self.start[first + size]) - 1].tobytes()

    def hits(self, w: Words) -> tuple[np.ndarray, list[set[str | None]]]:
        """A mark for each word that an occurrence covers, and the items found in each text."""
        cover = np.zeros(len(w.hash) + 1, np.int64)
        items: list[set[str | None]] = [set() for _ in range(len(w.off) - 1)]
        for size, (known, first, bits, table) in self.by_len.items():
            at, h = w.windows(size)
            place = h >> np.uint64(64 - bits)
            near = np.flatnonzero(table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
            if not len(near):
                continue
            lo, hi = np.searchsorted(known, h[near]), np.searchsorted(known, h[near], "right")
            for i, a, b in zip(at[near].tolist(), lo.tolist(), hi.tolist()):
                if a == b:
                    continue
                key = b" ".join(w.text(j) for j in range(i, i + size))
                owners = {self.names[self.owner[f]] for f in first[a:b].tolist() if self.key(f, size) == key}
                if owners:
                    cover[i] += 1
                    cover[i + size] -= 1
                    items[w.doc[i]] |= owners
        return np.cumsum(cover[:-1]) > 0, items


def split_item(text: str, max_bytes: int, n: int) -> Iterator[str]:
    """The words of a large item in parts of about max_bytes that overlap by n - 1 words, so that each of its windows is in one of them."""
    held: list[str] = []
    size = 0
    for m in _WORD.finditer(text):
        held.append(m.group())
        size += len(m.group().encode()) + 1
        if size > max_bytes and len(held) > n:
            yield " ".join(held)
            held = held[len(held) - n + 1 :] if n > 1 else []
            size = sum(len(x.encode()) + 1 for x in held)
    if held:
        yield " ".join(held)


def item_blocks(items: DataFrame, max_bytes: int = MAX_BLOCK_BYTES, n: int = WINDOW) -> Iterator[list[tuple[str | None, str | None]]]:
    """The test items, streamed to the driver in blocks of at most about max_bytes of text."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text", F.octet_length("text").alias("size")).filter("text IS NOT NULL")
    for row in rows.toLocalIterator():
        for part in [row["text"]] if row["size"] <= max_bytes else split_item(row["text"], max_bytes, n):
            own = len(part.encode())
            if block and size + own > max_bytes:
                yield block
                block, size = [], 0
            block.append((row["item_id"], part))
            size += own
    yield block


def _named(found: set[str | None]) -> list[str | None]:
    """The names in order; an item without one last."""
    return sorted(x for x in found if x is not None) + [None] * (None in found)


def _scan_block(docs: DataFrame, held) -> DataFrame:
    """docs with __n_words, __n_hit, __items and __bits (the covered words) added.

    Marks that docs already holds in __items and __bits are merged.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("__n_words", "__n_hit", "__items", "__bits")]
    names, again = [f.name for f in keep], "__bits" in docs.columns
    schema = T.StructType([*keep, T.StructField("__n_words", T.LongType()), T.StructField("__n_hit", T.LongType()), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__bits", T.BinaryType())])

    def scan(batches):
        windows = held.value
        for batch in batches:
            n_words, n_hit, items, marks = [], [], [], []
            old_items = batch.column("__items").to_pylist() if again else None
            old_bits = batch.column("__bits").to_pylist() if again else None
            for lo, _, data, off in blocks(batch.column("text")):
                w = Words(data, off)
                hit, found = windows.hits(w)
                for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    if again and old_bits[lo + k]:
                        hit[a:b] |= np.unpackbits(np.frombuffer(old_bits[lo + k], np.uint8), count=b - a).astype(bool)
                        found[k] |= set(old_items[lo + k])
                    own = hit[a:b]
                    any_hit = bool(own.any())
                    n_hit.append(int(own.sum()) if any_hit else 0)
                    marks.append(np.packbits(own).tobytes() if any_hit else b"")
                n_words.append(w.count)
                items += [_named(x) for x in found]
            counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            added = [pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in names] + added, [f.name for f in schema])

    return docs.mapInArrow(lean(scan), schema)


def marked(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int, max_block_bytes: int) -> DataFrame:
    """docs with the marks of all test items; what each pass but the last finds is written to the shared folder."""
    out, old = None, []
    for block in item_blocks(items, max_block_bytes, n):
        if out is not None:
            docs = written(out, "decontaminate")
            for t in old:
                forget(t)
            old = [docs]
        out = _scan_block(docs, spark.sparkContext.broadcast(WindowSet(block, n)))
    return out


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit and the sorted items found, one row for each row of docs."""
    found = marked(spark, docs.select("doc_id", "text"), items, n, max_block_bytes)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"), F.col("__items").alias("items"))


def remove(spark: SparkSession, docs: DataFrame, items: DataFrame, n: int = WINDOW, mode: str = "span", max_hit_share: float = 0.5, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """docs with every covered span cut out of text (mode "span"), or without hit documents ("document").

    In span mode a document of which more than max_hit_share of the words are hit is
    dropped whole.  All columns are kept; rows without a hit are returned unchanged.
    """
    found = marked(spark, docs, items, n, max_block_bytes)
    if mode == "document":
        return found.filter("__n_hit = 0").select(*docs.columns)
    return _cut(found.filter(F.col("__n_hit") <= max_hit_share * F.col("__n_words")).select(*docs.columns, "__bits"), docs)


def _cut(found: DataFrame, docs: DataFrame) -> DataFrame:
    names = docs.columns

    def run(batches):
        for batch in batches:
            column, bits = batch.column("text"), batch.column("__bits").to_pylist()
            rows = [i for i, b in enumerate(bits) if b]
            if rows:
                texts, hit = column.to_pylist(), {}
                for lo, _, data, off in blocks(column.take(pa.array(rows))):
                    w = Words(data, off)
                    for k, i in enumerate(rows[lo : lo + len(off) - 1]):
                        own = w.first[k] + np.flatnonzero(np.unpackbits(np.frombuffer(bits[i], np.uint8), count=w.count[k]))
                        gap = own[1:] != own[:-1] + 1
                        first, last = own[np.concatenate(([True], gap))], own[np.concatenate((gap, [True]))]
                        begins, ends = [int(off[k]), *w.end[last].tolist()], [*w.start[first].tolist(), int(off[k + 1])]
                        hit[i] = b"".join(data[a:b].tobytes() for a, b in zip(begins, ends)).decode()
                column = pa.array([hit.get(i, t) for i, t in enumerate(texts)], column.type)
            yield pa.RecordBatch.from_arrays([column if c == "text" else batch.column(c) for c in names], names)

    return found.mapInArrow(lean(run), docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return scan(spark, docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.i, win.item_id FROM dw JOIN win ON dw.n = win.n AND dw.win = win.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

