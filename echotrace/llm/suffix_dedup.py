"""Exact substring dedup: a collection's Burrows-Wheeler transform and common prefixes, built column by column.

A byte goes if it is covered by a ``k``-byte string (k = 100) that also starts
earlier: in a smaller doc_id, or earlier in the same text; overlaps count.

1. Every k-byte window has a minimizer: the least hash of its m-byte substrings
   (m = 32).  Runs of windows with one minimizer form a segment of at most 2k - m
   bytes.  Equal windows have equal minimizers, so segments can be dealt out by it.
2. Equal segments collapse to the earliest, within a batch before the shuffle and by
   a window function after it; the others are removed whole.  Segments whose
   minimizer has no other segment are done.  A minimizer that is common in a sample of
   the texts is dealt out by the segments' digests and counts as one that has others.
3. The rest are fetched and dealt to collections by minimizer.  In a collection, only
   segments that agree with another one for (k - m) / 2 bytes on one side of the
   minimizer can share a window; those enter the construction: round j inserts the
   suffix of length j of each segment, one symbol per segment, by last-to-first
   mapping, and updates the transform and the array of common prefixes; the state of a
   round is read and written in sequence.  Rounds are bounded by the segment length.
   Runs of suffixes whose common prefixes reach k are classes of equal windows; all but
   the earliest window of a class are removed.
4. A minimizer with more than ``hot`` segments is split over several collections.  These
   also return one window per class with a 128-bit digest, and a last window function
   over the digests finds the earliest of all parts.

Defined results: null text is empty; texts shorter than k lose nothing; repeated rows
are one document; matches never cross documents; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spans import FLAG, SELF, SPAN, cut, earliest_in_batch, keyed, pack, start_of
from .store import forget, release, written
from .textkit import BLOCK, buffers, lean, mix, prefix_hash, span_hash, window_hash

K, M = 100, 32
#: Segments of one minimizer beyond which it is split; segments of one construction.
HOT, COLLECTION = 16_384, 8_192
#: A minimizer is dealt out over PARTS tasks if it has a 1 / SHARE part of the segments of one text in SAMPLE: at most
#: SHARE minimizers are.  The sample decides where rows go and changes no result.
PARTS, SHARE, SAMPLE = 64, 2_048, 16
_SEED = 11


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every run of w values."""
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (w - span)], h[w - span :]) if w > span else h


def segments(data: np.ndarray, off: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, ...]:
    """(text, start in data, bytes, minimizer, digest, may hold a window twice) of the segments of a block."""
    none = np.zeros(0, np.int64)
    if len(data) < k:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    s = prefix_hash(data)
    h = mix(window_hash(s, m), _SEED)
    least = sliding_min(h, k - m + 1)
    sizes = np.maximum(np.diff(off) - k + 1, 0)
    valid = np.zeros(len(least) + 1, np.int8)  # one past the last window of each text may be the end
    has = np.flatnonzero(sizes)
    np.add.at(valid, off[:-1][has], 1)
    np.add.at(valid, (off[:-1] + sizes)[has], -1)
    valid = np.cumsum(valid[:-1]).astype(bool)
    edge = np.concatenate(([True], least[1:] != least[:-1]))
    edge[off[:-1][has]] = True
    edge |= np.concatenate(([True], valid[1:] != valid[:-1]))
    at = np.flatnonzero(edge)
    run = np.diff(np.append(at, len(least)))
    at, run = at[valid[at]], run[valid[at]]
    most = k - m + 1
    if len(run) and run.max() > most:  # a minimizer that recurs at once: split its run
        parts = -(-run // most)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, run = np.repeat(at, parts) + nth * most, np.minimum(np.repeat(run, parts) - nth * most, most)
    size = run + k - 1
    digest = mix(span_hash(prefix_hash(data ^ np.uint8(0x5A)), at, at + size) ^ size.astype(np.uint64), 3)
    # a window that recurs within a segment brings its minimizer along: neighbouring minimizers are then equal
    ends = np.concatenate((np.zeros(most - 1, np.uint64), least, np.zeros(most - 1, np.uint64)))
    places = np.flatnonzero(h == ~sliding_min(~ends, most))
    again = np.flatnonzero((h[places[1:]] == h[places[:-1]]) & (np.diff(places) < most))
    twice = np.searchsorted(places[again], at) < np.searchsorted(places[again + 1], at + size - m, "right")
    return np.searchsorted(off, at, "right") - 1, at, size, least[at], digest, twice


def pieces(column: pa.Array, k: int):
    """(first row, bytes, offsets, shift) of blocks of whole texts; a text beyond a block comes in pieces that overlap by k - 1 bytes."""
    raw, off = buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(off, off[lo] + BLOCK, "right")) - 1))
        if off[hi] - off[lo] > 2 * BLOCK:
            for a in range(int(off[lo]), max(int(off[hi]) - k + 1, int(off[lo]) + 1), BLOCK):
                b = min(a + BLOCK + k - 1, int(off[hi]))
                yield lo, raw[a:b], np.array([0, b - a]), a - int(off[lo])
        else:
            yield lo, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], 0
        lo = hi


def segment_rows(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(h1: minimizer, h2: digest, __id, at) of all segments; copies known within an Arrow batch are flagged in at."""

    def run(batches):
        for batch in batches:
            ids = batch.column("__id").to_numpy()
            found = []
            for lo, data, off, shift in pieces(batch.column("text"), k):
                doc, at, size, h1, h2, twice = segments(data, off, k, m)
                found.append((h1, h2, ids[lo + doc], pack(at - off[doc] + shift, size) | (twice * SELF)))
            if not found:
                continue
            h1, h2, who, at = (np.concatenate(x) for x in zip(*found))
            h1, at = earliest_in_batch(h1, h2, who, at)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(who), pa.array(at)], ["h1", "h2", "__id", "at"])

    return docs.select("__id", "text").mapInArrow(lean(run), "h1 bigint, h2 bigint, __id bigint, at bigint")


def common_minimizers(rows: DataFrame, share: int = SHARE) -> list[int]:
    """The minimizers that hold at least a 1 / share part of the given segments, if that is 64 or more; at most share."""
    counts = rows.groupBy("h1").agg(F.count("*").alias("n"))
    total = rows.count()
    return [r["h1"] for r in counts.filter(F.col("n") >= max(64, -(-total // share))).select("h1").collect()]


def transform(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and common prefixes of a collection of strings, one symbol per string each round.

    Symbol 0 stands before a string's first byte; a byte b is held as b + 1.  Round j
    inserts the suffixes of length j.  The end markers of the strings differ and sort in
    the order of the strings.
    """
    m, longest = len(size), int(size.max(initial=0))
    small = np.uint8 if longest < 255 and int(data.max(initial=0)) < 255 else np.uint16  # UTF-8 has no byte 255
    most = np.iinfo(small).max - 1
    symbols = np.zeros(len(data) + 1, small)
    symbols[:-1] = data
    symbols += 1
    bwt = np.where(size > 0, symbols[start + size - 1], 0).astype(small)
    lcp = np.zeros(m, small)
    who, fresh = np.arange(m), np.arange(m)  # the strings whose suffix came last, and where it stands
    for j in range(1, longest + 1):
        # rows sorted by (symbol before, place) are the suffixes that are one longer: those that stand already, and the new ones
        order = np.argsort(bwt, kind="stable")
        order = order[len(order) - np.count_nonzero(bwt) :]
        is_new = np.zeros(len(bwt), bool)
        going = size[who] >= j
        is_new[fresh[going]] = True
        new = np.flatnonzero(is_new[order])
        seat = np.empty(len(bwt), np.int64)
        seat[fresh[going]] = who[going]
        who = seat[order[new]]
        left = np.where(size[who] > j, symbols[start[who] + np.maximum(size[who] - 1 - j, 0)], 0)
        grown = np.zeros(m + len(order), bool)
        grown[m + new] = True
        bwt_next, lcp_next = np.empty(len(grown), small), np.empty(len(grown), small)
        bwt_next[~grown], bwt_next[grown] = bwt, left
        lcp_next[~grown], lcp_next[grown] = lcp, 0
        # common prefixes change at new rows and right after them: one more than the least between the shorter suffixes
        touched = np.union1d(new, new[new + 1 < len(order)] + 1)
        inner = touched[touched > 0]
        lcp_next[m + touched[touched == 0]] = 0
        a, b = order[inner - 1], order[inner]
        same = bwt[a] == bwt[b]
        lcp_next[m + inner[~same]] = 0
        a, b, place = a[same] + 1, b[same] + 1, m + inner[same]
        if len(a):
            down = np.argsort(-a, kind="stable")
            ranges = np.stack((a[down], b[down]), axis=1).ravel()
            low = np.minimum.reduceat(np.append(lcp, small(0)), ranges)[::2]
            lcp_next[place[down]] = np.minimum(low, most) + 1
        bwt, lcp, fresh = bwt_next, lcp_next, m + new
    return bwt, lcp


def places(bwt: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, row) of all suffixes of at least that length, by last-to-first mapping."""
    m = len(size)
    order = np.argsort(bwt, kind="stable")
    order = order[len(order) - np.count_nonzero(bwt) :]
    step = np.zeros(len(bwt), np.int64)
    step[order] = m + np.arange(len(order))
    who, row, out = np.arange(m), np.arange(m), []
    for j in range(1, int(size.max(initial=0)) + 1):
        on = size[who] >= j
        who, row = who[on], step[row[on]]
        if j >= least:
            out.append((who, np.full(len(who), j), row))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def viable(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, k: int, m: int) -> np.ndarray:
    """Segments that may share a window with another of their minimizer.

    A window spans the minimizer and k - m more bytes, so two segments with an equal
    window agree on (k - m) / 2 bytes on its one side or on its other.
    """
    side = (k - m) // 2
    h = mix(window_hash(prefix_hash(data), m), _SEED)
    n = len(size)
    # where in its segment the minimizer stands; a segment with several of them is always kept
    reach = size - m + 1
    owner = np.repeat(np.arange(n), reach)
    pos = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(start, reach)
    hit = np.flatnonzero(h[pos] == key[owner])
    times = np.bincount(owner[hit], minlength=n)
    anchor = np.zeros(n, np.int64)
    anchor[owner[hit]] = pos[hit]
    keep = times != 1
    s = prefix_hash(data)
    for a, b in ((anchor - side, anchor + m), (anchor, anchor + m + side)):
        inside = (a >= start) & (b <= start + size) & (times == 1)
        near = mix(span_hash(s, np.where(inside, a, 0), np.where(inside, b, 0)) ^ key, 5)
        at = np.flatnonzero(inside)
        _, back, count = np.unique(near[at], return_inverse=True, return_counts=True)
        keep[at[count[back] > 1]] = True
    # a segment that is always kept may pair with any other of its minimizer
    odd = np.unique(key[times != 1])
    return keep | np.isin(key, odd)


def equal_windows(data, start, size, ids, at, k: int) -> tuple[np.ndarray, ...]:
    """(segment, offset, is removed, is earliest) of every window of the given segments that has an equal, or could have one elsewhere."""
    bwt, lcp = transform(data, start, size)
    who, length, row = places(bwt, size, k)
    group = np.cumsum(lcp < k)[row]
    rank = np.empty(len(ids), np.int64)
    rank[np.lexsort((at, ids))] = np.arange(len(ids))
    offset = size[who] - length
    when = rank[who] * 4096 + offset
    first = np.full(int(group.max(initial=0)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, group, when)
    return who, offset, when != first[group], when == first[group]


def spans_of(who: np.ndarray, offset: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, packed span) of runs of consecutive windows."""
    if not len(who):
        return who, np.zeros(0, np.int64)
    order = np.lexsort((offset, who))
    who, offset = who[order], offset[order]
    new = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (offset[1:] != offset[:-1] + 1))))
    last = np.append(new[1:] - 1, len(who) - 1)
    seg = who[new]
    return seg, pack(start_of(at[seg]) + offset[new], offset[last] - offset[new] + k)


def collections(batches, size: int):
    """Sorted rows in runs of about size rows, cut between minimizers or parts of them."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("h1").to_numpy()
        part = batch.column("part").to_numpy()
        ends = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        lo = 0
        if held and n >= size and (key[0] != held[-1].column("h1")[-1].as_py() or part[0] != held[-1].column("part")[-1].as_py()):
            yield pa.Table.from_batches(held)
            held, n = [], 0
        while True:
            cutat = ends[np.searchsorted(ends, lo + max(size - n, 1)) :][:1]
            if not len(cutat):
                break
            held.append(batch.slice(lo, int(cutat[0]) - lo))
            yield pa.Table.from_batches(held)
            held, n, lo = [], 0, int(cutat[0])
        held.append(batch.slice(lo))
        n += batch.num_rows - lo
    if held:
        yield pa.Table.from_batches(held)


def copied_spans(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT, collection: int = COLLECTION, share: int = SHARE) -> DataFrame:
    """(__id, at: packed) of spans whose k-byte windows all start earlier too; spans may overlap."""
    if not (k > m >= 8 and (k - m) % 2 == 0 and 2 * k < SPAN):
        raise ValueError("k must exceed m by an even number")
    some = written(segment_rows(docs.filter(F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(SAMPLE)) == 0), k, m).filter(F.col("at").bitwiseAND(FLAG) == 0).select("h1"), "suffix-sample")
    common = common_minimizers(some, share)
    forget(some)
    rows = segment_rows(docs, k, m)
    deal = F.when(F.col("h1").isin(common), F.pmod(F.col("h2"), F.lit(PARTS)).cast("int")).otherwise(-1) if common else F.lit(-1)
    rows = rows.withColumn("deal", deal)
    by = Window.partitionBy("h1", "deal").orderBy("h2", "__id", "at")
    every = Window.partitionBy("h1", "deal")
    flagged = F.col("at").bitwiseAND(FLAG) != 0
    several = (F.min("h2").over(every) != F.max("h2").over(every)) | (F.col("at").bitwiseAND(SELF) != 0) | (F.col("deal") >= 0)
    rows = rows.select("h1", "__id", "at", (flagged | F.coalesce(F.lag("h2").over(by) == F.col("h2"), F.lit(False))).alias("copy"), several.alias("several"))
    found = written(rows.filter("copy OR several").select("h1", "__id", F.col("at").bitwiseAND(~(FLAG | SELF)).alias("at"), "copy"), "suffix-segments")
    release(docs.sparkSession)

    rest = found.filter("NOT copy").select("h1", "__id", "at")
    large = written(rest.groupBy("h1").count().filter(F.col("count") > hot).select("h1", F.ceil(F.col("count") / hot).cast("int").alias("parts")), "suffix-hot")
    rest = rest.join(large, "h1", "left").select("h1", "__id", "at", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("__id", "at"), "parts").cast("int")).otherwise(-1).alias("part"))
    wanted = rest.groupBy("__id").agg(F.collect_list(F.struct("h1", "at", "part")).alias("__want"))
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    fetched = _fetch(docs.join(wanted, "__id")).repartition(int(parts), "h1", "part").sortWithinPartitions("h1", "part")

    def construct(batches):
        for table in collections(batches, collection):
            key, part, ids, at = (table.column(c).to_numpy() for c in ("h1", "part", "__id", "at"))
            data, off = buffers(table.column("bytes"))
            size = np.diff(off)
            keep = np.flatnonzero(viable(data, off[:-1], size, key.view(np.uint64), k, m) | (part >= 0))
            if not len(keep):
                continue
            who, offset, gone, first = equal_windows(data, off[:-1][keep], size[keep], ids[keep], at[keep], k)
            seg, span = spans_of(who[gone], offset[gone], at[keep], k)
            rep = np.flatnonzero(first & (part[keep][who] >= 0))
            at_rep = off[:-1][keep][who[rep]] + offset[rep]
            d1 = mix(span_hash(prefix_hash(data), at_rep, at_rep + k), 7) if len(rep) else np.zeros(0, np.uint64)
            d2 = mix(span_hash(prefix_hash(data ^ np.uint8(0x5A)), at_rep, at_rep + k), 8) if len(rep) else np.zeros(0, np.uint64)
            mine = at[keep][who[rep]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((ids[keep][seg], ids[keep][who[rep]]))),
                    pa.array(np.concatenate((span, pack(start_of(mine) + offset[rep], k)))),
                    pa.array(np.concatenate((np.zeros(len(seg), np.int64), d1.view(np.int64)))),
                    pa.array(np.concatenate((np.zeros(len(seg), np.int64), d2.view(np.int64)))),
                    pa.array(np.concatenate((np.zeros(len(seg), bool), np.ones(len(rep), bool)))),
                ],
                ["__id", "at", "d1", "d2", "rep"],
            )

    built = written(fetched.mapInArrow(lean(construct), "__id bigint, at bigint, d1 bigint, d2 bigint, rep boolean"), "suffix-spans")
    release(docs.sparkSession)
    before = F.lag("at").over(Window.partitionBy("d1", "d2").orderBy("__id", "at"))
    across = built.filter("rep").select("__id", "at", before.isNotNull().alias("copy")).filter("copy")
    return found.filter("copy").select("__id", "at").unionByName(built.filter("NOT rep").select("__id", "at")).unionByName(across.select("__id", "at"))


def _fetch(docs: DataFrame) -> DataFrame:
    """The bytes of the wanted segments."""

    def run(batches):
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            lists = batch.column("__want")
            lo = lists.offsets.to_numpy()
            flat = lists.flatten()
            at_all = flat.field("at").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lo))
            for some in np.array_split(np.arange(len(row)), max(1, len(row) // 20_000)):
                at = at_all[some]
                size = at & SPAN
                start = off[row[some]] + start_of(at)
                ends = np.concatenate(([0], np.cumsum(size)))
                take = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
                data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[take]))])
                pick = pa.array(some)
                yield pa.RecordBatch.from_arrays([flat.field("h1").take(pick), flat.field("part").take(pick), batch.column("__id").take(pa.array(row[some])), pa.array(at), data], ["h1", "part", "__id", "at", "bytes"])

    return docs.select("__id", "text", "__want").mapInArrow(lean(run), "h1 bigint, part int, __id bigint, at bigint, bytes binary")


def dedup(docs: DataFrame, k: int = K, m: int = M, hot: int = HOT, text: bool = False, share: int = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (with text also spans and kept) of each row of docs."""
    docs = keyed(docs.select("doc_id", "text"))
    return cut(docs, copied_spans(docs, k, m, hot, share=share), text)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d WHERE len(h) >= 200)),
c AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM w),
m AS (SELECT doc_id, i AS a, i + 100 AS b, lag(i + 100) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c WHERE n > 1),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM m),
r AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM r),
p AS (SELECT doc_id, a AS place, substr(h, 2 * last + 1, 2 * (a - last)) AS piece FROM e JOIN d USING (doc_id)
  UNION ALL SELECT doc_id, 9223372036854775807, substr(h, 2 * coalesce(b, 0) + 1) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM r GROUP BY doc_id) USING (doc_id)),
k AS (SELECT doc_id, string_agg(piece, '' ORDER BY place) AS kept FROM p GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, (len(h) - len(kept)) // 2 AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id) USING (doc_id)
"""
