"""MinHash near-dedup by DartMinHash signatures and banded joining.

A text's set is that of its five-word shingles (a text of fewer words is one shingle).
Darts are thrown at the plane of weight and rank that belongs to each element, one on
average for every unit cell, all from hashes of the element: whoever holds the element
sees the same darts.  A set keeps the darts below its elements' weights and below a rank
that lets about k ln k + 2k of them through, hashes each to one of k coordinates, and
keeps the earliest (least rank) of every coordinate; where a coordinate stays empty, the
rank bound doubles.  Two sets agree on a coordinate with the probability of their
weighted Jaccard similarity.  The near-duplicate query gives every shingle the weight 1.

Equal sets collapse to one representative before anything is joined.  The signatures of
representatives are cut into bands; in each bucket of a band, every member is paired
with the one of least id, so pairs grow linearly with a bucket.  Pairs are checked exactly
on their shingle sets, and linked pairs are joined to classes.

Then every bucket whose members lie in several classes is searched for the links that its
pivot has missed.  Members are dealt to blocks of about ``BLOCK``, a large class to blocks
of its own, and two blocks meet in a cell unless they hold one class.  A cell compares odd
sketches: the parity of a set's elements in each of 4n bits.  Two sketches differ in at
most as many bits as the sets differ in elements, so a pair whose sketches differ in more
than a link allows is none, and no link is lost.  The other pairs of different classes are
checked exactly.  Of a large cell, those go first that would join all classes they can;
its buckets are searched again with the new classes, and then all pairs left are checked.  So work is linear in a bucket that one class fills, and quadratic only in texts
of one bucket that are not near-duplicates.

Defined results: texts without a word (null and empty ones too) are classes of their
own; rows that repeat doc_id and text are one document; the class id is the least doc_id
of the class (null counts as the least); texts of any length are shingled whole; extra
columns are ignored by ``classes`` and kept by ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .joins import join_common
from .spans import _NULL_ID, keyed, repeats
from .store import forget, release, written
from .textkit import Words, blocks, lean, mix

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 22, 5
#: Members of a block; rows of a cell up to which all its pairs are checked at once.
BLOCK, SMALL = 256, 32
#: Tasks that the pairs of one pivot are dealt to.
DEALT = 64
_SET_BITS = 44
#: P(at most i darts in a unit cell).
_POISSON = np.cumsum([np.exp(-1.0) / p for p in np.cumprod([1.0, *range(1, 16)])])


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, 44-bit hash) of the distinct shingles of a block, sorted."""
    w = Words(data, off)
    at, h = w.windows(n)
    doc = w.doc[at]
    for size in range(1, n):
        few = np.flatnonzero(w.count == size)
        if len(few):
            start, short = w.windows(size)
            pick = np.isin(w.doc[start], few)
            doc, h = np.concatenate((doc, w.doc[start[pick]])), np.concatenate((h, short[pick]))
    both = np.sort(doc.astype(np.uint64) << np.uint64(_SET_BITS) | h >> np.uint64(64 - _SET_BITS))
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    return (both >> np.uint64(_SET_BITS)).astype(np.int64), both & np.uint64((1 << _SET_BITS) - 1)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs by k earliest darts; a dart is (rank, hash) in one 64-bit value. Sets without elements hold the greatest value."""
    none = np.uint64(2**64 - 1)
    out = np.full(n_docs * k, none)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    bound = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    todo = total > 0
    while todo.any():
        pick = np.flatnonzero(todo[doc])
        d, e, w = doc[pick], element[pick], weight[pick]
        across, down = np.ceil(w).astype(np.int64), np.ceil(bound[d]).astype(np.int64)
        cells = across * down
        ends = np.cumsum(cells)
        for lo in _steps(ends, 1 << 18):
            hi = lo[1]
            lo = lo[0]
            own = np.repeat(np.arange(lo, hi), cells[lo:hi])
            nth = np.arange(len(own)) - np.repeat(np.cumsum(cells[lo:hi]) - cells[lo:hi], cells[lo:hi])
            column, row = nth // down[own], nth % down[own]
            with np.errstate(over="ignore"):
                seed = mix(e[own] * np.uint64(0x9FB21C651E98DF25) + (column.astype(np.uint64) << np.uint64(32)) + row.astype(np.uint64), 21)
            darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right")
            cell = np.repeat(np.arange(len(own)), darts)
            nth = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
            with np.errstate(over="ignore"):
                h = mix(seed[cell] + np.uint64(0xC2B2AE3D27D4EB4F) * (nth + 1).astype(np.uint64), 22)
            rank = row[cell] + (h >> np.uint64(40)).astype(np.float64) * 2.0**-24
            of = own[cell]
            keep = rank < bound[d[of]]
            if (w[of] != across[of]).any():
                keep &= column[cell] + ((h >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24 < w[of]
            h, of, rank = h[keep], of[keep], rank[keep]
            again = mix(h, 23)
            place = d[of] * k + (again >> np.uint64(32)).astype(np.int64) % k
            # 16 + 24 bits of rank, 24 bits of the dart's hash
            np.minimum.at(out, place, (rank * 2.0**24).astype(np.uint64) << np.uint64(24) | again & np.uint64(0xFFFFFF))
        todo &= (out.reshape(n_docs, k) == none).any(axis=1)
        bound = bound * 2
    return out.reshape(n_docs, k)


def _steps(ends: np.ndarray, size: int):
    """Index ranges whose running total grows by about size."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield lo, min(hi, len(ends))
        lo = hi


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    with np.errstate(over="ignore"):
        value = mix(signature[:, : bands * rows], 31).reshape(-1, bands, rows) * (mix(np.arange(rows, dtype=np.uint64), 32) | np.uint64(1))
        return mix(value.sum(axis=2, dtype=np.uint64) + mix(np.arange(bands, dtype=np.uint64), 33), 34)


def _sets_table(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(__id, n, d1, d2, keys) of each document: set size, digest of the set, band keys."""

    def run(batches):
        for batch in batches:
            n_all, d1_all, d2_all, keys_all = [], [], [], []
            for lo, hi, data, off in blocks(batch.column("text")):
                doc, element = shingle_sets(data, off)
                n = np.bincount(doc, minlength=hi - lo)
                digest = []
                for salt in (41, 42):
                    running = np.zeros(len(element) + 1, np.uint64)
                    with np.errstate(over="ignore"):
                        np.cumsum(mix(element, salt), out=running[1:])
                        edge = np.concatenate(([0], np.cumsum(n)))
                        digest.append(mix(running[edge[1:]] - running[edge[:-1]] + n.astype(np.uint64)))
                keys = band_keys(signatures(doc, element, np.ones(len(element)), hi - lo, bands * rows), bands, rows)
                n_all.append(n)
                d1_all.append(digest[0])
                d2_all.append(digest[1])
                keys_all.append(keys)
            if n_all:
                flat = pa.array(np.concatenate(keys_all).ravel().view(np.int64))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(np.concatenate(n_all).astype(np.int32)), pa.array(np.concatenate(d1_all).view(np.int64)), pa.array(np.concatenate(d2_all).view(np.int64)), keys], ["__id", "n", "d1", "d2", "keys"])

    return docs.select("__id", "text").mapInArrow(lean(run), "__id bigint, n int, d1 bigint, d2 bigint, keys array<bigint>")


def _sets_of(docs: DataFrame) -> DataFrame:
    """(node, s): the sorted shingle hashes of each document."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in blocks(batch.column("text")):
                doc, element = shingle_sets(data, off)
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(lo, hi - lo), pa.array([element[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["node", "s"])

    return docs.select("node", "text").mapInArrow(lean(run), "node bigint, s binary")


def groups(batches, keys: tuple[str, ...]):
    """Tables of the sorted rows, each of whole groups of equal keys and, but for one large group, of about a batch."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            edge |= c[1:] != c[:-1]
        if held and any(batch.column(k)[0].as_py() != held[-1].column(k)[-1].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.flatnonzero(edge)[-1]) + 1 if edge.any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (u, v) whose shingle sets are at least that similar.

    The pairs of one u go to at most DEALT tasks; each gets the set of u once.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(DEALT)).cast("int"))
    members = dealt.join(sets.withColumnRenamed("node", "v").hint("merge"), "v").select("u", "part", "v", "s")
    pivots = dealt.select("u", "part").distinct().join(sets.withColumnRenamed("node", "u").hint("merge"), "u").select("u", "part", F.lit(None).cast("bigint").alias("v"), "s")
    rows = members.unionByName(pivots).repartition("u", "part").sortWithinPartitions("u", "part", "v")

    def run(batches):
        pivot = None
        for batch in batches:
            keep = []
            for i, (v, s) in enumerate(zip(batch.column("v").to_pylist(), batch.column("s"))):
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if v is None:
                    pivot = own.copy()
                    continue
                common = int((pivot[np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)] == own).sum())
                if common >= similarity * (len(pivot) + len(own) - common) - 1e-9:
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u").take(at), batch.column("v").take(at)], ["u", "v"])

    return rows.mapInArrow(lean(run), "u bigint, v bigint")


def sketch(element: np.ndarray) -> bytes:
    """The odd sketch of a set: the parity of its elements in each of a power of two of about 4n bits."""
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * max(len(element), 1))), 8, 16))
    return np.packbits((np.bincount((element & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, sketch) of each set."""

    def run(batches):
        for batch in batches:
            own = pa.array([sketch(np.frombuffer(s.as_buffer(), np.uint64)) for s in batch.column("s")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), own], ["node", "sketch"])

    return sets.mapInArrow(lean(run), "node bigint, sketch binary")


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """The sketches, of size or twice as many bytes, as rows of size bytes."""
    out = np.zeros((len(sketches), size), np.uint8)
    for i, s in enumerate(sketches):
        own = np.frombuffer(s, np.uint8)
        if len(own) in (size, 2 * size):
            out[i] = own if len(own) == size else own[:size] ^ own[size:]
    return out.view(np.uint64)


def near(sketches: list[bytes], n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Of the pairs (i, j) of sets of n elements, the share of the difference that a link allows which the sketches show (beyond 1: no link)."""
    width = np.array([len(s) for s in sketches])
    out = np.full(len(i), np.inf)
    allowed = (n[i] + n[j]) * (1 - similarity) / (1 + similarity) + 1e-6
    fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
    least = np.minimum(width[i], width[j])
    for size in np.unique(least[fits]).tolist():
        rows = folded(sketches, size)
        at = np.flatnonzero(fits & (least == size))
        step = max(1, (1 << 22) // size)
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            out[some] = np.bitwise_count(rows[i[some]] ^ rows[j[some]]).sum(axis=1) / allowed[some]
    return out


def _spanning(roots: np.ndarray, i: np.ndarray, j: np.ndarray, order: np.ndarray) -> list[int]:
    """Of the pairs in that order, those that join classes which the ones before them leave apart."""
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for p in order.tolist():
        a, b = find(int(roots[i[p]])), find(int(roots[j[p]]))
        if a != b:
            parent[a] = b
            out.append(p)
    return out


def search_cell(node, root, n, pivot, side, sketches: list[bytes], similarity: float, every: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(i, j) of the pairs of a cell to be checked, and whether there are more; side is null in a cell of one block."""
    i_all, j_all, rate_all = [], [], []
    order = np.argsort(n, kind="stable")  # partners in size are near in this order
    most = np.searchsorted(n[order], n[order] / similarity + 1e-6, "right")
    step = 4096
    for lo in range(0, len(order), step):  # rows at a time, so that pairs are few at a time
        own = np.arange(lo, min(lo + step, len(order)))
        for a in np.array_split(own, max(1, int((most[own] - own).sum() >> 20))):
            count = np.maximum(most[a] - a - 1, 0)
            i = np.repeat(a, count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            i, j = order[i], order[j]
            ok = (root[i] != root[j]) & ~pivot[i] & ~pivot[j]
            if side is not None:
                ok &= side[i] != side[j]
            i, j = i[ok], j[ok]
            rate = near(sketches, n, i, j, similarity)
            ok = rate <= 1
            i_all.append(i[ok])
            j_all.append(j[ok])
            rate_all.append(rate[ok])
    i, j, rate = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i_all, j_all, rate_all))
    if every or len(node) <= SMALL:
        return i, j, False
    pick = _spanning(root, i, j, np.argsort(rate, kind="stable"))
    return i[pick], j[pick], len(pick) < len(i)


def _searched(members: DataFrame, sketches: DataFrame, similarity: float, every: bool) -> DataFrame:
    """(u, v, key): pairs to be checked, of members (key, node, n, pivot, root) of buckets; or a key of which there are more."""
    total = members.count()
    by_class = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    large = F.col("c") >= BLOCK
    per_key = by_class.groupBy("key").agg(
        F.count("*").alias("classes"),
        F.sum("c").alias("rows"),
        F.ceil(F.sum(F.when(large, 0).otherwise(F.col("c"))) / BLOCK).cast("int").alias("mixed"),
        F.sort_array(F.collect_list(F.when(large, F.struct("root", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))))).alias("own"),
    )
    several = written(per_key.filter("classes > 1"), "minhash-several")
    dealt = join_common(members, several, ["key"], "rows", total)
    before = F.aggregate(F.filter("own", lambda x: x["root"] < F.col("root")), F.lit(0), lambda s, x: s + x["blocks"])
    mine = F.filter("own", lambda x: x["root"] == F.col("root"))
    count = F.aggregate("own", F.lit(0), lambda s, x: s + x["blocks"])
    dealt = dealt.select("key", "node", "n", "pivot", "root", before.alias("before"), F.coalesce(F.get(mine, F.lit(0))["blocks"], F.lit(0)).alias("blocks"), count.alias("count"), "mixed")
    spread = lambda column, parts: F.pmod(F.xxhash64(column), F.greatest(parts, F.lit(1))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("blocks") > 0, F.col("before") + spread("node", F.col("blocks"))).otherwise(F.col("count") + spread("root", F.col("mixed"))))
    others = F.filter(F.sequence(F.lit(0), F.col("count") + F.col("mixed") - 1), lambda b: (F.col("blocks") == 0) | (b < F.col("before")) | (b >= F.col("before") + F.col("blocks")))
    with_sketch = dealt.join(sketches.hint("merge"), "node")
    cells = with_sketch.select("key", F.explode(others).alias("other"), "block", "node", "n", "pivot", "root", "sketch")
    cells = cells.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "n", "pivot", "root", "sketch")
    rows = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches):
        for table in groups(batches, ("key", "lo", "hi")):
            key, lo, hi, block, node, n, pivot, root = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "node", "n", "pivot", "root"))
            sketches = [s.as_py() for s in table.column("sketch")]
            edge = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1, [len(key)]))
            u, v, more = [], [], []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                side = None if lo[a] == hi[a] else block[a:b] == lo[a]
                i, j, rest = search_cell(node[a:b], root[a:b], n[a:b].astype(np.int64), pivot[a:b], side, sketches[a:b], similarity, every)
                u.append(np.minimum(node[a:b][i], node[a:b][j]))
                v.append(np.maximum(node[a:b][i], node[a:b][j]))
                if rest:
                    more.append(key[a])
            u, v = np.concatenate(u), np.concatenate(v)
            none = pa.nulls(len(more), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(u), none]), pa.concat_arrays([pa.array(v), none]), pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(more, pa.int64())])], ["u", "v", "key"])

    return rows.mapInArrow(lean(run), "u bigint, v bigint, key bigint")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, repeated: bool = True) -> DataFrame:
    """(__id, __class) of each distinct document of docs, which must be keyed(): the least __id of its class.

    repeated may be False if no __id stands in several rows.
    """
    spark = docs.sparkSession
    texts = docs.select("__id", "text")
    table = written(_sets_table(texts, bands, rows), "minhash-table")
    reps = written(table.filter("n > 0").groupBy("d1", "d2").agg(F.min("__id").alias("node"), F.max("n").alias("n"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "minhash-distinct")
    buckets = reps.select("node", "n", F.explode("keys").alias("key"))
    pivots = written(buckets.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("p")).filter("members > 1").select("key", "members", F.col("p.node").alias("p"), F.col("p.n").alias("pn")), "minhash-pivots")
    members = written(join_common(buckets, pivots, ["key"], "members", bands * reps.count()), "minhash-buckets")
    forget(pivots)
    release(spark)
    # the sets of all that share a bucket, once for all passes; texts are moved by one plan at every size
    sharing = members.select(F.col("node").alias("__id")).distinct().hint("merge")
    shared = texts.join(sharing, "__id", "left_semi")
    shared = shared.dropDuplicates(["__id"]) if repeated else shared
    sets = written(_sets_of(shared.withColumnRenamed("__id", "node")), "minhash-sets")
    release(spark)
    fits = (F.col("p") != F.col("node")) & (F.least("n", "pn") >= similarity * F.greatest("n", "pn") - 1e-9)
    checked = [written(members.filter(fits).select(F.col("p").alias("u"), F.col("node").alias("v")).distinct(), "minhash-pairs")]
    links = written(_linked(checked[0], sets, similarity), "minhash-links")
    release(spark)
    roots, keys, sketches = components(links), None, None
    for last in (False, True):
        open_ = members.filter("members > 2")
        if keys is not None:
            open_ = open_.join(keys, "key", "left_semi")
        known = written(open_.select("key", "node", "n", (F.col("node") == F.col("p")).alias("pivot")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-known")
        if sketches is None:
            sketches = written(_sketches(sets), "minhash-sketches")
        found = written(_searched(known, sketches, similarity, last), "minhash-searched")
        fresh = found.filter("u IS NOT NULL").select("u", "v").distinct()
        for old in checked:
            fresh = fresh.join(old, ["u", "v"], "left_anti")
        fresh = written(fresh, "minhash-pairs")
        forget(known)
        release(spark)
        checked.append(fresh)
        more = written(_linked(fresh, sets, similarity), "minhash-links")
        if not more.isEmpty():
            roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
        release(spark)
        keys = found.filter("key IS NOT NULL").select("key").distinct()
        if keys.isEmpty():
            break
    for t in (members, sets, sketches, *checked):
        forget(t)
    grouped = written(reps.select("d1", "d2", "node", "copies").join(roots, "node", "left").select("d1", "d2", "copies", F.coalesce("root", "node").alias("__class")), "minhash-classes")
    named = join_common(table.filter("n > 0").select("__id", "d1", "d2"), grouped, ["d1", "d2"], "copies", table.count())
    single = table.filter("n = 0").select("__id", F.col("__id").alias("__class"))
    out = named.select("__id", "__class").unionByName(single)
    return out.distinct() if repeated else out


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each class: the row with the least doc_id (and text hash) stays."""
    names, repeated = docs.columns, repeats(docs)
    with_key = keyed(docs, repeated)
    stays = classes(with_key, similarity, repeated=repeated).filter("__id = __class").select("__id")
    kept = with_key.join(stays, "__id", "left_semi")
    if repeated:  # rows may repeat whole
        kept = kept.dropDuplicates(["__id"])
    return kept.select(*names)


def op2_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    repeated = repeats(docs)
    kind = dict(docs.dtypes)["doc_id"]
    docs = keyed(docs, repeated)
    found = classes(docs, repeated=repeated)
    is_copy = (F.col("__id") != F.col("__class")).alias("is_copy")
    if not repeated:
        shown = lambda c, name: F.when(F.col(c) != _NULL_ID, F.col(c)).cast(kind).alias(name)
        return found.select(shown("__id", "doc_id"), shown("__class", "class_id"), is_copy)
    # __id numbers the documents: the class is shown by its least document's doc_id
    found = written(found, "minhash-found")
    sizes = found.groupBy(F.col("__class").alias("__id")).agg(F.count("*").alias("n"))
    least = sizes.join(docs.select("__id", "doc_id").distinct(), "__id").select(F.col("__id").alias("__class"), "n", F.col("doc_id").alias("class_id"))
    named = join_common(found, written(least, "minhash-least"), ["__class"], "n", found.count())
    return docs.select("doc_id", "__id").join(named, "__id").select("doc_id", "class_id", is_copy)


#: Exact: all pairs that share a shingle, and the closure of their links.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
r AS (SELECT doc_id AS a, doc_id AS root FROM documents UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.a)
SELECT a AS doc_id, min(root) AS class_id, min(root) <> a AS is_copy FROM r GROUP BY a
"""
