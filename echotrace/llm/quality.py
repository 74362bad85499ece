"""Quality classifier: gated-attention multiple-instance learning over passages.

A text is a bag of passages of ``PASSAGE`` words (the last may be shorter; one of fewer
than half as many words joins the one before).  A passage is encoded by hashed features
of its words and byte classes, a fixed signed projection and a learned layer.  Gated
attention (a tanh branch times a sigmoid branch) weighs the passages of a text; the
weighted sum of their codes is scored by a logistic unit.  Labels exist for texts only:
attention learns which passages matter.

Training runs on the driver on all passages of at most ``max_train`` labelled texts, those
with the least hash of doc_id; workers turn texts into passages' inputs before the bound
applies, so no task or driver holds the texts.  Scoring uses all passages of every text.
Only the text enters a score.

Defined results: null and empty texts are a bag of one empty passage; ids without a
label, and labels without a text, teach nothing; a doc_id with several labels or rows
teaches once per pair; with no label, or one class only, every score is the share of
label 1 (0.5 without any); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import Words, blocks, crc32_mod, lean

PASSAGE = 48
FEATURES, CODE, HIDDEN = 4096, 48, 32
MAX_TRAIN = 6_000
EPOCHS, BATCH, RATE, DECAY = 14, 64, 3e-3, 1e-4

#: Byte classes of which each passage's shares are features, by their place.
_CLASSES = np.zeros(256, np.int64)
for _k, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), (32,), (10,), (46, 44, 59, 58), (33, 63), (35, 36, 37, 38, 64, 42), (124, 60, 62, 123, 125, 91, 93, 61, 95), range(128, 256))):
    for _b in _bytes:
        _CLASSES[_b] = _k + 1
N_DENSE = 11 + 6


def passages(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of all passages; a text without a word has one empty passage."""
    full = np.maximum(1, (w.count + PASSAGE // 2) // PASSAGE)
    doc = np.repeat(np.arange(len(w.count)), full)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
    first = w.first[doc] + nth * PASSAGE
    last = np.where(nth == full[doc] - 1, w.first[doc + 1], first + PASSAGE)
    return doc, first, last


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each passage, dense features, bucket of each word, passage of each word)."""
    w = Words(data, off)
    doc, first, last = passages(w)
    n = len(doc)
    # a passage's bytes: from its first word, or the text's start, up to the next passage, or the text's end
    new = np.concatenate(([True], doc[1:] != doc[:-1])) if n else np.zeros(0, bool)
    begin = np.where(new, off[doc], w.start[np.minimum(first, len(w.start) - 1)] if len(w.start) else 0)
    end = np.append(begin[1:], len(data))
    end = np.where(np.append(new[1:], True), off[doc + 1], end) if n else end
    size = np.maximum(end - begin, 1)
    owner = np.repeat(np.arange(n), np.maximum(end - begin, 0))
    kinds = np.bincount(owner * 11 + _CLASSES[data], minlength=n * 11).reshape(n, 11) / size[:, None] if len(data) else np.zeros((n, 11))
    words = last - first
    number = np.maximum(words, 1)
    length = np.concatenate(([0], np.cumsum(w.end - w.start)))
    shout = np.concatenate(([0], np.cumsum((w.low[w.start] != w.data[w.start]) & (w.low[w.end - 1] != w.data[w.end - 1])))) if len(w.start) else np.zeros(1)
    passage = np.repeat(np.arange(n), words)
    fresh = np.unique(passage.astype(np.uint64) << np.uint64(40) | w.hash >> np.uint64(24)) >> np.uint64(40) if len(w.hash) else np.zeros(0, np.int64)
    distinct = np.bincount(fresh.astype(np.int64), minlength=n)
    again = np.concatenate(([0], np.cumsum(np.concatenate(([0], (w.hash[1:] == w.hash[:-1]) & (passage[1:] == passage[:-1])))))) if len(w.hash) else np.zeros(1)
    dense = np.concatenate((kinds, np.stack(((length[last] - length[first]) / number / 10, (shout[last] - shout[first]) / number, distinct / number, (again[last] - again[first]) / number, np.minimum(words, PASSAGE) / PASSAGE, np.log1p(w.count[doc]) / 10), axis=1)), axis=1)
    return doc, dense.astype(np.float32), (w.hash >> np.uint64(44)).astype(np.int64) % FEATURES, passage


class Network:
    """Word embedding by a fixed signed projection, a learned code, gated attention and a logistic unit."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.projection = (rng.integers(0, 2, (FEATURES, CODE)) * 2 - 1).astype(np.float32) / np.sqrt(CODE)
        wide = CODE + N_DENSE
        scale = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": scale(wide, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": scale(HIDDEN, HIDDEN), "U": scale(HIDDEN, HIDDEN), "a": scale(HIDDEN, 1), "o": scale(HIDDEN, 1), "c": np.zeros(1, np.float32)}
        self.mean, self.spread = np.zeros(wide, np.float32), np.ones(wide, np.float32)
        self.constant: float | None = None

    def inputs(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text of each passage, its input)."""
        doc, dense, bucket, passage = features(data, off)
        words = np.bincount(passage, minlength=len(doc)) if len(passage) else np.zeros(len(doc), int)
        bags = np.zeros((len(doc), CODE), np.float32)
        on = np.flatnonzero(words)
        if len(on):
            starts = np.cumsum(words) - words
            bags[on] = np.add.reduceat(self.projection[bucket], starts[on], axis=0) / np.sqrt(words[on])[:, None]
        return doc, np.concatenate((bags, dense), axis=1)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p, s = self.p, {}
        s["x"] = (x - self.mean) / self.spread
        s["h"] = np.tanh(s["x"] @ p["W"] + p["b"])
        s["t"], s["g"] = np.tanh(s["h"] @ p["V"]), 1 / (1 + np.exp(-np.clip(s["h"] @ p["U"], -30, 30)))
        e = ((s["t"] * s["g"]) @ p["a"])[:, 0]
        count = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), count))
        s["w"] = e / np.repeat(np.add.reduceat(e, first), count)
        s["z"] = np.add.reduceat(s["w"][:, None] * s["h"], first, axis=0)
        s["y"] = 1 / (1 + np.exp(-np.clip((s["z"] @ p["o"])[:, 0] + p["c"], -30, 30)))
        s["count"] = count
        return s

    def gradient(self, s: dict, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        p = self.p
        d = ((s["y"] - label) * weight / len(label))[:, None]
        g = {"o": s["z"].T @ d, "c": d.sum(axis=0)}
        dz = np.repeat(d @ p["o"].T, s["count"], axis=0)
        dw = (dz * s["h"]).sum(axis=1)
        de = s["w"] * (dw - np.repeat(np.add.reduceat(s["w"] * dw, first), s["count"]))
        dtg = de[:, None] @ p["a"].T
        g["a"] = (s["t"] * s["g"]).T @ de[:, None]
        dt, dg = dtg * s["g"] * (1 - s["t"] ** 2), dtg * s["t"] * s["g"] * (1 - s["g"])
        g["V"], g["U"] = s["h"].T @ dt, s["h"].T @ dg
        dh = (s["w"][:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - s["h"] ** 2)
        g["W"], g["b"] = s["x"].T @ dh, dh.sum(axis=0)
        return {k: g[k] + DECAY * p[k] for k in p}

    def fit(self, bags: list[np.ndarray], label: np.ndarray, seed: int = 9) -> None:
        share = float(label.mean()) if len(label) else 0.5
        if not len(label) or share in (0.0, 1.0):
            self.constant = share
            return
        every = np.concatenate(bags)
        self.mean, self.spread = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(EPOCHS):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), BATCH):
                pick = order[lo : lo + BATCH]
                sizes = np.array([len(bags[i]) for i in pick])
                first = np.cumsum(sizes) - sizes
                g = self.gradient(self.forward(np.concatenate([bags[i] for i in pick]), first), first, label[pick], np.ones(len(pick)))
                step += 1
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.constant is not None or not n:
            return np.full(n, self.constant or 0.0)
        doc, x = self.inputs(data, off)
        return self.forward(x, np.searchsorted(doc, np.arange(n)))["y"].astype(np.float64)


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(h, doc_id, text, y) of at least that many labelled rows, if there are so many: those with the least hashes h of doc_id.

    The share to take comes from a count, so texts outside it are not moved.
    """
    named = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    h = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1 << 20))
    n = named.count()
    named = named.filter(h < int(min(1.0, 1.2 * most / max(n, 1)) * (1 << 20)) + 1)
    return docs.select("doc_id", "text").join(named, "doc_id").select(h.alias("h"), "doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Network:
    net = Network()

    def run(batches):
        for batch in batches:
            rows = []
            for _, _, data, off in blocks(batch.column("text")):
                doc, x = net.inputs(data, off)
                edge = np.searchsorted(doc, np.arange(len(off)))
                rows += [x[a:b].astype(np.float32).tobytes() for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("doc_id"), pa.array(rows, pa.binary()), batch.column("y")], ["h", "doc_id", "x", "y"])

    some = sample(docs, labels, label, max_train)
    bags = some.mapInArrow(lean(run), f"h bigint, doc_id {dict(some.dtypes)['doc_id']}, x binary, y double")
    found = bags.orderBy("h", "doc_id", "y", F.xxhash64("x")).limit(max_train).select("x", "y").toPandas()
    bags = [np.frombuffer(x, np.float32).reshape(-1, CODE + N_DENSE) for x in found["x"]]
    order = np.argsort([b.sum(dtype=np.float64) for b in bags], kind="stable")  # the rows come in any order
    net.fit([bags[i] for i in order], found["y"].to_numpy()[order])
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id and score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            parts = [held.value.score(data, off) for _, _, data, off in blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, score double")


def op8_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc32_mod(F.col("doc_id"), 3) == 1
    net = train(docs, labels.filter(~held_out))
    return score(docs, net).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
