"""Language identification: which languages a text mixes, by expectation-maximisation.

Each language has a smoothed distribution over hashed byte trigrams of lower-cased
words, counted over all training texts.  A word's likelihood in a language is that of
its trigrams.  A text is a mixture: expectation-maximisation over its words estimates
the proportion of each language.  Sets of the 1, 2, ... leading languages are refitted,
and the one with the best likelihood less ``penalty`` times half the logarithm of the
word count for each language beyond the first is kept.  The prediction is the language
with the largest proportion in that set (ties: the first in alphabetical order), the
score its proportion.

Defined results: null text, and text without a letter, is ``und`` with score 0; so is
everything if nothing can be learned; repeated rows are each predicted; texts of any
length count whole; extra columns are ignored.  There is no bound on the number of
languages of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import LETTER, Words, blocks, crc32_mod, lean

BITS = 16
SMOOTHING = 0.5
ROUNDS, REFITS, PENALTY = 8, 3, 2.0


def trigrams(w: Words) -> np.ndarray:
    """Bucket of the trigram that starts one byte before each byte, where bytes between words read as spaces."""
    c = np.full(len(w.low) + 2, 32, np.uint32)
    c[1:-1] = np.where(LETTER[w.data], w.low, 32)
    first = w.off[:-1][np.diff(w.off) > 0]
    before, after = c[:-2].copy(), c[2:].copy()
    before[first] = 32
    after[w.off[1:][np.diff(w.off) > 0] - 1] = 32
    with np.errstate(over="ignore"):
        return ((before << np.uint32(16) | c[1:-1] << np.uint32(8) | after) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


class Model:
    """Log-probabilities of trigram buckets, one row for each language."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def word_logs(self, w: Words) -> np.ndarray:
        grams = trigrams(w)
        out = np.empty((len(self.languages), len(w.start)))
        total = np.empty(len(grams) + 1)
        total[0] = 0
        for k, row in enumerate(self.logs):
            np.cumsum(row[grams], dtype=np.float64, out=total[1:])
            out[k] = total[w.end] - total[w.start]
        return out


def mixture(logs: np.ndarray, count: np.ndarray, rounds: int = ROUNDS, refits: int = REFITS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions, languages by texts, of texts of count (at least one) words with the given log-likelihoods."""
    langs, texts = logs.shape[0], len(count)
    like = np.exp(logs - logs.max(axis=0)).astype(np.float32)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))

    def refine(share: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        for step in range(times + 1):
            joint = like * np.repeat(share, count, axis=1)
            total = np.maximum(joint.sum(axis=0), np.float32(1e-30))
            if step == times:
                return share, np.add.reduceat(np.log(total, dtype=np.float64), first)
            share = (np.add.reduceat(joint / total, first, axis=1) / count).astype(np.float32)

    full, _ = refine(np.full((langs, texts), 1 / langs, np.float32), rounds)
    # leading languages first; the sort is stable, so ties go in order
    lead = np.argsort(-full, axis=0, kind="stable")
    place = np.empty_like(lead)
    np.put_along_axis(place, lead, np.arange(langs)[:, None].repeat(texts, 1), 0)
    best, best_value = full, np.full(texts, -np.inf)
    for size in range(1, langs + 1):
        # a word's likelihood is at most that of its best language, here 1: no larger set can be better where this holds
        if (best_value >= -penalty * (size - 1) * 0.5 * np.log(np.maximum(count, 2))).all():
            break
        start = np.where(place < size, np.maximum(full, 1e-6), 0).astype(np.float32)
        share, value = refine(start / start.sum(axis=0), refits if size > 1 else 0)
        value = value - penalty * (size - 1) * 0.5 * np.log(np.maximum(count, 2))
        better = value > best_value
        best = np.where(better, share, best)
        best_value = np.where(better, value, best_value)
    return best


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all given texts; each task sends its sums."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, data, off in blocks(batch.column("text")):
                w = Words(data, off, LETTER)
                if not len(w.start):
                    continue
                grams = trigrams(w)
                inside = LETTER[data]
                owner = np.repeat(np.arange(hi - lo), np.diff(off))[inside]
                names, code = np.unique(np.array(langs[lo:hi], object), return_inverse=True)
                table = np.bincount(code[owner].astype(np.int64) << BITS | grams[inside], minlength=len(names) << BITS).reshape(len(names), -1)
                for name, row in zip(names, table):
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "bucket", "n"])

    return docs.select("text", "lang").mapInArrow(lean(run), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """A model of the languages named in lang.  What reaches the driver is at most 2**BITS sums for each of them."""
    rows = count_trigrams(docs.filter("lang IS NOT NULL AND text IS NOT NULL")).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), 1 << BITS))
    counts[np.searchsorted(languages, rows["lang"]), rows["bucket"]] = rows["n"]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1]) if languages else counts
    return Model(languages, logs.astype(np.float32))


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = LETTER.copy()
    ascii_letter[128:] = False
    total = np.concatenate(([0], np.cumsum(ascii_letter[data])))
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode(errors="ignore"))
    return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the proportions above 0.001 of each text."""
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        own = Model(*held.value)
        names = pa.array(own.languages, pa.string())
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, -1), np.zeros(n)
            shares: list[list[tuple[str, float]]] = [[] for _ in range(n)]
            for lo, hi, data, off in blocks(batch.column("text")):
                w = Words(data, off, LETTER)
                on = np.flatnonzero(w.count)
                if not len(on) or not own.languages:
                    continue
                share = mixture(own.word_logs(w), w.count[on]).astype(np.float64)
                ok = has_letter(data, off)[on]
                top = share.argmax(axis=0)
                pred[lo + on[ok]] = top[ok]
                score[lo + on[ok]] = np.clip(share[top, np.arange(len(on))][ok], 0, 1)
                for k, i in zip(*np.nonzero((share > 0.001) & ok)):
                    shares[lo + on[i]].append((own.languages[k], float(share[k, i])))
            lang = names.take(pa.array(np.maximum(pred, 0))) if own.languages else pa.nulls(n, pa.string())
            lang = pa.array(["und" if p < 0 else x for p, x in zip(pred.tolist(), lang.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lang, pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, lang_pred string, score double, shares map<string, double>")


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text has a letter and fits a learned language better than chance.

    Chance is the uniform distribution over trigram buckets; the fit is the mean
    log-likelihood per trigram under the proportions that expectation-maximisation finds.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.languages, model.logs))
    chance = -BITS * float(np.log(2))

    def run(batches):
        own = Model(*held.value)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, _, data, off in blocks(batch.column("text")):
                w = Words(data, off, LETTER)
                on = np.flatnonzero(w.count)
                if not len(on) or not own.languages:
                    continue
                logs = own.word_logs(w)
                count = w.count[on]
                top = logs.max(axis=0)
                share = np.repeat(mixture(logs, count), count, axis=1)
                fit = np.log(np.maximum((share * np.exp(logs - top)).sum(axis=0), 1e-30)) + top
                first = np.concatenate(([0], np.cumsum(count)[:-1]))
                mean = np.add.reduceat(fit, first) / np.add.reduceat(w.end - w.start, first)
                keep[lo + on] = (mean > chance) & has_letter(data, off)[on]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)
