"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded by a byte-level BPE vocabulary and aggregated by their number of
tokens, within tasks first.  The histogram has one row for each length that occurs, so
its size depends on the longest text and not on the number of documents.  Suffix sums
over it give, for every context limit c: how many documents have at least c tokens, how
many tokens those hold, and the tokens that remain if every document is truncated to c.

Suffix sums are taken in ranges of ``SPAN`` lengths: each range is summed on its own,
the ranges' totals are summed after it, and no task sees more than one range or the
list of ranges.

Defined results: null text has no tokens, as has an empty one; a table without rows has
an empty histogram; repeated rows count each; extra columns are ignored by ``histogram``
and kept by ``lengths``, which replaces an ``n_tokens`` that is there.
"""

from __future__ import annotations

import base64
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import written
from .textkit import lean

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPAN = 256
#: A text is encoded in parts of at most about this many characters, cut where the pattern cuts anyway.
PART = 1 << 20

_encoders: dict[int, object] = {}


def _encoder(held):
    data, pattern = held.value
    key = hash((data, pattern))
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def parts(text: str, size: int = PART):
    """The text in parts that encode on their own: cut before a space that stands between two letters."""
    lo = 0
    while len(text) - lo > size:
        cut = lo + size
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs with n_tokens added; a column of that name is replaced."""
    docs = docs.drop("n_tokens")
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    names = docs.columns

    def run(batches):
        encoder = _encoder(held)
        for batch in batches:
            n = [sum(len(encoder.encode_ordinary(p)) for p in parts(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(n, pa.int64())], [*names, "n_tokens"])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType())]))


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs): each task sends one row for each length it met."""
    with open(vocabulary, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))

    def run(batches):
        encoder, seen = _encoder(held), Counter()
        for batch in batches:
            seen.update(sum(len(encoder.encode_ordinary(p)) for p in parts(t)) if t else 0 for t in batch.column("text").to_pylist())
        keys = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(lean(run), "n_tokens bigint, n_docs bigint").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame, span: int = SPAN) -> DataFrame:
    """hist with, for the context limit n_tokens: docs_at_least, tokens_at_least, truncated_tokens, and the rank quantile.

    truncated_tokens is the sum of min(length, limit); docs_below the number of shorter
    documents; quantile the share of documents of at most that length.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    hist = hist.withColumn("__range", F.floor(F.col("n_tokens") / span))
    ranges = hist.groupBy("__range").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    over = Window.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ranges.select("__range", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("__d"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("__t"), F.sum("d").over(every).alias("__docs"), F.sum("t").over(every).alias("__tokens"))
    within = Window.partitionBy("__range").orderBy(F.desc("n_tokens"))
    out = hist.select("*", F.sum("n_docs").over(within).alias("__wd"), F.sum(tokens).over(within).alias("__wt")).join(after, "__range")
    docs, held = F.col("__wd") + F.col("__d"), F.col("__wt") + F.col("__t")
    below = F.col("__docs") - docs
    return out.select(
        "n_tokens",
        "n_docs",
        docs.alias("docs_at_least"),
        held.alias("tokens_at_least"),
        (F.col("__tokens") - held + F.col("n_tokens") * docs).alias("truncated_tokens"),
        ((below + F.col("n_docs")) / F.col("__docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens left, and the documents cut, if every document is truncated to limit tokens."""
    total = F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0))
    return sums.agg(total.alias("truncated_tokens"), F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_cut"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents do not exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def op5_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(written(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "token-histogram"))
