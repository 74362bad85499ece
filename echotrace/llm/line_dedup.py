"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling, in DataFrame operations only.

1. Every distinct line that occurs more than once gets a rank; a line that occurs once
   starts no repeated run and takes no further part.
2. Doubling: the rank of the 2h lines from a place is that of the pair (rank of the
   first h lines, rank of the next h).  Only pairs that occur more than once are ranked,
   so each round handles the places that still repeat, and the rounds go on until none
   does.  Ranks follow the order of the pairs: distinct pairs are range-partitioned and
   sorted, and numbered in place, so no rank needs a sort of all places.  Where doubling
   would pass ``min_lines``, two overlapping halves meet it exactly.
3. The places of one rank at depth h are neighbours in the suffix array: an interval
   whose common prefixes are at least h lines long.  Intervals of depth ``min_lines`` or
   more show the repeated runs.  The earliest place of an interval (by doc_id, then
   position) is the original; every other one starts a later copy of h lines.  The
   copies of all depths merge to maximal repeated runs, and those are deleted.

Documents do not share runs across their borders.  Lines end at ``\\n``.  Pairs that
hold a large part of a round's places are ranked where these are (see ``joins``).

Defined results: null text has no line and stays null; an empty text is one empty line;
rows that repeat doc_id and text are one document; a text of which every line is deleted
is empty; extra columns are kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import join_common
from .spans import keyed
from .store import forget, release, written

MIN_LINES = 2
#: Places of a round from which its common pairs are joined where they are; fewer rows are one small shuffle.
SMALL = 100_000
PLACE = ("__id", "pos")


def intervals(pairs: DataFrame) -> DataFrame:
    """(a, b, n, first, rank) of the (a, b) that occur more than once: their places' number and earliest, ranks in their order."""
    groups = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).filter("n > 1")
    return groups.repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id())


def ranked(pairs: DataFrame, total: int) -> DataFrame:
    """(place, rank, later) of the places whose pair repeats; later: not the earliest place of its interval."""
    if total < SMALL:
        both = pairs.join(intervals(pairs), ["a", "b"])
    else:
        both = join_common(pairs, written(intervals(pairs), "line-intervals"), ["a", "b"], "n", total)
    return both.select(*PLACE, "rank", (F.struct(*PLACE) != F.col("first")).alias("later"))


def suffix_array(docs: DataFrame, min_lines: int = MIN_LINES) -> Iterator[tuple[int, DataFrame]]:
    """Round by round, a depth and the (place, rank, later, next) of all places whose next depth lines repeat.

    next is the rank of the lines after those that the next round looks at, where they repeat too.  docs must be keyed().
    """
    line = F.col("line")
    rows = docs.select("__id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    pairs = first = written(rows.select(*PLACE, F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b")), "line-ids")
    depth = 1
    while total := pairs.count():
        step = min(depth, min_lines - depth) if depth < min_lines else depth
        there = Window.partitionBy("__id").orderBy("pos").rangeBetween(step, step)
        places = written(ranked(pairs, total).withColumn("next", F.max("rank").over(there)), "line-places")
        if depth == 1:
            forget(first)
        if total >= SMALL:
            release(docs.sparkSession)
        yield depth, places
        pairs = places.filter("next IS NOT NULL").select(*PLACE, F.col("rank").alias("a"), F.col("next").alias("b"))
        depth += step


def runs(copies: DataFrame) -> DataFrame:
    """(__id, __runs) with the maximal runs of deleted lines of each document, in order, from (__id, pos, end) of copies."""
    own = Window.partitionBy("__id").orderBy("pos", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    starts = copies.select("__id", "pos", "end", F.coalesce(F.col("pos") > reach, F.lit(True)).alias("begins"))
    numbered = starts.withColumn("run", F.sum(F.col("begins").cast("int")).over(own))
    each = numbered.groupBy("__id", "run").agg(F.min("pos").alias("start"), (F.max("end") - 1).alias("end"))
    return each.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__runs"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(__id, __runs: array of (start, end)): the maximal runs that are later copies; docs must be keyed()."""
    copies, tables = None, []
    for depth, places in suffix_array(docs, min_lines):
        tables.append(places)
        if depth >= min_lines:
            own = places.filter("later").select("__id", "pos", (F.col("pos") + depth).alias("end"))
            copies = own if copies is None else copies.unionByName(own)
    if copies is None:
        return docs.select("__id", F.array().cast("array<struct<start: int, end: int>>").alias("__runs")).filter("false")
    found = written(runs(copies), "line-runs")
    for t in tables:
        forget(t)
    release(docs.sparkSession)
    return found


def with_runs(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Keyed docs with __lines, __runs and __kept (the lines that stay) added."""
    both = docs.join(repeated_runs(docs, min_lines), "__id", "left")
    both = both.withColumn("__lines", F.split("text", "\n")).withColumn("__runs", F.coalesce("__runs", F.array().cast("array<struct<start: int, end: int>>")))
    count = F.size("__runs")

    def between(k):
        """The lines after run k - 1 and before run k."""
        start = F.when(k == 0, 0).otherwise(F.get("__runs", k - 1)["end"] + 1)
        end = F.when(k == count, F.size("__lines")).otherwise(F.get("__runs", k)["start"])
        return F.slice("__lines", start + 1, F.greatest(end - start, F.lit(0)))

    kept = F.when(count == 0, F.col("__lines")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), count), between)))
    return both.withColumn("__kept", kept)


def dedup(docs: DataFrame, min_lines: int = MIN_LINES, drop_emptied: bool = False) -> DataFrame:
    """docs without the later copies of repeated line runs; drop_emptied leaves out texts that lost every line."""
    out = with_runs(keyed(docs), min_lines)
    if drop_emptied:
        out = out.filter("__kept IS NULL OR size(__runs) = 0 OR size(__kept) > 0")
    text = F.when(F.size("__runs") == 0, F.col("text")).otherwise(F.array_join("__kept", "\n"))
    return out.withColumn("text", text).select(*docs.columns)


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_runs(keyed(docs))
    n_lines, n_kept = F.coalesce(F.size("__lines"), F.lit(0)), F.coalesce(F.size("__kept"), F.lit(0))
    n_lines, n_kept = (F.greatest(x, F.lit(0)).cast("bigint") for x in (n_lines, n_kept))
    return out.select(
        "doc_id",
        n_lines.alias("n_lines"),
        (n_lines - n_kept).alias("n_deleted"),
        F.size("__runs").cast("bigint").alias("n_runs"),
        F.sha2(F.coalesce(F.array_join("__kept", "\n"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP6_SQL = """
WITH l AS (
  SELECT doc_id, i - 1 AS pos, s[i] AS line
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))),
w AS (SELECT doc_id, pos, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM l),
c AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, pos) AS n FROM w WHERE b IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS pos FROM c WHERE n > 1),
m AS (SELECT l.doc_id, l.pos, l.line, gone.pos IS NOT NULL AS del, coalesce(lag(gone.pos IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.pos), false) AS before
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE del) AS n_deleted, count(*) FILTER (WHERE del AND NOT before) AS n_runs,
      string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT del) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""
