"""Joins by keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold at least a 1 / SHARE part of the rows are broadcast; so there are at most SHARE of them.
SHARE = 1024


def join_common(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int, share: int = SHARE) -> DataFrame:
    """rows with the columns of per_key, inner.

    per_key has one row for each key, and in n how many of the total rows hold that key.
    Rows with a common key are joined where they are, by a broadcast of at most share
    rows; the others by a shuffle in which no key is large.  per_key should be a written
    table: it is read once more, to see which keys are common (at most share hashes).
    """
    key = F.xxhash64(*keys)
    common = [r[0] for r in per_key.filter(F.col(n) * share >= F.lit(total)).select(key).collect()]
    if not common:
        return rows.join(per_key, keys).select(*rows.columns, *[c for c in per_key.columns if c not in keys])
    here = rows.filter(key.isin(common)).join(F.broadcast(per_key.filter(key.isin(common))), keys)
    rest = rows.filter(~key.isin(common)).join(per_key.filter(~key.isin(common)), keys)
    names = [*rows.columns, *[c for c in per_key.columns if c not in keys]]
    return here.select(*names).unionByName(rest.select(*names))
