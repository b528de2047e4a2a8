"""Equi-joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in this many of the rows: so there are fewer hot keys than this.
HOT_KEYS = 1000
#: No key of fewer rows is hot.
LEAST_ROWS = 1000


def hot_keys(many: DataFrame, key: str, rows: int | None = None) -> list:
    """The keys (fewer than HOT_KEYS) that hold more than their share of the rows, if known about so many."""
    rows = many.count() if rows is None else rows
    if rows <= LEAST_ROWS:
        return []
    heavy = many.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_of_key")).filter(F.col("rows_of_key") > max(LEAST_ROWS, rows // HOT_KEYS))
    return [bytes(r[0]) if isinstance(r[0], bytearray) else r[0] for r in heavy.select(key).collect()]


def join_unique(many: DataFrame, one: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """``many`` joined (inner or left) with ``one``, which has a row for each key at most.

    Rows of hot keys meet their one row by broadcast, where they are; the
    others are shuffled, and no task gets more than its share of them.  The
    broadcast holds fewer than HOT_KEYS rows.  ``many`` is read up to four
    times: give a written table, or the hot keys if they are known.
    """
    hot = hot_keys(many, key) if hot is None else hot
    if not hot:
        return many.join(one, key, how)
    heavy = F.col(key).isin(hot)
    met = many.filter(heavy).join(F.broadcast(one.filter(heavy)), key, how)
    return met.unionByName(many.filter(~heavy | F.col(key).isNull()).join(one, key, how))
