"""Joins on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Stored

#: A key is hot from this many rows on, or from a thousandth of all rows, whichever is more; so at most 1000 keys are hot.
HOT_ROWS, HOT_KEYS = 20_000, 1000


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row per key and the number ``n`` of the key's rows; ``n`` is dropped.

    Hot keys' groups, of which there are at most ``HOT_KEYS`` whatever the table's size, are sent to the rows, so no task
    gets all rows of a hot key.  All others are joined by exchange.  ``rows`` is read twice and should be a stored table.
    ``total`` is the number of rows.  A null key joins nothing.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    cold = groups.where(F.col(n) < least).drop(n)
    if total < HOT_ROWS:  # no key can be hot
        return rows.join(cold, keys)
    hot = groups.where(F.col(n) >= least).drop(n)
    # hot rows are taken out before the exchange
    return rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys).unionByName(rows.join(F.broadcast(hot), keys))


def with_groups(store: Stored, rows: DataFrame, keys: list[str], name: str, **values: Column) -> DataFrame:
    """``rows``, a stored table, each with aggregates ``values`` of its key's rows.

    Keys that are not hot go by one exchange and a window, whose partitions are bounded by what makes a key hot.  Hot keys'
    aggregates, of which there are at most ``HOT_KEYS``, are sent to their rows.
    """
    total = rows.count()
    least = max(HOT_ROWS, total // HOT_KEYS)
    over = Window.partitionBy(*keys)
    if total >= HOT_ROWS:
        hot = store.put(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n"), f"hot-{name}")
        if not hot.isEmpty():
            groups = rows.join(F.broadcast(hot), keys).groupBy(*keys).agg(*(v.alias(c) for c, v in values.items()))
            cold = rows.join(F.broadcast(hot), keys, "left_anti").withColumns({c: v.over(over) for c, v in values.items()})
            return cold.unionByName(rows.join(F.broadcast(groups), keys))
    return rows.withColumns({c: v.over(over) for c, v in values.items()})
