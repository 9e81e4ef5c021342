"""Joins of many rows to one row for each key, where any key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is frequent if it holds more than one in so many rows; fewer keys than this can be.
OFTEN = 10_000


def attached(rows: DataFrame, found: DataFrame, keys: list[str], n: str = "n", often: int = OFTEN, total: int | None = None) -> DataFrame:
    """``rows`` left-joined to ``found``, which has one row for each key and in ``n`` how many of ``rows`` have it.

    Frequent keys, of which there are less than ``often`` whatever the size of the tables, are
    broadcast, so that their rows stay where they are; the rows of all others are shuffled, and no
    key among those has more than one row in ``often``. Keys must not be null; a key that
    ``found`` lacks must not be frequent. ``total`` is the number of ``rows``, counted if not given. Both
    frames are read twice, so they should be written ones.
    """
    total = rows.count() if total is None else total
    frequent = F.col(n) * often > total
    hot, rest = F.broadcast(found.where(frequent).drop(n)), found.where(~frequent).drop(n)
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys, "left")
    return rows.join(hot, keys).unionByName(cold)
