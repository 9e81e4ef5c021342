"""The most frequent values of a table of counts, without sorting it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def most_frequent(counts: DataFrame, size: int, value: str = "word", least: int = 1) -> pa.Table:
    """The ``size`` rows of ``counts`` (``value``, ``n``) with the highest ``n``, highest first, ties by value.

    If not all values of the lowest count fit in, those with the least hashes do: the order of bytes would
    take one alphabet before another. Counts fall into sixteenths of powers of two, hashes into 65,536 bins;
    the driver sees the sizes of bins, those of counts in one bin, and what is returned, with
    at most one bin of hashes more.
    """
    rows = counts.where(F.col("n") >= least).select(value, "n", F.xxhash64(value).alias("hash"))
    power, bins = F.floor(F.log2("n") * 16), F.shiftrightunsigned("hash", 48)
    some, room = _edge(rows, power, size, True)
    if some is not None:
        level = rows.where(power == some)
        n, room = _edge(level, F.col("n"), room, True)
        last, _ = _edge(level.where(F.col("n") == n), bins, room, False)
        rows = rows.where((F.col("n") > n) | ((F.col("n") == n) & (bins <= last)))
    found = rows.select(value, "n", "hash", bins.alias("bin")).toArrow()
    found = found.sort_by([("n", "descending"), ("bin", "ascending"), ("hash", "ascending"), (value, "ascending")]).slice(0, size)
    return found.select([value, "n"]).sort_by([("n", "descending"), (value, "ascending")])


def _edge(rows: DataFrame, key: Column, room: int, falling: bool) -> tuple[int | None, int]:
    """The first key in order whose rows do not all fit in, None if all do, and what room is left for them."""
    sizes = rows.groupBy(key.alias("key")).agg(F.count("*").alias("rows")).collect()
    for found, n in sorted(map(tuple, sizes), reverse=falling):
        if n > room:
            return found, room
        room -= n
    return None, room
