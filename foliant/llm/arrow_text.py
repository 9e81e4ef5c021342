"""Whole texts as Arrow buffers: slicing of batches, words and their fingerprints.

A batch that Spark hands to Python may hold texts of any length, so every user
of this module works through ``pieces``, which bounds the bytes held at a time
(one text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of text that one step works on at a time, unless a single text is longer.
PIECE_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on Spark sends Python batches of about ``PIECE_BYTES`` (one row, if it is longer), unless the session has a limit of its own.

    By default a batch has up to 64 MB, which the executor and its worker both hold while ``pieces`` cuts it.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(PIECE_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start, base = 0, 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            base, start = int(ends[stop - 1]), stop
    pa.default_memory_pool().release_unused()  # a worker process outlives its task


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of each (null: empty)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, dictionary-encoded, and each text's offsets into them.

    Null has no words. ``lower`` lower-cases A-Z and nothing else.
    """
    raw, offs = utf8_buffer(texts)
    if lower:
        raw = raw | (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~blank
    first[1:] &= blank[:-1]
    inner = offs[:-1][(offs[:-1] < len(raw)) & (np.diff(offs) > 0)]
    first[inner] = ~blank[inner]
    last = ~blank
    last[:-1] &= blank[1:]
    last[inner[inner > 0] - 1] = ~blank[inner[inner > 0] - 1]
    starts, ends = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    bounds = np.searchsorted(starts, offs).astype(np.int64)
    # words without the blanks between them are one contiguous buffer again
    solid = np.ascontiguousarray(raw[~blank])
    edges = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=edges[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(solid)])
    return words.dictionary_encode(), bounds


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_fingerprints(words: pa.Array) -> np.ndarray:
    """A 64-bit xxHash for each word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that read ``lengths[i]`` items from ``starts[i]``, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def partial_counts(encoded: Iterator[tuple[pa.Array, np.ndarray]], name: str = "word", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Counts of values, from distinct values and codes of each piece: ``name`` and ``n``.

    About ``most`` distinct values are held; beyond that what is held goes out, so a value
    may come more than once, and the counts are to be summed.
    """
    held: list[pa.Table] = []
    rows = 0

    def total() -> pa.Table:
        return pa.concat_tables(held).group_by(name).aggregate([("n", "sum")]).rename_columns([name, "n"])

    for values, codes in encoded:
        held.append(pa.table({name: values.cast(pa.binary()), "n": np.bincount(codes, minlength=len(values)).astype(np.int64)}))
        rows += len(values)
        if rows > most:
            merged = total()
            held, rows = [merged], merged.num_rows
            if rows > most // 2:
                yield from merged.to_batches()
                held, rows = [], 0
    if held:
        yield from total().to_batches()
