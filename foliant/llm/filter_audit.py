"""How five filters overlap: what each removes in every order, by part and label.

Each document gets five bits, one for each filter that it fails. A table of the 32 sets of
failures by the 120 orders gives the step at which an order removes such a document; a task
looks its documents up in it and adds them up, by ``bincount``, to an array of orders, steps
and labels for each part. Those arrays are summed, first by part and a salt of tasks, then
by part, and all columns follow from the sums: a document that fails a filter is removed by
it or was removed before, at the first step a filter removes all that fail it, at the
last one those that fail it alone.

The filters (words are maximal runs of ``[^\\x20\\x09-\\x0D]``, case-sensitive) fail a text if
A: it has fewer than 200 words; B: under 50 of 100 words are distinct; C: over 3 of 100 code
points are ``A-Z``; D: it holds one of ``#$%&*|``; E: its text is also that of a smaller id.
Equality of texts is that of their SHA-256 digests.

Texts are read once, in pieces; what is shuffled has some 60 bytes a document. Copies of a text are
counted before the shuffle, and texts with a large share of the rows are joined by broadcast.

Defined cases: null text is empty, null part is the empty string, as is an empty one; a null id has no labels, and
neither is its text a copy nor does it make others copies; rows that repeat an id and text are no copies of each other, and each
counts; an id with several labels has each that any of its rows has, null labels count as none; very long texts are
read whole; an empty table gives no rows; extra columns are not looked at. There are no ties: an
order is fixed, and so is the step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrow_text import pieces, split_words, utf8_buffer
from .skew import attached
from .storage import checkpointed

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 3, b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Sums kept for each part, order and step: all documents, good ones, toxic ones. The last step is that of none.
SHAPE = (len(ORDERS), STEPS + 1, 3)
SALTS = 256
#: Parts that a task holds before it sends their arrays on (17 kB each).
HELD_PARTS = 500

_JUDGED = pa.schema([("doc", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("digest", pa.binary())])
_OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def first_failures() -> np.ndarray:
    """[32, 120]: the step, from 0, at which each order removes a document with that set of failures; 5 if it stays."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS)
    for at, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            fails = np.arange(1 << STEPS) >> FILTERS.index(order[step]) & 1 == 1
            table[fails, at] = step
    return table


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    filled = np.diff(offsets) > 0
    out = np.zeros(len(offsets) - 1, np.int64)
    if filled.any():
        out[filled] = np.add.reduceat(flags, offsets[:-1][filled], dtype=np.int64)
    return out


def own_failures(texts: pa.Array) -> np.ndarray:
    """Bits of A to D for each text."""
    raw, offsets = utf8_buffer(texts)
    words, bounds = split_words(texts, lower=False)
    n_words, n = np.diff(bounds), len(texts)
    owner = np.repeat(np.arange(n, dtype=np.int64), n_words)
    size = max(1, len(words.dictionary))
    distinct = np.bincount(np.unique(owner * size + words.indices.to_numpy()) // size, minlength=n)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    upper, points = _sums((raw >= 65) & (raw <= 90), offsets), _sums(raw & 0xC0 != 0x80, offsets)
    failed = [n_words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * n_words, 100 * upper > MAX_UPPER * points, _sums(symbol[raw], offsets) > 0]
    return sum(bits.astype(np.int32) << i for i, bits in enumerate(failed))


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc, part and mask, the bits of the filters that each row fails."""
    slim = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            raw, offsets = utf8_buffer(piece.column("text"))
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([piece.column("doc"), piece.column("part"), pa.array(own_failures(piece.column("text"))), pa.array(digests, pa.binary())], schema=_JUDGED)

    rows = checkpointed(slim.mapInArrow(judge, "doc long, part string, mask int, digest binary"))
    copies = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = F.coalesce(F.col("doc") > F.col("first"), F.lit(False)).cast("int")
    return attached(rows, checkpointed(copies), ["digest"]).select("doc", "part", (F.col("mask") + repeated * (1 << FILTERS.index("E"))).alias("mask"))


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One array for each part of the task's documents."""
    first, held = first_failures(), {}
    order = np.arange(len(ORDERS))
    salt = TaskContext.get().partitionId() % SALTS

    def sent() -> pa.RecordBatch:
        flat = np.concatenate(list(held.values()))
        sums = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * np.prod(SHAPE, dtype=np.int32), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), sums], ["part", "salt", "sums"])

    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        masks, weights = batch.column("mask").to_numpy(), batch.column("n").to_numpy()
        flags = [np.ones(len(masks), np.int64), *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("good", "toxic"))]
        sets = parts.indices.to_numpy() * 32 + masks
        counts = np.stack([np.bincount(sets, weights * flag, 32 * len(parts.dictionary)) for flag in flags])  # exact below 2^53
        for i, part in enumerate(parts.dictionary.to_pylist()):
            counted = counts[:, 32 * i : 32 * i + 32]
            seen = np.flatnonzero(counted[0])
            cells = (order * (STEPS + 1) + first[seen]).ravel()
            sums = [np.bincount(cells, np.repeat(c[seen], len(ORDERS)), len(ORDERS) * (STEPS + 1)) for c in counted]
            sums = np.stack(sums, 1).astype(np.int64).ravel()
            held[part] = held[part] + sums if part in held else sums
        if len(held) > HELD_PARTS:
            yield sent()
            held.clear()
    if held:
        yield sent()


def _added(table: pa.Table) -> np.ndarray:
    return table["sums"].combine_chunks().flatten().to_numpy().reshape(-1, np.prod(SHAPE)).sum(0)


def _added_by_salt(table: pa.Table) -> pa.Table:
    total = _added(table)
    return pa.table({"part": table["part"][:1], "sums": pa.array([total], pa.list_(pa.int64()))})


def _reported(table: pa.Table) -> pa.Table:
    """All rows of one part."""
    removed, good, toxic = np.moveaxis(_added(table).reshape(SHAPE), 2, 0)
    n = removed.sum(1)[0]
    own = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    at_first, at_last, shapley = np.zeros(STEPS, np.int64), np.zeros(STEPS, np.int64), np.zeros(STEPS, np.int64)
    at_first[own[:, 0]], at_last[own[:, -1]] = removed[:, 0], removed[:, STEPS - 1]
    np.add.at(shapley, own, removed[:, :STEPS])
    gone = removed[:, :STEPS]
    columns = {"kept": n - gone.cumsum(1), "removed": gone, "redundant": at_first[own] - gone, "unique_fails": at_last[own], "good_lost": good[:, :STEPS], "toxic_lost": toxic[:, :STEPS], "shapley": shapley[own]}
    rows = len(ORDERS) * STEPS
    head = {"part": pa.array(table["part"][:1].to_pylist() * rows, pa.string()), "filter_order": np.repeat(ORDERS, STEPS), "step": np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))}
    return pa.table(head | {k: pa.array(v.ravel(), pa.int64()) for k, v in columns.items()})


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row for each part, order of filters and step."""
    marks = labels.groupBy(F.col(key).cast("long").alias("doc")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = judged(docs, key, text, part).groupBy("doc", "part", "mask").agg(F.count("*").alias("n"))
    marked = rows.join(marks, "doc", "left").select("part", "mask", "n", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    sums = checkpointed(marked.mapInArrow(_tallied, "part string, salt int, sums array<long>"))
    salted = sums.groupBy("part", "salt").applyInArrow(_added_by_salt, "part string, sums array<long>")
    return salted.groupBy("part").applyInArrow(_reported, _OUT)
