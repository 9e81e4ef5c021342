"""Compression of vectors to product codes of small integer codebooks.

Components become integers, ``floor(4096 * x)``, and vectors are cut into equal parts, each with a
codebook of at most 16 entries. Codebooks start as the parts of the rows with the smallest ids;
a round assigns every part to the nearest entry and moves entries to the means of what they got.

The nearest entry is found by partial distances: dimensions are taken in descending order of their
variance over the codebook, entries in order of index, and a vector leaves the search for an entry once the
distance that it has so far strictly exceeds its best complete one. So results are those of full distances, with ties to the
lower index. All is integer arithmetic; sums do not depend on how rows are dealt out.

A round reads the integers once and sends, for each task, the sums and counts of all entries, an
array of fixed size. These are added up by a salt of tasks, and the rows of the salts, bounded in number and
size, on the driver. Errors of a label are added up before they are shuffled, and labels
with a large share of the rows are joined by broadcast.

Defined cases: vectors that are null, or hold null or non-finite components, are left out,
as are those of another length than most (of the shorter length, if tied); a length that is no
multiple of the parts is filled up with zeros. Zero vectors take part. A null id comes
after all others, ids that repeat are rows of their own, and rows with the same id come in the order of their vectors.
With fewer rows than entries codebooks are smaller; an empty table gives no rows. Components whose squared
distances would not fit into 63 bits (beyond about 46,000 with 64 dimensions) count as the largest ones that do; the
error of a label that does not fit is null. Null labels are one label. Columns with the names of added ones are
replaced, other extra ones stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .skew import attached
from .storage import checkpointed, release

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that a step works on at a time.
CHUNK = 8_192
SALTS = 256
ADDED = ("code", "error", "label_error", "codebooks_sha256")


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For integer ``vectors`` [n, width] the index of the nearest entry of ``book`` [entries, width], and its squared distance."""
    n, exact = len(vectors), book.astype(object)
    spread = [len(book) * (column * column).sum() - column.sum() ** 2 for column in exact.T]  # n^2 times the variance, without overflow
    dims = sorted(range(book.shape[1]), key=lambda d: (-spread[d], d))
    columns = [np.ascontiguousarray(vectors[:, d]) for d in dims]
    best, found = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    for index, entry in enumerate(book):
        alive, so_far = np.arange(n), np.zeros(n, np.int64)
        for column, d in zip(columns, dims):
            gap = column[alive] - entry[d]
            so_far += gap * gap
            stays = so_far <= best[alive]
            if not stays.all():
                alive, so_far = alive[stays], so_far[stays]
        nearer = so_far < best[alive]
        best[alive[nearer]], found[alive[nearer]] = so_far[nearer], index
    return found, best


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)


def integers(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """The rows whose vectors take part, with ``__ints`` in place of the vector, and how many integers each has."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    length = size["size"] if size else 0
    dims = -(-length // parts) * parts
    most = isqrt(((1 << 63) - 1) // (4 * max(1, dims)))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x * scale, F.lit(-1e15)), F.lit(1e15))), F.lit(most)), F.lit(-most)))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), dims - length)) if dims > length else whole
    return rows.where(F.size(vector) == length).withColumn("__ints", filled).drop(vector), dims


def _assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices [n, parts] and squared distances [n, parts]."""
    width = books.shape[2]
    found = [nearest(vectors[:, p * width : (p + 1) * width], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _added(table: pa.Table) -> pa.Table:
    total = np.stack([np.frombuffer(x, np.int64) for x in table["sums"].to_pylist()]).sum(0)
    return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})


def train(rows: DataFrame, dims: int, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks [part, entry, width] of the integers in ``__ints``; None without rows."""
    first = rows.select(F.col(key).cast("long").alias("key"), "__ints").orderBy(F.col("key").asc_nulls_last(), "__ints").limit(entries).collect()
    if not first:
        return None
    width = dims // parts
    books = np.array([r["__ints"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)

        def summed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            n_parts, n_entries, width = books.shape
            sums = np.zeros((n_parts, n_entries, width + 1), np.int64)
            for batch in _chunks(batches):
                vectors = _matrix(batch.column("__ints"), dims)
                own, _ = _assigned(vectors, books)
                for p in range(n_parts):
                    np.add.at(sums[p, :, :width], own[:, p], vectors[:, p * width : (p + 1) * width])
                    sums[p, :, width] += np.bincount(own[:, p], minlength=n_entries)
            if sums.any():
                salt = TaskContext.get().partitionId() % SALTS
                yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["salt", "sums"])

        sent = rows.select("__ints").mapInArrow(summed, "salt int, sums binary")
        salted = sent.groupBy("salt").applyInArrow(_added, "sums binary").collect()  # SALTS rows of some 9 kB at most
        sums = sum(np.frombuffer(r["sums"], np.int64) for r in salted).reshape(*books.shape[:2], width + 1)
        counts = sums[:, :, width:]
        books = np.where(counts > 0, sums[:, :, :width] // np.maximum(counts, 1), books)
        shared.unpersist()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """The rows that take part without their vectors, with code, error, label_error and codebooks_sha256."""
    kept, dims = integers(rows.drop(*[c for c in ADDED if c not in (key, vector, label)]), vector, parts)
    kept = checkpointed(kept)
    books = train(kept, dims, key, parts, entries, rounds)
    shared = rows.sparkSession.sparkContext.broadcast(books)
    names = [c for c in kept.columns if c != "__ints"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            own, errors = _assigned(_matrix(batch.column("__ints"), dims), shared.value)
            codes = own.astype(np.uint8)
            texts = [row.tobytes().hex() for row in codes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(errors.sum(1))], [*names, "code", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "__ints")
    found = checkpointed(kept.mapInArrow(encoded, f"{fields}, code string, error long").withColumn("__label", F.coalesce(F.concat(F.lit("l"), F.col(label).cast("string")), F.lit(""))))
    release(kept)
    sums = checkpointed(found.groupBy("__label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")))
    whole = attached(found, sums, ["__label"]).drop("__label")
    return whole.withColumn("codebooks_sha256", F.lit(digest(books) if books is not None else None).cast("string"))
