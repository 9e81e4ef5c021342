"""Removal of passages that occur earlier in the corpus.

A window is ``width`` consecutive words of one document. A word goes if a window that
covers it also starts earlier, in a document with a smaller id or at an earlier place of
the same one; windows are judged on the input.

Suffix automata of the whole corpus, shard by shard, would have to be broadcast to all
documents, and both their size and their number grow with the corpus (README.md has the
figures), so windows are matched by key instead, in two passes:

1. Anchors. Of the half-width word runs in a window, the one with the least fingerprint is
   its anchor (winnowing), so a window that occurs twice has an anchor that occurs twice,
   and about one word in six starts an anchor. Anchors are dealt by fingerprint, and those
   that repeat set a bit in a bitmap of bounded size. Equal bits only let windows through
   that the second pass rejects.
2. Windows. Each window whose anchor's bit is set is dealt by an 80-bit key with its place.
   All but the earliest occurrences of a key are sent back to their documents.

Both passes ship packed arrays, a row for each piece of the corpus and bucket, so a passage
in a third of all documents is a few bytes for each of its occurrences; in the second one
each piece settles what repeats within it, and sends only its earliest window of each key.
Texts are shuffled once, when the words that stay are written.

A passage that all texts share takes one entry of each piece for each of its windows, 26 bytes in the bucket
of the window's key. Beyond ``SALT_BYTES`` of text, pieces of about that much meet first and leave one
entry together, so that at 100 TB a key has some 4,000 entries in the first step and 6,000 in the second. The bitmap has a
bit for 8 bytes of text up to 4 GB of it; beyond that more windows than need be are looked at in the second pass.

Ids are integers. Defined cases: null texts have no words; an empty table gives no rows; a
very long text is one piece and is never cut; ties: of equally early windows all stay; documents of fewer words than a
window stay whole; a null id counts as greater than all others; rows that share an id are
equally early, so none of them loses words to the other; blank texts give "". Extra columns
stay, but for those named like added ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrow_text import gather, mix64, pieces, split_words, word_fingerprints

WIDTH = 20
#: Bytes of text for one bucket of keys (there are as many buckets as that takes), and bits of the bitmap at most.
BUCKET_BYTES, MOST_BITS = 8 << 20, 1 << 29
#: Bytes of text whose pieces meet by key first, before what they have left meets that of all others.
SALT_BYTES = 16 << 30
LAST = np.int64((1 << 63) - 1)


def _powers(multiplier: int, n: int) -> np.ndarray:
    steps = np.full(n, multiplier, np.uint64)
    if n:
        steps[0] = 1
    return np.cumprod(steps)


def run_keys(h: np.ndarray, k: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A fingerprint of each run of ``k`` words from their fingerprints ``h``, by differences of one running sum."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(multiplier, len(h)), out=sums[1:])
    back = _powers(pow(multiplier, -1, 1 << 64), n)
    return mix64((sums[k:] - sums[:n]) * back)


def window_starts(bounds: np.ndarray, width: int) -> np.ndarray:
    """Places of words at which a window of their own text starts."""
    lengths = np.maximum(np.diff(bounds) - width + 1, 0)
    return gather(bounds[:-1], lengths)


def anchors(h: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window's anchor, the leftmost of equals, and its fingerprint, scrambled: as least ones, these are low."""
    half = width // 2
    keys = run_keys(h, half)
    best, place = keys[starts], starts.copy()
    for i in range(1, width - half + 1):
        other = keys[starts + i]
        less = other < best
        best[less] = other[less]
        place[less] = starts[less] + i
    return place, mix64(best)


def _deal(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, in which buckets are runs; the buckets that occur, and where their runs start and the last ends."""
    order = np.argsort(key, kind="stable")
    bucket = ((key[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    starts = np.nonzero(np.diff(bucket, prepend=-1))[0]
    return order, bucket[starts], np.append(starts, len(key))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, bounds = split_words(texts, lower=False)
    codes = words.indices.to_numpy(zero_copy_only=False)
    prints = word_fingerprints(words.dictionary)
    return (prints[codes] if len(codes) else np.empty(0, np.uint64)), bounds


def _slices(values: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """Bytes of each slice, all lowest bytes first and all highest last, so that zeros lie together."""
    planes = lambda v: v.view(np.uint8).reshape(len(v), -1).T.tobytes()
    values = np.ascontiguousarray(values)
    return [planes(values[a:b]) if b > a else b"" for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


def _read(blobs, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.frombuffer(b, np.uint8).reshape(size, -1).T for b in blobs]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.empty(0, kind)


def repeated_anchors(docs: DataFrame, text: str, width: int, buckets: int, bits: int, salts: int = 1) -> np.ndarray:
    """A bitmap of ``bits`` bits with those of all anchors that occur more than once; with ``salts``, equal ones of some tasks meet first."""
    per_bucket = max(8, bits // buckets // 8 * 8)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, bounds = _words(batch.column("text"))
            place, key = anchors(h, window_starts(bounds, width), width)
            key = np.sort(key[np.unique(place, return_index=True)[1]])
            key = key[np.concatenate([np.ones(min(2, len(key)), bool), key[2:] != key[:-2]])]  # two of a piece's equals tell that they repeat
            _, some, edges = _deal(key, buckets)
            salt = TaskContext.get().partitionId() % salts
            yield pa.record_batch([pa.array(some), pa.array([salt] * len(some), pa.int32()), pa.array(_slices(key, edges), pa.binary())], ["bucket", "salt", "keys"])

    def repeats(rows: pd.DataFrame) -> pd.DataFrame:
        key = np.sort(_read(rows["keys"], np.uint64))
        twice = key[1:][key[1:] == key[:-1]]
        flags = np.zeros(per_bucket, bool)
        flags[(twice % np.uint64(per_bucket)).astype(np.int64)] = True
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "bitmap": [np.packbits(flags).tobytes()]})

    def fewer(rows: pa.Table) -> pa.Table:
        key = np.sort(_read(rows["keys"].to_pylist(), np.uint64))
        key = key[np.concatenate([np.ones(min(2, len(key)), bool), key[2:] != key[:-2]])]
        return pa.table([rows["bucket"].slice(0, 1), rows["salt"].slice(0, 1), pa.array(_slices(key, np.array([0, len(key)])), pa.binary())], ["bucket", "salt", "keys"])

    schema = "bucket long, salt int, keys binary"
    keys = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(scan, schema)
    if salts > 1:
        keys = keys.groupBy("bucket", "salt").applyInArrow(fewer, schema)
    found = keys.groupBy("bucket").applyInPandas(repeats, "bucket long, bitmap binary")
    bitmap = np.zeros((buckets, per_bucket // 8), np.uint8)
    rows = found.toArrow()  # bounded by MOST_BITS, whatever the corpus
    for bucket, flags in zip(rows["bucket"].to_pylist(), rows["bitmap"].to_pylist(), strict=True):
        bitmap[bucket] = np.frombuffer(flags, np.uint8)
    return bitmap


def _later(key: np.ndarray, extra: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of windows that are later than the earliest of their key, and of the earliest."""
    order = np.lexsort((place, doc, extra, key))
    key, extra, doc, place = key[order], extra[order], doc[order], place[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (extra[1:] != extra[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0)) if len(key) else np.empty(0, np.int64)
    later = (doc != doc[first]) | (place != place[first])
    return order[later], order[~later]


#: The columns of an entry, a window that may repeat, and of rows between the steps.
ENTRY = {"key": np.uint64, "extra": np.uint16, "offsets": np.uint32, "doc": np.int64, "place": np.uint32}
ROW = ["base", "bucket", "salt", "docs", "digests", "bounds", *ENTRY]


def _entries(rows: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The entries of rows of one bucket, and the row of each."""
    blobs = {c: rows[c].to_pylist() for c in ENTRY}
    return {c: _read(blobs[c], kind) for c, kind in ENTRY.items()}, np.repeat(np.arange(rows.num_rows), [len(b) // 8 for b in blobs["key"]])


def _earliest(rows: pa.Table) -> pa.Table:
    """Of one bucket in some of the tasks, a row of what is settled and one of the earliest windows for each piece, so that no key has many entries left."""
    if rows["bucket"][0].as_py() < 0:
        return rows.select(ROW)
    entries, row = _entries(rows)
    later, first = _later(*(entries[c] for c in ("key", "extra", "doc", "place")))
    later, first, every = np.sort(later), np.sort(first), np.arange(rows.num_rows + 1)
    found = _slices(entries["offsets"][later], np.searchsorted(row[later], every))
    left = {c: _slices(v[first], np.searchsorted(row[first], every)) for c, v in entries.items()}
    settled, some = ([i for i, b in enumerate(blobs) if b] for blobs in (found, left["key"]))
    at = pa.array(settled + some, pa.int64())
    base = rows["base"].take(at)
    bucket = [-1 - b for b in base.slice(0, len(settled)).to_pylist()] + rows["bucket"].take(pa.array(some, pa.int64())).to_pylist()
    none = [pa.nulls(len(at), rows.schema.field(c).type) for c in ("docs", "digests", "bounds")]
    blobs = [pa.array([found[i] if c == "offsets" else None for i in settled] + [left[c][i] for i in some], pa.binary()) for c in ENTRY]
    return pa.table([base, pa.array(bucket, pa.int64()), rows["salt"].take(at), *none, *blobs], ROW)


def _resolve(rows: pa.Table) -> pa.Table:
    """Of one bucket, the windows that are later than others, by piece; tables of documents and what is settled pass."""
    names = ["base", "docs", "digests", "bounds", "offsets"]
    if rows["bucket"][0].as_py() < 0:
        return rows.select(names)
    entries, base = _entries(rows)
    key, extra, doc, place = (entries[c] for c in ("key", "extra", "doc", "place"))
    later = np.sort(_later(key, extra, doc, place)[0])
    edges = np.searchsorted(base[later], np.arange(rows.num_rows + 1))
    found = _slices(entries["offsets"][later], edges)
    some = [i for i in range(rows.num_rows) if found[i]]
    none = [pa.nulls(len(some), rows.schema.field(c).type) for c in names[1:4]]
    return pa.table([rows["base"].take(pa.array(some, pa.int64())), *none, pa.array([found[i] for i in some], pa.binary())], names)


def _by_document(rows: pa.Table) -> pa.Table:
    """Of one piece of the corpus, the places of later windows in each document."""
    at = np.sort(_read([b for b in rows["offsets"].to_pylist() if b], np.uint32)).astype(np.int64)
    table = rows.filter(pc.is_valid(rows["docs"])).slice(0, 1).to_pylist()[0]
    bounds = np.array(table["bounds"], np.int64)
    edges = np.searchsorted(at, bounds)
    some = np.nonzero(np.diff(edges))[0].tolist()
    starts = [(at[edges[i] : edges[i + 1]] - bounds[i]).astype(np.uint32).tobytes() for i in some]
    return pa.table([pa.array([table["docs"][i] for i in some], pa.int64()), pa.array([table["digests"][i] for i in some], pa.string()), pa.array(starts, pa.binary())], ["id", "digest", "starts"])


def repeated_windows(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``key`` (id and digest of the text) and ``starts``, packed places (uint32) of windows that occur earlier."""
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    buckets = int(max(24, -(-size // BUCKET_BYTES)))
    bits = int(min(MOST_BITS, max(1 << 16, size // 8)))
    salts = int(max(1, -(-size // SALT_BYTES)))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, text, width, buckets, bits, salts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        bitmap = shared.value
        per_bucket = np.uint64(bitmap.shape[1] * 8)
        for batch in pieces(batches):
            h, bounds = _words(batch.column("text"))
            ids = batch.column("doc").fill_null(int(LAST)).to_numpy(zero_copy_only=False)
            starts = window_starts(bounds, width)
            _, key = anchors(h, starts, width)
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            bit = (key % per_bucket).astype(np.int64)
            starts = starts[(bitmap[bucket, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1]
            key, extra = run_keys(h, width)[starts], (run_keys(h, width, 0xD1342543DE82EF95)[starts] >> np.uint64(48)).astype(np.uint16)
            owner = np.searchsorted(bounds, starts, side="right") - 1
            doc, place = ids[owner], (starts - bounds[owner]).astype(np.uint32)
            later, first = _later(key, extra, doc, place)
            order, some, edges = _deal(key[first], buckets)
            order = first[order]
            parts = [_slices(v[order], edges) for v in (key, extra, starts.astype(np.uint32), doc, place)]
            # the first row has the piece's documents and what is settled in it, the others its earliest windows
            found = np.sort(starts[later]).astype(np.uint32)
            settled = [None, None, _slices(found, np.array([0, len(found)]))[0], None, None]
            table = [pa.array([v] + [None] * len(some), k) for v, k in ((batch.column("doc").to_pylist(), pa.list_(pa.int64())), (batch.column("digest").to_pylist(), pa.list_(pa.string())), (bounds.tolist(), pa.list_(pa.int64())))]
            blobs = [pa.array([s, *p], pa.binary()) for s, p in zip(settled, parts, strict=True)]
            # each piece's own row is a group by itself, so that Spark's hash spreads them over the tasks
            salt = TaskContext.get().partitionId() % salts
            yield pa.record_batch([pa.array([base] * (1 + len(some))), pa.array([-1 - base, *some.tolist()], pa.int64()), pa.array([salt] * (1 + len(some)), pa.int32()), *table, *blobs], ROW)
            base += 1

    schema = "base long, bucket long, salt int, docs array<long>, digests array<string>, bounds array<long>, key binary, extra binary, offsets binary, doc binary, place binary"
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(F.col(doc).cast("long").alias("doc"), digest.alias("digest"), F.col(text).cast("string").alias("text"))
    windows = rows.mapInArrow(scan, schema)
    if salts > 1:
        windows = windows.groupBy("bucket", "salt").applyInArrow(_earliest, schema)
    settled = windows.groupBy("bucket").applyInArrow(_resolve, "base long, docs array<long>, digests array<string>, bounds array<long>, offsets binary")
    of_docs = settled.groupBy("base").applyInArrow(_by_document, "id long, digest string, starts binary")
    return of_docs.groupBy(F.struct("id", "digest").alias("key")).agg(F.min("starts").alias("starts"))


def drop_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``text`` of the words that stay, joined by one space, and n_words and n_removed as long."""
    if width < 2:
        raise ValueError("a window has two words or more")
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in kept], F.struct(F.col(doc).cast("long").alias("id"), digest.alias("digest")).alias("__key"))
    found = repeated_windows(docs, doc, text, width).withColumnRenamed("key", "__key").withColumnRenamed("starts", "__starts")
    joined = rows.join(found, "__key", "left").select(*kept, "__starts")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(text)
        for batch in pieces(batches, text):
            words, bounds = split_words(batch.column(at), lower=False)
            gone = np.zeros(int(bounds[-1]) + 1, np.int64)
            for i, starts in enumerate(batch.column(len(kept)).to_pylist()):
                if starts:
                    places = np.frombuffer(starts, np.uint32).astype(np.int64) + bounds[i]
                    np.add.at(gone, places, 1)
                    np.add.at(gone, places + width, -1)
            stays = np.cumsum(gone)[:-1] == 0
            edges = np.concatenate([[0], np.cumsum(stays)])[bounds]
            left = words.take(pa.array(np.nonzero(stays)[0])).cast(pa.large_binary()).to_pylist()
            texts = [b" ".join(left[a:b]).decode() for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
            n = np.diff(bounds)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
            yield pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array(n - np.diff(edges), pa.int64())], [*kept, "n_words", "n_removed"])

    from pyspark.sql import types as T

    schema = T.StructType([*joined.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(write, schema)
