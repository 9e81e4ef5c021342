"""Packing of token ids in rows of fixed length by best fit decreasing, as binary columns.

Texts longer than a row are split without loss: whole rows first, then a rest. In each
group of a bounded number of tokens the pieces go, longest first, to the open row whose
free capacity is the least that suffices; a segment tree over capacities finds it. A row
holds its ids as one little-endian array, filled up with the padding id, the cumulative
lengths of its segments (from 0), and the places at which positions start anew.

Each task encodes and packs what it reads: nothing is shuffled. A row's segments name
document, piece and input row, so documents can be put together again (``unpack``).
``write_packed`` writes flat files that trainers map into memory.

Defined cases: null and empty texts have no tokens and no segment; repeated rows are
packed as often as they occur, and ``unpack`` gives each of them back; a null id stays
null; ties of length go by order; a very long text fills whole rows and a rest, however many;
an empty table gives no rows and no files but an empty manifest. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .arrow_text import gather, pieces
from .bpe import character_classes, worker_codec

ROW_TOKENS = 2_048
#: Tokens that are packed together; at least as many as a single text has.
GROUP_TOKENS = 2 << 20


class CapacityTree:
    """Open rows by free capacity; finds the least capacity that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A row of the least capacity from ``least`` on, and that capacity; the row is taken out."""
        count, node = self.count, self.leaves + least
        while not count[node]:
            while node & 1:  # a right child: nothing greater below its parent
                node >>= 1
                if not node:
                    return None
            node += 1
            if node == 1 or node & (node - 1) == 0:
                return None
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        row = self.rows[capacity].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return row, capacity


def best_fit_decreasing(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Indices of pieces by row. Pieces are taken by falling length, then by index."""
    tree, rows = CapacityTree(row), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n) if n < row else None
        if found is None:
            rows.append([i])
            at, free = len(rows) - 1, row - n
        else:
            at, free = found[0], found[1] - n
            rows[at].append(i)
        if free:
            tree.put(at, free)
    return rows


def pack_group(docs: pa.Array, first: int, ids: np.ndarray, bounds: np.ndarray, row: int, pad: int, kind: str) -> pa.RecordBatch:
    """Rows for a group of encoded texts, which are numbered from ``first``."""
    lengths = np.diff(bounds)
    n_pieces = -(-lengths // row)
    owner = np.repeat(np.arange(len(lengths)), n_pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    starts = bounds[:-1][owner] + row * number
    sizes = np.minimum(row, bounds[1:][owner] - starts)
    packed = best_fit_decreasing(sizes, row)
    order = np.fromiter((i for r in packed for i in r), np.int64, len(owner))
    per_row = np.fromiter(map(len, packed), np.int64, len(packed))
    edges = np.concatenate([[0], np.cumsum(per_row)])
    total = np.concatenate([[0], np.cumsum(sizes[order])])
    matrix = np.full((len(packed), row), pad, kind)
    place = gather(row * np.repeat(np.arange(len(packed)), per_row) + total[:-1] - total[edges[:-1]].repeat(per_row), sizes[order])
    matrix.reshape(-1)[place] = ids[gather(starts[order], sizes[order])]
    cumulative = np.concatenate([np.r_[0, total[a + 1 : b + 1] - total[a]] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]) if len(packed) else np.empty(0)
    offsets = pa.array(edges.astype(np.int32))
    segments = pa.StructArray.from_arrays([docs.take(pa.array(owner[order])), pa.array(number[order].astype(np.int32)), pa.array(first + owner[order])], ["doc", "piece", "row"])
    resets = (total[:-1] - total[edges[:-1]].repeat(per_row)).astype(np.int32)
    return pa.record_batch(
        [
            pa.array([matrix[i].tobytes() for i in range(len(packed))], pa.binary()),
            pa.ListArray.from_arrays(pa.array((edges + np.arange(len(edges))).astype(np.int32)), pa.array(cumulative.astype(np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(resets)),
            pa.ListArray.from_arrays(offsets, segments),
        ],
        ["ids", "cu_seqlens", "resets", "segments"],
    )


def pack(docs: DataFrame, vocabulary_path: str, row: int = ROW_TOKENS, doc: str = "doc_id", text: str = "text", group_tokens: int = GROUP_TOKENS, pad: int | None = None, end: int | None = None) -> DataFrame:
    """Packed rows of all texts: ids (binary, of 2 or 4 bytes each), cu_seqlens, resets and segments (doc, piece, row).

    ``pad`` fills rows up (the file's first special token if None), and ``end`` is put
    behind every text that has tokens, if given.
    """
    if row < 1:
        raise ValueError("a row needs room for a token")
    with open(vocabulary_path, "rb") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((content, character_classes()))
    id_kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared, shared.value[0], classes=shared.value[1])
        special = codec.vocabulary.special
        fill = pad if pad is not None else min(special.values(), default=0)
        kind = "<u2" if len(codec.vocabulary.tokens) <= 1 << 16 else "<u4"
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        n, first = 0, TaskContext.get().partitionId() << 40

        def flush() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, _, b in held]))]).astype(np.int64)
            return pack_group(pa.concat_arrays([d for d, _, _ in held]), first, np.concatenate([i for _, i, _ in held]), bounds, row, fill, kind)

        for batch in pieces(batches):
            ids, bounds = codec.encode(batch.column("text"))
            if end is not None:
                some = np.nonzero(np.diff(bounds))[0]
                ids = np.insert(ids, bounds[some + 1], end)
                bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
            held.append((batch.column("doc"), ids, bounds))
            n += len(ids)
            if n >= group_tokens:
                yield flush()
                first += sum(len(d) for d, _, _ in held)
                held, n = [], 0
        if n:
            yield flush()

    rows = docs.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"ids binary, cu_seqlens array<int>, resets array<int>, segments array<struct<doc: {id_kind}, piece: int, row: bigint>>")


def _folder(path: str) -> str:
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory maps need a folder that all executors have mounted, not {path}")
    return unquote(parts.path)


def write_packed(packed: DataFrame, path: str, width: int = 2) -> None:
    """Write rows as flat little-endian files for memory maps, a set of files for each task.

    ``<name>.ids`` is the matrix of ids (``width`` bytes each), ``<name>.cu_seqlens`` (int32)
    the cumulative lengths of all rows one after the other, ``<name>.resets`` (int32) the
    places at which positions start anew, ``<name>.rows`` (int64) where each row's resets
    start and the last one's end (a row's cumulative lengths start one further for each row before it), and
    ``<name>.segments.parquet`` has the segments' documents. ``path`` is a folder that all
    executors have mounted. A task's files have a name of their own for each attempt, and
    ``manifest.json``, put there in one step at the end, lists those that count. Then files of
    this write's lost attempts are removed, and those that the manifest before this one listed; files of other
    writes that are still running stay. Of two writes to one folder the later manifest counts.
    """
    folder, own_prefix = _folder(path), f"part-{uuid.uuid4().hex[:12]}-"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, rows, tokens, length, at = f"{own_prefix}{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", hashlib.sha256(), 0, 0, 0, 0
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        os.makedirs(folder, exist_ok=True)
        base = os.path.join(folder, name)
        kind = first.schema.field("segments").type.value_type
        with open(f"{base}.ids", "wb") as ids, open(f"{base}.cu_seqlens", "wb") as cu, open(f"{base}.resets", "wb") as resets, open(f"{base}.rows", "wb") as starts, pq.ParquetWriter(f"{base}.segments.parquet", pa.schema(list(kind))) as segments:
            starts.write(np.zeros(1, "<i8").tobytes())
            for batch in (b for part in ([first], batches) for b in part):
                blobs = batch.column("ids").to_pylist()
                length = len(blobs[0]) // width
                for blob in blobs:
                    ids.write(blob)
                    digest.update(blob)
                lengths, own = batch.column("cu_seqlens"), batch.column("resets")
                cu.write(lengths.flatten().to_numpy().astype("<i4").tobytes())
                resets.write(own.flatten().to_numpy().astype("<i4").tobytes())
                counts = np.cumsum(np.array([len(r) for r in own.to_pylist()], "<i8")) + at
                starts.write(counts.astype("<i8").tobytes())
                at = int(counts[-1])
                segments.write_table(pa.table({f.name: batch.column("segments").flatten().field(i) for i, f in enumerate(kind)}))
                rows += len(blobs)
                tokens += sum(v[-1] for v in lengths.to_pylist())
            for file in (ids, cu, resets, starts):
                file.flush()
                os.fsync(file.fileno())
        yield pa.record_batch([pa.array([name]), pa.array([rows]), pa.array([tokens]), pa.array([length]), pa.array([digest.hexdigest()])], ["name", "rows", "tokens", "row", "sha256"])

    before = _manifest(folder)["parts"] if os.path.exists(os.path.join(folder, "manifest.json")) else []
    parts = sorted(packed.mapInArrow(run, "name string, rows long, tokens long, row long, sha256 string").collect())  # a row for each task
    os.makedirs(folder, exist_ok=True)
    manifest = os.path.join(folder, "manifest.json")
    with open(f"{manifest}.new", "w") as file:
        json.dump({"bytes_per_id": width, "parts": [p.asDict() for p in parts]}, file)
        file.flush()
        os.fsync(file.fileno())
    os.replace(f"{manifest}.new", manifest)
    named, replaced = {p["name"] for p in parts}, {p["name"] for p in before}
    for file in os.listdir(folder):
        part = file.split(".")[0]
        if part in replaced or part.startswith(own_prefix) and part not in named:
            os.unlink(os.path.join(folder, file))


def _manifest(folder: str) -> dict:
    with open(os.path.join(folder, "manifest.json")) as file:
        return json.load(file)


def read_packed(path: str) -> Iterator[dict[str, np.ndarray]]:
    """Memory maps of each written part: ids [row, place], cu_seqlens, resets and rows."""
    folder = _folder(path)
    manifest = _manifest(folder)
    for part in manifest["parts"]:
        yield _maps(folder, part["name"], part["rows"], part["row"], manifest["bytes_per_id"])


def _maps(folder: str, name: str, rows: int, row: int, width: int) -> dict[str, np.ndarray]:
    base = os.path.join(folder, name)
    maps = {"ids": np.memmap(f"{base}.ids", f"<u{width}", "r").reshape(rows, row)}
    return maps | {kind: np.memmap(f"{base}.{kind}", of, "r") for kind, of in (("cu_seqlens", "<i4"), ("resets", "<i4"), ("rows", "<i8"))}


def packed_table(spark: SparkSession, path: str, doc: str = "long") -> DataFrame:
    """The rows that ``write_packed`` put in ``path``, as ``pack`` gives them; ``doc`` is the type of the documents' ids."""
    folder = _folder(path)
    manifest = _manifest(folder)
    width = manifest["bytes_per_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                maps = _maps(folder, part["name"], part["rows"], part["row"], width)
                segments = pq.read_table(os.path.join(folder, f"{part['name']}.segments.parquet")).combine_chunks()
                segments = segments.to_struct_array().combine_chunks()
                for at in range(0, part["rows"], 512):
                    to = min(at + 512, part["rows"])
                    ends = maps["rows"][at : to + 1]
                    offsets, longer = ends - ends[0], ends + np.arange(at, to + 1)
                    lists = [pa.ListArray.from_arrays(pa.array((longer - longer[0]).astype(np.int32)), pa.array(maps["cu_seqlens"][longer[0] : longer[-1]]))]
                    lists += [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values) for values in (pa.array(maps["resets"][ends[0] : ends[-1]]), segments.slice(int(ends[0]), int(offsets[-1])))]
                    yield pa.record_batch([pa.array([r.tobytes() for r in maps["ids"][at:to]], pa.binary()), *lists], ["ids", "cu_seqlens", "resets", "segments"])

    parts = spark.createDataFrame([(p["name"], p["rows"], p["row"]) for p in manifest["parts"]], "name string, rows long, row long")  # a row for each task that wrote
    return parts.repartition(max(1, len(manifest["parts"]))).mapInArrow(run, f"ids binary, cu_seqlens array<int>, resets array<int>, segments array<struct<doc: {doc}, piece: int, row: bigint>>")


def unpack(packed: DataFrame, width: int = 2) -> DataFrame:
    """``doc`` and ``ids array<int>`` of each input row that has tokens, its pieces put together in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, parts = [], []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{width}")
                for s, a, b in zip(r["segments"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
                    found.append(s)
                    parts.append(ids[a:b].astype(np.int32))
            kind = batch.schema.field("segments").type.value_type
            columns = [pa.array([s[f.name] for s in found], f.type) for f in kind]
            yield pa.record_batch([*columns, pa.array(parts, pa.list_(pa.int32()))], ["doc", "piece", "row", "ids"])

    kind = packed.schema["segments"].dataType.elementType["doc"].dataType.simpleString()
    pieces_of = packed.select("ids", "cu_seqlens", "segments").mapInArrow(run, f"doc {kind}, piece int, row long, ids array<int>")
    whole = pieces_of.groupBy("row").agg(F.first("doc").alias("doc"), F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    return whole.select("doc", F.flatten(F.col("p.ids")).alias("ids"))
