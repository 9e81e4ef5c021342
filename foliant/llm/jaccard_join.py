"""Exact n-gram Jaccard join of texts, skipping by the relations between sets.

A text's set has its distinct shingles of ``width`` words. Sets link when
``whole * |A and B| >= part * |A or B|``. What comes back is each document's component and
its links. No step writes out all pairs of a group:

* Equal sets share all answers, so only one of them, their class, is looked at.
* Shingles are ordered by rarity: by how many sets of the corpus have one, in quarters of
  powers of two, then by fingerprint. Linked sets have one of their first
  n - ceil(part / whole * n) + 1 shingles in common, and an index lists the sets by these.
  A shingle that only one set has takes a place, but needs no list.
* An entry of a list has its set's size and the shingle's place in it. Sets of unlike size
  are skipped, and so are places that add up to more than two linked sets can differ by.
  Long lists are cut into blocks of like component, size and place, and pairs of blocks that are
  of one component, or too far apart in size or place, are skipped as a whole.
* In each list the least set is compared first. A component that results covers all pairs
  in it; lists in one component are done. In lists that remain, sets in different
  components are compared: pair by pair, once for all lists, in short lists, and in long
  ones by what each set differs from what most of its block share.
* A set's number of links derives from the answers of its component's least set, the pivot.
  If two sets' differences from the pivot add up to no more than linked sets may differ by,
  they link, and no shingle of theirs is compared. Sets that link in this way to all of
  their component are done; the others are compared with each other, in blocks, and link
  to all those that are done.

Shingles are 64-bit fingerprints; the rest is exact. Frequencies are counted from one entry
for each shingle of a piece of the corpus, so a shingle that a third of all texts have is
as small as any. Joins whose key may be hot read two written tables, which lets Spark split
that key.

Defined cases: null texts and texts without words have an empty set and no links; a text
with fewer words than a shingle has one shingle, the whole; rows with a null id have no
component and lend their set to none; repeated rows are one set and share a component; rows
of one id with different texts are sets of their own, whose links all count; a very long
text is one set like any other, and is never cut; pairs of exactly the threshold link; an
empty table gives no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrow_text import mix64, pieces, split_words, word_fingerprints
from .components import connected_components
from .skew import attached
from .storage import checkpointed, release

#: Bytes of text for one bucket of shingles; there are as many buckets as that takes.
BUCKET_BYTES = 8 << 20
#: Lists of so many members or fewer are compared pair by pair; longer ones in blocks.
SHORT_LIST, BLOCK = 24, 256
#: Ids that may be broadcast to pick texts (some 40 MB); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Bytes of text whose words are held at a time while sets are made.
SHINGLED_BYTES = 1 << 20
#: Rows of a piece at most, since places in it are 16-bit numbers.
PIECE_ROWS = 1 << 15


class Scheme:
    """Shingle width and threshold, and what follows from them."""

    def __init__(self, width: int, part: int, whole: int):
        self.width, self.part, self.whole = width, part, whole

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many of its rarest shingles a set of ``n`` is listed by."""
        return n - -(-n * self.part // self.whole) + 1

    def sets(self, texts: pa.Array) -> list[np.ndarray]:
        """The sorted distinct shingle fingerprints of each text."""
        some = pieces(iter([pa.record_batch([texts], ["text"])]), limit=SHINGLED_BYTES)
        return [s for piece in some for s in self._sets(piece.column("text"))]

    def _sets(self, texts: pa.Array) -> list[np.ndarray]:
        words, bounds = split_words(texts, lower=True)
        codes, k = words.indices.to_numpy(zero_copy_only=False), self.width
        prints = word_fingerprints(words.dictionary)
        h = prints[codes] if len(codes) else np.empty(0, np.uint64)
        rolled = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for i in range(k):
            rolled = mix64(rolled + h[i : len(h) - k + 1 + i] + np.uint64(i + 1))
        out = []
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for i in range(a, b):
                    whole = mix64(whole + h[i] + np.uint64(i - a + 1))
                out.append(mix64(whole + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        return out

    def linked(self, sets: list[np.ndarray]) -> np.ndarray:
        """Which members link, as a matrix; each is linked to itself."""
        n = len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        common = counts * 2 > n  # what most members share
        differ = sizes + common.sum() - 2 * np.bincount(owner, common[inverse], n).astype(np.int64)
        rare = ~common & (counts > 1)
        lacked = common & (counts < n)
        shared = np.zeros((n, n), np.float32)  # how many differences two members have in common
        for chosen, value in ((rare, 1), (lacked, 0)):
            columns = np.nonzero(chosen)[0]
            place = np.full(len(values), -1, np.int64)
            for at in range(0, len(columns), 2048):
                part = columns[at : at + 2048]
                place[part] = np.arange(len(part))
                hit = place[inverse] >= 0
                table = np.full((n, len(part)), 1 - value, np.float32)
                table[owner[hit], place[inverse[hit]]] = value
                shared += table @ table.T
                place[part] = -1
        distance = differ[:, None] + differ[None, :] - 2 * np.rint(shared).astype(np.int64)
        linked = distance * (self.whole + self.part) <= (sizes[:, None] + sizes[None, :]) * (self.whole - self.part)
        np.fill_diagonal(linked, True)
        return linked

    def forest(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Places of linked members, each with the least it is tied to."""
        n, linked = len(sets), self.linked(sets)
        label = np.arange(n)
        while True:
            least = np.where(linked, label[None, :], n).min(1)
            least = least[least]
            if (least == label).all():
                break
            label = least
        return [(i, int(label[i])) for i in range(n) if label[i] != i]


def _planes(values: np.ndarray) -> bytes:
    """Bytes by place, so that the highest ones of sorted values lie together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _values(blobs, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.frombuffer(b, np.uint8).reshape(size, -1).T for b in blobs]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.empty(0, kind)

def _numbers(blobs, size: int) -> np.ndarray:
    """Whole numbers of ``size`` bytes, as 64-bit ones."""
    parts = [np.frombuffer(b, np.uint8).reshape(size, -1).T for b in blobs]
    wide = np.zeros((sum(map(len, parts)), 8), np.uint8)
    if parts:
        wide[:, :size] = np.concatenate(parts)
    return wide.view(np.uint64).ravel()


def _prints(shingles: np.ndarray) -> tuple[int, int]:
    """Two fingerprints that tell sets of one size apart."""
    mixed = mix64(shingles)
    return tuple(int(x.sum(dtype=np.uint64).view(np.int64)) for x in (mixed, mix64(mixed ^ np.uint64(0xD6E8FEB86659FD93))))


def _scan(docs: DataFrame, scheme: Scheme, doc: str, text: str, buckets: int, key_bytes: int) -> DataFrame:
    """Of each piece of the corpus a row of its own, with its documents and who owns its shingles, and a row of distinct shingles for each bucket.

    A shingle's key is the first ``key_bytes`` bytes of its fingerprint. Keys are sorted, so
    buckets are runs of them, and the bucket's rows come back in the order of the piece.
    """
    kind = docs.schema[doc].dataType.simpleString()
    shift = np.uint64(64 - 8 * key_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for batch in pieces(batches):
            for at in range(0, batch.num_rows, PIECE_ROWS):
                part = batch.slice(at, PIECE_ROWS)
                sets = scheme.sets(part.column("text"))
                sizes = np.array([len(s) for s in sets], np.int64)
                print1, print2 = np.array([_prints(s) for s in sets], np.int64).T
                given = part.column("doc").is_valid().to_numpy(zero_copy_only=False)
                first: dict[tuple, int] = {}
                for i in np.nonzero(given & (sizes > 0))[0].tolist():
                    first.setdefault((sizes[i], print1[i], print2[i]), i)
                own = np.array(list(first.values()), np.int64)
                shingles = np.concatenate([np.empty(0, np.uint64), *(sets[i] for i in own)])
                order = np.argsort(shingles)
                shingles, owners = shingles[order], np.repeat(own, sizes[own]).astype(np.uint16)[order]
                keys = shingles >> shift
                fresh = np.nonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))[0]
                keys, counts = keys[fresh], np.diff(fresh, append=len(shingles)).astype(np.uint16)
                bucket = ((shingles[fresh] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                starts = np.nonzero(np.diff(bucket, prepend=-1))[0]
                edges = np.append(starts, len(keys)).tolist()
                runs = list(zip(edges, edges[1:]))
                key_planes = keys.view(np.uint8).reshape(-1, 8)[:, :key_bytes]
                rows = 1 + len(runs)
                ids = pa.ListArray.from_arrays(pa.array([0] + [part.num_rows] * rows, pa.int32()), part.column("doc"))
                longs = [pa.array([v] + [None] * len(runs), pa.list_(pa.int64())) for v in (part.column("digest").to_numpy(zero_copy_only=False), sizes, print1, print2)]
                blobs = [[_planes(owners)] + [None] * len(runs), [_planes(counts), *(_planes(counts[a:b]) for a, b in runs)], [None, *(key_planes[a:b].T.tobytes() for a, b in runs)]]
                yield pa.record_batch([pa.array([base] * rows), pa.array([-1 - base, *bucket[starts].tolist()], pa.int64()), ids, *longs, *(pa.array(b, pa.binary()) for b in blobs)], ["base", "bucket", "doc", "digest", "n", "f1", "f2", "owners", "counts", "keys"])
                base += 1

    rows = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("digest"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"base long, bucket long, doc array<{kind}>, digest array<long>, n array<long>, f1 array<long>, f2 array<long>, owners binary, counts binary, keys binary")


def _frequencies(rows: pa.Table, key_bytes: int) -> pa.Table:
    """Of one bucket, for each piece and key a band of frequency (0: no other set has it), and for shared keys a number; pieces' own rows pass."""
    names = ["base", "bucket", "doc", "digest", "n", "f1", "f2", "owners", "counts"]
    own, blobs = rows.select(names), [None] * rows.num_rows
    bands, numbers = list(blobs), list(blobs)
    if rows["bucket"][0].as_py() >= 0:
        given = rows["keys"].to_pylist()
        key, count = _numbers(given, key_bytes), _numbers(rows["counts"].to_pylist(), 2).astype(np.int64)
        order = np.argsort(key)
        fresh = np.diff(key[order], prepend=key[order[:1]] + np.uint64(1)) != 0
        total = np.add.reduceat(count[order], np.nonzero(fresh)[0])
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(fresh) - 1
        band = np.where(total > 1, 1 + np.floor(4 * np.log2(total)), 0).astype(np.uint8)[group]
        number = (np.cumsum(total > 1) - 1).astype(np.uint32)[group]
        edges = np.cumsum([0] + [len(k) // key_bytes for k in given]).tolist()
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            bands[i], numbers[i] = band[a:b].tobytes(), _planes(number[a:b][band[a:b] > 0])
    return own.append_column("bands", pa.array(bands, pa.binary())).append_column("numbers", pa.array(numbers, pa.binary()))


def _prefixes(rows: pa.Table, scheme: Scheme) -> pa.Table:
    """Of one piece its documents, and its sets' entries in the lists of their rarest shingles."""
    own = rows.filter(rows["owners"].is_valid())
    back = rows.filter(rows["owners"].is_null()).sort_by("bucket")
    sizes, print1, print2 = (own[c].combine_chunks().flatten().to_numpy() for c in ("n", "f1", "f2"))
    owners, counts = _values(own["owners"].to_pylist(), np.uint16), _values(own["counts"].to_pylist(), np.uint16)
    bands, numbers = back["bands"].to_pylist(), back["numbers"].to_pylist()
    band = np.frombuffer(b"".join(bands), np.uint8)
    lists = np.full(len(band), -1, np.int64)
    lists[band > 0] = _values(numbers, np.uint32) | np.repeat(back["bucket"].to_numpy().astype(np.int64), [len(b) // 4 for b in numbers]) << 32
    band, lists = np.repeat(band, counts), np.repeat(lists, counts)
    order = np.lexsort((band, owners))  # ties stay in the order of keys, which is that of all pieces
    owner = owners[order].astype(np.int64)
    place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(sizes)))[owner]
    chosen = (place < scheme.prefix(sizes[owner])) & (band[order] > 0)
    who = owner[chosen]
    entry = [lists[order][chosen], sizes[who], print1[who], print2[who], place[chosen]]
    one = lambda v: pa.array([v], pa.list_(pa.int64()))
    return pa.table([*(own[c] for c in ("doc", "digest", "n", "f1", "f2")), *map(one, entry)], ["doc", "digest", "n", "f1", "f2", "list", "size", "g1", "g2", "place"])


def set_components(docs: DataFrame, width: int = 3, part: int = 90, whole: int = 100, doc: str = "doc_id", text: str = "text", **limits: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, links)``: rows have doc, n_shingles and component_id.

    Links (a, b) are all links between different sets, each of which is named by its least id, and
    a <= b. They are found when they are read; a group of near copies has as many as its square.
    """
    join = _Join(docs, width, part, whole, doc, text, **limits)
    return join.rows().select("doc", "n_shingles", "component_id"), join.all_links()


def counted_components(docs: DataFrame, width: int = 3, part: int = 90, whole: int = 100, doc: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """doc, n_shingles, component_id and n_links, the number of different sets that the document's set links to."""
    return _Join(docs, width, part, whole, doc, text, **limits).rows(counted=True).select("doc", "n_shingles", "component_id", "n_links")


def drop_near_duplicates(docs: DataFrame, width: int = 5, part: int = 80, whole: int = 100, doc: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` with one row of each component: that of the least id; of several such rows, one with the least digest of its text.

    Rows without words or without an id stay. Rows are told apart by id and digest, so that a
    row stays though another of its id goes; no text is shuffled if few enough rows go.
    """
    rows = _Join(docs, width, part, whole, doc, text, broadcast_ids=broadcast_ids).rows()
    rows = rows.where("doc is not null and n_shingles > 0").select("doc", "digest", "component_id")
    later = rows.where("doc <> component_id").select("doc", "digest").distinct()
    heads = rows.where("doc = component_id").groupBy("doc", "digest").agg(F.count("*").alias("n"))
    least = heads.groupBy("doc").agg(F.min("digest").alias("least"), F.sum("n").alias("all")).where(F.col("all") > 1)
    crowded = checkpointed(heads.join(least, "doc").select("doc", "digest", "least"))
    gone = checkpointed(later.union(crowded.where("digest <> least").select("doc", "digest"))).toDF("__doc", "__digest")
    keyed = docs.withColumn("__doc", F.col(doc)).withColumn("__digest", F.xxhash64(F.col(text).cast("string")))
    few = lambda x: F.broadcast(x) if x.limit(broadcast_ids + 1).count() <= broadcast_ids else x
    kept = keyed.join(few(gone), ["__doc", "__digest"], "left_anti")
    if crowded.limit(1).count():  # rows that share id and text with the one that stays, or id alone
        once = few(crowded.where("digest = least").select(F.col("doc").alias("__doc"), F.col("digest").alias("__digest")))
        kept = kept.join(once, ["__doc", "__digest"], "left_anti").unionByName(kept.join(once, ["__doc", "__digest"], "left_semi").dropDuplicates(["__doc", "__digest"]))
    return kept.select(docs.columns)


def _matrices_of(scheme: Scheme):
    """A function from a group of ``_inside`` to the ids of each label in it and which of them link."""

    def matrices(rows: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, rows in rows.groupby("label"):
            rows = rows.drop_duplicates("id").sort_values("id")
            linked = scheme.linked([np.asarray(s, np.int64) for s in rows["shingles"]])
            np.fill_diagonal(linked, False)
            own = rows["block"].to_numpy()
            if rows["i"].iat[0] < rows["j"].iat[0]:  # one of the two blocks may be empty
                linked &= own[:, None] != own[None, :]
            yield rows["id"].to_numpy(), linked

    return matrices


class _Join:
    """The tables of one join. Sets are named by ``id``, a number for each class of equal sets."""

    def __init__(self, docs: DataFrame, width: int, part: int, whole: int, doc: str, text: str, short_list: int = SHORT_LIST, block: int = BLOCK, broadcast_ids: int = BROADCAST_IDS, bucket_bytes: int = BUCKET_BYTES):
        if not 0 < part <= whole or width < 1:
            raise ValueError("a shingle has a word or more, and the threshold is above 0 and at most 1")
        self.scheme, self.block = Scheme(width, part, whole), block
        self.kind = kind = docs.schema[doc].dataType.simpleString()
        scheme = self.scheme
        size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
        self.buckets = int(max(24, -(-size // bucket_bytes)))
        key_bytes = min(8, max(5, (int(size).bit_length() + 14) // 8))  # chance equals stay rare in a corpus of this size
        bands = _scan(docs, scheme, doc, text, self.buckets, key_bytes).groupBy("bucket").applyInArrow(lambda t: _frequencies(t, key_bytes), f"base long, bucket long, doc array<{kind}>, digest array<long>, n array<long>, f1 array<long>, f2 array<long>, owners binary, counts binary, bands binary, numbers binary")
        index = bands.groupBy("base").applyInArrow(lambda t: _prefixes(t, scheme), f"doc array<{kind}>, digest array<long>, n array<long>, f1 array<long>, f2 array<long>, list array<long>, size array<long>, g1 array<long>, g2 array<long>, place array<long>")
        index = checkpointed(index)
        self.units = index.select(F.explode(F.arrays_zip("doc", "digest", "n", "f1", "f2")).alias("u")).select("u.*")
        classes = self.units.where("doc is not null and n > 0").groupBy("n", "f1", "f2").agg(F.min("doc").alias("rep"))
        self.classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))  # numbers are those in the table
        entries = index.select(F.explode(F.arrays_zip("list", "size", "g1", "g2", "place")).alias("e")).select("e.list", "e.size", "e.g1", "e.g2", "e.place").toDF("list", "n", "f1", "f2", "place").distinct()
        entries = checkpointed(entries.join(self.classes.drop("rep"), ["n", "f1", "f2"]).select("list", "id", "n", "place"))
        lists = checkpointed(entries.groupBy("list").agg(F.min(F.struct("id", "n", "place")).alias("least"), F.max("id").alias("last"), F.count("*").alias("members")).where("least.id < last"))
        members = checkpointed(entries.join(lists.drop("last"), "list"))
        needed = checkpointed(self.classes.join(members.select("id").distinct(), "id"))
        self.sets = checkpointed(self._sets(docs, doc, text, needed, broadcast_ids))
        release(entries, lists, needed)

        stars = members.where("id <> least.id").where(self._alike("n", "least.n") & self._near("n", "place", "least.n", "least.place"))
        links = checkpointed(self._linked(stars.select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct()))
        self.labels = checkpointed(connected_components(links))
        named = members.drop("least").join(self.labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        named = checkpointed(named)
        split = checkpointed(named.groupBy("list").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("list"))
        if split.limit(1).count():
            rest = checkpointed(named.join(split, "list"))
            more = checkpointed(self._linked(self._short_pairs(rest.where(F.col("members") <= short_list))).union(self._long_links(rest.where(F.col("members") > short_list))))
            if more.limit(1).count():
                self.labels = checkpointed(connected_components(links.union(more)))
            release(rest, more)
        release(members, links, named, split)

    def _alike(self, m: str, n: str):
        """Sets of these sizes can link."""
        return F.least(m, n) * self.scheme.whole >= F.greatest(m, n) * self.scheme.part

    def _near(self, m: str, at: str, n: str, other: str):
        """Sets with their first common shingle at these places can link: what comes before is in one of them only."""
        scheme = self.scheme
        return (F.col(at) + F.col(other)) * (scheme.whole + scheme.part) <= (F.col(m) + F.col(n)) * (scheme.whole - scheme.part)

    def _sets(self, docs: DataFrame, doc: str, text: str, needed: DataFrame, broadcast_ids: int) -> DataFrame:
        """``id``, ``n`` and ``shingles`` of the sets in ``needed``; a set may come more than once if rows repeat."""
        scheme = self.scheme
        few = needed.limit(broadcast_ids + 1).count() <= broadcast_ids
        texts = docs.select(F.col(doc).alias("rep"), F.col(text).cast("string").alias("text")).join(F.broadcast(needed) if few else needed, "rep")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set = set()  # of a task's repeated rows one is enough
            for batch in pieces(batches):
                sets = scheme.sets(batch.column("text"))
                names, sizes, *given = (batch.column(c).to_pylist() for c in ("id", "n", "f1", "f2"))
                own = [i for i, s in enumerate(sets) if len(s) == sizes[i] and _prints(s) == (given[0][i], given[1][i]) and names[i] not in seen and not seen.add(names[i])]
                yield pa.record_batch([pa.array([names[i] for i in own], pa.int64()), pa.array([sizes[i] for i in own], pa.int64()), pa.array([sets[i].view(np.int64) for i in own], pa.list_(pa.int64()))], ["id", "n", "shingles"])

        return texts.select("text", "id", "n", "f1", "f2").mapInArrow(keep, "id long, n long, shingles array<long>")

    def _measured(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with the sizes of both sets and how many shingles they share."""
        joined = pairs.join(self.sets.toDF("b", "nb", "y"), "b").join(self.sets.toDF("a", "na", "x"), "a")
        return joined.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("common"))

    def _linked(self, pairs: DataFrame) -> DataFrame:
        fits = F.col("common") * self.scheme.whole >= (F.col("na") + F.col("nb") - F.col("common")) * self.scheme.part
        return self._measured(pairs).where(fits).select("a", "b")

    def _short_pairs(self, rest: DataFrame) -> DataFrame:
        """Pairs of sets in different components that a list has, no more than the square of a short list's members."""
        short = rest.groupBy("list").agg(F.sort_array(F.collect_list(F.struct("id", "n", "place", "label"))).alias("m"))
        second = short.select("m", F.explode(F.expr("sequence(1, size(m) - 1)")).alias("i")).select(F.expr("m[i - 1]").alias("x"), F.explode(F.expr("slice(m, i + 1, size(m))")).alias("y"))
        fits = F.expr("x.label <> y.label") & self._alike("x.n", "y.n") & self._near("x.n", "x.place", "y.n", "y.place")
        return second.where(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    def _blocks(self, rest: DataFrame) -> DataFrame:
        """``rest`` of long lists with its ``block``: sets of one component, band of size and band of place.

        Components of less than a block in a list share blocks, whose ``tribe`` is -1. A band of sizes
        links to its neighbours only. Only a cell with more sets than a block has is cut further, by hash.
        """
        step = float(np.log(self.scheme.whole / self.scheme.part)) or 1.0
        sizes = checkpointed(rest.groupBy("list", "label").agg(F.count("*").alias("n")).where(F.col("n") >= self.block).withColumn("tribe", F.col("label")))
        rows = attached(rest.select("list", "id", F.col("n").alias("size"), "place", "label"), sizes, ["list", "label"])
        limit = F.col("size") * (self.scheme.whole - self.scheme.part) / (self.scheme.whole + self.scheme.part)  # the most that a place can be beside one of 0
        rows = rows.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / step)).withColumn("quarter", F.floor(F.col("place") * 2 / F.greatest(limit, F.lit(1.0))))
        rows = checkpointed(rows.withColumn("tribe", F.coalesce("tribe", F.lit(-1))))
        cell = ["list", "tribe", "band", "quarter"]
        counted = checkpointed(rows.groupBy(*cell).agg(F.count("*").alias("n"), F.ceil(F.count("*") / self.block).cast("int").alias("many")))
        rows = attached(rows, counted, cell)
        return rows.withColumn("block", F.xxhash64("tribe", "band", "quarter", F.pmod(F.xxhash64("id"), "many"))).select("list", "id", F.col("size").alias("n"), "place", "label", "tribe", "block")

    def _block_pairs(self, rows: DataFrame) -> DataFrame:
        """list, i and j: the pairs of ``rows``' blocks that can link and are not of one component; a block meets those of other tribes only."""
        scheme = self.scheme
        bounds = checkpointed(rows.groupBy("list", "tribe", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("place").alias("place"), F.min("label").alias("least"), F.max("label").alias("most")))
        tribes = checkpointed(bounds.select("list", "tribe").distinct())
        meet = tribes.toDF("list", "tribe1").join(tribes.toDF("list", "tribe2"), "list").where("tribe1 < tribe2 or tribe1 = -1 and tribe2 = -1")
        one, two = (bounds.select("list", *[F.col(c).alias(f"{c}{i}") for c in ("tribe", "block", "low", "high", "place", "least", "most")]) for i in (1, 2))
        pairs = meet.join(one, ["list", "tribe1"]).join(two, ["list", "tribe2"]).where("(tribe1 < tribe2 or block1 <= block2) and not (least1 = most1 and least2 = most2 and least1 = least2)")
        pairs = pairs.where(f"high1 * {scheme.whole} >= low2 * {scheme.part} and high2 * {scheme.whole} >= low1 * {scheme.part}").where(self._near("high1", "place1", "high2", "place2"))
        return pairs.select("list", F.col("block1").alias("i"), F.col("block2").alias("j"))

    def _long_links(self, rest: DataFrame) -> DataFrame:
        """A forest of the links between components in long lists, by blocks; pairs of blocks that can't link are skipped.

        Most sets of a long list are of one component by now, so that work grows with its
        members times those of other components.
        """
        scheme = self.scheme
        rows = checkpointed(self._blocks(rest))
        pairs = checkpointed(self._block_pairs(rows))
        sides = pairs.select("*", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        inside = sides.join(rows, ["list", "block"]).join(self.sets.select("id", "shingles"), "id")

        def of_blocks(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.drop_duplicates("id").sort_values("id")
            ids = rows["id"].to_numpy()
            found = scheme.forest([np.asarray(s, np.int64) for s in rows["shingles"]])
            return pd.DataFrame({"a": [ids[j] for _, j in found], "b": [ids[i] for i, _ in found]})

        return inside.groupBy("list", "i", "j").applyInPandas(of_blocks, "a long, b long").distinct()

    def _inside(self, rows: DataFrame):
        """Sets of ``rows`` (id, label) grouped so that any two of a label meet in one group; ``rows`` is a written table.

        Labels of one block travel together, larger ones as pairs of their blocks.
        """
        sizes = checkpointed(rows.groupBy("label").agg(F.count("*").alias("members")))
        many = F.ceil(F.col("members") / self.block).cast("int")
        inside = rows.join(sizes, "label").select("id", "label", many.alias("many"), F.pmod(F.xxhash64("id"), many).cast("int").alias("block"))
        inside = inside.join(self.sets.select("id", "shingles"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
        h = F.when(F.col("many") > 1, F.xxhash64("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(self.buckets)))
        inside = inside.select("label", "id", "block", "shingles", h.alias("h"), (F.col("many") > 1).alias("cut"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        return inside.groupBy("cut", "h", "i", "j")

    def all_links(self) -> DataFrame:
        matrices = _matrices_of(self.scheme)

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            pairs = [(ids, *np.nonzero(np.triu(linked))) for ids, linked in matrices(rows)]
            return pd.DataFrame({"a": np.concatenate([ids[x] for ids, x, _ in pairs]), "b": np.concatenate([ids[y] for ids, _, y in pairs])})

        pairs = self._inside(self.labels.withColumnRenamed("node", "id")).applyInPandas(found, "a long, b long")
        names = self.classes.select("id", "rep")
        named = pairs.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b")
        return named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def rooms(self) -> DataFrame:
        """label, id and members of every set that links to another, and whether the pivot alone tells that it links to all members."""
        scheme = self.scheme
        less, more = scheme.whole - scheme.part, scheme.whole + scheme.part
        measured = self._measured(self.labels.where("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")))
        room = F.col("nb") * less - (F.col("na") + F.col("nb") - 2 * F.col("common")) * more  # two sets whose rooms add up to 0 or more link
        pivots = self.labels.where("node = label").select("label", F.col("node").alias("id")).join(self.classes.select("id", "n"), "id")
        rooms = checkpointed(measured.select(F.col("a").alias("label"), F.col("b").alias("id"), room.alias("room")).union(pivots.select("label", "id", F.col("n") * less)))
        rooms = rooms.distinct()  # repeated rows
        stats = checkpointed(rooms.groupBy("label").agg(F.count("*").alias("members"), F.min("room").alias("low")))
        return checkpointed(rooms.join(stats, "label").select("label", "id", "members", (F.col("room") + F.col("low") >= 0).alias("sure")))

    def counts(self) -> DataFrame:
        """``id`` and ``n_links`` of every set that links to another."""
        rooms = self.rooms()
        cores = checkpointed(rooms.groupBy("label").agg(F.count_if("sure").alias("core")))
        open_ = checkpointed(rooms.where("not sure").select("label", "id"))
        known = rooms.join(cores, "label").select("id", F.when(F.col("sure"), F.col("members") - 1).otherwise(F.col("core")).alias("n_links"))
        if open_.limit(1).count() == 0:
            return known
        matrices = _matrices_of(self.scheme)

        def sums(rows: pd.DataFrame) -> pd.DataFrame:
            found = [(ids, linked.sum(1)) for ids, linked in matrices(rows)]
            return pd.DataFrame({"id": np.concatenate([ids for ids, _ in found]), "k": np.concatenate([k for _, k in found])})

        among = self._inside(open_).applyInPandas(sums, "id long, k long")
        return known.union(among).groupBy("id").agg(F.sum("n_links").alias("n_links"))

    def rows(self, counted: bool = False) -> DataFrame:
        """doc, digest, n_shingles, component_id and, if ``counted``, n_links of every row."""
        named = checkpointed(self.labels.withColumnRenamed("node", "id").join(self.classes.select("id", "rep"), "id"))
        least = checkpointed(named.groupBy("label").agg(F.min("rep").alias("least")))
        answers = self.classes.join(named.join(least, "label").select("id", "least"), "id", "left")
        if counted:
            answers = answers.join(self.counts(), "id", "left")
        else:
            answers = answers.withColumn("n_links", F.lit(0))
        answers = checkpointed(answers.select("n", "f1", "f2", F.coalesce("least", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
        rows = self.units.join(answers, ["n", "f1", "f2"], "left")
        present = lambda c, none: F.when(F.col("doc").isNotNull(), F.coalesce(c, none))
        return rows.select("doc", "digest", F.col("n").alias("n_shingles"), present("component_id", "doc").alias("component_id"), present("n_links", F.lit(0).cast("long")).alias("n_links"))
