"""Maximum inner product search by score-aware four-bit quantisation.

Vectors are cut into subspaces of two dimensions with sixteen codewords each. What
matters for the largest inner products is the error along the vector itself, so the
loss weighs that (parallel) part of the residual more than the rest: codes are assigned
by coordinate descent on the weighted loss and codewords solve its normal equations
(anisotropic quantisation). Codebooks are fitted on at most ``SAMPLE`` vectors, those
with the lowest digests of their ids; every vector is encoded and searched.

A search deals candidates and queries into blocks of bounded size, each of which is packed,
and its candidates encoded, once. A task scans the
codes of one block of candidates for one block of queries, adding up small tables of 16
scores for each subspace (quantised to one byte), and reranks the best ``RERANK`` of each query by exact
inner products in double precision. The nearest of all blocks are then merged. As each block
reranks its own, the share of rows that is looked at exactly, and with it the recall, does not
fall as the table grows (README.md has the figures).

Defined cases: vectors that are null or zero, or hold null or non-finite components,
take no part; vectors of another length than most are left out likewise; ties go to the
smaller id; a query's own row is no candidate, and rows that repeat an id count once;
fewer candidates than asked for are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .storage import checkpointed

SAMPLE, DIMS, CODEWORDS = 4_096, 2, 16
#: Inner products below this share of the norm do not matter; sets the weight of parallel error.
THRESHOLD = 0.2
ROUNDS = 6
NEAREST, RERANK = 20, 100
CANDIDATE_BLOCK, QUERY_BLOCK = 4_096, 8_192


class Quantizer:
    """Codebooks [subspace, codeword, dim] for vectors of ``size`` components."""

    def __init__(self, vectors: np.ndarray, seed: int = 5, rounds: int = ROUNDS):
        self.size = vectors.shape[1]
        self.spaces = -(-self.size // DIMS)
        x = self._cut(vectors)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.books = x[rng.integers(0, n, CODEWORDS)].transpose(1, 0, 2).copy() + rng.normal(0, 1e-6, (self.spaces, CODEWORDS, DIMS))
        weight = max(1.0, (self.size - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)) - 1
        self.weight = weight
        unit = self._cut(self._unit(vectors))
        for _ in range(rounds):
            codes = self._assign(x, unit)
            along = np.stack([(unit[:, m] * (x[:, m] - self.books[m][codes[:, m]])).sum(1) for m in range(self.spaces)], 1)
            for m in range(self.spaces):
                rest = along.sum(1) - along[:, m] + (unit[:, m] * x[:, m]).sum(1)
                for k in range(CODEWORDS):
                    own = codes[:, m] == k
                    if own.any():
                        u = unit[own, m]
                        left = own.sum() * np.eye(DIMS) + weight * u.T @ u
                        self.books[m, k] = np.linalg.solve(left, x[own, m].sum(0) + weight * (rest[own, None] * u).sum(0))
                along[:, m] = (unit[:, m] * (x[:, m] - self.books[m][codes[:, m]])).sum(1)

    def _cut(self, vectors: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(vectors), self.spaces * DIMS))
        padded[:, : self.size] = vectors
        return padded.reshape(len(vectors), self.spaces, DIMS)

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        scale = np.abs(vectors).max(1, keepdims=True)
        scaled = vectors / scale
        return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))

    def _assign(self, x: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that minimise squared error plus the weighted square of its part along the vector."""
        errors = ((x[:, :, None, :] - self.books[None]) ** 2).sum(3)
        parallel = (unit[:, :, None, :] * (x[:, :, None, :] - self.books[None])).sum(3)
        codes = errors.argmin(2)
        rows = np.arange(len(x))
        along = np.take_along_axis(parallel, codes[:, :, None], 2)[:, :, 0]
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(self.spaces):
                rest = total - along[:, m]
                codes[:, m] = (errors[:, m] + self.weight * (rest[:, None] + parallel[:, m]) ** 2).argmin(1)
                along[:, m] = parallel[rows, m, codes[:, m]]
                total = rest + along[:, m]
        return codes

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Two codes to a byte: [vector, ceil(subspaces / 2)]."""
        codes = np.concatenate([self._assign(self._cut(v), self._cut(self._unit(v))) for v in np.array_split(vectors, max(1, len(vectors) // 2048))]).astype(np.uint8)
        if self.spaces % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        return codes[:, ::2] | (codes[:, 1::2] << 4)

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Approximate scores [query, vector] up to a shift and scale of each query."""
        tables = np.einsum("qmd,mkd->qmk", self._cut(queries), self.books)
        tables -= tables.min(2, keepdims=True)
        tables = np.rint(tables * (255 / np.maximum(tables.max((1, 2), keepdims=True), 1e-300))).astype(np.uint8)
        scores = np.zeros((len(queries), len(packed)), np.uint16)
        for byte in range(packed.shape[1]):
            low, high = 2 * byte, 2 * byte + 1
            pair = tables[:, low, :].astype(np.uint16)[:, None, :]
            if high < self.spaces:
                pair = pair + tables[:, high, :].astype(np.uint16)[:, :, None]
            else:
                pair = np.broadcast_to(pair, (len(queries), CODEWORDS, CODEWORDS))
            scores += pair.reshape(len(queries), 256)[:, packed[:, byte]]  # both codes of a byte in one look-up
        return scores


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _prepared(rows: DataFrame, key: str, vector: str) -> DataFrame:
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    return rows.where(usable("v")).groupBy("id").agg(F.min("v").alias("v"))


def fit(rows: DataFrame, sample: int = SAMPLE) -> Quantizer | None:
    """A quantiser fitted to the ``sample`` rows (id, v) with the lowest digests; None without rows."""
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return None
    total = max(1, size["count"])
    digest = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    low = rows.where((F.size("v") == size["size"]) & (digest < min(1 << 30, (1 << 30) * 2 * sample // total + 1)))
    picked = sorted(low.select(digest.alias("d"), "id", "v").collect())[:sample]  # about twice the sample at most
    return Quantizer(np.array([r["v"] for r in picked]))


def search(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, rerank: int = RERANK, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``nearest`` rows for each row where ``is_query`` (over the column ``id``) holds."""
    every = checkpointed(_prepared(rows, key, vector))
    schema = "query_id long, rank int, vec_id long, score double"
    quantizer = fit(every)
    if quantizer is None:
        return rows.sparkSession.createDataFrame([], schema)
    every = every.where(F.size("v") == quantizer.size)
    counts = every.agg(F.count("*").alias("all"), F.count_if(is_query).alias("queries")).first()
    n_salts = isqrt(max(1, -(-counts["all"] // candidate_block)) - 1) + 1
    n_blocks, n_query_blocks = max(1, -(-counts["all"] // candidate_block)), max(1, -(-counts["queries"] // query_block))
    block = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    shared, width = rows.sparkSession.sparkContext.broadcast(quantizer), quantizer.size

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        vectors = np.ascontiguousarray(table["v"].combine_chunks().flatten().to_numpy().reshape(-1, width))
        blobs = [table["id"].to_numpy().tobytes(), vectors.tobytes(), shared.value.encode(vectors).tobytes()]
        return pa.table([pa.array([v], k) for v, k in zip([table["block"][0].as_py(), *blobs], [pa.int32()] + [pa.binary()] * 3)], ["block", "ids", "vectors", "codes"])

    dealt = lambda rows, n, salt: rows.withColumn("block", block(n, salt)).groupBy("block").applyInArrow(packed, "block int, ids binary, vectors binary, codes binary")
    candidates = checkpointed(dealt(every, n_blocks, "c"))
    queries = checkpointed(dealt(every.where(is_query), n_query_blocks, "q").drop("codes"))
    candidates = candidates.withColumnRenamed("block", "c").withColumn("q", numbers(n_query_blocks))
    queries = queries.withColumnRenamed("block", "q").withColumn("c", numbers(n_blocks))

    def of_block(asked: pa.Table, given: pa.Table) -> pa.Table:
        kinds, parts = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), []
        salt = given["c"][0].as_py() % n_salts if given.num_rows else 0
        if asked.num_rows and given.num_rows:
            ids, wanted = (np.frombuffer(t["ids"][0].as_py(), np.int64) for t in (given, asked))
            vectors, q = (np.frombuffer(t["vectors"][0].as_py()).reshape(-1, width) for t in (given, asked))
            codes = np.frombuffer(given["codes"][0].as_py(), np.uint8).reshape(len(ids), -1)
            for at in range(0, len(wanted), 128):
                parts.append(_nearest(shared.value, wanted[at : at + 128], q[at : at + 128], ids, vectors, codes, rerank, nearest))
        whole = pa.concat_tables([kinds.empty_table(), *(pa.table(list(p), kinds) for p in parts)])
        return whole.append_column("salt", pa.array(np.full(whole.num_rows, salt, np.int32)))

    def best(rows: DataFrame, *keys: str) -> DataFrame:
        least = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score")))
        return rows.groupBy(*keys).agg(F.slice(least, 1, nearest).alias("best"))

    found = queries.groupBy("q", "c").cogroup(candidates.groupBy("q", "c")).applyInArrow(of_block, "query_id long, vec_id long, score double, salt int")
    salted = best(found, "query_id", "salt").select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score")
    out = best(salted, "query_id").select("query_id", F.posexplode("best").alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def _nearest(quantizer: Quantizer, wanted: np.ndarray, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, rerank: int, nearest: int) -> tuple[np.ndarray, ...]:
    """Query ids, ids and exact scores of the nearest in one block, for a few queries."""
    rough = quantizer.scan(q, codes).astype(np.int32) + 1
    rough[ids[None, :] == wanted[:, None]] = 0
    take = min(rerank, len(ids))
    best = np.argpartition(-rough, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(take), (len(q), 1))
    best.sort(axis=1)
    exact = np.einsum("qd,qcd->qc", q, vectors[best])
    exact[ids[best] == wanted[:, None]] = -np.inf
    order = np.argsort(-exact, axis=1, kind="stable")[:, :nearest]
    chosen, scores = np.take_along_axis(best, order, 1), np.take_along_axis(exact, order, 1)
    found = [np.repeat(wanted, order.shape[1]), ids[chosen].ravel(), scores.ravel()]
    return tuple(x[found[2] > -np.inf] for x in found)
