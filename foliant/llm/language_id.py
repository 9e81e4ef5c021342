"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions. At every byte the two hidden
states give a distribution over the languages, and the distributions of all bytes of a
text are averaged. It is trained here, in numpy, by backpropagation through time.

Whole texts are read: each is cut into spans of ``SPAN`` bytes, a text's spans start from
zero states, and every byte of every span has its say. All spans of many texts run as one
batch. Training takes at most ``TRAIN_PER_LANG`` texts of each language, those with the
lowest digests of their ids, and of each one span at a digest's place; this bound is a
parameter, and prediction has none.

Defined cases: ``und`` with score 0 for null, empty and blank texts and texts without
letters, and where nothing could be learned; ties go to the language that sorts first;
repeated rows are rows of their own; null languages teach nothing; a null id is like the
text "" when training texts are chosen; a very long text has all its spans read; an empty
table to train on teaches nothing, and an empty one to predict gives no rows. lang, source
and id are no inputs of a prediction. Extra columns stay, but for those named lang_pred and
score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrow_text import pieces, utf8_buffer

TRAIN_PER_LANG = 600
SPAN, HIDDEN, EMBED = 128, 8, 8
STEPS, BATCH, RATE = 220, 192, 0.02
#: Texts below this pooled probability are rejected by filters.
MIN_SCORE = 0.5
UNKNOWN = "und"


def held_out(doc: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit(""))) % 3 == 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Byte embeddings folded into the gates' inputs, a gated unit for each direction, and a softmax at every byte.

    Byte 256 fills spans up; it leaves states as they are and has no say.
    """

    def __init__(self, languages: list[str], seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        h, k = hidden, len(languages)
        self.languages, self.hidden = languages, h
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.weights = {"E": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32), "V": init(2 * h, k), "c": np.zeros(k, np.float32)}
        for d in "fb":
            self.weights |= {f"W{d}": init(EMBED, 3 * h), f"U{d}": init(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}

    def _run(self, spans: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states [time, span, hidden] of a direction; ``spans`` is [time, span]."""
        w, h = self.weights, self.hidden
        table = (w["E"] @ w[f"W{d}"] + w[f"b{d}"]).astype(np.float32)
        recur_rz, recur_n = np.ascontiguousarray(w[f"U{d}"][:, : 2 * h]), np.ascontiguousarray(w[f"U{d}"][:, 2 * h :])
        steps, n = spans.shape
        states, kept = np.zeros((steps, n, h), np.float32), []
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = table[spans[t]]
            gates = _sigmoid(x[:, : 2 * h] + state @ recur_rz)
            reset, update = gates[:, :h], gates[:, h:]
            inner = state @ recur_n
            fresh = np.tanh(x[:, 2 * h :] + reset * inner)
            update = np.where((spans[t] == 256)[:, None], np.float32(1), update)
            new = fresh + update * (state - fresh)
            if keep:
                kept.append((t, state, reset, update, inner, fresh))
            state = states[t] = new
        return states, kept

    def _back(self, spans: np.ndarray, d: str, kept: list, grad_states: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of a direction's weights, through time."""
        w, h = self.weights, self.hidden
        recur = w[f"U{d}"]
        grad_u = np.zeros_like(recur)
        grad_table = np.zeros((257, 3 * h), np.float32)
        carry = np.zeros(grad_states.shape[1:], np.float32)
        for t, before, reset, update, inner, fresh in reversed(kept):
            g = carry + grad_states[t]
            live = (spans[t] != 256)[:, None]
            g_fresh = g * (1 - update) * (1 - fresh * fresh)
            g_update = g * (before - fresh) * update * (1 - update) * live
            g_inner = g_fresh * reset
            g_reset = g_fresh * inner * reset * (1 - reset)
            grads = np.concatenate([g_reset, g_update, g_fresh], 1)
            np.add.at(grad_table, spans[t], grads)
            back = np.concatenate([g_reset, g_update, g_inner], 1)
            grad_u += before.T @ back
            carry = g * update + back @ recur.T
        return {f"U{d}": grad_u, f"b{d}": grad_table.sum(0), f"W{d}": w["E"].T @ grad_table, "E": grad_table @ w[f"W{d}"].T}

    def positions(self, spans: np.ndarray) -> np.ndarray:
        """Distributions over languages at every byte, [time, span, language]."""
        both = np.concatenate([self._run(spans, d, False)[0] for d in "fb"], 2)
        return self._softmax(both @ self.weights["V"] + self.weights["c"])

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def fit(self, spans: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on the mean cross entropy of all bytes; ``spans`` is [span, time]."""
        rng = np.random.default_rng(seed)
        w = self.weights
        first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
        by_class = [np.nonzero(target == k)[0] for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(c, max(1, BATCH // len(by_class))) for c in by_class])
            x, y = np.ascontiguousarray(spans[pick].T), target[pick]
            short = np.where(rng.random(len(y)) < 0.5, rng.integers(16, len(x) + 1, len(y)), len(x))
            x[np.arange(len(x))[:, None] >= short] = 256  # texts are short as well as long
            (forward, kept_f), (backward, kept_b) = self._run(x, "f", True), self._run(x, "b", True)
            both = np.concatenate([forward, backward], 2)
            g = self._softmax(both @ w["V"] + w["c"])
            g[:, np.arange(len(y)), y] -= 1
            g *= ((x != 256) / max(1, (x != 256).sum()))[:, :, None].astype(np.float32)
            grads = {"V": np.einsum("tnh,tnk->hk", both, g), "c": g.sum((0, 1))}
            g = g @ w["V"].T
            grads |= self._back(x, "f", kept_f, g[:, :, : self.hidden])
            other = self._back(x, "b", kept_b, g[:, :, self.hidden :])
            grads["E"] = grads["E"] + other.pop("E")
            grads |= other
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, v in grads.items():
                v = v * min(1.0, 1 / max(norm, 1e-9))
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def predict(self, raw: np.ndarray, offs: np.ndarray, batch: int = 1024) -> np.ndarray:
        """Mean distribution of each text laid out in ``raw``, zeros for empty ones."""
        lengths = np.diff(offs)
        n_spans = -(-lengths // SPAN)
        owner = np.repeat(np.arange(len(lengths)), n_spans)
        starts = offs[:-1][owner] + SPAN * (np.arange(len(owner)) - np.repeat(np.cumsum(n_spans) - n_spans, n_spans))
        sizes = np.minimum(SPAN, offs[1:][owner] - starts)
        total = np.zeros((len(lengths), len(self.languages)))
        order = np.argsort(-sizes, kind="stable")  # spans of like length share a batch
        h, v, c = self.hidden, self.weights["V"], self.weights["c"]
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            longest = int(sizes[some].max())
            place = np.minimum(starts[some][None, :] + np.arange(longest)[:, None], len(raw) - 1)
            live = np.arange(longest)[:, None] < sizes[some][None, :]
            spans = np.where(live, raw[place].astype(np.int16), np.int16(256))  # bytes have no room for 256
            states = [self._run(spans, d, False)[0].reshape(-1, h) for d in "fb"]
            logits = states[0] @ v[:h]
            logits += states[1] @ v[h:]
            logits += c
            p = self._softmax(logits).reshape(longest, len(some), -1)
            if sizes[some[-1]] < longest:
                p *= live[:, :, None]
            np.add.at(total, owner[some], p.sum(0))
        return total / np.maximum(lengths, 1)[:, None]


def training_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_PER_LANG) -> list:
    """At most ``per_lang`` rows of each language, chosen by a digest of the id.

    The languages are counted first; then only rows whose digest is low enough for about
    twice that many to be left are looked at, whatever the size of the table.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(F.col(lang).cast("string")).count().collect()}
    digest = F.pmod(F.xxhash64(F.col(doc).cast("string"), F.lit("language")), F.lit(1 << 30))
    limit = F.lit(0)
    for name, n in sorted(counts.items()):
        limit = F.when(F.col(lang) == name, F.lit(min(1 << 30, (1 << 30) * 2 * per_lang // n + 1))).otherwise(limit)
    span = F.encode(F.col(text), "utf-8")
    at = F.pmod(digest, F.greatest(F.lit(1), F.octet_length(text) - SPAN + 1)).cast("int")
    rows = known.where(digest < limit).select(F.col(lang).cast("string").alias("lang"), digest.alias("digest"), F.substring(span, at + 1, F.lit(SPAN)).alias("span")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["digest"], r["span"]))
    kept, seen = [], dict.fromkeys(counts, 0)
    for r in rows:
        if r["span"] and seen[r["lang"]] < per_lang:
            seen[r["lang"]] += 1
            kept.append((r["lang"], r["span"]))
    return kept


def train(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_PER_LANG, steps: int = STEPS) -> Network | None:
    """A network that knows the languages of ``docs``; None if there are none."""
    rows = training_texts(docs, doc, text, lang, per_lang)
    languages = sorted({name for name, _ in rows})
    if not languages:
        return None
    spans = np.full((len(rows), SPAN), 256, np.int16)
    for i, (_, span) in enumerate(rows):
        spans[i, : len(span)] = np.frombuffer(span, np.uint8)
    network = Network(languages)
    network.fit(spans, np.array([languages.index(name) for name, _ in rows]), steps)
    return network


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(network)
    index = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in pieces(batches, text, 4 << 20):
            column = batch.column(index)
            letters = np.array([has_letter(v) for v in column.to_pylist()], bool)
            names, scores = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters))
            if network is not None and letters.any():
                p = network.predict(*utf8_buffer(column))
                best = p.argmax(1)
                names[letters] = np.array(network.languages, object)[best[letters]]
                scores[letters] = np.clip(p[np.arange(len(best)), best][letters], 0, 1)
            yield pa.record_batch([*batch.columns, pa.array(names.tolist(), pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    from pyspark.sql import types as T

    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in kept])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
