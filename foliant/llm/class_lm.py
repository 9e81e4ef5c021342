"""A Brown class-based bigram model of a corpus, and the scores of its texts.

Exchange clustering moves each listed word to the class that most raises the likelihood
of the training text's class bigrams. The most frequent words are clustered first, from
their own bigrams; then sweeps over all listed words gather how often each meets each
class on either side, until few words move or the likelihood no longer rises. All words
that are not listed form one class, in which unseen words have a share; words seen once are never listed, so that this class
tells how likely a word is to be new. A text's log10 probability sums, over its words
and one end, the logarithm of the class transition times the word's share of its class,
mixed with the smoothed share of the word in the whole corpus.

Counts are taken from every training text. The ``LISTED`` most frequent words travel to
the workers; the counts of all others, whose number grows with the corpus, are joined by
word. Score and base score therefore hold for any vocabulary.

Defined cases: null text is empty and has only its end, and so have empty and blank texts;
a null id counts as the text ""; repeated rows are rows of their own, in training too; a
very long text is one text, and no count depends on how it is cut; if words of one count are
only listed in part, those with the least hashes are, and a word for which two classes are as good stays, or
takes the lower one; without training texts all words are unseen, and a table without rows
to score gives none. Other columns of the scored table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .arrow_text import partial_counts, pieces, split_words
from .frequency import most_frequent
from .storage import checkpointed, release

#: Words with ids of their own, those clustered first, classes, and sweeps over the latter.
LISTED, CLUSTERED, CLASSES, SWEEPS = 131_072, 1_500, 48, 3
#: Weight of a class's overall share in its transitions.
PRIOR = 50.0
#: Share of the class model in the mixture with plain frequencies.
MIX = 0.8
BUCKETS = 24
#: Sweeps over all listed words end when at most this share of them moves, or after so many; words that move together.
FEW, ALL_SWEEPS, BATCH = 0.01, 8, 256
#: Shares into which a task's counts are dealt by unit, and parts of a share that are added up at a time.
RANGES, PARTS = 256, 256
#: Tokens after which a task sends its counts, which are 32-bit numbers, and starts anew.
FULL = (1 << 31) - 1
#: Tokens whose pairs are counted together before the sweeps, and pairs or cells that are added up at a time in them.
HELD, STEP = 1 << 21, 1 << 18


def training(doc: str = "doc_id") -> Column:
    """Documents whose crc32 of the id leaves no remainder of 2 by 7."""
    return ~held_out(doc)


def held_out(doc: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit(""))) % 7 == 2


def exchange_clusters(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each word from the matrix of its bigram counts.

    Words start in classes by rank, and each in turn moves to the class with the highest
    sum of N(c, d) log N(c, d) less N(c) log N(c) of the classes' counts on either side.
    """
    n = len(bigrams)
    classes = max(1, min(classes, n))
    group = np.arange(n) % classes
    member = np.zeros((n, classes))
    member[np.arange(n), group] = 1
    counts = member.T @ bigrams @ member
    xlog = lambda x: x * np.log(np.maximum(x, 1e-300))
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        ahead, behind = bigrams @ member, bigrams.T @ member  # word -> class, class -> word
        for w in range(n):
            own = bigrams[w, w]
            out, into = ahead[w].copy(), behind[w].copy()
            a = group[w]
            out[a] -= own
            into[a] -= own
            counts[a, :] -= out
            counts[:, a] -= into
            counts[a, a] -= own
            rows, columns = counts.sum(1), counts.sum(0)
            # gain of each class b: its row and column take the word's counts
            gain = (xlog(counts + out) - xlog(counts)).sum(1) + (xlog(counts + into[:, None]) - xlog(counts)).sum(0)
            corner = counts[diagonal, diagonal]
            gain += xlog(corner + out + into + own) - xlog(corner + out) - xlog(corner + into) + xlog(corner)
            gain -= xlog(rows + out.sum() + own) - xlog(rows) + xlog(columns + into.sum() + own) - xlog(columns)
            b = int(np.argmax(gain + 1e-9 * (diagonal == a)))
            counts[b, :] += out
            counts[:, b] += into
            counts[b, b] += own
            if b != a:
                member[w, a], member[w, b] = 0, 1
                group[w] = b
                ahead[:, a] -= bigrams[:, w]
                ahead[:, b] += bigrams[:, w]
                behind[:, a] -= bigrams[w, :]
                behind[:, b] += bigrams[w, :]
                moved += 1
        if not moved:
            break
    return group


def _xlog(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 1e-300)
    return x * np.log(x)


def likelihood(counts: np.ndarray) -> float:
    """What of the likelihood of class bigrams depends on the classes."""
    return float(_xlog(counts).sum() - _xlog(counts.sum(0)).sum() - _xlog(counts.sum(1)).sum())


def _raised(table: np.ndarray, logs: np.ndarray, d: np.ndarray, v: np.ndarray) -> np.ndarray:
    """By how much n log n of each cell of rows ``d`` rises with ``v`` more; a ``v`` with more rows than the table is worked out for the whole table."""
    values, which, times = np.unique(v, return_inverse=True, return_counts=True)
    often = times > len(table)
    found, listed = np.empty((len(d), len(table))), often[which]
    whole = _xlog(table + values[often][:, None, None]) - logs
    found[listed] = whole[(np.cumsum(often) - 1)[which[listed]], d[listed]]
    found[~listed] = _xlog(table[d[~listed]] + v[~listed, None]) - logs[d[~listed]]
    return found


def exchange_sweep(group: np.ndarray, unit: np.ndarray, slot: np.ndarray, n: np.ndarray, classes: int, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """Classes after each word but the last two units moved once, and how many moved.

    Rows (``unit``, ``slot``, ``n``), sorted, tell how often each unit stands before each class as it is at the
    start (slots from 0), behind it (slots behind these), and before itself (the last slot). Words move in
    batches, each to the class that is best for it while all others of its batch stay where they are.
    """
    group, moved, k = group.copy(), 0, (_slots(classes) - 1) // 2
    counts = class_bigrams(group, unit, slot, n, k)
    words = len(group) - 2
    batch = max(1, min(batch, words // 64))
    edges = np.searchsorted(unit, np.append(np.arange(0, words, batch), words))
    for at, (x, y) in zip(range(0, words, batch), zip(edges, edges[1:])):
        size = min(batch, words - at)
        dense = np.zeros((size, 2 * k + 1))
        dense[unit[x:y] - at, slot[x:y]] = n[x:y]
        ahead, behind, own = dense[:, :k], dense[:, k : 2 * k], dense[:, 2 * k]
        rows, now = np.arange(size), group[at : at + size]
        ahead[rows, now] = np.maximum(ahead[rows, now] - own, 0)
        behind[rows, now] = np.maximum(behind[rows, now] - own, 0)
        gain, logs = np.zeros((size, k)), _xlog(counts)
        for part, other, table in ((ahead, behind, counts.T), (behind, ahead, counts)):
            w, d = np.nonzero(part)
            if len(w) == 0:
                continue
            v, a = part[w, d], now[w]
            terms = _raised(table, logs.T if table is not counts else logs, d, v)
            left = table[d, a] - v  # what the word gives its own class counts once
            terms[np.arange(len(w)), a] = _xlog(left + v) - _xlog(left)
            same = np.nonzero(d == a)[0]
            cells = table[d[same]]
            cells[np.arange(len(same)), a[same]] -= v[same] + own[w[same]]
            cells -= other[w[same]]
            terms[same] = _xlog(cells + v[same, None]) - _xlog(cells)
            starts = np.nonzero(np.diff(w, prepend=-1))[0]
            gain[w[starts]] += np.add.reduceat(terms, starts)
        corner = np.tile(np.diagonal(counts), (size, 1))
        corner[rows, now] -= ahead[rows, now] + behind[rows, now] + own
        gain += _xlog(corner + ahead + behind + own[:, None]) - _xlog(corner + ahead) - _xlog(corner + behind) + _xlog(corner)
        for total, part in ((counts.sum(1), ahead), (counts.sum(0), behind)):
            mass = (part.sum(1) + own)[:, None]
            left = np.tile(total, (size, 1))
            left[rows, now] -= mass[:, 0]
            gain -= _xlog(left + mass) - _xlog(left)
        gain[rows, now] += 1e-9
        best = np.argmax(gain[:, :classes], 1)
        gone = np.nonzero(best != now)[0]
        change = np.zeros((k, len(gone)))
        change[best[gone], np.arange(len(gone))] = 1
        change[now[gone], np.arange(len(gone))] = -1
        counts += change @ ahead[gone] + (change @ behind[gone]).T
        counts[np.arange(k), np.arange(k)] += change @ own[gone]
        group[at : at + size] = best
        moved += len(gone)
    return group, moved


def _slots(classes: int) -> int:
    return 2 * (classes + 2) + 1


def class_bigrams(group: np.ndarray, unit: np.ndarray, slot: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """How often each of ``k`` classes stands before each, from the rows of ``neighbours``."""
    table = np.zeros(k * (2 * k + 1))
    for at in range(0, len(unit), STEP):
        part = slice(at, at + STEP)
        table += np.bincount(group[unit[part]] * (2 * k + 1) + slot[part], n[part], len(table))
    return table.reshape(k, 2 * k + 1)[:, :k].copy()


class Model:
    """What scoring needs of a corpus, apart from the counts of unlisted words."""

    def __init__(self, listed: list[tuple[bytes, int]], texts: int, tokens: int, distinct: int, once: int):
        self.index = {w: i for i, (w, _) in enumerate(listed)}
        self.counts = np.array([c for _, c in listed], np.float64)
        self.texts, self.tokens, self.distinct, self.once = texts, tokens, distinct, once
        self.unlisted_tokens = tokens - texts - self.counts.sum()
        self.unlisted_words = distinct - len(listed) - (texts > 0)
        k = min(CLUSTERED, len(listed))
        #: Units of the bigram table: clustered words, buckets of listed ones, unlisted ones, and the end.
        self.units = k + BUCKETS + 2
        self.unit = np.arange(len(listed))
        self.unit[k:] = k + np.minimum(np.log2(np.maximum(self.counts[k:], 1)).astype(np.int64), BUCKETS - 1)
        self.clustered, self.other, self.end = k, k + BUCKETS, k + BUCKETS + 1

    def tokens_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Listed ids of all words (-1: not listed), offsets of texts, and the words."""
        words, bounds = split_words(texts, lower=True)
        get = self.index.get
        ids = np.fromiter((get(w, -1) for w in words.dictionary.to_pylist()), np.int64, len(words.dictionary))
        codes = words.indices.to_numpy(zero_copy_only=False)
        return ids[codes] if len(codes) else np.empty(0, np.int64), bounds, words

    def chain(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of all texts with an end behind each; offsets; the place of each word."""
        lengths = np.diff(bounds)
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(ids)) + text
        units = np.full(len(ids) + len(lengths), self.end, np.int64)
        units[place] = np.where(ids >= 0, self.unit[ids], self.other) if len(self.unit) else self.other
        return units, bounds + np.arange(len(bounds)), place

    def start(self, bigrams: np.ndarray) -> None:
        """Classes of the most frequent words from the bigram table of units; from now on each listed word is a unit."""
        k, n = self.clustered, len(self.counts)
        groups = exchange_clusters(bigrams[:k, :k], CLASSES) if k else np.empty(0, np.int64)
        self.classes = int(groups.max(initial=-1)) + 1
        self.unit = np.arange(n)
        self.units, self.other, self.end = n + 2, n, n + 1
        #: Words without a class yet count as unlisted.
        self.group = np.full(n + 2, self.classes, np.int64)
        self.group[:k], self.group[-1] = groups, self.classes + 1

    def learn(self, counts: np.ndarray) -> None:
        """Transitions and shares from the table of class bigrams; classes without words go."""
        used, self.group = np.unique(self.group, return_inverse=True)
        counts, n = counts[np.ix_(used, used)].astype(np.float64), len(used)
        counts[:, self.group[self.other]] *= 1 + self.once / max(1.0, self.unlisted_tokens)  # new words are as likely as words seen once
        share = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * n)
        self.transitions = np.log10((counts + PRIOR * share) / (counts.sum(1, keepdims=True) + PRIOR))
        mass = np.bincount(self.group[self.unit], self.counts, n) if len(self.counts) else np.zeros(n)
        self.emission = np.log10(self.counts / mass[self.group[self.unit]]) if len(self.counts) else np.empty(0)
        self.unlisted = -np.log10(self.unlisted_tokens + self.unlisted_words + 1)

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        """Of each text what its listed words and its end add; unlisted ones lack log10 of their counts plus 1."""
        units, edges, place = self.chain(ids, bounds)
        group = self.group[units]
        before = np.concatenate([[self.group[self.end]], group[:-1]]) if len(group) else group
        parts = self.transitions[before, group]  # a text starts behind the end of another
        known = ids >= 0
        listed = np.maximum(ids, 0)
        parts[place] += np.where(known, self.emission[listed], self.unlisted) if len(self.emission) else self.unlisted
        base = np.full(len(units), np.log10(self.texts + 1.0))
        base[place] = np.where(known, np.log10(self.counts[listed] + 1), 0.0) if len(self.counts) else 0.0
        base -= np.log10(self.tokens + self.distinct + 1.0)
        parts = np.log10(MIX * 10.0**parts + (1 - MIX) * 10.0**base)  # of unlisted words both lack the same factor
        total = lambda x: np.add.reduceat(x, edges[:-1]) if len(edges) > 1 else np.empty(0)
        seen = np.full(len(units), int(self.texts > 0), np.int64)
        seen[place] = known
        n = np.diff(edges)
        return {"n_tokens": n, "n_known": total(seen), "base": total(base), "score": total(parts)}


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word binary`` and ``n``: how often all texts have each word, A-Z lower-cased."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encoded() -> Iterator[tuple[pa.Array, np.ndarray]]:
            for batch in pieces(batches):
                words, _ = split_words(batch.column("text"), lower=True)
                yield words.dictionary, words.indices.to_numpy(zero_copy_only=False)

        yield from partial_counts(encoded())

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word binary, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers from 0 by the place of their bytes, which compresses better than one after the other.

    The first byte tells how many places there are; higher ones are 0 in all of ``values``.
    """
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    places = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return bytes([width]) + places[:, :width].T.tobytes()


def _values(blob: bytes, kind: type) -> np.ndarray:
    width = blob[0]
    size = (len(blob) - 1) // width
    found = np.zeros((size, np.dtype(kind).itemsize), np.uint8)
    found[:, :width] = np.frombuffer(blob, np.uint8)[1:].reshape(width, size).T
    return found.view(kind).ravel()


def followers(chains: Iterator[np.ndarray], end: int) -> Iterator[pa.RecordBatch]:
    """Pairs of units that follow each other in ``chains``, each of which starts behind ``end``, and how often, for ``HELD`` tokens together.

    The sweeps read these in place of the tokens: what a pass costs depends on the different pairs.
    """
    held: list[np.ndarray] = []
    tokens = 0

    def counted() -> pa.RecordBatch:
        keys = np.concatenate(held)
        keys.sort()
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        n, keys = np.diff(starts, append=len(keys)), keys[starts]
        return pa.record_batch([pa.array([_planes(c)], pa.binary()) for c in (keys >> 32, keys & 0xFFFFFFFF, n)], ["before", "unit", "n"])

    for chain in chains:
        for at in range(0, len(chain), HELD):
            units = chain[at : at + HELD].astype(np.int64)
            before = np.concatenate([[chain[at - 1] if at else end], units[:-1]])
            if held and tokens + len(units) > HELD:
                yield counted()
                held, tokens = [], 0
            held.append(before << 32 | units)
            tokens += len(units)
    if tokens:
        yield counted()


def neighbours(pairs: DataFrame, group: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each unit stands before each class, behind it, and before itself: units, slots and counts, sorted.

    ``pairs`` has the rows of ``followers``. Each task adds up its own counts and sends them packed, for every
    ``RANGES``-th unit together, so that frequent words spread; parts are added up in groups of ``PARTS`` first,
    so that no task holds those of all others.
    """
    shared, slots = pairs.sparkSession.sparkContext.broadcast(group), 2 * classes + 1
    width = -(-len(group) // RANGES) * slots
    salts = -(-pairs.rdd.getNumPartitions() // PARTS)
    names, full = ["range", "salt", "keys", "n"], FULL

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tokens = shared.value, 0
        ahead, behind, own = (np.zeros(n, np.int32) for n in (len(group) * classes, len(group) * classes, len(group)))
        for batch in batches:
            for row in range(batch.num_rows):
                before, unit = (_values(batch.column(c)[row].as_py(), np.int64) for c in ("before", "unit"))
                n = _values(batch.column("n")[row].as_py(), np.int32)
                if tokens + int(n.sum()) > full:
                    yield from packed(ahead, behind, own)
                    tokens = 0
                    for counts in (ahead, behind, own):
                        counts.fill(0)
                tokens += int(n.sum())
                for at in range(0, len(n), STEP):
                    a, b, v = (x[at : at + STEP] for x in (before, unit, n))
                    np.add.at(ahead, a * classes + group[b], v)
                    np.add.at(behind, b * classes + group[a], v)
                    np.add.at(own, b[a == b], v[a == b])
        yield from packed(ahead, behind, own)

    def packed(ahead: np.ndarray, behind: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        ahead, behind, own = ahead.reshape(-1, classes), behind.reshape(-1, classes), own[:, None]
        salt = TaskContext.get().partitionId() % salts
        for r in range(RANGES):
            part = np.concatenate([ahead[r::RANGES], behind[r::RANGES], own[r::RANGES]], 1).ravel()
            at = np.flatnonzero(part)
            if len(at):
                yield pa.record_batch([pa.array([r], pa.int32()), pa.array([salt], pa.int32()), pa.array([_planes(at)]), pa.array([_planes(part[at])])], names)

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for keys, n in zip(rows["keys"].to_pylist(), rows["n"].to_pylist()):
            total[_values(keys, np.uint32)] += _values(n, np.int64)
        at = np.flatnonzero(total)
        return pa.table([rows["range"].slice(0, 1), rows["salt"].slice(0, 1), pa.array([_planes(at)]), pa.array([_planes(total[at])])], names)

    schema = "range int, salt int, keys binary, n binary"
    found = pairs.mapInArrow(count, schema)
    if salts > 1:
        found = found.groupBy("range", "salt").applyInArrow(added, schema)
    rows = found.groupBy("range").applyInArrow(added, schema).toArrow()  # at most units times slots
    shared.destroy()
    sizes = np.zeros(len(group), np.int64)
    for r, keys in zip(rows["range"].to_pylist(), rows["keys"]):
        sizes[r::RANGES] = np.bincount(_values(keys.as_py(), np.int64) // slots, minlength=len(sizes[r::RANGES]))
    edges = np.append(0, np.cumsum(sizes))
    slot, count_of = np.empty(edges[-1], np.int16 if slots < 1 << 15 else np.int32), np.empty(edges[-1], np.int64)
    for r, keys, n in zip(rows["range"].to_pylist(), rows["keys"], rows["n"]):  # cells of a unit come together, in order
        keys, size = _values(keys.as_py(), np.int64), sizes[r::RANGES]
        at = np.arange(len(keys)) + np.repeat(edges[:-1][r::RANGES] - (np.cumsum(size) - size), size)
        slot[at], count_of[at] = keys % slots, _values(n.as_py(), np.int64)
    return np.repeat(np.arange(len(group), dtype=np.int32), sizes), slot, count_of


def train(docs: DataFrame, text: str = "text", listed: int = LISTED) -> tuple[Model, DataFrame]:
    """The model of all texts in ``docs``, and the counts of all words."""
    counts = checkpointed(word_counts(docs, text))
    words, distinct, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") == 1)).first()
    texts = docs.count()
    top = most_frequent(counts, listed, least=2)
    model = Model(list(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True)), texts, words + texts, distinct + (texts > 0), once)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = np.zeros(model.units * model.units, np.int64)
        for batch in pieces(batches):
            ids, bounds, _ = model.tokens_of(batch.column("text"))
            units, _, _ = model.chain(ids, bounds)
            before = np.concatenate([[model.end], units[:-1]])
            table += np.bincount(before * model.units + units, minlength=len(table))
        at = np.nonzero(table)[0]
        if len(at):
            yield pa.record_batch([pa.array(at), pa.array(table[at])], ["pair", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(pairs, "pair long, n long")
    rows = found.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most units squared
    bigrams = np.zeros(model.units * model.units)
    bigrams[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    model.start(bigrams.reshape(model.units, model.units))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        chains = (model.chain(*model.tokens_of(batch.column("text"))[:2])[0] for batch in pieces(batches))
        yield from followers(chains, model.end)

    pairs_of_units = checkpointed(docs.select(F.col(text).cast("string").alias("text")).mapInArrow(coded, "before binary, unit binary, n binary"))
    best, before, moved, k = None, model.group, len(model.group), model.classes + 2
    for sweep in range(ALL_SWEEPS + 1):
        unit = slot = n = None  # those of the pass before go first
        unit, slot, n = neighbours(pairs_of_units, model.group, k)
        table = class_bigrams(model.group, unit, slot, n, k)
        # the first sweep gives the rest their classes, which no longer count as unlisted
        if sweep > 1 and likelihood(table) < likelihood(best):
            model.group = before
            break
        best, before = table, model.group
        if sweep == ALL_SWEEPS or moved <= FEW * len(model.group) or not model.classes:
            break
        model.group, moved = exchange_sweep(model.group, unit, slot, n, model.classes)
    release(pairs_of_units)
    model.learn(best)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, n_tokens, n_known, train_tokens, base_score, score and perplexity, a row for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            ids, bounds, words = model.tokens_of(batch.column("text"))
            got = model.score(ids, bounds)
            unlisted = np.nonzero(ids < 0)[0]
            rare = words.take(pa.array(unlisted)).cast(pa.large_binary()).cast(pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(unlisted, bounds).astype(np.int32)), rare)
            yield pa.record_batch([batch.column("row"), batch.column("doc"), *(pa.array(got[c]) for c in ("n_tokens", "n_known", "base", "score")), lists], ["row", "doc", "n_tokens", "n_known", "base", "score", "rare"])

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    part = checkpointed(rows.mapInArrow(run, f"row long, doc {kind}, n_tokens long, n_known long, base double, score double, rare array<binary>"))
    rare = part.select("row", F.explode("rare").alias("word")).join(counts, "word").groupBy("row")
    rare = rare.agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("seen"))
    none = lambda c: F.coalesce(c, F.lit(0))
    score = F.col("score") + none("more")
    return part.join(rare, "row", "left").select(
        F.col("doc").alias(doc),
        "n_tokens",
        (F.col("n_known") + none("seen")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + none("more")).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
