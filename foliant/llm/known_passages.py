"""Removal of passages of a bounded reference, by broadcast suffix automata of its shards.

Each shard of the reference becomes one suffix automaton over words. Documents stream
through them: at each word the automaton tells the longest match that ends there
(matching statistics), and all words of matches of ``width`` words or more go, which are
the maximal spans above that length. A reference of more than ``MOST_WORDS`` words is
refused, since all its automata are broadcast; for a larger one, ``substring_dedup`` on the
union of both, with smaller ids for the reference's texts, has no such bound, but it also
removes what documents repeat of each other.

Texts are cut into lanes of ``LANE`` words, each read from ``width`` - 1 words before it,
so that lanes of all texts step together and no text is too long. Words are compared by
64-bit fingerprints.

Defined cases: null texts have no words and give ""; texts of the reference without words
have no spans; a span never runs from one text of the reference into the next; an empty
reference removes nothing, and an empty table of documents gives no rows; repeated rows are
rows of their own, and repeated texts of the reference change nothing; a very long text is
read in lanes, whole; ids are not read. Columns named like the added ones are replaced,
other extra ones stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import pieces, split_words, word_fingerprints

WIDTH, SHARD_WORDS, MOST_WORDS, LANE = 20, 250_000, 2_000_000, 512


class Automaton:
    """The suffix automaton of texts, given as fingerprints of words and where texts begin, in flat arrays.

    ``first`` has the least place at which a state's strings end.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.words, codes = np.unique(words, return_inverse=True)
        arcs: list[dict[int, int]] = [{}]
        link, length, first, last = [-1], [0], [-1], 0
        begins = set(bounds.tolist())
        for place, word in enumerate(codes.tolist()):
            if place in begins:  # a word that no text has keeps texts apart
                last = self._grow(arcs, link, length, first, last, -1 - place, place)
            last = self._grow(arcs, link, length, first, last, word, place)
        counts = np.fromiter(map(len, arcs), np.int64, len(arcs))
        state = np.repeat(np.arange(len(arcs)), counts)
        label = np.fromiter((w for a in arcs for w in a), np.int64, int(counts.sum()))
        target = np.fromiter((t for a in arcs for t in a.values()), np.int64, int(counts.sum()))
        real = label >= 0
        self.span = len(self.words) + 1
        keys = state[real] * self.span + label[real]
        order = np.argsort(keys)
        self.keys, self.target = keys[order], target[real][order].astype(np.int32)
        self.link, self.length, self.first = (np.array(x, np.int32) for x in (link, length, first))
        self.link[0] = 0

    @staticmethod
    def _grow(arcs: list, link: list, length: list, first: list, last: int, word: int, place: int) -> int:
        state = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        first.append(place)
        link.append(0)
        p = last
        while p >= 0 and word not in arcs[p]:
            arcs[p][word] = state
            p = link[p]
        if p >= 0:
            q = arcs[p][word]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[state] = copy
                while p >= 0 and arcs[p].get(word) == q:
                    arcs[p][word] = copy
                    p = link[p]
        return state

    def ends(self, words: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
        """For each word the least place of the reference where the ``width`` words up to it end, or -1."""
        found = np.full(len(words), -1, np.int64)
        if len(self.words) == 0 or len(words) == 0:
            return found
        code = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        code = np.where(self.words[code] == words, code, -1)
        lengths = np.diff(bounds)
        n = -(-lengths // LANE)
        text = np.repeat(np.arange(len(lengths)), n)
        own = bounds[:-1][text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        at, stop = np.maximum(bounds[:-1][text], own - width + 1), np.minimum(own + LANE, bounds[1:][text])
        state, matched = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while len(at):
            word = code[at]
            todo = np.arange(len(at))
            while len(todo):
                key = state[todo] * self.span + word[todo]
                arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = (self.keys[arc] == key) & (word[todo] >= 0)
                state[todo[ok]] = self.target[arc[ok]]
                matched[todo[ok]] += 1
                todo = todo[~ok]
                matched[todo[state[todo] == 0]] = 0
                todo = todo[state[todo] > 0]
                state[todo] = self.link[state[todo]]
                matched[todo] = self.length[state[todo]]
            some = np.nonzero(matched >= width)[0]
            if len(some):
                s = state[some]
                while (longer := self.length[self.link[s]] >= width).any():
                    s = np.where(longer, self.link[s], s)
                found[at[some]] = self.first[s]
            at = at + 1
            live = at < stop
            at, stop, state, matched = at[live], stop[live], state[live], matched[live]
        return found


def automata(reference: DataFrame, text: str = "text", shard_words: int = SHARD_WORDS, most_words: int = MOST_WORDS) -> list[Automaton]:
    """Automata of a reference of ``most_words`` words at most; a text is never cut."""
    rows = reference.select(F.col(text).cast("string").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))).first()[0] or 0
    if total > most_words:
        raise ValueError(f"the reference has {total} words; {most_words} may be broadcast")
    words, bounds = split_words(pa.array([r["text"] for r in rows.collect()], pa.string()), lower=False)  # bounded above
    codes = words.indices.to_numpy(zero_copy_only=False)
    h = word_fingerprints(words.dictionary)[codes] if len(codes) else np.empty(0, np.uint64)
    found, start = [], 0
    for i in range(1, len(bounds)):
        if i == len(bounds) - 1 or bounds[i + 1] - bounds[start] > shard_words:
            found.append(Automaton(h[bounds[start] : bounds[i]], bounds[start:i] - bounds[start]))
            start = i
    return found


def drop_known(docs: DataFrame, reference: DataFrame, text: str = "text", reference_text: str = "text", width: int = WIDTH, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``text`` of the words that stay, joined by one space, and n_words and n_removed as long."""
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    shared = docs.sparkSession.sparkContext.broadcast(automata(reference, reference_text, shard_words))
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            words, bounds = split_words(batch.column(at), lower=False)
            codes = words.indices.to_numpy(zero_copy_only=False)
            h = word_fingerprints(words.dictionary)[codes] if len(codes) else np.empty(0, np.uint64)
            gone = np.zeros(len(h) + 1, np.int64)
            for automaton in shared.value:
                ends = np.nonzero(automaton.ends(h, bounds, width) >= 0)[0]
                np.add.at(gone, ends - width + 1, 1)
                np.add.at(gone, ends + 1, -1)
            stays = np.cumsum(gone)[:-1] == 0
            edges = np.concatenate([[0], np.cumsum(stays)])[bounds]
            left = words.take(pa.array(np.nonzero(stays)[0])).cast(pa.large_binary()).to_pylist()
            texts = [b" ".join(left[a:b]).decode() for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
            n = np.diff(bounds)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
            yield pa.record_batch([*columns, pa.array(n, pa.int64()), pa.array(n - np.diff(edges), pa.int64())], [*kept, "n_words", "n_removed"])

    from pyspark.sql import types as T

    rows = docs.select(*[F.col(c).cast("string").alias(c) if c == text else F.col(c) for c in kept])
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]))
