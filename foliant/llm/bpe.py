"""Byte-level BPE encoding and decoding through a minimal acyclic transducer.

Frequent pieces of the whole corpus are compiled, with their token ids as
outputs, into an automaton that shares suffixes as well as prefixes (Daciuk et
al., incremental construction from sorted words). An arc's output is a number;
the sum along a path is the word's rank, and the rank points into one packed
array of ids. The compiled lexicon is a flat byte image that every worker maps
into memory; pieces it lacks are merged exactly by the vocabulary's ranks.

Results equal those of the public tokenizers library for the same file: special
tokens that occur in a text become their id, and the rest is split by the
byte-level pattern.

Defined cases: null and empty texts have no ids, and ids decode to "" then; arrays of ids
that are null decode to null; blank texts keep their blanks; repeated rows are rows of
their own; a null id stays null; a very long text is encoded whole, as is a piece of any
length; pieces of equal count enter the lexicon in the order of their bytes, which changes
no result; an empty table gives no rows. Only id and text are read and only they and the
added columns come back, whatever other columns there are; ``decode`` keeps all columns and
replaces one that is named like its own.
"""

from __future__ import annotations

import functools
import heapq
import json
import mmap
import struct
import tempfile
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .arrow_text import gather, partial_counts, pieces, utf8_buffer
from .frequency import most_frequent
from .storage import checkpointed

#: Bytes of text that a task cuts, or encodes and decodes, at a time.
ENCODED_BYTES = 1 << 20
#: Number of frequent pieces that the lexicon holds; the rest is merged on demand.
LEXICON_SIZE = 131_072
LETTER, NUMBER, OTHER, SPACE, SPECIAL = range(5)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def character_classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library sees it.

    Two Unicode tables of different age agree on nearly all; the library is asked
    about the others.
    """
    import unicodedata

    import regex
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
        elif kind == "Z" or 9 <= c <= 13 or c == 0x85:
            table[c] = SPACE
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    newer = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        newer[[ord(c) for c in regex.findall(pattern, every)]] = kind
    for c in np.nonzero(table != newer)[0].tolist():
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        table[c] = next((k for lead, k in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if len(split(lead + s)) == 1), SPACE)
    return table


def piece_bounds(raw: np.ndarray, offs: np.ndarray, special: Iterable[bytes] = (), classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the byte-level pattern cuts texts laid end to end: starts of pieces, and which are special tokens."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, bool)
    table = character_classes() if classes is None else classes
    cls = table[raw.astype(np.int32)]
    wide = np.nonzero(raw >= 0xC0)[0]
    if len(wide):
        lead = raw[wide].astype(np.int32)
        tail = lambda at, k: raw[at + k].astype(np.int32) & 0x3F
        for lo, hi, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
            at = wide[(lead >= lo) & (lead < hi)]
            if len(at) == 0:
                continue
            point = raw[at].astype(np.int32) & (0x7F >> size)
            for k in range(1, size):
                point = (point << 6) | tail(at, k)
            kind = table[point]
            for k in range(size):
                cls[at + k] = kind
    begins = np.zeros(n + 1, bool)
    begins[offs] = True
    whole = raw.tobytes()
    spans = []
    for word in special:
        at = whole.find(word)
        while at >= 0:
            text = int(np.searchsorted(offs, at, side="right")) - 1
            if at + len(word) <= offs[text + 1]:
                spans.append((at, at + len(word)))
                at = whole.find(word, at + len(word))
            else:
                at = whole.find(word, at + 1)
    for a, b in spans:
        cls[a:b] = SPECIAL
        begins[a] = begins[b] = True
    runs = begins[:n].copy()
    runs[1:] |= cls[1:] != cls[:-1]
    cut = runs.copy()
    after = np.nonzero(runs[1:] & (cls[1:] < SPACE) & (cls[:-1] == SPACE) & ~begins[1:n])[0] + 1
    blank = after - 1  # the last white-space character before a run stands alone or leads it
    for _ in range(3):
        inside = (raw[blank] & 0xC0) == 0x80
        blank = blank - inside
    cut[blank] = True
    cut[after[raw[after - 1] == 0x20]] = False
    quote = np.nonzero((raw[:-1] == 0x27) & cut[:-1] & runs[1:] & ~begins[1:n] & (cls[1:] == LETTER))[0] if n > 1 else np.empty(0, np.int64)
    if len(quote):
        padded = np.concatenate([raw[: n], np.zeros(2, np.uint8)])
        x, y = padded[quote + 1], padded[quote + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        joined = ~begins[np.minimum(quote + 2, n)]
        two = joined & (((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l"))))
        short = quote[one | two]
        cut[short + 1] = False
        rest = short + 2 + two[one | two]
        cut[rest[rest < n]] = True
    starts = np.nonzero(cut)[0]
    return starts, cls[starts] == SPECIAL


class Vocabulary:
    """Token ids, merge ranks and special tokens of a byte-level vocabulary file."""

    #: Pieces of so many bytes are merged by scanning all pairs; no pair has the rank NONE.
    SHORT, NONE = 48, (1 << 62, -1)
    #: Bytes of pieces that ``merge_all`` works on at a time.
    MERGED_BYTES = 1 << 17

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE vocabulary without a leading space is needed")
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens") or []}
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items() if s.encode() not in self.special}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for table in (self.ids, self.special):
            for word, i in table.items():
                self.tokens[i] = word
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            self.ranks.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        # the same as arrays: pairs as sorted numbers (no token has the id ``size``), and what each makes
        pairs = np.array(list(self.ranks), np.int64).reshape(-1, 2)
        made = np.array(list(self.ranks.values()), np.int64).reshape(-1, 2)
        numbers = pairs[:, 0] * (size + 1) + pairs[:, 1]
        order = np.argsort(numbers)
        self.pairs, self.pair_rank = np.append(numbers[order], 1 << 62), np.append(made[order, 0], self.NONE[0] >> 32)
        self.made = np.zeros(len(model["merges"]), np.int32)
        self.made[made[:, 0]] = made[:, 1]
        self.single_ids = np.array(self.single, np.int32)
        self.byte_rank = self._rank(self.single_ids.repeat(256), np.tile(self.single_ids, 256)).reshape(256, 256)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE shifted by 32 bits where they never merge."""
        number = left.astype(np.int64) * (len(self.tokens) + 1) + right
        at = np.searchsorted(self.pairs, number)
        return np.where(self.pairs[at] == number, self.pair_rank[at], self.NONE[0] >> 32)

    def merge_all(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces of ``raw``, flat, and their offsets; each as ``merge`` gives them."""
        counts, found, short = np.zeros(len(starts), np.int64), [], np.nonzero(lengths <= self.SHORT)[0]
        short = short[np.argsort(lengths[short], kind="stable")]
        sums = np.cumsum(lengths[short])
        a = 0
        while a < len(short):
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + self.MERGED_BYTES, side="right")))
            ids, counts[short[a:b]] = self._merge_rounds(raw, starts[short[a:b]], lengths[short[a:b]])
            found.append(ids)
            a = b
        long = np.nonzero(lengths > self.SHORT)[0]
        for i, start, n in zip(long.tolist(), starts[long].tolist(), lengths[long].tolist(), strict=True):
            found.append(np.array(self._merge_long(raw[start : start + n].tobytes()), np.int32))
            counts[i] = len(found[-1])
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        flat, order = np.empty(int(ends[-1]), np.int32), np.concatenate([short, long])
        flat[gather(ends[order], counts[order])] = np.concatenate([np.empty(0, np.int32), *found])
        return flat, ends

    def _merge_rounds(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for pieces by rising length; each round merges one pair of every piece that has one.

        Ids are a linked list in place, whose last item stands for both ends of every piece. A pair's
        key is its rank, then its place, so that the least is the one to merge.
        """
        edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        total, filled = int(edges[-1]), lengths > 0
        data = raw[gather(starts, lengths)]
        ids = np.append(self.single_ids[data], len(self.tokens))
        after, before = np.arange(1, total + 2), np.arange(-1, total)
        after[edges[1:][filled] - 1] = before[edges[:-1][filled]] = total
        none = self.NONE[0]
        keys = np.full(total + 1, none)
        if total > 1:
            keys[: total - 1] = (self.byte_rank[data[:-1], data[1:]] << 32) + np.arange(total - 1)
        keys[after == total] = none
        for merged in range(1, self.SHORT):  # a piece of n bytes has n - 1 merges at most
            first = int(np.searchsorted(lengths, merged, side="right"))
            if first == len(lengths):
                break
            base = edges[first]
            least = np.minimum.reduceat(keys[base:total], edges[first:-1] - base)
            least = least[least < none]
            if len(least) == 0:
                break
            at = least & 0xFFFFFFFF
            gone, previous = after[at], before[at]
            following = after[gone]
            ids[at], ids[gone] = self.made[least >> 32], -1
            after[at], before[following], keys[gone] = following, at, none
            keys[at] = (self._rank(ids[at], ids[following]) << 32) + at
            keys[previous] = (self._rank(ids[previous], ids[at]) << 32) + previous
        alive = np.nonzero(ids[:total] >= 0)[0]
        return ids[alive], np.diff(np.searchsorted(alive, edges))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by its merges, lowest rank first and leftmost of equals."""
        if len(piece) > self.SHORT:
            return self._merge_long(piece)
        ids, get, none = [self.single[b] for b in piece], self.ranks.get, self.NONE
        found = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], best[1]), none)
            if i < len(found):
                found[i] = get((best[1], ids[i + 1]), none)
        return ids

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a queue of ranked pairs over a linked list, in n log n."""
        ids, ranks = [self.single[b] for b in piece], self.ranks
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := ranks.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The flat image of the minimal acyclic transducer that maps each word to its ids.

    Layout: five int64 (states, arcs, words, ids, root), then int32 for the first arc of each
    state, arc targets, arc outputs, offsets of ids and ids, then a byte for each arc's label
    and each state's final flag.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    finals: list[bool] = []
    below: list[int] = []

    def freeze(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, *arcs)
        state = register.get(key)
        if state is None:
            state = register[key] = len(arcs_of)
            arcs_of.append(tuple(arcs))
            finals.append(final)
            below.append(final + sum(below[t] for _, t in arcs))
        return state

    path: list[list] = [[False, []]]  # the open states: final, arcs to frozen ones
    last = b""

    def close(keep: int) -> None:
        for depth in range(len(last), keep, -1):
            final, arcs = path.pop()
            path[-1][1].append((last[depth - 1], freeze(final, arcs)))

    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    close(0)
    root = freeze(path[0][0], path[0][1])
    first = np.zeros(len(arcs_of) + 1, np.int64)
    first[1:] = np.cumsum([len(a) for a in arcs_of])
    label, target, output = (np.zeros(int(first[-1]), np.int64) for _ in range(3))
    for state, arcs in enumerate(arcs_of):
        out = int(finals[state])
        for k, (byte, to) in enumerate(arcs):
            at = int(first[state]) + k
            label[at], target[at], output[at] = byte, to, out
            out += below[to]
    lengths = np.array([len(entries[w]) for w in words], np.int64)
    ids = np.array([i for w in words for i in entries[w]], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    head = struct.pack("<5q", len(arcs_of), len(label), len(words), len(ids), root)
    wide, narrow = (first, target, output, offsets, ids), (label, np.array(finals))
    return head + b"".join([*(p.astype("<i4").tobytes() for p in wide), *(p.astype(np.uint8).tobytes() for p in narrow)])


class Lexicon:
    """Look-ups in a compiled image, for many words at once, a byte of each at a time."""

    def __init__(self, image: bytes | mmap.mmap):
        states, arcs, words, ids, self.root = struct.unpack_from("<5q", image)
        at, parts = 40, []
        for n, kind in ((states + 1, "<i4"), (arcs, "<i4"), (arcs, "<i4"), (words + 1, "<i4"), (ids, "<i4"), (arcs, "u1"), (states, "u1")):
            parts.append(np.frombuffer(image, kind, n, at))
            at += parts[-1].nbytes
        first, self.target, self.output, self.offsets, self.ids, label, self.final = parts
        self.keys = np.repeat(np.arange(states, dtype=np.int64), np.diff(first)) * 256 + label

    @classmethod
    def mapped(cls, image: bytes) -> Lexicon:
        """Over a memory map of an unlinked file, which the system can drop and page in again."""
        with tempfile.TemporaryFile() as file:
            file.write(image)
            file.flush()
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def ranks(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 where the lexicon lacks it."""
        n = len(starts)
        result = np.full(n, -1, np.int64)
        if n == 0 or len(self.keys) == 0:
            return result
        live = np.nonzero(lengths > 0)[0]
        state, total = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state.astype(np.int64) * 256 + raw[starts[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc, total = live[ok], arc[ok], total[ok]
            state, total = self.target[arc], total + self.output[arc]
            step += 1
            done = lengths[live] == step
            ends = done & (self.final[state] == 1)
            result[live[ends]] = total[ends]
            live, state, total = live[~done], state[~done], total[~done]
        return result


class Codec:
    """Encodes Arrow string arrays to flat ids and offsets, and back."""

    def __init__(self, content: bytes, image: bytes | None = None, classes: np.ndarray | None = None):
        self.vocabulary = Vocabulary(content)
        self.lexicon = Lexicon.mapped(image) if image else None
        self.classes = classes
        self.token_bytes = pa.array(self.vocabulary.tokens, pa.large_binary())

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """Pieces of texts, dictionary-encoded; which pieces are special; offsets of texts into pieces."""
        raw, offs = utf8_buffer(texts)
        starts, special = piece_bounds(raw, offs, self.vocabulary.special, self.classes)
        edges = np.append(starts, len(raw)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw))])
        return words.dictionary_encode(), special, np.searchsorted(starts, offs).astype(np.int64)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, flat, and their offsets."""
        n = len(words)
        if n == 0:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        _, offsets, data = words.buffers()
        edges, raw = np.frombuffer(offsets, np.int64)[words.offset : words.offset + n + 1], np.frombuffer(data, np.uint8)
        lengths, ranks = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        if self.lexicon is not None:
            ranks = self.lexicon.ranks(raw, edges[:-1], np.diff(edges))
            lengths = np.where(ranks >= 0, self.lexicon.offsets[ranks + 1] - self.lexicon.offsets[ranks], 0).astype(np.int64)
        unseen, hit = np.nonzero(ranks < 0)[0], np.nonzero(ranks >= 0)[0]
        merged, bounds = self.vocabulary.merge_all(raw, edges[unseen], np.diff(edges)[unseen])
        lengths[unseen] = np.diff(bounds)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        flat = np.empty(int(ends[-1]), np.int32)
        flat[gather(ends[unseen], lengths[unseen])] = merged
        if len(hit):
            flat[gather(ends[hit], lengths[hit])] = self.lexicon.ids[gather(self.lexicon.offsets[ranks[hit]].astype(np.int64), lengths[hit])]
        return flat, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in a row, and the offsets of each text."""
        words, special, bounds = self.cut(texts)
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = words.dictionary
        flat, edges = self.lookup(names)
        if special.any():  # a special token is cut apart from an equal run of ordinary text by its flag only
            extra = np.nonzero(special)[0]
            known = {w: i for i, w in enumerate(names.to_pylist()) if w in self.vocabulary.special}
            ids = np.array([self.vocabulary.special[w] for w in known], np.int64)
            slot = np.full(len(names), -1, np.int64)
            slot[list(known.values())] = np.arange(len(known))
            codes[extra] = len(names) + slot[codes[extra]]
            flat, edges = np.concatenate([flat, ids]), np.concatenate([edges, edges[-1] + 1 + np.arange(len(ids))])
        lengths = np.diff(edges)[codes]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[gather(edges[:-1][codes], lengths)].astype(np.int32), ends[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text; bytes that are not UTF-8 become U+FFFD."""
        joined = self.token_bytes.take(pa.array(ids))
        _, offsets, data = joined.buffers()
        edges = np.frombuffer(offsets, np.int64)[joined.offset : joined.offset + len(joined) + 1]
        raw, at = (memoryview(data) if data is not None else memoryview(b"")), edges[bounds].tolist()
        return [bytes(raw[a:b]).decode("utf-8", "replace").encode() for a, b in zip(at, at[1:], strict=False)]


_codecs: weakref.WeakKeyDictionary[Broadcast, Codec] = weakref.WeakKeyDictionary()


def worker_codec(shared: Broadcast, content: bytes, image: bytes | None = None, classes: np.ndarray | None = None) -> Codec:
    """A codec that the tasks of a worker process share one after the other.

    It goes with ``shared``, the broadcast that it is made of: Spark takes that from a worker
    whose next task is of another kind, so that no worker keeps a codec for the rest of its life.
    """
    if shared not in _codecs:
        _codecs[shared] = Codec(content, image, classes)
    return _codecs[shared]


def decimal_lists(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each text its ids in decimal, joined by commas."""
    names = _decimals(1 << int(ids.max(initial=0)).bit_length()).take(pa.array(ids))
    _, offsets, data = names.buffers()
    edges = np.frombuffer(offsets, np.int64)[names.offset : names.offset + len(names) + 1]
    raw, at = (memoryview(data) if data is not None else memoryview(b"")), edges[bounds].tolist()
    return [bytes(raw[a : max(a, b - 1)]) for a, b in zip(at, at[1:], strict=False)]


@functools.cache
def _decimals(n: int) -> pa.Array:
    return pa.array([b"%d," % i for i in range(n)], pa.large_binary())


def frequent_pieces(docs: DataFrame, content: bytes, size: int = LEXICON_SIZE, text: str = "text") -> list[bytes]:
    """The most frequent pieces of all texts, ``size`` at most.

    Counts cover every text; each task adds up its own before the shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast((content, character_classes()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared, shared.value[0], classes=shared.value[1])

        def encoded() -> Iterator[tuple[pa.Array, np.ndarray]]:
            for batch in pieces(batches, limit=ENCODED_BYTES):
                words, special, _ = codec.cut(batch.column("text"))
                yield words.dictionary, words.indices.to_numpy(zero_copy_only=False)[~special]

        yield from partial_counts(encoded(), "piece")

    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "piece binary, n long")
    totals = checkpointed(counts.groupBy("piece").agg(F.sum("n").alias("n")))
    return most_frequent(totals, size, "piece")["piece"].to_pylist()


def build_lexicon(docs: DataFrame, vocabulary_path: str, size: int = LEXICON_SIZE, text: str = "text") -> tuple[bytes, bytes]:
    """The vocabulary file's content and the compiled lexicon of the corpus."""
    with open(vocabulary_path, "rb") as file:
        content = file.read()
    merge = Vocabulary(content).merge
    return content, compile_lexicon({p: merge(p) for p in frequent_pieces(docs, content, size, text)})


def _with_codec(docs: DataFrame, vocabulary_path: str, size: int, text: str, work, keep: list[Column], schema: str) -> DataFrame:
    content, image = build_lexicon(docs, vocabulary_path, size, text)
    shared = docs.sparkSession.sparkContext.broadcast((content, image, character_classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shared, *shared.value)
        for batch in pieces(batches, "_text", ENCODED_BYTES):
            yield work(codec, batch)

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text: str = "text", lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every text. Rows may repeat; extra columns are left out."""

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = codec.encode(batch.column("_text"))
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
        return pa.record_batch([batch.column(0), lists], ["_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = _with_codec(docs, vocabulary_path, lexicon_size, text, work, [F.col(id_col).alias("_id")], f"_id {kind}, ids array<int>")
    return out.withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds column ``out``: the text of each array of ids (null: null), special tokens included."""
    with open(vocabulary_path, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def text_of(column):
        import pandas as pd

        codec = worker_codec(shared, shared.value)
        none = column.isna()
        lengths = np.array([0 if m else len(v) for v, m in zip(column, none, strict=True)], np.int64)
        flat = np.concatenate([np.asarray(v, np.int64) for v, m in zip(column, none, strict=True) if not m] or [np.empty(0, np.int64)])
        texts = codec.decode(flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
        return pd.Series([None if m else t.decode() for t, m in zip(texts, none, strict=True)], dtype=object)

    return encoded.withColumn(out, text_of(ids))


def encode_and_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text: str = "text", lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """Each text encoded and its ids decoded again, as digests.

    Returns ``id_col``, n_tokens, ids_sha256 and decoded_sha256, a row for each input row.
    """
    import hashlib

    def work(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, bounds = codec.encode(batch.column("_text"))
        sha = lambda parts: [hashlib.sha256(p).hexdigest() for p in parts]
        return pa.record_batch([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(sha(decimal_lists(ids, bounds)), pa.string()), pa.array(sha(codec.decode(ids, bounds)), pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = _with_codec(docs, vocabulary_path, lexicon_size, text, work, [F.col(id_col).alias("_id")], schema)
    return out.withColumnRenamed("_id", id_col)
