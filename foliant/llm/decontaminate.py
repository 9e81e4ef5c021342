"""Benchmark decontamination: which words of a document lie in a passage of a benchmark.

A window is ``WINDOW`` consecutive words of an item (an item of fewer words, but not
none, is one window). The join finds every occurrence of every window:

1. A document has a window only if it has all its words, so by the prefix-filter rule one
   necessary token suffices to join on. Tokens are shingles of two words; the benchmark's
   shingles are counted over all documents, and each window is joined on its rarest.
2. A shingle's place in the document and in the window fixes where the window would start;
   starts before the first word and ends behind the last are ruled out (position, length).
3. What is left is compared with the window word by word, so fingerprints decide nothing.

Windows are broadcast in chunks of about ``CHUNK``, one or more joins in one plan, so what
is broadcast at a time is bounded however large the benchmark is. Documents' words pass
generator and join in one code-generated stage and only matches leave it; no text is
shuffled. Only DataFrame functions run.

Defined cases: null texts and texts without words, in documents or benchmark, have no
windows; a null doc_id is a row like any other; a very long text is one row, all of whose
words are looked at; of two equally rare shingles a window's first counts; an empty table
of documents gives no rows; a null item_id has no
name to list, but its passages count as hits; repeated items and documents change nothing
but the number of rows (each row of documents gives a row); an empty benchmark hits
nothing. Extra columns are left alone; those named like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import checkpointed

WINDOW = 10
CHUNK = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Words of a text with A-Z lower-cased; null and blank texts have none."""
    value = F.col(text).cast("string")
    ascii_only = F.octet_length(value) == F.char_length(value)  # then lower() changes A-Z only
    low = F.when(ascii_only, F.lower(value)).otherwise(F.translate(value, UPPER, LOWER))
    return F.filter(F.split(F.coalesce(low, F.lit("")), GAPS), lambda w: w != "")


def item_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """``items`` (ids as strings), ``n_ids`` and ``ws``, the words: a row for each distinct window."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), words(text).alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    cut = items.select("item", "ws", F.explode(starts).alias("at")).select("item", F.expr(f"slice(ws, at + 1, {window})").alias("ws"))
    return cut.groupBy("ws").agg(F.collect_set("item").alias("items"))


def _shingles(ws: str) -> Column:
    """Fingerprints of pairs of neighbouring words; a single word is a shingle of its own."""
    pairs = F.expr(f"transform(sequence(0, greatest(size({ws}) - 2, 0)), i -> xxhash64({ws}[i], get({ws}, i + 1)))")
    return pairs


def _tokens(texts: DataFrame, single: bool) -> DataFrame:
    """The columns of ``texts`` with ``at`` and ``shingle`` for each word; the last word's is that of a single word.

    Both generators stay in one code-generated stage with the join above, so that a text's
    words are not copied for each of its words.
    """
    pair = "xxhash64(word, get(ws, at + 1))"
    shingle = F.explode(F.expr(f"array({pair}, xxhash64(word))")) if single else F.expr(pair)  # windows of one word occur before other words too
    return texts.select("*", F.posexplode("ws").alias("at", "word")).select(*texts.columns, "at", shingle.alias("shingle"))


def _anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Each window with its rarest shingle and that shingle's place; ties by place."""
    parts = windows.select("ws", F.posexplode(_shingles("ws")).alias("shift", "shingle"))
    ranked = parts.join(counts, "shingle", "left").groupBy("ws").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shift", "shingle")).alias("a"))
    return windows.join(ranked, "ws").select("ws", "items", "a.shift", "a.shingle", "a.n").where("n > 0")


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc: str = "doc_id", text: str = "text", item: str = "item_id", chunk: int = CHUNK) -> DataFrame:
    """Occurrences: ``key`` (id and digest of the text), ``start`` (from 0), ``len`` and ``items`` (ids as strings)."""
    windows = checkpointed(item_windows(benchmark, window, item, text))
    total, single = windows.agg(F.count("*"), F.count_if(F.size("ws") == 1)).first()
    chunks = [windows] if total <= chunk else [windows.where(F.pmod(F.xxhash64("ws"), F.lit(-(-total // chunk))) == i) for i in range(-(-total // chunk))]
    texts = docs.select(row_key(doc, text).alias("key"), words(text).alias("ws"))
    counts = None
    for part in chunks:
        wanted = part.select(F.explode(_shingles("ws")).alias("shingle")).distinct()
        found = _tokens(docs.select(words(text).alias("ws")), single > 0).select("shingle").join(F.broadcast(wanted), "shingle")
        counts = found if counts is None else counts.unionByName(found)
    counts = counts.groupBy("shingle").agg((F.count("*") / 1).alias("n"))
    anchored = checkpointed(_anchored(windows, counts))
    hits = None
    for i in range(len(chunks)):
        part = anchored if len(chunks) == 1 else anchored.where(F.pmod(F.xxhash64("ws"), F.lit(len(chunks))) == i)
        places = _tokens(texts, single > 0).join(F.broadcast(part.select("shingle", "shift", F.col("ws").alias("need"), "items")), "shingle")
        fits = (F.col("at") >= F.col("shift")) & (F.col("at") - F.col("shift") + F.size("need") <= F.size("ws"))
        same = F.expr("slice(ws, at - shift + 1, size(need)) = need")
        found = places.where(fits & same).select("key", (F.col("at") - F.col("shift")).alias("start"), F.size("need").alias("len"), "items")
        hits = found if hits is None else hits.unionByName(found)
    return hits


def row_key(doc: str, text: str) -> Column:
    """Tells rows apart that share an id; rows alike in both have the same passages."""
    return F.struct(F.col(doc).alias("id"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("digest"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc: str = "doc_id", text: str = "text", item: str = "item_id", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with n_words, n_hit and n_items as long, ``items`` (sorted ids of items that occur) and ``contaminated``."""
    added = ("n_words", "n_hit", "n_items", "items", "contaminated")
    hits = find_hits(docs, benchmark, window, doc, text, item, chunk)
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    per_doc = hits.groupBy("key").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("__items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")),
        lambda a: a["n"],
    )
    per_doc = per_doc.select(F.col("key").alias("__key"), covered.cast("long").alias("__hit"), "__items")
    rows = docs.select(*[c for c in docs.columns if c not in added], F.size(words(text)).cast("long").alias("n_words"), row_key(doc, text).alias("__key"))
    joined = rows.join(per_doc, "__key", "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *[c for c in docs.columns if c not in added],
        "n_words",
        F.coalesce("__hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("__items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("__items", none).alias("items"),
        F.col("__hit").isNotNull().alias("contaminated"),
    )
