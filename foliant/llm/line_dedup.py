"""Site-relative line frequency: lines that too many pages of one host repeat are dropped.

Only DataFrame functions run. Each page counts once for each distinct line, whose key
is the line without blanks at either end; keys travel as MD5 digests. Pages of a host
that has many of all rows spread over the tasks: the counts are added up before the
shuffle, and texts are joined to a list for each host, which is short by its nature: a
host whose pages have m lines on average has at most m / ratio lines above the ratio.

Defined cases: null text stays null with no lines; blank lines always stay; a null host
is a host of its own; an empty text has one blank line; ties at exactly the ratio stay;
repeated rows are pages of their own; a very long text is one page, and its lines are taken
one by one; an empty table gives no rows. Columns named like the added ones are replaced,
other extra ones stay.

With ``copies_once`` a host's identical texts, and its pages that are near copies of each other, are one page
on both sides of the ratio, so that a text is not taken for boilerplate because it is copied;
``min_pages`` always counts every row. Near copies are told by the ``SKETCH`` least of the hashes of their
shingles of ``SHINGLE`` words (all, if there are no more): a page is compared with the least page that has one of its ``ANCHORS`` least
hashes, and with ``SAME`` of 100 of the least hashes of both in common the two are one page, as are those that
are tied to one another in this way. Pages without words are compared with none. Which pages are one does not
depend on how rows are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .components import connected_components
from .skew import attached
from .storage import checkpointed, release

#: A line is boilerplate if more than this share of its host's pages have it ...
MAX_RATIO = 0.1
#: ... and the host has at least so many pages.
MIN_PAGES = 20
#: Digests that may be broadcast (about 12 MB); beyond it texts are dealt out by host and salt.
BROADCAST_DIGESTS = 200_000
SALTS = 64
BLANKS = " \t\r"
#: Near copies that count as one page: words of a shingle, hashes that a sketch has and that are looked up, and how many of 100 are common.
SHINGLE, SKETCH, ANCHORS, SAME = 5, 32, 4, 60


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False, broadcast_digests: int = BROADCAST_DIGESTS) -> DataFrame:
    """``host_key`` and ``digests``, the array of MD5 digests of the host's boilerplate lines."""
    texts = docs.select(_host_key(host).alias("host_key"), F.col(text).cast("string").alias("text")).where("text is not null")
    keys = lambda rows: rows.select("*", F.array_distinct(F.transform(F.split("text", "\n"), _key)).alias("lines")).drop("text")
    hashed = lambda rows: rows.select("*", F.explode("lines").alias("line")).where("line <> ''").withColumn("digest", F.md5("line"))
    if not copies_once:
        totals = texts.groupBy("host_key").agg(F.count("*").alias("all"), F.count("*").alias("pages"))
        counts = hashed(keys(texts)).groupBy("host_key", "digest").agg(F.count("*").alias("n"))
    else:
        pages, units = _units(texts)
        totals = checkpointed(pages.join(units.drop("n"), "page", "left").groupBy("host_key").agg(F.sum("n").alias("all"), (F.count_if(F.col("unit").isNull()) + F.count_distinct("unit")).alias("pages")))
        lines = keys(texts.withColumn("page", _page()))
        if units.limit(broadcast_digests + 1).count() > broadcast_digests:
            found = attached(lines, units, ["page"])
        else:
            found = lines.join(F.broadcast(units.drop("n")), "page", "left")
        found = hashed(found.select("host_key", "unit", "lines"))
        alone = found.where("unit is null").groupBy("host_key", "digest").agg(F.count("*").alias("n"))
        shared = found.where("unit is not null").select("host_key", "unit", "digest").distinct().groupBy("host_key", "digest").agg(F.count("*").alias("n"))
        counts = alone.unionByName(shared).groupBy("host_key", "digest").agg(F.sum("n").alias("n"))
        release(pages)
    totals = totals.where(F.col("all") >= min_pages).drop("all")
    return counts.where("n > 1").join(totals, "host_key").where(F.col("n") > F.col("pages") * max_ratio).groupBy("host_key").agg(F.collect_list("digest").alias("digests"))


def _page() -> Column:
    """What names a text of a host."""
    return F.md5(F.concat_ws("\n", "host_key", "text"))


def _units(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different pages with their number of rows, and ``page``, ``unit`` and ``n`` of those that others are copies of, near ones included."""
    hashes = F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != ""), lambda word: F.xxhash64(word))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("hashes") - SHINGLE, F.lit(0))), lambda at: F.xxhash64(*[F.coalesce(F.get("hashes", at + i), F.lit(0)) for i in range(SHINGLE)]))
    rows = texts.select("host_key", _page().alias("page"), hashes.alias("hashes"))
    rows = rows.select("host_key", "page", F.slice(F.sort_array(F.array_distinct(F.when(F.size("hashes") > 0, runs).otherwise(F.array().cast("array<bigint>")))), 1, SKETCH).alias("sketch"))
    pages = checkpointed(rows.groupBy("host_key", "page").agg(F.first("sketch").alias("sketch"), F.count("*").alias("n")))
    keys = pages.select("host_key", "page", F.explode(F.slice("sketch", 1, ANCHORS)).alias("anchor"))
    least = checkpointed(keys.groupBy("host_key", "anchor").agg(F.min("page").alias("to"), F.count("*").alias("n")).where("n > 1"))
    pairs = checkpointed(attached(keys, least, ["host_key", "anchor"]).where("to < page").select("page", "to").distinct())
    sketches = pages.select("page", "sketch")
    known = checkpointed(pairs.groupBy("to").agg(F.count("*").alias("n")).join(sketches.toDF("to", "other"), "to"))
    both = attached(checkpointed(pairs.join(sketches, "page")), known, ["to"])
    both = both.withColumn("union", F.slice(F.sort_array(F.array_union("sketch", "other")), 1, SKETCH))
    common = F.size(F.array_intersect("union", F.array_intersect("sketch", "other")))
    links = checkpointed(both.where(common * 100 >= F.size("union") * SAME).select(F.col("page").alias("a"), F.col("to").alias("b")))
    copies = pages.where("n > 1").select("page", F.col("page").alias("unit"), "n")
    if links.limit(1).count():
        labels = checkpointed(connected_components(links)).withColumnRenamed("node", "page")
        named = pages.select("page", "n").join(labels, "page", "left").where("label is not null or n > 1")
        copies = named.select("page", F.coalesce("label", "page").alias("unit"), "n")
    found = checkpointed(copies)
    release(least, pairs, known, links)
    return pages, found


def _host_key(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit(""))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_digests: int = BROADCAST_DIGESTS, copies_once: bool = False) -> DataFrame:
    """``docs`` with ``text`` rid of boilerplate lines, and n_lines and n_dropped as long."""
    found = checkpointed(boilerplate(docs, host, text, max_ratio, min_pages, copies_once, broadcast_digests)).toDF("__host", "__digests")
    size = found.agg(F.sum(F.size("__digests"))).first()[0] or 0
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    pages = docs.withColumn("__host", _host_key(host))
    if size <= broadcast_digests:
        joined = pages.join(F.broadcast(found), "__host", "left")
    else:
        salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pages = pages.withColumn("__salt", F.pmod(F.xxhash64(F.col(text).cast("string")), F.lit(SALTS)).cast("int"))
        joined = pages.join(salted, ["__host", "__salt"], "left")
    lines = F.split(F.col(text).cast("string"), "\n")
    stays = lambda line: (_key(line) == "") | ~F.array_contains("__digests", F.md5(_key(line)))
    joined = joined.withColumn("__lines", lines).withColumn("__kept", F.when(F.col("__digests").isNull(), F.col("__lines")).otherwise(F.filter("__lines", stays)))
    clean = F.when(F.size("__kept") == F.size("__lines"), F.col(text).cast("string")).otherwise(F.array_join("__kept", "\n"))
    size_of = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return joined.select(
        *[clean.alias(c) if c == text else F.col(c) for c in names],
        size_of("__lines").alias("n_lines"),
        (size_of("__lines") - size_of("__kept")).alias("n_dropped"),
    )
