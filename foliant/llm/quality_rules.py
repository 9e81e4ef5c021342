"""Quality rules: few words, repeated windows, and outliers among robustly estimated statistics.

Only DataFrame functions run. Each text gives its words (``[^\\x20\\x09-\\x0D]+``), their code points,
symbols, repeated lines and words in repeated windows of five; too few words or too many repeated ones
fail the base rules. The others are judged by four transformed statistics, square roots
of word length and of symbols, repeated lines and repeated words for each word, each shrunk by
``PSEUDO`` words so that short texts are not outliers by chance.

For each language and source the regularised minimum covariance determinant (a ridge on
the scatter) gives a centre and a scatter of the bulk. Three starts that depend on no order of rows
(median and absolute deviation; moments of clipped values; plain moments) are concentrated:
distances from the estimate, moments of the nearest three quarters, ``STEPS`` times. The start with
the least determinant is reweighted once by the documents within the 0.975 quantile. A document is
rejected if its squared Mahalanobis distance exceeds the 0.99999 quantile of that of normal data.

Statistics are integers on a grid of 1/1024 and their moments exact sums, so estimates do not depend on
how rows are dealt out. A step reads some 60 bytes a document and adds moments up by group, start and bin of the
distance (4,096 bins at most) before the shuffle; the nearest three quarters are whole bins, ties in the
last one included. Groups with a large share of the rows are joined by broadcast. Texts are read once.
Windows are told apart by 64-bit hashes within one text.

Defined cases: null text has no words and fails; null language or source is a group of its own; a group with one
document left keeps it; repeated rows count each; a very long text is read whole, in the memory of
one row; an empty table gives no rows. A distance of exactly the limit is kept, as are exactly ``MIN_WORDS``
words and exactly ``MAX_REPEATED`` of 100 words repeated. Columns with the names of added ones are replaced,
other extra ones stay, except that names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .skew import attached
from .storage import checkpointed, release

MIN_WORDS, MAX_REPEATED, RUN = 10, 20, 5
#: Words of five letters, without symbols or repeats, that each text is taken to have besides its own.
PSEUDO, PSEUDO_LENGTH = 50, 5
GRID, LARGEST = 1024, 65_535
#: Spread that a statistic may always have, on the grid: one sixteenth.
RIDGE = 64
STEPS, BINS = 4, 4096
#: Quantiles 0.975 and 0.99999 of chi-squared with four degrees of freedom.
REWEIGHT, CUTOFF = 11.143, 28.474
#: What makes the scatter of the nearest 0.75 and 0.975 of normal data that of all: share over the cumulative distribution of chi-squared with six degrees at the share's quantile with four.
CONSISTENT, CONSISTENT_REWEIGHTED = 1.4865, 1.0645
#: The median absolute deviation of normal data is its standard deviation over this.
MAD = 1.4826
D = 4
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "distance", "kept")


def _repeated(positions: str) -> Column:
    """Words in the windows that begin at sorted positions."""
    p = F.col(positions)
    gaps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(RUN)))
    return F.when(F.size(p) > 0, RUN + F.aggregate(gaps, F.lit(0), lambda total, x: total + x)).otherwise(0)


def statistics(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    """The columns ``names`` of ``docs`` with the base statistics, all long, and base_failed."""
    blanks, body = " \t\n\x0b\f\r", F.coalesce(F.col(text).cast("string"), F.lit(""))
    trimmed = F.btrim("__body", F.lit(blanks))
    rows = docs.select(*names, body.alias("__body"))
    rows = rows.select("*", F.when(trimmed != "", F.split(trimmed, f"[{blanks}]+")).otherwise(F.array().cast("array<string>")).alias("__words"))
    lines = F.filter(F.split("__body", "\n"), lambda line: F.rlike(line, F.lit(f"[^{blanks}]")))
    rows = rows.select(
        *names,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__words", lambda word: F.xxhash64(word)).alias("__hashes"),
    )
    hashed = F.transform(F.sequence(F.lit(0), F.size("__hashes") - RUN), lambda at: F.xxhash64(*[F.get("__hashes", at + i) for i in range(RUN)]))
    rows = rows.select(*names, "n_words", "word_chars", "n_symbols", "__lines", F.when(F.size("__hashes") >= RUN, hashed).alias("__windows"))
    placed = F.sort_array(F.transform("__windows", lambda h, at: F.struct(h.alias("h"), at.alias("at"))))
    rows = rows.select(
        *names, "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), placed).alias("__placed"),
    )
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]
    beside = lambda at: F.get("__placed", at)["h"]
    again = F.filter(F.transform("__placed", lambda x, at: F.when((x.h == beside(at - 1)) | (x.h == beside(at + 1)), x.at)), lambda at: at.isNotNull())
    rows = rows.select(*names, *own, F.sort_array(again).alias("__again"))
    rows = rows.select(*names, *own, F.coalesce(_repeated("__again"), F.lit(0)).cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))


def transformed() -> list[Column]:
    """The four statistics on the grid."""
    words = F.col("n_words") + PSEUDO
    tops = [F.col("word_chars") + PSEUDO * PSEUDO_LENGTH, F.col("n_symbols"), F.col("n_dup_lines"), F.col("n_repeat_words")]
    return [F.least(F.floor(GRID * F.sqrt(top.cast("double") / words.cast("double")) + 0.5), F.lit(LARGEST)).cast("long").alias(f"__x{i}") for i, top in enumerate(tops)]


def _sums(values: list[str]) -> list[Column]:
    """How many rows, and exact sums of the values and of their products."""
    wide = lambda x, name: F.expr(f"sum(CAST({x} AS DECIMAL(20, 0))) AS {name}")
    return [F.count("*").alias("m"), *[wide(v, f"s{i}") for i, v in enumerate(values)], *[wide(f"({values[i]}) * ({values[j]})", f"q{i}{j}") for i, j in PAIRS]]


def _estimate(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and scatter from the sums of ``_sums``, in place of those."""
    names = [c for c in ("__group", "start", "n") if c in sums.columns]
    means = [f"CAST(s{i} AS DOUBLE) / CAST(m AS DOUBLE) AS mu{i}" for i in range(D)]
    rows = sums.selectExpr(*names, *means, *[f"CAST(q{i}{j} AS DOUBLE) / CAST(m AS DOUBLE) AS q{i}{j}" for i, j in PAIRS])
    ridge = lambda i, j: float(RIDGE**2 if i == j else 0)
    return _factored(rows.selectExpr(*names, *[f"mu{i}" for i in range(D)], *[f"(q{i}{j} - mu{i} * mu{j}) * {factor}D + {ridge(i, j)}D AS c{i}{j}" for i, j in PAIRS]))


def _factored(rows: DataFrame) -> DataFrame:
    """The lower triangular root l of the scatter c in its place, and its determinant; each term refers to those before it."""
    roots = []
    for i, j in sorted(PAIRS, key=lambda p: (p[1], p[0])):
        rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        roots.append(f"sqrt(greatest({rest}, 1D)) AS l{i}{i}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    names = [c for c in rows.columns if c not in {f"c{i}{j}" for i, j in PAIRS}]
    return rows.selectExpr(*names, *roots, "l00 * l11 * l22 * l33 AS det")


STATE = ["det", *[f"mu{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS]]


def _measured(rows: DataFrame) -> DataFrame:
    """The squared distance in place of the estimate's columns."""
    solved = []
    for i in range(D):
        rest = f"__x{i} - mu{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i))
        solved.append(f"({rest}) / l{i}{i} AS y{i}")
    names = [c for c in rows.columns if c not in STATE]
    return rows.selectExpr(*names, *solved, "y0 * y0 + y1 * y1 + y2 * y2 + y3 * y3 AS distance").drop(*[f"y{i}" for i in range(D)])


def estimates(rows: DataFrame) -> DataFrame:
    """``__group``, n and the reweighted estimate of each group of ``rows`` (``__group``, ``__x0`` to ``__x3``)."""
    x, each = [f"__x{i}" for i in range(D)], lambda text: [text.format(i=i) for i in range(D)]
    total = rows.count()
    of = lambda found: attached(rows, found, ["__group"], total=total)
    aggregated = lambda rows, columns: rows.groupBy("__group").agg(F.count("*").alias("n"), *[F.expr(c) for c in columns])
    centres = checkpointed(aggregated(rows, each("percentile(__x{i}, 0.5D) AS mu{i}")))
    gaps = aggregated(of(centres), each("first(mu{i}) AS mu{i}") + each("percentile(abs(__x{i} - mu{i}), 0.5D) AS mad{i}"))
    spread = lambda i, j: f"mad{i} * {MAD}D * (mad{i} * {MAD}D) + {float(RIDGE**2)}D" if i == j else "0D"
    plain = checkpointed(gaps.selectExpr("__group", "n", *each("mu{i}"), *[f"{spread(i, j)} AS c{i}{j}" for i, j in PAIRS]))
    bounds = plain.selectExpr("__group", "n", *each("floor(mu{i}) - floor(2 * sqrt(c{i}{i})) AS low{i}"), *each("floor(mu{i}) + floor(2 * sqrt(c{i}{i})) AS high{i}"))
    clipped = each("least(greatest(__x{i}, low{i}), high{i})")
    begun = [_factored(plain), *(_estimate(of(bounds).groupBy("__group").agg(F.count("*").alias("n"), *_sums(values)), 1.0) for values in (clipped, x))]
    begun = [rows.selectExpr("__group", "n", f"{start} AS start", *STATE) for start, rows in enumerate(begun)]
    state = checkpointed(begun[0].unionByName(begun[1]).unionByName(begun[2]))
    release(centres, plain)
    for _ in range(STEPS):
        binned = _measured(of(state)).withColumn("bin", F.expr(f"CAST(floor({BINS} * (sqrt(distance) / (sqrt(distance) + 4))) AS INT)"))
        nearest = checkpointed(_nearest(binned.groupBy("__group", "start", "bin").agg(*_sums(x))))
        before, state = state, checkpointed(_estimate(nearest, CONSISTENT))
        release(before, nearest)
    best = state.groupBy("__group").agg(F.first("n").alias("n"), F.min(F.struct("det", "start", *STATE[1:])).alias("best"))
    best = checkpointed(best.select("__group", "n", *[f"best.{c}" for c in STATE]))
    near = _measured(of(best)).where(F.col("distance") <= REWEIGHT).groupBy("__group").agg(*_sums(x))
    return checkpointed(_estimate(near.join(best.select("__group", "n"), "__group"), CONSISTENT_REWEIGHTED))


def _nearest(binned: DataFrame) -> DataFrame:
    """Sums of the lowest bins that together hold at least three quarters of the documents."""
    by = Window.partitionBy("__group", "start")
    before = F.coalesce(F.sum("m").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = binned.withColumn("n", F.sum("m").over(by)).withColumn("before", before).where(F.col("before") * 4 < F.col("n") * 3)
    total = [F.sum(c).cast("decimal(38,0)").alias(c) for c in ["m", *[f"s{i}" for i in range(D)], *[f"q{i}{j}" for i, j in PAIRS]]]
    return kept.groupBy("__group", "start").agg(F.first("n").alias("n"), *total)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carried: list[str] | None = None) -> DataFrame:
    """The ``carried`` columns of ``docs`` (all, if None) with the base statistics, base_failed, distance (null if base_failed) and kept.

    What is carried is written to the shared folder once.
    """
    part = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null"))
    names = [c for c in (docs.columns if carried is None else carried) if c not in ADDED]
    hidden = {f"__c{i}": c for i, c in enumerate(names)}
    slim = docs.select(F.col(text).alias("__text"), F.concat_ws("/", part(lang), part(source)).alias("__group"), *[F.col(c).alias(h) for h, c in hidden.items()])
    rows = checkpointed(statistics(slim, "__text", ["__group", *hidden]).select("*", *transformed()))
    passed = rows.where(~F.col("base_failed"))
    found = estimates(passed.select("__group", *[f"__x{i}" for i in range(D)]))
    near = _measured(attached(passed, found, ["__group"]))
    whole = near.unionByName(rows.where("base_failed").withColumn("distance", F.lit(None).cast("double")))
    return whole.select(*[F.col(h).alias(c) for h, c in hidden.items()], *BASE, "base_failed", "distance", F.coalesce(F.col("distance") <= CUTOFF, F.lit(False)).alias("kept"))
