"""Filter audit, vector codes and quality rules against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import filter_audit, quality_rules, vector_codes
from foliant.llm.skew import attached

from .samples import documents, odd, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("often", [3, 10_000])
def test_join_with_a_hot_key(spark, often):
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i % 20}", i) for i in range(200)] + [("alone", 999)], "k string, i long")
    found = rows.where("k <> 'alone'").groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    sums = {r.k: r.s for r in found.collect()}
    got = attached(rows, found, ["k"], often=often).collect()
    assert sorted((r.k, r.i, r.s or -1) for r in got) == sorted((r.k, r.i, sums.get(r.k, -1)) for r in rows.collect())


def failures(rows):
    firsts = {}
    for doc, text, *_ in rows:
        if doc is not None:
            firsts[text or ""] = min(doc, firsts.get(text or "", doc))
    for doc, text, lang, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), doc is not None and doc > firsts.get(text, doc)]
        yield doc, lang or "", {f for f, b in zip("ABCDE", bad) if b}


def test_filter_audit(spark):
    rng = random.Random(4)
    rows = prose(7) + odd() + [(7000 + i, " ".join(rng.choice(["Ab", "c#d", "e", "FG", "h|"]) + str(rng.randrange(9 + 90 * (i % 4))) for _ in range(150 + 60 * (i % 3))), rng.choice(["aa", "bb", "", None]), "s", 1) for i in range(40)]
    rows += [(8000 + i, "the same text of many rows " * 40, "aa", "s", 1) for i in range(60)]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1])) for r in rows if rng.random() < 0.6] + [(rows[0][0], 1, 1), (None, 1, 1), (-5, 1, 1)]
    marks = defaultdict(lambda: [False, False])
    for doc, good, toxic in labels:
        marks[doc] = [marks[doc][0] or good == 1, marks[doc][1] or toxic == 1]
    judged = [(part, bad, *(marks[doc] if doc is not None else (False, False))) for doc, part, bad in failures(rows)]
    want = []
    for part in {p for p, *_ in judged}:
        own = [j for j in judged if j[0] == part]
        shapley, report = Counter(), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                hit, before = [j for j in left if f in j[1]], len(left)
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(hit)
                report.append((order, step, f, before - len(hit), len(hit), sum(f in j[1] for j in own) - len(hit), sum(j[1] == {f} for j in own), sum(j[2] for j in hit), sum(j[3] for j in hit)))
        want += [(part, o, s, *counts, shapley[f]) for o, s, f, *counts in report]
    docs = documents(spark, rows).withColumn("n", F.lit("clash")).withColumn("mask", F.lit(3)).repartition(7)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = filter_audit.audit(docs, marked)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert filter_audit.audit(docs.limit(0), marked).count() == 0
    assert filter_audit.audit(docs, marked.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_parts_are_sent_on_in_time(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    docs = spark.createDataFrame([(i, f"text {i}", f"part{i % 11}") for i in range(50)], "doc_id long, text string, lang string")
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert got.count() == 11 * 600 and got.where("step = 5").agg(F.sum(F.col("kept") + F.col("removed"))).first()[0] == 24 * 50 + got.where("step = 5 AND substr(filter_order, 5, 1) <> 'A'").agg(F.sum("kept")).first()[0]


def plain_codes(rows, parts=8, entries=16, rounds=6):
    def fine(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    kept = [r for r in rows if fine(r[1])]
    sizes = Counter(len(r[1]) for r in kept)
    size = min(sizes, key=lambda s: (-sizes[s], s)) if sizes else 0
    dims = -(-size // parts) * parts
    most = math.isqrt((2**63 - 1) // (4 * max(1, dims)))
    kept = [(k, [max(-most, min(most, math.floor(4096 * float(x)))) for x in v] + [0] * (dims - size), label) for k, v, label in kept if len(v) == size]
    width = dims // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]

    def assign(v):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])) for p, x in enumerate(cut(v))]

    for _ in range(rounds):
        own = [assign(r[1]) for r in kept]
        for p in range(parts):
            for e in range(len(first)):
                mine = [cut(r[1])[p] for r, o in zip(kept, own) if o[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    own = [assign(r[1]) for r in kept]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    errors = Counter()
    for r, o in zip(kept, own):
        errors[r[2]] += sum(d for d, _ in o)
    return [(r[0], "".join(f"{e:02x}" for _, e in o), sum(d for d, _ in o), errors[r[2]], digest) for r, o in zip(kept, own)]


def as_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("size,n", [(16, 150), (12, 60), (8, 5)])
def test_vector_codes(spark, size, n):
    rng = random.Random(size)
    vector = lambda: [rng.choice([0.0, 0.25, rng.gauss(0, 1)]) for _ in range(size)]
    rows = [(rng.randrange(10**6), vector(), rng.choice([1, 2, None])) for _ in range(n)]
    rows += rows[:3] + [(None, vector(), 1), (7, None, 1), (8, vector()[:-1] + [None], 1), (9, vector()[:-1] + [float("nan")], 2), (10, vector()[:-1] + [float("-inf")], 2), (11, [0.0] * size, None), (12, [1.0], 1), (13, [], 1), (14, vector(), 3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("error", F.lit("clash")).withColumn("n", F.lit(5)).repartition(5)
    got = vector_codes.compress(frame)
    assert as_text((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == as_text(plain_codes(rows))
    assert got.select("n").distinct().count() == 1
    assert vector_codes.compress(frame.limit(0)).count() == 0
    assert vector_codes.compress(frame.where("embedding IS NULL")).count() == 0


def test_components_out_of_range_are_the_largest(spark):
    rows = [(1, [1e300] + [0.0] * 7, 1), (2, [-1e300] + [0.0] * 7, 1), (3, [1.0] * 8, 2)]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=1)
    assert as_text((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()) == as_text(
        (k, c, e, le if le < 2**63 else None, d) for k, c, e, le, d in plain_codes(rows, entries=1)
    )


def test_partial_distances_are_full_ones():
    rng = np.random.default_rng(2)
    vectors, book = rng.integers(-50, 50, (500, 6)), rng.integers(-50, 50, (16, 6))
    book[9] = book[3]
    full = ((vectors[:, None, :] - book[None]) ** 2).sum(2)
    found, best = vector_codes.nearest(vectors, book)
    assert (found == full.argmin(1)).all() and (best == full.min(1)).all() and 9 not in found


def plain_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    runs = defaultdict(list)
    for i in range(len(w) - 4):
        runs[tuple(w[i : i + 5])].append(i)
    covered = {i + j for at in runs.values() if len(at) > 1 for i in at for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_verdicts(groups):
    """Distances of points on the grid, by group, with exact sums."""
    q = quality_rules
    out = {}

    def estimate(points, factor):
        n = len(points)
        mean = [float(sum(p[i] for p in points)) / n for i in range(4)]
        cov = [[(float(sum(p[i] * p[j] for p in points)) / n - mean[i] * mean[j]) * factor + (q.RIDGE**2 if i == j else 0) for j in range(4)] for i in range(4)]
        return mean, cov

    def distances(points, state):
        z = np.array(points, float) - np.array(state[0])
        return (z @ np.linalg.inv(np.array(state[1])) * z).sum(1)

    for group, points in groups.items():
        median = [float(np.median([p[i] for p in points])) for i in range(4)]
        spread = [1.4826 * float(np.median([abs(p[i] - median[i]) for p in points])) for i in range(4)]
        begun = np.diag([s * s + q.RIDGE**2 for s in spread])
        reach = [math.floor(2 * math.sqrt(begun[i][i])) for i in range(4)]
        clipped = [[min(max(p[i], math.floor(median[i]) - reach[i]), math.floor(median[i]) + reach[i]) for i in range(4)] for p in points]
        states = [(median, begun), estimate(clipped, 1.0), estimate(points, 1.0)]
        for _ in range(q.STEPS):
            after = []
            for state in states:
                d = np.sqrt(distances(points, state))
                bins = np.floor(q.BINS * (d / (d + 4))).astype(int)
                limit = next(b for b in np.sort(bins) if (bins <= b).sum() * 4 >= 3 * len(points))
                after.append(estimate([p for p, b in zip(points, bins) if b <= limit], q.CONSISTENT))
            states = after
        best = min(states, key=lambda s: np.linalg.det(np.array(s[1])))
        near = [p for p, d in zip(points, distances(points, best)) if d <= q.REWEIGHT]
        out[group] = distances(points, estimate(near, q.CONSISTENT_REWEIGHTED))
    return out


def test_quality_rules(spark):
    rng = random.Random(5)
    rows = prose(11, 300) + odd()
    rows += [(9500 + i, " ".join("#" * rng.randrange(3) + "word" + str(rng.randrange(500)) for _ in range(60)), "aa", "s0", 1) for i in range(8)]
    rows += [(9600 + i, "\n".join(["a menu line", "another line"] * 4 + [" ".join(f"u{rng.randrange(900)}" for _ in range(80))]), "bb", "s0", 1) for i in range(4)]
    rows += [(9700, "lonely text of its own language and its own source with ten words or more", "zz", "zz", 1), (9701, "x\x0by\x0cz\r\n\n\t" * 9, "aa", "s1", 1)]
    docs = documents(spark, rows).withColumn("kept", F.lit("clash")).withColumn("mu0", F.lit("clash")).withColumn("n", F.lit(1)).repartition(6)
    got = quality_rules.judge(docs)
    assert set(docs.columns) <= set(got.columns)
    base = [plain_base(r[1]) for r in rows]
    failed = [b[0] < 10 or 100 * b[4] > 20 * b[0] for b in base]
    groups = defaultdict(list)
    on_grid = lambda b: [min(65_535, math.floor(1024 * math.sqrt(top / (b[0] + 50)) + 0.5)) for top in (b[1] + 250, *b[2:])]
    for row, b, bad in zip(rows, base, failed):
        if not bad:
            groups[row[2], row[3]].append(on_grid(b))
    d2 = {g: iter(d) for g, d in plain_verdicts(groups).items()}
    want = [(row[0], *b, bad, None if bad else float(next(d2[row[2], row[3]]))) for row, b, bad in zip(rows, base, failed)]
    order = lambda r: str(r[:7]) + f"{r[7] or 0:.3f}"
    want.sort(key=order)
    found = sorted(((r.doc_id, *(r[c] for c in quality_rules.BASE), r.base_failed, r.distance, r.kept) for r in got.collect()), key=order)
    assert [f[:7] for f in found] == [w[:7] for w in want]
    for f, w in zip(found, want):
        assert (f[7] is None) == (w[7] is None) and (f[7] is None or f[7] == pytest.approx(w[7], rel=1e-6, abs=1e-6))
        assert f[8] == (f[7] is not None and f[7] <= quality_rules.CUTOFF)
    assert any(not f[8] and not f[6] for f in found), "no outlier"
    kept = {f[0] for f in found if f[8]}
    assert 9700 in kept and not kept & {9500 + i for i in range(8)}
    assert quality_rules.judge(docs.limit(0)).count() == 0
    assert quality_rules.judge(docs.where("text IS NULL")).where("kept").count() == 0


def test_estimates_do_not_depend_on_partitions(spark):
    docs = documents(spark, prose(3, 150))
    a, b = (quality_rules.judge(docs.repartition(n), carried=["doc_id"]).select("doc_id", "distance").collect() for n in (1, 9))
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_no_python_in_the_plan(spark):
    plan = quality_rules.judge(documents(spark, prose(3, 20)), carried=["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
