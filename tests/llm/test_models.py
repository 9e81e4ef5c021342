"""Trained operators: gradients, held-out accuracy, recall, and sums that must come out."""

import zlib
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm import ann, class_lm, language_id
from foliant.llm.frequency import most_frequent
from foliant.llm.language_id import Network

from .samples import documents, odd, prose

DATA = "/root/testdata/sf0.001"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    network = Network(["a", "b"], hidden=3)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    spans = rng.integers(0, 257, (6, 4)).astype(np.int16)
    grad = rng.normal(size=(6, 4, 3))
    for d in "fb":
        loss = lambda: float((network._run(spans, d, False)[0] * grad).sum())  # noqa: E731, B023
        _, kept = network._run(spans, d, True)
        got = network._back(spans, d, kept, grad)
        for name in (f"U{d}", f"W{d}", f"b{d}", "E"):
            w = network.weights[name]
            at = tuple(rng.integers(0, n) for n in w.shape) if name != "E" else (int(spans[0, 0]), 1)
            kept_value = w[at]
            w[at] = kept_value + 1e-3
            up = loss()
            w[at] = kept_value - 1e-3
            down = loss()
            w[at] = kept_value
            assert got[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-3)


def test_language_of_texts_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language_id.train(docs.where(~language_id.held_out()), per_lang=200)
    found = language_id.predict(docs.select("doc_id", "text", F.col("lang").alias("truth")).where(language_id.held_out()), network)
    right, n, low, high = found.agg(F.count_if(F.expr("truth = lang_pred")), F.count("*"), F.min("score"), F.max("score")).first()
    assert right / n > 0.95 and 0 <= low and high <= 1


def test_pooled_scores_are_those_of_single_steps(spark):
    rows = prose(2, 60) + odd()[:6] + [(7001, "ab é " * 70, "aa", None, 350)]
    network = language_id.train(documents(spark, rows), per_lang=20, steps=30)
    w, h = {k: v.astype(float) for k, v in network.weights.items()}, network.hidden
    squash = lambda x: 1 / (1 + np.exp(-x))

    def states(span, d):
        state, found = np.zeros(h), []
        for byte in span if d == "f" else span[::-1]:
            x, u = w["E"][byte] @ w[f"W{d}"] + w[f"b{d}"], state @ w[f"U{d}"]
            reset, update = squash(x[:h] + u[:h]), squash(x[h : 2 * h] + u[h : 2 * h])
            state = update * state + (1 - update) * np.tanh(x[2 * h :] + reset * u[2 * h :])
            found.append(state)
        return found if d == "f" else found[::-1]

    def pooled(text):
        raw, total = text.encode(), np.zeros(len(network.languages))
        for at in range(0, len(raw), language_id.SPAN):
            span = raw[at : at + language_id.SPAN]
            for f, b in zip(states(span, "f"), states(span, "b")):
                z = np.concatenate([f, b]) @ w["V"] + w["c"]
                total += np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        return total / len(raw)

    found = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.predict(documents(spark, rows), network).collect()}
    for doc, text, *_ in rows:
        if any(map(str.isalpha, text or "")):
            p = pooled(text)
            name, score = found[doc, text]
            assert score == pytest.approx(p.max(), abs=1e-4) and p[network.languages.index(name)] == pytest.approx(p.max(), abs=1e-4)
        else:
            assert found[doc, text] == ("und", 0)


def test_languages_of_odd_rows(spark):
    rows = odd() + [(1, "12 34 !?", "aa", None, 8)] + prose(2, 40)
    docs = documents(spark, rows).withColumn("score", F.lit("clash")).withColumn("span", F.lit("clash"))
    network = language_id.train(docs, per_lang=20, steps=5)
    found = language_id.predict(docs, network)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "span", "lang_pred", "score"]
    for r in found.collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert found.count() == len(rows)
    assert language_id.train(docs.where("false")) is None
    assert language_id.predict(docs.limit(0), network).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_whole_texts_are_read():
    network = Network(["a", "b"])
    head, tail = b"x" * 500, b"y" * 500
    p = network.predict(*language_id.utf8_buffer(pa.array([(head + tail).decode(), head.decode(), tail.decode(), ""])))
    assert not np.allclose(p[0], p[1]) and not np.allclose(p[0], p[2]) and p[3].sum() == 0 and np.allclose(p[:3].sum(1), 1)
    spans = np.frombuffer(head[: language_id.SPAN], np.uint8).astype(np.int16)[:, None]
    assert network.positions(spans).shape == (language_id.SPAN, 1, 2)


def test_class_model_scores(spark):
    rows = prose(8, 150) + odd()
    docs = documents(spark, rows).withColumn("rare", F.lit("clash"))
    for listed in (class_lm.LISTED, 40):  # with few listed words most counts come by the join
        model, counts = class_lm.train(docs.where(class_lm.training()), listed=listed)
        got = class_lm.score(docs, model, counts)
        seen, n = Counter(), 0
        tokens = lambda t: [*(t or "").encode().lower().split(), "end"]
        for doc, text, *_ in rows:
            if zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 != 2:
                seen.update(tokens(text))
                n += len(tokens(text))
        want = sorted((str(d), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, sum(log10((seen[w] + 1) / (n + len(seen) + 1)) for w in tokens(t))) for d, t, *_ in rows)
        found = got.collect()
        plain = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
        assert [p[:4] for p in plain] == [w[:4] for w in want] and np.allclose([p[4] for p in plain], [w[4] for w in want])
        assert all(r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in found)


@pytest.mark.parametrize("listed", [class_lm.LISTED, 40])
def test_class_scores_are_those_of_plain_counts(spark, listed):
    rows = prose(8, 80) + odd()
    docs = documents(spark, rows)
    model, counts = class_lm.train(docs.where(class_lm.training()), listed=listed)
    tokens = lambda t: (t or "").encode().lower().split()
    learnt = [tokens(t) for d, t, *_ in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    seen = Counter(w for t in learnt for w in t)
    unlisted, end = int(model.group[model.other]), int(model.group[model.end])
    group = lambda w: int(model.group[model.unit[model.index[w]]]) if w in model.index else unlisted
    assert len(model.index) == min(listed, sum(n > 1 for n in seen.values())) or listed == 40
    k, moves = len(model.transitions), Counter()
    for t in learnt:
        chain = [end, *map(group, t), end]
        moves.update(zip(chain, chain[1:]))
    rest = sum(n for w, n in seen.items() if w not in model.index)
    new = 1 + sum(n == 1 for n in seen.values()) / max(1, rest)
    cell = lambda a, b: moves[a, b] * (new if b == unlisted else 1)
    total = sum(cell(a, b) for a in range(k) for b in range(k))
    into = [sum(cell(a, b) for a in range(k)) for b in range(k)]
    out = [sum(cell(a, b) for b in range(k)) for a in range(k)]
    step = lambda a, b: (cell(a, b) + class_lm.PRIOR * (into[b] + 0.5) / (total + 0.5 * k)) / (out[a] + class_lm.PRIOR)
    mass = Counter()
    for w in model.index:
        mass[group(w)] += seen[w]
    n, v = sum(seen.values()) + len(learnt), len(seen) + 1
    kinds = sum(w not in model.index for w in seen)

    def emit(w):
        return seen[w] / mass[group(w)] if w in model.index else (seen[w] + 1) / (rest + kinds + 1)

    def plain(text):
        words, before, found = tokens(text), end, 0.0
        for w in words:
            found += log10(class_lm.MIX * step(before, group(w)) * emit(w) + (1 - class_lm.MIX) * (seen[w] + 1) / (n + v))
            before = group(w)
        return found + log10(class_lm.MIX * step(before, end) + (1 - class_lm.MIX) * (len(learnt) + 1) / (n + v))

    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in class_lm.score(docs, model, counts).collect())
    want = sorted((str(d), len(tokens(t)) + 1, plain(t)) for d, t, *_ in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])


@pytest.mark.parametrize("parts, full", [(class_lm.PARTS, class_lm.FULL), (2, class_lm.FULL), (2, 150)])
def test_neighbours_are_counted(spark, monkeypatch, parts, full):
    monkeypatch.setattr(class_lm, "PARTS", parts)
    monkeypatch.setattr(class_lm, "FULL", full)
    rng = np.random.default_rng(5)
    group = np.append(rng.integers(0, 4, 500), [4, 5])
    blobs = [np.append(rng.integers(0, 501, rng.integers(0, 90)), 501).astype(np.int32) for _ in range(40)]
    rows = [tuple(c[0].as_py() for c in batch.columns) for b in blobs for batch in class_lm.followers(iter([b]), 501)]
    pairs = spark.createDataFrame(rows, "before binary, unit binary, n binary").repartition(7)
    want = Counter()
    for blob in blobs:
        for a, b in zip([501, *blob.tolist()], blob.tolist()):
            want.update([(a, int(group[b])), (b, 6 + int(group[a]))] + [(a, 12)] * (a == b))
    unit, slot, n = class_lm.neighbours(pairs, group, 6)
    found = list(zip(unit.tolist(), slot.tolist()))
    assert dict(zip(found, n.tolist())) == want and found == sorted(found)


@pytest.mark.parametrize("held", [1, 7, 64, 1 << 21])
def test_pairs_are_counted_however_they_are_cut(monkeypatch, held):
    monkeypatch.setattr(class_lm, "HELD", held)
    rng = np.random.default_rng(7)
    chains = [np.append(rng.integers(0, 300, n), 300) for n in (0, 5, 90, 1, 40)] + [np.empty(0, np.int64)]
    want, found = Counter(), Counter()
    for chain in chains:
        want.update(zip([300, *chain.tolist()], chain.tolist()))
    for batch in class_lm.followers(iter(chains), 300):
        before, unit, n = (class_lm._values(c[0].as_py(), np.int64) for c in batch.columns)
        assert n.sum() <= held and len(set(zip(before.tolist(), unit.tolist()))) == len(n)
        for pair, times in zip(zip(before.tolist(), unit.tolist()), n.tolist()):
            found[pair] += times
    assert found == want


@pytest.mark.parametrize("kind", [np.int32, np.uint32, np.int64])
@pytest.mark.parametrize("values", [[], [0], [255, 0, 256], [1, 65_535, 65_536], [2**31 - 1, 3]])
def test_numbers_come_back_from_their_planes(kind, values):
    assert class_lm._values(class_lm._planes(np.array(values, np.int64)), kind).tolist() == values


@pytest.mark.parametrize("size", [0, 1, 40, 217, 600, 5000])
def test_most_frequent_values_fill_the_room(spark, size):
    rng = np.random.default_rng(3)
    counts = [(f"w{i}é".encode(), int(n)) for i, n in enumerate(np.minimum(rng.zipf(1.6, 1500), 10**12))]
    table = spark.createDataFrame(counts, "word binary, n long").repartition(5)
    hashed = {(r.word, r.n): r.h for r in table.select("word", "n", F.xxhash64("word").alias("h")).collect()}
    ranked = sorted((c for c in counts if c[1] >= 2), key=lambda c: (-c[1], hashed[bytes(c[0]), c[1]] % (1 << 64)))
    got = most_frequent(table, size, least=2)
    assert list(zip(got["word"].to_pylist(), got["n"].to_pylist())) == sorted(ranked[:size], key=lambda c: (-c[1], c[0]))
    assert most_frequent(table.limit(0), size).num_rows == 0


def test_words_move_to_the_best_class():
    rng = np.random.default_rng(0)
    classes, k = 5, 7
    p = 1 / np.arange(1, 61)
    chain = rng.choice(60, 3000, p=p / p.sum())
    start = np.append(rng.integers(0, classes, 60), [classes, classes + 1])

    def table(group):
        counts = np.zeros((k, k))
        np.add.at(counts, (group[chain[:-1]], group[chain[1:]]), 1)
        return counts

    for word in range(60):
        order = np.arange(62)
        order[0], order[word] = word, 0  # the word moves first
        group, one, two = start[order], order[chain[:-1]], order[chain[1:]]
        keys = np.concatenate([one * 15 + group[two], two * 15 + k + group[one], two[one == two] * 15 + 2 * k])
        keys, n = np.unique(keys, return_counts=True)
        moved, _ = class_lm.exchange_sweep(group, keys // 15, keys % 15, n, classes, batch=1)
        best = [class_lm.likelihood(table(np.where(np.arange(62) == word, c, start))) for c in range(classes)]
        assert best[moved[0]] == pytest.approx(max(best))


def test_class_model_without_training_texts(spark):
    docs = documents(spark, odd())
    model, counts = class_lm.train(docs.where("false"))
    assert class_lm.score(docs, model, counts).count() == len(odd())
    model, counts = class_lm.train(docs)
    assert class_lm.score(docs.limit(0), model, counts).count() == 0


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 4, 60)
    step = rng.dirichlet(np.ones(4) * 0.2, 4)
    table = rng.poisson(2000 * step[truth][:, truth] / 60)
    group = class_lm.exchange_clusters(table.astype(float), 4)

    def likelihood(g):
        member = np.eye(4)[g]
        c = member.T @ table @ member
        x = lambda v: (v * np.log(np.maximum(v, 1e-300))).sum()
        return x(c) - x(c.sum(0)) - x(c.sum(1))

    assert likelihood(group) > likelihood(np.arange(60) % 4)
    assert likelihood(group) > 1.02 * likelihood(truth)  # both are negative


def test_rare_words_are_classed_by_context(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "CLUSTERED", 20)
    monkeypatch.setattr(class_lm, "CLASSES", 2)
    rng = np.random.default_rng(7)
    name = lambda kind: f"{kind}{rng.integers(10) if rng.random() < 0.7 else rng.integers(10, 60)}"
    rows = [(i, " ".join(name("ab"[j % 2]) for j in range(40)), "aa", "s", 1) for i in range(200)]
    model, _ = class_lm.train(documents(spark, rows))
    groups = {w: model.group[model.unit[i]] for w, i in model.index.items()}
    assert len(groups) > 100
    assert len({g for w, g in groups.items() if w.startswith(b"a")}) == 1 == len({g for w, g in groups.items() if w.startswith(b"b")})
    assert groups[b"a50"] != groups[b"b50"]


def test_probabilities_of_next_words_sum_to_one(spark):
    docs = documents(spark, prose(8, 60))
    model, counts = class_lm.train(docs, listed=50)
    group, total = model.group, np.zeros(len(model.transitions))
    share = np.bincount(group[model.unit], 10.0**model.emission, len(total))
    share[group[model.other]] = sum(r.n + 1 for r in counts.collect() if bytes(r.word) not in model.index) * 10.0**model.unlisted + 10.0**model.unlisted
    share[group[model.end]] = 1
    present = share > 0
    assert np.allclose(share[present], 1)
    assert np.allclose((10.0**model.transitions).sum(1), 1)


def brute(rows, nearest):
    usable = {}
    for i, v in rows:
        if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = np.array(v, float)
    out = []
    for q in sorted(usable):
        if q % 20 == 0:
            best = sorted((-float(usable[q] @ v), i) for i, v in usable.items() if i != q)[:nearest]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_search_of_few_rows_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 5), (102, [1.0, None, 0.0, 0.0, 0.0]), (103, [float("nan")] + [1.0] * 4), (120, [float("inf")] + [1.0] * 4), (104, rows[3][1]), (140, rows[3][1]), (140, rows[3][1]), (None, rows[3][1])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = ann.search(data, F.col("id") % 20 == 0, candidate_block=25, query_block=2)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())
    want = sorted(brute(rows, 20))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])
    assert ann.search(data.where("vec_id = 100"), F.col("id") % 20 == 0).count() == 0
    assert ann.search(data.where("vec_id = 20"), F.col("id") % 20 == 0).count() == 0


def test_recall(spark):
    data = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in data.collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, 20)}
    got = {(r.query_id, r.vec_id) for r in ann.search(data, F.col("id") % 20 == 0).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_recall_over_several_full_blocks(spark):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(4 * ann.CANDIDATE_BLOCK + 100, 32)).astype(np.float32)
    table = pa.table([pa.array(np.arange(len(data))), pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), 32).cast(pa.list_(pa.float32()))], ["vec_id", "embedding"])
    rows = spark.createDataFrame(table).repartition(8)
    got: dict[int, set] = {}
    for r in ann.search(rows, F.col("id") % 20 == 0, query_block=300).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    wide, right = data.astype(np.float64), 0
    for q in range(0, len(data), 20):
        exact = wide @ wide[q]
        exact[q] = -np.inf
        right += len(got[q] & set(np.argsort(-exact)[:20].tolist()))
        assert len(got[q]) == 20
    assert right >= 0.9 * 20 * len(got)


def test_codes_weigh_parallel_error():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain = ann.Quantizer(x, rounds=0)
    fitted = ann.Quantizer(x)

    def loss(q):
        codes = q._assign(q._cut(x), q._cut(x))
        near = np.stack([q.books[m][codes[:, m]] for m in range(q.spaces)], 1).reshape(len(x), -1)
        rest = x - near
        return ((rest**2).sum(1) + q.weight * ((rest * x).sum(1)) ** 2).mean()

    assert loss(fitted) < 0.9 * loss(plain)
    packed = fitted.encode(x[:50])
    assert packed.shape == (50, 4) and packed.dtype == np.uint8
