"""Tokens, packing, sharding, the queries' SQL and the pipeline."""

import gc
import hashlib
import json
import random
import re
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.llm import bpe, language_id, line_dedup, packing, queries, sharding
from foliant.llm.arrow_text import BATCH_BYTES, PIECE_BYTES

from .samples import documents, odd, prose

tokenizers = pytest.importorskip("tokenizers")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def codec():
    with open(queries.tokenizer_path(), "rb") as file:
        return bpe.Codec(file.read())


def strange(n, seed=3):
    rng = random.Random(seed)
    alphabet = [*"abst'  remdlvl\n\t 1290!?.,''\"", "é", "ß", "　", "̀", "中", "😀", "\xa0", "<|endoftext|>", "<|endoftext", "\x85", "\x1c", "٣", "'s", "'re", "'ll", " ", *(chr(i) for i in rng.sample(range(0x80, 0xD800), 300))]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 5000, " ", "\n", "  \n x", "ab" * 3000, "x　", "'s'", "it's'll"]


def test_ids_and_texts_equal_the_library(library, codec):
    texts = strange(5000)
    want = library.encode_batch(texts, add_special_tokens=False)
    ids, bounds = codec.encode(pa.array(texts))
    assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(bounds, bounds[1:], want))
    assert [t.decode() for t in codec.decode(ids, bounds)] == [library.decode(w.ids, skip_special_tokens=False) for w in want]
    assert bpe.decimal_lists(ids, bounds)[:50] == [",".join(map(str, w.ids)).encode() for w in want[:50]]


def test_classes_of_characters(library, codec):
    split = library.pre_tokenizer.pre_tokenize_str
    table = bpe.character_classes()
    for c in [*range(0x3000), *range(0x3000, 0x110000, 61)]:
        if not 0xD800 <= c < 0xE000:
            kind = next((k for lead, k in (("a", bpe.LETTER), ("1", bpe.NUMBER), ("!", bpe.OTHER)) if len(split(lead + chr(c))) == 1), bpe.SPACE)
            assert table[c] == kind, hex(c)


def test_broken_bytes_decode_to_replacements(codec, library):
    ids = np.array([codec.vocabulary.single[b] for b in b"a\xff\xc3b"], np.int32)
    assert codec.decode(ids, np.array([0, len(ids)]))[0].decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_transducer_is_minimal_and_exact(codec):
    words = [w.encode() for w in ("walk", "walks", "walked", "talk", "talks", "talked", "é", "a", "ab")]
    image = bpe.compile_lexicon({w: codec.vocabulary.merge(w) for w in words})
    lexicon = bpe.Lexicon.mapped(image)
    flat = b"".join([*words, b"wal", b"zz", b"abc"])
    lengths = np.array([*map(len, words), 3, 2, 3])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ranks = lexicon.ranks(np.frombuffer(flat, np.uint8), starts, lengths)
    assert sorted(ranks[:9].tolist()) == list(range(9)) and (ranks[9:] == -1).all()
    for w, r in zip(words, ranks[:9].tolist()):
        assert lexicon.ids[lexicon.offsets[r] : lexicon.offsets[r + 1]].tolist() == codec.vocabulary.merge(w)
    right = {w: frozenset(x[len(w) :] for x in words if x.startswith(w)) for x in words for w in (x[:i] for i in range(len(x) + 1))}
    assert len(lexicon.final) == len(set(right.values()))
    assert len(bpe.Lexicon.mapped(bpe.compile_lexicon({})).ranks(np.frombuffer(b"a", np.uint8), np.array([0]), np.array([1]))) == 1


@pytest.mark.parametrize("at_once", [1, 37, 1 << 17])
def test_pieces_are_merged_together(codec, monkeypatch, at_once):
    vocabulary, rng = codec.vocabulary, random.Random(11)
    monkeypatch.setattr(bpe.Vocabulary, "MERGED_BYTES", at_once)
    made = ["".join(rng.choice(["a", "an", "the", "in", " ", "é", "aa", "9", "ing"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(400)]
    found = [b"", b"a", b" ", b"aaaa", b"a" * 47, b"a" * 48, b"a" * 49, b"\xff\xfe\x00", bytes(range(256)), b"ab" * 300, *made, b"", b"z"]
    lengths = np.array([len(p) for p in found])
    ids, bounds = vocabulary.merge_all(np.frombuffer(b"".join(found), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [vocabulary.merge(p) for p in found]
    ids, bounds = vocabulary.merge_all(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))
    assert ids.tolist() == [] and bounds.tolist() == [0]


def test_distinct_pieces_are_not_merged_one_by_one(library, codec, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 14))) for _ in range(200)) for _ in range(50)]
    want = library.encode_batch(texts, add_special_tokens=False)
    monkeypatch.setattr(bpe.Vocabulary, "merge", lambda self, piece: pytest.fail(f"{piece} was merged by itself"))
    ids, bounds = codec.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [w.ids for w in want]


def test_encoding_of_tables(spark, library):
    rows = [(i, t, None, None, 0) for i, t in enumerate(strange(200))] + odd()
    docs = documents(spark, rows).withColumn("piece", F.lit("clash"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(d), len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))) for (d, *_), e in zip(rows, library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)))
    for size in (bpe.LEXICON_SIZE, 50):
        got = bpe.encode_and_decode(docs, queries.tokenizer_path(), lexicon_size=size).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode(bpe.encode(docs, queries.tokenizer_path()), queries.tokenizer_path())
    assert sorted(r.text for r in back.collect()) == sorted(r[1] or "" for r in rows)
    assert bpe.encode(documents(spark, []), queries.tokenizer_path()).count() == 0


def test_best_fit_is_the_best():
    rng = np.random.default_rng(1)
    for _ in range(150):
        row = int(rng.integers(1, 40))
        lengths = rng.integers(1, row + 1, int(rng.integers(0, 60)))
        packed = packing.best_fit_decreasing(lengths, row)
        free: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fitting = [f for f in free if f >= n]
            if fitting:
                free[free.index(min(fitting))] -= n
            else:
                free.append(row - n)
        assert sorted(row - sum(lengths[i] for i in r) for r in packed) == sorted(free)
        assert sorted(i for r in packed for i in r) == list(range(len(lengths)))


def test_packed_rows_hold_everything(spark, library):
    rows = [r for r in {r[0]: r for r in prose(6, 60) + odd()}.values()]
    packed = packing.pack(documents(spark, rows), queries.tokenizer_path(), row=64, group_tokens=500).cache()
    for r in packed.collect():
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[:-1] == r.resets and len(r.segments) == len(r.resets)
        assert (ids[r.cu_seqlens[-1] :] == 50256).all() and all(a < b for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))
    got = {r["doc"]: r["ids"] for r in packing.unpack(packed).collect()}
    want = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in rows}
    assert got == {k: v for k, v in want.items() if v}
    ended = packing.unpack(packing.pack(documents(spark, rows), queries.tokenizer_path(), row=64, end=50256))
    assert {r["doc"]: r["ids"] for r in ended.collect()} == {k: [*v, 50256] for k, v in want.items() if v}
    assert packing.pack(documents(spark, []), queries.tokenizer_path()).count() == 0


def test_packed_rows_are_written(spark, tmp_path):
    packed = packing.pack(documents(spark, prose(6, 40) + odd()).repartition(3), queries.tokenizer_path(), row=64, group_tokens=900).cache()
    for _ in range(2):  # a second run replaces the first
        packing.write_packed(packed, f"file://{tmp_path}/rows")
    want = sorted((r["ids"], r.cu_seqlens, r.resets, [s.doc for s in r.segments]) for r in packed.collect())
    got = []
    parts = json.loads((tmp_path / "rows" / "manifest.json").read_text())["parts"]
    for part, maps in zip(parts, packing.read_packed(f"{tmp_path}/rows"), strict=True):
        assert isinstance(maps["ids"], np.memmap) and maps["ids"].dtype == np.dtype("<u2") and maps["ids"].shape[1] == 64
        assert hashlib.sha256(maps["ids"].tobytes()).hexdigest() == part["sha256"] and len(maps["ids"]) == part["rows"]
        docs = pq.read_table(tmp_path / "rows" / f"{part['name']}.segments.parquet")["doc"].to_pylist()
        for i, (a, b) in enumerate(zip(maps["rows"], maps["rows"][1:])):
            got.append((maps["ids"][i].tobytes(), maps["cu_seqlens"][a + i : b + i + 1].tolist(), maps["resets"][a:b].tolist(), docs[a:b]))
    assert sorted(got, key=str) == sorted(want, key=str) and len(parts) == 3
    assert len(list((tmp_path / "rows").iterdir())) == 5 * len(parts) + 1
    table = packing.packed_table(spark, f"file://{tmp_path}/rows")
    assert table.dtypes == packed.dtypes and sorted(map(str, table.collect())) == sorted(map(str, packed.collect()))
    other = tmp_path / "rows" / "part-of-another-write.ids"
    other.write_bytes(b"running")
    packing.write_packed(packed.limit(3), f"{tmp_path}/rows")
    assert other.exists() and packing.packed_table(spark, f"{tmp_path}/rows").count() == 3 == sum(len(m["ids"]) for m in packing.read_packed(f"{tmp_path}/rows"))
    packing.write_packed(packed.limit(0), str(tmp_path / "none"))
    assert packing.packed_table(spark, str(tmp_path / "none")).count() == 0
    assert list(packing.read_packed(str(tmp_path / "none"))) == []
    with pytest.raises(ValueError):
        packing.write_packed(packed, "hdfs://host/rows")


def test_unpacking_gives_repeated_rows_back(spark, library):
    rows = [(1, "the same id and text", None, None, 0)] * 3 + [(1, "the same id", None, None, 0), (None, "no id", None, None, 0), (None, "none either", None, None, 0)]
    packed = packing.pack(documents(spark, rows), queries.tokenizer_path(), row=3)
    got = sorted(((r["doc"], r["ids"]) for r in packing.unpack(packed).collect()), key=str)
    assert got == sorted([(d, library.encode(t, add_special_tokens=False).ids) for d, t, *_ in rows], key=str)


def test_shards_take_turns():
    names = [f"s{i}" for i in range(7)]
    owner = sharding.fill_table(names, 1009)
    counts = np.bincount(owner, minlength=7)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 6)
    assert moved < 0.15 * 1009
    for bad in ((names, 1000), ([], 7), (["a", "a"], 7), (names, 5)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_shards_of_rows(spark, tmp_path):
    docs = documents(spark, prose(1, 50) + odd()).withColumn("slot", F.lit("clash")).withColumn("id", F.lit(1))
    names = ["a", "b", "c"]
    got = sharding.assign_shards(docs, ["doc_id"], names, 101).collect()
    owner = sharding.fill_table(names, 101)
    for r in got:
        text = "null" if r.doc_id is None else f"{len(str(r.doc_id))}:{r.doc_id}"
        assert r.slot == int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % 101 and r.shard == owner[r.slot]
    assert len(got) == docs.count() and sharding.assign_shards(docs.limit(0), ["doc_id", "text"], names, 101).count() == 0
    sharding.write_shards(docs.select("doc_id", "text"), ["doc_id"], names, str(tmp_path / "shards"), 101, 2)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def equals_sql(spark, name: str, data: str) -> list[dict]:
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = con.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    rows = got.select(columns).collect()
    assert sorted(str(tuple(r)) for r in rows) == want
    return [r.asDict() for r in rows]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_sql(spark, name):
    equals_sql(spark, name, DATA)


def test_boilerplate_sql_where_lines_go(spark):
    rows = equals_sql(spark, "op10_line_dedup", "/root/testdata/sf0.01")  # all its hosts have enough pages, those of DATA do not
    assert sum(r["n_dropped"] for r in rows) > 0


def test_tables_are_written_to_the_shared_folder(spark, tmp_path, monkeypatch):
    from foliant.llm import storage

    assert storage.shared_folder(spark).endswith(f"foliant-{spark.sparkContext.applicationId}")
    with monkeypatch.context() as patch:
        patch.setattr(storage, "shared_folder", lambda spark: f"file://{tmp_path}")
        found = storage.checkpointed(spark.range(5).withColumn("nothing", F.lit(None)))
    assert str(tmp_path) in found.inputFiles()[0] and found.where("nothing is null").count() == 5
    storage.release(found, spark.range(1))
    assert not list(tmp_path.rglob("*.parquet"))
    monkeypatch.setattr(type(spark.conf), "get", lambda self, name, default=None: default)
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    assert storage.shared_folder(spark).startswith("file:///")
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    with pytest.raises(ValueError):
        storage.shared_folder(spark)


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    docs = queries.table(spark, DATA, "documents").unionByName(documents(spark, odd()))
    stage = dict(pipeline.STAGES)
    first = stage["language_id"](spark, docs, DATA).cache()
    assert first.columns == docs.columns and first.where("text is null or doc_id in (5002, 5003)").count() == 0
    network = language_id.train(docs.where(~language_id.held_out()))
    given = docs.collect()
    p = network.predict(*language_id.utf8_buffer(pa.array([r.text for r in given])))
    sure = [r for r, row in zip(given, p) if any(map(str.isalpha, r.text or "")) and row.max() >= 0.5 + 1e-5]
    unsure = [r for r, row in zip(given, p) if any(map(str.isalpha, r.text or "")) and row.max() >= 0.5 - 1e-5]
    assert {(r.doc_id, r.text) for r in sure} <= {(r.doc_id, r.text) for r in first.collect()} <= {(r.doc_id, r.text) for r in unsure}
    assert len(sure) > 0.9 * len(given) - 3
    lines = stage["line_dedup"](spark, first, DATA).cache()
    want = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(first).collect()}
    assert lines.columns == docs.columns and all(r.text == want[r.doc_id] for r in lines.collect())

    shingles = lambda t: frozenset(zip(*[(w := t.encode().lower().split())[i:] for i in range(5)])) or frozenset([tuple(w)])
    kept = stage["near_duplicates"](spark, lines, DATA).cache()
    sets = {r.doc_id: shingles(r.text) for r in lines.collect()}
    label = {d: d for d in sets if d is not None}
    changed = True
    pairs = [(a, b) for a in label for b in label if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(d for d in label if label[d] == d)
    clean = stage["decontamination"](spark, kept, DATA).cache()
    pick = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pick.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + 10]) for r in queries.table(spark, DATA, "benchmark").collect() if (w := words(r.text)) for i in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))
    want = sorted(str(r.doc_id) for r in kept.collect() if not hit(words(r.text)))
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == want and 0 < len(want) < kept.count()
    tokens = stage["bpe"](spark, clean, DATA)
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {str(r.doc_id): library.encode(r.text, add_special_tokens=False).ids for r in clean.collect()}
    want = sorted((d, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for d, x in ids.items())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.collect()) == want


def test_pipeline_stages_on_empty_tables_and_clashing_columns(spark):
    import corpus_pipeline as pipeline

    clashing = ["lang_pred", "score", "n_lines", "n_dropped", "digest", "doc", "n_words", "items", "contaminated", "text2", "ids"]
    rows = [(i, f"some words of text number {i} and a few more of them {i * i} to tell texts apart", "aa" if i % 2 else "bb", "s", 1) for i in range(12)] + odd()
    docs = documents(spark, rows).withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in clashing})
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0
        after = stage(spark, docs, DATA)
        if name != "bpe":
            assert after.columns == docs.columns
            assert all(r[c] == f"{c} {r.doc_id}" for r in after.where("doc_id is not null").collect() for c in clashing)
            assert after.where("doc_id is null").count() == 1
    assert after.count() == len(rows)


def test_copies_are_not_boilerplate(spark):
    import corpus_pipeline as pipeline

    stage = dict(pipeline.STAGES)
    own = lambda name, n: "\n".join(" ".join(f"{name}{i}x{j}" for j in range(12)) for i in range(n))
    body, parts = own("copy", 3), own("near", 16).split("\n")
    texts = [f"menu of all\n{body}"] * 10 + [f"menu of all\n{own(f'page{i}y', 2)}" for i in range(20)]
    near = ["\n".join(parts[:i] + parts[i + 1 :]) for i in range(10)] + [own(f"other{i}y", 2) for i in range(20)]
    rows = [(i, t, "aa", "third", len(t)) for i, t in enumerate(texts)] + [(100 + i, t, "aa", "near", len(t)) for i, t in enumerate(near)]
    lines = stage["line_dedup"](spark, documents(spark, rows), DATA).cache()
    got = {r.doc_id: r.text for r in lines.collect()}
    assert got == {d: t.removeprefix("menu of all\n") for d, t, *_ in rows}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    kept = stage["near_duplicates"](spark, lines, DATA)
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(10, 30), 100, *range(110, 130)]


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_DIGESTS, 0])
def test_near_copies_with_a_line_of_their_own_are_not_boilerplate(spark, monkeypatch, broadcast):
    import corpus_pipeline as pipeline

    monkeypatch.setattr(line_dedup.drop_boilerplate, "__defaults__", tuple(broadcast if x == line_dedup.BROADCAST_DIGESTS else x for x in line_dedup.drop_boilerplate.__defaults__))
    stage = dict(pipeline.STAGES)
    own = lambda name, n, size=12: "\n".join(" ".join(f"{name}{i}x{j}" for j in range(size)) for i in range(n))
    body, long = own("body", 15), own("long", 12, 40).split("\n")
    texts = [f"menu of all\n{body}\nline of its own {i}" for i in range(10)]  # a third of the host
    changed = ["\n".join(" ".join(f"new{i}" if (j * 40 + k) % 97 == 7 * i % 97 else w for k, w in enumerate(line.split())) for j, line in enumerate(long)) for i in range(10)]  # a word in some of the lines
    rows = [(i, t, "aa", "third", len(t)) for i, t in enumerate(texts)] + [(10 + i, f"menu of all\n{own(f'page{i}y', 3)}", "aa", "third", 9) for i in range(20)]
    rows += [(100 + i, t, "aa", "near", len(t)) for i, t in enumerate(changed)] + [(110 + i, own(f"other{i}y", 2), "aa", "near", 9) for i in range(20)]
    lines = stage["line_dedup"](spark, documents(spark, rows), DATA).cache()
    assert {r.doc_id: r.text for r in lines.collect()} == {d: t.removeprefix("menu of all\n") for d, t, *_ in rows}
    kept = {r.doc_id: r.text for r in stage["near_duplicates"](spark, lines, DATA).collect()}
    assert sorted(kept) == [0, *range(10, 30), 100, *range(110, 130)] and kept[0] == f"{body}\nline of its own 0"


def test_pages_with_a_common_menu_are_not_copies(spark):
    rng = np.random.default_rng(4)
    menu = "\n".join(f"menu {i} of the site" for i in range(5))
    texts = [f"{menu}\n" + " ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(40)]
    texts += [t + " and few more words" for t in texts[:3]] + texts[:2]
    rows = spark.createDataFrame([("h", t) for t in texts], "host_key string, text string")
    pages, units = line_dedup._units(rows)
    assert pages.count() == 43 and sorted(r["count"] for r in units.groupBy("unit").count().collect()) == [2, 2, 2]
    again = line_dedup._units(rows.repartition(5))[1]
    assert sorted(map(tuple, units.collect())) == sorted(map(tuple, again.collect()))


def test_a_codec_goes_with_its_broadcast(spark):
    with open(queries.tokenizer_path(), "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    codec = weakref.ref(bpe.worker_codec(shared, shared.value))
    gc.collect()
    assert codec() is not None and bpe.worker_codec(shared, shared.value) is codec()
    del shared  # as Spark does in a worker whose next task has no use for it
    gc.collect()
    assert codec() is None


def test_pipeline_bounds_batches(spark):
    import corpus_pipeline as pipeline

    def sizes(batches):
        yield from (pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"]) for b in batches)

    texts = spark.range(0, 400, 1, 1).select(F.when(F.col("id") == 7, F.repeat(F.lit("long "), 2 << 20)).otherwise(F.repeat(F.lit("word "), 16_000)).alias("text"))
    docs = documents(spark, odd())
    try:
        for name in ("language_id", "near_duplicates", "bpe"):
            spark.conf.unset(BATCH_BYTES)
            dict(pipeline.STAGES)[name](spark, docs, DATA)
            found = texts.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in found) == 400
            assert max(r.bytes for r in found if r.bytes < 10 << 20) < PIECE_BYTES + 200_000 and sum(r.bytes >= 10 << 20 for r in found) == 1
        spark.conf.set(BATCH_BYTES, "1m")
        pipeline.token_stage(spark, docs, DATA)
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.unset(BATCH_BYTES)
