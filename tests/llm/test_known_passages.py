"""Suffix automata against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import known_passages

from .samples import documents, odd, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_places_are_the_first():
    rng = np.random.default_rng(1)
    for lane in (3, 512):
        known_passages.LANE, before = lane, known_passages.LANE
        for _ in range(40):
            reference = rng.integers(0, 4, 60).astype(np.uint64)
            starts = np.unique(rng.integers(0, 60, 4)) if rng.random() < 0.8 else np.array([0])
            starts[0] = 0
            text, width = rng.integers(0, 5, 80).astype(np.uint64), int(rng.integers(1, 6))
            bounds = np.array([0, 0, 31, 80])
            got = known_passages.Automaton(reference, starts).ends(text, bounds, width)
            edges = [*starts.tolist(), 60]
            first = {}
            for a, b in zip(edges, edges[1:]):
                for i in range(a, b - width + 1):
                    first.setdefault(tuple(reference[i : i + width]), i + width - 1)
            for a, b in zip(bounds, bounds[1:]):
                for i in range(a, b):
                    want = first.get(tuple(text[i - width + 1 : i + 1]), -1) if i - width + 1 >= a else -1
                    assert got[i] == want
        known_passages.LANE = before


@pytest.mark.parametrize("shard", [known_passages.SHARD_WORDS, 100])
def test_known_passages_go(spark, shard):
    rows = prose(5) + odd()
    reference = spark.createDataFrame([(rows[i][1],) for i in range(0, 30, 3)] + [(None,), ("",), (" ".join(f"w{i}" for i in range(100, 140)),)], "passage string")
    got = known_passages.drop_known(documents(spark, rows).withColumn("n_words", F.lit("clash")), reference, reference_text="passage", width=8, shard_words=shard).collect()
    known = set()
    for (text,) in reference.collect():
        w = WORD.findall(text or "")
        known |= {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    want = []
    for doc, text, *_ in rows:
        w, gone = WORD.findall(text or ""), set()
        for i in range(len(w) - 7):
            if tuple(w[i : i + 8]) in known:
                gone.update(range(i, i + 8))
        want.append((str(doc), len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.text) for r in got) == sorted(want)
    assert known_passages.drop_known(documents(spark, rows), reference.limit(0), reference_text="passage").where("n_removed > 0").count() == 0
    with pytest.raises(ValueError):
        known_passages.automata(reference, "passage", most_words=10)
