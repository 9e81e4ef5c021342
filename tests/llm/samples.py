"""Rows with every defined case, and seeded prose with copies and shared passages."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def prose(seed: int = 1, n: int = 120) -> list[tuple]:
    """Documents with exact and near copies, a passage that many share, and a few of odd length."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6)))
    vocabulary = [word() for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            text = rng.choice(texts)
        elif texts and kind < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(max(1, len(words) // rng.choice([10, 40, 90]))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150)))
            if kind > 0.8:
                text = f"{text}\n{passage} {word()}"
        texts.append(text)
        rows.append((9000 - 7 * i if i % 3 else i, text, rng.choice(["aa", "bb"]), rng.choice(["s0", "s0", "s1", None]), len(text)))
    return rows


def odd() -> list[tuple]:
    """Null, empty and blank texts, a null id, repeated rows, one word, and a very long text."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    return [
        (5001, None, "aa", "s0", None),
        (5002, "", None, None, 0),
        (5003, " \n\t ", "bb", "s1", 4),
        (None, "word of a text without an id and more of it", None, "s1", 20),
        (5004, "one", "aa", None, 3),
        (5005, "Same Row twice, the SAME row", "aa", "s0", 28),
        (5005, "Same Row twice, the SAME row", "aa", "s0", 28),
        (5006, long, "aa", "s0", len(long)),
        (5007, "x" * 40_000, "aa", "s0", 40_000),
        (5008, "two words", "bb", "s0", 9),
        ((1 << 62) + 1, "an id that no double holds and words that come again " * 3, "aa", "s1", 159),
    ]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
