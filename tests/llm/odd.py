"""Rows that every operator has to take: nulls, empty, long and repeated texts, ties, clashing columns."""

from __future__ import annotations

import random

#: Extra columns with names that operators use themselves.
SCHEMA = "doc_id long, text string, row string, key long, n long, block long, `to` long, bucket int, label int, size int, hits string, n_words string, spans string, shard string"
LONG = " ".join(f"w{i % 977} It's {i}." for i in range(9000))


def frame(spark, rows, parts=3):
    more = ("x", 1, 2, 3, 4, 5, 6, 7, "h", "w", "s", "t")
    return spark.createDataFrame([(i, t, *more) for i, t in rows], SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"{c}{i}" for i in range(30) for c in ("Ab", "ä", "x", "日本", "é", "Z")]
    passage = " ".join(rng.choice(vocabulary) for _ in range(24))
    texts = [None, "", " ", "\n\n", "word", "WORD", "Word word", "  ", "😀😀 😀", "\x00a\x01b", LONG, LONG]
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 50))]
        if rng.random() < 0.4:
            w[rng.randrange(len(w)) : 0] = passage.split(" ")
        texts.append(rng.choice([" ", "\n", "  ", "\t"]).join(w))
    texts += texts[12:18]
    return [(3 * i + 1, t) for i, t in enumerate(texts)] + [(1, None), (100, texts[33]), (None, "no id here"), (None, None)]


def plain(rows):
    return [(i, t) for i, t in rows if i is not None]
