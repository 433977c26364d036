from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import graphs, ngram_join

SCHEMA = "doc_id long, text string, set_key string, n long"


def shingles(rows):
    sets = []
    for _, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return sets


def brute(rows):
    sets = shingles(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(s), low[find(i)]) for i, ((doc_id, _), s) in enumerate(zip(rows, sets)))


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(60)]
    passage = " ".join(word() for _ in range(40))
    texts = [edited(rng, base, rng.randrange(0, 5)) for _ in range(150)]
    texts += [" ".join(word() for _ in range(rng.randrange(3, 60))) + " " + passage for _ in range(60)]
    texts += [edited(rng, passage.split(), rng.randrange(0, 3)) for _ in range(30)]
    for _ in range(30):
        family = [word() for _ in range(rng.randrange(5, 80))]
        texts += [edited(rng, family, rng.randrange(0, 3)) for _ in range(rng.randrange(2, 5))]
    texts += texts[:20] + ["", None, "  \n ", "one", "One", "one two", "a b c d e", "A b\tc d E", "x " * 400]
    return [(i * 7 % 1000 + i // 1000, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [2, 32])
def test_components_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "BLOCK_COLUMNS", 64)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == brute(rows)


def test_common_columns_are_consistent(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "COMMON", 3)
    rows = corpus(8)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA).repartition(2)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == brute(rows)


def test_link_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 16)
    monkeypatch.setattr(ngram_join, "STRIPE", 2)
    rows = corpus(5)
    sets = [set(x) for x in shingles(rows)]
    want = sorted((i, sum(bool(a) and j != k and 100 * len(a & b) >= 75 * len(a | b) for k, b in enumerate(sets))) for j, ((i, _), a) in enumerate(zip(rows, sets)))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, ngram_join.link_counts(docs).collect())) == want


def test_many_rows_of_one_boilerplate_compare_few_pairs(spark, monkeypatch):
    """4,000 rows that share four fifths of their shingles, and reach 75 % with nobody but their own near copies."""
    rng = random.Random(6)
    boilerplate = [f"b{i}" for i in range(84)]
    rows = [(i, " ".join([*boilerplate, *(f"u{i}x{k}" for k in range(20))])) for i in range(4000)]
    family = [f"f{i}" for i in range(90)]
    rows += [(5000 + i, edited(rng, family, 3)) for i in range(60)] + [(6000, rows[7][1] + " more")]
    seen = []
    product = ngram_join._links

    def watched(x, y, percent):
        seen.append(len(x) * len(y))
        return product(x, y, percent)

    monkeypatch.setattr(ngram_join, "_links", watched)
    real = ngram_join._blocks_linked

    def here(groups, percent, kept, counts=False):
        strong = groups.where(F.size("columns") * (100 + percent) >= F.col("n") * 2 * percent).count()
        seen.append(strong * groups.count())
        return real(groups, percent, kept, counts)

    monkeypatch.setattr(ngram_join, "_blocks_linked", here)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert sum(seen) < 4000 * 200
    assert got[6000] == 7 and all(got[i] == i for i in range(4000))
    assert len({got[5000 + i] for i in range(60)}) == len({c for i, _, c in brute(rows[4000:4060]) if i >= 5000})


def test_no_table_stays_but_the_result(spark):
    from urllib.parse import urlparse
    import pathlib

    folder = pathlib.Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path)
    before = set(folder.iterdir()) if folder.exists() else set()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in corpus(2)[:80]], SCHEMA)
    assert ngram_join.near_duplicates(docs).count() == 80
    assert len(set(folder.iterdir()) - before) == 1


def test_empty_and_repeated(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "", 0), (1, "a b c d e f", "", 0), (2, None, "", 0), (2, None, "", 0)], SCHEMA)
    assert sorted(map(tuple, ngram_join.near_duplicates(docs).collect())) == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 0, 2)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = graphs.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(map(tuple, found.collect())) == sorted((n, r) for n, r in root.items() if n in linked)
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
