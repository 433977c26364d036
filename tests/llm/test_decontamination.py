from __future__ import annotations

import re

import pytest

from factloom.llm import decontamination
from tests.llm import odd
from tests.llm.test_words import ALNUM, lower


def words(text):
    return re.findall(ALNUM, lower(text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            k = min(window, len(b))
            for i in range(len(b) - k + 1 if b else 0):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == b[i : i + k]:
                        hit |= set(range(s, s + k))
                        found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [5, 10**6])
def test_equals_brute_force(spark, block):
    docs = odd.rows(2) + [(900, "the the the the"), (901, "a b a b a b a b")]
    source = docs[20][1]
    items = [(1, source), (2, " ".join(words(source)[:3])), (3, None), (4, ""), (10, "Word"), (11, "the the"), (12, "a b a b"), (12, "x"), (2, docs[25][1])]
    found = decontamination.contamination(odd.frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window=4, block_windows=block)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "items").collect()), key=str) == brute(docs, items, 4)


def test_ranges_and_carried_columns(spark):
    found = decontamination.contamination(odd.frame(spark, [(5, "x a b y a b")]), spark.createDataFrame([(1, "A b")], "item_id long, text string"), carry=("doc_id", "text")).collect()
    assert found[0].hits == [1, 3, 4, 6] and found[0].row.text == "x a b y a b"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(odd.empty(spark), none).count() == 0
    assert decontamination.contamination(odd.frame(spark, [(1, "a b")]), none).collect()[0].n_words == 2
