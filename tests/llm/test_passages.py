from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import blobs, passages
from factloom.llm import textkit as tk
from tests.llm import odd
from tests.llm.test_words import SPACE


def brute(docs, window):
    seen, gone = {}, {}
    every = [(d, i, re.findall(SPACE, t or "")) for i, (d, t) in enumerate(docs)]
    for d, _, w in every:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            seen[key] = min(seen.get(key, (d, s)), (d, s))
    out = []
    for d, i, w in every:
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < (d, s):
                gone |= set(range(s, s + window))
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


@pytest.mark.parametrize("window,phrase,flush", [(6, 3, 1 << 21), (8, 8, 50), (20, 10, 1 << 21)])
def test_equals_brute_force(spark, monkeypatch, window, phrase, flush):
    monkeypatch.setattr(blobs, "FLUSH", flush)
    docs = odd.plain(odd.rows(4)) + [(800, "a b c " * 30), (801, "a b c " * 9)]
    found = passages.without_repeats(odd.frame(spark, docs), window, phrase)
    assert sorted(map(tuple, found.collect())) == brute(docs, window)


def test_empty_null_ids_and_carried_columns(spark):
    assert passages.without_repeats(odd.empty(spark)).count() == 0
    found = passages.without_repeats(odd.frame(spark, [(None, "a b c d e f"), (2, "z a b c d e f")]), 5, 3, carry=("key",)).collect()
    assert sorted((r.doc_id or 0, r.kept, r.row.key) for r in found) == [(0, "a b c d e f", 1), (2, "z", 1)]


@pytest.mark.parametrize("shard", [3, 10**6])
def test_occurrences_come_from_the_automata(spark, monkeypatch, shard):
    monkeypatch.setattr(passages, "SHARD", shard)
    docs = [(i, " ".join(f"w{(7 * i + k) % 90}" for k in range(40))) for i in range(40)] + [(50, " ".join(f"w{k}" for k in range(3, 60)))]
    got = sorted(map(tuple, passages.without_repeats(odd.frame(spark, docs), 12, 6).collect()))
    assert got == brute(docs, 12) and sum(r[2] for r in got) > 300


def test_nothing_is_found_without_automata():
    text = [("a b c d e f g h " * 3).encode()]
    w = tk.Words(*tk.arrays(pa.array(text, pa.binary())), tk.SPACE, lower=False)
    known = np.unique(passages._anchors(w, 6, 3)[1])
    assert len(passages._candidates(w, passages._automata(known, 3), 6, 3)) == 19
    assert not len(passages._candidates(w, passages._automata(known[:0], 3), 6, 3))


def test_a_text_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(tk, "CHUNK_BYTES", 500)
    monkeypatch.setattr(passages, "GROUP_BYTES", 300)
    docs = [(1, " ".join(f"w{k % 211}" for k in range(900))), (2, None), (3, " ".join(f"w{k}" for k in range(50)))]
    assert sorted(map(tuple, passages.without_repeats(odd.frame(spark, docs)).collect())) == brute(docs, 20)
