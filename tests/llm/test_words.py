from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import textkit as tk

SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words_of(texts, separators, low):
    buf, offsets = tk.arrays(pa.array([None if t is None else t.encode() for t in texts], pa.binary()))
    return tk.Words(buf, offsets, separators, low)


texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAzZ09 \t\n\x0b\x00.é日😀~`[{_"), max_size=40)), max_size=8)


@settings(deadline=None, max_examples=150)
@given(texts)
def test_words_are_those_of_the_pattern(texts):
    for separators, pattern, low in ((tk.SPACE, SPACE, False), (tk.SPACE, SPACE, True), (tk.NON_ALNUM, ALNUM, True)):
        w = words_of(texts, separators, low)
        got = [[w.text(i, i + 1).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
        assert got == [re.findall(pattern, lower(t or "") if low else t or "") for t in texts]


@settings(deadline=None, max_examples=100)
@given(texts, st.integers(1, 4))
def test_run_hashes_tell_runs_apart(texts, k):
    w = words_of(texts, tk.SPACE, True)
    at, h = w.runs(k)
    runs = [w.text(i, i + k) for i in at]
    assert len(runs) == sum(max(0, n - k + 1) for n in w.counts)
    assert len(set(zip(runs, h.tolist()))) == len(set(runs)) == len(set(h.tolist()))


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.lists(st.integers(0, 255), max_size=5))
def test_blobs_come_back(a, b):
    x, y = np.sort(np.array(a, np.uint64)), np.array(b, np.uint8)
    got = tk.unpack(tk.pack(tk.gaps(x), y))
    assert np.array_equal(tk.ungaps(got[0]), x) and np.array_equal(got[1], y)


def test_pieces_keep_every_row():
    rows = [b"x" * n for n in (0, 5, 50, 0, 3, 200, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(rows, pa.binary())], names=["i", "text"])
    cut = list(tk.pieces(iter([batch.slice(0, 3), batch.slice(3)]), "text", 40))
    assert [i for b, _, _ in cut for i in b.column("i").to_pylist()] == list(range(8))
    assert b"".join(buf.tobytes() for _, buf, _ in cut) == b"".join(x or b"" for x in rows)


def test_unmix_undoes_mix():
    x = np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (tk.unmix(tk.mix(x)) == x).all()
