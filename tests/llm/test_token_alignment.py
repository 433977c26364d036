"""Two tokenizers' tokens, groups and links against the libraries' ids and sets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factloom.llm import queries
from factloom.llm import token_alignment as ta
from tests.llm import odd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(ta.BYTE_MODEL)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ta.PIECE_MODEL)


def groups_of(text, libraries):
    """[(A ids, B ids)] by walking both sides, or None."""
    a, b = libraries
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    table = {c: i for i, c in enumerate([*range(33, 127), *range(161, 173), *range(174, 256)])}
    back = {chr(c): c for c in table} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in table)}
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (bytes_a, bytes_b)]
    out, at, start, overlaps = [], [0, 0], 0, len(ends[0] | ends[1])
    for end in sorted(ends[0] & ends[1]):
        group = []
        for side, (ids, data) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
            mine, size = [], 0
            while start + size < end:
                size += len(data[at[side]])
                mine.append(ids[at[side]])
                at[side] += 1
            group.append(mine)
        start = end
        out.append(tuple(group))
    return out, overlaps


def brute(rows, libraries):
    found = [(i, groups_of(t, libraries)) for i, t in rows]
    held = Counter(p for _, f in found if f for p in {(x, y) for a, b in f[0] for x in a for y in b})
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for i, f in found:
        if not f:
            out.append((i, 0, 0, 0, 0, 0, "", 0, 0))
            continue
        links = [(x, y) for a, b in f[0] for x in a for y in b]
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in f[0])
        out.append((i, sum(len(a) for a, _ in f[0]), sum(len(b) for _, b in f[0]), len(f[0]), len(links), f[1], hashlib.sha256(told.encode()).hexdigest(), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links)))
    return sorted(out, key=str)


def short(rows):
    return [(i, t if t is None or len(t) < 3000 else t[:3000]) for i, t in rows]


TEXTS = [
    "a▁b", "a b ▁", "x   y", "   lead", "trail   ", "\n\n a\n b", "a  b 　c  d", "<|endoftext|> <s></s><unk> <0x41>", "tab\tand\x0bmore \x85 x", "ab" * 400, "é" * 301, "日本語の文 です", "Привет мир it's don't 12 345", "😀😀 👩‍👩‍👧 é", "\x00 \x01\x7f", " ", "  ", "\n", "it's  I'll  we've", "a​b ﻿c",
]


def test_against_the_libraries(spark, libraries):
    rows = short(odd.rows()) + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    got = sorted((tuple(r) for r in ta.token_links(odd.frame(spark, rows)).collect()), key=str)
    assert got == brute(rows, libraries)
    assert sum(r[1] == 0 for r in got) >= 5


def test_small_blocks_and_slices(spark, libraries, monkeypatch):
    """Documents of many blocks count together; slices change nothing."""
    rows = short(odd.rows(seed=5))
    want = brute(rows, libraries)
    assert sorted((tuple(r) for r in ta.token_links(odd.frame(spark, rows, 7), block_bytes=300).collect()), key=str) == want


def test_large_groups_are_made_distinct(monkeypatch):
    rng = np.random.default_rng(3)
    na, nb = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    a, b = rng.integers(0, 9, na.sum()), rng.integers(0, 9, nb.sum())
    zero = np.zeros(1, int)
    found = ta.Aligned(zero, np.concatenate((zero, np.cumsum(na))), np.concatenate((zero, np.cumsum(nb))), zero, zero, zero)
    want = Counter((g, int(x), int(y)) for g in range(60) for x in a[found.a_cut[g] : found.a_cut[g + 1]] for y in b[found.b_cut[g] : found.b_cut[g + 1]])
    for size in (50, 1 << 20):
        monkeypatch.setattr(ta, "SLICE", size)
        got, last = Counter(), -1
        for group, pair, times in ta._links(found, a, b):
            assert group[0] >= last and (np.diff(group) >= 0).all()
            last = group[-1]
            for g, p, t in zip(group.tolist(), pair.tolist(), times.tolist(), strict=True):
                got[g, p >> 32, p & 0xFFFFFFFF] += t
        assert got == want


def test_intervals_have_one_owner_each():
    found = ta.align(np.array([2, 3, 1, 4]), np.array([1, 4, 5]))
    assert found.overlap_ends.tolist() == [1, 2, 5, 6, 10] and found.a_owner.tolist() == [0, 0, 1, 2, 3] and found.b_owner.tolist() == [0, 1, 1, 2, 2]
    assert found.ends.tolist() == [5, 10] and found.a_cut.tolist() == [0, 2, 4] and found.b_cut.tolist() == [0, 2, 3]


def test_words_encode_as_in_the_whole_text(libraries):
    """Every kind of character beside a cut, by both libraries (a text with U+2581 has no tokens at all)."""
    rng = random.Random(8)
    kinds = ["a", "Z", "1", "é", "я", "語", "😀", "\n", "\t", " ", "　", " ", "\x85", ".", "'", "'s", "\x00", "́", " ", "  ", "   "]
    sides = ta._tokenizers(ta.BYTE_MODEL, ta.PIECE_MODEL)
    for _ in range(400):
        text = "".join(rng.choice(kinds) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 30)))
        raw = np.frombuffer(text.encode(), np.uint8)
        buf, edges, first = ta._words(raw, np.array([0, len(raw)]))
        words = [buf[i:j].tobytes().decode() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        assert "".join(words) == " " + text and first.tolist() == [0, len(words)]
        for side, want in zip(sides, (libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)), strict=True):
            assert [i for ids in side.encode(words) for i in ids] == want


def test_long_and_equal_texts(spark):
    """A text of more than a block and an unbroken one; a third of all rows are one text."""
    long = " ".join(f"word{i % 3001}" for i in range(60_000))
    rows = [(1, long), (2, "x" * 100_000), *((i, "the same text") for i in range(3, 30))]
    got = {r.doc_id: r for r in ta.token_links(odd.frame(spark, rows), block_bytes=1 << 16).collect()}
    assert len(got) == 29 and got[1].n_b >= got[1].n_groups > 60_000 and got[2].n_a > 1000
    assert len({tuple(got[i])[1:] for i in range(3, 30)}) == 1 and got[3].n_links == 3 and got[3].count_sum == 81 and got[3].n_best == 3


def test_empty_table(spark):
    assert ta.token_links(odd.empty(spark)).collect() == []


def test_query(spark, libraries):
    """The whole table, held against the libraries on whole texts."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {r[0]: r for r in brute(rows, libraries)}
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, SF).collect()}
    assert set(got) == set(want)
    for i, r in want.items():
        assert tuple(got[i]) == (i, r[1], r[2], r[3], r[4], r[7], r[8], r[6], r[5])
