from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.llm import sentencepiece_lattice as sp
from tests.llm import odd

sentencepiece = pytest.importorskip("sentencepiece")


def odd_texts():
    rng = random.Random(4)
    letters = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "日本語", "😀", "_", "**", "=====", "représentation", "\r\n", ".", "\x00", "Zz", "ق", " the", "    "]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["x" * 700, " " * 100, "日本" * 300, "includegraphics" * 20]


def test_pieces_are_those_of_the_library_and_texts_come_back(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    docs = odd.rows(3) + [(5000 + i, t) for i, t in enumerate(odd_texts())]
    vocab = sp.vocabulary()
    found = sp.encode(odd.frame(spark, docs), block_bytes=3000).withColumn("text", sp.decode(F.col("ids"), vocab)).collect()
    got = sorted(((r.doc_id, r.ids, r.text) for r in found), key=str)
    assert got == sorted(((i, library.encode(t or ""), t or "") for i, t in docs), key=str)


def test_empty(spark):
    assert sp.encode(odd.empty(spark)).count() == 0
    assert [tuple(r) for r in sp.encode(odd.frame(spark, [(1, None), (1, "")])).collect()] == [(1, []), (1, [])]


def test_a_megabyte_without_a_blank(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    rng = random.Random(9)
    docs = [(1, "a" * (1 << 20)), (2, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(1 << 20))), (3, "function(){return;}" * 20000)]
    began = time.perf_counter()
    got = {r.doc_id: r.ids for r in sp.encode(odd.frame(spark, docs)).collect()}
    assert time.perf_counter() - began < 100
    assert all(got[i] == library.encode(t) for i, t in docs)


@pytest.mark.parametrize("longest", [0, 3, 10**6])
def test_both_folds_agree(spark, monkeypatch, longest):
    monkeypatch.setattr(sp, "LONGEST", longest)
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    docs = [(i, t[:60]) for i, t in enumerate(odd_texts())]
    assert {r.doc_id: r.ids for r in sp.encode(odd.frame(spark, docs)).collect()} == {i: library.encode(t) for i, t in docs}
