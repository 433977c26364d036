"""Texts longer than what tasks handle at once, and a benchmark word that stands everywhere."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from factloom.llm import decontamination, language, licenses, ngram_join, passages, pii, sharding, winnowing
from factloom.llm import textkit as tk
from tests.llm import odd, test_ngram_join, test_passages

LONG = " ".join(f"word{i % 30011}x{i % 7} is" for i in range(90_000))
DOCS = [(1, LONG), (2, LONG + " and a tail of it"), (3, "is it a short text is it"), (4, LONG[: len(LONG) // 3]), (5, None)]


def test_the_text_is_longer_than_a_piece():
    assert len(LONG) > 1.2 * tk.CHUNK_BYTES


def test_repeated_passages(spark):
    assert sorted(map(tuple, passages.without_repeats(odd.frame(spark, DOCS)).collect())) == test_passages.brute(DOCS, 20)


def test_near_duplicates(spark):
    got = sorted(map(tuple, ngram_join.near_duplicates(odd.frame(spark, DOCS)).collect()))
    assert got == test_ngram_join.brute(DOCS) and len({r[2] for r in got}) == 4


def test_one_word_item_in_every_document(spark):
    items = spark.createDataFrame([(1, "is"), (2, "short text is it")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontamination.contamination(odd.frame(spark, DOCS), items).collect()}
    want = {i: sum(w == "is" for w in re.findall("[a-z0-9]+", (t or "").lower())) for i, t in DOCS}
    assert got == {1: (want[1], ["1"]), 2: (want[2], ["1"]), 3: (5, ["1", "2"]), 4: (want[4], ["1"]), 5: (0, [])}


def test_others_read_it_whole(spark):
    tail = " under the MIT license. Write to me@example.org"
    rows = odd.frame(spark, [(1, LONG + tail), (2, LONG)])
    scanned = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert scanned[1].n_words == scanned[2].n_words + 9 and scanned[1].first_word == scanned[2].n_words and scanned[2].n_base == 0
    spans = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in pii.find_pii(rows).collect()}
    assert spans == {1: [("email", len(LONG) + len(tail) - len("me@example.org"))], 2: []}
    assert {r.doc_id: r["size"] for r in sharding.shards(rows).collect()} == {1: len(LONG) + len(tail) + 8, 2: len(LONG) + 8}
    marks = {r.doc_id: r.n for r in winnowing.fingerprints(rows).select("doc_id", F.size("marks").alias("n")).collect()}
    assert marks[1] >= marks[2] > 50_000
    model = language.fit(spark.createDataFrame([(i, "word1 is it" if i % 2 else "der Hund", "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.languages(rows, model).collect()} == {"en"}
