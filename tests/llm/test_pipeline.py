from __future__ import annotations

import zlib

import sentencepiece

import corpus_pipeline as p
from factloom.llm import line_quality, sentencepiece_lattice
from tests.llm import test_ngram_join, test_pii
from tests.llm.test_decontamination import words

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Every stage on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminated", "without_pii", "tokens"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    good = p.quality(spark, docs, SF)
    assert good.columns == list(p.COLUMNS)
    kept = {r.doc_id: r for r in good.collect()}
    assert all(tuple(kept[i]) == tuple(rows[i]) for i in kept)
    wrong = {i for i, q in labels.items() if (i in kept) != (q == 1)}
    learned = {i for i in labels if zlib.crc32(str(i).encode()) % 5}
    assert len(wrong & learned) <= 0.01 * len(learned)  # what the model has seen
    assert len(wrong - learned) <= 0.2 * len(labels.keys() - learned)  # what it hasn't; larger tables reach 99 per cent
    model = line_quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(kept) == {r.doc_id for r in line_quality.quality(docs, model).where("score >= 0.3").collect()}

    one = p.near_duplicates(spark, good, SF)
    roots = test_ngram_join.brute([(i, r.text) for i, r in kept.items()])
    one_rows = {r.doc_id: r for r in one.collect()}
    assert set(one_rows) == {i for i, _, root in roots if i == root} and one.columns == list(p.COLUMNS)

    clean = p.decontaminated(spark, one, SF)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {tuple(w[i : i + 10]) for r in items for w in [words(r.text)] for i in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    hit = {i for i, r in one_rows.items() for w in [words(r.text)] for k in sizes for s in range(len(w) - k + 1) if tuple(w[s : s + k]) in windows}
    clean_rows = {r.doc_id: r for r in clean.collect()}
    assert hit and set(clean_rows) == set(one_rows) - hit and all(tuple(r) == tuple(one_rows[i]) for i, r in clean_rows.items())

    masked = p.without_pii(spark, clean, SF)
    masked_rows = {r.doc_id: r for r in masked.collect()}
    assert set(masked_rows) == set(clean_rows) and masked.columns == list(p.COLUMNS)
    for i, r in masked_rows.items():
        assert r.n_chars == len(r.text) and not test_pii.brute(r.text)
        if not test_pii.brute(clean_rows[i].text) and "token" not in clean_rows[i].text:
            assert r.text == clean_rows[i].text

    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_lattice.MODEL)
    assert {r.doc_id: r.ids for r in p.tokens(spark, masked, SF).collect()} == {i: library.encode(r.text) for i, r in masked_rows.items()}


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(str, p.run(spark, SF).collect())) == sorted(map(str, docs.collect()))


def test_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for _, stage in p.STAGES:
            rows = stage(spark, rows, SF)
        assert rows.count() <= 2
