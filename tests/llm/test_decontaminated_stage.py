"""The pipeline's stage keeps exactly the documents without a window of any item."""

from __future__ import annotations

import corpus_pipeline as p
from tests.llm.test_decontamination import words

SF = "/root/testdata/sf0.001"


def test_stage_keeps_exactly_the_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    windows: dict[int, set[tuple[str, ...]]] = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        k = min(10, len(w))
        windows.setdefault(k, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1 if w else 0))
    clean = set()
    for r in docs.collect():
        w = words(r.text)
        if not any(tuple(w[i : i + k]) in some for k, some in windows.items() for i in range(len(w) - k + 1)):
            clean.add(r.doc_id)
    assert 0 < len(clean) < docs.count()
    assert {r.doc_id for r in p.decontaminated(spark, docs, SF).collect()} == clean
