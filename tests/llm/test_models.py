from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language, licenses, line_quality, samples
from tests.llm import odd

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language.languages(docs, language.fit(docs), carry=("lang",)).where(samples.held_out(F.col("doc_id")))
    right = found.agg(F.avg((F.col("row.lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.97


def test_language_of_odd_rows(spark):
    model = language.fit(spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(60)], "doc_id long, text string, lang string"))
    found = language.languages(odd.frame(spark, odd.rows(5) + [(7000, "die Katze und der Hund"), (7001, "12 34!"), (7002, "ß")]), model).collect()
    by = {r.doc_id: r for r in found}
    assert by[7000].lang_pred == "de" and by[7001].lang_pred == "und" and by[7002].lang_pred in ("de", "en")
    assert all(0 <= r.score <= 1 and r.lang_pred in ("de", "en", "und") for r in found) and len(found) == len(odd.rows(5)) + 3
    none = language.fit(odd.empty(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.languages(odd.frame(spark, odd.rows(5)), none).collect()} == {"und"}
    assert language.languages(odd.empty(spark), model).count() == 0


def test_quality_accuracy_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = line_quality.quality(docs, line_quality.fit(docs, labels)).join(labels, "doc_id").where(samples.held_out(F.col("doc_id")))
    assert scored.agg(F.avg(((F.col("score") >= 0.3).cast("int") == F.col("quality")).cast("double"))).first()[0] >= 0.95


def test_chain_equals_enumeration():
    rng = np.random.default_rng(2)
    first = np.array([0, 1, 5, 8])
    emission, moves = rng.normal(0, 2, 8), rng.normal(0, 1, (2, 2))
    marginals, pairs = line_quality._Chains(first).run(emission, moves)
    want, expected = np.zeros(8), np.zeros((2, 2))
    for i, j in zip(first[:-1], first[1:]):
        n, total, ones, joint = j - i, 0.0, np.zeros(j - i), np.zeros((2, 2))
        for bits in range(2**n):
            y = [bits >> k & 1 for k in range(n)]
            weight = np.exp(sum(emission[i + k] * y[k] for k in range(n)) + sum(moves[y[k], y[k + 1]] for k in range(n - 1)))
            total += weight
            ones += weight * np.array(y)
            for k in range(n - 1):
                joint[y[k], y[k + 1]] += weight
        want[i:j] = ones / total
        expected += joint / total
    assert np.allclose(marginals, want) and np.allclose(pairs, expected)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 400)] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rng = random.Random(1)
    docs = odd.frame(spark, [(i, "good words in a line\nand more" if i % 2 else "### !! $$ ##\n" * rng.randrange(1, 5)) for i in range(400)] + odd.rows(5))
    model = line_quality.fit(docs, labels)
    scores = {r.doc_id: r.score for r in line_quality.quality(docs, model).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[301] > 0.7 > 0.3 > scores[300]
    assert line_quality.quality(odd.empty(spark), model).count() == 0
    for none in (labels.limit(0), labels.where("quality = 1")):
        got = {round(r.score, 9) for r in line_quality.quality(docs, line_quality.fit(docs, none)).collect()}
        assert len(got) == 1


@pytest.mark.parametrize("rows", [3, 10**6])
def test_sample_is_bounded_and_even(spark, rows):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("label"))
    got = samples.labelled_sample(labels, min(rows, 400)).groupBy("label").count().collect()
    assert sum(r["count"] for r in got) <= 800 and (rows == 3 or {r["label"]: 50 < r["count"] < 300 for r in got} == {"a": True, "b": True})


def words(text):
    from tests.llm.test_words import ALNUM, lower
    import re

    return re.findall(ALNUM, lower(text or ""))


def test_licence_phrases_equal_brute_force(spark):
    docs = odd.rows(5) + [(8000, "Under the MIT License. under-the-mit license under the mit license"), (8001, "Apache License, Version 2.0; CC BY-NC 4.0"), (8002, "cc by nc cc by nc"), (8003, "xunder the mit license")]
    found = licenses.scan(odd.frame(spark, docs)).collect()
    want = []
    for i, t in docs:
        w, at, labels = words(t), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            here = [s for s in range(len(w)) if w[s : s + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), sorted(labels)))
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(want, key=str)
    assert licenses.scan(odd.empty(spark)).count() == 0


def test_licence_rules():
    ordered = licenses.rules()
    assert len(ordered) > 200
    see = lambda t: [(x[0], t[x[1] : x[2]]) for x in licenses.detect(t, ordered)]
    assert see("released under the mit license. x") == [("mit", "released under the mit"), ("mit", "mit license")]
    assert see("spdx-license-identifier: apache-2.0 ") == [("apache-2", "spdx-license-identifier: apache-2.0")]
    assert [x[0] for x in see("licensed under the gnu general public license, version 3")] == ["gpl-3"]
    assert [x[0] for x in see("this work: cc by-nc-sa 4.0 license")] == ["cc-by-nc-sa"]
    assert see("all rights reserved") == []
