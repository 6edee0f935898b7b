"""Held-out accuracy of the trained operators, and their awkward rows."""

from __future__ import annotations

import random
import zlib

import numpy as np

from samebytes.llm import language, quality, toxicity
from samebytes.llm.common import table
from samebytes.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def held_out(number, folds, one):
    return zlib.crc32(str(number).encode()) % folds == one


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in table(spark, FOLDER, "documents").select("doc_id", "lang").collect()}
    rows = QUERIES["op5_subword_language"](spark, FOLDER).collect()
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == held_out(r.doc_id, 5, 0) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) > 0.97 * len(test)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark, awkward, no_docs):
    model = language.learn_languages(awkward)
    rows = language.identify_language(awkward, model).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 5, 8)} == {language.UNKNOWN}
    assert {r.lang_pred for r in rows} <= {"en", "de", language.UNKNOWN}
    nothing = language.learn_languages(no_docs)
    assert {r.lang_pred for r in language.identify_language(awkward, nothing).collect()} == {language.UNKNOWN}
    assert language.identify_language(no_docs, model).count() == 0


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    rows = [r for r in QUERIES["op3_hierarchical_quality"](spark, FOLDER).collect() if r.doc_id in labels]
    test = [r for r in rows if held_out(r.doc_id, 3, 1)]
    assert sum(r.accepted == (labels[r.doc_id] == 1) for r in test) > 0.93 * len(test)


def test_quality_of_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (9, 1), (None, 1), (2, None), (1, 1)], "doc_id long, quality int")
    out = quality.score_quality(awkward, labels)
    assert out.count() == awkward.count() and out.columns[: len(awkward.columns)] == awkward.columns
    assert out.filter("quality_score IS NULL OR accepted IS NULL").count() == 0
    assert quality.score_quality(awkward, labels.limit(0)).filter("quality_score < 0 OR quality_score > 1").count() == 0
    assert quality.score_quality(no_docs, labels).count() == 0


def test_sparse_sites_shrink_to_their_host(spark):
    rows = [("big", "a", 1.0)] * 300 + [("big", "a", 0.0)] * 100 + [("bad", "a", 0.0)] * 190 + [("bad", "a", 1.0)] * 10
    rows += [("bad", "new", 1.0), ("big", "new", 1.0)]
    sites, base = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, good double"))
    rate = {(r.host, r.path): r.site for r in sites.collect()}
    assert rate["bad", "a"] < rate["bad", "new"] < rate["big", "new"] and rate["bad", "a"] < base < rate["big", "a"]


def words(some, n):
    return " ".join(some.choice("lorem ipsum dolor sit amet tempor magna aliqua".split()) + str(some.randrange(40)) for _ in range(n))


def test_toxicity_from_positives_and_unlabelled_rows(spark):
    some = random.Random(3)
    docs, labels = [], []
    for n in range(1500):
        toxic = n % 8 == 0
        text = words(some, some.randint(10, 80))
        docs.append((n, text + (" vilest" if toxic else "") + " " + words(some, 10)))
        labels.append((n, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    test = [r for r in toxicity.score_toxicity(frame, model).collect() if held_out(r.doc_id, 3, 1)]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in test]) > 0.97
    assert model.score("") == model.score(None) < 0.7


def test_negative_part_of_the_risk_stays_at_zero():
    """Few positives with words of their own do not drive the prior's share of the rest to toxic."""
    some = np.random.default_rng(1)
    positive = [np.unique(np.append(some.integers(10, 5000, 20), 1)).astype(np.int32) for _ in range(60)]
    rest = [np.unique(some.integers(10, 5000, 20)).astype(np.int32) for _ in range(540)]
    model = toxicity.train(positive, rest + positive, 0.1)
    at = np.searchsorted(model.buckets, 1)
    assert model.buckets[at] == 1 and model.weights[at] + model.bias > 0.5 and model.bias < -1


def test_toxicity_of_awkward_rows(spark, awkward, no_docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (2, None), (1, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.learn_toxicity(awkward, labels)
    out = toxicity.score_toxicity(awkward, model)
    assert out.count() == awkward.count() and out.filter("score IS NULL").count() == 0
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "h", "score", "predicted"]
    assert toxicity.score_toxicity(no_docs, toxicity.learn_toxicity(no_docs, labels.limit(0))).count() == 0
