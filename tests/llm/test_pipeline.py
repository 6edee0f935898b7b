"""The pipeline against a plain version of its rules."""

from __future__ import annotations

import corpus_pipeline
from samebytes.llm import decontamination, pii
from samebytes.llm.common import table
from tests_llm_helpers import brute_components

FOLDER = "/root/testdata/sf0.001"


def five(text):
    from samebytes.llm.near_duplicates import words_of

    words = words_of(text)
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def test_stages_one_by_one(spark):
    docs = table(spark, FOLDER, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]

    good = stages["quality"](spark, docs, FOLDER)
    kept = {r.doc_id: r for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert good.columns == columns and sum(i in kept for i in clean) > 0.95 * len(clean)

    once = stages["near_duplicates"](spark, good, FOLDER)
    sets = {i: five(r.text) for i, r in kept.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = brute_components(links, sets)
    left = {r.doc_id: r for r in once.collect()}
    assert set(left) == {i for i in sets if roots[i] == i} and once.columns == columns

    fair = stages["decontamination"](spark, once, FOLDER)
    items = [decontamination.words_of(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    holds = lambda text: any(f" {' '.join(i)} " in f" {' '.join(decontamination.words_of(text))} " for i in items)
    assert fair.columns == columns and {r.doc_id for r in fair.collect()} == {i for i, r in left.items() if not holds(r.text)}

    private = stages["pii"](spark, fair, FOLDER)
    anchors = pii.automaton()
    assert private.columns == columns and private.count() == fair.count()
    assert all(not pii.find_spans(r.text, anchors) and r.n_chars == len(r.text) for r in private.collect())

    mixed = stages["mixing"](spark, private, FOLDER)
    assert mixed.columns[: len(columns)] == columns and mixed.count() > 0


def test_run_and_awkward_rows(spark, awkward, no_docs):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for docs in (awkward, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert set(docs.columns) <= set(out.columns)
            # Mixing repeats documents of small sources.
            assert out.count() <= docs.count() * (4 if name == "mixing" else 1)
