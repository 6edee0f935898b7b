"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents count as labels. Everything else is unlabelled: a mixture in which
a share of documents, the class prior, is toxic too. With loss l, prior p, and means over positive (P)
and unlabelled (U) documents, the risk of a classifier g is

    p * P[l(g)] + max(0, U[l(-g)] - p * P[l(-g)])

where the second term estimates the risk on the negatives. It is never negative for the true
classifier; where a step drives it below zero, the classifier has begun to memorise, and the
next step goes back up that term instead. Steps are taken over the whole samples: in small batches
the number of hidden positives varies so much that the term is below zero by chance.

The classifier is linear over hashed features that are present or not: words, and beginnings of
words that at least one, two, four or eight different words of the text share. So one insult in a
long text weighs as much as in a short one. It is trained in numpy on bounded samples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import fold, hash_share, materialize, ship
from samebytes.llm.linear import sigmoid
from samebytes.operators.scale import lookup_join

#: Positive and unlabelled documents to train on, in expectation.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Rows of a fold (of three) whose labels are never learned.
HELD_OUT = 1
THRESHOLD = 0.7
#: Hash buckets of words, and how many of them the classifier uses.
BUCKETS, SELECTED = 1 << 20, 1024
#: Letters of a beginning, and the numbers of words that are told apart.
PREFIXES, LEVELS = (4, 5, 6), (1, 2, 4, 8)
_LEVEL = 0x9E3779B1
#: Least gain in log-likelihood of a used bucket: about one in 20,000 gets there by chance.
MIN_GAIN = 8.0

_WORD = re.compile(r"[^\W\d_]+")


def text_buckets(text: str | None) -> np.ndarray:
    """Hashed features of a whole text, sorted."""
    words = set(_WORD.findall(text.lower())) if text else ()
    keys = [crc32(f"{w}$".encode("utf-8", "surrogatepass")) for w in words]
    shared = Counter(w[:size] for w in words for size in PREFIXES if len(w) >= size)
    for prefix, count in shared.items():
        key = crc32(prefix.encode("utf-8", "surrogatepass"))
        keys += [key + level * _LEVEL for level in LEVELS if level <= count]
    return np.unique(np.array(keys, np.int64) % BUCKETS).astype(np.int32)


class Classifier:
    """Weights of the selected buckets and a bias."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias

    def score(self, text: str | None) -> float:
        found = text_buckets(text)
        if not len(self.buckets) or not len(found):
            return float(sigmoid(self.bias))
        place = np.minimum(np.searchsorted(self.buckets, found), len(self.buckets) - 1)
        return float(sigmoid(self.bias + self.weights[place[self.buckets[place] == found]].sum()))


def select_buckets(positive: list[np.ndarray], unlabelled: list[np.ndarray], count: int) -> np.ndarray:
    """Buckets whose document frequency differs most between the samples, by signed root likelihood ratio."""

    def frequency(rows):
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        return np.bincount(flat, minlength=BUCKETS).astype(float)

    a, b, n, m = frequency(positive), frequency(unlabelled), max(len(positive), 1), max(len(unlabelled), 1)
    pooled = (a + b) / (n + m)

    def part(seen, size):
        rate = seen / size
        with np.errstate(divide="ignore", invalid="ignore"):
            one = np.where(seen > 0, seen * np.log(rate / pooled), 0)
            none = np.where(seen < size, (size - seen) * np.log((1 - rate) / (1 - pooled)), 0)
        return one + none

    gain = np.where(a + b > 1, part(a, n) + part(b, m), 0)
    top = np.argsort(-gain, kind="stable")[:count]
    return np.sort(top[gain[top] > MIN_GAIN]).astype(np.int32)


def _matrix(rows: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), len(buckets)), np.float32)
    for i, row in enumerate(rows):
        place = np.minimum(np.searchsorted(buckets, row), len(buckets) - 1)
        out[i, place[buckets[place] == row]] = 1
    return out


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 500,
    rate: float = 0.02, ridge: float = 1e-4,
) -> Classifier:
    """Minimise the non-negative risk with logistic loss by Adam.

    Without positives, unlabelled rows or prior, the classifier gives the prior to every text.
    """
    prior = min(max(prior, 0.0), 0.999)
    start = float(np.log(max(prior, 1e-4) / (1 - prior)))
    buckets = select_buckets(positive, unlabelled, SELECTED)
    if not positive or not unlabelled or prior == 0 or not len(buckets):
        return Classifier(buckets[:0], np.empty(0), start)
    p, u = _matrix(positive, buckets), _matrix(unlabelled, buckets)
    weights = np.zeros(len(buckets) + 1)
    weights[-1] = start
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        narrow = weights[:-1].astype(np.float32)
        gp, gu = p @ narrow + weights[-1], u @ narrow + weights[-1]
        sp, su = sigmoid(gp), sigmoid(gu)
        # Loss of calling x negative is log(1 + e^g), its slope the sigmoid.
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        down_u, down_p = su / len(su), -prior * sp / len(sp)
        if negative >= 0:
            slope_u, slope_p = down_u, down_p + prior * (sp - 1) / len(sp)
        else:
            slope_u, slope_p = -down_u, -down_p
        inner = u.T @ slope_u.astype(np.float32) + p.T @ slope_p.astype(np.float32)
        gradient = np.append(inner + ridge * weights[:-1], slope_u.sum() + slope_p.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        speed = rate * (1 - (step - 1) / steps)
        weights -= speed * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Classifier(buckets, weights[:-1], float(weights[-1]))


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
    prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Classifier:
    """Train on documents outside the held-out fold (crc32 of the id as text modulo 3).

    Positives are a sample of the documents labelled 1, unlabelled ones a sample of all documents,
    whatever their label: `positives` and `unlabelled` rows in expectation, told apart by id and text, and
    of equal rows one. The prior is the share of 1 among the labels outside the fold unless given. Null ids
    and null labels do not count as labels; of several labels of an id the largest does. Documents
    without id are unlabelled ones. Without labels, or on empty tables, the classifier gives every text
    the prior.
    """
    ship(docs.sparkSession)

    # As bytes, a sample takes little memory on the driver.
    @F.pandas_udf("binary")
    def buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([text_buckets(t).astype("<i4").tobytes() for t in texts])

    learned = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id), 3) != HELD_OUT))
    known = materialize(learned.groupBy(id).agg(F.max(F.when(F.col(label) == 1, 1).otherwise(0)).alias("known")))
    rows, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("known"), F.lit(0))).first()
    if prior is None:
        prior = toxic / rows if rows else 0.0
    open_docs = docs.filter(fold(F.col(id), 3) != HELD_OUT).select(F.col(id).alias("id"), F.col(text).alias("text"))
    marked = known.filter("known = 1").select(F.col(id).alias("id"))
    confirmed = lookup_join(open_docs, marked, "id", "left_semi")

    def collected(some: DataFrame, rows: int, seed: str) -> list[np.ndarray]:
        share = rows / max(some.select("id").count(), 1)
        chosen = some.filter(hash_share(share, seed, F.col("id"), F.col("text"))).distinct()
        found = chosen.select("id", buckets("text").alias("x")).collect()
        return [np.frombuffer(r.x, np.int32) for r in sorted(found, key=lambda r: (r.id is None, 0 if r.id is None else r.id, r.x))]

    return train(
        collected(confirmed, positives, "toxic"), collected(open_docs, unlabelled, "unlabelled"), prior
    )


def score_toxicity(docs: DataFrame, model: Classifier, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Documents with `score` (0 to 1) and `predicted` (1 if score >= threshold, else 0).

    Every text is scored whole; null and empty texts, and texts without words, have the score of
    the bias. Other columns pass through; those with the names of the results are replaced.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    plain = docs.drop(*[c for c in ("score", "predicted") if c in docs.columns and c != text])
    scored = plain.select(F.struct(*plain.columns).alias("row"), score(F.col(text)).alias("score"))
    return scored.select(
        *[F.col("row").getField(c).alias(c) for c in plain.columns],
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
