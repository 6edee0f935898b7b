"""Document quality by hierarchical empirical Bayes.

A logistic classifier over features of the whole text gives the evidence of the document itself.
Sites give the rest: the good documents of a host (as labelled, else as the classifier expects)
are counted in grouped aggregations, the host's rate is shrunk towards the global rate, and the rate
of each path of a host towards the host's. The prior strength of both levels is estimated by
moments, so sites with few documents stay close to their prior. A document's log-odds are those of
its text, shifted by how far the posterior of its site departs from the global rate.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import Workspace, fold, hash_share, materialize, ship
from samebytes.llm.linear import fit_logistic
from samebytes.operators.scale import lookup_join

#: Labelled rows to fit on, in expectation; documents below `KEEP` are rejected.
TRAIN_ROWS, KEEP = 20_000, 0.5
#: Rows of a fold (of three) that are never learned from.
HELD_OUT = 1
MIN_RHO, MAX_RHO = 1e-4, 0.5
_ODDS = 12.0

_WORD = re.compile(r"\S+")
FEATURES = (
    "empty", "log_words", "variety", "repeated", "repeated_pairs", "repeated_lines", "symbols", "symbol_words",
    "capitals", "digits", "word_length", "top_word",
)


def text_features(text: str | None) -> list[float]:
    """Features of a whole text; null, empty and blank texts have only the first one."""
    words = _WORD.findall(text) if text else []
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    counts = Counter(words)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdecimal, text))
    blank = sum(map(str.isspace, text))
    symbols = len(text) - letters - digits - blank
    pairs = Counter(zip(words, words[1:]))
    lines = [line for line in text.split("\n") if line.strip()]
    return [
        0.0,
        float(np.log(n)),
        # Distinct words against the power law of growing vocabularies.
        float(np.log(len(counts)) / np.log(n + 1)),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(pairs) / (n - 1) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        symbols / max(1, len(text) - blank),
        sum(not word[0].isalnum() or not word[-1].isalnum() and word[-1] not in ".,;:!?)" for word in words) / n,
        upper / max(1, letters),
        digits / max(1, len(text) - blank),
        sum(map(len, words)) / n / 10,
        counts.most_common(1)[0][1] / n,
    ]


def _expand(x: np.ndarray) -> np.ndarray:
    """Features, their squares and square roots."""
    return np.column_stack([x, x**2, np.sqrt(np.abs(x))])


class TextClassifier:
    """Standardised features and logistic weights."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.rate = float(y.mean()) if len(y) else 0.5
        self.weights = None
        if len(np.unique(y)) == 2:
            wide = _expand(x)
            self.mean, self.scale = wide.mean(axis=0), wide.std(axis=0) + 1e-6
            self.weights = fit_logistic((wide - self.mean) / self.scale, y)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            rate = min(max(self.rate, 1e-3), 1 - 1e-3)
            return np.full(len(x), np.log(rate / (1 - rate)))
        z = np.clip((_expand(x) - self.mean) / self.scale, -10, 10)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -_ODDS, _ODDS)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def _posterior(level: DataFrame, parent: Column) -> Column:
    """Mean of the beta posterior of every row, from `n` and `good` and its parent's mean."""
    rate, size, variance = F.col("good") / F.col("n"), F.col("n"), parent * (1 - parent)
    row = level.agg(
        F.sum(size * (rate - parent) * (rate - parent)).alias("spread"),
        F.sum(variance).alias("noise"),
        F.sum(variance * (size - 1)).alias("room"),
    ).first()
    rho = (row.spread - row.noise) / row.room if row.room else MIN_RHO
    strength = 1 / min(max(rho, MIN_RHO), MAX_RHO) - 1
    return (F.lit(strength) * parent + F.col("good")) / (F.lit(strength) + size)


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """`host`, `path` and the posterior rate `site` of each, and the global rate.

    `evidence` has a row per document: host, path and `good` between 0 and 1.
    """
    paths = materialize(
        evidence.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("good").alias("good"))
    )
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    base = good / n if n else 0.5
    priors = hosts.select("host", _posterior(hosts, F.lit(base)).alias("prior"))
    joined = materialize(lookup_join(paths, materialize(priors), "host"))
    return joined.select("host", "path", _posterior(joined, F.col("prior")).alias("site")), base


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    label: str = "quality",
    train_rows: int = TRAIN_ROWS,
    keep: float = KEEP,
) -> DataFrame:
    """Documents with `text_score`, `site_score`, `quality_score` and `accepted`.

    `labels` has the id and a label of 1 (good) or 0; null ids and labels do not count, and of
    repeated labels of an id the lowest does. Labels of fold `HELD_OUT` (crc32 of the id as text
    modulo 3) are never used. The classifier is fitted on a sample of about `train_rows` labelled
    documents, told apart by id and text, and of equal rows one; sites count all documents. Null hosts and paths are sites named ``. Null, empty and blank
    texts have features of their own. Without labels of both kinds the text gives their rate, or
    0.5. Other columns pass through; those with the names of the results are replaced.
    """
    results = ("text_score", "site_score", "quality_score", "accepted")
    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts])

    known = labels.filter(F.col(id).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id), 3) != HELD_OUT))
    known = materialize(known.groupBy(id).agg(F.min(F.when(F.col(label) == 1, 1).otherwise(0)).alias("known")))
    known = known.withColumnRenamed(id, "id")
    learned = lookup_join(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), known, "id")
    share = train_rows / max(learned.select("id").count(), 1)
    sample = learned.filter(hash_share(share, "quality", F.col("id"), F.col("text"))).distinct()
    # About `train_rows` documents, and a dozen numbers for each.
    fitted = sample.select("id", features("text").alias("x"), "known").collect()
    fitted.sort(key=lambda r: (r.id, r.x))
    model = TextClassifier(
        np.array([r.x for r in fitted]).reshape(-1, len(FEATURES)), np.array([r.known for r in fitted], float)
    )

    @F.pandas_udf("double")
    def log_odds(texts: pd.Series) -> pd.Series:
        x = np.array([text_features(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.log_odds(x))

    site = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    plain = docs.drop(*[c for c in results if c in docs.columns])
    # Every text is measured once; rows are written with their evidence and read twice.
    packed = Workspace(docs.sparkSession).write(
        plain.select(
            F.struct(*plain.columns).alias("row"), F.col(id).alias("id"), site(host).alias("host"), site(path).alias("path"),
            log_odds(F.col(text)).alias("odds"),
        )
    )
    expected = 1 / (1 + F.exp(-F.col("odds")))
    good = lookup_join(packed.select("id", "host", "path", "odds"), known, "id", "left").withColumn(
        "good", F.coalesce("known", expected)
    )
    sites, base = site_posteriors(good.select("host", "path", "good"))
    scored = lookup_join(packed, materialize(sites), ["host", "path"])
    score = 1 / (1 + F.exp(-(F.col("odds") + _logit(F.col("site")) - _logit(F.lit(base)))))
    return scored.withColumn("score", score).select(
        *[F.col("row").getField(c).alias(c) for c in plain.columns],
        (1 / (1 + F.exp(-F.col("odds")))).alias("text_score"),
        F.col("site").alias("site_score"),
        F.col("score").alias("quality_score"),
        (F.col("score") >= keep).alias("accepted"),
    )
