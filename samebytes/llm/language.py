"""Language identification by averaged subword embeddings.

A text is the average of the embeddings of its hashed letter sequences (one to three letters,
with word boundaries); a linear softmax over that average gives the language. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, on a bounded sample. A part
of the sample is set aside to calibrate a temperature and the score below which a prediction is
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samebytes.llm.common import fold, hash_share, materialize, ship

#: Documents to learn from, in expectation, dealt evenly to the languages.
TRAIN_ROWS = 6_000
#: Rows of a fold (of five) that are never learned from.
HELD_OUT = 0
BUCKETS, DIMENSIONS = 4096, 24
UNKNOWN = "und"
#: Accepted predictions of the calibration part may be wrong at this rate.
MAX_ERROR = 0.01

_BOUNDARY = 32


def subword_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter sequences of a whole text; null for texts without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    kinds, places = np.unique(codes, return_inverse=True)
    letter = np.array([chr(k).isalpha() for k in kinds.tolist()], bool)[places]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint64(_BOUNDARY))
    line = np.concatenate([[np.uint64(_BOUNDARY)], codes, [np.uint64(_BOUNDARY)]])
    is_letter = line != _BOUNDARY
    counts = np.zeros(BUCKETS, np.int64)
    hashed = np.zeros(len(line), np.uint64)
    for size in (1, 2, 3):
        n = len(line) - size + 1
        hashed = (hashed[:n] * np.uint64(0x100000001B3)) ^ (line[size - 1 :] * np.uint64(0x9E3779B97F4A7C15))
        hashed = hashed ^ (hashed >> np.uint64(29))
        # A boundary may stand at either end, never inside, and not alone.
        good = is_letter[:n] if size == 1 else is_letter[:n] | is_letter[size - 1 :]
        if size == 3:
            good = good & is_letter[1:-1]
        counts += np.bincount((hashed[good] % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return counts


@dataclass
class Model:
    """Languages, embeddings, softmax and calibration."""

    languages: list[str]
    embeddings: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        """For rows of frequencies that add up to 1."""
        return x @ self.embeddings @ self.output + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the score is high enough."""
        counts = subword_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, False
        some = np.flatnonzero(counts)
        mean = (counts[some] / counts.sum()) @ self.embeddings[some]
        p = _softmax((mean @ self.output + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.accept)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 20, batch: int = 32, rate: float = 8.0) -> Model:
    """Gradient descent on the cross-entropy; every fifth row calibrates.

    `x` has a row of subword frequencies per text, `y` the number of its language. Rows of a
    language are weighted so that all languages count alike.
    """
    random = np.random.default_rng(5)
    k = len(languages)
    held = np.arange(len(x)) % 5 == 4
    fit = np.flatnonzero(~held) if (~held).any() and len(np.unique(y[~held])) == k else np.arange(len(x))
    test = np.flatnonzero(held)
    weight = np.array([len(fit) / (k * max(1, (y[fit] == c).sum())) for c in range(k)])
    e = random.normal(0, 1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w, b = np.zeros((DIMENSIONS, k), np.float32), np.zeros(k, np.float32)
    total, step = epochs * -(-len(fit) // batch), 0
    for _ in range(epochs):
        order = random.permutation(fit)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            h = x[rows] @ e
            p = _softmax(h @ w + b)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= (weight[y[rows]] / len(rows))[:, None]
            speed = rate * (1 - step / total)
            back = p @ w.T
            w -= speed * (h.T @ p)
            b -= speed * 0.1 * p.sum(axis=0)
            # Only buckets that occur in the batch change.
            used = np.flatnonzero(x[rows].any(axis=0))
            e[used] -= speed * (x[rows][:, used].T @ back)
            step += 1
    model = Model(languages, e.astype(float), w.astype(float), b.astype(float))
    return calibrate(model, x[test], y[test]) if len(test) else model


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """Set the temperature of least cross-entropy and the lowest score that keeps errors rare."""
    z = model.logits(x)
    # Half a wrong answer keeps a faultless part from an infinite certainty.
    smooth = 0.5 / (len(y) + 1)

    def loss(t: float) -> float:
        p = _softmax(z / t)
        own = p[np.arange(len(y)), y]
        return float(-((1 - smooth) * np.log(own + 1e-12) + smooth * np.log(p.mean(axis=1) + 1e-12)).mean())

    model.temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    p = _softmax(z / model.temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[order] != y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(wrong <= MAX_ERROR)
    model.accept = float(p.max(axis=1)[order][fine[-1]]) if len(fine) else 1.0
    return model


def learn_languages(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS
) -> Model:
    """Train on about `rows` documents with a language outside the held-out fold (crc32 of the id

    as text modulo 5). Every language has the same expected number of documents, as far as it has that
    many; rows are told apart by id and text, and of equal rows one counts. Documents without language or
    text are left out, and those without id are held out. Without such documents the model knows no language.
    """
    ship(docs.sparkSession)

    # As bytes, a sample takes little memory on the driver.
    @F.pandas_udf("struct<place:binary,count:binary>")
    def sparse(texts: pd.Series) -> pd.DataFrame:
        found = [subword_counts(t) for t in texts]
        return pd.DataFrame({
            "place": [None if c is None else np.flatnonzero(c).astype("<i4").tobytes() for c in found],
            "count": [None if c is None else c[c > 0].astype("<i4").tobytes() for c in found],
        })

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col(id), 5) != HELD_OUT))
    # One row per language.
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang).cast("string")).count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    each = max(1.0, rows / len(sizes))
    share = F.element_at(
        F.create_map(*[x for name, n in sorted(sizes.items()) for x in (F.lit(name), F.lit(min(1.0, each / n)))]),
        F.col(lang).cast("string"),
    )
    chosen = known.filter(hash_share(share, "language", F.col(id), F.col(text))).select(
        F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    found = chosen.distinct().select("id", "lang", sparse("text").alias("x")).filter("x.place IS NOT NULL").collect()
    found.sort(key=lambda r: (r.id is None, 0 if r.id is None else r.id, r.lang, r.x.place))
    languages = sorted({r.lang for r in found})
    x = np.zeros((len(found), BUCKETS), np.float32)
    for i, r in enumerate(found):
        counts = np.frombuffer(r.x["count"], np.int32)
        x[i, np.frombuffer(r.x.place, np.int32)] = counts / np.float32(counts.sum())
    y = np.array([languages.index(r.lang) for r in found], np.int64)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    return train(x, y, languages)


def identify_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Documents with `lang_pred`, `lang_score` and `lang_accepted`.

    Null texts and texts without a letter are `und` with score 0 and not accepted, as are all
    texts if the model knows no language. Every text is read whole. Other columns pass through;
    those with the names of the results are replaced.
    """
    ship(docs.sparkSession)
    results = ("lang_pred", "lang_score", "lang_accepted")

    @F.pandas_udf("struct<lang_pred:string,lang_score:double,lang_accepted:boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=list(results))

    plain = docs.drop(*[c for c in results if c in docs.columns])
    packed = plain.select(F.struct(*plain.columns).alias("row"), predict(F.col(text)).alias("p"))
    return packed.select(
        *[F.col("row").getField(c).alias(c) for c in plain.columns], *[F.col(f"p.{c}").alias(c) for c in results]
    )
