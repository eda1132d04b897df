"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all documents that may be learnt from, as counts for each of a fixed number of
hashed n-grams. Weights are trained by follow-the-regularised-leader (proximal, per coordinate) with elastic-net
penalties on a bounded sample; a temperature fitted on a held-back part of that sample calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold, sampled

#: Hash buckets of n-grams of 1 to ORDERS characters.
BUCKETS, ORDERS = 1 << 16, 3
#: Rows that the weights are trained on, at most about so many; rounds over them.
TRAIN_ROWS, EPOCHS = 6000, 2
#: Characters that the sample has at most about, beside one text of any length.
TRAIN_CHARS = 60_000_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5


def _classes() -> np.ndarray:
    """Characters below 0x250: letters lower-cased, all others a space."""
    out = np.full(0x250, 32, np.uint32)
    for i in range(0x250):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


_CLASS = _classes()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the text's n-grams hash to, ascending, and their counts. Runs of other characters are one space."""
    c = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(c < 0x250, _CLASS[np.minimum(c, 0x24F)], c).astype(np.uint32)
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    counts, h = np.zeros(BUCKETS, np.int64), np.zeros(len(c), np.uint32)
    for n in range(1, ORDERS + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ c[n - 1 :] * np.uint32(0x9E3779B1)
        counts += np.bincount((h ^ h >> np.uint32(15)) % np.uint32(BUCKETS), minlength=BUCKETS)
    nz = np.flatnonzero(counts)
    return nz, counts[nz]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = ngram_counts(text)
        x = (1 + np.log(n)) * self.idf[at]
        return at, x / max(1e-12, np.sqrt(x @ x))

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and probability; und for null and texts without a letter, or where nothing was learnt."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*self.features(text)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights (BUCKETS x classes); coordinates whose sums stay within L1 are exactly 0."""
    z, n, order = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes)), np.random.default_rng(seed)

    def weights(at):
        big = np.abs(z[at]) > L1
        return np.where(big, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            g = softmax(x @ w)
            g[y[i]] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search."""

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    a, b, r = np.log(0.25), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each bucket, and how many texts there are; a vector of fixed length from every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                df[ngram_counts(text.as_py())[0]] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    sums = texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(BUCKETS, np.int64), 0
    for bucket, n in sums:
        if bucket < 0:
            total = n
        else:
            out[bucket] = n
    return out, total


def train(labelled: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """labelled (doc_id, text, lang), without nulls in text and lang. No rows give a model that says und."""
    df, total = document_frequencies(labelled)
    rows = sorted((lang, text) for text, lang in bounded(sampled(labelled, "doc_id", bound, 31), "doc_id", "text", TRAIN_CHARS, 37).select("text", "lang").collect() if has_letter(text))
    languages = sorted({lang for lang, _ in rows})
    model = Model(languages, np.log((1 + total) / (1 + df)) + 1, np.zeros((BUCKETS, len(languages))))
    x, y = [model.features(t) for _, t in rows], np.array([languages.index(lang) for lang, _ in rows])
    if len(languages) > 1:
        held = np.arange(len(rows)) % 5 == 4
        model.weights = ftrl([a for a, h in zip(x, held, strict=True) if not h], y[~held], len(languages))
        if held.any():
            model.temperature = temperature(np.stack([model.logits(*a) for a, h in zip(x, held, strict=True) if h]), y[held])
        used = np.flatnonzero(np.abs(model.weights).sum(axis=1))
        model.weights[np.setdiff1d(np.arange(BUCKETS), used)] = 0
    return model


def languages_of(text: Column, model: Model) -> Column:
    """struct(lang_pred, score)"""

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score"])

    return udf(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bound: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs.

    Learns from rows with text, lang and an id whose crc32 modulo 4 isn't 2; rows with a null id are held out. Null
    texts and those without a letter are und with score 0. Repeated rows stay; other columns are ignored; an empty table
    gives an empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(True))
    model = train(rows.where(~held & F.col("text").isNotNull() & F.col("lang").isNotNull()), bound)
    found = rows.select("doc_id", held.alias("held_out"), languages_of(F.col("text"), model).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score")
