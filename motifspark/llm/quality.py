"""Quality classifier: supervised subword embeddings.

A token (a run of no white space) has the mean of the learned vectors of its hashed whole
form and its hashed character n-grams; a text has the mean over its tokens and over one
mark for each token that repeats the one before it; a softmax output gives the classes.
Vectors and output are trained together by stochastic gradient descent in numpy, on a
bounded sample of labelled rows. As the output is linear, each distinct token adds a fixed
amount to the class margin, and tokens that come again keep it.

Defined cases: a null or blank text gets the score of the empty text (the output's bias).
Without labelled rows every score is 0.5; an empty table gives no rows. Rows repeating a
doc_id are answered each; a null doc_id is carried along. Tokens of over ``LONGEST``
characters are read in segments of that many, each a token; texts of any length are read
whole. Columns other than doc_id and text are carried as they are where asked for, whatever
their names. The sample: about ``SAMPLE`` labelled rows a class, twice as many in all at most.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordScores, bounded, by_document, grid, held, id_crc, over_texts, spans, text_chunks

SAMPLE, BITS, DIM, LONGEST, GRAMS = 600, 16, 10, 40, (1, 2, 3, 4)
REPEAT = (1 << BITS) + 1  # the row of the repetition mark; 1 << BITS is padding


def tokens_of(text: str | None) -> list[str]:
    if not text:
        return []
    words = text.split()
    if max(map(len, words), default=0) > LONGEST:
        words = [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket rows of each word (padded), and how many there are."""
    codes, lens = grid([f"<{w}>" for w in words], max(map(len, words)) + 2)
    cols, counts = [], np.zeros(len(words), np.int64)
    for n, h in spans(codes, codes.shape[1]):
        if n in GRAMS:
            ok = np.arange(h.shape[1])[None, :] + n <= lens[:, None]
            cols.append(np.where(ok, (h >> np.uint64(64 - BITS)).astype(np.int64), 1 << BITS))
            counts += ok.sum(axis=1)
        here = lens == n
        if here.any():
            whole = np.full((len(words), 1), 1 << BITS)
            whole[here, 0] = (h[here, 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64)
            cols.append(whole)
            counts += here
    return np.concatenate(cols, axis=1), counts


class QualityModel:
    def __init__(self, dim: int = DIM, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-0.5, 0.5, ((1 << BITS) + 2, dim)) / dim
        self.vectors[1 << BITS] = 0
        self.out, self.bias = np.zeros((dim, 2)), np.zeros(2)

    def margins(self) -> np.ndarray:
        """What each row adds to the margin of class 1 over class 0."""
        return self.vectors @ (self.out[:, 1] - self.out[:, 0])

    def word_values(self, words: list[str]) -> np.ndarray:
        out, margin = np.zeros((len(words), 1)), self.margins()
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), 8192):
            at = order[a : a + 8192]
            rows, n = features([words[i] for i in at])
            out[at, 0] = margin[rows].sum(axis=1) / n
        return out

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 0.6, seed: int = 3) -> "QualityModel":
        bags = self._bags(texts)
        rng = np.random.default_rng(seed)
        steps, total = 0, epochs * max(1, len(texts))
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                lr = rate * (1 - steps / total)
                steps += 1
                rows, w = bags[i]
                x = w @ self.vectors[rows]
                z = x @ self.out + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                g = p.copy()
                g[labels[i]] -= 1
                gx = self.out @ g
                self.out -= lr * np.outer(x, g)
                self.bias -= lr * 0.1 * g
                self.vectors[rows] -= lr * w[:, None] * gx[None, :] * 4
        return self

    def _bags(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The rows of each text and their weights in its mean."""
        toks = [tokens_of(t) for t in texts]
        words = sorted({w for t in toks for w in t}, key=len)
        place = {w: i for i, w in enumerate(words)}
        flat: list = [None] * len(words)
        for a in range(0, len(words), 8192):
            rows, n = features(words[a : a + 8192])
            for i, (r, k) in enumerate(zip(rows, n)):
                flat[a + i] = r[r != 1 << BITS]
        out = []
        for t in toks:
            ids, count = np.unique(np.array([place[w] for w in t], np.int64), return_counts=True)
            twice = sum(x == y for x, y in zip(t, t[1:]))
            size = len(t) + twice
            parts = [flat[i] for i in ids]
            rows = np.concatenate([*parts, np.array([REPEAT] * bool(twice), np.int64)]) if len(t) else np.zeros(0, np.int64)
            w = np.concatenate([*(np.full(len(p), c / size / len(p)) for p, c in zip(parts, count)), np.array([twice / size] * bool(twice))]) if len(t) else np.zeros(0)
            u, inv = np.unique(rows, return_inverse=True)
            out.append((u.astype(np.int32), np.bincount(inv, w, len(u)).astype(np.float32)))
        return out


def train(rows: DataFrame, label: str = "quality", sample: int = SAMPLE) -> QualityModel | None:
    """Fit on a bounded sample of ``rows`` (doc_id, text, label 0 or 1)."""
    own = rows.filter(F.col(label).isin(0, 1) & F.col("text").isNotNull()).select("doc_id", label, "text")
    pdf = bounded(own, label, sample).toPandas().sort_values(["doc_id", "text"])
    return QualityModel().fit(list(pdf["text"]), pdf[label].to_numpy(np.int64)) if len(pdf) else None


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, sample: int) -> DataFrame:
    """Texts of a bounded sample of the labels whose id is outside the held-out fold."""
    own = labels.filter((F.pmod(id_crc(), F.lit(fold)) != held) & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias(label))
    ids = bounded(own, label, sample)  # twice the sample at most, so it may be broadcast
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def scored(docs: DataFrame, model: QualityModel | None, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, score (probability of class 1) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex  # the workers' stores outlive a job

    def run(texts: list[str]) -> dict:
        own = sent.value
        score = np.full(len(texts), 0.5)
        if own is None:
            return {"score": score}
        store = held(key, lambda: WordScores(own.word_values, 1))
        mark, bias = own.margins()[REPEAT], own.bias[1] - own.bias[0]
        for a, b in text_chunks(texts):
            words = [tokens_of(t) for t in texts[a:b]]
            at = store.look([w for x in words for w in x])
            lens = np.array([len(x) for x in words])
            sums = by_document(store.rows[at], lens)[:, 0]
            doc = np.repeat(np.arange(len(words)), lens)
            again = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1]) if len(at) else np.zeros(0, bool)
            twice = np.bincount(doc[1:][again], minlength=len(words)) if len(at) else np.zeros(len(words))
            z = (sums + twice * mark) / np.maximum(lens + twice, 1) + bias
            score[a:b] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return {"score": score}

    return over_texts(docs, run, "score double", *keep)
