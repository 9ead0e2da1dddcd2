"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary. For each language a distribution over pieces is
learned by expectation-maximisation on word counts of a bounded sample. A word's probability
in a language is the sum over all its segmentations into pieces, by a forward pass; a text's
log probability is the sum over its words. The forward pass runs on matrices of distinct
words, and words that come again keep their values.

Words are runs of letters (Unicode letters, no numbers), lower-cased, with a word mark in
front, of any length: the forward pass holds the last ``LONGEST`` positions, rescaled as it
goes, so all segmentations of a word count however long it is. A letter that is no piece has
a floor probability.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Ties go to the
first language by code point. Without training rows every text is ``und``; an empty table
gives no rows. Rows repeating a doc_id are answered each; a null doc_id is carried along.
Columns other than doc_id and text take part in no prediction, whatever their names; those
asked for are carried as they are. The fit: about ``SAMPLE`` whole texts a language, chosen
by a hash of doc_id, of the ``LANGS`` languages with most rows; a word of over ``TAUGHT`` letters
teaches nothing.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordScores, bounded, by_document, grid, held, over_texts, spans, text_chunks

LETTERS = re.compile(r"[^\W\d_]+")
#: Numbers that are no decimal digits (such as fractions) are word characters too, but no letters. Those of
#: 16 bits apart: such a class is one table, one with wider characters a list that is searched for each character.
NUMBERS = [c for c in map(chr, range(128, 0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal()]
NARROW, WIDE = (re.compile("[" + "".join(c for c in NUMBERS if (c > "\uffff") == wide) + "]") for wide in (False, True))
SAMPLE, LANGS, LONGEST, TAUGHT = 400, 200, 8, 600
CELLS, BLOCK = 400_000, 4096
MARK = "▁"
FLOOR = 1e-8


def letters_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = NARROW.sub(" ", text)
        if len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text):
            text = WIDE.sub(" ", text)
    return LETTERS.findall(text)


def vocabulary_pieces(name: str = "piece_bpe_32k.model") -> list[str]:
    """Lower-case pieces of letters, with or without the word mark, of ``LONGEST`` characters at most."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in found if len(p) <= LONGEST and LETTERS.fullmatch(p.removeprefix(MARK) or "-"))


class PieceTable:
    """Which pieces a matrix of characters has where: open addressing on 64-bit hashes."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.bits = max(8, (4 * self.n).bit_length())
        keys = np.zeros(self.n, np.uint64)
        for size in range(1, LONGEST + 1):
            at = [i for i, p in enumerate(pieces) if len(p) == size]
            if at:
                codes, _ = grid([pieces[i] for i in at], size)
                for n, h in spans(codes, size):
                    if n == size:
                        keys[at] = h[:, 0]
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, self.n, np.int32)
        for i, k in enumerate(keys):
            s = int(k) >> (64 - self.bits)
            while self.ids[s] != self.n:
                s = (s + 1) % len(self.ids)
            self.keys[s], self.ids[s] = k, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; n where there is none."""
        shape, h = h.shape, h.ravel()
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.ids[slot]
        open_ = np.flatnonzero((self.keys[slot] != h) & (out != self.n))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.ids)
            out[open_] = self.ids[slot[open_]]
            open_ = open_[(self.keys[slot[open_]] != h[open_]) & (out[open_] != self.n)]
        return out.reshape(shape)


class LanguageModel:
    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray | None = None):
        self.langs, self.table = langs, PieceTable(pieces)
        #: pieces + 1 rows (the last is: no piece), a column a language
        self.probs = np.full((len(pieces) + 1, len(langs)), 1.0 / max(1, len(pieces))) if probs is None else probs
        self.probs[-1] = 0

    def lattice(self, words: list[str]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """For each piece length the ids by (word, start), and the words' lengths."""
        codes, lens = grid(words, max(map(len, words)))
        return [(n, self.table.find(h)) for n, h in spans(codes, LONGEST)], lens

    def word_values(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), len(self.langs)))
        for at, own in batches_of([MARK + w for w in words]):
            out[at] = self.log_forward(own)
        return out

    def log_forward(self, words: list[str]) -> np.ndarray:
        """The forward pass over words sorted by length: memory holds ``LONGEST`` positions and a block's lattice."""
        lens = np.array([len(w) for w in words])
        out, scale = np.zeros((len(words), len(self.langs))), np.zeros((len(words), len(self.langs)))
        ring = [np.zeros_like(out) for _ in range(LONGEST)]  # position e at e % LONGEST
        ring[0] += 1
        for start in range(0, int(lens[-1]), BLOCK):
            stop, low = min(start + BLOCK, int(lens[-1])), max(0, start - LONGEST + 1)
            codes, _ = grid([w[low:stop] for w in words], stop - low)
            lat = [(n, self.table.find(h)) for n, h in spans(codes, LONGEST)]
            for e in range(start + 1, stop + 1):
                now = np.zeros_like(out)
                for n, ids in lat:
                    if n <= e:
                        own, before = ids[:, e - n - low], ring[(e - n) % LONGEST]
                        if n == 1:
                            now += before * np.maximum(self.probs[own], FLOOR)
                        elif len(hit := np.flatnonzero(own != self.table.n)):
                            now[hit] += before[hit] * self.probs[own[hit]]
                ring[e % LONGEST] = now
                if e % 16 == 0:  # before anything can underflow
                    top = np.max(ring, axis=0)
                    scale += np.log(top)
                    for x in ring:
                        x /= top
                    now = ring[e % LONGEST]
                a, b = np.searchsorted(lens, [e, e + 1])
                out[a:b] = np.log(now[a:b]) + scale[a:b]
        return out

    def forward(self, lat: list, lens: np.ndarray, kind=np.float64) -> np.ndarray:
        """All positions' sums, unscaled, as the fit needs them."""
        width = int(lens.max())
        alpha = np.zeros((len(lens), width + 1, len(self.langs)), kind)
        alpha[:, 0] = 1
        for e in range(1, width + 1):
            for n, ids in lat:
                if n <= e:
                    own = ids[:, e - n]
                    if n == 1:
                        alpha[:, e] += alpha[:, e - 1] * np.maximum(self.probs[own], FLOOR)
                    elif len(hit := np.flatnonzero(own != self.table.n)):
                        alpha[hit, e] += alpha[hit, e - n] * self.probs[own[hit]]
        return alpha

    def fit(self, counts: list[Counter], rounds: int = 5, smooth: float = 0.05) -> "LanguageModel":
        """Expected piece counts over all segmentations, ``rounds`` times."""
        for j, count in enumerate(counts):
            words = sorted(w for w in count if w and len(w) <= TAUGHT)
            weight = np.array([count[w] for w in words], np.float64)
            parts = list(batches_of([MARK + w for w in words]))
            one = LanguageModel([self.langs[j]], [])
            one.table = self.table
            p = self.probs[:, j : j + 1].copy()
            for _ in range(rounds):
                one.probs = p
                got = np.zeros(self.table.n + 1)
                for at, own in parts:
                    w = weight[at]
                    lat, lens = one.lattice(own)
                    kind = np.float64 if lens.max() <= 30 else np.longdouble  # 600 letters at the floor: 1e-4800
                    alpha = one.forward(lat, lens, kind)[:, :, 0]
                    beta = np.zeros_like(alpha)
                    beta[np.arange(len(own)), lens] = 1
                    total = alpha[np.arange(len(own)), lens]
                    for s in range(alpha.shape[1] - 2, -1, -1):
                        for n, ids in lat:
                            if s + n < alpha.shape[1]:
                                hit = np.flatnonzero(ids[:, s] != self.table.n) if n > 1 else np.arange(len(own))
                                q = p[ids[hit, s], 0]
                                q = np.maximum(q, FLOOR) if n == 1 else q
                                flow = q * beta[hit, s + n]
                                beta[hit, s] += flow
                                np.add.at(got, ids[hit, s], (w[hit] * alpha[hit, s] * flow / total[hit]).astype(np.float64))
                got = got[:-1] + smooth
                p = np.append(got / got.sum(), 0)[:, None]
            self.probs[:, j] = p[:, 0]
        return self


def batches_of(words: list[str]):
    """(places, words) by ascending length: few lengths and ``CELLS`` letters or one word at a time."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    for b in range(1, len(order) + 1):
        if b == len(order) or (b + 1 - a) * len(words[order[b]]) > CELLS or len(words[order[b]]) > 30 >= len(words[order[a]]):
            yield order[a:b], [words[i] for i in order[a:b]]
            a = b


def train(rows: DataFrame, sample: int = SAMPLE, pieces: list[str] | None = None, most: int = LANGS) -> LanguageModel:
    """Fit on a bounded sample of ``rows`` (doc_id, text, lang): ids are chosen first, their texts joined."""
    known = rows.filter("lang is not null and text is not null and doc_id is not null")
    langs = [r["lang"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()]
    ids = bounded(known.filter(F.col("lang").isin(langs)).select("doc_id", "lang"), "lang", sample)  # 2 * most * sample ids at most: may be broadcast
    own = known.select("doc_id", "lang", "text").join(F.broadcast(ids.distinct()), ["doc_id", "lang"])
    counts: dict[str, Counter] = {}
    for row in own.toLocalIterator():
        counts.setdefault(row["lang"], Counter()).update(letters_of(row["text"]))
    langs = sorted(counts)
    return LanguageModel(langs, pieces or vocabulary_pieces()).fit([counts[x] for x in langs])


def identified(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.probs))  # pieces x languages numbers
    key = uuid.uuid4().hex  # the workers' stores outlive a job

    def run(texts: list[str]) -> dict:
        langs, table, probs = sent.value
        own = LanguageModel(langs, [])
        own.table, own.probs = table, probs
        store = held(key, lambda: WordScores(own.word_values, len(langs)))
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        for a, b in text_chunks(texts) if langs else ():
            words = [letters_of(t) for t in texts[a:b]]
            at = store.look([w for x in words for w in x])
            sums = by_document(store.rows[at], [len(x) for x in words])
            post = np.exp(sums - sums.max(axis=1, keepdims=True))
            post /= post.sum(axis=1, keepdims=True)
            for i, x in enumerate(words):
                if x:
                    best = int(np.argmax(post[i]))
                    pred[a + i], score[a + i] = langs[best], post[i, best]
        return {"lang_pred": pred, "score": np.clip(score, 0, 1)}

    return over_texts(docs, run, "lang_pred string, score double", *keep)
