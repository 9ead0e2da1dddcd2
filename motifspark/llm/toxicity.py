"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer, a character trie whose arcs carry weights, rewrites each word to a
symbol: insult, threat, target, negation, reported speech, or other. Four small transducers
(target, negation, reported speech, and the one that accepts insults and threats) are
composed into one machine over those symbols. It reads a text clause by clause and gives
each clause its matches: plain, targeted, negated or reported insult, or threat. A clause
counts once for a kind, by its strongest match. A score is a logistic function of the matched
clauses: a targeted insult or a threat is enough, plain ones must come in more than one
clause, and negated and reported ones are no evidence. A word alone scores nothing.

Fitted on a bounded sample of labelled rows: which words and word beginnings are insults,
with weights from log odds, and the weights of the kinds, held near given ones. A beginning
counts by the distinct contexts it stands in, so that copies of a text are no evidence.

Defined cases: a null or empty text has no match and scores as such (near 0). Without
labels the given words and weights hold, as they do on an empty table, which gives no rows.
A clause ends at a stop, a semicolon or a line end. Texts of any length are read whole. Rows
repeating a doc_id are answered each; a null doc_id is carried along. Matches of equal weight
in a clause count as one. Columns other than doc_id and text are carried as they are where
asked for, whatever their names. The sample: about ``SAMPLE`` labelled rows a class, twice as many in all at most.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordScores, bounded, by_document, held, kept_texts, over_texts, released, text_chunks

SAMPLE = 2000
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;\n\r]")

LEXICON = {
    TARGET: "you your you're u he she they them him her these those this tu toi vous es êtes il elle ils du dich dir ihr sie er bist usted ustedes él ella ellos eres",
    NEGATION: "not no never none n't isn't aren't don't doesn't wasn't nobody ne pas jamais aucun nicht kein keine nie niemals nunca jamás ningún",
    REPORT: "said says say wrote writes claimed quoted quote called reportedly alleged according dit disait écrit selon sagte sagt schrieb laut dijo dice escribió según",
    THREAT: "kill hurt destroy murder stab shoot beat strangle tuer frapper töten schlagen umbringen matar golpear",
    INSULT: "idiot idiots moron morons imbecile stupid loser losers scumbag bastard",
}
KINDS = ("plain", "targeted", "negated", "reported", "threat")
PRIOR = np.array([-4.0, 3.0, 6.0, 0.0, 0.0, 6.0])  # no match; then the kinds
PULL = np.array([0.5, 0.5, 20.0, 1.0, 1.0, 20.0])  # how firmly the given weights hold


class Transducer:
    """Deterministic: (state, symbol) -> (output, next state); what is absent is copied in place."""

    def __init__(self, arcs: dict[tuple[int, object], tuple[object, int]], start: int = 0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (symbol, state))

    def then(self, other: "Transducer", symbols: Iterable) -> "Transducer":
        """The composition, built over all states reached."""
        ids, arcs = {(self.start, other.start): 0}, {}
        todo = [(self.start, other.start)]
        while todo:
            a, b = pair = todo.pop()
            for s in symbols:
                mid, a2 = self.step(a, s)
                out, b2 = other.step(b, mid)
                if (a2, b2) not in ids:
                    ids[a2, b2] = len(ids)
                    todo.append((a2, b2))
                arcs[ids[pair], s] = (out, ids[a2, b2])
        return Transducer(arcs)


def _mark(symbol, flag: str):
    """A hit with one more flag: hits are (symbol, flags)."""
    return (symbol[0], symbol[1] | {flag})


def grammar(reach: int = 3) -> Transducer:
    """hits . target . negation . report, as one machine over the lexical symbols."""
    symbols = range(7)
    hits = [(s, frozenset(f)) for s in (INSULT, THREAT) for f in ((), ("T",), ("N",), ("T", "N"))]
    accept = Transducer({(0, s): ((s, frozenset()), 0) for s in (INSULT, THREAT)})
    target = {(0, TARGET): (TARGET, 1), (1, END): (END, 0)} | {(1, h): (_mark(h, "T"), 1) for h in hits}
    # Negation reaches over the next words only: state n is n words of reach left.
    negation = {(0, NEGATION): (NEGATION, reach)}
    for n in range(1, reach + 1):
        negation |= {(n, END): (END, 0), (n, NEGATION): (NEGATION, reach)} | {(n, h): (_mark(h, "N"), 0) for h in hits}
        negation |= {(n, s): (s, n - 1) for s in (OTHER, TARGET, REPORT)}
    report = {(0, REPORT): (REPORT, 1), (1, END): (END, 0)} | {(1, h): (_mark(h, "R"), 1) for h in hits}
    machine = accept.then(Transducer(target), symbols)
    machine = machine.then(Transducer(negation), symbols)
    return machine.then(Transducer(report), symbols)


def kind_of(hit: tuple[int, frozenset], after: bool) -> int | None:
    """The kind of a match; ``after``: a target follows it in the clause."""
    symbol, flags = hit
    aimed = after or "T" in flags
    if symbol == THREAT and not aimed:
        return None
    if "N" in flags:
        return 2
    if "R" in flags:
        return 3
    return 4 if symbol == THREAT else 1 if aimed else 0


class Lexicon:
    """A character trie; a node may accept the words that end there, or all longer ones (a beginning)."""

    def __init__(self):
        self.trie: dict = {}
        for symbol, words in LEXICON.items():
            for w in words.split():
                self.add(w, symbol, 1.0, whole=True)

    def add(self, text: str, symbol: int, weight: float, whole: bool) -> None:
        node = self.trie
        for c in text:
            node = node.setdefault(c, {})
        node["end" if whole else "any"] = (symbol, weight)

    def read(self, word: str) -> tuple[int, float]:
        node, found = self.trie, (OTHER, 0.0)
        for c in word:
            if "any" in node:
                found = node["any"]
            node = node.get(c)
            if node is None:
                return found
        return node.get("end") or found

    def values(self, words: list[str]) -> np.ndarray:
        return np.array([(END, 0.0) if w in ".!?;\n\r" else self.read(w) for w in words])


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def contexts(toks: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """For each word, by number, how many different pairs of neighbours it has in the texts; -1 stands beyond a text's ends."""
    toks = [t for t in toks if len(t)]
    own = np.concatenate([np.zeros(0, np.int32), *toks])
    lens = np.array([len(t) for t in toks], np.int64)
    ends = np.cumsum(lens)
    before, after = np.roll(own, 1), np.roll(own, -1)
    before[ends - lens] = after[ends - 1] = -1
    at = np.flatnonzero(wanted[own])
    own, before, after = own[at], before[at], after[at]
    order = np.lexsort((after, before, own))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (own, before, after)], axis=0)
    return np.bincount(own[order[new]], minlength=len(wanted))


class ToxicModel:
    def __init__(self):
        self.lexicon, self.machine, self.weights = Lexicon(), grammar(), PRIOR.copy()

    def matches(self, symbols: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weights of a text's matched clauses by kind: of each clause and kind the strongest match."""
        out = np.zeros(len(KINDS))
        at = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
        if not len(at):
            return out
        ends = np.concatenate([[-1], np.flatnonzero(symbols == END), [len(symbols)]])
        for c in np.unique(np.searchsorted(ends, at)):  # the clauses with a hit
            own = symbols[ends[c - 1] + 1 : ends[c]].astype(int).tolist()
            own_weights = weights[ends[c - 1] + 1 : ends[c]]
            last = max((i for i, s in enumerate(own) if s == TARGET), default=-1)
            state, best = self.machine.start, np.zeros(len(KINDS))
            for i, s in enumerate(own):
                hit, state = self.machine.step(state, s)
                if isinstance(hit, tuple) and (kind := kind_of(hit, i < last)) is not None:
                    best[kind] = max(best[kind], own_weights[i])
            out += best
        return out

    def score(self, found: np.ndarray) -> np.ndarray:
        z = self.weights[0] + np.atleast_2d(found) @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def fit(self, texts: list[str], labels: np.ndarray) -> "ToxicModel":
        ids: dict[str, int] = {}  # a word is kept once, texts as numbers of words: the driver has little room
        toks = [np.fromiter((ids.setdefault(w, len(ids)) for w in tokens_of(t)), np.int32) for t in texts]
        words = list(ids)
        del ids
        self._learn_words(words, toks, np.asarray(labels))
        v = self.lexicon.values(words) if words else np.zeros((0, 2))
        x = np.array([self.matches(v[t, 0], v[t, 1]) for t in toks]).reshape(len(toks), len(KINDS))
        self._learn_kinds(x, labels)
        return self

    def _learn_words(self, words: list[str], toks: list[np.ndarray], labels: np.ndarray, longest: int = 7, proof: float = 16.0) -> None:
        """Insults: words, and beginnings of words, that stand almost only in toxic texts."""
        def beginnings(w: str) -> Iterator[str]:
            yield from (w[:k] for k in range(3, min(len(w) - 1, longest) + 1))
            yield w + "$"

        sides = [[t for t, y in zip(toks, labels) if y == k] for k in (0, 1)]
        mass = [1 + sum(map(len, side)) for side in sides]
        gain = math.log(sum(mass) / mass[1])  # what one context is worth
        times = [np.bincount(np.concatenate([np.zeros(0, np.int32), *side]), minlength=len(words)) for side in sides]

        def summed(counts: np.ndarray, known=None) -> Counter:
            out = Counter()
            for i in np.flatnonzero(counts).tolist():
                if words[i] not in ".!?;\n\r":
                    for b in beginnings(words[i]):
                        if known is None or b in known:
                            out[b] += int(counts[i])
            return out

        # What is common enough in toxic texts; of that, what is not mostly clean: the clean side is counted for no other.
        common = {b: n for b, n in summed(times[1]).items() if n * gain >= proof}
        clean = summed(times[0], common)
        maybe = {b for b, n in common.items() if clean[b] < 20 * n}
        del common, clean
        wanted = np.array([not maybe.isdisjoint(beginnings(w)) for w in words], bool)
        # A context is a word and those beside it, so a beginning has as many as its words have together.
        seen = [summed(contexts(side, wanted), maybe) for side in sides]
        spread = summed(np.minimum(times[1], 1), maybe)  # a beginning's words in toxic texts
        known: set[str] = set()  # beginnings that are in the trie
        for b in sorted(seen[1], key=lambda x: (len(x) - x.endswith("$"), x)):
            whole = b.endswith("$")
            text = b.rstrip("$")
            if any(text[:k] in known for k in range(3, len(text))):
                continue
            bad, good = seen[1][b], seen[0][b]
            if bad * gain < proof or good * 8 > bad:
                continue
            if not whole and spread[b] < 3:
                continue  # a beginning must carry several words
            odds = math.log((bad + 0.5) / mass[1]) - math.log((good + 0.5) / mass[0])
            self.lexicon.add(text, INSULT, min(1.25, max(0.2, (odds - 2) / 4)), whole)
            if not whole:
                known.add(text)

    def _learn_kinds(self, x: np.ndarray, y: np.ndarray, rounds: int = 25) -> None:
        """Logistic regression by Newton steps; ``PULL`` draws the weights to the given ones.

        Negated and reported matches stay without weight: that a labelled text has some does not make them evidence.
        """
        free = np.array([True, *(k not in ("negated", "reported") for k in KINDS)])
        a = np.hstack([np.ones((len(x), 1)), x])
        w = PRIOR.copy()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (p - y) + PULL * (w - PRIOR)
            hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(PULL)
            w[free] -= np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        self.weights = w


def train(rows: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Fit on a bounded sample of ``rows`` (doc_id, text, toxic)."""
    own = rows.filter(F.col("toxic").isin(0, 1) & F.col("text").isNotNull()).select("doc_id", "toxic", "text")
    pdf = bounded(own, "toxic", sample).toPandas().sort_values(["doc_id", "text"])
    model = ToxicModel()
    texts, labels = list(pdf["text"]), pdf["toxic"].to_numpy(np.int64)
    del pdf
    if len(set(labels.tolist())) == 2:
        model.fit(texts, labels)
    del texts
    released()
    return model


def _finder(spark: SparkSession, model: ToxicModel):
    """A function of texts, for the tasks, that gives the matched clauses by kind, a row a text."""
    sent = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex  # the workers' stores outlive a job

    def found_in(texts: list[str]) -> np.ndarray:
        own = sent.value
        store = held(key, lambda: WordScores(own.lexicon.values, 2))
        found = np.zeros((len(texts), len(KINDS)))
        for a, b in text_chunks(texts):
            words = [tokens_of(t) for t in texts[a:b]]
            lens = [len(x) for x in words]
            at = store.look([w for x in words for w in x])  # before rows are taken: it may move them
            v = store.rows[at]
            end = np.cumsum(lens)
            hits = by_document(((v[:, :1] == INSULT) | (v[:, :1] == THREAT)).astype(np.float64), lens)[:, 0]
            for i in np.flatnonzero(hits):
                own_v = v[end[i] - lens[i] : end[i]]
                found[a + i] = own.matches(own_v[:, 0], own_v[:, 1])
        return found

    return found_in, sent


def scored(docs: DataFrame, model: ToxicModel, *keep: str) -> DataFrame:
    """doc_id, the columns ``keep``, score, and the matched clauses of each kind, of every row."""
    found_in, sent = _finder(docs.sparkSession, model)

    def run(texts: list[str]) -> dict:
        found = found_in(texts)
        return {"score": sent.value.score(found)} | {k: found[:, i] for i, k in enumerate(KINDS)}

    return over_texts(docs, run, "score double, " + ", ".join(f"{k} double" for k in KINDS), *keep)


def filtered(docs: DataFrame, model: ToxicModel, reject: float = 0.5) -> DataFrame:
    """The documents that score below ``reject``, in all their columns, in one pass without a shuffle."""
    found_in, sent = _finder(docs.sparkSession, model)
    return kept_texts(docs, lambda texts: sent.value.score(found_in(texts)) < reject)
