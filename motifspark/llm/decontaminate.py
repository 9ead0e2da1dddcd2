"""Benchmark decontamination by spaced-seed hashing.

The words of documents and benchmark are compared along diagonals that seeds find. In an item
of over ``WHOLE`` words the best segment of a diagonal (1 for an equal word, -4 for another, so
at least 80 % of its words are equal) counts as an overlap if it holds ``LEAST`` equal words. A
shorter item counts if 80 % of its words are equal on one diagonal, wherever the others lie; the
overlap is the best segment if that holds as many, else the words from the first equal one to
the last.

The seeds miss nothing that counts. A best segment starts with five equal words at least, and
with nine in its first ten at least, the tenth being any of the last five; so five masks over
windows of 10 words, each ignoring one of the last five, find it. A short item has masks over
its whole length: its positions fall into residue classes, one for each word that may differ and
two more, and a mask keeps two of the classes. ``GAP`` empty words around each document let an
item run over its edge.

The benchmark is sent to the tasks in slices of at most ``SLICE`` words, made by running sums
of the items' words and counted again before they are sent: a larger benchmark is more slices
and as many passes, never a larger broadcast. An item of more words is cut into pieces that
overlap by ``LAP`` words, and found piece by piece. With more than one slice, each pass is
written before the next slice is made, so that the driver holds one at a time.

Defined cases: words are runs of letters and digits, lower-cased. Items of fewer than
``SHORT`` words match documents of the same words and no others; items without words match
nothing. Null or empty texts match nothing; empty tables give no rows. Texts of any length
are searched whole. Items that repeat are found each; of overlaps with as many equal words the
first found stands. Rows repeating a doc_id are answered each; a null doc_id is carried along. Extra columns are carried
as they are where asked for, and by ``clean``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import M, kept_texts, mix, over_texts, text_chunks, written

WORD = re.compile(r"[^\W_]+")
SPAN, SHORT, LEAST, SHARE = 10, 5, 13, 0.8
WHOLE, GAP = 16, 3  # 80 % of WHOLE words are LEAST at most; GAP of them may differ
SLICE, LAP, HITS = 1_000_000, 10_000, 200_000
FACTORS = mix(np.arange(1, WHOLE + 1, dtype=np.uint64) * M) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def least_equal(n: int) -> int:
    """The equal words that an overlap with an item of n words holds."""
    return min(LEAST, int(-(-n * SHARE // 1)))


def seed_hashes(h: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each mask's number and its windows' hashes, by the window's start.

    ``length`` is that of a short item, or 0 for the masks of the long ones.
    """
    span = length or SPAN
    n = len(h) - span + 1
    if n <= 0:
        return
    with np.errstate(over="ignore"):
        if not length:
            total = np.full(n, np.uint64(0))
            for o in range(SPAN):
                total += FACTORS[o] * h[o : o + n]
            for o in range(SPAN // 2, SPAN):
                yield o, mix(total - FACTORS[o] * h[o : o + n] + FACTORS[o])
            return
        kinds = length - least_equal(length) + 2
        sums = np.zeros((kinds, n), np.uint64)
        for o in range(length):
            sums[o % kinds] += FACTORS[o] * h[o : o + n]
        for k, (a, b) in enumerate(combinations(range(kinds), 2)):
            yield k, mix(sums[a] + sums[b] + np.uint64(1000 * length + k))


class SeedIndex:
    """A slice of the benchmark: for each length of short items, and 0 for the long ones, sorted window hashes, and the items' words."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        """``items``: ids and words; entries of one id that are pieces of an item are found apart."""
        self.ids, self.words = [], []
        self.exact: dict[bytes, list[int]] = {}
        by: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, own in items:
            h = word_hashes(own)
            if not len(h):
                continue
            me = len(self.ids)
            self.ids.append(item)
            self.words.append(h)
            if len(h) < SHORT:
                self.exact.setdefault(h.tobytes(), []).append(me)
            else:
                by.setdefault(len(h) if len(h) <= WHOLE else 0, []).append((h, me))
        self.groups = {}
        for length, own in sorted(by.items()):
            keys, where, at = [], [], []
            for h, me in own:
                for _, k in seed_hashes(h, length):
                    keys.append(k)
                    where.append(np.full(len(k), me))
                    at.append(np.arange(len(k)))
            keys, where, at = np.concatenate(keys), np.concatenate(where), np.concatenate(at)
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << max(16, (16 * len(keys)).bit_length()), bool)
            shift = np.uint64(64 - (len(bits).bit_length() - 1))
            bits[keys >> shift] = True
            self.groups[length] = keys[order], where[order], at[order], bits, shift

    def find(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start of the window in h, start of the item, item) of the hits of the concatenated words h, some at a time."""
        for length, (keys, where, at, bits, shift) in self.groups.items():
            for _, k in seed_hashes(h, length):
                maybe = np.flatnonzero(bits[k >> shift])
                a = np.searchsorted(keys, k[maybe], "left")
                n = np.searchsorted(keys, k[maybe], "right") - a
                maybe, a, n = maybe[n > 0], a[n > 0], n[n > 0]
                part = (np.cumsum(n) - n) // HITS
                for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
                    m = n[cut]
                    starts = np.repeat(maybe[cut], m)
                    rows = np.repeat(a[cut] - np.cumsum(m) + m, m) + np.arange(m.sum())
                    items = where[rows]
                    if length and len(items):
                        known, own = np.unique(items, return_inverse=True)
                        ref = np.stack([self.words[i] for i in known])
                        equal = sum((h[starts + o] == ref[own, o]).astype(np.int64) for o in range(length))
                        good = equal >= least_equal(length)
                        starts, rows, items = starts[good], rows[good], items[good]
                    if len(items):
                        yield starts, starts - at[rows], items


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the segment of highest sum of 1 and -4."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(equal[start:end].sum())


def overlaps_of(index: SeedIndex, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start word, words, equal words): the best verified overlap of each text and item."""
    words = [word_hashes(words_of(t)) for t in texts]
    lens = np.array([len(w) for w in words], np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, w in enumerate(words):
        if 0 < len(w) < SHORT:
            best |= {(d, i): (0, len(w), len(w)) for i in index.exact.get(w.tobytes(), ())}
    gap = np.zeros(GAP, np.uint64)
    flat = np.concatenate([*(x for w in words for x in (gap, w)), gap, np.zeros(WHOLE, np.uint64)])
    ends = np.cumsum(lens + GAP)
    found = [np.zeros((0, 3), np.int64)]
    for starts, begins, items in index.find(flat):
        doc = np.searchsorted(ends, starts, "right")  # the gap before a document is its own
        own = doc < len(words)
        doc = doc[own]
        found.append(np.unique(np.stack([doc, items[own], begins[own] - ends[doc] + lens[doc]], axis=1), axis=0))
    for d, i, o in np.unique(np.concatenate(found), axis=0).tolist():
        own, ref = words[d], index.words[i]
        a, b = max(0, o), min(len(own), o + len(ref))
        if b <= a:
            continue
        equal = own[a:b] == ref[a - o : b - o]
        s, e, n = best_segment(equal)
        least = least_equal(len(ref))
        if n < least and len(ref) <= WHOLE and equal.sum() >= least:
            at = np.flatnonzero(equal)
            s, e, n = int(at[0]), int(at[-1]) + 1, len(at)
        if n >= least and n > best.get((d, i), (0, 0, 0))[2]:
            best[d, i] = (a + s, e - s, n)
    return [(d, index.ids[i], *v) for (d, i), v in best.items()]


def slices(benchmark: DataFrame, words_each: int = SLICE) -> Iterator[SeedIndex]:
    """The benchmark's indexes, one at a time, of at most ``words_each`` words each (an item is cut where it has more)."""
    n = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).cast("long")  # at least as many as words_of finds, but for odd marks
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    small = bench.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] <= words_each  # a word takes a character at least
    if not small:
        # Items in the order of a hash, by running sums of their words, in tasks of the hash's high bits.
        part = bench.withColumn("_n", n).withColumn("_h", F.xxhash64("item_id", "text")).withColumn("_p", F.shiftrightunsigned("_h", 54))
        inside = Window.partitionBy("_p").orderBy("_h", "item_id")
        part = written(part.withColumn("_s", F.sum("_n").over(inside)), "bench-order")
        total = part.groupBy("_p").agg(F.sum("_n").alias("t"))  # 1,024 rows at most
        before = F.coalesce(F.sum("t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bench = part.join(total.select("_p", before.alias("_b")), "_p").withColumn("_slice", F.expr(f"(_b + _s) div {max(1, words_each // 2)}"))
        bench = written(bench.select("item_id", "text", "_slice"), "bench-slices")
    numbers = [0] if small else range(bench.agg(F.coalesce(F.max("_slice"), F.lit(0))).first()[0] + 1)
    for s in numbers:
        held, size = [], 0
        for r in (bench if small else bench.filter(F.col("_slice") == s)).toLocalIterator():
            words = words_of(r["text"])
            step = max(1, words_each - LAP) if len(words) > words_each else max(1, len(words))
            for k in range(0, max(1, len(words) - (LAP if len(words) > words_each else 0)), step):
                own = words[k : k + words_each]
                if held and size + len(own) > words_each:
                    yield SeedIndex(held)
                    held, size = [], 0
                held.append((r["item_id"], own))
                size += len(own)
        if held:
            yield SeedIndex(held)


def _found(sent, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    for a, b in text_chunks(texts, 1_000_000):
        yield from ((a + d, *x) for d, *x in overlaps_of(sent.value, texts[a:b]))


def overlaps(docs: DataFrame, benchmark: DataFrame, *keep: str, words_each: int = SLICE) -> DataFrame:
    """doc_id, the columns ``keep``, item_id, start, words, equal: verified overlaps of documents and items.

    A repeated item is found as often as it is there, an item cut into pieces once for each piece found.
    """
    sc = docs.sparkSession.sparkContext
    names = ("item_id", "start", "words", "equal")

    def one(index: SeedIndex) -> DataFrame:
        sent = sc.broadcast(index)

        def run(texts: list[str]) -> tuple[list[int], dict]:
            found = list(_found(sent, texts))
            return [x[0] for x in found], {n: [x[k] for x in found] for k, n in enumerate(names, 1)}

        return over_texts(docs, run, ", ".join(f"{n} long" for n in names), *keep)

    out, last = None, None
    for index in slices(benchmark, words_each):
        if last is not None:  # another slice follows: this one is answered before its index is made known to the tasks
            part = written(one(last), "overlaps")
            out = part if out is None else out.unionByName(part)
        last = index
    part = one(last if last is not None else SeedIndex([]))
    return part if out is None else out.unionByName(part)


def clean(docs: DataFrame, benchmark: DataFrame, words_each: int = SLICE) -> DataFrame:
    """The documents without a verified overlap, in all their columns: each pass drops its own, and nothing is shuffled."""
    out = docs
    last = None
    for index in slices(benchmark, words_each):
        if last is not None:
            out = written(_without(out, last), "clean")
        last = index
    return _without(out, last) if last is not None else out


def _without(docs: DataFrame, index: SeedIndex) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def good(texts: list[str]) -> list[bool]:
        bad = {x[0] for x in _found(sent, texts)}
        return [i not in bad for i in range(len(texts))]

    return kept_texts(docs, good)
