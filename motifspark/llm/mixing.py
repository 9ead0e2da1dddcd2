"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in the order of (bucket of a doc_id hash, doc_id), are one stream
of words, packed into blocks of ``BLOCK`` words (the last block of a source has what is left).
A source's target becomes a number of slots, the draws of blocks that make it up. Every slot
draws an output shard, so a source's counts in the shards are multinomial; the counts then
deal out the source's slots: shard 0 holds the first, shard 1 the next, and so on. Slot k
stands for block p(k mod n) of the n blocks, where p is a pseudorandom permutation of the
source's indices for each pass over them (swap-or-not rounds, which need no table and no sort);
blocks join the documents they overlap by index. Of a source's last slot only the words that
the target still lacks are taken, so a target is met to the word.

The prefix sums that place documents in a stream are two-level (bucket totals, then within a
bucket); there are as many buckets as a bucket has rows, the square root of all, so both levels
stay small and a source that holds most rows is spread over many tasks.

Defined cases: a null text has size 0; a null source is a source of its own, last in order.
Documents of size 0 are taken 0 times, and a source without words has target 0. Texts of any
length are counted and packed whole. Rows repeating a doc_id are separate documents; equal
rows (doc_id, text and source) share what is taken of them evenly. A null doc_id sorts first.
Ties of doc_id are broken by size, then by a hash. Empty tables give no rows. Extra columns,
whatever their names, are kept by ``mixed`` and ignored by ``drawn_words``. ``seed`` and the
rows fix the result: reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, parts, written

#: Spaces as the contracts count them.
WORDS = r"[^\x20\x09-\x0D]+"
BLOCK, ROUNDS, SHARDS = 256, 12, 16


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of each source in ``sizes`` (columns source, size).

    Sources by code point, null last, take the weights in turn and share ``share`` times all
    words; a target stops at ``most`` times its source's size and the excess goes to the rest
    by weight. With sources sorted by cap over weight, the capped ones are a prefix: the level
    (target over weight) of the others follows from running sums, with no iteration.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.expr("encode(source, 'utf-8')").asc_nulls_last())  # one row a source
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    each = each.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("w"), "source")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    z = F.lit(0.0)
    each = each.withColumn("level", (
        F.sum("source_size").over(whole) * float(share) - F.coalesce(F.sum("cap").over(upto), z)
    ) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), z)))
    # The level of the first source that stays below its cap holds for all.
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)["level"]
    goal = F.coalesce(F.least(F.col("cap"), level * F.col("w")), F.col("cap"))
    return each.select("source", F.col("source_size").cast("long").alias("source_size"), goal.cast("double").alias("target"))


def _swap(x: Column, r: Column, n: Column, *key: Column) -> Column:
    """One swap-or-not round: x or its partner, as a hash of the pair says. It is its own inverse."""
    other = F.pmod(F.xxhash64(r, n, *key), n) - x
    other = F.when(other < 0, other + n).otherwise(other)
    swap = F.xxhash64(F.greatest(x, other), r, *key).bitwiseAND(F.lit(1).cast("long")) == 1
    return F.when(swap, other).otherwise(x)


def permuted(k: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1 sends k: swap-or-not rounds keyed by ``key``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k.cast("long"), lambda x, r: _swap(x, r, n, *key))


def place_of(block: Column, n: Column, *key: Column) -> Column:
    """Which k the permutation sends to ``block``: the rounds backwards."""
    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)), block.cast("long"), lambda x, r: _swap(x, r, n, *key))


def _key(seed: int) -> Column:
    return F.coalesce(F.xxhash64(F.lit(seed), "source"), F.lit(0).cast("long"))


def sources_plan(sizes: DataFrame, block: int = BLOCK, seed: int = 0, **kw) -> DataFrame:
    """A row for each source: source_size, target, blocks, slots, and cut (words of the last slot that are not taken)."""
    plan = targets(sizes, **kw)
    plan = plan.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("want", F.round("target").cast("long"))
    plan = plan.withColumn("whole", F.expr("if(source_size > 0, want div source_size, 0L)")).withColumn("rest", F.col("want") - F.col("whole") * F.col("source_size"))
    # The last pass draws full blocks but for the source's last one, which lacks ``lack`` words and has its place in the pass.
    plan = plan.withColumn("lack", F.col("blocks") * block - F.col("source_size"))
    plan = plan.withColumn("at", F.when(F.col("blocks") > 0, place_of(F.col("blocks") - 1, F.col("blocks"), _key(seed), F.col("whole"))))
    full = F.expr(f"(rest + {block - 1}) div {block}")
    m = F.when(full <= F.col("at"), full).otherwise(F.expr(f"(rest + lack + {block - 1}) div {block}"))
    plan = plan.withColumn("m", F.when(F.col("rest") > 0, m).otherwise(F.lit(0)).cast("long"))
    words = F.col("m") * block - F.when(F.col("m") > F.col("at"), F.col("lack")).otherwise(F.lit(0))
    cut = F.when(F.col("m") > 0, words - F.col("rest")).otherwise(F.lit(0)).cast("long")
    return plan.select("source", "source_size", "target", "blocks", (F.col("whole") * F.col("blocks") + F.col("m")).alias("slots"), cut.alias("cut"))


def _exploded(rows: DataFrame, first: Column, last: Column, name: str, chunk: int = 4096) -> DataFrame:
    """``rows`` with ``name`` from ``first`` to ``last``: two explodes, so that no row ever holds more than a chunk's indices."""
    low, high, part = fresh(rows, "_low", "_high", "_part")
    starts = rows.withColumn(low, first).withColumn(high, last).filter(F.col(low) <= F.col(high))
    starts = starts.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({high} - {low}) div {chunk}"))))
    starts = starts.repartition(parts(rows.sparkSession), *rows.columns, part)
    begin = F.col(low) + F.col(part) * chunk
    return starts.withColumn(name, F.explode(F.sequence(begin, F.least(F.col(high), begin + chunk - 1)))).drop(low, high, part)


def counts(plan: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """source, shard, n, first: the multinomial counts of each source's slots in the shards, and the first slot of each."""
    each = _exploded(plan.select("source", "slots"), F.lit(0).cast("long"), F.col("slots") - 1, "slot")
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "slot"), F.lit(shards)).cast("int")
    drawn = each.groupBy("source", shard.alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(plan: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """shard, source, slot, block, epoch, cut: every draw of the mix, dealt to the shards by their counts."""
    of = plan.select(F.col("source").alias("_s"), "blocks", "slots", "cut")
    drawn = counts(plan, shards, seed).join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    each = _exploded(drawn, F.col("first"), F.col("first") + F.col("n") - 1, "slot")
    epoch = F.expr("slot div blocks")
    block = permuted(F.pmod("slot", "blocks"), F.col("blocks"), _key(seed), epoch)
    cut = F.when(F.col("slot") == F.col("slots") - 1, F.col("cut")).otherwise(F.lit(0))
    return each.select("shard", "source", "slot", block.alias("block"), epoch.alias("epoch"), cut.cast("long").alias("cut"))


def positions(sizes: DataFrame) -> DataFrame:
    """``sizes`` (row, doc_id, source, size) with ``at``: the words of the source before the document."""
    buckets = 1 + math.isqrt(sizes.count())
    bucket = F.pmod(F.xxhash64("doc_id", "row"), F.lit(buckets))
    docs = sizes.withColumn("bucket", bucket)
    totals = docs.groupBy("source", "bucket").agg(F.sum("size").alias("t"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.join(offsets, docs["source"].eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b"))).select(
        *sizes.columns, (F.col("offset") + F.col("inside")).alias("at"))


def overlaps(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, doc_id, source, size, block, first (word of the document, from 0), begin (word of the block), n: words of each block in each document."""
    docs = positions(docs).filter("size > 0")
    end = F.col("at") + F.col("size")
    each = docs.select("*", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * block)
    return each.select("row", "doc_id", "source", "size", "block", (start - F.col("at")).alias("first"), (start - F.col("block") * block).alias("begin"),
                       (F.least(end, (F.col("block") + 1) * block) - start).alias("n"))


def _sizes(docs: DataFrame) -> DataFrame:
    row = F.xxhash64("text", "source")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), row.alias("row"), n_words(F.col("text")).alias("size")), "mix-sizes")


def draws(sizes: DataFrame, plan: DataFrame, shards: int = SHARDS, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mix, a row for each slot and document it overlaps: shard, slot, epoch, row, doc_id, source, size, first, n (words taken)."""
    # Of the last slot, cut words at the end of the block are not taken; blocks are full but for the source's last one.
    last = plan.select(F.col("source").alias("_s"), F.least(F.lit(block), F.col("source_size") - (F.col("blocks") - 1) * block).alias("short"), "blocks")
    drawn = slots(plan, shards, seed).join(last, F.col("source").eqNullSafe(F.col("_s")))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(F.lit(block)) - F.col("cut")
    drawn = drawn.select("shard", "slot", "epoch", F.col("source").alias("_s"), F.col("block").alias("_b"), length.alias("_length"))
    own = overlaps(sizes, block)
    # The planner sees a few sources and no explode: without the hint it would broadcast all slots.
    both = own.join(drawn.hint("merge"), own["source"].eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    taken = F.least(F.col("n"), F.col("_length") - F.col("begin"))
    return both.withColumn("n", taken).filter("n > 0").select("shard", "slot", "epoch", "row", "doc_id", "source", "size", "first", "n")


def drawn_words(docs: DataFrame, seed: int = 0, shards: int = SHARDS, **kw) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document, and shards: how many output shards hold words of it."""
    sizes = _sizes(docs)
    plan = written(sources_plan(sizes, seed=seed, **kw), "mix-plan")
    key = ["row", "doc_id", "source", "size"]
    # A document's parts are first summed for each shard; equal rows (all four columns) then share their sum evenly.
    each = draws(sizes, plan, shards, seed).groupBy(*key, "shard").agg(F.sum("n").alias("w"))
    each = each.select(*key, "w", F.lit(1).alias("s"), F.lit(0).alias("c"))
    empty = sizes.select(*key, F.lit(0).cast("long").alias("w"), F.lit(0).alias("s"), F.lit(1).alias("c"))
    sums = each.unionByName(empty).groupBy(*key).agg(F.sum("w").alias("w"), F.sum("s").alias("shards"), F.sum("c").alias("c"))
    one = sums.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("i"))
    taken = F.expr("w div c") + F.when(F.col("i") < F.expr("w % c"), 1).otherwise(0)
    p = plan.select(F.col("source").alias("_s"), "source_size", "target")
    return one.join(p, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("shards").cast("int").alias("shards"))


def mixed(docs: DataFrame, seed: int = 0, **kw) -> DataFrame:
    """The mix as documents: a row for each document and pass over its source in which words of it are taken.

    A document taken whole keeps its text; of one taken in part, the words taken stay, in
    their order, joined by spaces. ``n_chars``, where there is one, is that of the new text.
    What is taken is decided on sizes and ids; texts meet the decision in one join.
    """
    sizes = _sizes(docs)
    plan = written(sources_plan(sizes, seed=seed, **kw), "mix-plan")
    key = ["row", "doc_id", "source", "size"]
    got = draws(sizes, plan, seed=seed).groupBy(*key, "epoch").agg(F.array_sort(F.collect_set(F.struct("first", "n"))).alias("runs"), F.least(F.sum("n"), F.col("size")).alias("taken"))
    mine, row, doc, epoch, runs, whole, new = fresh(docs, "_key", "_row", "_id", "epoch", "runs", "whole", "_text")
    some = F.when(F.col("taken") < F.col("size"), F.col("runs"))  # whole documents, the most, need no runs
    got = written(got.select(F.col("row").alias(row), F.col("doc_id").alias(doc), F.col("epoch").alias(epoch), some.alias(runs), (F.col("taken") == F.col("size")).alias(whole)), "mix-taken")
    full = docs.withColumn(mine, F.xxhash64("text", "source"))
    both = full.join(got, full["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(row)))
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    # The words are bound once a row: named inside the inner lambda they would be cut out anew for every run.
    some = F.transform(F.array(words), lambda ws: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(ws, (r["first"] + 1).cast("int"), r["n"].cast("int")))), " "))[0]
    text = F.when(F.col(whole), F.col("text")).otherwise(some)
    both = both.withColumn(new, text)
    out = {"text": F.col(new)} | ({"n_chars": F.length(new).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))
