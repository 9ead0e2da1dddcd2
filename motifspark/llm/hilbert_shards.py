"""Sharding along a Hilbert curve, with DataFrame functions only.

Four metadata dimensions (log2 of the size, language, source, place of the doc_id between
the least and the greatest) are quantised to 4 bits each. Rows are ordered by their index on
the Hilbert curve through the 16^4 cells, then by hashes of the text and of the row; 24 runs
of that order are the shards, so a shard covers few cells and its files' statistics prune on
every dimension. The law is ``rows``: counts of shards are at most one apart.

Equal texts are a group. A group takes the cell of its row of least doc_id and lies together
in the order, so that it shares a shard but where a run ends within it; a group of more rows than a
shard holds must lie in several. Which rows are a group's is counted before anything is
joined, and the join is salted, so that a text with a third of all rows is many tasks' work.

The global rank comes from one range shuffle of slim rows on the whole order: each task
numbers its rows, and the tasks' counts, a row a task, place them.

Defined cases: a null text has size 8 and checksum 0, as the empty one has. Null language or source are cells of their own; a null doc_id has place 0. Rows
repeating a doc_id, and equal rows, each have a slot. Texts of any length are read whole.
Empty tables give no rows; with fewer rows than shards some shards are empty. Extra columns,
whatever their names, are ignored by ``sharded`` and kept by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, parts, written

DIMS, BITS, SALT = 4, 4, 8


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _entry(w: int) -> int:
    return 0 if w == 0 else _gray(2 * ((w - 1) // 2))


def _ones(i: int) -> int:
    n = 0
    while i & 1:
        i, n = i >> 1, n + 1
    return n


def _direction(w: int, dims: int) -> int:
    return 0 if w == 0 else _ones(w - 1) % dims if w % 2 == 0 else _ones(w) % dims


def curve(cells: list[Column], bits: int = BITS) -> Column:
    """The Hilbert index of quantised coordinates (0 .. 2^bits - 1 each).

    From the highest bit plane down, the coordinates' bits name a corner of the current
    cube; its rank in the cube's Gray-code walk is the next digit, and the walk's entry
    corner and direction in the chosen corner carry to the next plane.
    """
    n = len(cells)
    full = (1 << n) - 1
    rank = F.array(*(F.lit(next(i for i in range(1 << n) if _gray(i) == g)) for g in range(1 << n)))
    entry = F.array(*(F.lit(_entry(w)) for w in range(1 << n)))
    turn = F.array(*(F.lit(_direction(w, n)) for w in range(1 << n)))

    def shl(x: Column, k: Column) -> Column:
        return F.call_function("shiftleft", x, k)

    def shr(x: Column, k: Column) -> Column:
        return F.call_function("shiftright", x, k)

    def rotl(x: Column, k: Column) -> Column:
        return shl(x, k).bitwiseOR(shr(x, n - k)).bitwiseAND(F.lit(full))

    def plane(acc: Column, level: Column) -> Column:
        corner = F.lit(0)
        for j, c in enumerate(cells):
            corner = corner.bitwiseOR(shl(shr(c, level).bitwiseAND(F.lit(1)), F.lit(j)))
        x = corner.bitwiseXOR(acc["e"])
        k = F.pmod(acc["d"] + 1, F.lit(n))
        back = rotl(x, F.pmod(n - k, F.lit(n)))
        w = F.element_at(rank, back + 1)
        return F.transform(F.array(w), lambda w: F.struct(
            (acc["h"] * (1 << n) + w).alias("h"),
            acc["e"].bitwiseXOR(rotl(F.element_at(entry, w + 1), k)).alias("e"),
            F.pmod(acc["d"] + F.element_at(turn, w + 1) + 1, F.lit(n)).alias("d")))[0]

    start = F.struct(F.lit(0).alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, plane, lambda acc: acc["h"])


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, lang, source, hash (of the text): the slim rows that all else works on."""
    text = F.coalesce("text", F.lit(""))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("hash"))


def grouped(rows: DataFrame) -> DataFrame:
    """With ``of``: doc_id, lang and source of the row that places each row; of equal texts that of least doc_id."""
    key = ["hash", "size", "text_crc32"]
    first = F.min(F.struct("doc_id", "lang", "source")).alias("first")
    many = rows.groupBy(*key).agg(F.count("*").alias("n"), first).filter("n > 1")  # partial sums before the shuffle
    many = many.select(*key, "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id", "source", "number"), F.lit(SALT)).cast("int")
    own = rows.withColumn("salt", salt).join(many, [*key, "salt"], "left")
    return own.select(*rows.columns, F.coalesce("first", F.struct("doc_id", "lang", "source")).alias("of"))


def cells(rows: DataFrame) -> DataFrame:
    """With ``cell`` for ``of``: the Hilbert index of each slim row."""
    top = (1 << BITS) - 1
    ends = rows.agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
    log = F.least(F.lit(top), F.greatest(F.lit(0), F.floor(F.log2("size")) - 3)).cast("int")
    # As doubles: the difference of two longs may not be one.
    place = (F.col("of.doc_id").cast("double") - F.col("_lo")) / (F.col("_hi").cast("double") - F.col("_lo") + 1.0)
    place = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(top), F.floor(place * (top + 1)))).cast("int"), F.lit(0))
    kind = lambda c: F.pmod(F.xxhash64(c), F.lit(top + 1)).cast("int")
    dims = grouped(rows).crossJoin(F.broadcast(ends))  # one row: the least and greatest id
    dims = dims.select(*rows.columns, log.alias("_a"), kind("of.lang").alias("_b"), kind("of.source").alias("_c"), place.alias("_d"))
    return dims.withColumn("cell", curve([F.col(c) for c in ("_a", "_b", "_c", "_d")])).select(*rows.columns, "cell")


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and cell (the curve index)."""
    rows = written(described(docs).withColumn("number", F.monotonically_increasing_id()), "hilbert-rows")
    placed = cells(rows).withColumn("mixed", F.xxhash64(F.lit(17), "doc_id", "lang", "source"))
    order = ["cell", "hash", "size", "mixed", "doc_id", "number"]  # the row's number parts equal rows only
    dealt = placed.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    # A task's rows are numbered as they come: the task's number above 33 bits, the row's below.
    dealt = dealt.select("doc_id", "size", "text_crc32", "cell", F.monotonically_increasing_id().alias("at"))
    dealt = written(dealt.select("*", F.shiftright("at", 33).alias("task")).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))), "hilbert-order")
    count = dealt.groupBy("task").agg(F.count("*").alias("n"))  # one row a task
    upto = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    start = count.select("task", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total"))
    ranked = dealt.join(start, "task").withColumn("rank", F.col("start") + F.col("at"))
    # Shard s holds the ranks with floor(rank * shards / total) = s, from ceil(s * total / shards) on.
    ranked = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "cell")


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """The documents themselves, a folder for each shard, sorted along the curve within its files.

    Rows that repeat a doc_id and text share a shard. Where the documents have a column
    ``shard`` of their own, the folders' column is named ``shard_``.
    """
    doc, crc, mine, shard, slot = fresh(docs, "_id", "_crc", "_k", "shard", "slot")
    keys = sharded(docs, shards).groupBy(F.col("doc_id").alias(doc), F.col("text_crc32").alias(crc)).agg(F.min(F.struct("shard", "slot")).alias(slot))
    keys = keys.select(doc, crc, F.col(f"{slot}.shard").alias(shard), F.col(f"{slot}.slot").alias(slot))
    own = docs.withColumn(mine, F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    both = own.join(keys, own["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(crc)))
    dealt = both.repartitionByRange(max(shards, parts(docs.sparkSession)), shard, slot).sortWithinPartitions(shard, slot)
    dealt.drop(doc, crc, mine, slot).write.partitionBy(shard).parquet(path)
