"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one Arrow batch; with whole texts in the rows this bounds a worker's memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary one is made and set, on a local master only:
    elsewhere the executors could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="motifspark-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier call returned; removed at exit."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and with it whoever needed the files
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_crc(col: str = "doc_id") -> Column:
    """Unsigned crc32 of an id's decimal digits: what held-out folds are cut by."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def bounded(df: DataFrame, by: str, rows_each: int, key: str = "doc_id") -> DataFrame:
    """About ``rows_each`` rows of each value of ``by``, those of least hash of ``key``; twice as many over all values at most.

    Only to fit a classifier. ``by`` has few values (classes, a bounded list of languages): their counts,
    a row a value, come to the driver and set what part of the hashes is taken. Where a key repeats so
    often that this is too many rows, those of least hash stay.
    """
    draw, most = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 40)), 1 << 40
    counts = df.groupBy(by).agg(F.count("*").alias("n")).collect()
    keep = F.lit(False)
    for value, n in counts:
        keep = keep | (F.col(by).eqNullSafe(F.lit(value)) & (draw < int(most * min(1.0, rows_each / n))))
    return df.filter(keep).orderBy(draw, key).limit(2 * rows_each * max(1, len(counts)))


def released() -> None:
    """Give freed memory back to the system: a driver that has fitted a model else keeps the room its sample took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_held: dict = {}


def held(key, make):
    """A worker's store of what it has worked out, made once for ``key``; workers outlive a job, and hold one store at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def array_of(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values.tolist() if isinstance(values, np.ndarray) and values.dtype == object else values, kind)


def over_texts(docs: DataFrame, run, adds: str, *keep: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key`` as a long, the columns ``keep``, and the columns ``adds`` (DDL) that ``run`` makes of the texts.

    ``run`` takes a list of texts (null: empty) and returns a dict of columns, one value a
    text; or a pair (places, dict), where value i belongs to the text at places[i]. Ids and kept columns
    stay in Arrow and come back as they are, nulls and 64-bit values too.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(key).cast("long").alias(key), *keep, F.col(column).cast("string").alias(fresh(docs, "_text")[0]))
    added = T.StructType.fromDDL(adds)
    schema = T.StructType([*own.schema.fields[:-1], *added.fields])
    kinds = {f.name: to_arrow_type(f.dataType) for f in added.fields}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = run([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            rest = batch.columns[:-1]
            if isinstance(got, tuple):
                places, got = got
                rest = [c.take(pa.array(places, pa.int64())) for c in rest]
            yield pa.RecordBatch.from_arrays([*rest, *(array_of(got[n], k) for n, k in kinds.items())], names=schema.names)

    return own.mapInArrow(each, schema)


def kept_texts(docs: DataFrame, good, column: str = "text") -> DataFrame:
    """The rows, in all their columns, whose texts ``good`` (a list of texts to a list of booleans) accepts."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = good([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(np.asarray(ok, bool)))

    return docs.mapInArrow(each, docs.schema)


M = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * M
        return x ^ (x >> np.uint64(29))


def grid(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as a padded matrix, and the words' lengths (``width`` at most)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.zeros((len(words), width), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[np.arange(width) < lens[:, None]] = flat
    return codes, lens


def spans(codes: np.ndarray, longest: int):
    """For n = 1..longest: the hashes of all n-grams, by start position."""
    with np.errstate(over="ignore"):
        h = np.zeros_like(codes)
        for n in range(1, longest + 1):
            if n > codes.shape[1]:
                return
            h = h[:, : codes.shape[1] - n + 1] * M2 + codes[:, n - 1 :] + np.uint64(1)
            yield n, mix(h + np.uint64(n))


def text_chunks(texts: list[str], most: int = 2_000_000):
    """Ranges of texts of about ``most`` characters together, each text whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


class WordScores:
    """Values of distinct words, worked out together and kept for the words that come again.

    ``values(words)`` returns an array of one row a word. The store is emptied when it holds
    ``most`` words; that changes time, never results.
    """

    def __init__(self, values, columns: int, most: int = 600_000):
        self.values, self.most, self.columns = values, most, columns
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1024, columns), np.float64)

    def look(self, words: list[str]) -> np.ndarray:
        """Row numbers in ``rows``, which stay good until the next call."""
        if len(self.ids) > self.most:
            self.ids.clear()
        ids = self.ids
        new = [w for w in set(words) if w not in ids]
        if new:
            at = len(ids)
            need = at + len(new)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(need - len(self.rows), len(self.rows)), self.columns))])
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                self.rows[at + i : at + i + len(part)] = self.values(part)
            ids.update(zip(new, range(at, need)))
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def by_document(values: np.ndarray, lens: list[int]) -> np.ndarray:
    """Sums of consecutive runs of rows."""
    ends = np.cumsum(np.asarray(lens, np.int64))
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return total[ends] - total[ends - np.asarray(lens, np.int64)]
