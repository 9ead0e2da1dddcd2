"""Token ids as ORC files.

Documents are dealt to files by ranges of (doc_id, hash of the text) and sorted; a file's rows
stream through the tokenizer in that order, so tokenising happens once, after the one shuffle.
Ids are an array<int> column, and ``before`` counts the ids of the file's rows above: ORC
run-length encodes both, indexes each 10,000 rows, and carries a Bloom filter on doc_id. So
readers take stripes in parallel, a row's place needs no more than its file's, and documents
asked for by id (``documents_of``) are found by pruning stripes and row groups.

Byte-level BPE never merges across the tokenizer's pre-tokens, and a space before anything
but white space starts one. So a text without runs of blanks is cut at its spaces, the
distinct pieces are encoded once by the tokenizer and kept, and a document's ids are its
pieces' ids one after another: the ids that encoding the whole text gives, at a fraction of
the time. Cutting, finding distinct pieces, looking them up and laying out the ids are Arrow and
numpy operations on some ``CHUNK`` bytes of texts; Python sees only pieces not met before.
Other texts, and texts that hold a special token's string, are encoded whole; so is
every text where the tokenizer's file does not say that it is of this kind.

Defined cases: a null text is the empty one (the end id alone). Null doc_ids come first. Rows
repeating a doc_id follow each other, by a hash of the text, then by text; ``start`` follows
their order in the file. Texts of any length are encoded whole. Empty tables give no rows.
Extra columns are ignored, whatever their names: doc_id and text alone are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, new_path, parts, small_batches, written

#: What keeps a text from being cut at its spaces: runs of white space, white space other than a
#: blank or a line end, a blank at the end, and what may begin a special token.
ODD = "  | \\n|\\n |\\n\\n|<\\||[\\t\\r\\f\\v\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]| $"
CHUNK, KEPT = 6 << 20, 800_000
#: A piece that is one word and the marks after it: the tokenizer cuts it between the two. Latin letters only,
#: as the classes of others differ between libraries.
SIMPLE = "([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?#$%&*|()-]*)"
ONE, MANY = re.compile(SIMPLE), "^" + SIMPLE.replace("(", "(?P<word>", 1).replace(")(", ")(?P<tail>", 1) + "$"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PACKS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def pack(ids: list[int]) -> bytes:
    return PACKS[len(ids)](*ids) if len(ids) < len(PACKS) else struct.pack(f"<{len(ids)}I", *ids)


def cuts_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer's file says: byte-level BPE, its usual cut into words, no normaliser, special tokens that begin "<|"."""
    model, cut = settings.get("model") or {}, settings.get("pre_tokenizer") or {}
    plain = not any((settings.get("normalizer"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"), model.get("ignore_merges")))
    return (plain and model.get("type") == "BPE" and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
            and all(t["content"].startswith("<|") for t in settings.get("added_tokens") or ()))


class PieceStore:
    """The ids of pieces after a space: one Arrow array of pieces and one of their ids; emptied when it holds ``most``."""

    def __init__(self, path: str, most: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.cuts = cuts_at_spaces(json.loads(self.tok.to_str()))
        # Byte-level vocabularies write each byte as a printable character: bytes that are
        # printable as themselves, the others as characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.high = {b: c for b, c in self.shown.items() if b > 127}
        self.space, self.line = self.shown[32], self.whole(["\n"])[0]
        self.marks: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        self.known, self.ids = pa.array([""]), pa.array([b""])  # the empty piece has no ids
        self.firsts.clear()

    def add(self, pieces: pa.Array, ids: pa.Array) -> np.ndarray:
        rows = len(self.known) + np.arange(len(pieces))
        self.known, self.ids = pa.concat_arrays([self.known, pieces]), pa.concat_arrays([self.ids, ids])
        return rows

    def word(self, text: str, space: str = "") -> bytes:
        """The ids of one pre-token, straight from the model."""
        if not text.isascii():
            text = "".join(map(self.shown.__getitem__, text.encode()))
        return pack([t.id for t in self.tok.model.tokenize(space + text)])

    def mark(self, tail: str) -> bytes:
        if tail not in self.marks:
            self.marks[tail] = self.word(tail)
        return self.marks[tail]

    def piece(self, text: str, space: str) -> bytes:
        """The ids of a piece, after a space or not: words through the model, all else through the tokenizer."""
        if text.startswith("\n"):  # a line end between two words is a pre-token of its own
            return self.line + self.first(text[1:])
        m = ONE.fullmatch(text)
        if m is not None:
            return self.word(m[1], space) + (self.mark(m[2]) if m[2] else b"")
        return self.whole([" " * bool(space) + text])[0]

    def first(self, text: str) -> bytes:
        """The ids of a piece without a space before it."""
        if not text:
            return b""
        out = self.firsts.get(text)
        if out is None:
            out = self.firsts[text] = self.piece(text, "")
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [pack(e.ids) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: pa.Array) -> np.ndarray:
        """Where the store holds each of some distinct words; those it lacks go through the model one by one."""
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        rows = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            shown = "\n".join(new.to_pylist())
            if not shown.isascii():
                shown = shown.encode().decode("latin-1").translate(self.high)
            encode, space = self.tok.model.tokenize, self.space
            ids = [pack([t.id for t in encode(space + w)]) for w in shown.split("\n")]
            rows[rows < 0] = self.add(new, pa.array(ids, pa.binary()))
        return rows

    def places(self, pieces: pa.Array) -> np.ndarray:
        """Where the store holds each of some distinct pieces; those it lacks are encoded and added."""
        at = pc.index_in(pieces, value_set=self.known)
        new = pieces.filter(pc.is_null(at))
        rows = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            cut = pc.extract_regex(new, MANY)
            simple = cut.is_valid().to_numpy(zero_copy_only=False)
            cut = cut.filter(pa.array(simple))
            coded, tails = cut.field("word").dictionary_encode(), cut.field("tail").dictionary_encode()
            found = np.full(len(new), -1, np.int64)
            # A word with marks has the word's ids, which texts mostly hold alone too, and the marks'.
            word = self.words(coded.dictionary)[coded.indices.to_numpy()]
            marked = pc.not_equal(cut.field("tail"), "").to_numpy(zero_copy_only=False)
            found[simple] = np.where(marked, -1, word)
            marks = pa.array([self.mark(t) if t else b"" for t in tails.dictionary.to_pylist()], pa.binary())
            both = pc.binary_join_element_wise(self.ids.take(pa.array(word[marked])), marks.take(tails.indices.filter(pa.array(marked))), b"")
            here = np.flatnonzero(simple)[marked]
            found[here] = self.add(new.take(pa.array(here)), both)
            rest = new.filter(pa.array(~simple))
            found[~simple] = self.add(rest, pa.array([self.piece(t, self.space) for t in rest.to_pylist()], pa.binary()))
            rows[rows < 0] = found
        return rows

    def encode(self, texts: pa.Array, end: int) -> pa.ListArray:
        """The ids of each text, and the end id."""
        if len(self.known) > self.most:
            self.clear()
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)) if self.cuts else np.arange(len(texts))
        mask = np.zeros(len(texts), bool)
        mask[odd] = True
        # A line starts a piece too: its end mark and what follows it.
        words = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(mask), "", texts), "\n", " \n"), " ")
        bounds = words.offsets.to_numpy().astype(np.int64)
        coded = words.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        firsts, own = np.unique(index[bounds[:-1]], return_inverse=True)
        rows = self.places(coded.dictionary)[index]
        known, ends = _layout(self.ids)
        # After the store's pieces: firsts, which have no space before them, texts encoded whole, and the end.
        more = [self.first(t) for t in coded.dictionary.take(pa.array(firsts)).to_pylist()]
        n, wide = len(self.known), len(more)
        more += self.whole(texts.take(pa.array(odd)).to_pylist()) if len(odd) else []
        more.append(np.array([end], "<i4").tobytes())
        flat = np.concatenate([known, np.frombuffer(b"".join(more), "<i4")])
        ends = np.concatenate([ends, ends[-1] + np.cumsum(np.fromiter(map(len, more), np.int64, len(more))) // 4])
        docs = np.arange(len(texts))
        heads = bounds[:-1] + docs  # each text has one row more, its end
        every = np.full(len(rows) + len(texts), n + len(more) - 1, np.int64)
        every[np.arange(len(rows)) + np.repeat(docs, np.diff(bounds))] = rows
        every[heads] = n + own
        every[heads[odd]] = n + wide + np.arange(len(odd))
        start, lens = ends[every], ends[every + 1] - ends[every]
        upto = np.concatenate([[0], np.cumsum(lens)])
        values = flat[np.repeat(start - upto[:-1], lens) + np.arange(upto[-1])]
        return pa.ListArray.from_arrays(pa.array(upto[np.append(heads, len(every))].astype(np.int32)), pa.array(values))


def _layout(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of an array of packed ids one after another, and where each entry's begin and end."""
    _, ends, flat = ids.buffers()
    ends = np.frombuffer(ends, np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // 4
    return np.frombuffer(flat or b"", "<i4"), ends


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Batches put together to some ``size`` bytes of texts."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.column(1).nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    """A file's rows: doc_id, ids, and how many ids the rows before have."""
    store = held(path, lambda: PieceStore(path))
    total = 0
    for batch in chunks(batches):
        ids = store.encode(batch.column(1), end)
        starts = ids.offsets.to_numpy().astype(np.int64)
        out = pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(total + starts[:-1])], names=["doc_id", "ids", "before"])
        total += int(starts[-1])
        for a in range(0, out.num_rows, 256):
            yield out.slice(a, 256)


SCHEMA = "doc_id long, ids array<int>, before long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2, file_rows: int = 200_000) -> None:
    """Write the ids of every document as ORC under ``path``, ascending by doc_id over the files' names.

    A file has about ``file_rows`` documents at most, however many there are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    files = max(parts(spark), -(-own.count() // file_rows))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = own.repartitionByRange(files, *order).sortWithinPartitions(*order, "text")
    ids = dealt.mapInArrow(lambda it: encode_batches(it, tokenizer, end), SCHEMA)
    (ids.write.format("orc").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", "10000").option("orc.stripe.size", str(64 << 20)).option("compression", "lz4").save(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids, before, and the file each row is in."""
    return spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_name"))


def documents_of(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The stored rows of some documents: the ids go down to the ORC reader, whose row indexes and Bloom filters skip the rest."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.values.to_numpy(zero_copy_only=False).view("<u4")
        offs = ids.offsets.to_numpy()
        n = np.diff(offs)
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offs, offs[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("file"), batch.column("before"), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())],
                                         names=["doc_id", "file", "before", "n_tokens", "ids_crc32"])


def token_digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document."""
    small_batches(stored.sparkSession)
    rows = stored.mapInArrow(checksums, "doc_id long, file string, before long, n_tokens long, ids_crc32 long")
    rows = written(rows, "token-digest")
    total = rows.groupBy("file").agg(F.sum("n_tokens").alias("t"))  # one row a file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select("file", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    return rows.join(offset, "file").select("doc_id", (F.col("offset") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def tokenised(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """Write the documents' ids to the shared folder, read the files back, and digest them."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or vocabulary(), end)
    return token_digest(read_tokens(spark, path))
