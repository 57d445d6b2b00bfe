"""Operator 8: token-id files with Elias-Fano coded document boundaries.

Documents are range-partitioned and sorted by id, encoded, and written as shard files of bounded size in that order, so
that the files read one after the other are one concatenated id array. A shard holds its documents' ids (16 bits each
where the vocabulary allows, else 32), the document ids, and the boundaries of the documents in the id array as an
Elias-Fano sequence: the low bits of each boundary packed, the high bits in unary, and a sampled select structure that
finds the n-th boundary without a table of 64-bit offsets (2 + log2(ids / documents) bits a document).

    magic "QEF1" | header of 8 little-endian uint64: documents, ids, bytes an id, low bits, high bytes, samples, flags, 0
    document ids (int64) | null bitmap | low bits | high bits | select samples (uint32, every 256th) | ids

Each attempt of a task writes files under names of its own, and hands their names on as its result. The names of the
attempts that counted are committed by Spark as a table beside the files, the manifest, and only files that it names are
read: what a lost executor or a repeated task leaves is never seen, on stores without renames too. Files lie in the shared
folder (spark.checkpoint.dir).

Readers go through the select structure: a document's boundaries from the sample before them, a run of documents from
the samples at its ends, so that nothing but the run is unpacked.

Defined cases: a null text has only the end id; rows that repeat an id are ordered by their text; null ids come first;
ids that aren't whole numbers are refused; a text of any length is one row of a file; an empty table gives no documents.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.llm.bpe import byte_letters
from quirefold.llm.common import own_folder, tidy
from quirefold.sources.stores import opened

MANIFEST = "manifest"
MAGIC, HEADER = b"QEF1", struct.Struct("<8Q")
SAMPLE = 256
# Fixed value of this family of tokenizers: the words that the merges see.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# The same for lower-cased text of Latin-1 characters, its classes written out.
_LATIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^ \t\n\r\v\f\x85\xa0a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+").findall
_MARK = "\x01"
_LETTERS = {b: c for c, b in byte_letters().items()}
SHARD_IDS = 8 << 20


class EliasFano:
    """A non-decreasing sequence of integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Place of the i-th one in the high bits: from the sample before it, byte by byte."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        value = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := value.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            value = int(self.high[byte])
        for _ in range(left):
            value &= value - 1
        return byte * 8 + (value & -value).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        low = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little") >> (first & 7) & ((1 << self.low_bits) - 1)
        return (self.select(i) - i) << self.low_bits | low

    def run(self, block: int) -> np.ndarray:
        """The values of one block of SAMPLE, from the high bits between its sample and the next."""
        first, last = block * SAMPLE, min((block + 1) * SAMPLE, self.n)
        at = int(self.samples[block])
        end = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at >> 3 : (end + 7) >> 3], bitorder="little")[at & 7 :]
        ones = np.flatnonzero(bits)[: last - first].astype(np.int64) + at - np.arange(first, last)
        if not self.low_bits:
            return ones
        low, high = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[low >> 3 : (high + 7) >> 3], bitorder="little")[low & 7 :][: high - low].reshape(-1, self.low_bits)
        return (ones << self.low_bits) + (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def all(self) -> np.ndarray:
        """All values, a block after the other."""
        return np.concatenate([self.run(k) for k in range(len(self.samples))]) if self.n else np.zeros(0, np.int64)


def pack_shard(doc_ids: list[int | None], rows: list[np.ndarray], width: int) -> bytes:
    ends = EliasFano.of(np.cumsum([0] + [len(r) for r in rows]))
    ids = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        MAGIC, HEADER.pack(len(rows), len(ids), width, ends.low_bits, len(ends.high), len(ends.samples), 0, 0),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(known, bitorder="little").tobytes(),
        ends.low.tobytes(), ends.high.tobytes(), ends.samples.astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes(),
    ])


class Shard:
    """One file's content, read in place."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC:
            raise ValueError("not a token file of this format")
        n, total, width, low_bits, high, samples, _, _ = HEADER.unpack_from(content, 4)
        at = 4 + HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, count, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", n), np.unpackbits(take("u1", (n + 7) // 8), count=n, bitorder="little")
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        low, bits, select = take("u1", ((n + 1) * low_bits + 7) // 8), take("u1", high), take("<u4", samples)
        self.ends = EliasFano(n + 1, low_bits, low, bits, select)
        self.ids = take(f"<u{width}", total)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] : self.ends[i + 1]]


class CachedTokenizer:
    """A tokenizers file whose tokens never span a blank; every distinct piece of text is encoded once per cache.

    Latin-1 texts are lower-cased and cut as the file's own pre-tokenizer cuts them, other texts at blanks only. New words
    go to the library's model, new pieces of other texts to the whole library, many at a time in one text: set apart by a
    character that is one token of its own; those that hold it or the start of an added token go alone.
    """

    def __init__(self, path: str, cache: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        spec = json.loads(self.tokenizer.to_str())
        if _WORDS not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False) or not any(n["type"] == "Lowercase" for n in spec["normalizer"]["normalizers"]):
            raise ValueError(f"{path}: only lower-casing word tokenizers with the known word pattern")
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        if len(mark) != 1 or not spec["model"]["end_of_word_suffix"]:
            raise ValueError(f"{path}: needs word ends and a token of its own for {_MARK!r}")
        self._mark = mark[0]
        self._odd = re.compile("|".join(re.escape(x) for x in sorted({t["content"][:2] for t in spec["added_tokens"]} | {_MARK}))).search
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._limit = cache

    def _cut(self, text: str) -> tuple[list[str], bool]:
        """The text's pieces, and whether each is one word as the file's own pre-tokenizer would cut it."""
        try:
            text.encode("latin-1")  # such text is in normal form C, and lower() works letter by letter
        except UnicodeEncodeError:
            return text.replace("\n", " ").replace("\t", " ").split(" "), False
        if self._odd(text):
            return text.split(" "), False
        return _LATIN_WORDS(text.lower()), True

    def _missing(self, pieces: set[str]) -> list[str]:
        new, old, out = self._new, self._old, []
        for piece in pieces:
            if piece not in new:
                if (ids := old.get(piece)) is not None:
                    new[piece] = ids
                else:
                    out.append(piece)
        return out

    def _learn_words(self, words: list[str]) -> None:
        """Words that are normalised and cut already go to the library's model at once, in its letters for bytes."""
        known, tokenize = self._new, self.tokenizer.model.tokenize
        for word in words:
            letters = word if word.isalnum() and word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
            known[word] = array("I", [t.id for t in tokenize(letters)]).tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Pieces with more to them are encoded many at a time, set apart by the mark."""
        groups = [pieces[at : at + 2048] for at in range(0, len(pieces), 2048)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(ids == self._mark)).tolist()
            flat, starts = ids.tobytes(), [0, *(e + 4 for e in ends)]
            self._new.update((p, flat[a:b]) for p, a, b in zip(some, starts, [*ends, 4 * len(ids)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self._new) > self._limit:
            self._old, self._new = self._new, {}
        cut = [self._cut(t) for t in texts]
        words = set().union(*(c for c, plain in cut if plain))
        others = set().union(*(c for c, plain in cut if not plain)) - words
        words, others = self._missing(words), self._missing(others)
        self._learn_words(words)
        self._learn_pieces([p for p in others if not self._odd(p)])
        new, alone = self._new, [p for p in others if self._odd(p)]
        for piece in alone:
            new[piece] = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        return [b"".join(map(new.__getitem__, c)) for c, _ in cut]


_loaded: dict[str, CachedTokenizer] = {}


def _tokenizer(path: str) -> CachedTokenizer:
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the files now; gives file, documents, ids and start (ids in all files before it), one row per file."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col}: token files hold ids that are whole numbers, not {docs.schema[id_col].dataType.simpleString()}")

    def run(batches):
        task = TaskContext.get()
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        tok, part, held, ids, size = _tokenizer(tokenizer), 0, [], [], 0
        width = tok.width if end_id < 1 << 8 * tok.width else 4
        end = np.array([end_id], "<u4").tobytes()
        rows = []

        def flush():
            name = f"part-{task.partitionId():07d}-{part:05d}-{task.taskAttemptId():x}-{uuid.uuid4().hex[:8]}.qef"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(pack_shard(held, ids, width))
            rows.append((name, len(held), size))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), tok.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                one = np.frombuffer(text + end, "<u4").astype(f"<u{width}")
                if held and size + len(one) > shard_ids:
                    flush()
                    part, held, ids, size = part + 1, [], [], 0
                held.append(doc)
                ids.append(one)
                size += len(one)
        if held:
            flush()
        held, ids = [], []
        tidy()
        names, counts, sizes = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["file", "documents", "ids"])

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "file string, documents long, ids long").write.parquet(f"{folder}/{MANIFEST}")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, documents, ids and start of the files that count."""
    files = spark.read.schema("file string, documents long, ids long").parquet(f"{folder}/{MANIFEST}")
    # one row per file of millions of ids: a running sum in one task is fine
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """file, doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files alone."""

    def run(batches):
        store, base = opened(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as file:
                    shard = Shard(file.read())
                ends = shard.ends.all()
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                n = len(shard)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(shard.doc_ids, pa.int64()), pa.array(ends[:-1] + start, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())],
                    ["file", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest(spark, folder).select("file", "start")
    # a task a few files: the manifest is small, what it names is not
    parts = max(1, min(files.count(), 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return files.repartition(parts, "file").mapInArrow(run, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **names) -> DataFrame:
    """Writes docs as token files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or f"{own_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    files = write_shards(docs, tokenizer, end_id, folder, **names)
    if files.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(docs.sparkSession, folder).drop("file")
