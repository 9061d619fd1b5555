"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries and select structures.

A folder holds id files and a manifest (a Parquet table with one row for each file: number, name, documents, ids, smallest
document). Files are numbered in ascending doc_id order, and so are the documents in them. A file is

    head (8 little-endian 64-bit numbers) | document ids | ends of documents | ids (16 bits each if the vocabulary allows, else 32)

where document ids (less the smallest) and ends are Elias-Fano sequences: of each value the low bits stand in a packed
array, and the high parts as unary gaps in a bit vector. For every 256th value its place in that vector is kept in 32
bits, so ``select(i)`` jumps there and counts at most some words on; no table of 64-bit offsets exists. A document costs
two bits and the logarithm of the mean gap.

Writing: rows are sorted by range of (doc_id, hash of the text, position), so one doc_id that a third of the rows have is
dealt to several tasks. Tasks encode and write files of at most ``file_ids`` ids (one longer document is a file of its own)
under names that no other attempt uses; the manifest, which Spark commits, names those that count. A lost executor's
files are thus never read. Files go through pyarrow's file systems, to any folder that driver and executors share.

Encoding: white space parts the tokenizer's words, so each distinct stretch between spaces and line ends is encoded once by the tokenizers
library (and kept, up to a fixed number), and a text's ids are put together from those.

Edge cases: a null or empty text is the end id alone; a null doc_id comes first; rows that repeat a doc_id stand in the order
of their texts' hashes, each with a place of its own; an empty table gives no files and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codefacts.llm.common import U, doc_slices, give_back, shared_dir

TOKENIZER, END_ID = "word_bpe_49k", 1
MAGIC, HEAD, SAMPLE = 0x31454C4946534449, 8, 256
FILE_IDS, FILE_DOCS, READ_IDS = 1 << 24, 1 << 20, 1 << 20
#: stretches and characters that a task keeps
KEPT, KEPT_CHARS = 400_000, 1 << 23
#: words of letters that are encoded as one text
WORDS = 256
#: what a word may end with; no apostrophe, which may belong to the letters after it
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
MANIFEST = "number long, name string, n_docs long, n_ids long, first_id long, last_id long"


class EliasFano:
    """A non-decreasing sequence of numbers below 2**63 in near-minimal space, with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.sample = n, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        x = values.astype(U)
        n = len(x)
        top = int(x[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (x[:, None] >> np.arange(low_bits, dtype=U)) & U(1)
        low = np.packbits(bits.astype(bool).ravel(), bitorder="little")
        at = (x >> U(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // 64) * 64, bool)
        high[at] = True
        return cls(n, low_bits, low, np.packbits(high, bitorder="little").view(U), at[::SAMPLE].astype(np.uint32))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.sample)], "<u8"), self.high.astype("<u8"), self.sample.astype("<u4"), self.low]

    @classmethod
    def read(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence that starts at a byte, and where it ends."""
        n, low_bits, low, high, sample = np.frombuffer(raw, "<u8", 5, at).tolist()
        a = at + 40
        b, c = a + 8 * high, a + 8 * high + 4 * sample
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, low, c), np.frombuffer(raw, "<u8", high, a), np.frombuffer(raw, "<u4", sample, b)), c + low

    def select(self, i: int) -> int:
        """The i-th value: from the sampled place before it, over whole words, to its bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.sample[i // SAMPLE])
        left, word = i % SAMPLE, start >> 6
        bits = int(self.high[word]) >> (start & 63) << (start & 63)
        while (found := bits.bit_count()) <= left:
            left, word = left - found, word + 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        first = i * self.low_bits
        some = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little") >> (first & 7)
        return (place - i) << self.low_bits | some & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        """Every value, as unsigned 64-bit numbers."""
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = (bits.astype(U) << np.arange(self.low_bits, dtype=U)).sum(1, dtype=U)
        return (at - np.arange(self.n)).astype(U) << U(self.low_bits) | low

    def index(self, value: int) -> int:
        """How many values are smaller, by halving."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) < value else (lo, mid)
        return lo


def open_store(at: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    return fs.FileSystem.from_uri(at) if ":/" in at else (fs.LocalFileSystem(), at)


def file_parts(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> list[np.ndarray]:
    """A file's parts for documents in ascending order, nulls first; ids come in arrays of any length with their documents' lengths."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) for x in ids])
    head = np.array([MAGIC, len(doc_ids), int(ends[-1]) if len(ends) else 0, width, len(doc_ids) - len(known), base & (1 << 64) - 1, 0, 0], "<u8")
    # differences as unsigned numbers, so that ids of both signs do
    keys, bounds = EliasFano.of(known.view(U) - U(base & (1 << 64) - 1)).parts(), EliasFano.of(ends).parts()
    return [head, *keys, *bounds, *[x.astype(f"<u{width}") for x in ids]]


class IdFile:
    """An id file that is open for reading: boundaries are held coded, ids are read as they are asked for."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        head = np.frombuffer(self.file.read_at(8 * HEAD, 0), "<u8")
        if int(head[0]) != MAGIC:
            raise ValueError(f"{path} is no id file")
        self.n_docs, self.n_ids, self.width, self.nulls = head[1:5].tolist()
        self.base = int(head[5:6].view("<i8")[0])
        size = self.file.size() - self.n_ids * self.width
        raw = self.file.read_at(size - 8 * HEAD, 8 * HEAD)
        self.keys, at = EliasFano.read(raw)
        self.ends, _ = EliasFano.read(raw, at)
        self.first = size

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.all() + U(self.base & (1 << 64) - 1)).view(np.int64).tolist()

    def ids(self, start: int, stop: int) -> np.ndarray:
        raw = self.file.read_at((stop - start) * self.width, self.first + start * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """Where the i-th document starts, and its ids: two selects and one read."""
        start = self.ends.select(i - 1) if i else 0
        return start, self.ids(start, self.ends.select(i))

    def places(self, doc_id: int) -> range:
        """The documents that have this id."""
        return range(self.nulls + self.keys.index(doc_id - self.base), self.nulls + self.keys.index(doc_id - self.base + 1))

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Start and ids of every document, some MB at a time."""
        ends = self.ends.all().astype(np.int64)
        i, start = 0, 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, start + READ_IDS, side="right")))
            some = self.ids(start, int(ends[j - 1]))
            for stop in ends[i:j].tolist():
                yield start, some[: stop - start]
                some, start = some[stop - start :], stop
            i = j

    def close(self) -> None:
        self.file.close()


class Encoder:
    """Texts' ids by the tokenizers library, each distinct stretch between spaces once while it is kept.

    A stretch of letters alone is one word for the tokenizer, and only the last id of a word stands for a piece that ends one: so many are encoded as
    one text and its ids cut there. Marks at the end of a word are a word of their own, but after a letter with a combining mark. All other stretches are encoded one by one.
    """

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.own = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        vocabulary = self.own.get_vocab()
        most = max(vocabulary.values())
        self.width = 2 if most < 1 << 16 else 4
        suffix = getattr(self.own.model, "end_of_word_suffix", None)
        self.ends = np.zeros(most + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        self.closed: dict[str, bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Keeps the stretches that came up more than twice, up to half of the bound."""
        if not hasattr(self, "index"):
            self.index: dict[str, int] = {}
            self.flat, self.size, self.start, self.used = np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))
        hot = np.flatnonzero(self.used > 2)
        hot = np.sort(hot[np.argsort(-self.used[hot], kind="stable")[: KEPT // 2]])
        names = np.array(list(self.index), object)[hot].tolist()
        self.flat, self.size = self._gather(hot), self.size[hot]
        self.start, self.used = np.cumsum(self.size) - self.size, np.zeros(len(hot), np.int64)
        self.index = dict(zip(names, range(len(names)), strict=True))
        self.chars = sum(map(len, names))

    def _add(self, new: list[str]) -> None:
        words: dict[str, None] = {}
        others: dict[str, None] = {}
        tails: list[tuple[str, str, str]] = []
        for w in new:
            if w.isalpha():
                words[w] = None
            elif (core := w.rstrip(MARKS)).isalpha() and self._closed(core[-1]):
                tails.append((w, core, w[len(core) :]))
            else:
                others[w] = None
        words.update((core, None) for _, core, _ in tails if core not in self.index)
        others.update((tail, None) for _, _, tail in tails if tail not in self.index)
        single = self._add_words(list(words)) + list(others)
        for i in range(0, len(single), 1024):
            parts = [e.ids for e in self.own.encode_batch_fast(single[i : i + 1024], add_special_tokens=False)]
            size = np.fromiter(map(len, parts), np.int64, len(parts))
            self._store(single[i : i + 1024], np.fromiter(chain.from_iterable(parts), np.uint32, size.sum()), size)
        pairs = np.array([(self.index[core], self.index[tail]) for _, core, tail in tails], np.int64).reshape(-1)
        self._store([w for w, _, _ in tails], self._gather(pairs), self.size[pairs].reshape(-1, 2).sum(1))

    def _closed(self, letter: str) -> bool:
        """Whether marks after this letter are a word of their own; not if its normal form ends with a combining mark, which they join."""
        if letter not in self.closed:
            alone, mark, both = (e.ids for e in self.own.encode_batch_fast([letter, ".", f"{letter}."], add_special_tokens=False))
            self.closed[letter] = alone + mark == both
        return self.closed[letter]

    def _add_words(self, words: list[str]) -> list[str]:
        """Adds words of letters, many to a text; returns those of texts whose ids don't end as many words as went in."""
        left, names, flat, size = [], [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), WORDS):
            some = words[i : i + WORDS]
            ids = np.array(self.own.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                names += some
                flat.append(ids)
                size.append(np.diff(stops, prepend=0))
            else:
                left += some
        self._store(names, np.concatenate(flat), np.concatenate(size))
        return left

    def _store(self, names: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.flat = np.concatenate([self.flat, flat])
        self.size, self.used = np.concatenate([self.size, size]), np.concatenate([self.used, np.zeros(len(size), np.int64)])
        self.index.update(zip(names, range(len(self.index), len(self.index) + len(names)), strict=True))
        self.chars += sum(map(len, names))

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of some stretches in a row."""
        n = self.size[at]
        return self.flat[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        if not len(texts):
            return []
        if len(self.index) > KEPT or self.chars > KEPT_CHARS:
            self._forget()
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()).fill_null("")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        word = np.asarray(coded.indices)
        names = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(at < 0).tolist()
        if fresh:
            self._add([names[i] for i in fresh])
            at[fresh] = [self.index[names[i]] for i in fresh]
        self.used[at] += np.bincount(word, minlength=len(at))
        at = at[word]
        ends = np.concatenate(([0], np.cumsum(self.size[at])))[np.cumsum(np.asarray(pc.list_value_length(split), np.int64))]
        return np.split(self._gather(at), ends[:-1])


@lru_cache(maxsize=1)
def encoder(name: str) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    return Encoder(name)


Batches = Iterable[pa.RecordBatch]


def write(docs: DataFrame, folder: str, name: str = TOKENIZER, end_id: int | None = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all documents to id files in a shared folder, and the manifest; returns the manifest."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, (store, top) = encoder(name), open_store(folder)
        store.create_dir(top, recursive=True)
        partition, files, held = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        end = np.array([] if end_id is None else [end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal keys, parts, held, files
            file = f"ids-{partition:08d}-{files:06d}-{uuid.uuid4().hex}.bin"
            with store.open_output_stream(f"{top}/{file}") as out:
                for part in file_parts(keys, parts, task.width):
                    out.write(memoryview(np.ascontiguousarray(part)).cast("B") if part.size else b"")
            known = [k for k in keys if k is not None]
            row = [partition << 32 | files, file, len(keys), held, known[0] if known else None, known[-1] if known else None]
            files, held, keys, parts = files + 1, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([file]), *[pa.array([x], pa.int64()) for x in row[2:]]], ["number", "name", "n_docs", "n_ids", "first_id", "last_id"])

        for batch in batches:
            for i, j in doc_slices(batch.column(1)):
                for key, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), task.encode(batch.column(1).slice(i, j - i)), strict=True):
                    ids = np.concatenate([ids, end]).astype(f"<u{task.width}")
                    if keys and (held + len(ids) > file_ids or len(keys) == FILE_DOCS):
                        yield flush()
                    keys.append(key)
                    parts.append(ids)
                    held += len(ids)
        if keys:
            yield flush()
        give_back()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    rows = rows.withColumn("h", F.crc32(F.coalesce("text", F.lit(""))))
    placed = rows.repartitionByRange("doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at")
    placed.select("doc_id", "text").mapInArrow(run, MANIFEST).write.mode("error").parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def with_starts(files: DataFrame) -> DataFrame:
    """The manifest with the number of ids in all files before: sums over a thousand files each, then over those."""
    chunked = files.withColumn("chunk", F.shiftright("number", 42))
    chunks = chunked.groupBy("chunk").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("chunk_start"))
    inside = Window.partitionBy("chunk").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return chunked.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(chunks, "chunk").withColumn("start", F.col("chunk_start") + F.col("inside")).drop("chunk", "chunk_start", "inside")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, unless they are not wanted, ids of every document in the files."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                file = IdFile(store, f"{top}/{row['name']}")
                out: list[tuple] = []
                held = 0
                for doc_id, (start, ids) in zip(file.doc_ids(), file.documents(), strict=True):
                    out.append((doc_id, row["start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                    held += len(ids)
                    if held > READ_IDS or len(out) >= 4096:
                        yield rows(out)
                        out, held = [], 0
                yield rows(out)
                file.close()
        give_back()

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 5
        arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + ([pa.array(columns[4], pa.list_(pa.int32()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    files = with_starts(manifest(spark, folder)).select("name", "start")
    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def lookup(wanted: DataFrame, folder: str) -> DataFrame:
    """doc_id, start and ids of the documents whose ids the first column of wanted names: two selects and one read for each."""

    spark = wanted.sparkSession
    files = with_starts(manifest(spark, folder)).filter("first_id IS NOT NULL").orderBy("number").toArrow()  # a row for each FILE_IDS ids
    first, last, names, starts = (files[c].to_numpy() for c in ("first_id", "last_id", "name", "start"))

    def dealt(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0), np.int64)
            a = np.searchsorted(last, x)
            n = np.maximum(np.searchsorted(first, x, side="right") - a, 0)
            at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, n)), pa.array(names[at], pa.string()), pa.array(starts[at], pa.int64())], ["wanted", "name", "start"])

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        store, top = open_store(folder)
        at: tuple[str, IdFile] | None = None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if at is None or at[0] != row["name"]:
                    at = (row["name"], IdFile(store, f"{top}/{row['name']}"))
                out += [(row["wanted"], row["start"] + s, ids.astype(np.int32)) for s, ids in map(at[1].document, at[1].places(row["wanted"]))]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    keys = wanted.select(F.col(wanted.columns[0]).cast("long").alias("wanted")).filter("wanted IS NOT NULL").distinct()
    placed = keys.mapInArrow(dealt, "wanted long, name string, start long").repartition("name").sortWithinPartitions("name", "wanted")
    return placed.mapInArrow(run, "doc_id long, start long, ids array<int>")


def op12_elias_fano_id_files(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/id-files-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read(spark, folder, with_ids=False)
