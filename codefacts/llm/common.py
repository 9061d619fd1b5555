"""What several operators share: durable tables, Arrow texts as numpy arrays, and connected components.

Nothing here holds a corpus: word and shingle hashes are made per Arrow batch inside Spark tasks, and
``durable`` writes to the folder that the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: glibc's; other C libraries have none
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new temporary one if all runs in this one process, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read back: lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``durable`` wrote, once nothing reads them any more; what is left behind would fill the shared folder."""
    for table in tables:
        spark = table.sparkSession
        top = shared_dir(spark)
        for file in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if file.partition(":")[2].lstrip("/").startswith(top.partition(":")[2].lstrip("/") if ":" in top else top.lstrip("/")):
                path = spark._jvm.org.apache.hadoop.fs.Path(file)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """While it lasts, Arrow batches hold fewer rows, so that batches of long texts or sets fit a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_rows(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, int, str]:
    """The columns in keep as k0, k1, ... (whatever they are called) with the text once; where the text stands, and the kept columns as DDL."""
    kept = [docs[c].alias(f"k{i}") for i, c in enumerate(keep)]
    ddl = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    if "text" in keep:
        return docs.select(*kept), keep.index("text"), ddl
    return docs.select(*kept, docs["text"].alias("whole")), len(keep), ddl


def crc_of(doc_id: Column) -> Column:
    """crc32 of an id written as text, unsigned; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))
_SLICE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def string_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and the offset of each text (one more than texts); nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, parts: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``, or run of bytes that don't part words, and for each text the index of its first."""
    space = parts[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([True], space[:-1])) if len(raw) else space
    after = np.concatenate((space[1:], [True])) if len(raw) else space
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums over slices of some MB, so that long texts need little memory."""
    out = np.zeros(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, side="right")))
        lo, hi = starts[i], ends[j - 1]
        part = _LOWER[raw[lo:hi]] if lower else raw[lo:hi]
        up, down = _powers(_BASE, hi - lo), _powers(_BASE_INV, hi - lo)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(_BYTE[part] * up, out=total[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[b] - total[a]) * down[a] + (b - a).astype(U)
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k word hashes (one for fewer words, none for none)."""
    if not len(words):
        return words
    n, k = max(1, len(words) - k + 1), min(k, len(words))
    total = np.full(n, U(k))
    for j in range(k):
        total = total * U(0xD6E8FEB86659FD93) + words[j : j + n]
    return mix(total)


def doc_slices(texts: pa.Array, size: int = 1 << 20, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a few MB of text each and no more than so many rows (at least one): what one numpy step holds."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    i, ends = 0, np.cumsum(lengths)
    while i < len(lengths):
        j = max(i + 1, min(i + rows, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right"))))
        yield i, j
        i = j
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps Python workers for later stages, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def fixed_width(column: pa.ChunkedArray, dtype: type, width: int) -> np.ndarray:
    """A column of binaries of one size as rows of numbers, without a Python object for each."""
    parts = [np.zeros((0, width), dtype)]
    for chunk in column.chunks:
        offsets, data = chunk.buffers()[1:]
        if len(chunk):
            at = np.frombuffer(offsets, np.int32, len(chunk) + 1, chunk.offset * 4)
            parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype).reshape(-1, width))
    return np.concatenate(parts)


def list_array(parts: list[np.ndarray], dtype: str) -> pa.Array:
    """One Arrow list of each part."""
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(dtype)))


def fixed_bloom(df: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """A Bloom filter of the longs in a column: always 2**bits bits, so its size never grows with the data.

    A filter that is too full lets more rows through, never fewer; an exact join must follow it.
    """

    # the set bits themselves come back byte by byte, OR-ed in Spark: at most 2**(bits - 3) rows
    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(0).drop_null(), np.int64)
            s = np.unique(np.concatenate(bloom_slots(x, bits)))
            yield pa.RecordBatch.from_arrays([pa.array((s >> 6).astype(np.int64)), pa.array((U(1) << (s & 63).astype(U)).view(np.int64))], ["word", "bit"])

    rows = df.select(F.col(column).cast("long")).mapInArrow(slots, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[np.asarray(rows["word"], np.int64)] = np.asarray(rows["bits"], np.int64)
    return out.view(U)


def bloom_slots(x: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(x.view(U))
    return [(mix(h + U(i * 0x9E37)) >> U(64 - bits)).astype(np.int64) for i in range(3)]


def bloom_has(bloom: np.ndarray, x: np.ndarray) -> np.ndarray:
    bits = (len(bloom) * 64).bit_length() - 1
    ok = np.ones(len(x), bool)
    for s in bloom_slots(x.astype(np.int64), bits):
        ok &= (bloom[s >> 6] >> (s & 63).astype(U)) & U(1) == 1
    return ok


def part_by_ids(rows: DataFrame, column: str, ids: DataFrame, most: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is among the distinct ids and maybe a few more, all other rows), without a shuffle of the rows.

    Up to ``most`` ids are broadcast (16 MB); for more a Bloom filter of fixed size tells which rows may have one.
    """
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias("_id"))
    if ids.limit(most + 1).count() <= most:
        marked = rows.join(F.broadcast(ids.distinct()), rows[column] == F.col("_id"), "left")
        return marked.filter("_id IS NOT NULL").drop("_id"), marked.filter("_id IS NULL").drop("_id")
    bloom = fixed_bloom(ids, "_id")
    at = rows.columns.index(column)

    def part(wanted: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = np.asarray(batch.column(at).is_valid())
                has = bloom_has(bloom, np.asarray(batch.column(at).cast(pa.int64()).fill_null(0), np.int64)) & known
                yield batch.filter(pa.array(has == wanted))

        return rows.mapInArrow(run, rows.schema)

    return part(True), part(False)


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Every vertex sends the smallest of its neighbours to all of them, until nothing changes; each round is
    a grouped minimum with map-side combining and an equi-join that AQE can split, written to the shared folder.
    """
    def settle(rows: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, written, and what tells them from others; both in one job."""
        seen = Observation()
        marked = rows.filter("u > v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        return durable(marked, name), tuple(seen.get.values())

    e, state = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while True:
        before = state
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        sent = both.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e, state = settle(sent.union(low.select("u", F.col("low").alias("v"))))
        if state == before:
            return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").union(e.select("v", "v").distinct())
