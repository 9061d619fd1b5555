"""Packing token sequences: non-negative least squares over shallow length combinations.

A document's ids and an end id are cut into pieces of at most ``window`` tokens. The histogram of the piece
lengths (at most ``window`` rows, whatever the corpus holds) goes to the driver. There the pairs and triples of
lengths that fill a window exactly are enumerated (the second length of a triple on a grid), repeat counts are
solved by non-negative least squares against the histogram, rounded down, and what remains is packed greedily,
longest first. The plan says where the r-th piece of a length goes; pieces are ranked within their length in
Spark, over hash chunks that hold no more than a quarter of a task's even share, so a length that a third of
the pieces have is spread as well, and so are rows that repeat one doc_id.

Edge cases: a null or empty text is the end id alone; repeated rows are packed each for itself; very long texts
become many full pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import durable

WINDOW, END_ID = 2048, 1
TOKENIZER = "byte_bpe_50k"


#: white space as the vocabularies' pattern sees it, in runs that are too long for a matcher that backtracks
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")


@lru_cache(maxsize=2)
def encoder(name: str):
    """(tokenizers' reader of a public byte-level BPE, a reader of its ranks that is four times as fast, its added tokens)."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    added = {token.content: i for i, token in own.get_added_tokens_decoder().items()}
    return own, fast, added


def token_ids(text: str | None, name: str = TOKENIZER, end_id: int = END_ID) -> np.ndarray:
    """The tokenizers file's ids of a text, and the end id.

    Added tokens are cut out first, as the file asks. Inside a run of white space before a word its last character goes with
    the word, so the rest of the run stands alone: long ones are read by tokenizers itself.
    """
    own, fast, added = encoder(name)
    parts: list[np.ndarray] = []
    for piece in re.split(f"({'|'.join(map(re.escape, added))})", text or "") if added else [text or ""]:
        if piece in added:
            parts.append(np.array([added[piece]], "<u4"))
            continue
        at = 0
        for run in LONG_RUN.finditer(piece):
            stop = run.end() - (run.end() < len(piece))
            parts.append(np.asarray(fast.encode_to_numpy(piece[at : run.start()], disallowed_special=()), "<u4"))
            parts.append(np.array(own.encode(piece[run.start() : stop], add_special_tokens=False).ids, "<u4"))
            at = stop
        parts.append(np.asarray(fast.encode_to_numpy(piece[at:], disallowed_special=()), "<u4"))
    return np.concatenate([*parts, np.array([end_id], "<u4")])


def cut_pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, copy (how many rows before it in its batch have its doc_id) of each piece, and its ids (array<int>) if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int | None, int] = {}
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = token_ids(text, tokenizer)
                    copy = seen[doc_id] = seen.get(doc_id, -1) + 1
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), copy, piece.astype(np.int32) if with_ids else None))
                cols = list(zip(*out, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in cols[:6]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"]
                if with_ids:
                    arrays.append(pa.array(cols[6], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def combinations(lengths: np.ndarray, window: int, grid: int = 16) -> np.ndarray:
    """Rows of three lengths (0: none) that add up to the window, of those that occur."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a = np.flatnonzero(there)
    pairs = a[(a < window) & there[np.clip(window - a, 0, window)] & (2 * a >= window)]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1)]
    for b in a[(a % grid == 0) & (a < window)]:
        c = window - b - a
        ok = (c > 0) & (c <= a) & (c < window)
        ok[ok] = there[c[ok]]
        out.append(np.stack([a[ok], np.full(ok.sum(), b), c[ok]], 1))
    rows = np.sort(np.concatenate(out), 1)[:, ::-1]
    return np.unique(rows, axis=0)


def least_squares(rows: np.ndarray, h: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the counts of lengths that rows use x times close to h: accelerated projected gradients."""
    if not len(rows):
        return np.zeros(0)

    def used(x: np.ndarray) -> np.ndarray:
        u = np.bincount(rows.ravel(), np.repeat(x, 3), len(h))
        u[0] = 0
        return u

    scale = max(float(h.max()), 1.0)
    target = h / scale
    target[0] = 0
    v = np.ones(len(rows))
    top = 1.0
    for _ in range(20):
        g = used(v)[rows]
        v = np.where(rows > 0, g, 0).sum(1)
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        rest = target - used(y)
        new = np.maximum(0, y + np.where(rows > 0, rest[rows], 0).sum(1) / top)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(histogram: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Rows (length, first rank, pieces of it in a sequence, first sequence, offset), sorted: where ranks from there on go."""
    h = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        h[length] = n
    out: list[tuple[int, int, int, int, int]] = []
    given = np.zeros(window + 1, np.int64)
    sequences = 0

    def lay(lengths: list[tuple[int, int]], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length, k in lengths:
            out.append((length, int(given[length]), k, sequences, offset))
            given[length] += k * times
            h[length] -= k * times
            offset += k * length
        sequences += times

    if h[window]:
        lay([(window, 1)], int(h[window]))
    rows = combinations(np.flatnonzero(h[1:]) + 1, window)
    x = least_squares(rows, h.astype(float))
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        need: dict[int, int] = {}
        for length in rows[j]:
            if length:
                need[int(length)] = need.get(int(length), 0) + 1
        times = min(int(x[j]), *(int(h[length]) // k for length, k in need.items()))
        if times:
            lay(list(need.items()), times)
    while h[1:].any():  # greedy: the longest piece that fits, again and again; the same fill as often as it can
        lengths = np.flatnonzero(h[1:]) + 1
        left, fill = window, []
        while left:
            at = int(np.searchsorted(lengths, left, side="right")) - 1
            while at >= 0 and any(f[0] == lengths[at] for f in fill):
                at -= 1
            if at < 0:
                break
            length = int(lengths[at])
            k = min(left // length, int(h[length]))
            fill.append((length, k))
            left -= k * length
        lay(fill, min(int(h[length]) // k for length, k in fill))
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = durable(cut_pieces(docs, window, tokenizer), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window rows at most
    total, tasks = sum(counts.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(64, total // (4 * tasks))
    chunks = np.ones(window + 1, np.int64)
    for length, n in counts.items():
        chunks[length] = -(-n // most)
    by_length = F.array(*[F.lit(int(c)) for c in chunks]) if total else F.array(F.lit(1))
    chunked = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.get(by_length, F.col("length").cast("int"))))
    sizes = chunked.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "copy")
    ranked = chunked.withColumn("at", F.row_number().over(inside)).join(F.broadcast(starts), ["length", "chunk"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_rank") + F.col("at") - 1).cast("long").alias("rank"))
    where = plan(counts, window)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = where[:, 0] << 48 | where[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column(2), np.int64), np.asarray(batch.column(5), np.int64)
            w = where[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            j = rank - w[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(w[:, 3] + j // w[:, 2]), pa.array(w[:, 4] + j % w[:, 2] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_least_squares_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): all documents that are left, packed."""
    return pack(docs.select("doc_id", "text"))
