"""Exact top-k inner products over vectors sorted by length, with rotated partial sums.

Components become integers, floor(scale * x), so scores are exact. Vectors are range-partitioned by descending
length into blocks. Each query starts from the k-th best score among the longest vectors (a bounded head). A
block is met only by the queries whose length times the block's greatest length (Cauchy-Schwarz) reaches that bar.
Inside, vectors and queries are rotated by the singular vectors of a bounded sample, so the first components
carry most of the product; a vector whose partial sum plus the product of the remaining lengths stays under the
bar is dropped, and only the others are multiplied exactly. The bar rises with every run of vectors.

Edge cases: vectors that are null, of another width than most or hold null or non-finite components take no part
(zero vectors do); ties go to the smaller id; repeated vectors are answers like any other, repeated rows count once; a query is not its own
answer; fewer than k candidates give what there is; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import durable
from codefacts.llm.vectors import common_width, matrix

#: the longest vectors that set the queries' first bars, and the rows that the rotation is fitted on
HEAD, SAMPLE = 2048, 4096


def _ints(width: int, scale: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = matrix(batch.column(1), width)
            v = np.floor(x * scale)
            ids, query = np.asarray(batch.column(0), np.int64)[at], np.asarray(batch.column(2).fill_null(False))[at]
            cols = [pa.array(ids), pa.array(query), pa.array((v**2).sum(1)), pa.array([r.tobytes() for r in v], pa.binary())]
            batch = pa.RecordBatch.from_arrays(cols, ["vec_id", "is_query", "norm2", "v"])
            if len(np.unique(ids)) < len(ids):  # rows that repeat an id may be a third of all: one of equal ones goes on
                rows = {(i, r): n for n, (i, r) in enumerate(zip(ids.tolist(), batch.column(3).to_pylist(), strict=True))}
                batch = batch.take(pa.array(sorted(rows.values())))
            yield batch

    return run


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by length, id and vector, without those that repeat the row before."""
    last = None
    for batch in batches:
        ids, v = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        keep = [(i, x) != (ids[n - 1], v[n - 1]) if n else (i, x) != last for n, (i, x) in enumerate(zip(ids, v, strict=True))]
        if ids:
            last = (ids[-1], v[-1])
        yield batch.filter(pa.array(keep, pa.bool_()))


def _stack(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.array([np.frombuffer(v) for v in column.to_pylist()]).reshape(len(column), width)


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer products: in doubles while all sums stay exact there, else in Python integers."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[-1]
    return (q @ v.T).astype(np.int64) if most < 2**53 else (q.astype(object) @ v.T.astype(object)).astype(np.int64)


def top_products(rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, vector: str = "embedding", block: int = 8192, chunk: int = 8192, prefix: int = 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query row with all other rows.

    A block of vectors moves once for each chunk of queries of which any may find an answer in it.
    """
    rows = rows.select(F.col("vec_id").cast("long"), vector, is_query.alias("is_query")).filter("vec_id IS NOT NULL")
    width = common_width(rows, vector)
    ints = rows.mapInArrow(_ints(width, scale), "vec_id long, is_query boolean, norm2 double, v binary")
    n = rows.count()
    blocks = max(1, -(-n // block))
    order_by = [F.desc("norm2"), F.col("vec_id"), F.col("v")]
    once = ints.repartitionByRange(blocks, *order_by[:2]).sortWithinPartitions(*order_by).mapInArrow(_once, "vec_id long, is_query boolean, norm2 double, v binary")
    sorted_rows = durable(once.withColumn("block", F.spark_partition_id()), "lengths")

    head = sorted_rows.orderBy(F.desc("norm2"), "vec_id").limit(HEAD).select("vec_id", "v").toArrow()
    head_id, head_v = np.asarray(head["vec_id"], np.int64), _stack(head["v"], width)
    share = min(1.0, SAMPLE / max(n, 1))
    some = sorted_rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 24)) / float(1 << 24) < share).limit(2 * SAMPLE).select("v").toArrow()
    sample = _stack(some["v"], width)
    turn = np.linalg.svd(sample, full_matrices=True)[2].T if len(sample) and width else np.eye(width)
    longest = {r["block"]: r["m"] ** 0.5 for r in sorted_rows.groupBy("block").agg(F.max("norm2").alias("m")).collect()}
    order = sorted(longest, key=lambda b: -longest[b])
    reach = np.array([longest[b] for b in order])
    order = np.array(order, np.int32)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their bar, once for each block that may hold an answer."""
        for batch in batches:
            ids, q = np.asarray(batch.column(0), np.int64), _stack(batch.column(1), width)
            if not len(ids):
                continue
            s = exact_products(q, head_v).astype(float)
            s[ids[:, None] == head_id[None, :]] = -np.inf
            bar = np.sort(s, 1)[:, -k] if s.shape[1] >= k else np.full(len(ids), -np.inf)
            norm = np.sqrt((q**2).sum(1))
            who, where = np.nonzero(norm[:, None] * reach[None, :] * (1 + 1e-9) >= bar[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(order[where]), pa.array(ids[who]), pa.array(bar[who]), pa.array([q[i].tobytes() for i in who], pa.binary())], ["block", "query_id", "bar", "v"])

    count = sorted_rows.filter("is_query").count()
    chunks = max(1, -(-count // chunk))
    queries = sorted_rows.filter("is_query").select("vec_id", "v").mapInArrow(meet, "block int, query_id long, bar double, v binary")
    queries = durable(queries.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")), "meetings")
    asked = queries.groupBy("block").agg(F.collect_set("chunk").alias("chunks"))  # a row for each block
    vectors = sorted_rows.join(asked, "block").select("block", F.explode("chunks").alias("chunk"), "vec_id", "norm2", "v")

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _scan(left, right, width, turn, prefix, k)

    found = vectors.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInArrow(compare, "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(left: pa.Table, right: pa.Table, width: int, turn: np.ndarray, prefix: int, k: int, run: int = 256) -> pa.Table:
    """The k best of one block for each query of one chunk, of those that reach its bar."""
    none = pa.table({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    if not left.num_rows or not right.num_rows:
        return none
    ids, norm2 = np.asarray(left["vec_id"], np.int64), np.asarray(left["norm2"])
    order = np.lexsort((ids, -norm2))
    ids, norm = ids[order], np.sqrt(norm2[order])
    v = _stack(left["v"], width)[order]
    qid, bar, q = np.asarray(right["query_id"], np.int64), np.asarray(right["bar"], float).copy(), _stack(right["v"], width)
    h = min(prefix, width)
    vr, qr = v @ turn, q @ turn
    v_rest, q_rest = np.sqrt((vr[:, h:] ** 2).sum(1)), np.sqrt((qr[:, h:] ** 2).sum(1))
    q_norm = np.sqrt((q**2).sum(1))
    best_score = np.full((len(q), k), -np.inf)
    got: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in qid]
    for i in range(0, len(v), run):
        live = np.flatnonzero(q_norm * norm[i] * (1 + 1e-9) >= bar)  # lengths fall: the others are done
        if not len(live):
            break
        part = qr[live, :h] @ vr[i : i + run, :h].T
        slack = 1e-9 * q_norm[live, None] * norm[None, i : i + run] + 1e-6
        may = part + q_rest[live, None] * v_rest[None, i : i + run] + slack >= bar[live, None]
        may &= qid[live, None] != ids[None, i : i + run]
        for r in np.flatnonzero(may.any(1)):
            at, who = np.flatnonzero(may[r]) + i, live[r]
            score = exact_products(q[who][None, :], v[at])[0]
            keep = score >= bar[who]
            if keep.any():
                got[who].append((score[keep], ids[at][keep]))
                best_score[who] = np.sort(np.concatenate((best_score[who], score[keep])))[-k:]
                bar[who] = max(bar[who], best_score[who][0])
    out = []
    for who, parts in enumerate(got):
        if parts:
            s, d = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            top = np.lexsort((d, -s))[:k]
            out.append((np.full(len(top), qid[who]), d[top], s[top]))
    return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)}) if out else none


def op6_norm_sorted_products(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5"""
