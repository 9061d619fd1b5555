"""Nearest neighbours: an inverted file with product-quantised residuals, exact reranking and an exact check.

Coarse centroids and codebooks are fitted on at most ``sample`` vectors (documented bound); every vector is
indexed: it goes to its nearest centroid's list with one byte for each sub-vector of its residual. A query probes
the ``probes`` nearest lists. There a table of distances from the query's residual to each code word scores all
codes of a list; only ids and these distances go on. The best ``shortlist`` of all lists together are looked up by id and
compared with their original vectors in double precision, and the best k are what the codes find. Lists are dealt in parts of at
most ``part`` rows and their queries in parts of ``part`` too, so a centroid that a third of the vectors share is searched
by many tasks.

Codes tell vectors apart only as far as the residuals differ by more than a code word: in a dense cluster, or beside a few
vectors of great length, the true neighbours may not be among the shortlist. So an exact check follows: the distance of the
k-th found is the query's bar, and by the triangle inequality only lists, and in them only rows, whose distance to the centroid
is within the bar of the query's own can hold a nearer vector. These are compared in full where the lists lie, and what is within the bar
joins the answer, which then is exact. Clusters leave few such lists; vectors without clusters leave most of them.

Edge cases: vectors that are null, zero, of another width than most or hold null or non-finite components take
no part; ties go to the smaller id; repeated vectors are answers like any other, repeated rows
count once; a query is not its own answer
(nor are rows with its id); fewer rows than centroids or k give what there is; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from codefacts.llm.common import durable, fixed_width, release
from codefacts.llm.vectors import common_width, matrix


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centroids, from distinct rows of x spread over it."""
    seeds = np.unique(x, axis=0)
    c = seeds[np.linspace(0, len(seeds) - 1, min(k, len(seeds))).astype(int)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None, :]


def nearest(x: np.ndarray, c: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([squared(x[i : i + block], c).argmin(1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, int)


class Index:
    """centroids (cells x width) and codebooks (parts x words x width / parts)."""

    def __init__(self, x: np.ndarray, cells: int, parts: int, words: int):
        self.width = x.shape[1]
        self.centroids = kmeans(x, cells) if len(x) else np.zeros((0, self.width))
        self.bounds = np.linspace(0, self.width, min(parts, self.width) + 1).astype(int)
        rest = x - self.centroids[nearest(x, self.centroids)] if len(x) else x
        self.books = [kmeans(rest[:, a:b], words) for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)] if len(x) else []

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        return np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.bounds[:-1], self.bounds[1:], self.books, strict=True)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray, cell: int) -> list[np.ndarray]:
        """For each part the squared distances (queries x words) from the queries' residuals to its code words."""
        rest = q - self.centroids[cell]
        return [squared(rest[:, a:b], book) for a, b, book in zip(self.bounds[:-1], self.bounds[1:], self.books, strict=True)]


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of x to that of q."""
    return np.sqrt(((x - q) ** 2).sum(1))


def fit(rows: DataFrame, vector: str, sample: int = 20_000, most: int = 131_072, parts: int = 16, words: int = 256) -> Index:
    """Fits on a sample of vectors, chosen by a hash of their components: ``sample``, or 32 a cell, but at most ``most``; cells grow as the square root of the rows, up to a 32nd of most."""
    width = common_width(rows, vector)
    n = rows.count()
    cells = int(min(most // 32, max(1, n**0.5 / 2)))
    wanted = min(most, max(sample, 32 * cells))
    draw = F.pmod(F.xxhash64(vector, "vec_id"), F.lit(1 << 40)) / float(1 << 40)

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = matrix(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x[(x != 0).any(1)]], pa.binary())], ["x"])

    drawn = rows.filter(draw < min(1.0, 1.2 * wanted / max(n, 1))).select(vector, draw.alias("draw"), "vec_id").orderBy("draw", "vec_id").limit(wanted)
    x = fixed_width(drawn.select(vector).mapInArrow(take, "x binary").toArrow()["x"], np.float64, width) if width else np.zeros((0, 0))
    return Index(x, cells, parts, words)


def search(rows: DataFrame, is_query: Column, k: int = 10, probes: float = 0.7, shortlist: int = 200, part: int = 8192, vector: str = "embedding", index: Index | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest for each query row.

    probes is the share of the lists that a query probes by codes (16 lists at least). It sets how near to the true ones the first neighbours are,
    and so how many rows the exact check reads.
    """
    kind = np.float32 if isinstance(rows.schema[vector].dataType.elementType, FloatType) else np.float64  # moved as they are given
    rows = durable(rows.select(F.col("vec_id").cast("long"), vector, is_query.alias("is_query")).filter("vec_id IS NOT NULL").dropDuplicates(["vec_id", vector]), "vectors")
    index = index or fit(rows, vector)
    width, cells = index.width, len(index.centroids)
    probed = min(cells, max(16, int(np.ceil(probes * cells))))
    of_list = max(32, k + 4 * -(-shortlist // max(1, probed)))
    whole = lambda column: fixed_width(pa.chunked_array(column), kind, width).astype(np.float64)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's id, list, distance to its centroid, code and components."""
        for batch in batches:
            x, at = matrix(batch.column(1), width)
            some = (x != 0).any(1)
            x, at = x[some], at[some]
            if not len(x) or not cells:
                continue
            cell = nearest(x, index.centroids)
            cols = [np.asarray(batch.column(0), np.int64)[at], np.asarray(batch.column(2).fill_null(False))[at], cell.astype(np.int32), distances(x, index.centroids[cell])]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), _bytes(index.encode(x, cell)), _bytes(x.astype(kind))], ["vec_id", "is_query", "cell", "off", "code", "x"])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each list that a query probes."""
        for batch in batches:
            ids, x = np.asarray(batch.column(0), np.int64), whole([batch.column(1)])
            for i in range(0, len(ids), 256):
                q = x[i : i + 256]
                near = np.argpartition(squared(q, index.centroids), probed - 1, 1)[:, :probed]
                who = np.repeat(np.arange(len(q)), probed)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(ids[i : i + 256][who]), _bytes(q[who].astype(kind))], ["cell", "query_id", "q"])

    everything = durable(rows.mapInArrow(assign, "vec_id long, is_query boolean, cell int, off double, code binary, x binary"), "lists")
    release(rows)
    asked = everything.filter("is_query").select("vec_id", "x")
    lists = {r["cell"]: r for r in everything.groupBy("cell").agg(F.count("*").alias("n"), F.min("off").alias("least"), F.max("off").alias("most")).collect()}  # a row a list
    q_parts = max(1, -(-asked.count() // part))
    by_cell = F.array(*[F.lit(-(-lists[c]["n"] // part) if c in lists else 1) for c in range(max(cells, 1))])
    own = F.pmod(F.xxhash64("vec_id"), F.get(by_cell, F.col("cell")))
    dealt = everything.select("cell", own.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q"), "vec_id", "off", "code", "x")
    to_lists = [
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.get(by_cell, F.col("cell")).cast("long") - 1)).alias("p"), F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int").alias("part"), "query_id", F.col("q").alias("x")
    ]
    queries = asked.mapInArrow(probe, "cell int, query_id long, q binary").select(*to_lists)

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _scan(index, int(key[0].as_py()), left, right, of_list, whole)

    rough = dealt.drop("off", "x").groupBy("cell", "p", "q").cogroup(queries.groupBy("cell", "p", "part")).applyInArrow(compare, "query_id long, vec_id long, rough float")
    best = Window.partitionBy("query_id").orderBy("rough", "vec_id")
    close = durable(rough.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= shortlist).select("query_id", "vec_id"), "close")
    both = close.join(everything.select("vec_id", "x"), "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), "query_id")

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = distances(whole([batch.column(2)]), whole([batch.column(3)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    def nearest_of(found: DataFrame) -> DataFrame:
        rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = durable(nearest_of(both.select("query_id", "vec_id", "x", "q").mapInArrow(exact, "query_id long, vec_id long, score double")), "first")
    bars = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bar"))
    least, most = (np.array([lists[c][name] if c in lists else empty for c in range(cells)]) for name, empty in (("least", np.inf), ("most", -np.inf)))

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each list that may hold a vector within a query's bar."""
        for batch in batches:
            ids, bar, x = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(2), np.float64), whole([batch.column(1)])
            for i in range(0, len(ids), 256):
                q, far = x[i : i + 256], bar[i : i + 256, None]
                off = np.sqrt(np.maximum(squared(q, index.centroids), 0))
                far = far + _margin(q, index.centroids)[:, None]
                who, cell = np.nonzero(~((off - far > most) | (off + far < least)) & (most >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(ids[i + who]), _bytes(q[who].astype(kind)), pa.array(bar[i + who])], ["cell", "query_id", "q", "bar"])

    def check(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _within(index.centroids[int(key[0].as_py())], left, right, k, whole)

    open_lists = asked.join(bars, "vec_id", "left").select("vec_id", "x", F.coalesce("bar", F.lit(float("inf"))).alias("bar"))
    open_lists = open_lists.mapInArrow(reach, "cell int, query_id long, q binary, bar double").select(*to_lists, "bar")
    nearer = dealt.drop("code").groupBy("cell", "p", "q").cogroup(open_lists.groupBy("cell", "p", "part")).applyInArrow(check, "query_id long, vec_id long, score double")
    return nearest_of(first.drop("rank").unionByName(nearer))


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _scan(index: Index, cell: int, left: pa.Table, right: pa.Table, few: int, whole: Callable) -> pa.Table:
    """Of one list's codes the few nearest to each query by the table of distances."""
    out: list[tuple[np.ndarray, ...]] = []
    if left.num_rows and right.num_rows:
        ids = np.asarray(left["vec_id"], np.int64)
        order = np.argsort(ids, kind="stable")
        ids, code = ids[order], fixed_width(left["code"], np.uint8, len(index.books))[order]
        qid, q = np.asarray(right["query_id"], np.int64), whole(right["x"].chunks)
        some = min(few, len(ids))
        for i in range(0, len(q), 64):
            score = sum(t[:, code[:, m]] for m, t in enumerate(index.tables(q[i : i + 64], cell))).astype(np.float32)
            score[qid[i : i + 64, None] == ids[None, :]] = np.inf
            near = np.argpartition(score, some - 1, 1)[:, :some] if some < len(ids) else np.broadcast_to(np.arange(len(ids)), score.shape)
            bar = np.take_along_axis(score, near, 1).max(1)
            for row in np.flatnonzero((score <= bar[:, None]).sum(1) > some):  # ties go to the smaller ids
                close = np.flatnonzero(score[row] < bar[row])
                near[row] = np.concatenate((close, np.flatnonzero(score[row] == bar[row])[: some - len(close)]))
            rough = np.take_along_axis(score, near, 1)
            r, c = np.nonzero(np.isfinite(rough))
            out.append((qid[i + r], ids[near[r, c]], rough[r, c]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)]
    return pa.table({"query_id": cols[0], "vec_id": cols[1], "rough": cols[2]})


def _margin(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """More than rounding can move a distance that is taken from squares, by query: rounding of a square goes with the lengths' squares."""
    return 1e-6 * (np.sqrt((q**2).sum(1)) + np.sqrt((c**2).sum(1).max(initial=0)))


def _within(centroid: np.ndarray, left: pa.Table, right: pa.Table, k: int, whole: Callable) -> pa.Table:
    """Of one list's vectors those within each query's bar, the k nearest at most: query_id, vec_id, score.

    Rows lie in the order of their distance to the centroid, so a block of queries reads one stretch of them. Of equal vectors k + 1 stay, as a
    query needs no more (one may be its own).
    """
    out: list[tuple[np.ndarray, ...]] = []
    if left.num_rows and right.num_rows:
        ids, off, x = np.asarray(left["vec_id"], np.int64), np.asarray(left["off"], np.float64), whole(left["x"].chunks)
        few = k + len(ids) - len(np.unique(ids))  # rows that share an id may give one answer together
        same = np.asarray(left["x"].combine_chunks().dictionary_encode().indices)
        order = np.lexsort((ids, same))
        at = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        order = order[at <= few]
        order = order[np.lexsort((ids[order], off[order]))]
        ids, off, x = ids[order], off[order], x[order]
        qid, bar, q = np.asarray(right["query_id"], np.int64), np.asarray(right["bar"], np.float64), whole(right["x"].chunks)
        own = distances(q, centroid)
        order = np.lexsort((qid, own))
        qid, bar, q, own = qid[order], bar[order], q[order], own[order]
        far = bar + _margin(q, centroid[None, :])
        length = (x**2).sum(1)
        slip = 1e-14 * (x.shape[1] + 16)  # of squares, by the lengths' squares
        for i in range(0, len(q), 64):
            some = slice(i, i + 64)
            a, b = np.searchsorted(off, (own[some] - far[some]).min()), np.searchsorted(off, (own[some] + far[some]).max(), side="right")
            if a == b:
                continue
            size = (q[some] ** 2).sum(1)
            slack = slip * (size + length[a:b].max())
            sq = size[:, None] - 2 * q[some] @ x[a:b].T + length[None, a:b]
            sq[qid[some, None] == ids[None, a:b]] = np.inf
            for row in range(len(sq)):
                close = np.flatnonzero(~(sq[row] > bar[i + row] ** 2 + slack[row]) & (ids[a:b] != qid[i + row]))
                if len(close) > few:
                    close = close[sq[row, close] <= np.partition(sq[row, close], few - 1)[few - 1] + 2 * slack[row]]
                if len(close):
                    score = distances(x[a:b][close], q[i + row])
                    best = np.lexsort((ids[a:b][close], score))
                    best = best[score[best] <= bar[i + row]][:few]
                    out.append((np.full(len(best), qid[i + row]), ids[a:b][close][best], score[best]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})


def op3_ivf_pq_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
