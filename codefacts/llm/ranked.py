"""Ranked lexical search: summed accumulators of short lists, then documents at a time over long lists.

1. One pass over all texts keeps, of every document, how many terms it has and which of the asked terms it holds how
   often (``forward_index``, written once); a second job over that table sums document frequencies.
2. Tasks turn some thousand documents at a time into posting lists with their exact integer contributions. For each item
   the short lists are summed term at a time into accumulators. These then count as one more list with a bound, next to
   the long lists, which are read document at a time: a range of documents whose bounds can't reach the item's k-th best
   score is skipped; in the others only essential lists (those without which the score can't be reached) name
   candidates, and candidates are dropped as soon as what is left to add can't save them.
3. A task holds the k best of each item and hands them on at its end; the k best of all tasks are found in two steps.

All sums are 64-bit integers, so pruning loses nothing, ties included. Items are asked in chunks of at most
``chunk`` different (item, term) pairs (one longer item is a chunk of its own), each a pass of its own over the documents, so what is
sent to tasks doesn't grow with the items.

Terms are found by 64-bit hashes and then compared byte by byte.

Edge cases: documents without a term (null, empty, marks only) count nowhere; items without a term that occurs have no rows;
item rows that repeat an item_id are one item with the terms of all; rows that repeat a doc_id are documents of their
own; a null doc_id comes last among equal scores; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import doc_slices, durable, give_back, release, string_buffer, word_hashes, word_spans

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K, CHUNK, BLOCK_DOCS, BLOCK_POSTINGS, RANGE, SHORT = 10, 1 << 18, 1 << 14, 1 << 22, 1 << 9, 1 << 9
#: bytes that no term has
_PART = np.ones(256, bool)
_PART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

Batches = Iterable[pa.RecordBatch]


class Vocabulary:
    """The asked terms, found in batches of text."""

    def __init__(self, terms: list[str]):
        raw, offsets = string_buffer(pa.array(terms, pa.string()))
        hashes = word_hashes(raw, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.raw, self.start = hashes[self.order], raw, offsets[:-1][self.order]
        self.size = np.diff(offsets)[self.order]
        #: most terms with one hash
        self.alike = int(np.unique(hashes, return_counts=True)[1].max()) if terms else 0

    def find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are asked terms, and which ones."""
        spans, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        hashes = word_hashes(raw, starts, ends)
        first = np.searchsorted(self.hashes, hashes)
        for shift in range(self.alike):
            at = np.minimum(first + shift, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == hashes) & (self.size[at] == ends - starts))
            size = self.size[at[hit]]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            text = raw[np.repeat(starts[hit], size) + inside]
            lower = np.where((text >= 65) & (text <= 90), text + 32, text)
            differs = np.concatenate([[0], np.cumsum(lower != self.raw[np.repeat(self.start[at[hit]], size) + inside])])
            ends_of = np.cumsum(size)
            same = differs[ends_of] == differs[ends_of - size]
            spans.append(hit[same])
            found.append(self.order[at[hit[same]]])
        return np.concatenate(spans), np.concatenate(found)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term)."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col("item_id"), F.explode(words).alias("term")).distinct()


def forward_index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of the asked ones, ascending) and tfs of each document that has a term."""
    asked, v = Vocabulary(terms), len(terms)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in doc_slices(batch.column(1)):
                raw, offsets = string_buffer(batch.column(1).slice(i, j - i))
                starts, ends, first = word_spans(raw, offsets, _PART)
                n = np.diff(first)
                span, term = asked.find(raw, starts, ends)
                doc = np.searchsorted(first, span, side="right") - 1
                keys, tf = np.unique(doc * max(v, 1) + term, return_counts=True)
                cuts = np.searchsorted(keys, np.arange(len(n) + 1) * max(v, 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (keys % max(v, 1), tf)]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def frequencies(index: DataFrame, v: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and the document frequency of each asked term."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        df = np.zeros(v, np.int64)
        for batch in batches:
            df += np.bincount(np.asarray(batch.column(0).flatten(), np.int64), minlength=v)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    total = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    rows = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each asked term
    df = np.zeros(v, np.int64)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return total["docs"], total["terms"] or 0, df


class Best:
    """The k best documents of an item so far: score, whether the id is null, id."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, scores: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([scores, unknown, ids], 1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))[: self.k]]

    def bar(self) -> int:
        """What a score must reach to matter."""
        return int(self.rows[-1, 0]) if len(self.rows) == self.k else 1


class Block:
    """Posting lists of some thousand documents with the contributions of all postings, and their maxima by ranges of documents."""

    def __init__(self, ids: np.ndarray, unknown: np.ndarray, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs: int, total: int):
        self.ids, self.unknown = ids, unknown
        doc = np.repeat(np.arange(len(n)), counts)
        m = 10 + (90 * n * docs) // max(total, 1)
        order = np.argsort(terms, kind="stable")
        self.term, self.doc = terms[order], doc[order]
        tf = tfs[order].astype(np.int64)
        self.gain = weights[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc]))
        self.at = np.searchsorted(self.term, np.arange(len(weights) + 1))
        self.ranges = -(-len(n) // RANGE)
        cell = self.term.astype(np.int64) * self.ranges + self.doc // RANGE
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell, self.cell_at = cell[first], np.append(first, len(cell))
        self.cell_most = np.maximum.reduceat(self.gain, first) if len(first) else np.zeros(0, np.int64)

    def search(self, terms: np.ndarray, best: Best) -> None:
        size = self.at[terms + 1] - self.at[terms]
        terms, size = terms[size > 0], size[size > 0]
        # term at a time: short lists summed into accumulators
        acc = np.zeros(self.ranges * RANGE, np.int64)
        for t in terms[size <= SHORT]:
            some = slice(self.at[t], self.at[t + 1])
            acc[self.doc[some]] += self.gain[some]
        bar = best.bar()
        if np.count_nonzero(acc) >= best.k:
            bar = max(bar, int(np.partition(acc, -best.k)[-best.k]))
        # the accumulators are list 0 from here on; bounds of every list in every range
        long = terms[size > SHORT]
        bounds = np.zeros((len(long) + 1, self.ranges), np.int64)
        bounds[0] = acc.reshape(-1, RANGE).max(1)
        parts = np.zeros((len(long) + 1, self.ranges, 2), np.int64)
        for i, t in enumerate(long, 1):
            a, b = np.searchsorted(self.cell, [t * self.ranges, (t + 1) * self.ranges])
            r = self.cell[a:b] - t * self.ranges
            bounds[i, r] = self.cell_most[a:b]
            parts[i, r, 0], parts[i, r, 1] = self.cell_at[a:b], self.cell_at[a + 1 : b + 1]
        reach = bounds.sum(0)
        for r in np.argsort(-reach, kind="stable"):  # promising ranges first, so that the bar is high for the others
            if reach[r] < bar:
                break
            self._range(r, bounds[:, r], parts[:, r], acc[r * RANGE : (r + 1) * RANGE], bar, best)
            bar = max(bar, best.bar())

    def _range(self, r: int, bounds: np.ndarray, parts: np.ndarray, acc: np.ndarray, bar: int, best: Best) -> None:
        """Candidates from the essential lists of a range; the others are looked up for those that may still reach the bar."""
        order = np.argsort(bounds, kind="stable")
        below = np.cumsum(bounds[order])  # what this list and all lesser ones can add
        essential = int(np.searchsorted(below, bar))  # the lists before it can't reach the bar together
        scores, named = np.zeros(RANGE, np.int64), np.zeros(RANGE, bool)
        for i in order[essential:]:
            if i:
                some = slice(parts[i, 0], parts[i, 1])
                at = self.doc[some] - r * RANGE
                scores[at] += self.gain[some]
                named[at] = True
            else:
                scores += acc
                named |= acc > 0
        docs = np.flatnonzero(named)
        left = scores[docs]
        for rank in range(essential - 1, -1, -1):
            alive = left + below[rank] >= bar
            docs, left = docs[alive], left[alive]
            if not len(docs):
                return
            i = order[rank]
            if not i:
                left = left + acc[docs]
            elif parts[i, 1] > parts[i, 0]:
                listed = self.doc[parts[i, 0] : parts[i, 1]]
                at = np.minimum(np.searchsorted(listed, docs + r * RANGE), len(listed) - 1)
                left = left + np.where(listed[at] == docs + r * RANGE, self.gain[parts[i, 0] + at], 0)
        keep = left >= bar
        docs, left = docs[keep] + r * RANGE, left[keep]
        best.add(left, self.unknown[docs], self.ids[docs])


def blocks(batches: Batches, most_docs: int, most_postings: int) -> Iterator[tuple]:
    """Columns of (doc_id, n, terms, tfs) batches put together to blocks."""
    held: list[pa.RecordBatch] = []
    docs = postings = 0

    def joined() -> tuple:
        ids, n, terms, tfs = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in range(4))
        known = np.asarray(ids.is_valid())
        return np.asarray(ids.fill_null(0), np.int64), (~known).astype(np.int64), np.asarray(n, np.int64), np.asarray(terms.value_lengths(), np.int64), np.asarray(terms.flatten(), np.int64), np.asarray(tfs.flatten(), np.int64)

    for batch in batches:
        for i in range(0, batch.num_rows, most_docs):
            part = batch.slice(i, most_docs)
            if held and (docs + part.num_rows > most_docs or postings > most_postings):
                yield joined()
                held, docs, postings = [], 0, 0
            held.append(part)
            docs, postings = docs + part.num_rows, postings + len(part.column(2).flatten())
    if docs:
        yield joined()


def _asked(items: DataFrame, chunk: int) -> Iterator[list[tuple]]:
    """Chunks of items as (item_id, its terms), read one partition at a time in the order of ids."""
    out: list[tuple] = []
    n, item = 0, object()
    for row in item_terms(items).orderBy("item_id", "term").toLocalIterator():
        if row["item_id"] != item:
            if n >= chunk:
                yield out
                out, n = [], 0
            item = row["item_id"]
            out.append((item, []))
        out[-1][1].append(row["term"])
        n += 1
    if out:
        yield out


def _best(docs: DataFrame, asked: list[tuple], kind: str, k: int) -> DataFrame:
    """The k best documents of each item in every task."""
    terms = sorted({t for _, ts in asked for t in ts})
    number = {t: i for i, t in enumerate(terms)}
    lists = [np.array([number[t] for t in ts], np.int64) for _, ts in asked]
    items = pa.array([i for i, _ in asked])
    index = durable(forward_index(docs, terms), "terms-of-documents")
    n_docs, total, df = frequencies(index, len(terms))
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in lists]
        for columns in blocks(batches, BLOCK_DOCS, BLOCK_POSTINGS):
            block = Block(*columns, weights, n_docs, total)
            for ts, b in zip(lists, best, strict=True):
                block.search(ts, b)
        rows = np.concatenate([np.zeros((0, 3), np.int64), *[b.rows for b in best]])
        at = np.repeat(np.arange(len(best)), [len(b.rows) for b in best])
        ids = pa.array(rows[:, 2], pa.int64(), mask=rows[:, 1] == 1)
        yield pa.RecordBatch.from_arrays([items.take(pa.array(at)), ids, pa.array(rows[:, 0])], ["item_id", "doc_id", "score"])
        give_back()

    found = durable(index.mapInArrow(run, f"item_id {kind}, doc_id long, score long"), "best-of-tasks")
    release(index)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = K, chunk: int = CHUNK) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = [_best(docs, asked, kind, k) for asked in _asked(items, chunk)]
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    # an item has k rows of each task: groups of tasks first
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "some"], ["item_id"]):
        rows = rows.withColumn("some", F.spark_partition_id() % 64) if "some" in keys else rows
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return rows.select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def op13_hybrid_ranked_search(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs.select("doc_id", "text"), items.select("item_id", "text"))


_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"
ORACLE = f"""
WITH q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark)),
w AS (SELECT r, doc_id, unnest(words) AS term FROM (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents)),
ns AS (SELECT r, count(*) AS n FROM w GROUP BY r),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM ns),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM tf, g GROUP BY term, docs),
s AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN weights USING (term) JOIN ns USING (r), g GROUP BY item_id, r, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {K}
"""
