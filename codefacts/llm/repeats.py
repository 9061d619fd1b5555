"""Repeated passages by a sparse suffix array.

Of each document's suffixes (by word) only those at minimiser positions are retained: a position whose 40-word
gram has the least hash among 11 neighbouring ones. Any 50 words that two documents share hold such a position in
both, so about one suffix in six is enough. The retained suffixes are sorted over the whole corpus by their first 40 words
(by these words' hash, which is as good an order as any), then by document and position, in ranges; each is compared with
the first suffix of its run. Neighbouring hits on one diagonal (document, first document, shift) join to a match.

Matches are then extended left and right, against all documents and not only the first: every window of ``least`` words
that holds a match's first or last gram is sorted and compared in the same way. A window of 50 words that repeats holds a
retained gram; it holds the first or the last gram of that gram's match, or it lies inside the match. So the words that
are found are exactly those of all windows of ``least`` words that an earlier document has too. A text that repeats fewer
than ``gram`` + 1 words on and on is one suffix with a last position; two such runs of unlike length share all words if both
have ``least``, else their windows tell.

Words are runs of non-space bytes, A-Z in lower case. Matches inside one document do not count.

Edge cases: null, empty and short texts have no repeats; a null doc_id takes no part; repeated rows with one id
count as one document; of equal texts the smallest doc_id is the first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import _powers, bloom_has, doc_slices, durable, fixed_bloom, mix, part_by_ids, release, string_buffer, word_hashes, word_spans

LEAST, GRAM = 50, 40
SUFFIX = "key long, doc long, pos int, last int"
_BASE = 0xC2B2AE3D27D4EB4F | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k word hashes, by prefix sums."""
    n = len(words)
    if n < k:
        return words[:0]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _powers(_BASE_INV, n)[: n - k + 1])


def periods(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The smallest period of the n words from each of these positions on; n if there is none."""
    out = np.full(len(at), n)
    for i in range(0, len(at), 4096):
        w = words[at[i : i + 4096, None] + np.arange(n)]
        for p in range(n - 1, 0, -1):
            out[i : i + 4096][(w[:, p:] == w[:, :-p]).all(1)] = p
    return out


def _runs(words: np.ndarray, key: np.ndarray, doc: np.ndarray, where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, position, last position): one for each run in which grams of n words come again after their smallest period."""
    order = np.lexsort((where, key, doc))
    key, doc, where = key[order], doc[order], where[order]
    step = np.where((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]), where[1:] - where[:-1], n + 1)
    again = np.flatnonzero(step <= n)
    _, one, back = np.unique(key[again], return_index=True, return_inverse=True)
    begin = np.ones(len(key), bool)
    begin[again + 1] = step[again] != periods(words, where[again[one]], n)[back.ravel()]
    heads = np.flatnonzero(begin)
    return key[heads], doc[heads], where[heads], where[np.append(heads[1:], len(where))[: len(heads)] - 1]


def retained(words: np.ndarray, first: np.ndarray, least: int = LEAST, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, position in it, last position of its run) of the retained suffixes; first: where each document's words begin, and their end."""
    g = grams(words, k)
    lengths = np.diff(first)
    doc = np.repeat(np.arange(len(lengths)), np.maximum(lengths - least + 1, 0))
    if not len(doc):
        return g[:0], doc, doc, doc
    skipped = np.cumsum(np.minimum(lengths, least - 1))  # words that begin no window, of this and earlier documents
    at = np.arange(len(doc)) + np.concatenate(([0], skipped[:-1]))[doc]
    low, where = g[at], at.copy()
    for j in range(1, least - k + 1):
        other = g[at + j]
        less = other < low
        low[less], where[less] = other[less], at[less] + j
    new = np.concatenate(([True], where[1:] != where[:-1]))
    where, doc = where[new], doc[new]
    # a text with a short period holds one gram again and again: one suffix stands for such a run
    key, doc, where, last = _runs(words, g[where], doc, where, k)
    return key, doc, where - first[doc], last - first[doc]


def suffixes(docs: DataFrame, least: int, k: int) -> DataFrame:
    """key, doc, pos, last of each document's retained suffixes (doc, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in doc_slices(batch.column(1)):
                raw, offsets = string_buffer(batch.column(1).slice(i, j - i))
                starts, ends, first = word_spans(raw, offsets)
                key, doc, pos, last = retained(word_hashes(raw, starts, ends), first, least, k)
                yield _once(key, np.asarray(batch.column(0).slice(i, j - i), np.int64), doc, pos, last)

    return docs.mapInArrow(run, SUFFIX)


def _once(key: np.ndarray, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Suffixes as a batch; rows that repeat one document with its id give theirs once."""
    cols = [key.view(np.int64), ids[doc], pos.astype(np.int32), last.astype(np.int32)]
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        cols = [c[new] for c in cols]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "doc", "pos", "last"])


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one range of the sorted suffixes (key, doc, pos, last): each with the first of its run, if that is in another document.

    A run may have begun in an earlier range or go on in a later one. So all of the range's first run and the first suffix
    of its last run come with edge = true, and without a first one.
    """
    names = ["key", "doc", "pos", "last", "first_doc", "first_pos", "first_last", "edge"]
    start = last = None  # the key of the range's first run; the first suffix of the newest run
    for batch in batches:
        key, doc, pos, end = (np.asarray(c) for c in batch.columns)
        if not len(key):
            continue
        start = key[0] if start is None else start
        new = np.concatenate(([last is None or key[0] != last[0]], key[1:] != key[:-1]))
        heads, run = np.flatnonzero(new), np.cumsum(new) - 1
        d, p, q = (c[heads][run] if new[0] else np.append(o, c[heads])[run + 1] for o, c in zip(last[1:] if last else (0, 0, 0), (doc, pos, end), strict=True))
        last = (key[-1], d[-1], p[-1], q[-1])
        edge = key == start
        ok = (d != doc) | edge
        yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (key, doc, pos, end, d, p, q, edge)], names)
    if last is not None and last[0] != start:
        one = [np.array([x], t) for x, t in zip((*last, *last[1:]), (np.int64, np.int64, np.int32, np.int32, np.int64, np.int32, np.int32), strict=True)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, one), pa.array([True])], names)


def _compared(found: DataFrame, name: str) -> DataFrame:
    """doc, first_doc, shift, pos, last, end_shift, key of each suffix (key, doc, pos, last) whose run begins in another document.

    The suffixes are sorted over the whole corpus, by range, so a run that a third of them share is spread over many tasks.
    What ranges tell each other is at most two suffixes each.
    """
    rows = durable(found, "suffixes")
    order = ["key", "doc", "pos", "last"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = durable(ranges.mapInArrow(_heads, f"{SUFFIX}, first_doc long, first_pos int, first_last int, edge boolean"), "runs")
    edges = runs.filter("edge")
    first = edges.groupBy("key").agg(F.min(F.struct("doc", "pos", "last")).alias("f")).select("key", F.col("f.doc").alias("first_doc"), F.col("f.pos").alias("first_pos"), F.col("f.last").alias("first_last"))
    over = edges.select(*order).join(F.broadcast(first), "key").filter("doc <> first_doc")  # two rows a range at most
    hits = runs.filter("NOT edge").drop("edge").unionByName(over)
    out = durable(hits.select("doc", "first_doc", (F.col("first_pos") - F.col("pos")).alias("shift"), "pos", "last", (F.col("first_last") - F.col("last")).alias("end_shift"), "key"), name)
    release(rows, runs)
    return out


def _chains(k: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over hits sorted by document, first document, shift, position: runs whose grams touch, as (start, end) in words, and the keys of
        their first and last grams; a hit of unlike lengths stays alone. whole: whether all of it is shared in a run of ``least`` words."""
        names = ["doc", "first_doc", "shift", "start", "end", "end_shift", "whole", "first_key", "last_key"]
        held = None  # doc, first document, shift, position, last position, shift at the end, key, last key of the newest chain
        for batch in batches:
            doc, first, shift, pos, last, end_shift, key = (np.asarray(c, np.int64) for c in batch.columns)
            if not len(doc):
                continue
            last_key = key
            if held is not None:
                doc, first, shift, pos, last, end_shift, key, last_key = (np.append(o, c) for o, c in zip(held, (doc, first, shift, pos, last, end_shift, key, last_key), strict=True))
            uneven = shift != end_shift
            apart = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (shift[1:] != shift[:-1]) | uneven[1:] | uneven[:-1]
            heads = np.flatnonzero(np.concatenate(([True], apart | (pos[1:] > last[:-1] + k))))
            final = np.append(heads[1:], len(doc)) - 1
            top = np.maximum.reduceat(last, heads)
            chains = [doc[heads], first[heads], shift[heads], pos[heads], top, end_shift[heads], key[heads], last_key[final]]
            held = tuple(c[-1] for c in chains)  # it may go on in the next batch
            yield _chain_rows([c[:-1] for c in chains], k, least, names)
        if held is not None:
            yield _chain_rows([np.array([c]) for c in held], k, least, names)

    return run


def _chain_rows(chains: list[np.ndarray], k: int, least: int, names: list[str]) -> pa.RecordBatch:
    doc, first, shift, pos, last, end_shift, key, last_key = chains
    shared = np.minimum(last - pos, last - pos + end_shift - shift) + k
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, first, shift, pos, last + k, end_shift, shared >= least, key, last_key)], names)


def _windows(texts: DataFrame, keys: DataFrame, least: int, k: int) -> DataFrame:
    """key, doc, pos, last of each window of least words that holds one of these grams (a Bloom filter of fixed size: and of a few more)."""
    bloom = fixed_bloom(keys, "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in doc_slices(batch.column(1)):
                raw, offsets = string_buffer(batch.column(1).slice(i, j - i))
                starts, ends, first = word_spans(raw, offsets)
                words = word_hashes(raw, starts, ends)
                key, doc, pos, last = retained(words, first, least, k)
                some = bloom_has(bloom, key.view(np.int64))
                doc, pos, last = doc[some], pos[some], last[some]
                low, high = np.maximum(pos - (least - k), 0), np.minimum(last, np.diff(first)[doc] - least)
                n = np.maximum(high - low + 1, 0)
                at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
                place = np.unique(np.repeat(doc, n) << 40 | at)
                doc, at = place >> 40, place & ((1 << 40) - 1)
                ids, window = np.asarray(batch.column(0).slice(i, j - i), np.int64), grams(words, least)
                where = first[doc] + at
                key, doc, where, last = _runs(words, window[where], doc, where, least)
                yield _once(key, ids, doc, where - first[doc], last - first[doc])

    return texts.mapInArrow(run, SUFFIX)


def _matches(found: DataFrame, k: int, least: int, name: str) -> DataFrame:
    """Runs of touching grams on one diagonal, of suffixes (key, doc, pos, last) and the first of their run."""
    hits = _compared(found, f"{name}-hits")
    diagonals = hits.repartition("doc", "first_doc").sortWithinPartitions("doc", "first_doc", "shift", "pos", "last")
    out = durable(diagonals.mapInArrow(_chains(k, least), "doc long, first_doc long, shift long, start long, end long, end_shift long, whole boolean, first_key long, last_key long"), name)
    release(hits)
    return out


def repeated_passages(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, n_words, first_doc_id, first_start_word of each passage that an earlier document (by id) has too."""
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc"), "text")
    chains = _matches(suffixes(texts, least, gram), gram, least, "chains")
    # the ends: each window of least words over the first or last gram of a chain; what lies between them is in the chain
    ends = chains.select(F.explode(F.array("first_key", "last_key")).alias("key"))
    windows = _matches(_windows(texts, ends, least, gram), least, least, "windows")
    out = chains.filter("whole").unionByName(windows)
    return out.select(
        F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("first_doc").alias("first_doc_id"), (F.col("start") + F.col("shift")).alias("first_start_word")
    ).distinct()


def op10_sparse_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def cut(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """The documents without the passages' words; n_chars follows the text, and documents that lose all words go. Only documents with passages are shuffled."""
    spans = durable(passages.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "n_words")).alias("spans")), "spans")  # bounded by the document's words
    names = docs.columns
    kept = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(names)])  # whatever the columns are called
    at = {c: f"k{i}" for i, c in enumerate(names)}
    may, rest_rows = part_by_ids(kept, at["doc_id"], spans.select("doc_id"))
    touched = may.join(spans, may[at["doc_id"]] == spans["doc_id"], "left").drop("doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out: list[str | None] = []
            for text, spans in zip(texts, batch.column(1).to_pylist(), strict=True):
                if spans and text is not None:
                    raw, offsets = string_buffer(pa.array([text]))
                    starts, ends, _ = word_spans(raw, offsets)
                    drop = np.zeros(len(starts), bool)
                    for s in spans:
                        drop[s["start_word"] : s["start_word"] + s["n_words"]] = True
                    gone = np.zeros(len(raw) + 1, np.int8)
                    for w in np.flatnonzero(drop & ~np.concatenate(([False], drop[:-1]))):
                        stop = w + int(np.argmin(drop[w:])) if not drop[w:].all() else len(drop)
                        gone[starts[w]] += 1
                        gone[starts[stop] if stop < len(drop) else len(raw)] -= 1
                    keep = np.cumsum(gone[:-1]) == 0
                    text = raw[keep].tobytes().decode("utf-8", "ignore") if not drop.all() else None
                    out.append(text)
                else:
                    out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])

    rest = [at[c] for c in names if c != "text"]
    schema = ", ".join(["text string", *(f"{at[c]} {docs.schema[c].dataType.simpleString()}" for c in names if c != "text")])
    changed = touched.filter("spans IS NOT NULL").select(at["text"], "spans", *rest).mapInArrow(run, schema).filter("text IS NOT NULL").withColumnRenamed("text", at["text"])
    if "n_chars" in names:
        changed = changed.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    whole = rest_rows.unionByName(touched.filter("spans IS NULL").select(*at.values())).unionByName(changed.select(*at.values()))
    return whole.select(*[F.col(k).alias(c) for c, k in at.items()])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each passage stays in the first document (by id) that has it and is cut from the others."""
    return cut(docs, durable(repeated_passages(docs.select("doc_id", "text")), "passages"))
