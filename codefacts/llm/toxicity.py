"""Toxicity by a subsequence string kernel SVM with Nyström landmarks.

The kernel of two words sums, over all subsequences of three characters that they share, a weight that
shrinks with the gaps in either word; it is normalised to 1 for equal words. So ``idiot``, ``id-iot`` and
``idxiot`` stay close. A word that holds all of a landmark's characters in order with others between them, as
``i1d1i1o1t``, counts at least by how many these are: nearly in full up to one at each position, half at 1.5 times the landmark's length,
then fast to nothing. A text's kernel with a landmark is the largest over
its words (also without the marks inside them, as in
``i.d.i.o.t``, and over runs of single letters joined, as in ``i d i o t``). Landmarks are the words that mark
toxic rows in the labelled sample, and the clean words most like them; the SVM is linear in the Nyström
coordinates, and a sigmoid turns its margin into a score.

Training reads the texts of at most ``per_class`` labelled ids of each class (a documented bound); scoring reads every whole
text and nothing but the text. A word takes part for a landmark only if it holds 3 in 4 of the landmark's
distinct letters and half of its pairs of neighbours, or all of it in order; words over 24 bytes are read in overlapping parts.

Edge cases: null and empty texts score as texts without words; equal texts score alike; without labelled rows
of both classes every score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import _LOWER, crc_of, doc_slices, mix, string_buffer, text_rows, word_spans
from codefacts.llm.linear import fit_sigmoid, fit_svm, sigmoid

ORDER, DECAY, WIDTH, STRIDE = 3, 0.8, 24, 12
#: a power of a kernel is a kernel; this one sets apart words that only share an ending
POWER = 3
#: so many characters put in for each of a landmark's halve the value of a word that holds all of it in order
GAPS = 1.5
THRESHOLD = 0.7
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_BIT = np.zeros(256, np.uint64)
for _b in range(256):
    if 97 <= _b < 123:
        _BIT[_b] = 1 << (_b - 97)
    elif _b >= 128:
        _BIT[_b] = 1 << (26 + _b % 38)


def kernel(words: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Unnormalised kernels of rows of words (n x w bytes, padded by 0) with other: one word (m bytes) or a row for each."""
    n, w = words.shape
    other = np.broadcast_to(other, (n, other.shape[-1]))
    m = other.shape[1]
    same = [(words == other[:, j : j + 1]) & (words != 0) for j in range(m)]
    before = np.ones((m + 1, w + 1, n), np.float32)  # order 0
    gap = np.float32(DECAY)
    for order in range(1, ORDER):
        now = np.zeros((m + 1, w + 1, n), np.float32)
        for a in range(w):
            run = np.zeros(n, np.float32)
            for j in range(m):
                run = gap * run + np.where(same[j][:, a], gap * gap * before[j, a], 0)
                now[j + 1, a + 1] = gap * now[j + 1, a] + run
        before = now
    total = np.zeros(n, np.float32)
    for a in range(w):
        for j in range(m):
            total += np.where(same[j][:, a], gap * gap * before[j, a], 0)
    return total


def padded(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """The words' bytes as rows of WIDTH, padded by 0; by blocks, as the indices take eight times the room of the bytes."""
    out = np.zeros((len(starts), WIDTH), np.uint8)
    for i in range(0, len(starts), block):
        a, b = starts[i : i + block], ends[i : i + block]
        at = a[:, None] + np.arange(WIDTH)
        out[i : i + block] = np.where(at < b[:, None], raw[np.minimum(at, len(raw) - 1)], 0)
    return out


def _rows(words: list[bytes]) -> np.ndarray:
    """Words as rows of WIDTH bytes, padded by 0."""
    out = np.zeros((len(words), WIDTH), np.uint8)
    for i, w in enumerate(words):
        out[i, : len(w)] = np.frombuffer(w, np.uint8)
    return out


def normalised(words: np.ndarray, other: np.ndarray, self_words: np.ndarray | None = None) -> np.ndarray:
    own = kernel(words, words) if self_words is None else self_words
    unit = float(kernel(other[None, :], other[None, :])[0])
    return kernel(words, other) / np.sqrt(np.maximum(own * unit, 1e-12))


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text) of what is compared: words trimmed to letters and digits, in parts of WIDTH, and joined runs of single letters."""
    low = _LOWER[raw]
    starts, ends, first = word_spans(raw, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    good = np.flatnonzero(_WORD_BYTE[raw])
    if not len(good):
        return low, starts[:0], ends[:0], text[:0]
    a = good[np.minimum(np.searchsorted(good, starts), len(good) - 1)]
    b = good[np.maximum(np.searchsorted(good, ends) - 1, 0)] + 1
    keep = (a >= starts) & (b <= ends) & (b > a)
    single = keep & (b - a == 1)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], single, [False])).astype(np.int8)))
    a, b, t = a, b, text
    extra, extra_a, extra_b, extra_t, end = [], [], [], [], len(low)
    for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        for lo in range(i, j, 1):  # a run may go over texts
            if lo == i or text[lo] != text[lo - 1]:
                hi = lo
                while hi < j and text[hi] == text[lo]:
                    hi += 1
                if hi - lo > ORDER:
                    joined = low[a[lo:hi]]
                    extra.append(joined)
                    extra_a.append(end)
                    end += len(joined)
                    extra_b.append(end)
                    extra_t.append(text[lo])
    a, b, t = a[keep], b[keep], t[keep]
    inner = np.flatnonzero(_inner_marks(raw, a, b))
    if len(inner):  # the same words without the marks inside them
        inside = np.zeros(len(raw) + 1, np.int8)
        np.add.at(inside, a[inner], 1)
        np.add.at(inside, b[inner], -1)
        kept = np.flatnonzero(np.cumsum(inside[:-1]).astype(bool) & _WORD_BYTE[raw])
        bare = end + np.searchsorted(kept, a[inner]), end + np.searchsorted(kept, b[inner])
        a, b, t = np.append(a, bare[0]), np.append(b, bare[1]), np.append(t, t[inner])
        extra.append(low[kept])
    if extra_a:
        a, b, t = np.append(a, extra_a), np.append(b, extra_b), np.append(t, extra_t)
    if extra:
        low = np.concatenate([low, *extra])
    long = np.flatnonzero(b - a > WIDTH)
    if len(long):
        parts = [np.arange(a[i], max(a[i] + 1, b[i] - STRIDE), STRIDE) for i in long]
        n = [len(p) for p in parts]
        pa_, pe, pt = np.concatenate(parts), np.repeat(b[long], n), np.repeat(t[long], n)
        rest = np.delete(np.arange(len(a)), long)
        a, b, t = np.append(a[rest], pa_), np.append(b[rest], np.minimum(pa_ + WIDTH, pe)), np.append(t[rest], pt)
    return low, a.astype(np.int64), b.astype(np.int64), t.astype(np.int64)


def _inner_marks(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words (trimmed) hold bytes that belong to no word."""
    marks = np.concatenate(([0], np.cumsum(~_WORD_BYTE[raw])))
    return marks[b] - marks[a] > 0


def _masks(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each padded word a set of its letters and one of its pairs of neighbouring bytes, as 64 bits each."""
    two = words[:, :-1].astype(np.uint64) * np.uint64(0x9E3779B1) + words[:, 1:].astype(np.uint64) * np.uint64(0x85EBCA6B)
    pair = np.where((words[:, :-1] != 0) & (words[:, 1:] != 0), np.uint64(1) << (mix(two) >> np.uint64(58)), np.uint64(0))
    return np.bitwise_or.reduce(_BIT[words], 1), np.bitwise_or.reduce(pair, 1)


def _gapped(words: np.ndarray, lengths: np.ndarray, letters: np.ndarray, marks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, landmark) where a word holds all of a longer landmark's bytes in order, with others between them."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ended = np.concatenate((marks, np.zeros((len(marks), 1), np.uint8)), 1)
    for k, own in enumerate(_masks(marks)[0]):
        w = np.flatnonzero((letters & own == own) & (lengths > sizes[k]))
        at = np.zeros(len(w), np.int64)
        for a in range(WIDTH):
            byte = words[w, a]
            at += (byte == ended[k, at]) & (byte != 0)
        w = w[at == sizes[k]]
        # where they stand together nothing was put in between
        m = sizes[k]
        whole = np.zeros(len(w), bool)
        for a in range(WIDTH - m + 1):
            whole |= (words[w, a : a + m] == marks[k, :m]).all(1)
        found.append((w[~whole], np.full((~whole).sum(), k)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def pooled(raw: np.ndarray, offsets: np.ndarray, landmarks: list[bytes]) -> np.ndarray:
    """For each text and landmark the largest normalised kernel of any of its words."""
    out = np.zeros((len(offsets) - 1, len(landmarks)), np.float32)
    low, a, b, t = units(raw, offsets)
    long_enough = b - a >= ORDER
    a, b, t = a[long_enough], b[long_enough], t[long_enough]
    if not len(a) or not landmarks:
        return out
    rows = padded(low, a, b)
    parts = rows.view(np.uint64)
    _, first, back = np.unique(mix(parts[:, 0] + mix(parts[:, 1] + mix(parts[:, 2]))), return_index=True, return_inverse=True)
    words, lengths = rows[first], (b - a)[first]
    letters, pairs = _masks(words)
    near = []
    for l in landmarks:
        own_letters, own_pairs = (int(m[0]) for m in _masks(np.frombuffer(l, np.uint8)[None, :]))
        near.append((np.bitwise_count(letters & np.uint64(own_letters)) >= -(-3 * own_letters.bit_count() // 4)) & (2 * np.bitwise_count(pairs & np.uint64(own_pairs)).astype(int) >= own_pairs.bit_count()))
    marks = _rows(landmarks)
    sizes = np.array([len(l) for l in landmarks])
    gap_word, gap_mark = _gapped(words, lengths, letters, marks, sizes)
    some = np.logical_or.reduce(near)
    some[gap_word] = True
    if not some.any():
        return out
    value = np.zeros((len(first), len(landmarks)), np.float32)
    word, mark = np.nonzero(np.stack(near, 1))
    unit = kernel(marks, marks)
    used, at = np.unique(word, return_inverse=True)
    own = np.zeros(len(used), np.float32)
    for lo in range(4, WIDTH + 4, 4):  # words of like length together, and with them landmarks of like length
        mine = np.flatnonzero((lengths[used] > lo - 4) & (lengths[used] <= lo))
        for i in range(0, len(mine), 4096):
            w = words[used[mine[i : i + 4096]]][:, :lo]
            own[mine[i : i + 4096]] = kernel(w, w)
        here = (lengths[word] > lo - 4) & (lengths[word] <= lo)
        for size in range(4, WIDTH + 4, 4):
            both = np.flatnonzero(here & (sizes[mark] > size - 4) & (sizes[mark] <= size))
            for i in range(0, len(both), 8192):
                r = both[i : i + 8192]
                value[word[r], mark[r]] = kernel(words[word[r]][:, :lo], marks[mark[r]][:, :size]) / np.sqrt(np.maximum(own[at[r]] * unit[mark[r]], 1e-12))
    value **= POWER
    value[gap_word, gap_mark] = np.maximum(value[gap_word, gap_mark], 1 / (1 + ((lengths[gap_word] / sizes[gap_mark] - 1) / GAPS) ** 4))
    back = back.ravel()
    hits = np.flatnonzero(some[back])
    np.maximum.at(out, t[hits], value[back[hits]])
    return out


class Model:
    def __init__(self, landmarks: list[bytes], x: np.ndarray, y: np.ndarray):
        self.landmarks = landmarks
        self.ready = bool(landmarks) and (y > 0).any() and (y <= 0).any()
        if not self.ready:
            return
        rows = _rows(landmarks)
        raw = np.stack([kernel(rows, r[None, :]) for r in rows]).astype(np.float64)
        gram = (raw / np.sqrt(np.maximum(np.outer(np.diag(raw), np.diag(raw)), 1e-12))) ** POWER
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        self.root = vectors @ np.diag(np.maximum(values, 1e-2) ** -0.5) @ vectors.T
        z = x @ self.root
        self.w, self.b = fit_svm(z, np.where(y > 0, 1.0, -1.0), c=2000.0, rounds=400)
        self.a, self.c = fit_sigmoid(z @ self.w + self.b, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * (x @ self.root @ self.w + self.b) + self.c) if self.ready else np.zeros(len(x))


def _sample(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int) -> DataFrame:
    """(text, toxic) of at most per_class labelled ids of each class, those with the least hashes of doc_id; of equal texts one."""
    known = labels.filter(may_learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one, none = (known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (1, 0))
    chosen = one.union(none)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text IS NOT NULL").groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def find_landmarks(sample: DataFrame, most: int = 96, negatives: int = 8) -> list[bytes]:
    """Words that mark toxic rows (by the z value of the difference of shares), then the frequent clean words most like them."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), "[\\x20\\x09-\\x0D]+"))).alias("w"))
    words = words.select("toxic", F.regexp_replace("w", "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "").alias("w")).filter(F.octet_length("w").between(ORDER + 1, WIDTH))
    seen = words.groupBy("w").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    p = (F.col("c1") + F.col("c0") + 1) / float(n1 + n0 + 2)
    z = (F.col("c1") / float(n1) - F.col("c0") / float(n0)) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    ranked = seen.withColumn("z", z)
    top = ranked.filter("c1 >= 3 AND z >= 5").orderBy(F.desc("z"), "w").limit(most).collect()
    good = [r["w"].encode() for r in top]
    if not good:
        return []
    clean = [r["w"].encode() for r in ranked.filter("c0 >= 2 AND z < 1").orderBy(F.desc("c0"), "w").limit(3000).collect()]
    if clean:
        rows = _rows(clean)
        own = kernel(rows, rows)
        like = np.max([normalised(rows, np.frombuffer(g, np.uint8), own) for g in good], 0)
        good += [clean[i] for i in np.argsort(-like, kind="stable")[:negatives] if like[i] > 0.05]
    return good


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, per_class: int = 1500) -> Model:
    sample = _sample(docs, labels, may_learn, per_class).cache()
    try:
        landmarks = find_landmarks(sample)

        def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, j in doc_slices(batch.column(0)):
                    x = pooled(*string_buffer(batch.column(0).slice(i, j - i)), landmarks)
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], ["toxic", "x"])

        rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(features, "toxic int, x binary").toArrow()
    finally:
        sample.unpersist()
    x = np.array([np.frombuffer(v, np.float32) for v in rows["x"].to_pylist()], np.float64).reshape(rows.num_rows, len(landmarks))
    return Model(landmarks, x, np.array(rows["toxic"].to_pylist(), float))


def score_texts(docs: DataFrame, model: Model, keep: list[str], below: float | None = None) -> DataFrame:
    """The columns named in keep with toxic_score; with below, only rows under that score, without the score."""
    rows, at, ddl = text_rows(docs, keep)
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in doc_slices(batch.column(at)):
                part = batch.slice(i, j - i)
                s = model.score(pooled(*string_buffer(part.column(at)), model.landmarks).astype(np.float64))
                if below is not None:
                    yield part.select(part.schema.names[:n]).filter(pa.array(s < below, pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(s)], [*part.schema.names[:n], "toxic_score"])

    out = rows.mapInArrow(run, ddl if below is not None else f"{ddl}, toxic_score double")
    return out.toDF(*keep) if below is not None else out.toDF(*keep, "toxic_score")


def op8_string_kernel_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = F.pmod(crc_of(F.col("doc_id")), F.lit(3)) == 1
    model = train(docs, labels, ~held_out)
    return score_texts(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score reaches THRESHOLD go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_texts(docs, train(docs, labels, F.lit(True)), docs.columns, below=THRESHOLD)
