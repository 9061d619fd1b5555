"""Cross-tokenizer alignment: token groups of two tokenizers, and counts of linked id pairs behind a minimal perfect hash.

A reads a space and the text (byte-level BPE), B reads the text and adds that space itself (SentencePiece). Where tokens of
both end at one byte the text is cut into groups; the two tokens that end there are linked. Both tokenizers begin anew
at a single space before a word, so every task aligns each distinct stretch between such spaces once (it forgets them
at a fixed number), and documents are put together from stretches.

1. First pass: every task counts the pairs of its documents; the distinct ones are dealt to segments by hash, and each
   segment gets a minimal perfect hash (levels of bit vectors in which keys that collide move on to the next level).
2. Counts: tasks lay their counts into dense vectors indexed by the hash; these are summed as a tree, sixteen at a time.
3. Second pass: documents are aligned again, and each link's count is looked up in the vector. The key that is stored at
   the hash's index is compared with the pair, so a pair that was never counted has count 0.

Up to ``most`` distinct pairs (about 20 bytes for each) hash, keys and counts are sent to all tasks. Beyond, each
document's distinct pairs are joined to the summed counts by equality, which AQE splits where a pair is frequent.

Edge cases: a text that is null, empty or not given back by a tokenizer's bytes (U+2581 in it) has zeros and an empty digest,
and none of its links count; every row of a repeated one is counted; texts of any length are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import U, doc_slices, durable, give_back, mix, release

A, B = "byte_bpe_50k", "piece_bpe_32k.model"
#: a space that follows another character than a space and stands before one that isn't white
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
ODD = re.compile(r" \s")
#: stretches and characters that a task keeps, stretches that are read as one text
KEPT, KEPT_CHARS, JOINED = 400_000, 1 << 23, 1 << 9
MOST, SEGMENT, VECTOR, FAN_IN = 4_000_000, 1 << 14, 1 << 16, 16
DIGEST = "n_a long, n_b long, n_groups long, n_links long"


@lru_cache(maxsize=1)
def tokenizers(a: str, b: str):
    """(A's ids of a string, B's ids of many, bytes of A's tokens, bytes of B's tokens)."""
    import json

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from codefacts.llm.packing import LONG_RUN, encoder

    path = public_tokenizers.path(f"{a}.json")
    own, fast = Tokenizer.from_file(path), encoder(a)[1]
    own.encode_special_tokens = True
    # byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(sorted(set(range(256)) - set(printable)))}
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    bytes_a = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items() if all(c in byte_of for c in token)}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
    n = model.vocab_size()
    names = [model.id_to_piece(i) for i in range(n)]
    bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def ids_a(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids if LONG_RUN.search(text) else fast.encode_ordinary(text)

    return ids_a, lambda texts: model.encode(texts, num_threads=1), bytes_a, bytes_b


def stretches(text: str) -> list[str]:
    """What stands between the spaces at which both tokenizers begin anew; a space goes before each."""
    if text[0] == " " or text[-1] == " " or "  " in text or ODD.search(text):
        return CUT.split(text)
    return text.split(" ")


class Reader:
    """Two tokenizers, and what lines up of stretches that both have read; with the groups as text if these are wanted."""

    def __init__(self, a: str, b: str, with_groups: bool):
        self.ids_a, self.ids_b, bytes_a, self.bytes_b = tokenizers(a, b)
        self.width = len(self.bytes_b)
        self.size_a = np.array([len(bytes_a.get(i, b"")) for i in range(max(bytes_a) + 1)])
        self.size_b = np.array(list(map(len, self.bytes_b)))
        n = len(self.size_a)
        # A's id before another of its group or before B's ids; B's before another, at the end of a group or of a stretch
        self.written = [f"{i}{m}" for i in range(n) for m in ",|"] + [f"{i}{m}" for i in range(self.width) for m in (",", ";", "\n")] if with_groups else None

    def read(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """For each stretch n_a, n_b, links and whether its bytes differ; the linked pairs of all; and each one's groups as text.

        Stretches are joined by the spaces that part them, some hundred at a time, and read as one text. Where other white
        space stands beside such a space, each is read by itself.
        """
        parts = [(np.zeros((0, 4), np.int64), np.zeros(0, np.int64), [])]
        for i in range(0, len(new), JOINED):
            some = new[i : i + JOINED]
            text = " ".join(some)
            plain = text.count(" ") == len(some) - 1 and not (text[:1].isspace() or text[-1:].isspace() or "  " in text or ODD.search(text))
            parts += [self._joined(some, text)] if plain else [self._joined([w], w) for w in some]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), list(chain.from_iterable(p[2] for p in parts))

    def _joined(self, words: list[str], text: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
        raw = (" " + text).encode()
        a, b = np.asarray(self.ids_a(" " + text), np.int64), self.ids_b([text])[0]
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            if len(words) == 1:
                return np.array([[0, 0, 0, 1]]), np.zeros(0, np.int64), [""]
            singly = [self._joined([w], w) for w in words]
            return np.concatenate([p[0] for p in singly]), np.concatenate([p[1] for p in singly]), list(chain.from_iterable(p[2] for p in singly))
        b = np.asarray(b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.array([len(raw)]) if len(words) == 1 else np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[1:], len(raw))
        # no token is empty, so an end comes once
        both = np.zeros(len(raw) + 1, bool)
        both[ends_b] = True
        at_a = np.flatnonzero(both[ends_a])
        at_b = np.searchsorted(ends_b, ends_a[at_a])
        rows = np.zeros((len(words), 4), np.int64)
        for column, x in enumerate((ends_a, ends_b, ends_a[at_a])):
            rows[:, column] = np.diff(np.searchsorted(x, ends, side="right"), prepend=0)
        pairs = a[at_a] * self.width + b[at_b]
        if self.written is None:
            return rows, pairs, []
        written_a, written_b = 2 * a, 2 * len(self.size_a) + 3 * b
        written_a[at_a] += 1
        written_b[at_b] += 1
        written_b[np.searchsorted(ends_b, ends)] += 1
        # A's ids of a group stand before B's
        out = np.zeros(len(a) + len(b), np.int64)
        group_a, group_b = np.searchsorted(at_a, np.arange(len(a))), np.searchsorted(at_b, np.arange(len(b)))
        out[np.arange(len(a)) + np.append(0, at_b + 1)[group_a]] = written_a
        out[np.arange(len(b)) + (at_a + 1)[group_b]] = written_b
        return rows, pairs, "".join(map(self.written.__getitem__, out.tolist()))[:-1].split("\n")


@lru_cache(maxsize=2)
def reader(a: str, b: str, with_groups: bool) -> Reader:
    return Reader(a, b, with_groups)


@lru_cache(maxsize=1)
def stretches_of_worker(a: str, b: str, table: str | None) -> Stretches:
    """What a Python worker has seen lately, over all of its tasks: one for each counting (table: its name) or for the first pass."""
    return Stretches(a, b, table is not None)


class Stretches:
    """The alignments of the stretches that a worker has seen lately: numbers and digests by index, and their pairs."""

    def __init__(self, a: str, b: str, with_groups: bool = True, table: Pairs | None = None):
        self.reader, self.table = reader(a, b, with_groups), table
        self.index: dict[str, int] = {}
        self.digests: list[str] = []
        self.chars = 0
        #: the linked pairs of all, in the order of the stretches
        self.parts: list[np.ndarray] = []
        #: n_a, n_b, n_groups, n_links, n_best, count_sum, wrong
        self.rows = np.zeros((1024, 7), np.int64)
        #: how often each was counted in this task, and how often it came up since room was made
        self.seen, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def make_room(self) -> None:
        """Keeps the stretches that came up more than twice, up to half of the bound. What was counted must be fetched before."""
        n = len(self.index)
        hot = np.flatnonzero(self.used[:n] > 2)
        hot = np.sort(hot[np.argsort(-self.used[hot], kind="stable")[: KEPT // 2]])
        names = np.array(list(self.index), object)[hot].tolist()
        sizes = self.rows[:n, 2]
        flat, kept = np.concatenate([np.zeros(0, np.int64), *self.parts]), np.zeros(n, bool)
        kept[hot] = True
        self.parts = [flat[np.repeat(kept, sizes)]]
        self.digests = [self.digests[i] for i in hot.tolist()] if self.digests else []
        self.index = dict(zip(names, range(len(names)), strict=True))
        self.chars = sum(map(len, names))
        rows = np.zeros((max(1024, len(hot)), 7), np.int64)
        rows[: len(hot)] = self.rows[hot]
        self.rows, self.seen, self.used = rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)

    def add(self, new: list[str]) -> None:
        found = len(self.index)
        while found + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.seen, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.seen, self.used))
        rows, pairs, digests = self.reader.read(new)
        at, ends = slice(found, found + len(new)), np.cumsum(rows[:, 2])
        self.rows[at, :3], self.rows[at, 3], self.rows[at, 6] = rows[:, :3], rows[:, 2], rows[:, 3]
        if self.table is not None:
            counts = self.table.counts_of(pairs)
            for column, x in ((4, counts == self.table.best[pairs % self.reader.width]), (5, counts)):
                self.rows[at, column] = np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        self.digests += digests
        self.parts.append(pairs)
        self.index.update(zip(new, range(found, found + len(new)), strict=True))
        self.chars += sum(map(len, new))

    def of(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The indices of each text's stretches; None for texts without tokens."""
        split = [stretches(t) if t else None for t in texts]
        new = {w for words in split if words for w in words}.difference(self.index)
        self.add(list(new))
        out = []
        for words in split:
            at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)) if words else None
            if at is not None:
                np.add.at(self.used, at, 1)
            out.append(None if at is None or self.rows[at, 6].any() else at)
        return out

    def full(self) -> bool:
        return len(self.index) > KEPT or self.chars > KEPT_CHARS

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of what was counted in ``seen``, and their counts; counting starts anew."""
        n = len(self.index)
        out = summed(np.concatenate([np.zeros(0, np.int64), *self.parts]), np.repeat(self.seen[:n], self.rows[:n, 2]))
        self.seen[:] = 0
        return out

    def pairs_of(self, at: np.ndarray) -> np.ndarray:
        """All linked pairs of a text's stretches."""
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        ends = np.cumsum(self.rows[: len(self.index), 2])
        return np.concatenate([np.zeros(0, np.int64), *[self.parts[0][ends[x] - self.rows[x, 2] : ends[x]] for x in at]])


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with n > 0 and the sums of n."""
    keys, n = keys[n > 0], n[n > 0]
    found, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, at, n)
    return found, total


# -- the minimal perfect hash


def levels_of(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Bits of each level, all levels' bits (each level fills whole words), and the keys by their index.

    A level has two bits for each key that came to it; bits that exactly one key hits are set, and that key is placed there.
    """
    sizes, bits, order = [], [], []
    left = keys
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = slots(left, len(sizes), np.full(len(left), size))
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        order.append(left[placed][np.argsort(at[placed])])
        bits.append(alone)
        sizes.append(size)
        left = left[~placed]
    flat = np.concatenate([np.zeros(0, bool), *bits])
    return sizes, np.packbits(flat, bitorder="little").view(U), np.concatenate([np.zeros(0, np.int64), *order])


def slots(keys: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U) + U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % size.astype(U)).astype(np.int64)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys.view(U) ^ U(0x51ED270B0A1F39C1)) % U(segments)).astype(np.int64)


class Pairs:
    """Hash, keys and (once they are set) counts of all pairs; ``best`` is the highest count of each id of B."""

    def __init__(self, rows: list[tuple[int, list[int], bytes, bytes]], segments: int):
        """rows: (segment, level sizes, bits, keys by index)."""
        depth = max((len(r[1]) for r in rows), default=0)
        self.size, self.base = np.zeros((segments, depth), np.int64), np.zeros((segments, depth), np.int64)
        words, keys, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
        for segment, sizes, bits, stored in sorted(rows):
            for level, size in enumerate(sizes):
                self.size[segment, level], self.base[segment, level] = size, at
                at += size
            words.append(np.frombuffer(bits, U))
            keys.append(np.frombuffer(stored, np.int64))
        self.words, self.keys = np.concatenate(words), np.concatenate(keys)
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.counts = np.zeros(len(self.keys), np.int64)
        self.best = np.zeros(0, np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 where the key stored there is another one."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        segment, left = segment_of(keys, len(self.size)), np.arange(len(keys))
        for level in range(self.size.shape[1]):
            left = left[self.size[segment[left], level] > 0]
            if not len(left):
                break
            s = segment[left]
            at = self.base[s, level] + slots(keys[left], level, self.size[s, level])
            word, bit = self.words[at >> 6], (at & 63).astype(U)
            here = (word >> bit) & U(1) == 1
            below = np.bitwise_count(word & ((U(1) << bit) - U(1)))
            out[left[here]] = (self.rank[at >> 6] + below)[here]
            left = left[~here]
        found = out >= 0
        out[found] = np.where(self.keys[out[found]] == keys[found], out[found], -1)
        return out

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        at = self.index(keys)
        return np.where(at >= 0, self.counts[at] if len(self.counts) else 0, 0)


Batches = Iterable[pa.RecordBatch]


def partial_counts(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(pair, n): linked id pairs of each task's documents, A's id times B's vocabulary plus B's id; a pair comes once for each task or part of it."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        task = stretches_of_worker(a, b, None)
        task.seen[:] = 0  # a task that failed may have left some
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for i, j in doc_slices(batch.column(0)):
                for at in task.of(batch.column(0).slice(i, j - i).to_pylist()):
                    if at is not None:
                        np.add.at(task.seen, at, 1)
                if task.full():
                    more = task.counted()
                    keys, n = summed(np.concatenate([keys, more[0]]), np.concatenate([n, more[1]]))
                    task.make_room()
                    if len(keys) > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
                        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        more = task.counted()
        keys, n = summed(np.concatenate([keys, more[0]]), np.concatenate([n, more[1]]))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
        give_back()

    return docs.select("text").mapInArrow(run, "pair long, n long")


def hash_table(partial: DataFrame, distinct: int) -> Pairs:
    """The minimal perfect hash of all pairs, made segment by segment in Spark."""
    segments = max(1, -(-distinct // SEGMENT))

    def numbered(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(segment_of(keys, segments))], ["pair", "segment"])

    def build(rows: pa.Table) -> pa.Table:
        sizes, bits, keys = levels_of(np.sort(np.asarray(rows["pair"], np.int64)))
        return pa.table({"segment": rows["segment"][:1], "sizes": pa.array([sizes], pa.list_(pa.int64())), "bits": [bits.tobytes()], "keys": [keys.tobytes()]})

    keys = partial.select("pair").distinct().mapInArrow(numbered, "pair long, segment long")
    made = keys.groupBy("segment").applyInArrow(build, "segment long, sizes array<long>, bits binary, keys binary")
    return Pairs([(r["segment"], r["sizes"], bytes(r["bits"]), bytes(r["keys"])) for r in made.collect()], segments)  # at most MOST keys in all


def summed_vectors(partial: DataFrame, table: Pairs) -> np.ndarray:
    """Dense count vectors by the hash's index, one for each task and stretch of the index, summed as a tree."""

    def vectors(batches: Batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(table.keys), np.int64)
        part = 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            np.add.at(total, table.index(np.asarray(batch.column(0), np.int64)), np.asarray(batch.column(1), np.int64))
        for at in range(0, len(total), VECTOR):
            some = total[at : at + VECTOR]
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // VECTOR], pa.int64()), pa.array([part], pa.int64()), pa.array([some.tobytes()])], ["stretch", "part", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(x.as_buffer(), np.int64) for x in rows["counts"]), np.int64(0))
        return pa.table({"stretch": rows["stretch"][:1], "part": rows["part"][:1], "counts": [total.tobytes()]})

    schema = "stretch long, part long, counts binary"
    tree = durable(partial.select("pair", "n", F.spark_partition_id().cast("long").alias("part")).mapInArrow(vectors, schema), "count-vectors")
    while (tree.agg(F.max("part")).first()[0] or 0) > 0:
        below = tree
        tree = durable(below.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("stretch", "part").applyInArrow(add, schema), "count-vectors")
        release(below)
    out = np.zeros(len(table.keys), np.int64)
    for r in tree.collect():  # one row for each stretch of the index: at most MOST counts
        some = np.frombuffer(bytes(r["counts"]), np.int64)
        out[r["stretch"] * VECTOR :][: len(some)] += some
    release(tree)
    return out


def pair_counts(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """(a, b, n): how many links of all documents hold the two ids linked."""
    width = len(tokenizers(a, b)[3])
    n = partial_counts(docs, a, b).groupBy("pair").agg(F.sum("n").alias("n"))
    return n.select(F.expr(f"int(pair div {width})").alias("a"), (F.col("pair") % width).cast("int").alias("b"), "n")


def aligned(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """doc_id and groups (array of a: ids, b: ids) of each text; none for texts without tokens. The last ids of a group are linked."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        task = Stretches(a, b)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for batch in batches:
            for i, j in doc_slices(batch.column(0)):
                part = batch.slice(i, j - i)
                out = []
                for at in task.of(part.column(0).to_pylist()):
                    groups = [g.split("|") for x in ([] if at is None else at) for g in task.digests[x].split(";")]
                    out.append([{"a": list(map(int, x.split(","))), "b": list(map(int, y.split(",")))} for x, y in groups])
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(out, kind)], ["doc_id", "groups"])
                if task.full():
                    task.make_room()

    return docs.select("text", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


def _digests(docs: DataFrame, a: str, b: str, table: Pairs | None) -> DataFrame:
    """Numbers and digest of each text; without a table its distinct pairs and their times instead of the counts."""
    pass_id = uuid.uuid4().hex
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *(["n_best", "count_sum"] if table else ["pairs", "times"]), "groups_sha256"]

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        task = stretches_of_worker(a, b, pass_id)
        task.table = table
        for batch in batches:
            for i, j in doc_slices(batch.column(0)):
                part = batch.slice(i, j - i)
                found = task.of(part.column(0).to_pylist())
                rows = np.array([np.zeros(7, np.int64) if at is None else task.rows[at].sum(0) for at in found], np.int64).reshape(-1, 7)
                digests = ["" if at is None else hashlib.sha256(";".join([task.digests[x] for x in at]).encode()).hexdigest() for at in found]
                columns = [part.column(1), *[pa.array(rows[:, k]) for k in range(4)]]
                if table:
                    columns += [pa.array(rows[:, 4]), pa.array(rows[:, 5])]
                else:
                    pairs = [np.unique(task.pairs_of(np.zeros(0, np.int64) if at is None else at), return_counts=True) for at in found]
                    columns += [pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1] for p in pairs], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names)
                if task.full():
                    task.make_room()
        give_back()

    counts = "n_best long, count_sum long" if table else "pairs array<long>, times array<long>"
    return docs.select("text", F.col("doc_id").cast("long")).mapInArrow(run, f"doc_id long, {DIGEST}, {counts}, groups_sha256 string")


def align(docs: DataFrame, a: str = A, b: str = B, most: int = MOST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    width = len(tokenizers(a, b)[3])
    partial = durable(partial_counts(docs, a, b), "pair-counts")
    distinct = partial.select("pair").distinct().count()
    if distinct <= most:
        table = hash_table(partial, distinct)
        table.counts = summed_vectors(partial, table)
        release(partial)
        table.best = np.zeros(width, np.int64)
        np.maximum.at(table.best, table.keys % width, table.counts)
        return _digests(docs, a, b, table)
    counts = durable(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-sums")
    release(partial)
    best = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("best"))  # a row for each id of B
    rows = durable(_digests(docs, a, b, None).withColumn("row", F.monotonically_increasing_id()), "pairs-of-texts")
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    links = links.join(counts, links["pairs"] == counts["pair"]).join(F.broadcast(best), F.col("pair") % width == F.col("b"))
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    none = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *none, "groups_sha256")


def op11_hashed_pair_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
