"""SentencePiece encoding and decoding by one forward pass over the trie of a batch's distinct marked words.

Text is marked as the model's own rules say (a leading space, each space as U+2581) and cut before each run of
marks, which no piece crosses. A batch's distinct marked words are sorted, so words with a common prefix stand
together, and the trie that they form is walked depth-first: the forward state of a prefix is the last piece of its
encoding, and a word only computes the states after the prefix that it shares with the word before.

The public model file is a BPE model. A Viterbi pass that adds piece scores (``encode_scored``, the one for models whose
scores are log probabilities) gives other ids than its merges do, so the transition used by default is the one that
gives the model's ids: a piece may follow another if merging the two pieces' characters yields exactly these two pieces
(checked once for each pair and kept). The encoding of a prefix is then unique, and the pass needs no merging of whole
words. Words with repeated marks are merged directly. Characters that the model lacks become byte pieces.

Decoding is a lookup of each piece's bytes, less the leading space.

Edge cases: a null text has null ids, an empty one none; equal texts get equal ids; texts of any length are encoded
whole; invalid ids do not occur in encoded text; other columns are ignored. A kept column that is called as the result
is comes back with an underscore after its name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import doc_slices

MARK = "▁"
MODEL = "piece_bpe_32k.model"
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
BATCH_BYTES, KEPT_WORDS, KEPT_PAIRS = 1 << 23, 200_000, 2_000_000


class Pieces:
    """A model's pieces, their scores and the states that encoding needs."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(n)]
        self.id_of = {p: i for i, p in enumerate(names) if plain[i]}
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.name = names
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(names) if model.is_byte(i)}
        self.bytes_of = [b"" if not (plain[i] or model.is_byte(i)) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.follows: dict[int, bool] = {}
        self._automaton()

    def merge(self, text: str) -> list[str]:
        """The model's merges on a short string: the best-scored neighbours first, the leftmost of equals."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = self.score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.follows.get(key)
        if known is None:
            known = self.follows[key] = self.merge(self.name[a] + self.name[b]) == [self.name[a], self.name[b]]
        return known

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of distinct words."""
        out: dict[str, list[int]] = {}
        if len(self.follows) > KEPT_PAIRS:
            self.follows.clear()
        follows, may_follow = self.follows, self.may_follow
        step, fallback, ending = self.step, self.fallback, self.ending
        before = ""
        last, size, node = [-1], [0], [0]  # for each end position of the current path: its last piece (-1 at the root), that piece's length, the automaton's node
        for word in sorted(words):
            if word.startswith(MARK + MARK):
                out[word] = [x for p in self.merge_long(word) for x in self._ids(p)]
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :], node[shared + 1 :]
            at = node[shared]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                while at and c not in step[at]:
                    at = fallback[at]
                at = step[at].get(c, 0)
                piece, length = -2, 1  # a character that the model lacks
                for p, n in ending[at]:
                    prior = last[end - n]
                    if prior >= 0:
                        ok = follows.get(prior << 20 | p)
                        if ok is None:
                            ok = may_follow(prior, p)
                        if not ok:
                            continue
                    piece, length = p, n
                    break
                last.append(piece)
                size.append(length)
                node.append(at)
            out[word] = self._back(word, last, size)
            before = word
        return out

    def encode_scored(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of distinct words whose pieces' scores have the largest sum; on ties the longest last piece. Forward scores of a common prefix are used again."""
        out: dict[str, list[int]] = {}
        lacking = min(self.score.values(), default=0.0) - 10.0  # for a character that the model lacks
        value = [0.0] * len(self.name)
        for piece, i in self.id_of.items():
            value[i] = self.score[piece]
        before = ""
        best, last, size, node = [0.0], [-1], [0], [0]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            for path in (best, last, size, node):
                del path[shared + 1 :]
            at = node[shared]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                while at and c not in self.step[at]:
                    at = self.fallback[at]
                at = self.step[at].get(c, 0)
                top, piece, length = best[end - 1] + lacking, -2, 1
                for p, n in self.ending[at]:
                    if best[end - n] + value[p] > top:
                        top, piece, length = best[end - n] + value[p], p, n
                best.append(top)
                last.append(piece)
                size.append(length)
                node.append(at)
            out[word] = self._back(word, last, size)
            before = word
        return out

    def _back(self, word: str, last: list[int], size: list[int]) -> list[int]:
        ids: list[int] = []
        end = len(word)
        while end:
            if last[end] >= 0:
                ids.append(last[end])
            else:
                ids += [self.byte_id[b] for b in reversed(word[end - 1].encode())]
            end -= size[end]
        return ids[::-1]

    def _automaton(self) -> None:
        """Nodes for all prefixes of pieces: step (by character), fallback (the longest proper suffix that is a node too) and ending, the pieces that end here, longest first."""
        self.step: list[dict[str, int]] = [{}]
        own: list[int] = [-1]
        for piece, i in self.id_of.items():
            at = 0
            for c in piece:
                new = self.step[at].get(c)
                if new is None:
                    new = self.step[at][c] = len(own)
                    self.step.append({})
                    own.append(-1)
                at = new
            own[at] = i
        self.fallback = [0] * len(own)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        level = [(0, c, n, 1) for c, n in self.step[0].items()]
        while level:
            deeper = []
            for parent, c, n, depth in level:
                f = self.fallback[parent]
                while f and c not in self.step[f]:
                    f = self.fallback[f]
                self.fallback[n] = self.step[f].get(c, 0) if parent else 0
                self.ending[n] = (((own[n], depth),) if own[n] >= 0 else ()) + self.ending[self.fallback[n]]
                deeper += [(n, d, m, depth + 1) for d, m in self.step[n].items()]
            level = deeper

    def merge_long(self, word: str) -> list[str]:
        """Words with several leading marks: the last mark goes with the letters, unless nothing follows; long runs are merged from the left as their equal scores ask."""
        marks = len(word) - len(word.lstrip(MARK))
        if marks > 64 or len(word) > 256:
            head = self.merge(MARK * 64)  # the run's merges reach a fixed pattern: whole longest pieces, then the rest
            whole = head[0]
            letters = word[marks - 1 :] if len(word) > marks else ""
            run = marks - 1 if letters else marks
            out = [whole] * (run // len(whole))
            rest = MARK * (run % len(whole))
            return out + (self.merge(rest) if rest else []) + ([self.name[i] for i in self.encode_words([letters])[letters]] if letters else [])
        return self.merge(word)

    def _ids(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        return [i] if i is not None else [self.byte_id[b] for b in piece.encode()] if not re.fullmatch("<0x..>", piece) else [int(piece[3:5], 16) + self.byte_id[0]]


@lru_cache(maxsize=2)
def pieces(model: str = MODEL) -> Pieces:
    import public_tokenizers

    return Pieces(public_tokenizers.path(model))


def mark(text: str) -> str:
    return (MARK + text.replace(" ", MARK)) if text else ""


def encode_texts(texts: list[str | None], model: str, known: dict[str, list[int]], scored: bool = False) -> list[np.ndarray | None]:
    """Ids of each text; known: words encoded before, which this adds to."""
    p = pieces(model)
    split = [WORD.findall(mark(t)) if t else [] for t in texts]
    new = {w for words in split for w in words if w not in known}
    if len(known) + len(new) > KEPT_WORDS:
        known.clear()
        new = {w for words in split for w in words}
    known.update(p.encode_scored(new) if scored else p.encode_words(new))
    return [None if t is None else np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32) for t, words in zip(texts, split, strict=True)]


def decode_ids(ids: np.ndarray, model: str = MODEL) -> str:
    table = pieces(model).bytes_of
    return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


Batches = Iterable[pa.RecordBatch]


def encoded(batches: Batches, model: str, scored: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of (text, ...) as (ids, ...)."""
    known: dict[str, list[int]] = {}
    for batch in batches:
        for i, j in doc_slices(batch.column(0), BATCH_BYTES, 4096):
            part = batch.slice(i, j - i)
            ids = encode_texts(part.column(0).to_pylist(), model, known, scored)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), *part.columns[1:]], ["ids", *part.schema.names[1:]])


def decoded(batches: Batches, model: str) -> Iterator[pa.RecordBatch]:
    """Batches of (ids, ...) as (text, ...)."""
    for batch in batches:
        column = batch.column(0)
        flat, offsets, valid = np.asarray(column.values, np.int32), np.asarray(column.offsets), np.asarray(column.is_valid())
        texts = [decode_ids(flat[a:b], model) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], ["text", *batch.schema.names[1:]])


def _mapped(rows: DataFrame, source: str, keep: list[str], run, result: str, kind: str) -> DataFrame:
    """The result of a column and the kept columns, whatever these are called."""
    schema = ", ".join([f"result {kind}", *(f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))])
    out = rows.select(rows[source].alias("source"), *[rows[c].alias(f"k{i}") for i, c in enumerate(keep)]).mapInArrow(run, schema)
    return out.toDF(result, *[c + "_" * (c == result) for c in keep])


def encode(docs: DataFrame, keep: list[str], model: str = MODEL, scored: bool = False) -> DataFrame:
    """ids (array<int>) of text, and the columns named in keep; scored: by the largest sum of scores."""
    return _mapped(docs, "text", keep, lambda batches: (b.rename_columns(["result", *b.schema.names[1:]]) for b in encoded(batches, model, scored)), "ids", "array<int>")


def decode(rows: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """text of ids, and the columns named in keep."""
    return _mapped(rows, "ids", keep, lambda batches: (b.rename_columns(["result", *b.schema.names[1:]]) for b in decoded(batches, model)), "text", "string")


def _digest(batches: Batches) -> Iterator[pa.RecordBatch]:
    """Both ways in one pass: batches of (text, doc_id) as (decoded text, doc_id, n_ids, ids_crc32)."""

    def counted(parts: Batches) -> Iterator[pa.RecordBatch]:
        for part in parts:
            column = part.column(0)
            flat, offsets = np.asarray(column.values, "<i4"), np.asarray(column.offsets)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], [*part.schema.names, "n_ids", "ids_crc32"])

    for batch in decoded(counted(encoded(batches, MODEL)), MODEL):
        crc = [zlib.crc32((t or "").encode()) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(crc, pa.int64())], ["doc_id", "n_ids", "ids_crc32", "decoded_crc32"])


def op2_trie_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids) and the crc32 of the text decoded from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_digest, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long")
