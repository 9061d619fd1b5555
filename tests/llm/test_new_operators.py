"""Alignment of tokenizers, id files and ranked search: against plain versions of their contracts, and over odd rows."""

import hashlib
import math
import os
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from pyspark.sql import functions as F

from codefacts.llm import align, idfiles, ranked, registry
from codefacts.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
DOCS = "doc_id long, text string, lang string, pair long, rank int, start long, n long"
ODD = [
    "one two  three", " leading", "trailing ", "\n a\n\n b \t c", "tab\tand nbsp 　wide", "", " ", "  ", "<|endoftext|> and <|startoftext|>x", "café café İstanbul ﬁne",
    "a▁b here", "\x00 nul\x00", "\U0001f600\U0001f600 smile", "don't we'll 'tis", "漢字かな交じり", " ".join(["again"] * 300), "x" * 5000, " " * 400 + "far", "UPPER lower UPPER.", "a1b2 c3,d4;e5",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, None, 7, 1, 2, 3) for i, t in texts], DOCS)


# -- alignment


def plain_alignment(docs):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest) straight from the two libraries."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    _, _, size_a, size_b = align.tokenizers(align.A, align.B)
    counts, of_docs = Counter(), []
    for doc_id, text in docs:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(size_a[x] for x in ids_a) != whole or b"".join(size_b[x] for x in ids_b) != whole:
            ids_a, ids_b = [], []
        ends_a, ends_b = np.cumsum([len(size_a[x]) for x in ids_a]).tolist(), np.cumsum([len(size_b[x]) for x in ids_b]).tolist()
        links = [(x, y) for x, end in zip(ids_a, ends_a) for y in [ids_b[ends_b.index(end)] if end in set(ends_b) else None] if y is not None] if len(ids_a) < 3000 else None
        common = sorted(set(ends_a) & set(ends_b))
        if links is None:
            where = {e: y for y, e in zip(ids_b, ends_b)}
            links = [(x, where[e]) for x, e in zip(ids_a, ends_a) if e in where]
        groups, before = [], 0
        for end in common:
            groups.append(",".join(str(x) for x, e in zip(ids_a, ends_a) if before < e <= end) + "|" + ",".join(str(y) for y, e in zip(ids_b, ends_b) if before < e <= end))
            before = end
        counts.update(links)
        of_docs.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""))
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return Counter((d, na, nb, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), h) for d, na, nb, g, ls, h in of_docs)


def alignment_rows(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def odd_texts():
    random.seed(4)
    mixed = ["".join(random.choice(["word", "Rare", " ", " ", "  ", "\n", ".", "é", "'s", "9", "　", "▁", "_"]) for _ in range(random.randrange(1, 40))) for _ in range(200)]
    return [*enumerate([*ODD, *mixed]), (3, ODD[3]), (900, None), (None, "one two")]


@pytest.mark.parametrize("most", [align.MOST, 10])
def test_alignment_equals_the_libraries(spark, most):
    """With the hash table, and with the join for more pairs than it may hold."""
    docs = odd_texts()
    assert alignment_rows(align.align(frame(spark, docs).repartition(5), most=most)) == plain_alignment(docs)


def test_alignment_of_no_rows(spark):
    assert align.align(frame(spark, [])).count() == 0
    got = align.align(frame(spark, [(1, None), (2, "")])).collect()
    assert [(r["n_a"], r["n_groups"], r["count_sum"], r["groups_sha256"]) for r in got] == [(0, 0, 0, "")] * 2


def test_groups_and_counts_of_the_operator(spark):
    docs = frame(spark, [(1, "the cat the cat"), (2, "the dog")])
    groups = {r["doc_id"]: r["groups"] for r in align.aligned(docs).collect()}
    ids_a, ids_b, _, _ = align.tokenizers(align.A, align.B)
    assert [x for g in groups[1] for x in g["a"]] == ids_a(" the cat the cat") and [y for g in groups[2] for y in g["b"]] == ids_b(["the dog"])[0]
    n = {(r["a"], r["b"]): r["n"] for r in align.pair_counts(docs).collect()}
    assert n[groups[1][0]["a"][-1], groups[1][0]["b"][-1]] == 3


@needs_tables
def test_op11_equals_the_libraries(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert alignment_rows(registry.QUERIES["op11_hashed_pair_alignment"](spark, SF)) == plain_alignment(docs)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=400), st.integers(1, 5))
def test_the_hash_is_minimal_perfect_and_verified(keys, segments):
    keys = np.array(sorted(keys), np.int64)
    of = align.segment_of(keys, segments)
    rows = []
    for s in set(of.tolist()):
        sizes, bits, stored = align.levels_of(keys[of == s])
        rows.append((s, sizes, bits.tobytes(), stored.tobytes()))
    table = align.Pairs(rows, segments)
    assert sorted(table.index(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(keys + 1, keys)
    assert (table.index(others) == -1).all()


def test_vectors_are_summed_as_a_tree(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(n)) for k, n in zip(rng.integers(0, 500, 4000), rng.integers(1, 9, 4000))]
    partial = spark.createDataFrame(rows, "pair long, n long").repartition(40)
    table = align.hash_table(partial, 500)
    counts = align.summed_vectors(partial, table)
    want = Counter()
    for k, n in rows:
        want[k] += n
    assert dict(zip(table.keys.tolist(), counts.tolist())) == want


# -- id files


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=700), st.integers(0, 44))
def test_elias_fano_round_trip(values, shift):
    x = np.array(sorted(v >> shift for v in values), np.uint64)
    raw = b"pad" + b"".join(np.ascontiguousarray(p).tobytes() for p in idfiles.EliasFano.of(x).parts())
    read, end = idfiles.EliasFano.read(raw, 3)
    assert end == len(raw) and read.all().tolist() == x.tolist() and [read.select(i) for i in range(len(x))] == x.tolist()
    for value in x[:5].tolist():
        assert read.index(value) == np.searchsorted(x, value) and read.index(value + 1) == np.searchsorted(x, value, side="right")


def test_elias_fano_is_near_minimal():
    x = np.cumsum(np.random.default_rng(1).integers(1, 1000, 20_000)).astype(np.uint64)
    size = sum(p.nbytes for p in idfiles.EliasFano.of(x).parts())
    assert size * 8 / len(x) < 2 + math.log2(int(x[-1]) / len(x)) + 1


def ids_of(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = ids_of.__dict__.setdefault("own", Tokenizer.from_file(P.path("word_bpe_49k.json")))
    return np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize("file_ids", [idfiles.FILE_IDS, 50])
def test_id_files_give_every_document_back(spark, file_ids):
    docs = odd_texts()
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    files = idfiles.write(frame(spark, docs).repartition(6), folder, file_ids=file_ids).collect()
    assert sum(f["n_docs"] for f in files) == len(docs) and all(f["n_ids"] <= file_ids or f["n_docs"] == 1 for f in files)
    rows = sorted(idfiles.read(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((d, tuple(ids_of(t).tolist())) for d, t in docs)
    wanted = spark.createDataFrame([(3,), (17,), (10**9,), (None,), (-5,), (3,)], "w long")
    got = Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in idfiles.lookup(wanted, folder).collect())
    assert got == Counter((r["doc_id"], r["start"], tuple(r["ids"])) for r in rows if r["doc_id"] in (3, 17))


def test_id_files_of_no_rows_and_of_both_signs(spark):
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    idfiles.write(frame(spark, []), folder)
    assert idfiles.read(spark, folder).count() == 0 and idfiles.lookup(spark.createDataFrame([(1,)], "w long"), folder).count() == 0
    far = [(-(2**63), "a"), (2**63 - 1, "b c"), (0, None)]
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    idfiles.write(frame(spark, far).coalesce(1), folder)
    assert [(r["doc_id"], r["n_tokens"]) for r in sorted(idfiles.read(spark, folder).collect(), key=lambda r: r["start"])] == [(-(2**63), 2), (0, 1), (2**63 - 1, 3)]


def test_a_files_documents_by_number(tmp_path):
    docs, rng = [(i * 3, rng_ids) for i, rng_ids in enumerate(np.split(np.arange(1000, dtype=np.uint32), [3, 3, 500, 777]))], random.Random(0)
    with open(tmp_path / "f", "wb") as f:
        for part in idfiles.file_parts([d for d, _ in docs], [x for _, x in docs], 4):
            f.write(np.ascontiguousarray(part).tobytes())
    file = idfiles.IdFile(fs.LocalFileSystem(), str(tmp_path / "f"))
    for i in rng.sample(range(len(docs)), len(docs)):
        assert file.document(i)[1].tolist() == docs[i][1].tolist() and list(file.places(docs[i][0])) == [i]
    assert list(file.places(1)) == []


@needs_tables
class Counted:
    """A tokenizer that counts the texts given to it."""

    def __init__(self, own):
        self.own, self.texts = own, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.own.encode_batch_fast(texts, **how)

    def __getattr__(self, name):
        return getattr(self.own, name)


def test_words_are_encoded_many_to_a_text():
    rng = np.random.default_rng(2)
    words = list(dict.fromkeys("".join(rng.choice(list("aeinrstßéж"), rng.integers(2, 9))) for _ in range(3000)))
    encoder = idfiles.Encoder(idfiles.TOKENIZER)
    encoder.own = own = Counted(encoder.own)
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    got = [x.tolist() for x in encoder.encode([*texts, None, ""])]
    assert 0 < own.texts <= len(words) // 100 and got == [e.ids for e in own.own.encode_batch_fast([*texts, "", ""], add_special_tokens=False)]
    assert encoder.encode([]) == []


def test_marks_after_letters_that_decompose():
    """Their normal form ends with a combining mark, which is one word with the mark after it; letters newer than the tokenizer's are no words at all."""
    letters = [chr(c) for c in range(0x20000) if chr(c).isalpha()]
    texts = [" ".join(f"a{c} {c}. {c}b," for c in letters[i : i + 100]) for i in range(0, len(letters), 100)]
    encoder = idfiles.Encoder(idfiles.TOKENIZER)
    want = [e.ids for e in encoder.own.encode_batch_fast(texts, add_special_tokens=False)]
    assert [i for i, (x, y) in enumerate(zip(encoder.encode(texts), want, strict=True)) if x.tolist() != y] == []


def test_op12_equals_the_library(spark):
    got = {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in registry.QUERIES["op12_elias_fano_id_files"](spark, SF).collect()}
    start, want = 0, set()
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = ids_of(r["text"])
        want.add((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


# -- ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(docs, items, k=10):
    words = [(d, Counter(terms(t))) for d, t in docs]
    words = [(d, c) for d, c in words if c]
    n_docs, total = len(words), sum(c.total() for _, c in words)
    df = Counter(t for _, c in words for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    out = []
    for item, ts in asked.items():
        scores = []
        for d, c in words:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("short", "block", "chunk"), [(1 << 9, 1 << 14, 1 << 18), (2, 40, 30), (0, 700, 1 << 18)])
def test_search_equals_brute_force(spark, monkeypatch, short, block, chunk):
    """Short and long lists, small blocks and ranges, several chunks of items; many ties."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "The", "ÉTÉ", "été", "x_y", "漢字"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(1500)]
    docs += [(i + 3000, docs[i][1]) for i in range(300)] + docs[:20] + [(None, docs[5][1]), (9000, None), (9001, "?!"), (9002, " ".join(vocabulary * 200))]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for i in range(25)] + [(3, "w1 w59"), (70, None), (71, "nothing-here"), (None, "the w3"), (72, ""), (1, "w2")]
    values = {"SHORT": short, "BLOCK_DOCS": block, "RANGE": 16 if block < 1 << 14 else ranked.RANGE}
    found = frame(spark, docs).repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 1) for i, t in items], "item_id long, text string, doc_id long, score long")
    for name, value in values.items():
        monkeypatch.setattr(ranked, name, value)
    got = Counter(tuple(r) for r in with_settings(values, ranked.search, found, asked, chunk=chunk).select("item_id", "rank", "doc_id", "score").collect())
    assert got == plain_search(docs, items)


def with_settings(values, search, docs, items, **kw):
    """The search with its module pickled by value, so that workers see the test's block sizes as well."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(ranked)
    try:
        return search(docs, items, **kw)
    finally:
        cloudpickle.unregister_pickle_by_value(ranked)


def test_search_of_no_rows(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(frame(spark, []), items).count() == 0
    assert ranked.search(frame(spark, [(1, "a b")]), items.limit(0)).count() == 0
    assert ranked.search(frame(spark, [(1, None), (2, "..")]), items).count() == 0


def test_terms_with_one_hash_are_told_apart():
    texts = ["alpha", "beta", "gamma"]
    found = ranked.Vocabulary(texts)
    found.hashes[:] = found.hashes[0]
    found.alike = 3
    raw = np.frombuffer(b"Beta gamma", np.uint8)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ranked, "word_hashes", lambda raw, starts, ends: np.full(len(starts), found.hashes[0]))
        spans, which = found.find(raw, np.array([0, 5]), np.array([4, 10]))
    assert sorted(zip(spans.tolist(), which.tolist())) == [(0, 1), (1, 2)]


def test_the_term_pattern_of_items(spark):
    items = spark.createDataFrame([(1, "Don't ÉTÉ x_y 3.14 漢字😀  z")], "item_id long, text string")
    assert {r["term"] for r in ranked.item_terms(items).select(F.col("term")).collect()} == set(terms("Don't ÉTÉ x_y 3.14 漢字😀  z"))
