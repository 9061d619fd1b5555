"""Text operators against brute force, exact round trips and held-out accuracy, and the defined results of odd rows."""

import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefacts.llm import common, htmltext, jaccard, langid, packing, pieces, repeats, sharding, toxicity
from codefacts.llm.common import string_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, spans string, id string, x double"


def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    words = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven", "en", "s", 33, "k", "s", "i", 0.5),
        (1, "one two three four five six seven", "en", "s", 33, "k", "s", "i", 0.5),
        (2, None, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "k", "s", "i", 0.5),
        (4, " \t\n ", "de", "s", 4, "k", "s", "i", 0.5),
        (5, words, "en", "s", len(words), "k", "s", "i", 0.5),
        (6, words, "en", "s", len(words), "k", "s", "i", 0.5),
        (None, "one two three four five six seven", "en", None, 33, "k", "s", "i", 0.5),
        (8, "漢字 é\U0001f600 123", None, "s", 9, "k", "s", "i", 0.5),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, s = root(sets[a][0]), root(sets[b][0])
                parent[max(r, s)] = min(r, s)
    return {(i, len(s), root(i)) for i, s in sets}


def edited_copies(seed, groups=6, copies=12):
    """Texts, copies with some words changed (nearer to the first than to each other), shared passages and short texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 200))]
        for c in range(copies):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(words) // 40)) if c else 0):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(words)
    out += [passage + [r.choice(vocabulary) for _ in range(30)] for _ in range(10)]
    out += [[r.choice(vocabulary[:4]) for _ in range(r.randint(0, 6))] for _ in range(20)]
    r.shuffle(out)
    return [(i * 3 + 1, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_equals_brute_force(spark, seed):
    rows = edited_copies(seed)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(r) for r in found} == brute_components(rows)


def test_jaccard_join_of_odd_rows(spark):
    found = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd_docs(spark)).collect())
    assert found == [(-1, 3, None), (1, 3, 1), (1, 3, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 29_996, 5), (6, 29_996, 5), (8, 1, 8)]
    assert jaccard.near_duplicates(empty_docs(spark)).count() == 0
    kept = jaccard.stage(spark, odd_docs(spark), "")
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 8]


def test_sketches_never_part_sets_that_link():
    r = np.random.default_rng(3)
    for n in (1, 5, 40, 700, 20_000):
        s = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        t = np.unique(np.concatenate((s[: max(1, int(len(s) * 0.9))], r.integers(0, 2**63, len(s) // 20, dtype=np.uint64))))
        both = [jaccard.sketch(x, jaccard.full_bits(len(x))) for x in (s, t)]
        if 9 * len(np.intersect1d(s, t)) >= 4 * (len(s) + len(t)):
            assert jaccard.may_link(*both, len(s) + len(t))
        other = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        if n > 40:
            assert not jaccard.may_link(both[0], jaccard.sketch(other, jaccard.full_bits(len(other))), len(s) + len(other))


@pytest.mark.parametrize("part", [3, 10_000])
def test_jaccard_join_of_long_lists_in_sides(spark, part, monkeypatch):
    """Texts that share a passage, which is most of each, and fall into several components."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(90):
        own = random.Random(i // 3)
        rows.append((i, " ".join(passage + [own.choice(vocabulary) for _ in range(18 + i % 3)])))
    deal = jaccard._dealt
    monkeypatch.setattr(jaccard, "_dealt", lambda rows: deal(rows, part))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(x) for x in found} == brute_components(rows)


@pytest.fixture
def many_ranges(spark):
    """Shuffles into 17 parts that stay apart, so that long runs of one key go over several of them."""
    given = {"spark.sql.shuffle.partitions": "17", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    for k, v in given.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_runs_over_several_ranges(spark, many_ranges):
    """Most texts share one passage and one fifth of all shingles' rarest: the runs of a key span many ranges, in both operators."""
    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    rows = []
    for i in range(150):
        own = random.Random(i // 2)
        rows.append((i, " ".join([own.choice(vocabulary) for _ in range(8)] + passage[: 55 + i % 16] + [own.choice(vocabulary) for _ in range(6)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    parts = repeats.suffixes(texts, 50, 40).repartitionByRange("key", "doc", "pos", "last").groupBy(F.spark_partition_id().alias("p"), "key").count().groupBy("key").count().agg(F.max("count")).first()[0]
    assert parts > 3
    found: dict[int, set] = {i: set() for i, _ in rows}
    for p in repeats.repeated_passages(docs).collect():
        assert p["first_doc_id"] < p["doc_id"]
        found[p["doc_id"]] |= set(range(p["start_word"], p["start_word"] + p["n_words"]))
    assert found == brute_repeated(rows)
    assert {tuple(x) for x in jaccard.near_duplicates(docs).collect()} == brute_components(rows)


def test_rows_by_ids_with_and_without_a_broadcast(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 50 != 7, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    ids = spark.range(0, 300, 9).select(F.col("id").alias("doc_id"))
    for most in (1000, 0):
        some, rest = common.part_by_ids(rows, "doc_id", ids, most)
        a, b = {r["text"] for r in some.collect()}, {r["text"] for r in rest.collect()}
        assert not a & b and len(a | b) == 300 and a >= {f"t{i}" for i in range(0, 300, 9) if i % 50 != 7} and len(a) < 60


def brute_repeated(rows, least=50):
    """Words of each document that stand in a run of ``least`` words which an earlier document has too."""
    out = {}
    seen: dict[tuple, int] = {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        runs = [tuple(w[a : a + least]) for a in range(len(w) - least + 1)]
        hit = set()
        for a, run in enumerate(runs):
            if seen.get(run, i) < i:
                hit |= set(range(a, a + least))
        out[i] = hit
        for run in runs:
            seen.setdefault(run, i)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_equal_brute_force(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passages = [[r.choice(vocabulary) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(60):
        words = [f"u{i}x{j}" for j in range(r.randint(5, 120))]
        for p in r.sample(passages, r.randint(0, 2)):
            at = r.randrange(len(words))
            words[at:at] = p
        rows.append((i, " ".join(words)))
    rows += [(100, "a b " * 300), (101, "a b " * 200), (102, rows[0][1]), (103, "same " * 60), (104, "same " * 200)]
    found: dict[int, set] = {i: set() for i, _ in rows}
    for p in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert p["n_words"] >= 50 and p["first_doc_id"] < p["doc_id"]
        found[p["doc_id"]] |= set(range(p["start_word"], p["start_word"] + p["n_words"]))
    assert found == brute_repeated(rows)


def test_a_passage_that_the_first_document_shares_in_part_only(spark):
    """The smallest id holds 45 of the words; two later documents share 60."""
    p = [f"p{i}" for i in range(60)]
    rows = [(1, " ".join(["a"] * 30 + p[8:53] + ["b"] * 30)), (2, " ".join([f"c{i}" for i in range(20)] + p)), (3, " ".join(p + [f"d{i}" for i in range(20)]))]
    got = repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {w for r in got for w in range(r["start_word"], r["start_word"] + r["n_words"])}
    assert {(r["doc_id"], r["first_doc_id"]) for r in got} == {(3, 2)} and len(covered) >= 50 and covered <= set(range(60))


def test_repeated_lines_of_unlike_lengths_equal_brute_force(spark):
    """An earlier document repeats a line too few times for 50 words, later ones much more often, or between the same words."""
    rows = []
    for period in (1, 3, 8, 37, 40):
        for order in (range(12), (4, 0, 3, 5, 2, 1, 8, 6, 7, 10, 11, 9), (0, 3), (1, 2), (2, 1)):
            own = len(rows)
            run = [f"l{own}x{i}" for i in range(period)] * 300
            other = [f"{c}{own}x{i}" for c in "mn" for i in range(6)]
            texts = [
                ["a"] + run[:48] + ["b"], other[:6] + run[:80] + other[6:], other[:6] + run[:40] + other[6:], run[:240], ["c", *run[:46], "d"], run[:240] + ["e"],
                ["f", *run[3:52], "g"], run[5:60], other[:6] + run[:43] + other[6:], run[:period][::-1] * 60, run[:41] + ["h"] + run[:240] + ["i"] + run[:49], run[:500],
            ]
            rows += [(own + n, " ".join(texts[i])) for n, i in enumerate(order)]
    rows += [(len(rows) + n, f"only{n} " * 3) for n in range(20)]
    found: dict[int, set] = {i: set() for i, _ in rows}
    for p in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert p["n_words"] >= 50 and p["first_doc_id"] < p["doc_id"]
        found[p["doc_id"]] |= set(range(p["start_word"], p["start_word"] + p["n_words"]))
    brute = brute_repeated(rows)
    assert {i: w for i, w in found.items() if w != brute[i]} == {}


def test_repeats_cut_and_odd_rows(spark):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"head one {shared} tail", "en", "s", 1), (2, f"other  start\n{shared}\nend", "en", "s", 1), (3, shared, "en", "s", 1), (4, "clean text stays", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in repeats.stage(spark, docs, "").collect()}
    assert kept == {1: rows[0][1], 2: "other  start\nend", 4: "clean text stays"}
    odd = repeats.stage(spark, odd_docs(spark), "")
    assert odd.columns == odd_docs(spark).columns and odd.count() == 8  # the later of two equal long texts goes
    assert repeats.stage(spark, empty_docs(spark), "").count() == 0


def test_packing_places_every_token_once(spark):
    docs = odd_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(i, "token " * (i % 900)) for i in range(100, 600)], "doc_id long, text string"))
    rows = packing.pack(docs).collect()
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert sum(r["length"] for r in rows) == sum(len(packing.token_ids(d["text"])) for d in docs.collect())
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    filled = sum(r["length"] for r in rows) / (len(by_sequence) * packing.WINDOW)
    assert filled > 0.97
    assert packing.pack(empty_docs(spark)).count() == 0


def test_packing_ids_are_the_tokenizers_own():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    space = "\n \t\u3000\x85\u2003"
    texts = ["", " ", "Hello  world\n\tdon't <|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x  <|endoftext|", "é漢\U0001f600 " * 50, "x" * 3000, "a1b22 333  \r\n"]
    for n in (255, 256, 257, 1000, 1_000_000):
        texts += [" " * n, "a" + " " * n + "b", "\n" * n + "1 2", " ." + space * (n // 6 + 1), "\x1c" * min(n, 1000) + "x" + "\t" * n + "<|endoftext|>" + " " * n + "<"]
    r = random.Random(8)
    texts += ["".join(r.choice(["a", "Ä", "1", " ", "  ", ".", "'s", "\n", space, " " * 300, "\r\n" * 200, "<|endoftext|>", "\u0301", "\U0001f600"]) for _ in range(40)) for _ in range(300)]
    for text in texts:
        assert packing.token_ids(text)[:-1].tolist() == own.encode(text, add_special_tokens=False).ids, text[:80]


def test_packing_of_repeated_and_odd_rows_by_the_contracts_tokenizer(spark):
    """Every row's pieces hold its ids in order; rows that repeat one id share the work of ranking."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(7, "same text " * 30)] * 400 + [(None, "no id")] * 300 + [(1, " " * 1_000_000), (2, None), (3, ""), (4, "a <|endoftext|> b"), (5, "word " * 9000)]
    want: dict[tuple, int] = {}
    for i, text in rows:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            key = (i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    got: dict[tuple, int] = {}
    places = set()
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        key = (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
        got[key] = got.get(key, 0) + 1
        places.add((r["sequence_id"], r["offset"]))
    assert got == want and len(places) == sum(want.values())
    chunks = packing.cut_pieces(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 7").select("copy").distinct().count()
    assert chunks >= 100


@pytest.mark.parametrize(("short", "fill"), [(False, 0.93), (True, 0.998)])
def test_packing_plan_covers_a_histogram(short, fill):
    """Random lengths fill less where there are few short pieces, as pieces are not cut to fit; with as many short ones as texts have, nearly all."""
    r = random.Random(4)
    h = {n: r.randint(1, 500) for n in r.sample(range(1, 2049), 300)}
    if short:
        h |= {n: 400 for n in range(1, 200)}
    where = packing.plan(h)
    sequences = set()
    for length, first, k, base, _ in where.tolist():
        later = [w for w in where.tolist() if w[0] == length and w[1] > first]
        stop = min((w[1] for w in later), default=h[length])
        sequences |= set(range(base, base + (stop - first) // k))
    assert len(sequences) == max(sequences) + 1
    assert sum(n * c for n, c in h.items()) / (len(sequences) * 2048) > fill


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    r = random.Random(5)
    texts = ["", " ", "   ", "a  b\n c\td  ", "The unbelievable, the unbelievably!", "漢字 é́ \x00 \U0001f600", " " * 100 + "x", "zz" * 500, "<s> <unk> <0x0A>"]
    texts += ["".join(r.choice("abcdeth  .") for _ in range(r.randint(1, 400))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    encoded = pieces.encode(docs, ["doc_id"])
    got = {x["doc_id"]: x["ids"] for x in encoded.collect()}
    assert got.pop(len(texts)) is None
    assert [got[i] for i in range(len(texts))] == own.encode(texts)
    back = {x["doc_id"]: x["text"] for x in pieces.decode(encoded, ["doc_id"]).collect()}
    assert [back[i] for i in range(len(texts) + 1)] == [*texts, None]
    assert pieces.encode(empty_docs(spark), ["doc_id"]).count() == 0
    assert pieces.encode(odd_docs(spark), ["doc_id", "x"]).count() == 9


def test_scored_pieces_equal_brute_force():
    """Of all ways to cut a word into pieces, the one with the largest sum of scores."""
    p = pieces.pieces()
    lacking = min(p.score.values()) - 10.0

    def best(word):
        sums = {0: (0.0, ())}
        for end in range(1, len(word) + 1):
            ways = [(sums[a][0] + p.score[word[a:end]], (*sums[a][1], word[a:end])) for a in range(end) if word[a:end] in p.id_of]
            ways.append((sums[end - 1][0] + lacking, (*sums[end - 1][1], word[end - 1])))
            sums[end] = max(ways, key=lambda w: w[0])
        return sums[len(word)]

    r = random.Random(12)
    words = {pieces.MARK + "".join(r.choice("abcdeinorst漢\U0001f600") for _ in range(r.randint(0, 14))) for _ in range(400)} | {pieces.MARK + w for w in "the unbelievable unbelievably then there thesis".split()}
    got = p.encode_scored(words)
    for word in words:
        value = sum(p.score[p.name[i]] for i in got[word] if p.name[i] in p.id_of) + lacking * sum(c not in p.id_of for c in word)
        assert value == best(word)[0]
        assert b"".join(p.bytes_of[i] for i in got[word]).decode() == word.replace(pieces.MARK, " ")


def test_pieces_of_rows_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a text", "kept", 5)], "doc_id long, text string, ids string, result long")
    out = pieces.encode(docs, ["text", "ids", "result"])
    assert out.columns == ["ids", "text", "ids_", "result"]
    back = pieces.decode(out, ["text", "ids_"])
    assert back.columns == ["text", "text_", "ids_"] and tuple(back.first()) == ("a text", "a text", "kept")


def labelled(spark, n=400):
    r = random.Random(6)
    parts = {"en": "the and of to in that with this from have".split(), "de": "der die und nicht mit ein ist auf für über".split(), "fr": "le la et les des une pour dans être déjà".split(), "es": "el los que una por para con está niño según".split()}
    rows = []
    for i in range(n):
        lang = r.choice(list(parts))
        rows.append((i, " ".join(r.choice(parts[lang]) for _ in range(r.randint(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id_on_held_out_rows(spark):
    docs = labelled(spark)
    model = langid.train(docs, F.col("doc_id") % 4 != 0, per_lang=60)
    assert model.families == ["germanic", "romance"] and [len(p) for p in model.pairs.values()] == [1, 1]
    out = langid.identify(docs.filter("doc_id % 4 = 0"), model, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    assert all(0 <= r["lang_score"] <= 1 for r in out)


def test_language_id_of_odd_rows(spark):
    docs = odd_docs(spark)
    out = langid.identify(docs, langid.train(labelled(spark, 200), F.lit(True)), docs.columns)
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in out.collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[8][0] != "und"
    assert langid.stage(spark, docs, "").columns == docs.columns
    none = langid.train(docs.filter("lang IS NULL"), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, none, ["doc_id"]).collect()} == {"und"}
    assert langid.stage(spark, empty_docs(spark), "").count() == 0


def test_language_features_do_not_depend_on_slices(monkeypatch):
    r = random.Random(9)
    for _ in range(60):
        texts = string_buffer(pa.array(["".join(r.choice("abÀé É12 .\n") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 6))]))
        whole = langid.gram_shares(*texts)
        for size in (3, 7, 64):
            monkeypatch.setattr(langid, "SLICE", size)
            assert np.array_equal(langid.gram_shares(*texts), whole)
        monkeypatch.undo()


def test_language_sample_is_bounded_and_repeated_rows_push_nothing_out(spark):
    """Two thirds of all rows are one text without an id: it is learned from once, and every language keeps its share."""
    docs = labelled(spark, 300).unionByName(spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text of all").alias("text"), F.lit("en").alias("lang")))
    model = langid.train(docs, F.lit(True), per_lang=50)
    out = langid.identify(docs.filter("doc_id IS NOT NULL"), model, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    few = langid.train(docs, F.lit(True), per_lang=50, most=40, most_langs=3)
    assert sum(len(m) for m in few.members.values()) == 3


def insults(spark, n=600):
    r = random.Random(7)
    clean = [f"{a}{b}" for a in ("th", "re", "an", "on", "ea", "st") for b in ("er", "ing", "tion", "nd", "ly", "ou")]
    bad = ["wretchling", "dunderhead", "scumbucket"]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(clean) for _ in range(r.randint(10, 80))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows_and_disguised_words(spark):
    docs, labels = insults(spark)
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1, per_class=300)
    out = toxicity.score_texts(docs.filter("doc_id % 3 = 1"), model, ["doc_id"]).collect()
    assert np.mean([(r["toxic_score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 4 == 0) for r in out]) > 0.98

    def score(*texts):
        return model.score(toxicity.pooled(*string_buffer(pa.array(texts)), model.landmarks).astype(float))

    for disguised in ("dunder-head d.u.n.d.e.r.h.e.a.d wretch_ling", "d u n d e r h e a d and wretchlinng scumbuckeet", "Dunderheads! Wretchlings, SCUMBUCKET"):
        assert score(f"ther {disguised} onnd")[0] > toxicity.THRESHOLD
    assert max(score("ther onnd rely", "", None)) < toxicity.THRESHOLD
    assert (tuple(score("", None)) == (score("")[0],) * 2)


@pytest.mark.parametrize("put", ["x", "1", "q"])
def test_toxicity_of_words_with_characters_put_in(spark, put):
    """One character at one, two and every position of an insult; clean words stay clean."""
    docs, labels = insults(spark)
    model = toxicity.train(docs, labels, F.lit(True), per_class=300)

    def score(*texts):
        return model.score(toxicity.pooled(*string_buffer(pa.array(texts)), model.landmarks).astype(float))

    for word in ("wretchling", "dunderhead", "scumbucket"):
        n = len(word)
        disguised = [word[:i] + put + word[i:] for i in range(1, n)] + [word[:i] + put + word[i:j] + put + word[j:] for i in range(1, n) for j in range(i + 1, n)] + [put.join(word)]
        assert score(*[f"ther {d} onnd" for d in disguised]).min() > toxicity.THRESHOLD
    clean = [r["text"] for r in docs.filter("doc_id % 4 <> 0").collect()]
    assert score(*clean, "ther onnd rely", "wren dune scum bucket head ling").max() < toxicity.THRESHOLD
    x = toxicity.pooled(*string_buffer(pa.array(["ixdxixoxt", "i1d1i1o1t", "idxixoxt", "traditional", "radio"])), [b"idiot"])[:, 0]
    assert x[:3].min() > 0.5 > 0.3 > x[3:].max()


def test_string_kernel_equals_brute_force():
    def brute(s, t, p=toxicity.ORDER, decay=toxicity.DECAY):
        from itertools import combinations

        def weights(w):
            out: dict = {}
            for at in combinations(range(len(w)), p):
                u = tuple(w[i] for i in at)
                out[u] = out.get(u, 0.0) + decay ** (at[-1] - at[0] + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(v * b.get(u, 0.0) for u, v in a.items())

    words = [b"idiot", b"id-iot", b"tidiiot", b"abc", b"xyzzyx"]
    rows = np.zeros((len(words), toxicity.WIDTH), np.uint8)
    for i, w in enumerate(words):
        rows[i, : len(w)] = np.frombuffer(w, np.uint8)
    for t in words:
        assert np.allclose(toxicity.kernel(rows, np.frombuffer(t, np.uint8)), [brute(w, t) for w in words], rtol=1e-4)


def test_toxicity_of_odd_rows(spark):
    docs, labels = insults(spark, 200)
    odd = odd_docs(spark)
    model = toxicity.train(docs, labels, F.lit(True))
    assert toxicity.score_texts(odd, model, odd.columns).count() == 9
    nothing = toxicity.train(odd, labels.limit(0), F.lit(True))
    assert {r["toxic_score"] for r in toxicity.score_texts(odd, nothing, ["doc_id"]).collect()} == {0.0}
    assert toxicity.score_texts(empty_docs(spark), model, ["doc_id"]).count() == 0


def test_shards_move_only_into_the_new_one(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    tree = sharding.balanced_tree(8)
    out = sharding.assign_shards(docs, tree, sharding.grow(tree)).toPandas()
    assert ((out.grown_shard == out.shard) | (out.grown_shard == 8)).all()
    assert 300 < (out.grown_shard == 8).sum() < 600
    assert out.groupby("shard").size().between(400, 600).all()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    heavy = {**tree, "r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 3.0, 3: 1.0}}}
    before, after = (spark.range(4000).select("id", sharding.shard_of(F.col("id"), t).alias("s")).toPandas() for t in (tree, heavy))
    moved = before.s != after.s
    assert moved.any() and after.s[moved & ~before.s.isin([0, 1, 2, 3])].isin([0, 1, 2, 3]).all() and not (moved & after.s.isin([4, 5, 6, 7])).any()


def test_shards_of_odd_rows(spark):
    tree = sharding.balanced_tree(8)
    out = {(r["doc_id"], r["slot"]): r for r in sharding.assign_shards(odd_docs(spark), tree, sharding.grow(tree)).collect()}
    assert len(out) == 9
    assert [r["size"] for r in out.values() if r["doc_id"] in (2, 3)] == [1, 1]
    assert sharding.assign_shards(empty_docs(spark), tree).count() == 0


PAGE = """<html><head><title>t</title><script>var a='</p>';</script></head><body><header>Site</header><nav class="menu1"><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="post-{n} body"><h1>Head &amp; line</h1><p>First  para&nbsp;graph <b>bold<br>text, and more of it, at length.<p>Second &lt;one&gt;, still going on.
<aside>side</aside><form><input>form text</form></div><div id="comments"><p>reader says, something long, very long indeed, longer than all of the article, by far, it goes on, and on</p></div><footer>&copy; foot</footer></body></html>"""


def test_main_text_of_pages(spark):
    rows = [(i, f"http://Host.example/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    rows += [(7, "http://host.example/x", ""), (8, None, None), (9, "nonsense", "just text, no tags &amp; more"), (10, "http://host.example/y", "<div class='post-9 body'><p>cut off here <a"), (0, rows[0][1], rows[0][2])]
    out = sorted((r["page_id"], r["text"]) for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect())
    text = "Head & line First para graph bold text, and more of it, at length. Second <one>, still going on."
    assert out == sorted([*((i, text) for i in (0, 0, 1, 2, 3, 4)), (7, ""), (8, ""), (9, "just text, no tags & more"), (10, "cut off here <a")])
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_marked_article_is_read_whole():
    page = "<main><article class='a1'><div class='entry-header'><h1>Head</h1></div><div class='lead'><p>Lead text.</p></div><div class='story'><p>The story, which is long, and longer, and holds most words.</p></div><section class='reader-comments'><p>Me too, me too, me too, me too.</p></section></article><div class='related'>More</div></main>"
    assert htmltext.best_path(*htmltext.blocks(page)) == "main/article.a#"
    assert htmltext.extract(page, "main/article.a#") == "Head Lead text. The story, which is long, and longer, and holds most words."


def test_pages_without_a_marked_article_are_read_whole():
    """Heading and lead beside the story, two sections, and a list or table that is most of the page; menus of links stay out."""
    links = "<div class='top'>" + "".join(f"<a href='/{i}'>Somewhere else {i}</a> " for i in range(30)) + "</div>"
    story, lead = "The story is told here at length. " * 30, "What the story is about, told in some words before it. " * 2
    parts = [
        ([("<h1>Head</h1>", "Head"), (f"<div class='lead'><p>{lead}</p></div>", lead), (f"<div class='story'><p>{story}</p></div>", story)]),
        ([("<h1><a href='/x'>Head of it</a></h1>", "Head of it"), (f"<section class='one'><p>{story}</p></section>", story), (f"<section class='two'><p>{lead}</p></section>", lead)]),
        ([("<h2>Steps</h2><p>Do this:</p>", "Steps Do this:"), ("<ul>" + f"<li>{lead}</li>" * 20 + "</ul>", lead * 20), ("<p>Done.</p>", "Done.")]),
        ([("<p>Prices of all kinds.</p>", "Prices of all kinds."), ("<table><tr>" + f"<td>{lead}</td>" * 20 + "</tr></table>", lead * 20)]),
    ]
    for part in parts:
        inner, text = "".join(h for h, _ in part), " ".join(" ".join(t.split()) for _, t in part)
        for page in (f"<html><body>{links}<div class='post'>{inner}</div></body></html>", f"<html><body>{links}{inner}</body></html>", f"{links}{inner}", f"<body><div><div class='post'>{inner}</div>{links}</div></body>"):
            path = htmltext.best_path(*htmltext.blocks(page))
            assert htmltext.extract(page, path) == text and htmltext.extract(page, None) == text


def test_host_consensus_beats_one_page(spark):
    """A page whose longest container is not the host's article path is read from the host's path."""
    usual = "<body><div class='story'><p>{t}, a story, told at length, with commas, and words.</p></div><div class='extra'><p>x</p></div></body>"
    odd = "<body><div class='story'><p>Short.</p></div><div class='extra'><p>Much longer, but it is not the story, as other pages show, of this host.</p></div></body>"
    rows = [(i, "http://h.example/a", usual.replace("{t}", f"Tale {i}")) for i in range(4)] + [(9, "http://h.example/b", odd)]
    out = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[9] == "Short."


class Reader(HTMLParser):
    """Text of well-formed pages without the elements that a page drops, by Python's own parser; a block is what lies between two block tags."""

    OUT = {"nav", "footer", "aside", "form", "script", "style", "button"}
    VOID = {"br", "img", "hr"}
    INLINE = {"b", "i", "a", "em", "span"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.parts = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag not in self.INLINE or self._dropped(tag, attrs):
            self.parts.append("")
        if tag not in self.VOID:
            self.open.append(self._dropped(tag, attrs))

    def _dropped(self, tag, attrs):
        return tag in self.OUT or dict(attrs).get("class") in ("notice", "promo", "ad")

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.parts.append("")
        self.open.pop()

    def handle_data(self, data):
        if not any(self.open):
            self.parts[-1] += data


def read_page(page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    return " ".join(" ".join(p.split()) for p in reader.parts if p.split())


def made_page(r):
    """A page of nested elements with all end tags."""
    words = ["word", "another", "tale", "&amp;", "caf\u00e9", "x &lt; y", "it's", "&#8212;", "long,", "end."]

    def line():
        out = []
        for _ in range(r.randint(3, 14)):
            w = r.choice(words)
            out.append(r.choice([w, w, w, w, f"<b>{w}</b>", f"<em title=don't>{w}</em>", f"<a href=/x/y>{w}</a>", f"<span class=ad>{w}<span>{w}</span>{w}</span>", w + "<br>"]))
        return r.choice([" ", "\n ", "  "]).join(out)

    def part(depth):
        kind = r.choice(["p", "p", "p", "ul", "dl", "table", "div", "h2", "notice", "li", "script", "blockquote"] if depth < 3 else ["p"])
        if kind == "p":
            return f"<p>{line()}</p>"
        if kind == "notice":
            return f"<p class='notice'>{line()}</p>"
        if kind == "h2":
            return f"<h2>{line()}</h2>"
        if kind == "script":
            return "<script>if (a < b) { document.write('</p><p>no'); }</script><!-- <p>none</p> -->"
        if kind in ("ul", "li"):
            return "<ul>" + "".join(f"<li{r.choice(['', '', ' class=promo'])}>{line()}{''.join(part(depth + 1) for _ in range(r.randint(0, 1)))}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
        if kind == "dl":
            return "<dl>" + "".join(f"<{t}{r.choice(['', ' class=ad'])}>{line()}</{t}>" for t in r.choices(["dt", "dd"], k=4)) + "</dl>"
        if kind == "table":
            cells = lambda: "".join(f"<td{r.choice(['', '', ' class=ad'])}>{line()}{''.join(part(depth + 1) for _ in range(r.randint(0, 1)))}</td>" for _ in range(r.randint(1, 3)))
            return "<table><tbody>" + "".join(f"<tr>{cells()}</tr>" for _ in range(r.randint(1, 3))) + "</tbody></table>"
        inner = "".join(part(depth + 1) for _ in range(r.randint(1, 3)))
        return f"<{kind} class='c{depth}'>{inner}</{kind}>"

    body = "".join(part(0) for _ in range(r.randint(3, 8)))
    return f"<html><body><nav><a href=/>Home</a></nav><article class=story><h1>Head of it</h1>{body}</article><aside>Side words here</aside><footer>Foot</footer></body></html>"


@pytest.mark.parametrize("seed", range(60))
def test_main_text_equals_another_parsers(seed):
    """With all end tags the text is that which Python's parser gives; with those left out that may be, it stays the same."""
    whole = made_page(random.Random(seed))
    assert htmltext.extract(whole, None) == read_page(whole)
    r = random.Random(seed + 1000)
    dropped = whole
    for tag, follows in (("p", r"(?=\s*(?:<(?:p|ul|dl|table|div|h2|blockquote)\b|</(?:div|blockquote|article|li|td)>))"), ("li", r"(?=\s*(?:<li\b|</ul>))"), ("dt|dd", r"(?=\s*(?:<d[td]\b|</dl>))"), ("td|tr|tbody", r"(?=\s*(?:<t[dr]\b|</t|</table>))")):
        for _ in range(3):
            dropped = re.sub(f"</(?:{tag})>{follows}", lambda m: "" if r.random() < 0.5 else m[0], dropped)
    assert htmltext.extract(dropped, None) == read_page(whole), dropped


STORY = "<h1>Head of it</h1>" + "".join(f"<p>Paragraph {i} of the story, which is long enough, as stories are, to be one.</p>" for i in range(6))
STORY_TEXT = "Head of it " + " ".join(f"Paragraph {i} of the story, which is long enough, as stories are, to be one." for i in range(6))


@pytest.mark.parametrize("wrapper", [
    "div class='content with-sidebar'", "div class='post comments-open'", "div id='main' class='no-ads layout-nav-top'", "section class='social-science'", "div class='alert-box-none'", "div class='has-menu'",
    "div class='notice'", "div id=widget", "div class='entry-content share-none'", "div class='navigation-systems'", "table class='header-image'", "div class=postHeader",
])
@pytest.mark.parametrize("marked", [True, False])
def test_names_of_several_parts_keep_a_story(wrapper, marked):
    """A class drops an element only as a whole name or a known compound, and never the story itself."""
    tag = wrapper.split()[0]
    inner = f"<article>{STORY}</article>" if marked else STORY
    inner = f"<tr><td>{inner}</td></tr>" if tag == "table" else inner
    page = f"<body><div class='site-header'><p>Site name</p></div><nav><a href=/>Home</a></nav><{wrapper}>{inner}</{tag}><div class='widget-area'><p>Side</p></div><div id=siteFooter><p>Foot words</p></div><ol class='comment-list'><li>A reader says much, at length, here.</li></ol></body>"
    assert htmltext.extract(page, None) == STORY_TEXT
    assert htmltext.extract(page, htmltext.best_path(*htmltext.blocks(page))) == STORY_TEXT


@pytest.mark.parametrize("kind", ["section class='social-science'", "p class='alert-box-none'", "label", "map", "div class='with-ads'"])
def test_parts_of_an_article_stay(kind):
    tag = kind.split()[0]
    page = f"<body><article><p>One of the story.</p><{kind}>Two of it</{tag}><p>Three of it.</p></article><div class='sidebar-2'>Side</div></body>"
    assert htmltext.extract(page, None) == "One of the story. Two of it Three of it."


@pytest.mark.parametrize("name", "site-header widget-area sidebar comments-section comment-list share-buttons related-posts cookie-banner ad-slot ads newsletter-signup main-nav breadcrumb-list post-comments left-sidebar siteFooter".split())
def test_names_and_known_compounds_drop(name):
    assert htmltext.extract(f"<body><div class='{name} x'><p>Not of it, but beside it.</p></div><div class=story>{STORY}</div></body>", None) == STORY_TEXT


def test_heading_and_lead_before_an_article():
    page = f"<body><nav><a href=/>Home</a></nav><div class=page><h1>Head</h1><p class=lead>Lead text.</p><article>{STORY}</article></div><footer>Foot</footer></body>"
    for winner in (None, htmltext.best_path(*htmltext.blocks(page))):
        assert htmltext.extract(page, winner) == f"Head Lead text. {STORY_TEXT}"
    beside = f"<body><p>Stray</p><article>{STORY}</article></body>"
    assert htmltext.extract(beside, None) == STORY_TEXT
    others = f"<body><div class=page><article>{STORY}</article><div class=more><p>Another thing, told elsewhere.</p></div></div></body>"
    assert htmltext.extract(others, None) == STORY_TEXT


def test_long_comments_are_not_taken_for_the_story():
    comments = "".join(f"<p>Reader {i} says something, at some length, about it all.</p>" for i in range(60))
    assert htmltext.extract(f"<body><div class=story><p>Short story, told.</p></div><div class=comments>{comments}</div></body>", None) == "Short story, told."


def test_blocks_that_nothing_ends():
    for page, text in [
        ("<div class='story'><p class='notice'>Cookies<p>First paragraph.<p>Second.</div>", "First paragraph. Second."),
        ("<ul><li class='promo'>Ad<li>Point one is long<li>Point two</ul>", "Point one is long Point two"),
        ("<div><p title=don't>Some text here</p></div>", "Some text here"),
        ("<table><tr><td class=ad>Ad<td>Main text<tr><td>more text</table>", "Main text more text"),
        ("<select><option class=ad>x<option>y</select><p>Text of it</p>", "Text of it"),
        ('<p title="broken>One two three</p><p>four</p>', "One two three four"),
        ("<div class='w-1/2'><p>Half of it</p></div>", "Half of it"),
        ("a < b and c <!-- d", "a < b and c"),
        ("<div><b class=ad>x<p>y</b>Some text</div>", "Some text"),
    ]:
        assert htmltext.extract(page, None) == text
        assert htmltext.extract(page, htmltext.best_path(*htmltext.blocks(page))) == text


@pytest.mark.parametrize("unit", ["<a ", "<!", "<div>", "<b></i>", "<li>", "<p><table>", "<script></script", '<a x="', "<a x=\"<b y='>'\" x=\"", "<span class=ad>", "<h1>", "&amp", "='\"", "<ul><li class=ad>"])
def test_broken_pages_take_time_in_proportion(unit):
    import time

    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    htmltext.extract(page, None)
    assert time.process_time() - began < 10  # a second or two; what is square takes hours


def test_pages_of_many_hosts_are_joined(spark):
    """With more hosts than may be broadcast the large ones are, and the others are joined."""
    page = "<body><div class='{c}'><p>Text {i}, of this page, long enough.</p></div><div class='x'><p>y</p></div></body>"
    rows = [(i, f"http://h{min(i, 20)}.example/", page.replace("{c}", "a" if i % 2 else "b").replace("{i}", str(i))) for i in range(60)] + [(99, None, "<p>No host</p>"), (100, "http://other.example", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, htmltext.main_text(pages, most_hosts=4).collect()), key=str) == sorted(map(tuple, htmltext.main_text(pages).collect()), key=str)
