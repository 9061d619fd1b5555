"""Substring search over posting lists against the scan."""

import os
import random

from pyspark.sql import functions as F

from codefacts import corpus, search, store, trigrams

PIECES = ["Health", "GetMax", "void ", "ΑΣ", "ΑΣΑ", "İx", "ß", "😀", "a😀b", "%", "_", "\\", "\n", "zz", "Tick", "()", "ŁÓDŹ"]
PATTERNS = ["health", "GETMAX", "void g", "ας", "ΑΣΑ", "ασα", "i̇x", "😀b", "x😀", "h%tick", "t_ck", "a\\%", "%", "_", "zz", "lthget", "łódź", "nothing at all", "\\", "h\\", "", "k()%zz"]


def texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(PIECES) for _ in range(draw.randrange(0, 9))) for _ in range(n)]


def test_code_search_by_index_equals_the_scan(spark):
    files = spark.createDataFrame([(i, 1 + i % 2, f"f{i}.h") for i in range(60)], "file_id long, codebase_id long, relative_path string")
    symbols = spark.createDataFrame([(i % 60, i, t) for i, t in enumerate(texts(300, 1))] + [(3, 1, None)], "file_id long, line_start int, raw_text string")
    references = spark.createDataFrame([(i % 60, i, t) for i, t in enumerate(texts(300, 2))], "file_id long, line_number int, context string")
    sources = spark.createDataFrame(list(enumerate(texts(59, 3))) + [(59, None)], "file_id long, content string")
    index = search.code_trigrams(symbols, references, files, sources).cache()
    for escape in (False, True):
        asked = PATTERNS if escape else [p for p in PATTERNS if p not in ("\\", "h\\")]  # a lone escape sign before the last wildcard changes its meaning only
        rows = [sorted(map(tuple, search.search_code(symbols, references, files, asked, 1, 10_000, escape, sources, index=i).collect())) for i in (None, index)]
        assert rows[0] == rows[1] and len(rows[0]) > 500


def test_symbols_by_index_equal_the_scan(spark):
    symbols = spark.createDataFrame([(i, t, f"A::{t}" if i % 3 else None, "method") for i, t in enumerate(texts(500, 4))], "id long, name string, qualified_name string, kind string")
    index = search.symbol_trigrams(symbols)
    asked = ["::health", "tickge", "h%tick", "ti", "zzz", "ας"]
    rows = [sorted(map(tuple, search.search_symbols_fallback(symbols, asked, limit=limit, index=i).collect())) for limit in (None, 7) for i in (None, index)]
    assert rows[0] == rows[1] and rows[2] == rows[3] and rows[0]


def test_lists_are_bounded_and_hold_every_key_once(spark):
    rows = spark.range(3000).select(F.col("id").alias("file_id"), F.concat(F.lit("Common"), (F.col("id") % 7).cast("string")).alias("text"))
    index = trigrams.build_trigram_index(rows.unionByName(rows), block=200).collect()
    assert max(len(r["keys"]) for r in index) < 320
    assert sorted(k for r in index if r["gram"] == "com" for k in r["keys"]) == list(range(3000))
    assert sorted(k for r in index if r["gram"] == "on3" for k in r["keys"]) == list(range(3, 3000, 7))


def test_empty_tables_and_nulls(spark):
    empty = spark.createDataFrame([], "file_id long, text string")
    index = trigrams.build_trigram_index(empty)
    assert index.collect() == [] and trigrams.candidates(index, ["abc", "x"]).collect() == []
    some = trigrams.build_trigram_index(spark.createDataFrame([(1, None), (None, "abc"), (2, "ab"), (3, "xABCx")], empty.schema))
    assert [tuple(r) for r in trigrams.candidates(some, ["abc", "ab", "bcd"]).collect()] == [("abc", 3)]
    assert trigrams.split(spark, ["abc", "a%bc", "", "ab_cde"]) == (["abc", "ab_cde"], ["a%bc", ""])


def test_only_files_that_can_match_are_opened(spark, tmp_path):
    """All other files are deleted once the index is made; a scan would fail on them."""
    root = tmp_path / "Source"
    root.mkdir()
    for i in range(120):
        (root / f"f{i:03d}.h").write_text(f"// file {i}\nint Value{i};\n" + ("void Needle();\r\n" if i % 40 == 7 else "") + ("void NeedLess();\n" if i % 40 == 8 else ""))
    listing = corpus.discover_files(spark, str(root)).withColumn("file_id", F.xxhash64("relative_path")).withColumn("codebase_id", F.lit(1).cast("long")).cache()
    assert listing.count() == 120
    index = trigrams.build_trigram_index(corpus.read_sources(listing).withColumnRenamed("content", "text"))
    store.write_index({"trigrams": index}, f"{tmp_path}/index")
    stored = store.read_index(spark, f"{tmp_path}/index", ["trigrams"])["trigrams"]
    for i in range(120):
        if i % 40 != 7:
            os.remove(root / f"f{i:03d}.h")
    assert trigrams.candidates(stored, ["NEEDLE()"]).count() == 3
    got = sorted((r["q"], r["path"], r["line_number"], r["text"]) for r in search.search_sources(listing, stored, "NEEDLE()").collect())
    assert got == [("NEEDLE()", f"f{i:03d}.h", 3, "void Needle();") for i in (7, 47, 87)]
