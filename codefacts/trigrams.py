"""Substring search by three-character posting lists: which files, symbols or other keys can hold a pattern at all.

An index is a table (gram, part, keys): the keys whose lower-case text holds the gram, dealt by their hash to parts, so that no list
grows with the corpus (about ``BLOCK`` keys). With codebase_id in the rows it is kept for each codebase, so an index can be written as one more table of
``store.write_index``. A pattern's grams select their lists where these are read; lists of one part are intersected in one row. What is
left is a superset of the hits, which an exact ``ilike`` tests; patterns without three characters in a row are answered by a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4096
#: every three characters that stand together, found by looking ahead, so they overlap
GRAM = "(?s)(?=(...))"


def like_pattern(q: str, escape: bool) -> str:
    """The LIKE pattern of what contains q; with escape, its wildcards stand for themselves."""
    if escape:
        for c in "\\%_":
            q = q.replace(c, "\\" + c)
    return f"%{q}%"


def literal_parts(pattern: str) -> list[str]:
    """The stretches of a LIKE pattern between its wildcards, as they stand in a text that it matches."""
    parts, at, i = [""], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c in "%_":
            parts.append("")
            at += 1
        else:
            i += c == "\\" and i + 1 < len(pattern)
            parts[at] += pattern[i]
        i += 1
    return [p for p in parts if p]


def pattern_parts(spark: SparkSession, patterns: list[str], escape: bool = False) -> dict[str, list[str]]:
    """The literal stretches of each pattern, in lower case as Spark makes it, so as texts become."""
    asked = list(dict.fromkeys(patterns))
    if not asked:
        return {}
    table = spark.createDataFrame([(q, like_pattern(q, escape)) for q in asked], "q string, pattern string")
    lower = {r["q"]: r["p"] for r in table.select("q", F.lower("pattern").alias("p")).collect()}  # what the caller typed
    return {q: literal_parts(lower[q]) for q in asked}


def pattern_grams(spark: SparkSession, patterns: list[str], escape: bool = False) -> dict[str, list[str]]:
    """The grams that a text must hold for each pattern; none for a pattern that is too short."""
    parts = pattern_parts(spark, patterns, escape)
    return {q: sorted({p[i : i + 3] for p in ps for i in range(len(p) - 2)}) for q, ps in parts.items()}


def build_trigram_index(rows: DataFrame, key: str = "file_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """gram, part, keys (and codebase_id, if rows have it) of rows (key, text); a key may have several texts, null ones have no grams."""
    by = [c for c in ("codebase_id",) if c in rows.columns]
    some = rows.filter(F.col(key).isNotNull() & F.col(text).isNotNull())
    parts = max(1, -(-some.select(key).distinct().count() // block))
    grams = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(GRAM), F.lit(1))))
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    return some.select(*by, part.alias("part"), F.col(key).alias("key"), grams.alias("gram")).groupBy(*by, "gram", "part").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, patterns: list[str], escape: bool = False) -> DataFrame:
    """q, key: all keys whose texts hold every gram of a pattern. Patterns without grams have no rows here: they need a scan (see ``split``)."""
    spark = index.sparkSession
    by = [c for c in ("codebase_id",) if c in index.columns]
    grams = pattern_grams(spark, patterns, escape)
    listed = [(q, g, len(gs)) for q, gs in grams.items() for g in gs]
    wanted = spark.createDataFrame(listed, "q string, gram string, n int")
    lists = index.filter(F.col("gram").isin(sorted({g for _, g, _ in listed}))).join(wanted, "gram").groupBy(*by, "part", "q", "n").agg(F.collect_list("keys").alias("lists")).filter(F.size("lists") == F.col("n"))
    shared = F.aggregate(F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.get("lists", F.lit(0)), F.array_intersect)
    return lists.select("q", F.explode(shared).alias("key")).distinct()


def split(spark: SparkSession, patterns: list[str], escape: bool = False) -> tuple[list[str], list[str]]:
    """(patterns that an index answers, patterns that are too short for it)."""
    grams = pattern_grams(spark, patterns, escape)
    return [q for q in grams if grams[q]], [q for q in grams if not grams[q]]
