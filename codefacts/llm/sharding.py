"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree of regions, racks and weighted shards is descended from the top. At each node every child draws
``-ln(u) / weight`` with u from a hash of (document id, child name), and the smallest draw wins, so a child
gets rows in proportion to its weight. Changing a weight only changes the draws of the nodes above it:
rows move into or out of those subtrees and nowhere else. ``grow`` adds a shard in a region of its own,
so rows move into that shard only.

Edge cases: a null id draws as the empty text, a null text has no bytes (size 1, crc32 0), repeated rows get
one slot each, an empty table gives an empty result, and further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
_DRAW_BITS, _CHUNK_DIGITS = 52, 3


def balanced_tree(shards: int, racks: int = 2, per_rack: int = 2) -> Tree:
    """Shards 0.. of weight 1, per_rack to a rack and racks to a region."""
    out: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        out.setdefault(f"r{rack // racks}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return out


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, alone in a new region: all older nodes keep their weights and draws."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return {**tree, f"r+{new}": {f"k+{new}": {new: weight}}}


def _hash52(key: Column, name: str) -> Column:
    digest = F.md5(F.concat(key, F.lit(f":{name}")).cast("binary"))
    return F.conv(F.substring(digest, 1, _DRAW_BITS // 4), 16, 10).cast("long")


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What belongs to the child with the smallest draw; ties go to the earlier child."""
    if len(children) == 1:
        return children[0][2]
    draws = [-F.log((_hash52(key, name) + 0.5) / float(1 << _DRAW_BITS)) / weight for name, weight, _ in children]
    least = F.least(*draws)
    pick = children[-1][2]
    for draw, (_, _, value) in reversed(list(zip(draws[:-1], children[:-1], strict=True))):
        pick = F.when(draw == least, value).otherwise(pick)
    return pick


def shard_of(doc_id: Column, tree: Tree) -> Column:
    """The shard (int) that a document id belongs to."""
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    regions = []
    for region, racks in tree.items():
        own = []
        for rack, shards in racks.items():
            leaves = [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in shards.items() if w > 0]
            if leaves:
                own.append((f"{region}/{rack}", sum(w for _, w, _ in leaves), _winner(key, leaves)))
        if own:
            regions.append((region, sum(w for _, w, _ in own), _winner(key, own)))
    return _winner(key, regions)


def assign_shards(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard.

    Slots are dealt without bringing a shard into one task: rows are numbered inside one of 4096 chunks of their shard,
    by a hash of id and text, and the rows of earlier chunks, counted first (4096 rows a shard at most), are added.
    Equal rows are counted before they are shuffled and take slots in a row.
    """
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), tree).cast("int").alias("shard"),
        (shard_of(F.col("doc_id"), grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text_crc32").cast("string"))
    placed = placed.groupBy(*placed.columns).agg(F.count("*").alias("rows")).withColumn("chunk", F.substring(F.md5(named.cast("binary")), 1, _CHUNK_DIGITS))
    counts = placed.groupBy("shard", "chunk").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("at", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    slots = numbered.join(F.broadcast(starts), ["shard", "chunk"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("first_slot") + F.col("at") + F.col("copy")).cast("long").alias("slot"), "grown_shard",
    )


def moved_share(before: Column, after: Column) -> Column:
    """Share of rows whose shard differs, as an aggregate."""
    return F.avg((before != after).cast("double"))


def oracle(tree: Tree, grown: Tree) -> str:
    """The shards and slots in DuckDB SQL; crc32 comes from a table of 256 steps folded over the text's bytes."""

    def h(name: str) -> str:
        return f"CAST('0x' || substr(md5(k || ':{name}'), 1, 13) AS BIGINT)"

    def winner(children: list[tuple[str, float, str]]) -> str:
        if len(children) == 1:
            return children[0][2]
        draws = [f"(-ln(({h(n)} + 0.5) / 4503599627370496.0) / {w!r})" for n, w, _ in children]
        cases = " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {v}" for d, (_, _, v) in zip(draws[:-1], children[:-1], strict=True))
        return f"(CASE {cases} ELSE {children[-1][2]} END)"

    def tree_sql(t: Tree) -> str:
        regions = []
        for region, racks in t.items():
            own = [(f"{region}/{rack}", sum(s.values()), winner([(f"{region}/{rack}/{i}", w, str(i)) for i, w in s.items()])) for rack, s in racks.items()]
            regions.append((region, sum(w for _, w, _ in own), winner(own)))
        return winner(regions)

    return f"""
WITH bytes AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, encode(coalesce(text, '')) AS b FROM documents
), step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS UBIGINT), [CAST(x AS UBIGINT) FOR x IN range(8)]),
      lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS UBIGINT)) ELSE a >> 1 END) AS c FROM range(256) r(i))
), placed AS (
  SELECT doc_id, octet_length(b) + 1 AS size,
    CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), [CAST('0x' || x AS UBIGINT) FOR x IN regexp_extract_all(hex(b), '..')]),
      lambda a, x: xor(a >> 8, t[CAST(xor(a & 255, x) AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32,
    CAST({tree_sql(tree)} AS INTEGER) AS shard, CAST({tree_sql(grown)} AS INTEGER) AS grown_shard, k
  FROM bytes, step
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || ':' || text_crc32), 1, {_CHUNK_DIGITS}), doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard FROM placed"""


def op4_hash_tree_sharding(spark, sf_dir: str) -> DataFrame:
    tree = balanced_tree(8)
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), tree, grow(tree))
