"""Exact n-gram Jaccard self-join with set-relation skipping.

A document's set is its distinct k-word shingles (64-bit hashes). Two documents link when their sets' Jaccard
similarity reaches 4 in 5. The join never makes all pairs of a list:

1. *Equal sets* answer alike: only the smallest id of each class of equal sets goes on.
2. *Prefix lists.* Shingles have one global order, common ones last (by counts in slots of a fixed number over all
   documents) and by hash among those; two linked sets share a shingle among the first n - ceil(4n/5) + 1 of each.
   So each set is posted under those shingles only, with its size and the shingle's position.
3. *Pivots.* Each list's smallest id is its pivot; every member whose size and position allow a link is paired
   with it, and the pairs are checked exactly. Copies of one text so cost one check each, not one for each pair.
   Lists that still hold several components take a second pivot, the member whose lists hold most members.
4. *Derived answers.* What is left are pairs of one list in different components. A member's answers follow
   from the pivot's: distances d to the pivot bound the distance of two members to at least |d1 - d2|, so most
   are skipped unseen; lists are read in blocks ordered by size, and a block is skipped when its sizes,
   positions or components rule it out. Each member brings a sketch of 512 bits: the exclusive or of two sketches bounds
   the sets' difference from below, which rules out most other pairs. The rest is checked exactly. A long list is dealt in
   sides that meet two by two in different tasks.

A check first compares larger sketches of both sets, which prove most pairs apart, and then the sets themselves.

Links are the edges of connected components; no link between different texts is lost.

Edge cases: null, empty and wordless texts have an empty set, link with nothing and stay their own component;
fewer than k words make one shingle of the whole sequence; a null doc_id is never linked; repeated rows each
return with the same component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import bloom_has, connected_components, doc_slices, durable, fixed_bloom, fixed_width, list_array, mix, release, shingle_hashes, string_buffer, word_hashes, word_spans

WORDS = 5
#: slots that count shingles, and bits of the fixed sketch of a set
SLOT_BITS, FIXED_BITS = 22, 512
#: links need 9 * shared >= 4 * (sum of both sizes), which is 100 * shared >= 80 * union
_SHARE, _OF = 4, 9


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least number of shared shingles that links sets of these sizes."""
    return -(-_SHARE * (n + m) // _OF)


def shingle_sets(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, offsets = string_buffer(texts)
    starts, ends, first = word_spans(raw, offsets)
    words = word_hashes(raw, starts, ends)
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(first[:-1], first[1:], strict=True)]


def shingle_levels(docs: DataFrame, k: int = WORDS, bits: int = SLOT_BITS) -> np.ndarray:
    """For each of 2**bits hash slots how common its shingles are, as a power of two; 0 for most.

    Each task counts its documents and names the slots that hold clearly more than its usual one, so little is
    shuffled; the counts of all tasks add up. The array has the same size for any corpus. It only orders shingles:
    any order gives the same links, this one gives short lists.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for i, j in doc_slices(batch.column(0)):
                flat = np.concatenate(shingle_sets(batch.column(0).slice(i, j - i), k))
                np.add.at(total, (flat >> np.uint64(64 - bits)).astype(np.int64), 1)
        usual = total.sum() / len(total)
        slots = np.flatnonzero(total > usual + 4 * usual**0.5 + 1)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots].astype(np.int64))], ["slot", "n"])

    rows = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    levels[np.asarray(rows["slot"], np.int64)] = np.clip(np.log2(np.maximum(np.asarray(rows["n"], np.float64), 2.0)), 1, 60).astype(np.uint8)
    return levels


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def describe(docs: DataFrame, levels: np.ndarray, k: int = WORDS) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128 bits that name the set), its prefix in the global order, and its sketches: fixed and full."""
    shift = np.uint64(64 - (len(levels).bit_length() - 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in doc_slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(i, j - i), k)
                n = np.array([len(s) for s in sets], np.int64)
                s1 = np.array([np.sum(mix(s)) if len(s) else 0 for s in sets], np.uint64)
                s2 = np.array([np.sum(mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF))) if len(s) else 0 for s in sets], np.uint64)
                prefix = []
                for s in sets:
                    level = levels[(s >> shift).astype(np.int64)]
                    keep = len(s) - -(-_SHARE * len(s) // 5) + 1 if len(s) else 0
                    prefix.append(_signed(s[np.lexsort((s, level))[:keep]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.array(_signed(s1)), pa.array(_signed(s2)), list_array(prefix, "i8"), pa.array([sketch(s, FIXED_BITS) for s in sets], pa.binary()), pa.array([sketch(s, full_bits(len(s))) for s in sets], pa.binary())], ["doc_id", "n", "s1", "s2", "prefix", "fixed", "full"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix array<long>, fixed binary, full binary")


def full_bits(n: int) -> int:
    """As many bits as elements, up to a power of two."""
    return max(64, 1 << max(0, n - 1).bit_length())


def sketch(s: np.ndarray, bits: int) -> bytes:
    """For each of so many slots whether it holds an odd number of the set's elements.

    The sketches' exclusive or is the sketch of the symmetric difference, which has at least as many elements as odd slots.
    """
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, total: int) -> bool:
    """Whether sets with these sketches may link: they do up to a symmetric difference of a ninth of their sizes' sum. The larger is folded to the smaller."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0)
    return (_OF - 2 * _SHARE) * total >= _OF * int(np.bitwise_count(x ^ y).sum())


def _star(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one range of the postings (key, id, n, pos) sorted by key and id: those that are not their list's first, with
    that one, their pivot (p_id, p_n, p_pos).

    A list may have begun in an earlier range or go on in a later one, so all of the range's first list and the first
    posting of its last list come with edge = true, as pivots of themselves.
    """
    names = ["key", "id", "n", "pos", "p_id", "p_n", "p_pos", "edge"]
    start = last = None  # key of the first list; key, id, n, pos of the newest list's first posting
    for batch in batches:
        key, who, n, pos = (np.asarray(c, np.int64) for c in batch.columns)
        if not len(key):
            continue
        start = key[0] if start is None else start
        new = np.concatenate(([last is None or key[0] != last[0]], key[1:] != key[:-1]))
        heads, run = np.flatnonzero(new), np.cumsum(new) - 1
        pivot = [c[heads][run] if new[0] else np.append(o, c[heads])[run + 1] for o, c in zip(last[1:] if last else (0, 0, 0), (who, n, pos), strict=True)]
        last = (key[-1], *(c[-1] for c in pivot))
        edge = key == start
        ok = (who != pivot[0]) | edge
        yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (key, who, n, pos, *pivot, edge)], names)
    if last is not None and last[0] != start:
        yield pa.RecordBatch.from_arrays([*(pa.array([int(x)]) for x in (*last, *last[1:])), pa.array([True])], names)


def pivoted(posted: DataFrame) -> DataFrame:
    """key, id, n, pos, p_id, p_n, p_pos of the postings (key, id, n, pos) whose list has a smaller id, its pivot.

    The postings are sorted by list over the whole corpus, in ranges, so a list that a third of all sets are in is spread over many tasks.
    """
    ranges = posted.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    found = durable(ranges.mapInArrow(_star, "key long, id long, n long, pos long, p_id long, p_n long, p_pos long, edge boolean"), "star")
    edges = found.filter("edge").select("key", "id", "n", "pos")
    first = edges.groupBy("key").agg(F.min(F.struct("id", "n", "pos")).alias("f")).select("key", F.col("f.id").alias("p_id"), F.col("f.n").alias("p_n"), F.col("f.pos").alias("p_pos"))
    over = edges.join(F.broadcast(first), "key").filter("id <> p_id")  # first: two rows a range at most
    out = durable(found.filter("NOT edge").drop("edge").unionByName(over), "pivots")
    release(found)
    return out


def _blocks(batches: Iterable[pa.RecordBatch], block: int = 256) -> Iterator[pa.RecordBatch]:
    """Over postings (key, p, q, id, n, pos, component, dist, side, fixed) sorted by list (key, p, q) and size: pairs of different
    components that may link; where p <> q, of different sides.

    Only the part of a list whose sizes still matter is held.
    """
    held: list[np.ndarray] = []
    held_key = None
    for batch in batches:
        lists = np.stack([np.asarray(c, np.int64) for c in batch.columns[:3]], 1)
        cols = [*(np.asarray(c) for c in batch.columns[3:9]), fixed_width(pa.chunked_array([batch.column(9)]), np.uint64, FIXED_BITS // 64)]
        bounds = np.concatenate(([0], np.flatnonzero((lists[1:] != lists[:-1]).any(1)) + 1, [len(lists)])) if len(lists) else [0]
        found = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if held_key is None or (held_key != lists[lo]).any():
                held, held_key = [c[:0] for c in cols], lists[lo]
            one_side = held_key[1] == held_key[2]
            for i in range(lo, hi, block):
                x = [c[i : min(i + block, hi)] for c in cols]
                keep = held[1] * 5 >= x[1][0] * 4  # lists ascend by size: smaller sets are done
                held = [np.concatenate((c[keep], d)) for c, d in zip(held, x, strict=True)]
                if (held[3] == held[3][0]).all() or not one_side and (held[5] == held[5][0]).all():
                    continue
                for j in range(0, len(held[0]), 4 * block):
                    y = [c[j : j + 4 * block] for c in held]
                    n, m = x[1][:, None], y[1][None, :]
                    ok = (x[3][:, None] != y[3][None, :]) & ((m < n) | ((m == n) & (y[0][None, :] < x[0][:, None])))
                    if not one_side:
                        ok &= x[5][:, None] != y[5][None, :]
                    ok &= np.minimum(n - x[2][:, None], m - y[2][None, :]) >= needed(n, m)
                    ok &= ~(np.abs(x[4][:, None] - y[4][None, :]) > 0.2 + 1e-9)
                    r, c = np.nonzero(ok)
                    for a in range(0, len(r), 1 << 15):
                        u, v = r[a : a + (1 << 15)], c[a : a + (1 << 15)]
                        far = np.bitwise_count(x[6][u] ^ y[6][v]).sum(1, dtype=np.int64)
                        near = (_OF - 2 * _SHARE) * (x[1][u] + y[1][v]) >= _OF * far
                        if near.any():
                            one, two = x[0][u[near]], y[0][v[near]]
                            found.append(np.stack([np.minimum(one, two), np.maximum(one, two)], 1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _dealt(rows: DataFrame, part: int = 4096) -> DataFrame:
    """The postings of lists (key, ...) as lists (key, p, q): one of more than ``part`` postings falls into sides by hash of id, and each two sides meet in a list of their own."""
    long = durable(rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > part).select("key", F.ceil(F.col("size") / part).cast("long").alias("sides")), "long")
    if long.isEmpty():
        return rows.withColumns({c: F.lit(0).cast("long") for c in ("p", "q", "side")})
    sided = rows.join(long, "key", "left").withColumn("sides", F.coalesce("sides", F.lit(1).cast("long"))).withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")))
    dealt = sided.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    return dealt.withColumn("p", F.least("side", "other")).withColumn("q", F.greatest("side", "other")).drop("sides", "other")


def _of_documents(docs: DataFrame, ids: DataFrame, make, schema: str, k: int) -> DataFrame:
    """id and what make() gives for the sets of the documents that ids (id) may name: a Bloom filter of fixed size, so a few more."""
    bloom = fixed_bloom(ids, "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(bloom_has(bloom, np.asarray(batch.column(0), np.int64))))
            for i, j in doc_slices(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(i, j - i), k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int32()), make(sets)], ["id", "n", "x"])

    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"id long, n int, x {schema}")


def few_or_joined(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A column or two of longs for a join: broadcast if it has at most ``most`` rows (16 MB a column), else left to a shuffle."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def check(docs: DataFrame, pairs: DataFrame, sketches: DataFrame, k: int = WORDS) -> DataFrame:
    """a, b, na, nb, shared of the pairs that the sketches (id, n, x) of both leave possible; exact, from sets made anew from the texts.

    The rest can't link. A sketch has a bit or two for each element, so only near pairs move whole sets.
    """

    def joined(rows: DataFrame, own: DataFrame) -> DataFrame:
        rows = few_or_joined(rows, 500_000)  # narrow rows: where they are few, what they name needs no shuffle for the first side
        for side in ("b", "a"):
            rows = own.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("x").alias(f"x{side}")).join(rows, side)
        return rows

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                total = np.asarray(part.column(2), np.int64) + np.asarray(part.column(3), np.int64)
                keep = [may_link(x, y, t) for x, y, t in zip(part.column(4).to_pylist(), part.column(5).to_pylist(), total.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in part.columns[:2]], ["a", "b"])

    near = durable(joined(pairs, sketches).select("a", "b", "na", "nb", "xa", "xb").mapInArrow(prune, "a long, b long").distinct(), "near")
    ids = near.select(F.explode(F.array("a", "b")).alias("id"))
    sets = durable(_of_documents(docs, ids, lambda sets: list_array([_signed(s) for s in sets], "i8"), "array<long>", k), "sets")
    tested = durable(joined(near, sets).select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).alias("shared")), "tested")
    release(near, sets)
    return tested


def _once(rows: DataFrame, twice: DataFrame | None) -> DataFrame:
    """Of the rows that repeat an id (those in twice) one."""
    if twice is None:
        return rows
    again = rows.join(few_or_joined(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rows.join(few_or_joined(twice), "doc_id", "left_anti").unionByName(again)


def near_duplicates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) of each row."""
    described = durable(describe(docs, shingle_levels(docs, k), k), "described")
    small = described.select("doc_id", "n", "s1", "s2")
    classes = durable(small.filter("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).filter("size > 1").drop("size"), "classes")
    member = durable(small.join(classes, ["s1", "s2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("first")), "members")

    copies = few_or_joined(member.filter("doc_id <> first").select("doc_id").distinct())
    repeated = durable(small.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "twice")
    twice = None if repeated.isEmpty() else repeated
    own = _once(described.filter("n > 0 AND doc_id IS NOT NULL").join(copies, "doc_id", "left_anti"), twice).withColumnRenamed("doc_id", "id")
    docs = _once(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), twice)
    first = pivoted(own.select("id", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "id", "n", F.col("pos").cast("long").alias("pos")))

    linked = F.expr(f"{_OF} * shared >= {_SHARE} * (na + nb)")
    may = F.expr(f"{_OF} * least(n - pos, p_n - p_pos) >= {_SHARE} * (n + p_n)")
    pairs = durable(first.filter(may).select(F.col("p_id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    sketches = own.select("id", "n", F.col("full").alias("x"))
    tested = check(docs, pairs, sketches, k)
    near = connected_components(tested.filter(linked).select("a", "b"))

    dist = tested.select(F.col("a").alias("pivot"), F.col("b").alias("id"), (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("dist"))
    pivot = first.groupBy("key").agg(F.first("p_id").alias("id"), F.first("p_n").alias("n"), F.first("p_pos").alias("pos"), F.count("*").alias("size"))
    pivot = pivot.filter("size > 1").select("key", F.col("id").alias("pivot"), "id", "n", "pos")  # lists of three and more
    rest = first.select("key", F.col("p_id").alias("pivot"), "id", "n", "pos").unionByName(pivot)
    lists = _with_components(rest, near)
    rest = durable(_still_open(lists).join(dist, ["pivot", "id"], "left"), "rest")
    release(first, lists)
    # a member that was not tested against the pivot has no distance to it (NaN), and nothing is skipped by it
    rest = rest.withColumn("dist", F.when(F.col("pivot") == F.col("id"), 0.0).otherwise(F.coalesce("dist", F.lit(float("nan")))))

    def answer(found: DataFrame) -> DataFrame:
        return member.join(found.select(F.col("id").alias("first"), "component"), "first", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "first").alias("component_id"))

    if rest.isEmpty():
        return answer(near)
    hub_pairs = durable(_hub_pairs(rest).join(pairs, ["a", "b"], "left_anti"), "pairs")
    by_hubs = check(docs, hub_pairs, sketches, k).filter(linked).select("a", "b")
    near = connected_components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).union(by_hubs))

    lists = _with_components(rest.drop("component"), near)
    still = durable(_still_open(lists).join(own.select("id", "fixed"), "id").select("key", "id", "n", "pos", "component", "dist", "fixed"), "open")
    release(lists, rest)
    dealt = _dealt(still)
    ordered = dealt.select("key", "p", "q", "id", "n", "pos", "component", "dist", "side", "fixed").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "n", "id")
    last_pairs = ordered.mapInArrow(_blocks, "a long, b long").distinct().join(pairs.union(hub_pairs), ["a", "b"], "left_anti")
    last_pairs = durable(last_pairs, "pairs")
    release(still)
    if last_pairs.isEmpty():
        return answer(near)
    by_blocks = check(docs, last_pairs, sketches, k).filter(linked).select("a", "b")
    near = connected_components(near.select(F.col("id").alias("a"), F.col("component").alias("b")).union(by_blocks))
    release(described)
    return answer(near)


def _with_components(rows: DataFrame, near: DataFrame) -> DataFrame:
    return durable(rows.join(near, "id", "left").withColumn("component", F.coalesce("component", "id")), "lists")


def _still_open(rows: DataFrame) -> DataFrame:
    """Postings (key, id, component, ...) of the lists that hold more than one component."""
    keys = rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("key")
    return rows.join(keys, "key", "left_semi")


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each open list's hub with its members of other components. The hub is the member whose lists hold most members:
    of a text and its edited copies, which are nearer to it than to each other, that is the text."""
    size = rows.groupBy("key").agg(F.count("*").alias("size"))
    score = rows.select("key", "id").join(size, "key").groupBy("id").agg(F.sum("size").alias("score"))
    scored = rows.join(score, "id")
    hub = scored.groupBy("key").agg(F.max_by(F.struct("id", "n", "pos", "component"), F.struct("score", -F.col("id"))).alias("hub"))
    met = scored.join(hub, "key").filter("component <> hub.component")
    may = F.expr(f"{_OF} * least(n - pos, hub.n - hub.pos) >= {_SHARE} * (n + hub.n)")
    return met.filter(may).select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def op7_set_relation_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id stays, and of rows that repeat its id one."""
    found = durable(near_duplicates(docs.select("doc_id", "text")), "components")
    dropped = few_or_joined(found.filter("doc_id <> component_id").select("doc_id").distinct())
    kept = docs.join(dropped, "doc_id", "left_anti")
    twice = found.filter("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(twice, "doc_id", "left_anti")
    again = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(again).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), one AS (SELECT r, unnest(s) AS x FROM sets),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM one a JOIN one b ON a.x = b.x AND a.r < b.r GROUP BY 1, 2),
links AS (
  SELECT p.doc_id AS a, q.doc_id AS b FROM shared JOIN sets p ON p.r = shared.a JOIN sets q ON q.r = shared.b
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT doc_id AS d, doc_id AS c FROM sets UNION SELECT e.b, reach.c FROM reach JOIN edges e ON e.a = reach.d)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(c) FROM reach WHERE d = doc_id) AS component_id FROM sets"""
