"""Linking facts: enclosing functions, names to symbols in a file and across a codebase, includes to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.functions import basename, forward_slashes
from codefacts.tables import CLASS_KINDS, FUNCTION_KINDS

#: lines of a block; functions that cross blocks are copied to each
LINES = 64


def attach_enclosing_function(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Items (file_id, line_number, ...) with caller_symbol_id and caller_name: the first function-like symbol whose lines hold the item; others are dropped, and equal items stay as many as they are.

    Functions are gathered by blocks of lines, one row a block, so items meet them in an equi-join that can't multiply rows; a
    file with very many functions and items is dealt to tasks by its blocks.
    """
    spans = symbols.filter(F.col("kind").isin(*FUNCTION_KINDS)).select("file_id", F.struct("ord", "line_start", "line_end", "id", "qualified_name").alias("f"))
    block = lambda line: F.floor(line / LINES)
    spread = spans.withColumn("_block", F.explode(F.sequence(block(F.col("f.line_start")), F.greatest(block(F.col("f.line_start")), block(F.col("f.line_end"))))))
    blocks = spread.groupBy("file_id", "_block").agg(F.array_sort(F.collect_list("f")).alias("_functions"))
    first = F.get(F.filter("_functions", lambda f: F.col("line_number").between(f["line_start"], f["line_end"])), F.lit(0))
    hit = items.withColumn("_block", block(F.col("line_number"))).join(blocks, ["file_id", "_block"]).withColumn("_f", first).filter("_f IS NOT NULL")
    return hit.select(*items.columns, F.col("_f.id").alias("caller_symbol_id"), F.col("_f.qualified_name").alias("caller_name"))


def names_in_file(symbols: DataFrame) -> DataFrame:
    """(file_id, key, symbol_id): short and qualified names of a file's symbols; of equal names the last one."""
    keyed = symbols.select("file_id", "id", "ord", F.explode(F.array_distinct(F.array("qualified_name", "name"))).alias("key"))
    return keyed.groupBy("file_id", "key").agg(F.max_by("id", "ord").alias("symbol_id"))


def resolve_names_in_file(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with caller_symbol_id and callee_symbol_id where the same file has the name."""
    known = names_in_file(symbols)
    rest = calls.drop("caller_symbol_id", "callee_symbol_id")
    out = rest.join(known.select("file_id", F.col("key").alias("caller_name"), F.col("symbol_id").alias("caller_symbol_id")), ["file_id", "caller_name"], "left")
    return out.join(known.select("file_id", F.col("key").alias("callee_name"), F.col("symbol_id").alias("callee_symbol_id")), ["file_id", "callee_name"], "left")


def first_by_name(symbols: DataFrame, files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(codebase_id, name, found): the first symbol of each name in a codebase by path and position. One row a name, so a frequent name can't multiply rows."""
    some = symbols.filter(F.col("kind").isin(*kinds)) if kinds else symbols
    at = files.select("file_id", "codebase_id", "relative_path")
    return some.select("file_id", "id", "name", "ord").join(at, "file_id").groupBy("codebase_id", "name").agg(F.min_by("id", F.struct("relative_path", "ord")).alias("found"))


def callees_in_file(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls with callee_symbol_id where the same file has the name; open elsewhere."""
    known = names_in_file(symbols).select("file_id", F.col("key").alias("callee_name"), F.col("symbol_id").alias("callee_symbol_id"))
    return calls.drop("callee_symbol_id").join(known, ["file_id", "callee_name"], "left")


def resolve_names(rows: DataFrame, lookup: DataFrame, name: str, target: str) -> DataFrame:
    """Rows (with codebase_id) whose target is open get what the lookup (codebase_id, name, found) has for their name.

    One left join, so the input is computed once. Rows that are linked have no key in it: they meet nothing, and a random
    second key that lookup rows (0) can't have deals them to all tasks.
    """
    is_open = F.col(target).isNull()
    keyed = rows.withColumn("_key", F.when(is_open, F.col(name))).withColumn("_deal", F.when(is_open, 0).otherwise(1 + F.pmod(F.xxhash64(*[c for c in rows.columns if c != "codebase_id"]), F.lit(1 << 20))))
    right = lookup.select("codebase_id", F.col("name").alias("_key"), F.lit(0).cast("long").alias("_deal"), "found")
    return keyed.join(right, ["codebase_id", "_key", "_deal"], "left").withColumn(target, F.coalesce(target, "found")).select(*rows.columns)


def resolve_calls(calls: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Calls whose callee is unresolved get the first function of that short name in their codebase."""
    rows = calls.join(files.select("file_id", "codebase_id"), "file_id")
    return resolve_names(rows, first_by_name(symbols, files, FUNCTION_KINDS), "callee_name", "callee_symbol_id")


def resolve_inheritance(inheritance: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    at = symbols.select(F.col("id").alias("child_symbol_id"), "file_id").join(files.select("file_id", "codebase_id"), "file_id").drop("file_id")
    return resolve_names(inheritance.join(at, "child_symbol_id"), first_by_name(symbols, files, CLASS_KINDS), "parent_name", "parent_symbol_id")


def resolve_references(references: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    rows = references.join(files.select("file_id", "codebase_id"), "file_id")
    return resolve_names(rows, first_by_name(symbols, files), "symbol_name", "symbol_id")


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Includes with resolved_file_id: exact relative path, else the only file of that basename, else the first (by path) of that basename whose path ends so.

    System includes stay open. For the third step files meet the lengths of the includes that are still open, not the includes: work grows with
    files times lengths of a basename, and the last join is by equality.
    """
    at = files.select("file_id", "codebase_id", forward_slashes(F.col("relative_path")).alias("relative_path"))
    rows = includes.drop("resolved_file_id").join(at.select("file_id", "codebase_id"), "file_id").withColumn("wanted", forward_slashes(F.col("included_path"))).withColumn("base", basename(F.col("included_path")))
    exact = at.groupBy("codebase_id", F.col("relative_path").alias("wanted")).agg(F.min("file_id").alias("exact"))
    named = at.withColumn("base", basename(F.col("relative_path")))
    single = named.groupBy("codebase_id", "base").agg(F.min("file_id").alias("single"), F.count("*").alias("n")).filter("n = 1").drop("n")
    two = rows.join(exact, ["codebase_id", "wanted"], "left").join(single, ["codebase_id", "base"], "left")
    two = two.withColumn("resolved_file_id", F.when(~F.col("is_system").cast("boolean"), F.coalesce("exact", "single"))).drop("exact", "single")
    # the ends of paths that are as long as a wanted one are keys: one row for each end, however many files have the basename
    still = two.filter("resolved_file_id IS NULL AND NOT CAST(is_system AS BOOLEAN)").select("codebase_id", "base", F.length("wanted").alias("n")).distinct()
    ends = named.select("codebase_id", "base", "relative_path", F.col("file_id").alias("candidate")).join(still, ["codebase_id", "base"]).filter(F.length("relative_path") >= F.col("n"))
    suffix = ends.withColumn("wanted", F.expr("right(relative_path, n)")).groupBy("codebase_id", "wanted").agg(F.min_by("candidate", "relative_path").alias("suffix"))
    out = two.join(suffix, ["codebase_id", "wanted"], "left").withColumn("resolved_file_id", F.coalesce("resolved_file_id", F.when(~F.col("is_system").cast("boolean"), F.col("suffix"))))
    return out.select(*[c for c in includes.columns if c != "resolved_file_id"], "codebase_id", "resolved_file_id")


def unresolved_names(rows: DataFrame, name: str, target: str) -> DataFrame:
    """(codebase_id, name) of rows without a target."""
    return rows.filter(F.col(target).isNull()).select("codebase_id", F.col(name).alias("name")).distinct()


def resolution_rate(includes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Local includes that are resolved and not, in all or by keys."""
    local = includes.filter("NOT CAST(is_system AS BOOLEAN)")
    is_open: Column = F.col("resolved_file_id").isNull()
    return local.groupBy(*(keys or [])).agg(F.sum((~is_open).cast("long")).alias("resolved"), F.sum(is_open.cast("long")).alias("unresolved"))
