"""Source texts to facts: symbols, parameters, base classes, includes, macros, specifiers, calls and references.

One Arrow pass per source file runs the scanner for declarations and bodies; macros, their specifiers, includes and cleaned
text are DataFrame functions on the texts, calls and references on the scanner's result. Sources are a table (file_id,
codebase_id, relative_path, content).
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codefacts import changes, lexical, link, macros
from codefacts.corpus import file_rows
from codefacts.functions import is_builtin_callee
from codefacts.scan import scan
from codefacts.tables import file_id, located, settled, symbol_id

#: Specifier keys that are metadata even outside meta=(...).
META_KEYS = frozenset(
    """DisplayName ToolTip ShortTooltip DocumentationPolicy AllowPrivateAccess DeprecatedFunction DeprecationMessage ClampMin ClampMax UIMin UIMax
    EditCondition EditConditionHides InlineEditConditionToggle MakeStructureDefaultValue AllowedClasses DisallowedClasses ExactClass MustImplement
    BlueprintBaseOnly BindWidget BindWidgetOptional BindWidgetAnim BindWidgetAnimOptional Keywords CompactNodeTitle ArrayParm MapParam
    ReturnDisplayName AdvancedDisplay DevelopmentOnly NativeBreakFunc NativeMakeFunc HidePin DefaultToSelf WorldContext CallableWithoutWorldContext
    Latent LatentInfo ExpandEnumAsExecs ExpandBoolAsExecs CommutativeAssociativeBinaryOperator""".split()
)
#: Words before a bracket that are no calls.
KEYWORDS = "if for while switch return catch sizeof alignof decltype new delete throw else do case and or not static_assert noexcept alignas typeid defined operator".split()

#: scopes that may lie in each other
SCOPES = 10_000
#: UTF-8 bytes of texts that a task scans; a longer text is scanned alone
TASK_BYTES = 32 << 20
#: parts in which running sums of sizes are taken
CHUNKS = 1024

_PARAMETER = "struct<name:string,type:string,default_value:string,position:int>"
_BASE = "struct<name:string,access:string,is_virtual:boolean>"
_SYMBOL = (
    "struct<ord:int,parent_ord:int,name:string,qualified_name:string,kind:string,access:string,is_static:boolean,is_virtual:boolean,is_const:boolean,"
    f"is_inline:boolean,return_type:string,line_start:int,line_end:int,column_start:int,signature:string,raw_text:string,parameters:array<{_PARAMETER}>,base_classes:array<{_BASE}>>"
)


def balanced(sources: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The sources (each file_id once) dealt to tasks by the bytes of their texts, as a scan's time grows with them.

    Files are put into bins of task_bytes by a running sum, over hash chunks and then over the chunks; a file of task_bytes or more has
    a bin of its own. So no task has more than twice task_bytes but for a single longer file. Ids and sizes alone meet in windows;
    the driver learns the two numbers of bins.
    """
    size = F.coalesce(F.octet_length("content"), F.lit(0)) + 1
    sizes = sources.select("file_id", size.cast("long").alias("size"), F.pmod(F.xxhash64("file_id"), F.lit(CHUNKS)).alias("chunk"))
    long_one = F.col("size") >= task_bytes
    sizes = settled(sizes.withColumns({"short": F.when(long_one, 0).otherwise(F.col("size")), "long": long_one.cast("long")}), "sizes")
    chunks = sizes.groupBy("chunk").agg(F.sum("short").alias("short_all"), F.sum("long").alias("long_all"))
    whole = chunks.agg(F.sum("short_all").alias("short"), F.sum("long_all").alias("long")).first()
    n_short, n_long = (whole["short"] or 0) // task_bytes + 1, whole["long"] or 0
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # CHUNKS rows at most
    starts = chunks.select("chunk", *[F.coalesce(F.sum(f"{c}_all").over(before), F.lit(0)).alias(f"{c}_before") for c in ("short", "long")])
    inside = Window.partitionBy("chunk").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)
    at = {c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{c}_before") for c in ("short", "long")}
    in_short = F.floor(at["short"] / task_bytes)
    bins = sizes.join(F.broadcast(starts), "chunk").select("file_id", F.when(F.col("long") == 1, n_short + at["long"]).otherwise(in_short).cast("int").alias("_bin"))
    return sources.join(bins, "file_id").repartitionById(int(n_short + n_long), F.col("_bin")).drop("_bin")


def scan_sources(sources: DataFrame) -> DataFrame:
    """file_id, codebase_id, symbols, code, body_code, content, failed of each source.

    A source that can't be scanned (more than SCOPES in each other) gives no symbols, calls and references, and the error's name in failed.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * SCOPES))
        for pdf in batches:
            rows = []
            for text in pdf["content"]:
                failed = None
                try:
                    found = scan(text or "")
                except (ValueError, RecursionError, IndexError) as error:
                    found, failed = {"symbols": [], "code": "", "body_code": ""}, type(error).__name__
                rows.append((found["symbols"], found["code"], found["body_code"], text, failed))
            out = pd.DataFrame(rows, columns=["symbols", "code", "body_code", "content", "failed"])
            out.insert(0, "codebase_id", pdf["codebase_id"].to_numpy())
            out.insert(0, "file_id", pdf["file_id"].to_numpy())
            yield out

    schema = f"file_id long, codebase_id long, symbols array<{_SYMBOL}>, code string, body_code string, content string, failed string"
    return sources.select(F.col("file_id").cast("long"), F.col("codebase_id").cast("long"), "content").mapInPandas(run, schema)


def scan_failures(scanned: DataFrame) -> DataFrame:
    """codebase_id, failed, n_files of sources that gave no facts, by the error's name."""
    return scanned.filter("failed IS NOT NULL").groupBy("codebase_id", "failed").agg(F.count("*").alias("n_files"))


def clean_source(sources: DataFrame) -> DataFrame:
    """The sources with clean_text: no export tokens or UMETA(...), macro and delegate lines empty, line numbers kept."""
    return sources.withColumn("clean_text", lexical.clean(F.col("content")))


def extract_symbols(scanned: DataFrame) -> DataFrame:
    """One row a symbol with id and parent_symbol_id; parameters and base_classes stay as arrays."""
    rows = scanned.select("file_id", "codebase_id", F.explode("symbols").alias("s")).select("file_id", "codebase_id", "s.*")
    parent = F.when(F.col("parent_ord").isNotNull(), symbol_id(F.col("file_id"), F.col("parent_ord")))
    return rows.withColumn("id", symbol_id(F.col("file_id"), F.col("ord"))).withColumn("parent_symbol_id", parent)


def explode_parameters(symbols: DataFrame) -> DataFrame:
    return symbols.select(F.col("id").alias("symbol_id"), F.explode("parameters").alias("p")).select("symbol_id", "p.*")


def explode_base_classes(symbols: DataFrame) -> DataFrame:
    rows = symbols.select(F.col("id").alias("child_symbol_id"), F.col("name").alias("child_name"), F.explode("base_classes").alias("b"))
    return rows.select("child_symbol_id", "child_name", F.col("b.name").alias("parent_name"), F.lit(None).cast("long").alias("parent_symbol_id"), F.col("b.access").alias("access"), F.col("b.is_virtual").alias("is_virtual"))


def extract_includes(sources: DataFrame) -> DataFrame:
    """file_id, line_number, included_path, is_system, resolved_file_id (open)."""
    lines = sources.select("file_id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    pattern = r'^\s*#\s*include\s*([<"])([^>"]+)[>"]'
    rows = lines.filter(F.col("line").rlike(pattern))
    return rows.select("file_id", (F.col("at") + 1).alias("line_number"), F.regexp_extract("line", pattern, 2).alias("included_path"), (F.regexp_extract("line", pattern, 1) == "<").alias("is_system"), F.lit(None).cast("long").alias("resolved_file_id"))


def extract_macros(sources: DataFrame) -> DataFrame:
    """id, file_id, macro_type, line_number, raw_text, specifiers (array); one a line."""
    rows = sources.select(F.col("file_id").cast("long").alias("file_id"), F.explode(lexical.macros(F.col("content"))).alias("m"))
    rows = rows.select("file_id", "m.macro_type", "m.line_number", "m.raw_text", lexical.specifiers(F.col("m.content"), META_KEYS).alias("specifiers"))
    return rows.withColumn("id", F.xxhash64("file_id", "line_number")).withColumn("symbol_id", F.lit(None).cast("long"))


def explode_specifiers(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("macro_id"), F.explode("specifiers").alias("s")).select("macro_id", "s.*")


def extract_calls(scanned: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call sites inside functions: id, file_id, line_number, callee_name, caller_symbol_id, caller_name.

    The callee is the written name (with its scopes), the last member of a member call, the name of a template call.
    A name after a type name is a declaration and no call.
    """
    name = r"[A-Za-z_]\w*(?:\s*::\s*~?[A-Za-z_]\w*)*"
    pattern = rf"(?:(?<=\breturn\s)|(?<=\belse\s)|(?<=\bnew\s)|(?<![\w>*&~]\s)(?<![\w~]))({name})\s*(?:<[^<>;(){{}}]*>\s*)?\("
    lines = scanned.select("file_id", F.posexplode(F.split("body_code", "\n")).alias("at", "line")).filter(F.col("line").contains("("))
    sites = lines.select("file_id", (F.col("at") + 1).alias("line_number"), F.posexplode(F.regexp_extract_all("line", F.lit(pattern), F.lit(1))).alias("n", "callee_name"))
    sites = sites.withColumn("callee_name", F.regexp_replace("callee_name", r"\s", ""))
    sites = sites.filter(~is_builtin_callee(F.col("callee_name")) & ~F.col("callee_name").isin(KEYWORDS))
    inside = link.attach_enclosing_function(sites, symbols)
    return inside.withColumn("id", F.xxhash64("file_id", "line_number", "n")).drop("n").withColumn("callee_symbol_id", F.lit(None).cast("long"))


def extract_references(scanned: DataFrame, symbols: DataFrame, names: str = "top") -> DataFrame:
    """Identifier occurrences of a file's own names: symbol_name, line_number, column_number (from 0), context (trimmed line, 200 characters).

    names: "top" for names of top-level symbols, "all" for nested ones as well. The semi-join runs before anything else grows.
    """
    known = (symbols if names == "all" else symbols.filter("parent_ord IS NULL")).select("file_id", F.col("name").alias("symbol_name")).distinct()
    both = F.arrays_zip(F.split("code", "\n").alias("line"), F.split("content", "\n").alias("text"))
    lines = scanned.select("file_id", F.posexplode(both).alias("at", "both")).filter("both.line IS NOT NULL").select("file_id", "at", "both.line", "both.text")
    tokens = lines.select("file_id", "at", F.posexplode(F.split("line", r"\b")).alias("n", "symbol_name")).filter(F.col("symbol_name").rlike(r"^[A-Za-z_]\w*$"))
    hits = tokens.join(known, ["file_id", "symbol_name"], "left_semi")
    column = F.length(F.array_join(F.slice(F.split("line", r"\b"), F.lit(1), F.col("n")), ""))
    return hits.join(lines, ["file_id", "at"]).select("file_id", F.lit(None).cast("long").alias("symbol_id"), "symbol_name", (F.col("at") + 1).alias("line_number"), column.alias("column_number"), F.substring(F.trim("text"), 1, 200).alias("context"))


def index_corpus(sources: DataFrame, linked: bool = True) -> dict[str, DataFrame]:
    """All fact tables of a corpus, linked across its files or, without linked, only inside each."""
    scanned = settled(scan_sources(balanced(sources)), "scan")
    files = file_rows(sources)
    symbols = extract_symbols(scanned)
    texts = scanned.select("file_id", "content")
    found = extract_macros(texts)
    tables = {
        "files": files,
        "symbols": symbols.drop("parameters", "base_classes"),
        "parameters": explode_parameters(symbols),
        "inheritance": explode_base_classes(symbols),
        "ue_macros": macros.attach_macro_symbol(found.drop("specifiers"), symbols),
        "ue_macro_specifiers": explode_specifiers(found),
        "calls": link.callees_in_file(extract_calls(scanned, symbols), symbols),
        "includes": extract_includes(texts),
        "references_table": extract_references(scanned, symbols),
    }
    return changes.relink(tables) if linked else tables


def reindex_files(tables: dict[str, DataFrame], codebases: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The linked tables with the facts of these files (path, content) taken anew.

    A file belongs to the codebase whose root holds its path; known files are replaced, others added, paths of no codebase left out.
    """
    owned = sources.join(changes.codebase_of(codebases, sources.select("path")), "path")
    rows = owned.select("codebase_id", "relative_path", "content").withColumn("file_id", file_id(F.col("codebase_id"), F.col("relative_path")))
    known = located(tables["files"]).select("codebase_id", "relative_path", F.col("file_id").alias("_known"))
    rows = rows.join(known, ["codebase_id", "relative_path"], "left").withColumn("file_id", F.coalesce("_known", "file_id")).drop("_known")
    touched = rows.select("codebase_id", "relative_path", F.lit("changed").alias("status"))
    return changes.apply_changes(tables, touched, index_corpus(rows, linked=False))
