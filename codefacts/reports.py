"""Reports over fact tables: index status, script exposure, class reports and simple lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions import EXPOSING_KEYS, format_specifier, name_prefix, name_prefix_description
from codefacts.macros import concat_specifiers
from codefacts.tables import located, names_table


def index_status(codebases: DataFrame, files: DataFrame, symbols: DataFrame, macros: DataFrame, codebase_id: int | None = None) -> DataFrame:
    """A row for each codebase (with all its columns, so the time of its last run as well) and its files, symbols and macros, each counted by itself so that joins don't multiply.

    codebases may call their id codebase_id, as a table of an index does, or id.
    """
    bases = codebases if "codebase_id" in codebases.columns else codebases.withColumnRenamed("id", "codebase_id")
    some = bases.filter(F.col("codebase_id") == codebase_id) if codebase_id is not None else bases
    at = located(files).select("file_id", "codebase_id")
    per_file = symbols.groupBy("file_id").agg(F.count("*").alias("s"))
    per_file_m = macros.groupBy("file_id").agg(F.count("*").alias("m"))
    counts = at.join(per_file, "file_id", "left").join(per_file_m, "file_id", "left").groupBy("codebase_id").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_symbols"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_macros"))
    out = some.join(counts, "codebase_id", "left")
    return out.fillna(0, ["n_files", "n_symbols", "n_macros"])


def blueprint_exposed(macros: DataFrame, specifiers: DataFrame, symbols: DataFrame, files: DataFrame, codebase_id: int, macro_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """Macros of a codebase that have any exposing key, with those keys; by path and line."""
    at = files.filter(F.col("codebase_id") == codebase_id).select("file_id", F.col("relative_path").alias("path"))
    some = (macros.filter(F.col("macro_type") == macro_type) if macro_type else macros).join(at, "file_id")
    keys = specifiers.filter(F.col("key").isin(EXPOSING_KEYS)).join(some.select(F.col("id").alias("macro_id")), "macro_id", "left_semi")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda p: p["key"])
    grouped = keys.groupBy(F.col("macro_id").alias("id")).agg(listed.alias("keys"))
    name = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"))
    out = some.join(grouped, "id").join(name, "symbol_id", "left").select("path", "line_number", "macro_type", "symbol_name", "symbol_kind", "keys")
    return out.orderBy("path", "line_number").limit(limit) if limit is not None else out


def first_classes(symbols: DataFrame, files: DataFrame, names, every: bool = False) -> DataFrame:
    """q, class_id, path, line_start of the first class or struct of each name (by path and line), or of every one."""
    rows = symbols.filter(F.col("kind").isin("class", "struct")).join(names_table(symbols.sparkSession, names), F.col("name") == F.col("q")).join(files.select("file_id", F.col("relative_path").alias("path")), "file_id")
    if every:
        return rows.select("q", F.col("id").alias("class_id"), "file_id", "path", "line_start", "kind")
    first = rows.groupBy("q").agg(F.min_by(F.struct("id", "file_id", "path", "line_start", "kind"), F.struct("path", "line_start")).alias("c"))
    return first.select("q", F.col("c.id").alias("class_id"), "c.file_id", "c.path", "c.line_start", "c.kind")


def blueprint_interface(symbols: DataFrame, macros: DataFrame, specifiers: DataFrame, files: DataFrame, names) -> DataFrame:
    """q, is_blueprintable, is_blueprint_type, section (function, event, property, delegate), symbol_name, line_start, specifiers of each named class."""
    classes = first_classes(symbols, files, names)
    texts = specifiers.groupBy(F.col("macro_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", format_specifier(F.col("key"), F.col("value")).alias("t")))), lambda p: p["t"]).alias("texts"), F.collect_set("key").alias("keys"))
    own = macros.filter(F.col("macro_type").isin("UCLASS", "USTRUCT")).join(texts, "id").join(classes.select("q", F.col("class_id").alias("symbol_id")), "symbol_id")
    flags = own.groupBy("q").agg(F.max(F.array_contains("keys", "Blueprintable") | F.array_contains("keys", "BlueprintType")).alias("is_blueprintable"), F.max(F.array_contains("keys", "BlueprintType")).alias("is_blueprint_type"))
    members = symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), F.col("line_start"), F.col("parent_symbol_id").alias("class_id")).join(classes.select("q", "class_id"), "class_id")
    rows = members.join(macros.select("id", "symbol_id", "macro_type"), "symbol_id").join(texts, "id")
    rows = rows.filter(F.exists("texts", lambda t: t.startswith("Blueprint")))
    event = F.exists("texts", lambda t: t.contains("ImplementableEvent") | t.contains("NativeEvent"))
    section = F.when((F.col("macro_type") == "UFUNCTION") & event, "event").when(F.col("macro_type") == "UFUNCTION", "function").when(F.col("macro_type") == "UPROPERTY", "property").when(F.col("macro_type").startswith("DECLARE_"), "delegate")
    out = rows.withColumn("section", section).filter("section IS NOT NULL").join(flags, "q", "left")
    return out.select("q", F.coalesce("is_blueprintable", F.lit(False)).alias("is_blueprintable"), F.coalesce("is_blueprint_type", F.lit(False)).alias("is_blueprint_type"), "section", "symbol_name", "line_start", F.array_join("texts", ", ").alias("specifiers"))


def analyze_class(symbols: DataFrame, inheritance: DataFrame, macros: DataFrame, specifiers: DataFrame, files: DataFrame, names, every: bool = False) -> DataFrame:
    """Long rows (q, section, ord, name, detail, modifiers, signature): header, naming, base classes, macros, methods and fields of each
    named class. detail of a member is its macros; modifiers are its access, virtual and static; a field's signature is its type and name."""
    classes = first_classes(symbols, files, names, every)
    head = classes.select("q", F.lit("class").alias("section"), F.col("line_start").cast("int").alias("ord"), F.col("kind").alias("name"), F.col("path").alias("detail"))
    naming = classes.select("q", F.lit("naming").alias("section"), F.lit(0).alias("ord"), name_prefix(F.col("q")).alias("name"), name_prefix_description(name_prefix(F.col("q"))).alias("detail"))
    base = inheritance.join(classes.select("q", F.col("class_id").alias("child_symbol_id")), "child_symbol_id").select("q", F.lit("base").alias("section"), F.lit(0).alias("ord"), F.col("parent_name").alias("name"), F.col("access").alias("detail"))
    text = concat_specifiers(specifiers).withColumnRenamed("macro_id", "id")
    own = macros.join(classes.select("q", F.col("class_id").alias("symbol_id")), "symbol_id").join(text, "id", "left").select("q", F.lit("macro").alias("section"), F.col("line_number").cast("int").alias("ord"), F.col("macro_type").alias("name"), F.col("specifiers").alias("detail"))
    mods = F.concat_ws(" ", "access", F.when(F.col("is_virtual"), "virtual"), F.when(F.col("is_static"), "static"))
    signature = F.coalesce("signature", F.concat_ws(" ", "return_type", "name"))
    members = symbols.select(F.col("id").alias("symbol_id"), "name", "kind", "line_start", F.col("parent_symbol_id").alias("class_id"), mods.alias("modifiers"), signature.alias("signature")).join(classes.select("q", "class_id"), "class_id")
    marks = macros.join(text, "id", "left").groupBy("symbol_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", F.concat("macro_type", F.lit("("), F.coalesce("specifiers", F.lit("")), F.lit(")")).alias("t")))), lambda p: p["t"]), " ").alias("detail"))
    rows = members.join(marks, "symbol_id", "left").select("q", F.when(F.col("kind").isin("method", "constructor", "destructor", "function"), "method").otherwise("field").alias("section"), F.col("line_start").cast("int").alias("ord"), "name", "detail", "modifiers", "signature")
    return head.unionByName(naming).unionByName(base).unionByName(own).unionByName(rows, allowMissingColumns=True)


def symbols_by_file(symbols: DataFrame, file_ids: DataFrame) -> DataFrame:
    return symbols.join(file_ids.select(F.col(file_ids.columns[0]).alias("file_id")).distinct(), "file_id", "left_semi").orderBy("file_id", "line_start")


def symbols_by_name(symbols: DataFrame, files: DataFrame, names) -> DataFrame:
    return symbols.join(names_table(symbols.sparkSession, names, "name"), "name").join(files.select("file_id", "codebase_id", F.col("relative_path").alias("path")), "file_id")


def symbols_by_kind(symbols: DataFrame, files: DataFrame, kind: str, codebase_id: int, limit: int | None = 50) -> DataFrame:
    at = files.filter(F.col("codebase_id") == codebase_id).select("file_id", F.col("relative_path").alias("path"))
    out = symbols.filter(F.col("kind") == kind).join(at, "file_id")
    return out.orderBy("path", "line_start", "name").limit(limit) if limit is not None else out


def members_of(symbols: DataFrame, parent_ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    some = symbols.filter(F.col("kind").isin(kinds)) if kinds else symbols
    return some.join(parent_ids.select(F.col(parent_ids.columns[0]).alias("parent_symbol_id")).distinct(), "parent_symbol_id", "left_semi")


def parameters_of(parameters: DataFrame, symbol_ids: DataFrame) -> DataFrame:
    return parameters.join(symbol_ids.select(F.col(symbol_ids.columns[0]).alias("symbol_id")).distinct(), "symbol_id", "left_semi").orderBy("symbol_id", "position")


def references_by_file(references: DataFrame, symbols: DataFrame, file_ids: DataFrame) -> DataFrame:
    name = symbols.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("resolved_name"), "kind")
    return references.join(file_ids.select(F.col(file_ids.columns[0]).alias("file_id")).distinct(), "file_id", "left_semi").join(name, "symbol_id", "left")


def files_of_codebase(files: DataFrame, codebase_id: int) -> DataFrame:
    return files.filter(F.col("codebase_id") == codebase_id)


def file_by_path(files: DataFrame, codebase_id: int, path: str) -> DataFrame:
    return files.filter((F.col("codebase_id") == codebase_id) & (F.col("relative_path") == path))


def symbol_by_id(symbols: DataFrame, symbol_id: int) -> DataFrame:
    return symbols.filter(F.col("id") == symbol_id)
